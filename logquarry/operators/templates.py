"""Online template miner: lines to templates by prefix, word set, then longest common subsequence.

Templates lie in an index by word and by opening, so a line meets only the
templates it shares words with; common subsequences are measured on bit
vectors.  The miner is sequential, so a file of too many lines is mined in
bounded chunks and once more over the templates the chunks found, which are few.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from logquarry.session import durable

WILD = "<*>"
EMPTY = "<empty>"
#: Lines of one mining task.
CHUNK_LINES = 20_000
#: Least share of a line's words that a template must have to be looked at by set or sequence; fixed by the rules.
LOOK = 0.5
#: Default masks, applied in order.
MASKS = (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"(?<=[^A-Za-z0-9])(?:-?\d+(?:\.\d+)?)(?=[^A-Za-z0-9]|$)", r"\b[0-9a-f]{8,}\b")


class Alignment:
    """A line measured against templates: bit k of a vector stands for position k of the template.

    After the line's first i words the zero bits below k are the length of the
    longest common subsequence with the template's first k words.
    """

    def __init__(self, line: list[str], template: list[str]) -> None:
        places: dict[str, int] = defaultdict(int)
        for k, word in enumerate(template):
            places[word] |= 1 << k
        self.line = line
        self.vectors = [(1 << len(template)) - 1]
        full = self.vectors[0]
        for word in line:
            v = self.vectors[-1]
            hit = v & places.get(word, 0)
            self.vectors.append(((v + hit) | (v - hit)) & full)
        self.width = len(template)
        self.length = self.width - self.vectors[-1].bit_count()

    def words(self) -> list[str]:
        """The common subsequence; of equal ones that which gives up words of the line first, from the end."""
        below = lambda i, k: k - (self.vectors[i] & ((1 << k) - 1)).bit_count()
        taken: list[str] = []
        i, k = len(self.line), self.width
        while len(taken) < self.length:
            if below(i - 1, k) == below(i, k):
                i -= 1
            elif self.vectors[i] >> (k - 1) & 1:
                k -= 1
            else:
                i, k = i - 1, k - 1
                taken.append(self.line[i])
        return taken[::-1]


def widen(template: list[str], kept: list[str]) -> list[str]:
    """The template with a wildcard in place of every word before the last kept one, and one for all after it.

    Kept words are looked for from the left.
    """
    at: list[int] = []
    for word in kept:
        at.append(template.index(word, at[-1] + 1 if at else 0))
    if not at:
        return []
    hold = set(at)
    return [w if k in hold else WILD for k, w in enumerate(template[: at[-1] + 1])] + [WILD] * (at[-1] + 1 < len(template))


class Miner:
    """Templates met so far, numbered in order of appearance."""

    def __init__(self, tau: float = 0.5, templates: Iterable[list[str]] = ()) -> None:
        self.tau = tau
        self.templates: list[list[str]] = []
        self.having: dict[str, set[int]] = defaultdict(set)  # word -> templates
        self.fixed: list[int] = []  # distinct words of each template that are no wildcard
        self.openings: dict[tuple[str, ...], list] = {}  # leading fixed words -> [templates under it, template that ends there]
        for t in templates:
            self.templates.append([])
            self.fixed.append(0)
            self._file(len(self.templates) - 1, t)

    @staticmethod
    def _openings(words: Iterable[str]) -> list[tuple[str, ...]]:
        fixed = tuple(w for w in words if w != WILD)
        return [fixed[: k + 1] for k in range(len(fixed))]

    def _file(self, n: int, template: list[str]) -> None:
        """Puts template ``n`` under its words and openings, taking it from where it was."""
        for word in set(self.templates[n]):
            self.having[word].discard(n)
        for path in self._openings(self.templates[n]):
            self.openings[path][0] -= 1
            if not self.openings[path][0]:
                del self.openings[path]
        self.templates[n] = template
        self.fixed[n] = len({*template} - {WILD})
        for word in set(template):
            self.having[word].add(n)
        paths = self._openings(template)
        for path in paths:
            self.openings.setdefault(path, [0, None])[0] += 1
        if paths and self.openings[paths[-1]][1] is None:
            self.openings[paths[-1]][1] = n

    def _by_opening(self, words: list[str]) -> int | None:
        """Walk along the openings, words that lead nowhere being passed over; a template with too few fixed words is passed over too, not gone below."""
        path: tuple[str, ...] = ()
        for word in words:
            uses_end = self.openings.get((*path, word))
            if uses_end is None:
                continue
            n = uses_end[1]
            if n is None:
                path = (*path, word)
            elif len(self.templates[n]) - self.templates[n].count(WILD) >= self.tau * len(words):
                return n
        return None

    def _by_words(self, words: list[str]) -> int | None:
        """First template that is long enough and has no fixed word which the line lacks."""
        shared = Counter(n for word in set(words) for n in self.having.get(word, ()))
        fits = [n for n, k in shared.items() if k == self.fixed[n]] + [n for n in self.having.get(WILD, ()) if not self.fixed[n]]
        return min((n for n in fits if len(self.templates[n]) >= LOOK * len(words)), default=None)

    def _by_order(self, words: list[str]) -> tuple[int, Alignment] | None:
        """Template with the longest subsequence in common, then the shorter, then the earlier one."""
        shared = Counter(n for word in set(words) for n in self.having.get(word, ()))
        best: tuple[tuple[int, int, int], Alignment] | None = None
        for n in sorted(shared):
            if shared[n] >= LOOK * len(words):
                a = Alignment(words, self.templates[n])
                rank = (a.length, -len(self.templates[n]), -n)
                if best is None or rank > best[0]:
                    best = (rank, a)
        return (-best[0][2], best[1]) if best and best[1].length >= self.tau * len(words) else None

    def tree(self) -> list[str]:
        """The openings as indented lines, each with the number of templates under it and the template that ends there."""
        return [f"{'  ' * (len(path) - 1)}{path[-1]} ({uses}{'' if n is None else f', template {n}'})" for path, (uses, n) in sorted(self.openings.items())]

    def add(self, words: list[str]) -> int:
        """Number of the template of a tokenised line; may widen it.  A line without words has the number -1."""
        if not words:
            return -1
        fixed = [w for w in words if w != WILD]
        for rule in (self._by_opening, self._by_words):
            if (n := rule(fixed)) is not None:
                return n
        if (found := self._by_order(words)) is None:
            self.templates.append([])
            self.fixed.append(0)
            self._file(len(self.templates) - 1, words)
            return len(self.templates) - 1
        n, alignment = found
        wider = widen(self.templates[n], alignment.words())
        if wider != self.templates[n]:
            self._file(n, wider)
        return n


def masked(text: Column, masks: Iterable[str] = MASKS) -> Column:
    """Text with what the masks match as wildcards; NULL becomes ''."""
    c = F.coalesce(text, F.lit(""))
    for m in masks:
        c = F.regexp_replace(c, m, WILD)
    return c


def parameters(text: str | None, template: str | None) -> list[str]:
    """What stands at the wildcards of a template, blanks squeezed; none if the text does not fit it.

    The fixed parts are looked for from the left, the last one at the end.
    """
    if not text or not template or WILD not in template:
        return []
    first, *parts = " ".join(template.split()).split(WILD)
    line = " ".join(text.split())
    if not line.startswith(first):
        return []
    at, values = len(first), []
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        hit = (len(line) - len(part) if line.endswith(part) else -1) if last else line.find(part, at)
        if hit < at:
            return []
        values.append(line[at:hit])
        at = hit + len(part)
    return values


def with_parameters(df: DataFrame, text: str, template: str, out: str = "parameters") -> DataFrame:
    """Adds ``out``: the values at the wildcards of each row's template; [] where there is none or the text does not fit."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def values(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([parameters(a, b) for a, b in zip(t, p)], dtype=object)

    return df.withColumn(out, values(text, template))


def mine(lines: DataFrame, group: str, order: str, text: str, tau: float = 0.5, masks: Iterable[str] = MASKS, chunk: int = CHUNK_LINES) -> DataFrame:
    """(order, template, event_id): the template of every line; event_id numbers templates by first line inside a group.

    A group of at most ``chunk`` lines is mined as a whole, by the sequential
    rules, wherever its order numbers lie.  A larger one is cut into chunks of
    so many lines, and the templates of its chunks are mined again, in order,
    to one set.  NULL and empty lines have the template '<empty>'.
    """
    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Miner(tau)
        pdf = pdf.sort_values("o")
        at = [m.add(x.split()) for x in pdf["t"]]
        shown = [" ".join(t) for t in m.templates]
        return pd.DataFrame({"g": pdf["g"], "o": pdf["o"], "first": [shown[n] if n >= 0 else EMPTY for n in at], "n": at, "whole": pdf["whole"]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Miner(tau)
        pdf = pdf.sort_values(["o", "first"])
        at = [m.add(x.split()) if x != EMPTY else -1 for x in pdf["first"]]
        shown = [" ".join(t) for t in m.templates]
        return pd.DataFrame({"g": pdf["g"], "first": pdf["first"], "template": [shown[n] if n >= 0 else EMPTY for n in at], "n": at})

    d = lines.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(order).cast("bigint").alias("o"), masked(F.col(text), masks).alias("t"))
    # row numbers inside a group: counted in buckets of order numbers and moved up by the rows before
    d = d.withColumn("b", F.floor(F.col("o") / chunk))
    w = W.partitionBy("g").orderBy("b")
    rows = d.groupBy("g", "b").agg(F.count("*").alias("k"))
    rows = rows.select("g", "b", (F.sum("k").over(w) - F.col("k")).alias("before"), (F.sum("k").over(W.partitionBy("g")) <= chunk).alias("whole"))
    d = d.withColumn("r", F.row_number().over(W.partitionBy("g", "b").orderBy("o"))).join(rows, ["g", "b"])
    d = d.select("g", "o", "t", "whole", F.floor((F.col("before") + F.col("r") - 1) / chunk).alias("c"))
    got = durable(d.groupBy("g", "c").applyInPandas(local, "g string, o bigint, first string, n int, whole boolean"))
    cut = got.where("not whole").select("g", "o", "first")
    names = cut.groupBy("g", "first").agg(F.min("o").alias("o")).groupBy("g").applyInPandas(join, "g string, first string, template string, n int")
    out = got.where("whole").select("g", "o", F.col("first").alias("template"), "n").unionByName(cut.join(names, ["g", "first"]).select("g", "o", "template", "n"))
    return out.select(F.col("o").alias(order), "template", F.concat(F.col("g"), F.lit(":"), (F.col("n") + 1).cast("string")).alias("event_id"))
