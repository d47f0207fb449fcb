"""Problem 4: log lines of many programs into entries with timestamp, level, component and message.

Iterative partitioning: the distinct shapes of the lines that can open an entry
are split by token count, then at the position with the fewest distinct tokens,
then by the bijections between two positions.  Every leaf is a template - a
constant or a variable slot per position.  No list of layouts is kept: the
templates that open with the same kinds of time tokens show together where
their header ends and which of its slots is what.  A slot of nothing but level
words is the level; marks (a colon, brackets, a process id, dashes, bars) show
the component; a word without marks is a component if what follows it differs
freely, and message text if the templates tie it to the word after it.  The
slots are then read from each line, and lines without a header of their own
join the entry before them in their file.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logquarry.session import durable

#: The spellings of levels and the level they stand for.
LEVELS = {
    "TRACE": "TRACE", "DEBUG": "DEBUG", "INFO": "INFO", "WARN": "WARN", "WARNING": "WARN",
    "ERROR": "ERROR", "FATAL": "FATAL", "CRITICAL": "FATAL",
    "T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL",
}
#: Syslog severities 0 to 7.
SEVERITIES = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]

#: Names of one field in entries that name their fields (JSON, key=value).
JSON_TIME = ["time", "ts", "@timestamp", "timestamp"]
JSON_LEVEL = ["level", "severity", "lvl"]
JSON_COMPONENT = ["component", "logger", "name"]
JSON_MESSAGE = ["message", "msg"]

_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DATE = rf"(?:0000[-/.]00[-/.]00|00[-/.]00[-/.]0000|0?0[-/]{_MONTH}[-/]0000)"
_CLOCK = r"0?0:00:00(?:[.,]0+)?"
_ZONE = r"(?:Z|[+-]00:?00)"
_NAME = r"[A-Za-z_$@][\w.$@/-]*"
#: Kinds of tokens, every digit written 0: letter and pattern, first match wins.  Times first, then marks, then text.
KINDS = [
    ("P", r"<0{1,3}>0"),  # syslog priority and version
    ("Q", rf"<0{{1,3}}>{_MONTH}"),  # priority joined to a month
    ("I", rf"{_DATE}[T_:-]{_CLOCK}{_ZONE}?[,:]?"),  # date and time in one
    ("J", rf"[\[(]{_DATE}[T_:-]{_CLOCK}{_ZONE}?[\])]:?"),  # the same in brackets
    ("I", r"0000-00-00-00\.00\.00\.0+"),
    ("D", rf"[\[(]?{_DATE}[\]),]?"),
    ("T", rf"[\[(]?{_CLOCK}{_ZONE}?[\])]?[,:]?"),
    ("E", r"0{10}(?:\.0+)?|0{13}"),  # seconds or milliseconds since 1970
    ("n", r"0{6}"),
    ("N", r"0+"),
    ("y", r"0{1,2},"),
    ("M", _MONTH),
    ("A", r"[AP]M"),
    ("Z", rf"UTC|GMT|{_ZONE}"),
    ("g", r"[TDIWEFC]0000"),  # level letter joined to month and day
    ("L", r"(?i:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL):?"),
    ("l", r"[\[(](?i:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)[\])]:?"),
    ("h", r"-+"),
    ("b", r"[\[(][^\[\]()]+[\])]:?"),
    ("m", rf"{_NAME}(?:\[0+\]:?|\(0+\):|:0+\]|:)"),  # name[pid]:  name:line]  name:
    ("k", r"[A-Za-z_@][\w.@]*=.*"),
    ("w", _NAME),
]
_KIND = [(k, re.compile(p)) for k, p in KINDS]
_ZERO = str.maketrans("123456789", "0" * 9)
#: Kinds a line opens with: times, what may stand before them and a host between two of them.
_OPENING = re.compile(r"(?:[PLlh]|w(?=E))*(?:E[DI]w?I|[IJ]Z?|DT[AZ]?|MN(?:T|NT)Z?|MyNTA?|QNT|nn|gT|TZ?|E)")
#: Fields after the time that are looked at; a header has no more.
HEADER_FIELDS = 8
#: Share of a family's rows that makes a slot one of its kind; the rest are lines of another make.
PURE = 0.95
#: Share of constant positions at which a part is split no more.
CONSTANT = 0.5
#: Distinct shapes partitioned in one task; more are spread over tasks by hash and their evidence is added up.
TASK_SHAPES = 100_000
#: Ways to open a line that the driver may hold.
MAX_FAMILIES = 10_000

#: Rows of one file handled in one window; LineId is unique, so no part is larger.
CHUNK = 100_000


class _Kinds(dict):
    """Kind of each token met, digits written 0."""

    def __missing__(self, tok: str) -> str:
        kind = next((k for k, p in _KIND if p.fullmatch(tok)), "v")
        if len(self) >= 200_000:
            self.clear()
        if len(tok) < 100:
            self[tok] = kind
        return kind


_kinds = _Kinds()


def _tokens(line: str) -> tuple[str, list[str], str]:
    """``(opening, tokens, kinds)`` of a line: the kinds it opens with ('' if no time), '|' added where bars part its fields.

    The tokens of the opening come first; of a barred line each further token is one cell.
    """
    bar = line.find("|", 0, 64)
    zeros = line.translate(_ZERO)
    if bar >= 0:
        toks = line[:bar].split()
        kinds = "".join([_kinds[t] for t in zeros[:bar].split()])
        m = _OPENING.fullmatch(kinds)
        if m is not None:  # bars after the time, not in the text
            cells = [c.strip() for c in line[bar + 1 :].split("|")]
            return kinds + "|", toks + cells, kinds + "".join(["L" if c.upper() in LEVELS else _kinds[c.translate(_ZERO)] for c in cells])
    toks = line.split()
    kinds = "".join([_kinds[t] for t in zeros.split()])
    m = _OPENING.match(kinds)
    return ("" if m is None or m[0].endswith("E") else m[0]), toks, kinds


def _mask(tok: str, kind: str) -> str:
    """A token of a shape: words as they are, numbers in names as 0, all else as its kind."""
    return re.sub("0+", "0", tok.translate(_ZERO)) if kind in "wLlmb" else f"<{kind}>"


def split_shapes(tokens: list[tuple[str, ...]]) -> list[np.ndarray]:
    """Leaves of the iterative partitioning of shapes of one token count, as arrays of their numbers.

    A part with enough constant positions is a leaf.  Else it is split at the
    position with the fewest distinct tokens above one, and each part of it by
    the mapping between the first two positions that share the commonest
    number of distinct tokens: one-to-one pairs become leaves of their own, of
    one-to-many the one decides, many-to-many stay together.
    """
    n = len(tokens[0])
    codes = np.stack([pd.factorize(np.array(col, dtype=object))[0] for col in zip(*tokens)], axis=1) if n else np.zeros((len(tokens), 0), int)

    def card(part: np.ndarray) -> np.ndarray:
        return np.array([len(np.unique(codes[part, j])) for j in range(n)])

    def by(part: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(key, kind="stable")
        return np.split(part[order], np.flatnonzero(np.diff(key[order])) + 1)

    def good(c: np.ndarray) -> bool:
        return n == 0 or (c == 1).mean() >= CONSTANT or c.max() == 1

    out = []
    whole = np.arange(len(tokens))
    c = card(whole)
    for part in [whole] if good(c) else by(whole, codes[whole, np.flatnonzero(c == c[c > 1].min())[0]]):
        c = card(part)
        many = c[c > 1]
        commonest = Counter(many.tolist()).most_common()
        pair = np.flatnonzero(c == max(commonest, key=lambda x: (x[1], -x[0]))[0])[:2] if commonest else []
        if good(c) or len(pair) < 2:
            out.append(part)
            continue
        a, b = codes[part, pair[0]], codes[part, pair[1]]
        to, back = defaultdict(set), defaultdict(set)
        for x, y in set(zip(a.tolist(), b.tolist())):
            to[x].add(y)
            back[y].add(x)
        key = [(0, x, y) if len(to[x]) == 1 == len(back[y]) else (1, x, 0) if len(to[x]) > 1 and all(len(back[z]) == 1 for z in to[x]) else (2, 0, y) if len(back[y]) > 1 and all(len(to[z]) == 1 for z in back[y]) else (3, 0, 0) for x, y in zip(a.tolist(), b.tolist())]
        out += by(part, pd.factorize(pd.Series(key))[0])
    return out


def template_of(tokens: list[tuple[str, ...]]) -> list[str]:
    """Constants and ``<*>`` slots of shapes of one length."""
    return [col[0] if len(set(col)) == 1 and not col[0].startswith("<") else "<*>" for col in zip(*tokens)]


_SHAPES = "opening string, n int, toks string, kinds string, rows bigint"
_LEAVES = "opening string, toks string, template string, prefix string, kinds string, word string, follower string, rows bigint"


def _shape_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shapes of the lines of each batch that open with a time, with their numbers."""
    for b in batches:
        seen: Counter = Counter()
        for line in b.column(0).to_pylist():
            opening, toks, kinds = _tokens(line)
            if opening:
                k = len(opening.rstrip("|"))
                seen[(opening, "\u0001".join([*(f"<{x}>" for x in kinds[:k]), *map(_mask, toks[k:], kinds[k:])]), kinds)] += 1
        if seen:
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([len(k[2]) for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys]), pa.array(list(seen.values()), pa.int64())],
                names=["opening", "n", "toks", "kinds", "rows"],
            )


def _partition(part: pd.DataFrame) -> pd.DataFrame:
    """Leaves of the shapes of one opening and token count: a row for each shape and one for each word in front of another in the header."""
    toks = [tuple(t.split("\u0001")) for t in part["toks"]]
    kinds, rows, opening = part["kinds"].tolist(), part["rows"].tolist(), part["opening"].iloc[0]
    k = len(opening.rstrip("|"))
    out = []
    for leaf in split_shapes(toks):
        inside = [toks[i] for i in leaf]
        template = template_of(inside)
        shown = " ".join(template)
        for i in leaf:
            out.append((opening, part["toks"].iloc[i], shown, None, kinds[i][k : k + HEADER_FIELDS], None, None, rows[i]))
        pairs: Counter = Counter()
        for i in leaf:
            for p in range(k, min(k + HEADER_FIELDS, len(template))):
                if kinds[i][p] in "wL":
                    pairs[(_classes(kinds[i][k:p]), toks[i][p], template[p + 1] if p + 1 < len(template) else "")] += rows[i]
        out += [(opening, None, None, prefix, None, word, follower, m) for (prefix, word, follower), m in pairs.items()]
    return pd.DataFrame(out, columns=["opening", "toks", "template", "prefix", "kinds", "word", "follower", "rows"])


def templates(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves of the iterative partitioning of ``heads(first)``, the lines that can open an entry.

    Returns ``(shapes, words)``: shapes(opening, toks, template, kinds, rows),
    one row for each distinct shape with the template of its leaf; and
    words(opening, prefix, word, follower, rows), what the templates have after
    each word of the header, prefix being the classes of the slots before it.
    """
    shapes = heads.select("first").mapInArrow(_shape_batches, _SHAPES).groupBy("opening", "n", "toks", "kinds").agg(F.sum("rows").alias("rows"))
    shapes = durable(shapes)
    size = shapes.groupBy("opening", "n").agg(F.ceil(F.count("*") / TASK_SHAPES).alias("parts"))
    salted = shapes.join(size, ["opening", "n"]).withColumn("part", F.pmod(F.xxhash64("toks"), F.col("parts")))
    got = durable(salted.groupBy("opening", "n", "part").applyInPandas(lambda pdf: _partition(pdf), _LEAVES))
    return got.where("toks is not null").drop("prefix", "word", "follower"), got.where("toks is null").drop("toks", "template", "kinds")


def _classes(kinds: str) -> str:
    """Kinds as classes of slots: text (with levels), number, dash, bracket, marked name."""
    return "".join("t" if x in "wLvkgMAZPQDTIJEy" else "N" if x == "n" else "b" if x == "l" else x for x in kinds)


def layout_of(opening: str, kinds: Counter, free: dict[str, bool]) -> dict[str, dict]:
    """Slots of the headers with one opening: a way by classes -> {level, comp, end}, positions counted from the opening's end.

    ``kinds`` counts the kinds after the opening; ``free`` says of the text slot
    after some classes whether what follows its words differs freely.  The way
    is walked from the left: it branches by class, so structures that share an
    opening are told apart, and ends where the message starts.
    """
    out: dict[str, dict] = {}

    def share(part: Counter, at: int, want: str) -> float:
        return sum(m for x, m in part.items() if len(x) > at and x[at] in want) / sum(part.values())

    def walk(path: str, part: Counter, level: int | None, names: list[int], brackets: list[int], pid: int | None) -> None:
        at = len(path)
        ahead = Counter()
        next_class = lambda x: _classes(x[at : at + 1]) or "$"
        for x, m in part.items():
            ahead[next_class(x)] += m
        for cls in ahead:
            mine = Counter({x: m for x, m in part.items() if next_class(x) == cls})
            step = path + cls
            done = lambda end, comp=None, lv=level: out.__setitem__(step, {"level": lv, "comp": comp, "end": end})
            chosen = _component(level, names, brackets, pid, mine)
            if cls == "$" or at >= HEADER_FIELDS:
                done(at, chosen)
            elif cls == "m":
                done(at + 1, at) if not names or level is None or max(names) < level or chosen is None else done(at, chosen)
            elif cls == "h":
                walk(step, mine, level, names, brackets, pid)
            elif cls in "tb" and level is None and share(mine, at, "Ll") >= PURE:
                walk(step, mine, at, names, brackets, pid)
            elif cls == "b":
                walk(step, mine, level, names, [*brackets, at], pid)
            elif cls == "N":
                if chosen is None or at - 1 in names:
                    walk(step, mine, level, names, brackets, at - 1 if at - 1 in names else pid)
                else:
                    done(at, chosen)
            elif opening.endswith("|"):
                if chosen is None:
                    walk(step, mine, level, [*names, at], brackets, pid)
                else:
                    done(at, chosen)
            else:
                more = range(at + 1, min(at + 4, HEADER_FIELDS))
                text = lambda j: all(share(mine, i, "wLvNn") >= PURE for i in range(at + 1, j))
                leads = (
                    (level is None and any(share(mine, j, "Ll") >= PURE and text(j) for j in more))
                    or any(share(mine, j, "h") >= PURE and text(j) for j in more)
                    or (chosen is None and share(mine, at + 1, "m") >= PURE)
                )
                if leads:
                    walk(step, mine, level, [*names, at], brackets, pid)
                elif chosen is None and share(mine, at, "wL") >= PURE and (free.get(path, True) or all(len(x) == at + 1 for x in mine)):
                    done(at + 1, at)  # a word with nothing after it fills the header
                else:
                    done(at, chosen)

    walk("", kinds, None, [], [], None)
    return out


def _component(level: int | None, names: list[int], brackets: list[int], pid: int | None, kinds: Counter) -> int | None:
    """The slot of the component so far: the name before a process id, the last name before the level, a name after it, or a bracket."""
    if pid is not None:
        return pid
    if level is not None and (before := [i for i in names if i < level]):
        return before[-1]
    if names:
        return names[0]
    if level is not None and all(x[level] == "l" for x in kinds) and (after := [i for i in brackets if i > level]):
        return after[0]
    return None


def layouts(shapes: DataFrame, words: DataFrame) -> dict[str, dict[str, dict]]:
    """Slots of every opening, from the templates: opening -> ``layout_of``.

    A word that only ever has one word after it is tied, one with several is
    free; a text slot is a field if its free words are no fewer than its tied
    ones.  Single rows prove nothing.  The driver holds a few rows for each
    opening, MAX_FAMILIES openings at most.
    """
    per = words.groupBy("opening", "prefix", "word").agg(F.countDistinct("follower").alias("k"), F.sum("rows").alias("rows"))
    rel = per.groupBy("opening", "prefix").agg(F.count_if(F.col("k") > 1).alias("free"), F.count_if((F.col("k") == 1) & (F.col("rows") > 1)).alias("tied"), F.count("*").alias("words"))
    rel = rel.groupBy("opening").agg(F.map_from_entries(F.collect_list(F.struct("prefix", (F.col("free") >= F.col("tied")) | (F.col("words") == 1)))).alias("free"))
    seen = shapes.groupBy("opening", "kinds").agg(F.sum("rows").alias("rows"))

    def settle(key: tuple, kinds: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
        f = dict(free["free"].iloc[0]) if len(free) else {}
        c: Counter = Counter()
        for x, m in zip(kinds["kinds"], kinds["rows"]):
            c[x] += m
        return pd.DataFrame({"opening": [key[0]], "spec": [json.dumps(layout_of(key[0], c, f))]})

    specs = seen.groupBy("opening").cogroup(rel.groupBy("opening")).applyInPandas(settle, "opening string, spec string")
    got = specs.limit(MAX_FAMILIES + 1).collect()
    if len(got) > MAX_FAMILIES:
        raise ValueError(f"lines open in more than {MAX_FAMILIES} ways")
    return {r["opening"]: json.loads(r["spec"]) for r in got}


class _Header:
    """What a line that opens an entry says of it."""

    __slots__ = ("layout", "shape", "level", "component", "time", "message")

    def __init__(self, layout: str, level: str | None, component: str | None, time: str | None, message: str | None, shape: str | None = None) -> None:
        self.layout, self.level, self.component, self.time, self.message, self.shape = layout, level, component, time, message, shape


_BARE = re.compile(r"^[\[(]|[\])]?:?$")
_MARK = re.compile(r"(?:\[\d+\]:?|\(\d+\):|:\d+\]|:)$")
_PRIORITY = re.compile(r"<(\d{1,3})>")
_FIELD = re.compile(r'(?:^|(?<= ))([A-Za-z_@][\w.@]*)=("[^"]*"|\S*)')
_TOKEN = re.compile(r"\S+")
_OBJECT = re.compile(r"(\{.*?\n\})[ \t]*\r?\n?", re.S)
_OWN_LEVEL = re.compile(r"([A-Z]+): ")
_MEMBER = re.compile(rf'\s*"(?:{"|".join(JSON_TIME + JSON_LEVEL + JSON_COMPONENT + JSON_MESSAGE)})"\s*:')


def level_of(text: str | None) -> str | None:
    """The level a spelling stands for."""
    return LEVELS.get(_BARE.sub("", text).upper()) if text else None


def _named(fields: dict, layout: str) -> _Header | None:
    """Header of an entry that names its fields; without time or message it is none."""
    pick = lambda names: next((fields[n] for n in names if fields.get(n) is not None), None)
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    time, message = text(pick(JSON_TIME)), text(pick(JSON_MESSAGE))
    if time is None or message is None:
        return None
    return _Header(layout, level_of(text(pick(JSON_LEVEL))), text(pick(JSON_COMPONENT)), time, message)


def _object(text: str) -> dict | None:
    try:
        o = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def read_header(first: str, content: str, specs: dict[str, dict[str, dict]], bodies: bool = True) -> _Header | None:
    """Header of a line by the slots of the templates that open like it; None if it has none.  Without ``bodies`` no time, message and shape."""
    if first[:1] == "{":
        if first == "{":
            m = _OBJECT.match(content)
            got = _named(_object(m[1]) or {}, "jsonlines") if m else None
            return got or _Header("jsonopen", None, None, None, None)
        return _named(_object(first) or {}, "json") if first.rstrip().endswith("}") else None
    opening, toks, kinds = _tokens(first)
    if not opening:
        if kinds[:1] != "k":
            return None
        fields = {k: v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' else v for k, v in reversed(_FIELD.findall(first))}
        got = _named(fields, "keys")
        return got if got and (got.level or got.component) else None
    spec = specs.get(opening)
    k = len(opening.rstrip("|"))
    way = _classes(kinds[k : k + HEADER_FIELDS]) + "$"
    slots = next((spec[way[:j]] for j in range(1, len(way) + 1) if way[:j] in spec), None) if spec else None
    if slots is None:
        return None
    lv, comp = slots["level"], slots["comp"]
    level = component = None
    if lv is not None:
        if kinds[k + lv] not in "Ll":
            return None
        level = level_of(toks[k + lv])
    else:
        lead = next((i for i in range(k) if kinds[i] in "LlgPQ"), None)
        if lead is not None:
            p = _PRIORITY.match(toks[lead])
            level = SEVERITIES[int(p[1]) % 8] if p else level_of(toks[lead][0] if kinds[lead] == "g" else toks[lead])
    if comp is not None:
        if kinds[k + comp] not in "wLmb":
            return None
        component = _MARK.sub("", toks[k + comp]) if kinds[k + comp] == "m" else _BARE.sub("", toks[k + comp]) if kinds[k + comp] == "b" else toks[k + comp]
    if level is None and component is None:
        return None
    end = k + slots["end"]
    layout = opening if end < len(toks) else f"{opening}$"
    if not bodies:
        return _Header(layout, level, component, None, None)
    time = [_BARE.sub("", t) for t, x in zip(toks[:k], kinds[:k]) if x not in "PQLlhw"]
    if kinds[0] in "Qg":
        time.insert(0, re.sub(r"^<\d+>|^[A-Z](?=\d)", "", toks[0])) if kinds[0] == "Q" else time.__setitem__(0, toks[0][1:])
    last = next((i for i in range(k - 1, -1, -1) if kinds[i] in "IJ"), None)
    if last is not None:
        time = [_BARE.sub("", toks[last])]
    if opening.endswith("|"):
        message = first.split("|", end - k + 1)[-1] if len(toks) > end else ""
    else:
        ends = [m.end() for _, m in zip(range(end), _TOKEN.finditer(first))]
        message = first[ends[-1] :] if ends else first
        message = message[1:] if message[:1] == " " else message
    shape = "\u0001".join([*(f"<{x}>" for x in kinds[:k]), *map(_mask, toks[k:], kinds[k:])])
    return _Header(layout, level, component, " ".join(time), message, shape)


#: Of each row: what a header says, and what rows below a header may add to it.
_READ = [
    ("LineId", pa.int64()), ("Logrecord", pa.string()), ("mark", pa.int64()), ("layout", pa.string()), ("lv", pa.string()), ("comp", pa.string()),
    ("member", pa.string()), ("closes", pa.bool_()), ("second", pa.string()), ("own", pa.string()), ("multi", pa.bool_()),
    ("at", pa.string()), ("msg", pa.string()), ("shape", pa.string()), ("text", pa.string()),
]
#: The columns that the result needs with bodies only.
_BODY = 4


def _first_line(content: str) -> str:
    at = content.find("\n")
    first = content if at < 0 else content[:at]
    return first[:-1] if first.endswith("\r") else first


def _read_rows(batches: Iterator[pa.RecordBatch], specs: dict[str, dict[str, dict]], bodies: bool) -> Iterator[pa.RecordBatch]:
    """Header and text of every row that no parser read before."""
    fields = _READ if bodies else _READ[:-_BODY]
    own_level = lambda line: m[1] if (m := _OWN_LEVEL.match(line)) else None
    for b in batches:
        rows: list[tuple] = []
        for line, record, content in zip(*(c.to_pylist() for c in b.columns)):
            content = content or ""
            first = _first_line(content)
            h = read_header(first, content, specs, bodies) if first[:1].strip() else None
            multi = len(first) < len(content) and "\n" in content
            if h is None:
                row = (line, record, None, None, None, None, first if _MEMBER.match(first) else None, first[:1] == "}", None, own_level(first), multi)
                rows.append(row + (None, None, None, content) if bodies else row)
                continue
            second = own_level(content.split("\n", 2)[1]) if multi and h.layout.endswith("$") else None
            row = (line, record, line, h.layout, h.level, h.component, None, False, second, None, multi)
            if bodies:
                msg = h.message
                if h.layout == "jsonlines":
                    behind = _OBJECT.sub("", content, count=1)
                    msg = "\n".join(x for x in (msg, behind) if x) if msg or behind else msg
                elif multi and h.layout != "jsonopen":
                    msg = f"{msg or ''}\n{content.split(chr(10), 1)[1]}"
                row += (h.time, msg, h.shape, content if h.layout == "jsonopen" else None)
            rows.append(row)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _level_of(tok: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return F.try_element_at(names, F.upper(tok))  # one reading of the token, however it is come by


def _json(col: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(col, f"$['{n}']") for n in names])


def _before(df: DataFrame, mark: str, out: str) -> DataFrame:
    """Last non-null ``mark`` at or before each row of its Logrecord, by LineId; a LineId met again is left out.

    Windows cover at most CHUNK rows of a file; what a chunk hands on is one
    row, so a file with a third of all lines is not gathered in one task.
    """
    w = W.partitionBy("Logrecord", "chunk").orderBy("LineId")
    d = df.withColumn("chunk", F.floor(F.col("LineId") / CHUNK)).withColumn("again", F.lag("LineId").over(w).eqNullSafe(F.col("LineId")))
    d = d.withColumn("here", F.last(mark, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).where("not again").drop("again")
    d = durable(d)
    ends = d.groupBy("Logrecord", "chunk").agg(F.max("here").alias("end"))  # marks are LineIds, the last is the greatest
    wc = W.partitionBy("Logrecord").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col("Logrecord").alias("lr_"), F.col("chunk").alias("ch_"), F.last("end", ignorenulls=True).over(wc).alias("carry")).where("carry is not null")
    d = d.join(ends, F.col("Logrecord").eqNullSafe(F.col("lr_")) & (F.col("chunk") == F.col("ch_")), "left")
    return d.withColumn(out, F.coalesce("here", "carry")).drop("chunk", "here", "lr_", "ch_", "carry")


def entries(log_lines: DataFrame, bodies: bool = True) -> DataFrame:
    """One row per log entry: (Logrecord, first_line, last_line, time_text, ts, level, component, message, n_rows, layout, template).

    ``log_lines`` needs LineId, Logrecord, Date, Time, Level, Component,
    Content; further columns are ignored.  Rows with a Date were parsed before
    and open an entry.  Rows with NULL or blank Content, indented rows and rows
    whose template has no header belong to the entry before them in the same
    Logrecord (NULL is one Logrecord of its own); rows before the first entry
    belong to none.  A LineId repeated in its Logrecord counts once.  level is
    '' where the header has none.  message is the text after the header with
    the further rows of the entry as lines below it, however the entry was
    delivered, NULL rows being blank lines; rows of a JSON object that is the
    header are no text of their own.  Without ``bodies`` no text is read beyond
    the headers, and message and template are NULL.  layout is the kinds of
    the tokens the entry opens with ('$' where the header is the whole line),
    or parsed, keys, json, jsonlines (an object in one row) or jsonopen (in
    several).  n_rows counts the rows of the entry.
    An empty table gives no rows.
    """
    base = log_lines.select(F.col("LineId").cast("bigint"), "Logrecord", F.col("Date").cast("string"), F.col("Time").cast("string"), "Level", "Component", "Content").where("LineId is not null")
    first = F.regexp_replace(F.split("Content", "\n", 2)[0], r"\r$", "")
    shapes, words = templates(base.where(F.col("Date").isNull() & F.col("Content").rlike(r"^[^\s{]")).select(first.alias("first")))
    specs = layouts(shapes, words)
    sql = ", ".join(f"{n} {({pa.int64(): 'bigint', pa.bool_(): 'boolean'}).get(t, 'string')}" for n, t in (_READ if bodies else _READ[:-_BODY]))
    read = base.where(F.col("Date").isNull()).select("LineId", "Logrecord", "Content").mapInArrow(lambda b: _read_rows(b, specs, bodies), sql)
    told = {"LineId": F.col("LineId"), "Logrecord": F.col("Logrecord"), "mark": F.col("LineId"), "layout": F.lit("parsed"), "lv": _level_of(F.trim("Level")), "comp": F.col("Component"), "at": F.concat_ws(" ", "Date", "Time"), "msg": F.col("Content")}
    parsed = base.where(F.col("Date").isNotNull()).select(*[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in read.schema])
    d = _before(read.unionByName(parsed), "mark", "prov")
    body = F.col("LineId") > F.col("prov")
    none = F.lit(None).cast("string")
    texts = [F.collect_list(F.when(body & F.col("text").isNotNull(), F.struct("LineId", "text"))).alias("below"), F.max(F.when(~body, F.col("text"))).alias("opening")] if bodies else []
    prov = d.where("prov is not null").groupBy("Logrecord", "prov").agg(
        F.max(F.when(~body, F.struct("layout", "lv", "comp", "second", "multi", *(["at", "msg", "shape"] if bodies else [none.alias("at"), none.alias("msg"), none.alias("shape")])))).alias("h"),
        F.min(F.when(body, F.struct("LineId", "own"))).alias("next"),
        F.array_sort(F.collect_list(F.when(body & F.col("member").isNotNull(), F.struct("LineId", "member")))).alias("members"),
        F.min(F.when(body & F.col("closes"), F.col("LineId"))).alias("closing"),
        F.max("LineId").alias("last_line"), F.count("*").alias("n_rows"), *texts,
    )
    # an opening brace is a header only if the object after it has time and message
    opened = (F.col("h.layout") == "jsonopen") & ~F.coalesce(F.col("h.multi"), F.lit(False))
    own = F.transform(F.filter("members", lambda x: x.LineId < F.col("closing")), lambda x: F.regexp_replace(x.member, r",\s*$", ""))
    prov = prov.withColumn("js", F.when(opened, F.concat(F.lit("{"), F.concat_ws(",\n", own), F.lit("}"))))
    js = F.col("js")
    whole_line = F.col("h.layout").endswith("$")
    cols = [
        "Logrecord", "prov", "last_line", "h.layout", "h.shape",
        F.when(opened, _level_of(_json(js, JSON_LEVEL))).when(whole_line & F.col("h.lv").isNull(), _level_of(F.coalesce("h.second", F.when(~F.coalesce(F.col("h.multi"), F.lit(False)), F.col("next.own"))))).otherwise(F.col("h.lv")).alias("level"),
        F.when(opened, _json(js, JSON_COMPONENT)).otherwise(F.col("h.comp")).alias("component"),
        F.when(opened, _json(js, JSON_TIME)).otherwise(F.col("h.at")).alias("time_text"),
        F.when(opened, _json(js, JSON_MESSAGE)).otherwise(F.col("h.msg")).alias("message"),
        (opened & _json(js, JSON_MESSAGE).isNull()).alias("no_message"), "n_rows",
    ]
    if bodies:
        # of an object that is a header, only what stands behind its last brace is further text
        last = F.regexp_replace(F.get(F.transform(F.filter("below", lambda x: x.LineId == F.col("closing")), lambda x: x.text), F.lit(0)), r"^\}[ \t]*\r?\n?", "")
        after = F.concat(F.when(F.length(last) > 0, F.array(F.struct(F.col("closing").alias("LineId"), last.alias("text")))).otherwise(F.filter("below", lambda x: F.lit(False))), F.filter("below", lambda x: x.LineId > F.col("closing")))
        cols += ["below", "opening", F.when(opened, after).otherwise(F.col("below")).alias("after")]
    prov = durable(prov.select(*cols))
    real = (F.col("layout") != "jsonopen") | (F.col("time_text").isNotNull() & ~F.col("no_message"))
    marks = prov.select("Logrecord", F.col("prov").alias("LineId"), F.when(real, F.col("prov")).alias("m"), "last_line", "n_rows", *([F.when(real, F.col("after")).otherwise(F.concat(F.array(F.struct(F.col("prov").alias("LineId"), F.col("opening").alias("text"))), "below")).alias("texts")] if bodies else []))  # what is no header belongs to the entry before, its opening row too
    ends = _before(marks, "m", "first_line").where("first_line is not null").groupBy("Logrecord", "first_line").agg(F.max("last_line").alias("last_line"), F.sum("n_rows").alias("n_rows"), *([F.array_sort(F.flatten(F.collect_list("texts"))).alias("texts")] if bodies else []))
    kept = prov.where(real).select(F.col("Logrecord").alias("lr_"), "prov", "layout", "shape", F.coalesce("level", F.lit("")).alias("level"), F.coalesce("component", F.lit("")).alias("component"), "time_text", "message")
    out = ends.join(kept, (F.col("first_line") == F.col("prov")) & F.col("Logrecord").eqNullSafe(F.col("lr_")))
    if bodies:
        out = out.withColumn("message", F.when(F.size("texts") > 0, F.concat_ws("\n", "message", F.array_join(F.transform("texts", lambda x: x.text), "\n"))).otherwise(F.col("message")))
        out = out.withColumn("message", F.when(F.col("layout").endswith("$"), F.regexp_replace("message", r"^\n?[A-Z]+: ", "")).otherwise(F.col("message")))
        leaf = shapes.select(F.col("opening").alias("op_"), F.col("toks").alias("shape"), "template").distinct()
        out = out.withColumn("op_", F.regexp_replace("layout", r"\$$", "")).join(leaf, ["op_", "shape"], "left")
    else:
        out = out.withColumn("message", none).withColumn("template", none)
    return out.select("Logrecord", "first_line", "last_line", "time_text", _timestamp(F.col("time_text")).alias("ts"), "level", "component", "message", "n_rows", "layout", "template")


def _timestamp(text: Column) -> Column:
    """Local time of a header; NULL where the header has no year or no readable time."""
    t = F.regexp_replace(F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", ""), ",(?=\\d)", ".")
    forms = ["yyyy-MM-dd HH:mm:ss[.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd-HH.mm.ss.SSSSSS", "dd-MMM-yyyy HH:mm:ss[.SSS]", "yyMMdd HHmmss", "MMM d, yyyy h:mm:ss a", "yyyy/MM/dd HH:mm:ss[.SSS]"]
    epoch = F.when(text.rlike(r"^\d{13}$"), F.timestamp_millis(F.when(text.rlike(r"^\d{13}$"), text).cast("bigint"))).when(text.rlike(r"^\d{10}$"), F.timestamp_seconds(F.when(text.rlike(r"^\d{10}$"), text).cast("bigint")))
    return F.coalesce(epoch, *[F.try_to_timestamp(t, F.lit(f)) for f in forms])


def found(log_lines: DataFrame) -> DataFrame:
    """Entries as (first_line, last_line, level, component)."""
    return entries(log_lines, bodies=False).select("first_line", "last_line", "level", "component")
