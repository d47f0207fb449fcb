"""Problem 2: spellings of names linked to the registry entry they mean.

Metric-space partitioning: the family part of a name (of an organisation, its
proper part) is a point.  Pivots part the space under the bag distance, the
least edits that turn the letters of one word into those of another whatever
their order: a true metric, below the edit distance, to which a swap costs
nothing, so the radius stays one and the cells prune.  Every registry point
lies in the cell of its nearest pivot; a typed name goes to each cell that may
hold a point within the radius, as the triangle inequality tells of the cell's
pivot and of every other, and inside a cell an exact radius join runs under the
Damerau-Levenshtein distance.  An exact check of the whole name then settles
which entry is meant, if it is one only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

#: Radius of the join: one letter missing, added, changed or swapped with its neighbour.
RADIUS = 1
#: Points of a cell on average, and the bounds of the number of pivots, which are taken in hash order of the points.
CELL_POINTS, LEAST_PIVOTS, MOST_PIVOTS = 4, 4, 1024
#: Letters are counted in so many classes.
LETTERS = 32
SALTS = 8

#: Short forms of given names and the names they stand for; a parameter of ``link`` and ``found``.
#: Short forms that are beginnings of a name need no entry.
NICKNAMES: dict[str, str | tuple[str, ...]] = {
    "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "al": "alexander", "xander": "alexander",
    "archie": "archibald", "baldo": "archibald", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin",
    "chris": "christopher", "kit": "christopher", "topher": "christopher",
    "dora": "dorothea", "thea": "dorothea", "dot": "dorothea", "dorothy": "dorothea", "dolly": "dorothea", "dory": "dorothea",
    "katya": "ekaterina", "katia": "ekaterina", "katja": "ekaterina", "kata": "ekaterina",
    "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "libby": "elizabeth", "bess": "elizabeth", "betsy": "elizabeth", "ella": "elizabeth",
    "paco": "francisco", "pancho": "francisco", "fran": "francisco", "frank": "francisco", "cisco": "francisco", "kiko": "francisco",
    "fred": "frederick", "freddy": "frederick", "freddie": "frederick", "rick": ("richard", "frederick"), "fritz": "frederick",
    "gabi": "gabriela", "gaby": "gabriela", "gabby": "gabriela", "ela": "gabriela",
    "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "peppino": "giuseppe",
    "jo": "josephine", "josie": "josephine", "josy": "josephine", "fina": "josephine", "posy": "josephine",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kitty": "katherine", "kay": "katherine",
    "leo": "leonardo", "nardo": "leonardo", "len": "leonardo", "lenny": "leonardo",
    "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "greta": "margaret", "marge": "margaret", "margie": "margaret", "daisy": "margaret", "peg": "margaret", "rita": "margaret", "madge": "margaret",
    "misha": "mikhail", "mischa": "mikhail", "mike": "mikhail",
    "nat": ("nathaniel", "natalie"), "nate": "nathaniel", "nathan": "nathaniel", "nick": "nicholas",
    "dick": "richard", "rich": "richard", "richie": "richard", "ricky": "richard", "ritchie": "richard",
    "bob": "robert", "rob": "robert", "bobby": "robert", "robbie": "robert", "bert": "robert", "robby": "robert",
    "sam": ("samantha", "samuel"), "sammy": ("samantha", "samuel"), "mantha": "samantha", "sammie": "samantha",
    "sue": "susannah", "susie": "susannah", "suzy": "susannah", "susan": "susannah", "anna": "susannah", "zanna": "susannah", "sanna": "susannah",
    "ted": "theodore", "theo": "theodore", "teddy": "theodore",
    "tori": "victoria", "vicky": "victoria", "vic": "victoria", "vicki": "victoria", "vickie": "victoria", "tory": "victoria",
    "mina": "wilhelmina", "willa": "wilhelmina", "minnie": "wilhelmina", "billie": "wilhelmina", "wilma": "wilhelmina", "helma": "wilhelmina",
    "bill": "william", "will": "william", "billy": "william", "willy": "william", "willie": "william", "liam": "william",
}
#: Words that open or close a person's name without being part of it.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "sir", "mx"}
SUFFIXES = {"jr", "sr", "phd", "md", "msc", "ii", "iii", "iv", "esq"}
#: Words that belong to the family name after them.
PARTICLES = {"van", "der", "den", "de", "von", "ter", "ten", "la", "le", "del", "di", "da", "zu", "zur", "af", "av"}
#: Short forms of words in the names of organisations.
ORG_WORDS = {
    "inst": "institute", "lab": "laboratory", "labs": "laboratory", "obs": "observatory", "ctr": "centre", "cent": "centre", "center": "centre",
    "acad": "academy", "cons": "consortium", "univ": "university", "dept": "department", "assoc": "association", "soc": "society", "grp": "group", "fdn": "foundation",
}
ORG_KINDS = set(ORG_WORDS.values())

#: Letters that do not decompose, in their plain spelling.
_PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "’": "'", "‐": "-", "‑": "-"})


def fold(s: str) -> str:
    """Small letters without accents."""
    s = unicodedata.normalize("NFKD", s.translate(_PLAIN))
    return "".join(c for c in s if not unicodedata.combining(c)).lower()


def slip(a: str, b: str) -> int:
    """0 if equal, 1 if one letter is missing, added, changed or swapped with its neighbour, else 2."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return 2
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    if ra[1:] == rb[1:] or ra[1:] == rb or ra == rb[1:]:
        return 1
    return 1 if len(ra) >= 2 and len(rb) >= 2 and ra[0] == rb[1] and ra[1] == rb[0] and ra[2:] == rb[2:] else 2


def _words(s: str) -> list[tuple[str, bool]]:
    """Folded words of a name, each with whether it is an initial."""
    out = []
    loud = any(w.isupper() for w in re.findall(r"[^\W\d_]{4,}", s))
    for m in re.finditer(r"[^\W\d_]+(?:['’‐‑-][^\W\d_]+)*\.?", s):
        w = m[0].rstrip(".")
        if len(w) == 1:
            out.append((fold(w), True))
        elif len(w) <= 3 and w.isupper() and not s.isupper() and (fold(w) not in SUFFIXES or not m.start()) and not (loud and fold(w) in PARTICLES):
            out += [(fold(c), True) for c in w]
        else:
            out.append((fold(w), False))
    return out


def _org(s: str) -> list[tuple[str, str, list[str]]]:
    """Readings of a text as an organisation: ('org', proper part, [kind, topic words])."""
    t = re.sub(r"\([^()]*\)", " ", s)
    parts = [[w for w in re.findall(r"[^\W_]+", fold(x))] for x in t.split(",")]
    parts = [[ORG_WORDS.get(w, w) for w in p] for p in parts if p]
    if not parts:
        return []
    if parts[0] and parts[0][0] == "the":
        parts[0] = parts[0][1:]
    flat = [w for p in parts for w in p]
    kinds = [w for w in flat if w in ORG_KINDS]
    if len(kinds) != 1:
        return []
    kind = kinds[0]
    if len(parts) == 2:  # "Topic Kind, Proper"
        proper, rest = " ".join(parts[1]), [w for w in parts[0] if w not in (kind, "of", "for", "the", "and")]
    elif "of" in flat:  # "Proper Kind of Topic"
        i = flat.index(kind)
        proper, rest = " ".join(flat[:i]), [w for w in flat[i + 1 :] if w not in ("of", "for", "the", "and")]
    else:  # "Proper Topic Kind"
        proper, rest = flat[0], [w for w in flat[1:] if w != kind]
    return [("org", proper, [kind, *rest])] if proper else []


def readings(name: str | None) -> list[tuple[str, str, list[str]]]:
    """Ways to read a typed name: (kind, point, rest).

    kind person: point is the family name with its particles, rest the given
    words, an initial as 'x.'.  kind org: see ``_org``.  kind acronym: point
    is the letters.  NULL, blank or letterless names have no reading.
    """
    s = unicodedata.normalize("NFC", name or "").strip()
    out = list(_org(s))
    if out:
        return out
    letters = re.sub(r"[\s.]", "", s)
    if re.fullmatch(r"[A-Z]{3,8}", letters) and (letters == s or re.fullmatch(r"(?:[A-Z]\.\s*){3,8}", s)):
        out.append(("acronym", letters.lower(), []))
    segs = [_words(x) for x in s.split(",")]
    segs = [[w for w in g if w[0] not in SUFFIXES | TITLES or w[1]] for g in segs]
    segs = [g for g in segs if g]
    if not segs:
        return out

    def person(family: list[tuple[str, bool]], given: list[tuple[str, bool]]) -> None:
        if family and not any(i for _, i in family):
            out.append(("person", " ".join(w for w, _ in family), [w + "." * i for w, i in given]))

    if len(segs) >= 2:
        person(segs[0], [w for g in segs[1:] for w in g])
    else:
        g = segs[0]
        n = len(g)
        start = next((i for i, (w, _) in enumerate(g) if w in PARTICLES), None)
        if n == 1:
            person(g, [])
        elif start is not None and start > 0:  # Given van der Family
            person(g[start:], g[:start])
        else:
            end = max((i for i, (w, _) in enumerate(g) if w in PARTICLES), default=-1) + 2 if start == 0 else 1
            k = max(i for i, (_, ini) in enumerate(g) if not ini) if any(not i for _, i in g) else -1
            if start is None and k >= 0:
                person([g[k]], g[:k] + g[k + 1 :])  # Given Family, Given M. Family, or Family G.
            person(g[:end], g[end:])  # Family Given
    seen, uniq = set(), []
    for r in out:
        if (key := (r[0], r[1], tuple(r[2]))) not in seen:
            seen.add(key)
            uniq.append(r)
    return uniq


_READ = T.ArrayType(T.StructType().add("kind", T.StringType()).add("point", T.StringType()).add("rest", T.ArrayType(T.StringType())))


@F.pandas_udf(_READ)
def _readings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([[{"kind": k, "point": p, "rest": r} for k, p, r in readings(x)] for x in s])


def tier(kind: str, point: str, rest: list[str], r_point: str, r_rest: list[str], nicknames: Mapping[str, str | tuple[str, ...]] = NICKNAMES) -> int:
    """How well a reading fits a registry entry: 0 best, 99 not at all."""
    f = slip(point, r_point)
    if f > 1 or (f and len(r_point) < 4):
        return 99
    if kind == "acronym":
        return 1 if f == 0 else 99
    if kind == "org":
        if sorted(rest) == sorted(r_rest):
            return f
        bad = [slip(a, b) for a, b in zip(sorted(rest), sorted(r_rest))]
        return 2 if len(rest) == len(r_rest) and f == 0 and sum(bad) == 1 else 99
    given = " ".join(r_rest)
    if not rest:
        return 60 + f
    full = [w for w in rest if not w.endswith(".")]
    first = rest[0]
    if full:
        head = full[0]
        if head == given or " ".join(full) == given:
            return 0 + 10 * f
        nick = nicknames.get(head, ())
        if given in ((nick,) if isinstance(nick, str) else nick):
            return 1 + 10 * f
        if slip(head, given) == 1 and len(given) > 2:
            return 5 + 20 * f
        if given_alt(head) == given:
            return 6 + 20 * f
        return 8 + 20 * f if len(head) >= 3 and given.startswith(head) else 99
    return 30 + 10 * f if given[:1] == first[0] else 99


def given_alt(s: str) -> str:
    """Two-letter spellings of umlauts as one letter."""
    return s.replace("oe", "o").replace("ue", "u").replace("ae", "a")


def registry_points(registry: DataFrame) -> DataFrame:
    """Points of the registry: (author_id, kind, r_point, r_rest); an organisation has a second one, its acronym."""
    r = registry.select("author_id", "kind", "given", "family", "display_name")

    @F.pandas_udf(_READ)
    def points(kind: pd.Series, given: pd.Series, family: pd.Series, shown: pd.Series) -> pd.Series:
        out = []
        for k, g, f, d in zip(kind, given, family, shown):
            rows = []
            if k == "person" and f:
                fam, giv = [w for w, _ in _words(f)], [w for w, _ in _words(g or "")]
                rows.append({"kind": "person", "point": " ".join(fam), "rest": giv})
            elif d:
                rows += [{"kind": a, "point": b, "rest": c} for a, b, c in _org(d)]
                word = [w for w in re.findall(r"[^\W_]+", fold(d)) if w not in ("of", "for", "the", "and")]
                if len(word) >= 3:
                    rows.append({"kind": "acronym", "point": "".join(w[0] for w in word), "rest": []})
            out.append(rows)
        return pd.Series(out)

    e = r.select("author_id", F.explode(points("kind", "given", "family", "display_name")).alias("z"))
    return e.select("author_id", F.col("z.kind").alias("kind"), F.col("z.point").alias("r_point"), F.col("z.rest").alias("r_rest"))


def choose_pivots(points: DataFrame) -> list[str]:
    """Pivots: one for CELL_POINTS distinct points, within LEAST_PIVOTS and MOST_PIVOTS, in hash order.

    More pivots mean smaller cells and fewer copies; their number bounds what
    the driver and each task hold, and changes no result.
    """
    d = points.select("r_point").distinct()
    n = min(max(d.count() // CELL_POINTS, LEAST_PIVOTS), MOST_PIVOTS)
    return [r[0] for r in d.orderBy(F.xxhash64("r_point"), "r_point").limit(n).collect()] or [""]


def letters(words: list[str]) -> np.ndarray:
    """Letters of each word counted by class."""
    out = np.zeros((len(words), LETTERS), np.int32)
    for i, w in enumerate(words):
        for c in w:
            out[i, ord(c) % LETTERS] += 1
    return out


def bag_distances(words: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Bag distance of every word to every pivot, both as ``letters``: the letters one has more, or those the other has, whichever are more."""
    more = np.zeros((len(words), len(pivots)), np.int32)
    for k in range(LETTERS):
        more += np.maximum(words[:, k, None] - pivots[None, :, k], 0)
    less = more - (words.sum(1)[:, None] - pivots.sum(1)[None, :])
    return np.maximum(more, less)


class Cells:
    """Cells of points around pivots, each with the least and greatest distance of its points to every pivot."""

    def __init__(self, pivots: list[str], low: np.ndarray, high: np.ndarray) -> None:
        self.pivots = letters(pivots)
        self.low, self.high = low, high  # cell x pivot; low is above high where a cell is empty

    def of(self, words: list[str], radius: int) -> list[list[int]]:
        """The cells that may hold a point within the radius of each word."""
        out: list[list[int]] = []
        for start in range(0, len(words), 512):
            d = bag_distances(letters(words[start : start + 512]), self.pivots)
            # x lies nearest to its own pivot: d(q, p) <= d(x, p) + r <= d(x, p') + r <= d(q, p') + 2 r
            word, cell = np.nonzero(d - d.min(1)[:, None] <= 2 * radius)
            keep = np.ones(len(word), bool)
            for a in range(0, len(word), 4096):  # |d(q, p) - d(x, p)| <= r for every pivot
                w, c = word[a : a + 4096], cell[a : a + 4096]
                keep[a : a + 4096] = ((d[w] >= self.low[c] - radius) & (d[w] <= self.high[c] + radius)).all(1)
            part: list[list[int]] = [[] for _ in range(len(d))]
            for w, c in zip(word[keep].tolist(), cell[keep].tolist()):
                part[w].append(c)
            out += part
        return out


def make_cells(points: DataFrame) -> tuple[Cells, DataFrame]:
    """Cells of ``points(r_point, ...)`` and the points with their ``cell``.

    The driver holds the pivots and two numbers for each cell and pivot.
    """
    pivots = choose_pivots(points)

    @F.pandas_udf(T.IntegerType())
    def cell(p: pd.Series) -> pd.Series:
        return pd.Series(bag_distances(letters(p.tolist()), letters(pivots)).argmin(1).astype("int32"))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = letters(pivots)
        for b in batches:
            d = bag_distances(letters(b["r_point"].tolist()), own)
            at = d.argmin(1)
            rows = [(int(c), d[at == c].min(0).tolist(), d[at == c].max(0).tolist()) for c in np.unique(at)]
            yield pd.DataFrame(rows, columns=["cell", "low", "high"])

    def widest(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": b["cell"].iloc[:1], "low": [np.stack(b["low"]).min(0).tolist()], "high": [np.stack(b["high"]).max(0).tolist()]})

    schema = "cell int, low array<int>, high array<int>"
    got = points.select("r_point").distinct().mapInPandas(spans, schema).groupBy("cell").applyInPandas(widest, schema).collect()
    low, high = np.full((len(pivots), len(pivots)), 1 << 30), np.full((len(pivots), len(pivots)), -(1 << 30))
    for r in got:
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    return Cells(pivots, low, high), points.withColumn("cell", cell("r_point"))


def swapped(a: Column, b: Column) -> Column:
    """Whether two words of one length differ in two neighbouring letters that changed places."""
    turn = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: turn(i) == b)


def radius_join(queries: DataFrame, points: DataFrame) -> DataFrame:
    """All pairs of ``queries(point, ...)`` and ``points(r_point, ...)`` of one kind within RADIUS, exactly.

    Queries are salted, so a cell that draws many is spread; the points are
    the registry's.
    """
    cells, x = make_cells(points)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def to(p: pd.Series) -> pd.Series:
        return pd.Series(cells.of(p.tolist(), RADIUS))

    q = queries.withColumn("cell", F.explode(to("point"))).withColumn("salt", F.pmod(F.xxhash64("point"), F.lit(SALTS)).cast("int"))
    x = x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    j = q.join(x, ["cell", "kind", "salt"]).where(F.abs(F.length("point") - F.length("r_point")) <= RADIUS)
    edits = F.levenshtein("point", "r_point", 2 * RADIUS)
    return j.where(edits.between(0, RADIUS) | ((edits == 2) & swapped(F.col("point"), F.col("r_point")))).drop("cell", "salt")


def link(citations: DataFrame, registry: DataFrame, nicknames: Mapping[str, str | tuple[str, ...]] = NICKNAMES) -> DataFrame:
    """Distinct typed names with the registry entry each means: (name, author_id, tier).

    Names written exactly like a display_name mean that entry (tier -1).  Of
    the entries within the radius the best tier counts; if two entries share
    it the name means none of them.  Names of others come out with a NULL
    author_id, as do blank ones.  NULL elements are no names; empty tables
    give no rows; further columns are ignored.  ``nicknames`` maps short forms
    to given names, all in small letters without accents.
    """

    @F.pandas_udf(T.IntegerType())
    def _tier(kind: pd.Series, point: pd.Series, rest: pd.Series, r_point: pd.Series, r_rest: pd.Series) -> pd.Series:
        return pd.Series([tier(k, p, list(a), q, list(b), nicknames) for k, p, a, q, b in zip(kind, point, rest, r_point, r_rest)], dtype="int32")

    names = citations.select(F.explode("authors").alias("name")).where("name is not null").distinct()
    exact = registry.where("display_name is not null").groupBy(F.col("display_name").alias("name")).agg(F.min("author_id").alias("same"))
    named = names.join(exact, "name", "left")
    # distinct names are few bytes and much work: keep them spread, whatever their size suggests
    spread = max(citations.sparkSession.sparkContext.defaultParallelism * 4, int(citations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    typed = named.where("same is null").select("name").repartition(spread, "name")
    q = typed.select("name", F.explode(_readings("name")).alias("z")).select("name", "z.kind", "z.point", "z.rest")
    near = radius_join(q, registry_points(registry))
    fit = near.withColumn("tier", _tier("kind", "point", "rest", "r_point", "r_rest")).where("tier < 99").groupBy("name", "author_id").agg(F.min("tier").alias("tier"))
    best = fit.withColumn("b", F.min("tier").over(W.partitionBy("name"))).where("tier = b").groupBy("name").agg(F.min("author_id").alias("author_id"), F.count("*").alias("n"), F.min("tier").alias("tier")).where("n = 1")
    return (
        typed.join(best.select("name", "author_id", "tier"), "name", "left")
        .unionByName(named.where("same is not null").select("name", F.col("same").alias("author_id"), F.lit(-1).alias("tier")))
    )


def found(citations: DataFrame, registry: DataFrame, nicknames: Mapping[str, str | tuple[str, ...]] = NICKNAMES) -> DataFrame:
    """(citation_id, author_pos, author_id): elements that mean an entry but are not written like its display_name.

    A name typed a third of the time is one row of ``link``; the expansion to
    its places is salted.
    """
    linked = link(citations, registry, nicknames).where("tier >= 0 and author_id is not null").select("name", "author_id")
    places = citations.select("citation_id", F.posexplode("authors").alias("author_pos", "name")).withColumn("salt", F.pmod(F.xxhash64("citation_id"), F.lit(SALTS)).cast("int"))
    spread = linked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return places.join(spread, ["name", "salt"]).select("citation_id", "author_pos", "author_id").distinct()
