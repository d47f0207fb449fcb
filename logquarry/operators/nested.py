"""Problem 3: nested records into related flat tables, by Merkle subtree identity.

``shred`` hashes every object and array of a JSON document bottom-up over its
canonical form (keys in order, one spelling per number), so equal subtrees have
equal 128-bit identities whatever their whitespace or key order.  An object is
stored once, as the bridge rows (parent, key, ordinal, child) below it, and a
work once more as the list of its nodes; each document only adds one row with
the identity of its root and one for each work it holds, with its ordinal.
``works_flat`` joins these occurrences to the distinct works.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.session import durable

#: What ``shred`` can give: answers with their roots, members of objects and arrays, works of answers, nodes of works.
PARTS = ("answers", "members", "works", "nodes")
_NODE = pa.struct([("node", pa.string()), ("pos", pa.int32()), ("subpos", pa.int32()), ("value", pa.string()), ("object_id", pa.binary())])
_ARROW = pa.schema(
    [
        ("part", pa.string()), ("response_id", pa.int64()), ("id", pa.binary()), ("key", pa.string()), ("ordinal", pa.int32()), ("child", pa.binary()),
        ("kind", pa.string()), ("filled", pa.bool_()), ("value", pa.string()), ("nodes", pa.list_(_NODE)),
    ]
)
SHRED_SCHEMA = "part string, response_id bigint, id binary, key string, ordinal int, child binary, kind string, filled boolean, value string, nodes array<struct<node: string, pos: int, subpos: int, value: string, object_id: binary>>"
#: Rows of one batch, counting nodes.
_BATCH = 20_000


def _full(v) -> bool:
    """Whether a value is more than null, '' or an empty container."""
    return v is not None and v != "" and v != [] and v != {}


def _elements(v) -> list[tuple[int, object]]:
    """Values with their positions; what is no array counts as one of one."""
    return list(enumerate(v if isinstance(v, list) else [v]))


def _kind(v) -> str:
    return "null" if v is None else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "bool" if isinstance(v, bool) else "number"


def _text(v) -> str | None:
    """Scalars as text; of null and containers None."""
    if isinstance(v, str):
        return v.encode("utf-8", "replace").decode()
    return None if v is None or isinstance(v, (dict, list)) else "true" if v is True else "false" if v is False else repr(v)


class _Shredder:
    """Collects the rows of one Arrow batch, each distinct object, array and work once."""

    def __init__(self, parts: frozenset[str]) -> None:
        self.rows: list[tuple] = []
        self.size = 0
        self.seen: set[bytes] = set()
        self.works: set[bytes] = set()
        self.parts = parts
        self.members = "members" in parts
        self.ids: dict[int, bytes] = {}  # identities of the containers of the document at hand

    def _encode(self, v) -> bytes:
        """What a value adds to its parent's identity: its text, or the identity of a container."""
        t = type(v)
        if t is str:
            raw = v.encode("utf-8", "surrogatepass")
            return b"s%d:%b" % (len(raw), raw)
        if t is dict:
            parts = [b"o"]
            for k in sorted(v):
                raw = k.encode("utf-8", "surrogatepass")
                parts.append(b"%d:%b" % (len(raw), raw))
                parts.append(self._encode(v[k]))
        elif t is list:
            parts = [b"a", *map(self._encode, v)]
        else:
            return b"n" if v is None else b"T" if v is True else b"F" if v is False else b"d%b;" % repr(v).encode()
        me = hashlib.blake2b(b"".join(parts), digest_size=16).digest()
        self.ids[id(v)] = me
        if self.members and me not in self.seen:
            self.seen.add(me)
            pairs = [(None, x) for x in v] if t is list else [(k.encode("utf-8", "replace").decode(), v[k]) for k in sorted(v)]
            for i, (k, x) in enumerate(pairs):
                self._row("members", None, me, k, i, self.ids.get(id(x)) if isinstance(x, (dict, list)) else None, _kind(x), _full(x), _text(x))
        return b"#" + me

    def _row(self, *row) -> None:
        self.rows.append(row if len(row) == len(_ARROW) else (*row, *[None] * (len(_ARROW) - len(row))))
        self.size += 1

    def add(self, response_id: int, message: dict) -> None:
        """Rows of one answer."""
        self.ids.clear()
        self._encode(message)
        root = self.ids[id(message)]
        if "answers" in self.parts:
            self._row("answers", response_id, root)
        if "works" not in self.parts and "nodes" not in self.parts:
            return
        for pos, work in _elements(message["items"]) if "items" in message else [(0, message)]:
            if work is None:
                continue
            me = self.ids.get(id(work)) if isinstance(work, (dict, list)) else None
            if "works" in self.parts:
                self._row("works", response_id, root, "items" if "items" in message else None, pos, me, _kind(work), _full(work), _text(work))
            if "nodes" in self.parts and isinstance(work, dict) and me not in self.works:
                self.works.add(me)
                nodes = self._nodes(work)
                self.size += len(nodes)
                self._row("nodes", None, me, None, None, None, None, None, None, nodes)

    def _nodes(self, work: dict) -> list[tuple]:
        """(node, pos, subpos, value, object_id) of a work."""
        made: list[tuple] = []

        def node(name: str, pos: int, subpos: int, v) -> None:
            made.append((name, pos, subpos, _text(v), self.ids.get(id(v)) if isinstance(v, (dict, list)) else None))

        if _full(doi := work.get("DOI")):
            node("doi", -1, -1, doi)
        for name in ("title", "author"):
            if not _full(work.get(name)):
                continue
            for pos, v in _elements(work[name]):
                if not _full(v):
                    continue
                node(name, pos, -1, v)
                if name == "author" and isinstance(v, dict) and _full(v.get("affiliation")):
                    for sub, x in _elements(v["affiliation"]):
                        if _full(x):
                            node("affiliation", pos, sub, x)
        indexed = work.get("indexed")
        if isinstance(indexed, dict) and _full(indexed.get("date-parts")):
            for pos, v in _elements(indexed["date-parts"]):
                if _full(v):
                    for sub, x in _elements(v):
                        if _full(x):
                            node("date_part", pos, sub, x)
        return made

    def batch(self) -> pa.RecordBatch:
        cols = zip(*self.rows)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def _no_constant(x: str):
    raise ValueError(x)


def read_answer(status_code, body) -> dict | None:
    """The message of a readable answer, or None for error answers and broken bodies.

    Readable: a 2xx (or unknown) code, a body that is one JSON object whose
    status is not 'failed' or 'error', and a message that is an object or the
    text of one.
    """
    if body is None or (status_code is not None and not 200 <= status_code < 300):
        return None
    try:
        top = json.loads(body, parse_constant=_no_constant)
        msg = top.get("message") if isinstance(top, dict) else None
        if isinstance(msg, str):
            msg = json.loads(msg, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    if not isinstance(msg, dict) or str(top.get("status", "ok")).lower() in ("failed", "error"):
        return None
    return msg


def _shred_batches(batches: Iterator[pa.RecordBatch], parts: frozenset[str]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # as deep as the JSON reader goes
    s = _Shredder(parts)
    for b in batches:
        ids, codes, bodies = (b.column(i).to_pylist() for i in range(3))
        for rid, code, body in zip(ids, codes, bodies):
            msg = read_answer(code, body)
            if msg is None:
                continue
            s.add(rid, msg)
            if s.size >= _BATCH:
                yield s.batch()
                s = _Shredder(parts)
    if s.rows:
        yield s.batch()


def shred(api: DataFrame, parts: tuple[str, ...] = PARTS) -> dict[str, DataFrame]:
    """Related tables of the messages in ``api_responses``, by name:

    answers: (response_id, root), one row per readable answer.
    members: (parent, key, ordinal, child, kind, filled, value), the bridge:
    one row per member of each distinct object or array, of every name; key is
    NULL inside arrays, value holds scalars, child the identity of an object
    or array, filled is false for null, '' and empty containers.
    works: (response_id, root, key, item_pos, work, kind, value), one row per
    work of an answer; a work that is no object has its value instead of an
    identity, and a single work is its own root, with a NULL key.
    nodes: (work, nodes), the nodes of each distinct work.

    Only ``parts`` are made; identities cover whole subtrees all the same.
    NULL bodies, error answers and broken text give no rows; a repeated answer
    adds an occurrence, not a second copy of its objects; further columns of
    the input are ignored; an empty input gives empty tables.
    """
    want = frozenset(parts)
    raw = durable(api.select(F.col("response_id").cast("bigint"), F.col("status_code").cast("int"), "body").mapInArrow(lambda b: _shred_batches(b, want), SHRED_SCHEMA))
    of = lambda part: raw.where(F.col("part") == part)
    every = {
        "answers": lambda: of("answers").select("response_id", F.col("id").alias("root")),
        "members": lambda: durable(of("members").select(F.col("id").alias("parent"), "key", "ordinal", "child", "kind", "filled", "value").dropDuplicates(["parent", "ordinal"])),
        "works": lambda: of("works").select("response_id", F.col("id").alias("root"), "key", F.col("ordinal").alias("item_pos"), F.col("child").alias("work"), "kind", "value"),
        "nodes": lambda: of("nodes").select(F.col("id").alias("work"), "nodes").dropDuplicates(["work"]),
    }
    return {p: every[p]() for p in PARTS if p in want}


def _first_title(msg: dict) -> str | None:
    """First title of the first work, the one with which a search answer is scored; None where that work has none."""
    works = msg["items"] if "items" in msg else [msg]
    work = next((w for w in (works if isinstance(works, list) else [works]) if w is not None), None)
    title = work.get("title") if isinstance(work, dict) else None
    found = next((t for t in (title if isinstance(title, list) else [title]) if isinstance(t, str) and t), None)
    return found and found.encode("utf-8", "replace").decode()


def first_titles(api: DataFrame, keep: list[str]) -> DataFrame:
    """(response_id, *keep, title) of every readable answer whose first work has a title; ``keep`` names columns to pass on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            msgs = (read_answer(*x) for x in zip(b.column("status_code").to_pylist(), b.column("body").to_pylist()))
            titles = pa.array([None if m is None else _first_title(m) for m in msgs], pa.string())
            out = b.select(["response_id", *keep])
            yield pa.RecordBatch.from_arrays([*out.columns, titles], names=[*out.schema.names, "title"])

    d = api.select("response_id", *keep, F.col("status_code").cast("int"), "body")
    schema = d.select("response_id", *keep, F.col("body").alias("title")).schema
    return d.mapInArrow(run, schema).where("title is not null")


def nodes(members: DataFrame) -> DataFrame:
    """One row per distinct object or array: identity, number of members, number of places it is used."""
    own = members.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_members"))
    used = members.where("child is not null").groupBy(F.col("child").alias("node")).agg(F.count("*").alias("n_used"))
    return own.join(used, "node", "left").select("node", "n_members", F.coalesce("n_used", F.lit(0)).cast("bigint").alias("n_used"))


def leaves(answers: DataFrame, members: DataFrame) -> DataFrame:
    """(response_id, path, kind, value): every scalar and null of every answer, walked from the roots over the bridge.

    A path is '$', then '.key' or '[ordinal]' for each step.  The walk goes
    level by level over distinct roots, one join a level; the answers are
    joined last.
    """
    at = answers.select("root").distinct().select("root", F.col("root").alias("parent"), F.lit("$").alias("path"))
    step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
    found = None
    while True:
        level = durable(at.join(members, "parent").select("root", F.concat("path", step).alias("path"), "child", "kind", "value"))
        here = level.where("child is null").select("root", "path", "kind", "value")
        found = here if found is None else found.unionByName(here)
        at = level.where("child is not null").select("root", F.col("child").alias("parent"), "path")
        if at.isEmpty():
            return answers.join(found, "root").select("response_id", "path", "kind", "value")


def works_flat(api: DataFrame) -> DataFrame:
    """Nodes of every work: (response_id, item_pos, node, pos, subpos, value, object_id).

    node is item, doi, title, author, affiliation or date_part; value is the
    scalar text where the node is one, object_id the identity of the subtree
    where it is an object or array, the parent of its rows in the bridge; rows
    of a work are linked to it by (response_id, item_pos).  Null, missing and
    empty values give no row; nulls inside an array keep the positions of the
    rest.  A work that many answers hold is one row on its side of the join.
    """
    t = shred(api, ("works", "nodes"))
    none = F.lit(-1)
    items = t["works"].select("response_id", "item_pos", F.lit("item").alias("node"), none.alias("pos"), none.alias("subpos"), "value", F.col("work").alias("object_id"))
    inner = t["works"].where("kind = 'object'").select("response_id", "item_pos", "work").join(t["nodes"], "work")
    inner = inner.select("response_id", "item_pos", F.explode("nodes").alias("n")).select("response_id", "item_pos", "n.*")
    return items.unionByName(inner)


def found(api: DataFrame) -> DataFrame:
    """Rows of ``works_flat`` as (response_id, item_pos, node, pos, subpos)."""
    return works_flat(api).select("response_id", "item_pos", "node", "pos", "subpos")
