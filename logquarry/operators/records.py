"""Recorded answers as flat records, and the lookup of citations in them: by identifier, then by title."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.functions import text as T
from logquarry.operators import match
from logquarry.operators.nested import _elements, read_answer

_FIELDS = [
    ("response_id", pa.int64()), ("item_pos", pa.int32()), ("doi", pa.string()), ("type", pa.string()), ("title", pa.string()), ("publisher", pa.string()),
    ("container", pa.string()), ("year", pa.int32()), ("n_authors", pa.int32()), ("first_author", pa.string()),
]
SCHEMA = "response_id bigint, item_pos int, doi string, type string, title string, publisher string, container string, year int, n_authors int, first_author string"


def _first(v):
    """A value, or the first of an array; of an empty one None."""
    return (v[0] if v else None) if isinstance(v, list) else v


def _string(v) -> str | None:
    return v.encode("utf-8", "replace").decode() if isinstance(v, str) else None


def _year(work: dict) -> int | None:
    """First number of the first date that a work has, of issued, created and published."""
    for name in ("issued", "created", "published"):
        date = work.get(name)
        y = _first(_first(date.get("date-parts"))) if isinstance(date, dict) else None
        if isinstance(y, int) and not isinstance(y, bool) and abs(y) < 1 << 31:
            return y
        if isinstance(y, str) and y.isascii() and y.isdigit() and len(y) < 10:
            return int(y)
    return None


def records(api: DataFrame) -> DataFrame:
    """One flat record for each work that is an object: its identifiers, first title, first container, year and authors.

    Fields of another shape are NULL; first_author is the family name of the
    first author, or the whole name where there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rid, code, body in zip(*(c.to_pylist() for c in b.columns)):
                msg = read_answer(code, body)
                if msg is None:
                    continue
                for pos, w in _elements(msg["items"]) if "items" in msg else [(0, msg)]:
                    if not isinstance(w, dict):
                        continue
                    authors = [a for _, a in _elements(w.get("author")) if a is not None]
                    a = authors[0] if authors else None
                    name = (_string(a.get("family")) or _string(a.get("name"))) if isinstance(a, dict) else None
                    rows.append((rid, pos, _string(w.get("DOI")), _string(w.get("type")), _string(_first(w.get("title"))), _string(w.get("publisher")), _string(_first(w.get("container-title"))), _year(w), len(authors), name))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])

    return api.select(F.col("response_id").cast("bigint"), F.col("status_code").cast("int"), "body").mapInArrow(run, SCHEMA)


def by_identifier(citations: DataFrame, recs: DataFrame) -> DataFrame:
    """(citation_id, route, doi, response_id, item_pos): the record of each citation's DOI or working-paper number.

    DOIs meet in small letters.  Of several records under a DOI the one with
    the lowest (response_id, item_pos) is taken before the join, so the record
    side has one row a key; citations without a record have NULLs.
    """
    doi = F.when(F.length("doi") > 0, F.lower("doi")).otherwise(F.lower(T.nber_doi(F.col("nber_number"))))
    route = F.when(F.length("doi") > 0, "doi").when(F.length("nber_number") > 0, "nber")
    c = citations.select("citation_id", route.alias("route"), doi.alias("doi"))
    one = recs.where(F.length("doi") > 0).groupBy(F.lower("doi").alias("doi")).agg(F.min(F.struct("response_id", "item_pos")).alias("at"))
    return c.join(one, "doi", "left").select("citation_id", "route", "doi", "at.response_id", "at.item_pos")


def exact_then_fuzzy(citations: DataFrame, recs: DataFrame, k: int = 5, threshold: float = 0.70) -> DataFrame:
    """(citation_id, how, rank, response_id, item_pos, f1): the record by identifier, or else the best by title.

    A citation whose identifier is found has one row, how = 'doi' or 'nber',
    rank 1 and f1 1; of the others, those with a title have up to ``k`` rows,
    how = 'search', best word F1 first.
    """
    exact = by_identifier(citations, recs).where("response_id is not null").select("citation_id", F.col("route").alias("how"), F.lit(1).alias("rank"), "response_id", "item_pos", F.lit(1.0).alias("f1"))
    rest = citations.join(exact.select("citation_id"), "citation_id", "left_anti").where("title is not null").select(F.col("citation_id").alias("id"), "title")
    works = recs.where("title is not null").select((F.col("response_id") * 100_000 + F.col("item_pos")).alias("other"), "title")
    best = match.best_by_tokens(rest, works, k, threshold)
    fuzzy = best.select(F.col("id").alias("citation_id"), F.lit("search").alias("how"), "rank", F.floor(F.col("other") / 100_000).alias("response_id"), (F.col("other") % 100_000).cast("int").alias("item_pos"), "f1")
    return exact.unionByName(fuzzy)


def siblings(citations: DataFrame, looked_up: DataFrame, recs: DataFrame) -> DataFrame:
    """(citation_id, response_id, item_pos, f1): the book that a citation may mean whose first record is a chapter.

    ``looked_up`` has (citation_id, response_id).  Of the later works of the
    same answer the first that is a book or monograph, has the first word of
    the citation's first author in its first author, and an F1 over 0.85.
    """
    chapter = recs.where("type = 'book-chapter' and item_pos = 0").select("response_id")
    c = citations.where("title is not null").select("citation_id", F.col("title").alias("own"), F.lower(F.get(F.split(F.regexp_replace(F.trim(F.get("authors", F.lit(0))), ",", " "), " "), F.lit(0))).alias("a")).where("a <> ''")
    books = recs.where("item_pos > 0 and type in ('book', 'monograph') and title is not null and first_author is not null")
    d = looked_up.join(chapter, "response_id", "left_semi").join(books, "response_id").join(c, "citation_id").where(F.contains(F.lower("first_author"), F.col("a")))
    d = match.title_match(d, "own", "title").where("f1 > 0.85")
    return d.groupBy("citation_id", "response_id").agg(F.min(F.struct("item_pos", "f1")).alias("z")).select("citation_id", "response_id", "z.item_pos", "z.f1")
