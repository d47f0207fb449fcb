"""Problem 6: records that differ in formatting only, collapsed with their counts.

Title and DOI are brought to a canonical form - characters composed and of one
width, case folded, blanks, punctuation and field order gone - hashed to 128
bits, and counted with map-side combining.  Each group also carries the least and the
greatest canonical form, so two forms under one hash would be seen and split.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.session import durable
from logquarry.sources.bibtex import parse_bibtex


@F.pandas_udf(T.StructType().add("title", T.StringType()).add("doi", T.StringType()))
def _raw_fields(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Title and DOI of a raw BibTeX or JSON record, whatever the order and case of its fields."""
    for s in batches:
        rows = []
        for raw in s:
            t = (raw or "").lstrip("\ufeff \t\r\n")
            got: dict = {}
            if t.startswith("{"):
                try:
                    o = json.loads(t)
                    got = {str(k).lower(): v for k, v in o.items()} if isinstance(o, dict) else {}
                except (ValueError, RecursionError):
                    got = {}
            elif t.startswith("@"):
                recs = parse_bibtex(t)
                got = recs[0] if recs else {}
            title, doi = got.get("title"), got.get("doi")
            if isinstance(title, list):
                title = next((x for x in title if isinstance(x, str)), None)
            rows.append((title if isinstance(title, str) else None, doi if isinstance(doi, str) else None))
        yield pd.DataFrame(rows, columns=["title", "doi"])


#: Full-width forms and the characters they are forms of: the same row of the code table, further up.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


@F.arrow_udf(T.StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([x and unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())


def folded(col: Column) -> Column:
    """Characters in one spelling, composed (NFC) and of ordinary width, and case folded.  Only texts outside ASCII go to Arrow."""
    other = col.rlike(r"[^\x00-\x7F]")
    one = _composed(F.when(other, F.translate(col, _WIDE, _NARROW)))
    full = F.translate(F.lower(F.upper(F.regexp_replace(one, "[ßẞ]", "ss"))), "ς", "σ")  # a final sigma depends on what follows it
    return F.when(other, full).otherwise(F.lower(col))


def bare(col: Column) -> Column:
    """Canonical text: one spelling of characters, case folded, blanks, invisible characters, punctuation and symbols left out; '' becomes NULL."""
    return F.nullif(F.regexp_replace(folded(col), r"[\p{P}\p{S}\p{Z}\p{C}\s]+", ""), F.lit(""))


def canonical(citations: DataFrame) -> DataFrame:
    """(citation_id, title_key, doi_key, form, h): canonical forms and their 128-bit hash; no row without a title."""
    c = citations.select("citation_id", "raw", "title", "doi")
    lead = F.regexp_extract("raw", r"^[\s\ufeff]*(.)", 1)
    unparsed = F.col("title").isNull() & F.col("doi").isNull() & F.coalesce(lead.isin("{", "@"), F.lit(False))
    plain = c.where(~unparsed).select("citation_id", "title", "doi")
    taken = c.where(unparsed).withColumn("f", _raw_fields("raw")).select("citation_id", "f.title", "f.doi")
    keyed = plain.unionByName(taken).select("citation_id", bare(F.col("title")).alias("title_key"), F.nullif(F.regexp_replace(bare(F.col("doi")), r"^(https?(dx)?doiorg|doi)(?=10)", ""), F.lit("")).alias("doi_key"))
    form = F.concat_ws("\u0001", "title_key", F.coalesce("doi_key", F.lit("")))
    return keyed.where("title_key is not null").withColumn("form", form).withColumn("h", F.unhex(F.md5("form")))


def groups(canon: DataFrame) -> DataFrame:
    """One row for each distinct record: (h, form, first_id, n_copies).

    Counting is by the 16-byte hash with partial sums before the shuffle; a
    hash whose least and greatest forms differ is a collision and is counted
    again by the form itself.
    """
    by = canon.groupBy("h").agg(F.min("citation_id").alias("first_id"), F.count("*").alias("n_copies"), F.min("form").alias("form"), F.max("form").alias("form_max"))
    clean = by.where("form = form_max").drop("form_max")
    clash = by.where("form <> form_max").select("h")
    again = canon.join(clash, "h", "left_semi").groupBy("h", "form").agg(F.min("citation_id").alias("first_id"), F.count("*").alias("n_copies"))
    return clean.select("h", "form", "first_id", "n_copies").unionByName(again.select("h", "form", "first_id", "n_copies"))


def collapse(citations: DataFrame) -> DataFrame:
    """Each record once: (citation_id, title_key, doi_key, n_copies), citation_id being the smallest of its group.

    Records without a title, in the column or in a BibTeX or JSON raw, are
    copies of nothing and come out on their own with n_copies 1 and NULL keys.
    NULL columns, empty texts and an empty table are legal; a repeated row is
    a copy; further columns are ignored.
    """
    canon = durable(canonical(citations).select("citation_id", "h", "form"))
    one = groups(canon).select(F.col("first_id").alias("citation_id"), F.get(F.split("form", "\u0001"), F.lit(0)).alias("title_key"), F.nullif(F.get(F.split("form", "\u0001"), F.lit(1)), F.lit("")).alias("doi_key"), "n_copies")
    rest = citations.select("citation_id").join(canon.select("citation_id"), "citation_id", "left_anti")
    none = F.lit(None).cast("string")
    return one.unionByName(rest.select("citation_id", none.alias("title_key"), none.alias("doi_key"), F.lit(1).cast("bigint").alias("n_copies")))


def found(citations: DataFrame) -> DataFrame:
    """(citation_id_a, citation_id_b): every further copy with the smallest id of its group.

    Groups of more than one copy are joined back on hash and salt: the group
    side is one row a salt, so a group with a third of all rows is spread.
    """
    salts = 8
    canon = durable(canonical(citations).select("citation_id", "h", "form"))  # read three times
    many = groups(canon).where("n_copies > 1").select("h", "form", "first_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = canon.withColumn("salt", F.pmod(F.xxhash64("citation_id"), F.lit(salts)).cast("int"))
    return rows.join(many, ["h", "salt", "form"]).where("citation_id <> first_id").select(F.col("first_id").alias("citation_id_a"), F.col("citation_id").alias("citation_id_b")).distinct()
