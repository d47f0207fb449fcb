"""Small operators: one-hot vectors, filters, samples, line statistics, shares, scores, input kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot(state: Column, classes: int) -> Column:
    """Vector of ``classes`` zeros with a one at ``state``; a state outside raises.  NULL gives NULL."""
    ok = (state >= 0) & (state < classes)
    vec = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == state).cast("double"))
    return F.when(state.isNull(), None).when(ok, vec).otherwise(F.raise_error(F.format_string("state %s is not in 0..%d", state.cast("string"), F.lit(classes - 1))))


def literature_filter(papers: DataFrame, first: int = 2024, last: int = 2026, tiers: tuple[str, ...] = ("I",)) -> DataFrame:
    """Papers of the years and tiers asked for that have open code."""
    return papers.where(F.col("year").between(first, last) & F.col("tier").isin(*tiers) & F.coalesce("has_code", F.lit(False)))


def replay_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement by md5 order of the key: a sample that is the same on every run."""
    return rows.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))).orderBy("_h", key).limit(n).drop("_h")


def line_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: lines, longest line in characters, distinct blank-separated words."""
    d = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(text, "\n")).alias("l"))
    words = d.select(F.explode(F.filter(F.split("l", " +"), lambda x: x != "")).alias("w")).agg(F.countDistinct("w").alias("vocabulary"))
    lines = d.agg(F.count("*").alias("n_lines"), F.max(F.length("l")).alias("longest"))
    return lines.withColumn("vocabulary", words.scalar())


def histogram_share(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, share): counts and their share of all rows, NULL a class like others."""
    g = rows.groupBy(by).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / g.agg(F.sum("n")).scalar(), 6))


def weighted_score(accuracy: Column, precision: Column, coverage: Column, hallucination: Column, recovery: Column) -> Column:
    """Weighted score 0.25 a + 0.25 p + 0.30 c - 0.10 h + 0.10 r."""
    return 0.25 * accuracy + 0.25 * precision + 0.30 * coverage - 0.10 * hallucination + 0.10 * recovery


def input_kind(path: Column, raw: Column) -> Column:
    """bibtex, json or text, by suffix or else by the first visible character."""
    lead = F.regexp_extract(raw, r"^\s*(\S)", 1)
    return F.when(F.lower(path).rlike(r"\.(bib|bibtex)$") | (lead == "@"), "bibtex").when(lead == "{", "json").otherwise("text")


def synthetic_raw(kind: Column, key: Column) -> Column:
    """'@type{key}' for records that have no raw text."""
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit("}"))


def surname_key(authors: Column) -> Column:
    """Small-letter parts before the comma of each name, in order, for comparing two spellings of one record."""
    return F.array_sort(F.transform(authors, lambda a: F.lower(F.trim(F.get(F.split(a, ","), F.lit(0))))))
