"""Writers: structured logs, splits, session text, JSON, edge lists, the audit log, manifests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators.sessions import session_text
from logquarry.sources.logs import CSV


def write_structured(structured: DataFrame, templates: DataFrame, path: str) -> None:
    """Structured log and template dictionary as CSV with headers; arrays become JSON."""
    flat = lambda d: d.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in d.dtypes])
    flat(structured).write.mode("overwrite").csv(f"{path}/structured", **CSV)
    flat(templates).write.mode("overwrite").csv(f"{path}/templates", **CSV)


def write_splits(sessions: DataFrame, path: str) -> None:
    """Sessions with a column ``split``, one folder a split."""
    sessions.write.mode("overwrite").partitionBy("split").parquet(path)


def write_session_text(sessions: DataFrame, ids: str, path: str) -> None:
    """Sessions as lines of ids, with the trailing blank of that format."""
    session_text(sessions, ids, trailing=True).write.mode("overwrite").text(path)


def write_json(d: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; null fields are left out.  A link in place of a local path is refused."""
    if os.path.islink(path.removeprefix("file:")):
        raise ValueError(f"{path} is a link")
    d.write.mode("append" if append else "overwrite").option("ignoreNullFields", "true").json(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Edge list 'src dst {"weight": w}'."""
    w = F.to_json(F.struct(F.col("weight")))
    edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), w).alias("value")).write.mode("overwrite").text(path)


def audit_rows(verdicts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(*keep, timestamp, citation_hash, status, lookup_mode) for the audit log."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return verdicts.select(*(keep or []), now.alias("timestamp"), F.concat(F.lit("sha256:"), F.sha2("raw", 256)).alias("citation_hash"), "status", "lookup_mode")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest_differs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either manifest that the other lacks; none means equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
