"""Streams: the same operators over unbounded inputs, with state and watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logquarry.operators.templates import Miner, masked
from logquarry.session import shared_dir


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder or glob as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n) per tumbling window; rows later than the watermark are dropped by the stream."""
    t = F.col(ts).cast("timestamp")
    d = stream.withColumn("_t", t).withWatermark("_t", late)
    return d.groupBy(F.window("_t", width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def gap_sessions(stream: DataFrame, ts: str, entity: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(entity, start, end, n) of sessions that a gap ends."""
    d = stream.withColumn("_t", F.col(ts).cast("timestamp"))
    d = d.withWatermark("_t", late) if stream.isStreaming else d
    return d.groupBy(F.session_window("_t", gap).alias("w"), F.col(entity).alias("entity")).agg(F.count("*").alias("n")).select("entity", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def count_sessions(stream: DataFrame, entity: str, order: str, size: int = 20) -> DataFrame:
    """(entity, session, rows): a row for every full session of ``size`` rows of an entity; the state of an entity is its rows seen."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        n = sum(len(b) for b in batches)
        full_before, full = seen // size, (seen + n) // size
        state.update((seen + n,))
        if full > full_before:
            yield pd.DataFrame({"entity": key[0], "session": range(full_before, full), "rows": size})

    d = stream.select(F.col(entity).cast("string").alias("entity"), F.col(order))
    return d.groupBy("entity").applyInPandasWithState(step, "entity string, session bigint, rows int", "seen bigint", "append", GroupStateTimeout.NoTimeout)


def mine_stream(stream: DataFrame, group: str, order: str, text: str, tau: float = 0.5) -> DataFrame:
    """(group, order, template) as lines arrive; the state of a group is its templates."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Miner(tau, [t.split(" ") for t in (state.get[0] if state.exists else [])])
        for b in batches:
            b = b.sort_values("o")
            at = [m.add(x.split()) for x in b["t"]]
            yield pd.DataFrame({"g": b["g"], "o": b["o"], "template": [" ".join(m.templates[n]) if n >= 0 else "<empty>" for n in at]})
        state.update(([" ".join(t) for t in m.templates],))

    d = stream.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(order).cast("bigint").alias("o"), masked(F.col(text)).alias("t"))
    return d.groupBy("g").applyInPandasWithState(step, "g string, o bigint, template string", "templates array<string>", "append", GroupStateTimeout.NoTimeout)


def keep_edges(edges: DataFrame, path: str) -> DataFrame:
    """(src, dst, n): a stream of (src, dst) as an edge table with weights, over what there is.

    Each batch writes its partial counts under its own number, so a batch that
    is delivered again replaces itself; readers add the batches up.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        batch.groupBy("src", "dst").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/edges/batch={number}")

    q = edges.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(upsert).start()
    q.awaitTermination()
    return edges.sparkSession.read.parquet(f"{path}/edges").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def run_to_end(out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its output as a table in the shared folder.

    Complete output goes through ``foreachBatch``; either way the sink is
    files, so a restart goes on from its checkpoint.
    """
    spark = out.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/logquarry-stream-{uuid.uuid4().hex}"
    w = out.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", f"{base}/out").outputMode("append").start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
