"""Value of an event: policy evaluation on transitions, and the session flags built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.session import durable

GAMMA = 0.99


def values(trans: DataFrame, sweeps: int = 5, start: DataFrame | None = None, cut_every: int = 10) -> DataFrame:
    """(state, q) after ``sweeps`` of Q(s) = avg(r + 0.99 (1 - done) Q(s')).

    Transitions are aggregated once to (state, next, done, n, sum of r); the
    sweeps read that table only.  Unknown next states count 0.  ``start``
    (state, q) continues from earlier values.  Lineage is cut every few sweeps.
    """
    agg = durable(trans.groupBy("state", "next_state", "done").agg(F.count("*").alias("n"), F.sum("reward").alias("r")))
    q = start
    for i in range(sweeps):
        if q is None:
            nxt = F.lit(0.0)
            d = agg
        else:
            d = agg.join(q.select(F.col("state").alias("next_state"), "q"), "next_state", "left")
            nxt = F.coalesce("q", F.lit(0.0))
        target = F.col("r") + F.when(F.col("done"), 0.0).otherwise(F.col("n") * GAMMA * nxt)
        q = d.groupBy("state").agg((F.sum(target) / F.sum("n")).alias("q"))
        if i % cut_every == cut_every - 1:
            q = durable(q)
    return q


def flag_sessions(items: DataFrame, by: str, order: list[str], state: str, q: DataFrame, finals: DataFrame, threshold: float) -> DataFrame:
    """(by, low_event, bad_end, flagged): any event but the last below the threshold, or an end never seen before.

    Events without a value are not below any threshold.  One aggregation a
    session: the last event is ``max_by`` the order, its value is taken off
    the count again.
    """
    low = (F.col("q") < threshold).cast("int")
    d = items.join(q.select(F.col("state").alias(state), "q"), state, "left")
    key = F.struct(*order)
    g = d.groupBy(by).agg(F.sum(F.coalesce(low, F.lit(0))).alias("lows"), F.max_by(F.coalesce(low, F.lit(0)), key).alias("last_low"), F.max_by(state, key).alias("last"))
    f = finals.select(F.col("final_state").alias("last"), F.lit(True).alias("known"))
    g = g.join(f, "last", "left")
    return g.select(by, (F.col("lows") - F.col("last_low") > 0).alias("low_event"), F.col("known").isNull().alias("bad_end"), ((F.col("lows") - F.col("last_low") > 0) | F.col("known").isNull()).alias("flagged"))


def save_values(q: DataFrame, path: str) -> None:
    """Writes a table of values (state, q)."""
    q.select("state", "q").write.mode("overwrite").parquet(path)


def load_values(spark: SparkSession, path: str) -> DataFrame:
    """Values written before, to go on from."""
    return spark.read.parquet(path).select("state", "q")
