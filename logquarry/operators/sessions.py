"""Sessions: numbering rows, fixed-count sessions, ordered lists, transitions, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def number_rows(df: DataFrame, order: list[str], bucket: Column, out: str = "rn") -> DataFrame:
    """Adds ``out``: 1-based position in the order of ``order``, without gathering all rows in one task.

    ``bucket`` must not decrease along the order (an hour of the first order
    column, say).  Rows are numbered inside their bucket and moved up by the
    rows of the buckets before; only one row a bucket is ordered globally.
    """
    d = df.withColumn("_b", bucket)
    counts = d.groupBy("_b").agg(F.count("*").alias("_n"))
    run = W.partitionBy(F.lit(1)).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    ahead = counts.select(F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(W.partitionBy("_b").orderBy(*order))
    d = d.withColumn("_own", own).join(ahead, F.col("_b").eqNullSafe(F.col("_k")))
    return d.withColumn(out, (F.col("_own") + F.col("_ahead")).cast("bigint")).drop("_b", "_k", "_own", "_ahead")


def fixed_sessions(numbered: DataFrame, size: int = 20, rn: str = "rn") -> DataFrame:
    """Adds ``sid``: the 0-based number of the session's first row, a new one every ``size`` rows."""
    return numbered.withColumn("sid", (F.floor((F.col(rn) - 1) / size) * size).cast("bigint"))


def event_sessions(events: DataFrame, size: int = 20) -> DataFrame:
    """Events in order of (ts, event_id) with rn and sid."""
    return fixed_sessions(number_rows(events, ["ts", "event_id"], F.date_trunc("hour", F.col("ts"))), size)


def ordered_list(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """One array a group, in order; repeated order keys are ordered by the value."""
    z = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*by).agg(F.transform(z, lambda x: x[value]).alias(out))


def transitions(df: DataFrame, by: str, order: list[str], state: str, negative: bool = False) -> DataFrame:
    """Adjacent pairs: (by, rn, state, next_state, reward, done).

    The last pair of a session earns 50 and ends it, the others 1; negative
    sessions earn -1 and never end.  A session of one event has no pair.
    """
    w = W.partitionBy(by).orderBy(*order)
    d = df.select(by, F.row_number().over(w).alias("rn"), F.col(state).alias("state"), F.lead(state, 1).over(w).alias("next_state"), F.lead(F.lit(1), 2).over(w).isNull().alias("last"), F.lead(F.lit(1), 1).over(w).isNotNull().alias("has"))
    reward = F.lit(-1.0) if negative else F.when(F.col("last"), 50.0).otherwise(1.0)
    done = F.lit(False) if negative else F.col("last")
    return d.where("has").select(by, "rn", "state", "next_state", reward.alias("reward"), done.alias("done"))


def md5_split(keys: DataFrame, key: str, train: float = 0.8, seed: str = "42") -> DataFrame:
    """Splits by md5 order: the first floor(train n) keys 'train', the rest 'test', numbered without a global window."""
    d = keys.select(key).distinct().withColumn("h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))))
    d = number_rows(d, ["h", key], F.substring("h", 1, 4), "pos")
    n = d.count()
    return d.select(key, F.when(F.col("pos") <= int(n * train), "train").otherwise("test").alias("split"))


def head_share(df: DataFrame, order: list[str], bucket: Column, num: int = 7, den: int = 8) -> DataFrame:
    """Adds ``head``: whether a row is among the first num/den in the order."""
    n = df.count()
    return number_rows(df, order, bucket, "pos").withColumn("head", F.col("pos") <= n * num // den)


def final_states(sessions: DataFrame, ids: str = "event_ids") -> DataFrame:
    """Distinct last events of sessions; NULL and empty sessions have none."""
    return sessions.where(F.size(ids) > 0).select(F.element_at(ids, -1).alias("final_state")).distinct()


def session_text(sessions: DataFrame, ids: str, trailing: bool = False) -> DataFrame:
    """Sessions as lines of ids separated by blanks (column ``value``), as the text sink writes them."""
    line = F.concat_ws(" ", F.transform(ids, lambda x: x.cast("string")))
    return sessions.select((F.concat(line, F.lit(" ")) if trailing else line).alias("value"))
