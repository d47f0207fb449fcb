"""Time: bins, ordered and windowed pairs, conflicts, the last rows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bins(events: DataFrame, ts: str, item: str, width: str = "minute", fill: bool = False) -> DataFrame:
    """(bin, n, items) per tumbling bin; with ``fill`` the empty bins between the first and the last too."""
    b = events.groupBy(F.date_trunc(width, ts).alias("bin")).agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set(item))).alias("items"))
    if not fill:
        return b
    every = b.agg(F.min("bin").alias("a"), F.max("bin").alias("z")).where("a is not null").select(F.explode(F.sequence("a", "z", F.expr(f"interval 1 {width}"))).alias("bin"))
    return every.join(b, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("items", F.lit("")).alias("items"))


def ordered_pair_counts(events: DataFrame, entity: str, ts: str, kind: str) -> DataFrame:
    """(cause, effect, n): how often a kind comes strictly before another for one entity.

    Counted, not enumerated: a running count of each kind meets every event,
    so an entity with many events costs its length, not its square.
    """
    per = events.where(F.col(kind).isNotNull()).groupBy(entity, ts, kind).agg(F.count("*").alias("c"))
    m = per.groupBy(entity, ts).agg(F.map_from_entries(F.collect_list(F.struct(kind, "c"))).alias("m"))
    j = m.join(per.select(entity, F.col(kind).alias("cause")).distinct(), entity).withColumn("here", F.coalesce(F.element_at("m", F.col("cause")), F.lit(0)))
    before = F.coalesce(F.sum("here").over(W.partitionBy(entity, "cause").orderBy(ts).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = j.withColumn("before", before).where("before > 0").select("cause", "before", F.explode("m").alias("effect", "c"))
    return d.groupBy("cause", "effect").agg(F.sum(F.col("before") * F.col("c")).alias("n"))


def within(events: DataFrame, entity: str, ts: str, key: str, kind: str, cause: str, effect: str, seconds: int) -> DataFrame:
    """(entity, cause_id, effect_id, gap_s): causes at most ``seconds`` before an effect of the same entity.

    A range join by time buckets: a cause is copied to its own bucket and the
    next one, so every pair meets in exactly one bucket and none is compared
    with events far away.
    """
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    d = events.select(F.col(entity).alias("entity"), F.col(key).alias("id"), F.col(kind).alias("kind"), sec.alias("s"))
    b = F.floor(F.col("s") / seconds)
    c = d.where(F.col("kind") == cause).select("entity", F.col("id").alias("cause_id"), F.col("s").alias("cs"), F.explode(F.array(b, b + 1)).alias("b"))
    e = d.where(F.col("kind") == effect).select("entity", F.col("id").alias("effect_id"), F.col("s").alias("es"), b.alias("b"))
    j = c.join(e, ["entity", "b"]).where((F.col("cs") < F.col("es")) & (F.col("es") - F.col("cs") <= seconds))
    return j.select("entity", "cause_id", "effect_id", F.round(F.col("es") - F.col("cs"), 3).alias("gap_s"))


def conflicts(events: DataFrame, entity: str, ts: str, kind: str, width: str = "minute") -> DataFrame:
    """(entity, at, kinds): instants at which an entity has more than one kind of event."""
    g = events.groupBy(F.col(entity).alias("entity"), F.date_trunc(width, ts).alias("at")).agg(F.array_sort(F.collect_set(kind)).alias("k"))
    return g.where(F.size("k") > 1).select("entity", "at", F.concat_ws(",", "k").alias("kinds"))


def last_n(events: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows, as a ring buffer of that capacity would hold them (a top-k, not a sort of all)."""
    return events.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def sliding_counts(events: DataFrame, ts: str, kind: str, width: str, slide: str) -> DataFrame:
    """(start, kind, n): counts in windows of ``width``, a new one every ``slide``."""
    w = events.groupBy(F.window(F.col(ts).cast("timestamp"), width, slide).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "kind", "n")
