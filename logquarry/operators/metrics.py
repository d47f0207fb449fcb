"""Metrics of predictions: precision, recall, F1, confusion, MAP, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def prf_percent(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 in percent; 0 where undefined."""
    c = df.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"))
    c = c.withColumn("precision", _safe(100.0 * F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _safe(100.0 * F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", F.round(_safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6)).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


def macro_prf(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: mean precision, recall and F1 over the union of true and predicted labels, 0 where undefined."""
    per = df.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(guess).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("z"), (F.col(truth) == F.col(guess)).alias("hit"))
    g = per.groupBy("z.c").agg(F.sum("z.t").alias("t"), F.sum("z.p").alias("p"), F.sum((F.col("hit") & (F.col("z.t") == 1)).cast("int")).alias("h"))
    g = g.select(_safe(F.col("h"), F.col("p")).alias("pr"), _safe(F.col("h"), F.col("t")).alias("rc"))
    g = g.withColumn("f", _safe(2 * F.col("pr") * F.col("rc"), F.col("pr") + F.col("rc")))
    return g.agg(F.round(F.avg("pr"), 6).alias("precision"), F.round(F.avg("rc"), 6).alias("recall"), F.round(F.avg("f"), 6).alias("f1"))


def accuracy(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: share of equal labels."""
    return df.agg(F.round(F.avg((F.col(truth) == F.col(guess)).cast("double")), 6).alias("accuracy"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n), the long form of the confusion matrix."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def average_precision(df: DataFrame, k: int) -> DataFrame:
    """(q, ap): precision at each hit among the first k, divided by the hits found; columns q, rank, hit."""
    run = F.sum("hit").over(W.partitionBy("q").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    d = df.where(F.col("rank") <= k).withColumn("found", run)
    return d.groupBy("q").agg(F.round(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("found") / F.col("rank"))) / F.nullif(F.sum("hit"), F.lit(0)), F.lit(0.0)), 6).alias("ap"))


def losses(df: DataFrame, error: Column, delta: float = 1.0) -> DataFrame:
    """One row: mean squared, Huber and log-cosh loss of an error column."""
    e = F.abs(error)
    logcosh = e + F.log1p(F.exp(-2 * e)) - F.log(F.lit(2.0))  # does not overflow
    return df.agg(F.round(F.avg(error * error), 6).alias("mse"), F.round(F.avg(F.when(e < delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))), 6).alias("huber"), F.round(F.avg(logcosh), 6).alias("logcosh"))


def focal_loss(df: DataFrame, logits: str, label: str, gamma: float = 2.0, alpha: float | list[float] | None = None) -> DataFrame:
    """(.., focal): -w (1 - p)^gamma log p of the labelled class; alpha weighs class 0 and 1 - alpha the others, or is a weight for each class."""
    top = F.array_max(logits)
    norm = F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)) + top
    logp = F.get(logits, F.col(label)) - norm
    if isinstance(alpha, list):
        w = F.get(F.array(*[F.lit(float(a)) for a in alpha]), F.col(label))
    else:
        w = F.lit(1.0) if alpha is None else F.when(F.col(label) == 0, alpha).otherwise(1 - alpha)
    return df.withColumn("focal", -w * F.pow(1 - F.exp(logp), gamma) * logp)


def bundle(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: macro precision, recall and F1, and accuracy."""
    return macro_prf(df, truth, guess).withColumn("accuracy", accuracy(df, truth, guess).scalar())
