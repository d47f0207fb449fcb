"""Problem 8: sources mixed to target token shares, small ones repeated at most so often.

Temperature mixing: weights are ``base * (natural / base) ** a``, normalised.
With the targets as base, a = 0 gives the targets and a = 1 the natural
shares; with an even base it is the plain temperature rule.  The exponent is
bisected to the least that a budget's repetition limits allow, or to a target
entropy.  Weights become budgets, budgets whole passes over a source and one
part of a pass, each pass a permutation of the source's documents by hash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logquarry.llm.tokens import TOKENIZER, count_tokens
from logquarry.session import durable

#: Documents a hash bucket holds on average; a part of a pass is cut inside one bucket.
BUCKET_DOCS = 20_000
#: Sources a mixture may have; the driver holds one row for each.
MAX_SOURCES = 100_000
#: Blocks of the mixture; each has every source in its share.
BLOCKS = 1024


def weights(natural: dict[str, float], base: dict[str, float], a: float) -> dict[str, float]:
    """Normalised ``base * (natural / base) ** a`` of the sources that have both."""
    raw = {s: base[s] * (natural[s] / base[s]) ** a for s in base if base[s] > 0 and natural.get(s, 0) > 0}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()} if total else {}


def entropy(w: dict[str, float]) -> float:
    """Shannon entropy in nats."""
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def exponent_for_entropy(natural: dict[str, float], target: float) -> float:
    """Exponent of the plain rule in [0, 1] whose weights have the entropy nearest to ``target``, by bisection."""
    even = dict.fromkeys(natural, 1 / max(len(natural), 1))
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(weights(natural, even, mid)) > target else (lo, mid)
    return (lo + hi) / 2


def exponent_for_limits(tokens: dict[str, int], base: dict[str, float], limits: dict[str, int], budget: float) -> float:
    """Least exponent in [0, 1] at which no source exceeds its limit for ``budget`` tokens; 1 if even that exceeds one."""
    total = sum(tokens.values())
    natural = {s: n / total for s, n in tokens.items()} if total else {}

    def fits(a: float) -> bool:
        return all(budget * w <= limits[s] * tokens[s] * (1 + 1e-12) for s, w in weights(natural, base, a).items())

    if fits(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def plan(tokens: dict[str, int], base: dict[str, float], limits: dict[str, int], budget: float | None = None, stretch: float = 1.0, target_entropy: float | None = None) -> dict[str, float]:
    """Tokens to take of each source.

    Without a budget the mixture is ``stretch`` times the largest that meets
    the targets exactly within the limits.  Beyond that size, or with a budget
    beyond it, the exponent is bisected: the weights leave the targets only as
    far as the limits force them to.  With ``target_entropy`` (nats) the
    targets give way to the plain temperature rule, its exponent bisected to
    that entropy; the mixture is the largest within the limits, or the budget.
    Sources without tokens or with a target of 0 get none, and the others keep
    their proportions.
    """
    live = {s: n for s, n in tokens.items() if n > 0 and base.get(s, 0) > 0 and limits.get(s, 0) > 0}
    base = {s: base[s] for s in live}
    total = sum(live.values())
    natural = {s: n / total for s, n in live.items()} if total else {}
    if not live:
        return {}
    if target_entropy is not None:
        base = dict.fromkeys(live, 1 / len(live))
        w = weights(natural, base, exponent_for_entropy(natural, target_entropy))
    else:
        w = weights(natural, base, 0.0)
    most = min(limits[s] * live[s] / w[s] for s in live)
    size = budget if budget is not None else stretch * most
    if target_entropy is None:
        w = weights(natural, base, exponent_for_limits(live, base, limits, size))
    return {s: min(size * w[s], limits[s] * live[s]) for s in live}


def _counted(docs: DataFrame, targets: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    if (n := t.count()) > MAX_SOURCES:
        raise ValueError(f"{n} sources; a mixture has at most {MAX_SOURCES}")
    d = docs.where("text <> ''").join(F.broadcast(t.select("source")), "source", "left_semi")  # counted just above
    return durable(count_tokens(d, ["doc_id", "source"], path=path)), t


def mixture(docs: DataFrame, targets: DataFrame, budget: float | None = None, path: str = TOKENIZER, stretch: float = 1.0, entropy_of_targets: bool = False) -> DataFrame:
    """(doc_id, source, pass, n_tokens, block, place): one row for each use of a document.

    Sorting by (block, place) gives the mixture: place runs evenly through a
    source's uses, so each block holds the sources in their shares.  pass
    counts from 0 and stays below max_repeats.  Documents without a source,
    of sources that have no target, NULL and empty texts are not used; copies
    of a text are documents like others; repeated doc_ids count as documents;
    further columns are ignored; an empty table gives no rows.  ``budget`` and
    ``stretch`` set the size, see ``plan``; ``entropy_of_targets`` mixes by
    temperature to the entropy that the targets have.
    """
    counted, t = _counted(docs, targets, path)
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).join(t, "source").collect()
    by = {r["source"]: r for r in sums}
    share = {s: r["target_share"] or 0.0 for s, r in by.items()}
    total = sum(share.values())
    goal_entropy = entropy({s: x / total for s, x in share.items()}) if entropy_of_targets and total else None
    take = plan({s: r["tokens"] for s, r in by.items()}, share, {s: r["max_repeats"] or 0 for s, r in by.items()}, budget, stretch, goal_entropy)
    spark = docs.sparkSession
    rows = [(s, int(v // by[s]["tokens"]), float(v - (v // by[s]["tokens"]) * by[s]["tokens"]), v / by[s]["tokens"], max(1, math.ceil(by[s]["docs"] / BUCKET_DOCS))) for s, v in sorted(take.items())]
    goal = F.broadcast(spark.createDataFrame(rows, "source string, whole int, part double, passes double, buckets int"))  # one row a source
    d = counted.join(goal, "source").where("n_tokens > 0")
    full = d.where("whole > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).withColumn("h", F.xxhash64("doc_id", "pass"))
    last = d.where("part > 0").withColumn("pass", F.col("whole")).withColumn("h", F.xxhash64("doc_id", "pass"))
    last = last.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.col("buckets")))
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = last.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("in_bucket")).withColumn("before", F.coalesce(F.sum("in_bucket").over(run), F.lit(0)))
    last = last.join(before, ["source", "bucket"])
    inside = last.where(F.col("before") + F.col("in_bucket") <= F.col("part"))
    edge = last.where((F.col("before") < F.col("part")) & (F.col("before") + F.col("in_bucket") > F.col("part")))
    cols = ["doc_id", "source", "pass", "n_tokens", "h", "passes"]
    cut = edge.select(*cols, (F.col("part") - F.col("before")).alias("room")).groupBy("source").applyInPandas(_first_fit, edge.select(*cols).schema)
    used = full.select(*cols).unionByName(inside.select(*cols)).unionByName(cut)
    u = (F.col("pass") + (F.shiftrightunsigned("h", 1) / F.lit(float(2**63))) * F.least(F.lit(1.0), F.col("passes") - F.col("pass"))) / F.col("passes")
    return used.withColumn("place", u).select("doc_id", "source", "pass", "n_tokens", F.least(F.floor(u * BLOCKS), F.lit(BLOCKS - 1)).cast("int").alias("block"), "place")


def _first_fit(bucket: pd.DataFrame) -> pd.DataFrame:
    """Of the bucket in which a source's budget ends, in hash order, the documents that still fit the room left."""
    b = bucket.sort_values(["h", "doc_id"], kind="stable")
    room, take = b["room"].iloc[0], []
    for n in b["n_tokens"]:
        take.append(n <= room)
        room -= n if take[-1] else 0
    return b[take].drop(columns="room")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares reached: (source, target_share, share, n_tokens, n_uses, most_passes), one row for each target."""
    m = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"), (F.max("pass") + 1).alias("most_passes"))
    m = m.withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(W.partitionBy(F.lit(1))))
    t = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"))
    return t.join(m, "source", "left").select("source", "target_share", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("most_passes", F.lit(0)).alias("most_passes"))
