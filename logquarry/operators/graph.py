"""Entities, alignment, the knowledge graph and its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.session import durable

#: Members a group may have for its pairs to be made in it; sessions have a fixed size below this.
GROUP_PAIRS = 64


def cooccurrence(items: DataFrame, group: str, item: str) -> DataFrame:
    """(src, dst, n): groups in which two items occur together, src < dst, no self-loops.

    Groups are sessions of fixed size; one of more than GROUP_PAIRS distinct
    items raises, since its pairs would grow with its square.
    """
    g = items.where(F.col(item).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("s"))
    g = g.withColumn("s", F.when(F.size("s") <= GROUP_PAIRS, F.col("s")).otherwise(F.raise_error(F.lit("group too large for pairs"))))
    pair = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    return g.select(F.explode(pair).alias("p")).groupBy("p.src", "p.dst").agg(F.count("*").alias("n"))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree, weight) of an undirected edge list (src, dst, n)."""
    both = edges.select(F.explode(F.array("src", "dst")).alias("node"), "n")
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("n").alias("weight"))


def reach(edges: DataFrame, starts: DataFrame, depth: int = 4) -> DataFrame:
    """(node, hops): nodes within ``depth`` steps of any start, with the least steps; breadth first, one join a level."""
    both = durable(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct())
    seen = durable(starts.select("node").distinct().withColumn("hops", F.lit(0)))
    for h in range(1, depth + 1):
        front = seen.where(F.col("hops") == h - 1).select(F.col("node").alias("src"))
        new = both.join(front, "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = durable(seen.unionByName(new.withColumn("hops", F.lit(h))))
    return seen


def bag_cosine_pairs(entities: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cos): pairs of entities (id, words) with cosine of word counts >= threshold, a < b.

    An inverted index on prefixes: words are ordered by rarity, and a pair at
    the threshold must share one of the first words of each, those after which
    the rest alone cannot reach it.  Exact, and no group's pairs are emitted
    unfiltered.
    """
    e = entities.select("id", F.explode("words").alias("w")).groupBy("id", "w").agg(F.count("*").alias("c"))
    df = e.groupBy("w").agg(F.count("*").alias("df"))
    e = e.join(df, "w")
    norm = e.groupBy("id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    e = e.join(norm, "id").withColumn("u", F.col("c") / F.col("norm"))
    bag = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w", "u"))).alias("z"))
    # length of the suffix from each position; the prefix is where it is still >= threshold
    tail = F.transform("z", lambda x, i: F.sqrt(F.aggregate(F.slice("z", i + 1, F.size("z")), F.lit(0.0), lambda s, y: s + y.u * y.u)))
    bag = durable(bag.withColumn("tail", tail))
    pre = bag.select("id", F.explode(F.filter(F.arrays_zip("z", "tail"), lambda x: x.tail >= threshold - 1e-9)).alias("p")).select("id", F.col("p.z.w").alias("w"))
    cand = pre.alias("x").join(pre.alias("y"), F.col("x.w") == F.col("y.w")).where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    m = bag.select("id", F.map_from_entries(F.transform("z", lambda x: F.struct(x.w, x.u))).alias("m"))
    both = cand.join(m.select(F.col("id").alias("a"), F.col("m").alias("ma")), "a").join(m.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b")
    cos = F.aggregate(F.map_entries("ma"), F.lit(0.0), lambda s, x: s + x.value * F.coalesce(F.element_at("mb", x.key), F.lit(0.0)))
    return both.select("a", "b", cos.alias("cos")).where(F.col("cos") >= threshold - 1e-12)


def greedy_align(nodes: DataFrame, pairs: DataFrame, rounds: int = 1000) -> DataFrame:
    """(rep, member): the first unused entity represents itself and all later unused ones paired with it.

    ``nodes(id)``, ``pairs(a, b)`` with a < b.  Parallel form of the sequential
    rule: an entity is settled once all its earlier neighbours are; it joins
    the first of them that is a representative, else it becomes one.  Each
    round settles every entity that can be, so rounds grow with the longest
    chain of dependence, not with the entities.  A chain of more than
    ``rounds`` is refused, not cut.
    """
    pairs = durable(pairs.select("a", "b"))
    open_ = durable(nodes.select("id").distinct())
    done = durable(open_.limit(0).select("id", F.col("id").alias("rep")))
    for _ in range(rounds):
        waiting = pairs.join(open_.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        ready = open_.join(waiting, "id", "left_anti")
        first = pairs.join(done.where("id = rep").select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("r"))
        settled = durable(ready.join(first, "id", "left").select("id", F.coalesce("r", "id").alias("rep")))
        done = done.unionByName(settled)  # each round is a table of its own
        open_ = durable(open_.join(settled.select("id"), "id", "left_anti"))
        if open_.isEmpty():
            return done.select("rep", F.col("id").alias("member"))
    raise ValueError(f"entities are left open after {rounds} rounds")


def triples(answers: DataFrame, text: str) -> DataFrame:
    """Adds ``triples``: (head, relation, tail) of every '(a, b, c)' in an answer."""
    found = F.regexp_extract_all(text, F.lit(r"\(([^(),]+,[^(),]+,[^(),]+)\)"), F.lit(1))
    part = lambda x, i: F.trim(F.get(F.split(x, ","), F.lit(i)))
    return answers.withColumn("triples", F.transform(found, lambda x: F.struct(part(x, 0).alias("head"), part(x, 1).alias("relation"), part(x, 2).alias("tail"))))


def prompt(df: DataFrame, summary: str, entities: str, scores: str | None = None) -> DataFrame:
    """Adds ``prompt``: a root-cause question with the summary and the entities really filled in."""
    listed = F.concat_ws("\n", entities)
    parts = [F.lit("Find the root cause of this failure.\nFailure: "), F.coalesce(summary, F.lit("")), F.lit("\nRelated entities:\n"), listed]
    if scores:
        parts += [F.lit("\nSimilarity: "), F.concat_ws(", ", F.transform(scores, lambda x: F.format_number(x, 4)))]
    return df.withColumn("prompt", F.concat(*parts, F.lit("\nAnswer with the root cause and with knowledge triples (head, relation, tail).")))


def set_overlaps(entities: DataFrame) -> DataFrame:
    """(a, b, shared, within, half): pairs of entities (id, words) that share words.

    ``within``: all words of a are words of b; ``half``: they are half of b's
    or more.  Words lead to the pairs, so entities without a word in common
    are never compared.
    """
    e = entities.select("id", F.explode(F.array_distinct("words")).alias("w"))
    n = entities.select("id", F.size(F.array_distinct("words")).alias("k"))
    s = e.withColumnRenamed("id", "a").join(e.withColumnRenamed("id", "b"), "w").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    s = s.join(n.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(n.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    return s.select("a", "b", "shared", (F.col("shared") == F.col("ka")).alias("within"), (F.col("shared") >= 0.5 * F.col("kb")).alias("half"))


def similarity_edges(together: DataFrame, entities: DataFrame, threshold: float) -> DataFrame:
    """(a, b, weight): pairs of ``together(a, b)``, a < b, whose word bags have a cosine over ``threshold``, with it as the weight."""
    near = bag_cosine_pairs(entities, threshold).where(F.col("cos") > threshold + 1e-12)
    return near.join(together.select("a", "b").distinct(), ["a", "b"]).select("a", "b", F.col("cos").alias("weight"))


def direct(edges: DataFrame, node: str) -> DataFrame:
    """(node, n): neighbours of a node in an undirected edge list (src, dst, n)."""
    return edges.where((F.col("src") == node) | (F.col("dst") == node)).select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("node"), "n")
