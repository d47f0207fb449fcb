"""Citations against canonical records: title match, verdict, advisories, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logquarry.functions import text as T
from logquarry.session import durable


def title_match(df: DataFrame, expected: str, canonical: str) -> DataFrame:
    """Adds e, c, inter, precision, recall, f1, containment, verdict of two title columns.

    EXACT comes before the guard for short titles: fewer than three
    meaningful words on the expected side, or none on the other, are
    INSUFFICIENT.  Rounded values meet the bands 0.85, 0.70, 0.40.
    """
    d = df.withColumn("_e", T.normalise_title(F.col(expected))).withColumn("_c", T.normalise_title(F.col(canonical)))
    d = d.withColumn("_ew", T.meaningful(F.coalesce("_e", F.lit("")))).withColumn("_cw", T.meaningful(F.coalesce("_c", F.lit(""))))
    d = d.withColumn("e", F.size("_ew")).withColumn("c", F.size("_cw")).withColumn("inter", T.multiset_overlap(F.col("_ew"), F.col("_cw")))
    p, r = F.col("inter") / F.nullif(F.col("c"), F.lit(0)), F.col("inter") / F.nullif(F.col("e"), F.lit(0))
    f = 2 * p * r / F.nullif(p + r, F.lit(0.0))
    exact = (F.col("_e") == F.col("_c")) & (F.col("_e") != "")
    short = (F.col("e") < 3) | (F.col("c") == 0)
    d = d.withColumn("f1", F.when(exact, 1.0).when(short, 0.0).otherwise(F.round(F.coalesce(f, F.lit(0.0)), 6)))
    d = d.withColumn("containment", F.round(F.coalesce(F.col("inter") / F.nullif(F.least("e", "c"), F.lit(0)), F.lit(0.0)), 2))
    band = F.when(F.col("f1") >= 0.85, "STRONG_MATCH").when(F.col("f1") >= 0.70, "MATCH").when(F.col("f1") >= 0.40, "WEAK_MATCH").otherwise("MISMATCH")
    d = d.withColumn("verdict", F.when(exact, "EXACT").when(short, "INSUFFICIENT").otherwise(band))
    return d.drop("_e", "_c", "_ew", "_cw")


def status_of(verdict: Column, route: Column, has_record: Column) -> Column:
    """Status of a citation from its title verdict, how it was looked up and whether a record was found."""
    return (
        F.when(route == "insufficient_data", "NEEDS_MANUAL_VERIFICATION")
        .when(~has_record, "NOT_FOUND")
        .when(verdict.isin("EXACT", "STRONG_MATCH", "MATCH"), "VERIFIED")
        .when(verdict == "WEAK_MATCH", "PARTIAL_MATCH")
        .when((verdict == "MISMATCH") & route.isin("doi", "nber"), "METADATA_MISMATCH")
        .when(verdict == "MISMATCH", "NOT_FOUND")
        .otherwise("NEEDS_MANUAL_VERIFICATION")
    )


def containment_advisory(df: DataFrame) -> DataFrame:
    """Adds ``advisory``: a partial match whose shorter title lies in the longer one (f1 in [0.60, 0.70), containment >= 0.90)."""
    return df.withColumn("advisory", (F.col("f1") >= 0.60) & (F.col("f1") < 0.70) & (F.col("containment") >= 0.90))


def book_sibling(df: DataFrame) -> DataFrame:
    """First sibling record that the citation may mean instead: a book or monograph of the same first author with f1 over 0.85.

    Needs top STRUCT<type,doi,title>, siblings ARRAY<STRUCT<type,doi,title,first_author,f1>> and
    first_author; adds ``sibling`` (NULL where there is none).
    """
    a = F.lower(F.split(F.regexp_replace("first_author", ",", " "), " ")[0])
    fits = F.filter("siblings", lambda s: s.type.isin("book", "monograph") & F.contains(F.lower(s.first_author), a) & (s.f1 > 0.85))
    return df.withColumn("sibling", F.when(F.col("top.type") == "book-chapter", F.get(fits, F.lit(0))))


def best_by_tokens(left: DataFrame, right: DataFrame, k: int = 5, threshold: float = 0.70, itself: bool = True) -> DataFrame:
    """(id, other, rank, f1): the k best right titles of each left title with a word F1 of ``threshold`` or more, exactly.

    left(id, title), right(other, title); without ``itself`` a row with
    other = id takes none of the places; ties go to the lower ``other``.
    Titles of the same words are matched once, so a title that many rows carry
    is one on either side, and of its rows only the k + 1 lowest can take a
    place.  Prefix filter: words are ordered by rarity; sets with F1 >= t
    share t / (2 - t) of each one's words and, unless they are equal, two at
    least, so such sets meet in two of the first words of both; a pair whose
    sizes, or whose words after these two, cannot reach t goes no further.
    """
    bag = F.array_sort(F.array_distinct(T.meaningful(T.normalise_title(F.col("title")))))
    lw = durable(left.withColumn("w", bag).where(F.size("w") > 0).select("id", "w"))
    lbags = durable(lw.select("w").distinct().withColumn("lb", F.monotonically_increasing_id()))
    rw = right.withColumn("w", bag).where(F.size("w") > 0).select("other", "w")
    lowest = rw.withColumn("p", F.row_number().over(W.partitionBy("w").orderBy("other"))).where(F.col("p") <= k + 1)
    rbags = durable(lowest.groupBy("w").agg(F.array_sort(F.collect_list("other")).alias("others")).withColumn("rb", F.monotonically_increasing_id()))
    df = rbags.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    share = threshold / (2 - threshold)

    def prefix(d: DataFrame, key: str) -> DataFrame:
        e = d.where(F.size("w") > 1).select(key, F.size("w").alias("n"), F.explode("w").alias("word")).join(df, "word", "left")
        z = e.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("z"))
        z = z.select(key, "n", F.transform("z", lambda x: F.xxhash64(x.word)).alias("h"))  # short forms of the words, in order of rarity
        keep = F.least(F.col("n"), (F.col("n") - F.ceil(share * F.col("n") - F.lit(1e-9)) + 2).cast("int"))
        two = F.flatten(F.transform(F.slice("h", F.lit(1), keep), lambda x, i: F.transform(F.slice("h", F.lit(1), i), lambda y: F.struct(F.xxhash64(y, x).alias("two"), i.alias("pos")))))
        apart = F.when(F.size(F.array_distinct("h")) == F.col("n"), F.col("h"))  # NULL if two words of a title share a short form
        return z.select(key, "n", apart.alias("g"), F.explode(two).alias("p")).select(key, "n", F.col("g").alias("h"), "p.two", "p.pos")

    a = prefix(lbags, "lb").select("two", "lb", F.col("h").alias("ha"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    b = prefix(rbags, "rb").select("two", "rb", F.col("h").alias("hb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    need = F.lit(threshold / 2) * (F.col("na") + F.col("nb")) - F.lit(1e-9)
    met = a.join(b, "two").where((F.least("na", "nb") >= need) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1 >= need))
    enough = F.size(F.array_intersect("ha", "hb")) >= need  # short forms share no less than the words
    met = met.where(F.col("ha").isNull() | F.col("hb").isNull() | enough).select("lb", "rb").distinct()
    f1 = 2 * F.size(F.array_intersect("a", "b")) / (F.size("a") + F.size("b"))
    pairs = met.join(lbags.withColumnRenamed("w", "a"), "lb").join(rbags.withColumnRenamed("w", "b"), "rb").where("a <> b").withColumn("f1", f1)
    pairs = pairs.where(F.col("f1") >= threshold - 1e-12).select("a", "others", F.round("f1", 6).alias("f1"))
    same = lbags.select(F.col("w").alias("a")).join(rbags.select(F.col("w").alias("a"), "others"), "a").select("a", "others", F.lit(1.0).alias("f1"))
    hit = lw.withColumnRenamed("w", "a").join(pairs.unionByName(same), "a").select("id", "f1", F.explode("others").alias("other"))
    hit = hit.where(F.lit(itself) | (F.col("id") != F.col("other")))
    best = W.partitionBy("id").orderBy(F.col("f1").desc(), "other")
    return hit.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "other", "rank", "f1")


#: The mark of each status in a report.
ICONS = {"VERIFIED": "[OK]", "PARTIAL_MATCH": "[?]", "METADATA_MISMATCH": "[!]", "NOT_FOUND": "[X]", "NEEDS_MANUAL_VERIFICATION": "[TODO]"}


def status_counts(verdicts: DataFrame) -> DataFrame:
    """(status, n) of every status, absent ones included."""
    spark = verdicts.sparkSession
    every = spark.createDataFrame([(s,) for s in ICONS], "status string")
    return every.join(verdicts.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_keys(citations: DataFrame) -> DataFrame:
    """(key, n) of the DOIs, or raw texts without one, that occur more than once."""
    return citations.groupBy(F.coalesce("doi", "raw").alias("key")).agg(F.count("*").alias("n")).where("n > 1 and key is not null")


def findings(verdicts: DataFrame) -> DataFrame:
    """(section, index, line): Markdown lines of verdicts (index, status, authors, year, title), all of them and the critical ones again."""
    said = F.concat_ws(" ", F.coalesce(F.get("authors", F.lit(0)), F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce("title", F.lit("")))
    icon = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in ICONS.items()])
    line = F.concat(icon, F.lit(" **["), "status", F.lit("]** "), F.col("index").cast("string"), F.lit(" -- "), F.substring(T.sanitise(said), 1, 100))
    critical = F.col("status").isin("METADATA_MISMATCH", "NOT_FOUND")
    d = verdicts.select("index", line.alias("line"), F.explode(F.when(critical, F.array(F.lit("critical"), F.lit("all"))).otherwise(F.array(F.lit("all")))).alias("section"))
    return d.select("section", "index", "line")


def report(verdicts: DataFrame, shown: int = 1000) -> str:
    """Markdown: counts by status, keys that occur twice, critical findings and all findings by index.

    verdicts(index, status, raw, doi, authors, year, title).  Each list is cut
    at ``shown`` rows, as a report is read by people; the counts are not.
    """
    n = {r["status"]: r["n"] for r in status_counts(verdicts).collect()}
    out = ["# Citation report", "", f"Citations checked: {sum(n.values())}", *(f"- {icon} {status}: {n[status]}" for status, icon in ICONS.items()), ""]
    if twice := duplicate_keys(verdicts).orderBy("key").limit(shown).select(T.sanitise(F.col("key")).alias("key"), "n").collect():
        out += ["## Duplicate entries", "", *(f"- {r['key']}: {r['n']} times" for r in twice), ""]
    lines = findings(verdicts)
    for section, head in (("critical", "## Critical issues"), ("all", "## All findings")):
        if rows := lines.where(F.col("section") == section).orderBy("index").limit(shown).collect():
            out += [head, "", *(f"- {r['line']}" for r in rows), ""]
    return "\n".join(out)


def failed(verdicts: DataFrame) -> bool:
    """Whether any citation was mismatched or not found."""
    return bool(verdicts.agg(F.bool_or(F.col("status").isin("METADATA_MISMATCH", "NOT_FOUND"))).first()[0])
