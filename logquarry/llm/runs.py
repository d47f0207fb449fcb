"""Problem 5: runs of the same event in a session, collapsed to one event with count and duration.

Symbol-string regex: the canonical events of a session, each with its label,
become Unicode code points, a session becomes one string, and a regular
expression with a backreference matches the repetitions.  Symbols are numbered
within the session, so no dictionary has to fit anywhere; all of it is
JVM-side expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dictionary of at most so many templates is broadcast, a larger one joined.
BROADCAST_TEMPLATES = 50_000
#: Code points above the first plane; a session of as many kinds of events raises.
MOST_KINDS = 0x100000


def canonical_event(template: Column) -> Column:
    """Letters of a template in order, without case and without what stands in angle brackets."""
    return F.lower(F.regexp_replace(F.regexp_replace(template, r"<[^<>]*>", ""), r"[^\p{L}]+", ""))


def _with_events(sessions: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds ``events``: the canonical event of every position; an unknown id is an event of its own."""
    t = templates.where("EventId is not null").groupBy("EventId").agg(F.min("EventTemplate").alias("EventTemplate"))
    c = canonical_event(F.col("EventTemplate"))
    t = t.select("EventId", F.when(c != "", F.concat(F.lit("t:"), c)).otherwise(F.concat(F.lit("i:"), "EventId")).alias("ev"))
    if t.count() <= BROADCAST_TEMPLATES:
        m = t.agg(F.map_from_entries(F.collect_list(F.struct("EventId", "ev"))).alias("m"))
        s = sessions.withColumn("m", m.scalar())  # one value, its size bounded just above
        ev = F.transform("event_ids", lambda x: F.coalesce(F.when(x.isNotNull(), F.element_at("m", x)), F.concat(F.lit("i:"), x)))
        return s.withColumn("events", ev).drop("m")
    sessions = sessions.withColumn("key", F.md5(F.to_json(F.struct("sid", "event_ids", "labels", "idx"))))
    e = sessions.select("key", F.posexplode("event_ids").alias("pos", "EventId")).join(t, "EventId", "left")
    e = e.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("ev", F.concat(F.lit("i:"), "EventId")).alias("ev")))).alias("z"))
    return sessions.join(e.select("key", F.transform("z", lambda x: x.ev).alias("events")), "key", "left").drop("key")


def runs(sessions: DataFrame, templates: DataFrame) -> DataFrame:
    """Every maximal run: (sid, start_pos, n_events, event, label, first_idx, last_idx, all_idx), runs of one included.

    A session delivered again with the same content counts once.  NULL arrays and
    empty ones give no rows; a NULL event or label equals only another NULL;
    arrays of unequal length are read as far as event_ids goes.  Further
    columns are ignored; an empty table gives no rows.
    """
    s = sessions.select("sid", "event_ids", "labels", "idx").where("size(event_ids) > 0")
    s = s.distinct()
    s = _with_events(s, templates)
    pair = F.transform("events", lambda e, i: F.concat_ws("\u0001", F.coalesce(e, F.lit("\u0002")), F.coalesce(F.get("labels", i).cast("string"), F.lit("\u0002"))))
    s = s.withColumn("pairs", pair).withColumn("kinds", F.array_distinct("pairs"))
    s = s.withColumn("kinds", F.when(F.size("kinds") < MOST_KINDS, F.col("kinds")).otherwise(F.raise_error(F.lit("a session of more kinds of events than there are code points"))))
    # symbol k is code point 0x10000 + k, written as its two UTF-16 halves
    k = lambda p: F.array_position("kinds", p)
    half = lambda p: F.concat(F.hex(F.lit(0xD800) + F.shiftright(k(p), 10)), F.hex(F.lit(0xDC00) + k(p).bitwiseAND(F.lit(0x3FF))))
    word = F.decode(F.unhex(F.array_join(F.transform("pairs", half), "")), "UTF-16BE")
    s = s.withColumn("word", word)
    s = s.withColumn("matched", F.regexp_extract_all("word", F.lit(r"(?s)((.)\2*)"), F.lit(1)))
    lens = F.transform("matched", lambda m: F.char_length(m))
    ends = F.aggregate(lens, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + n))
    s = s.withColumn("ends", ends)
    s = s.select("sid", "events", "labels", "idx", F.explode(F.arrays_zip(F.col("ends").alias("e"), lens.alias("n"))).alias("z"))
    start = F.col("z.e") - F.col("z.n")
    return s.select(
        "sid", start.alias("start_pos"), F.col("z.n").alias("n_events"), F.get("events", start).alias("event"), F.get("labels", start).alias("label"),
        F.get("idx", start).alias("first_idx"), F.get("idx", F.col("z.e") - 1).alias("last_idx"),
        F.slice("idx", start + 1, F.col("z.n")).alias("all_idx"),
    )


def collapse(sessions: DataFrame, templates: DataFrame, log: DataFrame) -> DataFrame:
    """Runs with their times: adds started, ended and duration_us from the log's Time over idx.

    The times of all rows of a run count, from the earliest to the latest, as
    a late row may stand anywhere in it.  An idx that the log lacks is left
    out; a run without any row in the log has NULL times.
    """
    r = runs(sessions, templates)
    ts = F.try_to_timestamp("Time", F.lit("yyyy-MM-dd-HH.mm.ss.SSSSSS")).cast("timestamp_ntz")
    t = log.where("idx is not null").select(F.col("idx").alias("i"), ts.alias("ts"))  # a row met twice changes neither end
    rows = r.select("sid", "start_pos", F.explode("all_idx").alias("i")).where("i is not null").distinct()
    span = rows.join(t, "i").groupBy("sid", "start_pos").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    us = F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return r.drop("all_idx").join(span, ["sid", "start_pos"], "left").withColumn("duration_us", us)


def found(sessions: DataFrame, templates: DataFrame) -> DataFrame:
    """(sid, start_pos, n_events) of the runs of two or more."""
    return runs(sessions, templates).where("n_events >= 2").select("sid", "start_pos", "n_events").distinct()
