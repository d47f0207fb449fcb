"""Queries over the tables by name, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import text as T
from logquarry.functions.vectors import search
from logquarry.operators import graph, match, metrics, nested, sessions, small, temporal, templates, value
from logquarry.plans import learning
from logquarry.plans.nested_sql import first_titles_sql
from logquarry.session import load
from logquarry.streaming import sessions as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---- sessions ---------------------------------------------------------------------------------

_EV = "e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events), s AS (SELECT *, ((rn - 1) // 20) * 20 AS sid FROM e)"


@query(f"""WITH {_EV}, t AS (SELECT sid, rn, event_type AS state, lead(event_type, 1) OVER w AS next_state, lead(1, 2) OVER w IS NULL AS last FROM s WINDOW w AS (PARTITION BY sid ORDER BY rn))
SELECT state, next_state, count(*) AS n, sum(CASE WHEN last THEN 50.0 ELSE 1.0 END)::DOUBLE AS reward FROM t WHERE next_state IS NOT NULL GROUP BY ALL""")
def event_transitions(s: SparkSession, d: str) -> DataFrame:
    """Transitions between the events of fixed sessions, counted."""
    t = sessions.transitions(sessions.event_sessions(load(s, d, "events")), "sid", ["rn"], "event_type")
    return t.groupBy("state", "next_state").agg(F.count("*").alias("n"), F.sum("reward").alias("reward"))


@query(f"WITH {_EV} SELECT sid, count(*) AS n, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS label FROM s GROUP BY sid")
def session_labels(s: SparkSession, d: str) -> DataFrame:
    """Sessions that contain an error are abnormal."""
    e = sessions.event_sessions(load(s, d, "events"))
    return e.groupBy("sid").agg(F.count("*").alias("n"), F.max((F.col("event_type") == "error").cast("int")).alias("label"))


@query(f"WITH {_EV} SELECT sid, string_agg(event_type, ' ' ORDER BY rn) AS value FROM s GROUP BY sid")
def session_sequences(s: SparkSession, d: str) -> DataFrame:
    """Sessions as text, in order."""
    e = sessions.ordered_list(sessions.event_sessions(load(s, d, "events")), ["sid"], "rn", "event_type", "ids")
    return e.select("sid", F.concat_ws(" ", "ids").alias("value"))


@query("SELECT DISTINCT sid, len(event_ids)::INT AS n, event_ids[1] AS first_event, event_ids[-1] AS last_event, list_contains(labels, 1) AS abnormal FROM bgl_sessions")
def stored_sessions(s: SparkSession, d: str) -> DataFrame:
    """First and last event and label of the stored sessions, each once."""
    b = load(s, d, "bgl_sessions").where(F.size("event_ids") > 0)
    return b.select("sid", F.size("event_ids").alias("n"), F.get("event_ids", F.lit(0)).alias("first_event"), F.element_at("event_ids", -1).alias("last_event"), F.array_contains("labels", 1).alias("abnormal")).distinct()


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY idx) AS rn FROM bgl_log), s AS (SELECT *, ((rn - 1) // 20) * 20 AS sid FROM r)
SELECT sid, min(strptime(Time, '%Y-%m-%d-%H.%M.%S.%f')) AS started, max((Label <> '-')::INT) AS label, count(DISTINCT EventId) AS n_events FROM s GROUP BY sid""")
def log_sessions(s: SparkSession, d: str) -> DataFrame:
    """The structured log in sessions of 20 rows: start, label, distinct events."""
    r = sessions.fixed_sessions(sessions.number_rows(load(s, d, "bgl_log").select("idx", "Time", "Label", "EventId"), ["idx"], F.floor(F.col("idx") / 100_000)))
    ts = F.try_to_timestamp("Time", F.lit("yyyy-MM-dd-HH.mm.ss.SSSSSS")).cast("timestamp_ntz")
    return r.groupBy("sid").agg(F.min(ts).alias("started"), F.max((F.col("Label") != "-").cast("int")).alias("label"), F.countDistinct("EventId").alias("n_events"))


@query(f"""WITH {_EV}, k AS (SELECT DISTINCT sid FROM s), o AS (SELECT sid, row_number() OVER (ORDER BY md5(sid::VARCHAR || ':42'), sid) AS pos, count(*) OVER () AS n FROM k)
SELECT sid, CASE WHEN pos <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM o""")
def session_split_md5(s: SparkSession, d: str) -> DataFrame:
    """Train and test split of sessions by md5 order."""
    return sessions.md5_split(sessions.event_sessions(load(s, d, "events")), "sid")


@query("""WITH k AS (SELECT DISTINCT sid FROM bgl_sessions), o AS (SELECT sid, row_number() OVER (ORDER BY sid) AS pos, count(*) OVER () AS n FROM k) SELECT sid, pos <= (n * 7) // 8 AS head FROM o""")
def session_head_7of8(s: SparkSession, d: str) -> DataFrame:
    """The first seven eighths of the session keys."""
    k = load(s, d, "bgl_sessions").select("sid").distinct()
    return sessions.head_share(k, ["sid"], F.floor(F.col("sid") / 100_000)).select("sid", "head")


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def head_n_lines(s: SparkSession, d: str) -> DataFrame:
    """The first 100 rows: the limit is the feature."""
    return load(s, d, "documents").orderBy("doc_id").limit(100).select("doc_id", "n_chars")


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id FROM o WHERE pos <= floor(n * 10 / 100)""")
def sample_pct(s: SparkSession, d: str) -> DataFrame:
    """A tenth of the documents by md5 order: the sample is the feature."""
    return sessions.md5_split(load(s, d, "documents"), "doc_id", 0.1).where("split = 'train'").select("doc_id")


@query("SELECT DISTINCT event_ids[-1] AS final_state FROM bgl_sessions WHERE len(event_ids) > 0 AND NOT list_contains(labels, 1)")
def final_states(s: SparkSession, d: str) -> DataFrame:
    """Last events of the normal sessions."""
    return sessions.final_states(load(s, d, "bgl_sessions").where(~F.array_contains("labels", 1)))


@query("""WITH f AS (SELECT DISTINCT event_ids[-1] AS f FROM bgl_sessions WHERE NOT list_contains(labels, 1))
SELECT DISTINCT sid, event_ids[-1] AS last_event FROM bgl_sessions WHERE event_ids[-1] NOT IN (SELECT f FROM f)""")
def nonfinal_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions that end with an event no normal session ends with."""
    b = load(s, d, "bgl_sessions")
    return b.select("sid", F.element_at("event_ids", -1).alias("last_event")).distinct().join(final_states(s, d).withColumnRenamed("final_state", "last_event"), "last_event", "left_anti").select("sid", "last_event")


@query("""WITH f AS (SELECT EventId, min(idx) AS first, count(*) AS n FROM bgl_log GROUP BY EventId) SELECT EventId, row_number() OVER (ORDER BY first) AS id, n, first FROM f""")
def event_dictionary(s: SparkSession, d: str) -> DataFrame:
    """Dense event numbers by first appearance, with counts; the dictionary is small, the log is only aggregated."""
    f = load(s, d, "bgl_log").groupBy("EventId").agg(F.min("idx").alias("first"), F.count("*").alias("n"))
    return sessions.number_rows(f, ["first"], F.floor(F.col("first") / 1_000_000), "id").select("EventId", "id", "n", "first")


@query("""SELECT coalesce(m.id, -1) AS id, count(*) AS n FROM events e LEFT JOIN (SELECT * FROM (VALUES ('click', 0), ('view', 1), ('purchase', 2)) v(event_type, id)) m USING (event_type) GROUP BY ALL""")
def id_mapping_default(s: SparkSession, d: str) -> DataFrame:
    """Events by mapped number, -1 where there is none."""
    m = s.createDataFrame([("click", 0), ("view", 1), ("purchase", 2)], "event_type string, id int")
    return load(s, d, "events").join(F.broadcast(m), "event_type", "left").groupBy(F.coalesce("id", F.lit(-1)).alias("id")).agg(F.count("*").alias("n"))


# ---- value model ------------------------------------------------------------------------------

_LI = "li AS (SELECT l_orderkey AS sid, l_partkey AS state, row_number() OVER w AS rn, lead(l_partkey, 1) OVER w AS nx, lead(1, 2) OVER w IS NULL AS last FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"


def _sweeps(n: int, reward: str, done: str, start: str | None = None) -> str:
    out = [f"tr AS (SELECT state, nx, {done} AS done, count(*) AS n, sum({reward}) AS r FROM li WHERE nx IS NOT NULL GROUP BY ALL)"]
    prev = start
    for i in range(1, n + 1):
        nxt = f"CASE WHEN tr.done THEN 0.0 ELSE tr.n * 0.99 * coalesce(p.q, 0.0) END" if prev else "0.0"
        join = f" LEFT JOIN {prev} p ON p.state = tr.nx" if prev else ""
        tag = f"{'z' if start else 'q'}{i}"
        out.append(f"{tag} AS (SELECT tr.state, sum(tr.r + {nxt}) / sum(tr.n) AS q FROM tr{join} GROUP BY tr.state)")
        prev = tag
    return ", ".join(out)


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_POS = _sweeps(5, "CASE WHEN last THEN 50.0 ELSE 1.0 END", "last")


def _line_transitions(s: SparkSession, d: str, negative: bool = False) -> DataFrame:
    return sessions.transitions(load(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"), "l_orderkey", _ORDER, "l_partkey", negative)


@query(f"WITH {_LI}, {_POS} SELECT state, round(q, 6) AS q FROM q5")
def session_value_sweep5(s: SparkSession, d: str) -> DataFrame:
    """Event values after five sweeps."""
    return value.values(_line_transitions(s, d), 5).select("state", F.round("q", 6).alias("q"))


@query(f"WITH {_LI}, {_POS}, " + _sweeps(2, "-1.0", "false", "q5").replace("tr AS", "tn AS").replace("tr.", "tn.").replace("FROM tr", "FROM tn") + " SELECT state, round(q, 6) AS q FROM z2")
def session_value_negative(s: SparkSession, d: str) -> DataFrame:
    """Values after two more sweeps on negative transitions, from those of the five."""
    return value.values(_line_transitions(s, d, True), 2, value.values(_line_transitions(s, d), 5)).select("state", F.round("q", 6).alias("q"))


@query(f"""WITH {_LI}, {_POS}, x AS (SELECT sid, rn, li.state, nx, coalesce(q5.q < 42, false) AS low FROM li LEFT JOIN q5 ON q5.state = li.state),
tr8 AS (SELECT DISTINCT state FROM li WHERE nx IS NULL AND sid % 10 < 8),
g AS (SELECT sid, bool_or(low AND nx IS NOT NULL) AS low_event, max(CASE WHEN nx IS NULL THEN state END) AS last FROM x GROUP BY sid)
SELECT sid, low_event, last NOT IN (SELECT state FROM tr8) AS bad_end, low_event OR last NOT IN (SELECT state FROM tr8) AS flagged FROM g""")
def session_flags(s: SparkSession, d: str) -> DataFrame:
    """Orders whose parts have low values or whose last part ends no order of the training keys (key % 10 < 8)."""
    li = load(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    ends = li.where("l_orderkey % 10 < 8").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct(*_ORDER)).alias("final_state")).select("final_state").distinct()
    f = value.flag_sessions(li, "l_orderkey", _ORDER, "l_partkey", value.values(_line_transitions(s, d), 5), ends, 42.0)
    return f.withColumnRenamed("l_orderkey", "sid")


# ---- metrics ----------------------------------------------------------------------------------

_GUESS = "b AS (SELECT DISTINCT sid, list_contains(labels, 1) AS truth, event_ids[-1] NOT IN (SELECT event_ids[-1] FROM bgl_sessions WHERE NOT list_contains(labels, 1) AND sid % 200 < 160) AS guess FROM bgl_sessions)"


def _guessed(s: SparkSession, d: str) -> DataFrame:
    b = load(s, d, "bgl_sessions").select("sid", F.element_at("event_ids", -1).alias("last"), F.array_contains("labels", 1).alias("truth")).distinct()
    ends = b.where("not truth and sid % 200 < 160").select("last", F.lit(True).alias("known")).distinct()
    return b.join(ends, "last", "left").select("sid", "truth", F.col("known").isNull().alias("guess"))


@query(f"""WITH {_GUESS}, c AS (SELECT count_if(truth AND guess) AS tp, count_if(NOT truth AND guess) AS fp, count_if(truth AND NOT guess) AS fn FROM b),
p AS (SELECT *, coalesce(100.0 * tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(100.0 * tp / nullif(tp + fn, 0), 0.0) AS r FROM c)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM p""")
def prf_percent(s: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the ends as a detector."""
    return metrics.prf_percent(_guessed(s, d), F.col("truth"), F.col("guess"))


_TYPE = "t AS (SELECT c.citation_id, c.type AS truth, CASE WHEN c.venue LIKE '%Proceedings%' THEN 'proceedings-article' WHEN c.venue LIKE 'Working%' THEN 'posted-content' ELSE 'journal-article' END AS guess FROM citations c)"


def _typed(s: SparkSession, d: str) -> DataFrame:
    v = F.coalesce("venue", F.lit(""))
    g = F.when(v.contains("Proceedings"), "proceedings-article").when(v.startswith("Working"), "posted-content").otherwise("journal-article")
    return load(s, d, "citations").select("citation_id", F.col("type").alias("truth"), g.alias("guess"))


@query(f"""WITH {_TYPE}, l AS (SELECT truth AS c FROM t UNION SELECT guess FROM t),
g AS (SELECT l.c, count_if(t.truth = l.c) AS nt, count_if(t.guess = l.c) AS np, count_if(t.truth = l.c AND t.guess = l.c) AS h FROM l, t GROUP BY l.c),
p AS (SELECT coalesce(h / nullif(np, 0), 0.0) AS p, coalesce(h / nullif(nt, 0), 0.0) AS r FROM g)
SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0.0)), 6) AS f1 FROM p""")
def macro_prf(s: SparkSession, d: str) -> DataFrame:
    """Macro metrics of the venue as a guess at the type."""
    return metrics.macro_prf(_typed(s, d), "truth", "guess")


@query(f"WITH {_TYPE} SELECT round(avg((truth = guess)::INT), 6) AS accuracy FROM t")
def accuracy(s: SparkSession, d: str) -> DataFrame:
    """Share of right guesses."""
    return metrics.accuracy(_typed(s, d), "truth", "guess")


@query(f"WITH {_TYPE} SELECT truth, guess, count(*) AS n FROM t GROUP BY ALL")
def confusion_long(s: SparkSession, d: str) -> DataFrame:
    """Confusion matrix, long."""
    return metrics.confusion(_typed(s, d), "truth", "guess")


_COS = """u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT a.vec_id AS q, b.vec_id AS key, a.label AS la, b.label AS lb, list_cosine_similarity(a.v, b.v) AS cos FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(cos, 12) DESC, key) AS rank FROM c)"""


def _top(s: SparkSession, d: str, k: int) -> DataFrame:
    e = load(s, d, "embeddings").select("vec_id", "embedding")
    return search(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", k=k)


@query(f"""WITH {_COS}, h AS (SELECT q, rank, (la = lb)::INT AS hit FROM k WHERE rank <= 5), f AS (SELECT *, sum(hit) OVER (PARTITION BY q ORDER BY rank) AS found FROM h)
SELECT q, round(coalesce(sum(CASE WHEN hit = 1 THEN found / rank END) / nullif(sum(hit), 0), 0.0), 6) AS ap FROM f GROUP BY q""")
def map_at_k(s: SparkSession, d: str) -> DataFrame:
    """Average precision of the five nearest vectors, relevant being those of the same label."""
    l = load(s, d, "embeddings").select("vec_id", "label")
    t = _top(s, d, 5).join(l.select(F.col("vec_id").alias("q"), F.col("label").alias("la")), "q").join(l.select(F.col("vec_id").alias("key"), F.col("label").alias("lb")), "key")
    return metrics.average_precision(t.select("q", "rank", (F.col("la") == F.col("lb")).cast("int").alias("hit")), 5)


@query("""WITH m AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey), e AS (SELECT (o_totalprice - m) / 100000 AS e FROM orders JOIN m USING (o_custkey))
SELECT round(avg(e * e), 6) AS mse, round(avg(CASE WHEN abs(e) < 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END), 6) AS huber, round(avg(abs(e) + ln(1 + exp(-2 * abs(e))) - ln(2.0)), 6) AS logcosh FROM e""")
def loss_mse_huber_logcosh(s: SparkSession, d: str) -> DataFrame:
    """Losses of a customer's mean order as its prediction."""
    o = load(s, d, "orders").select("o_custkey", "o_totalprice")
    m = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    return metrics.losses(o.join(m, "o_custkey"), (F.col("o_totalprice") - F.col("m")) / 100000)


@query("""WITH x AS (SELECT event_id, [value, value / 2, 1.0] AS z, (event_id % 3)::INT AS y FROM events), m AS (SELECT *, list_max(z) AS mx FROM x),
l AS (SELECT event_id, y, z[y + 1] - mx - ln(exp(z[1] - mx) + exp(z[2] - mx) + exp(z[3] - mx)) AS lp FROM m)
SELECT y, round(avg(-(CASE WHEN y = 0 THEN 0.25 ELSE 0.75 END) * pow(1 - exp(lp), 2) * lp), 4) AS focal FROM l GROUP BY y""")
def focal_loss(s: SparkSession, d: str) -> DataFrame:
    """Focal loss by class over logits made of an event's value."""
    x = load(s, d, "events").select(F.array(F.col("value"), F.col("value") / 2, F.lit(1.0)).alias("z"), (F.col("event_id") % 3).cast("int").alias("y"))
    return metrics.focal_loss(x, "z", "y", alpha=0.25).groupBy("y").agg(F.round(F.avg("focal"), 4).alias("focal"))


# ---- vectors and graph ------------------------------------------------------------------------


@query(f"WITH {_COS} SELECT q, key, rank, round(cos, 6) AS cos FROM k WHERE rank <= 5")
def cosine_topk(s: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 20."""
    return _top(s, d, 5).select("q", "key", "rank", F.round("cos", 6).alias("cos"))


@query(f"WITH {_COS} SELECT q, key, round(cos, 6) AS cos FROM c WHERE cos >= 0.35")
def cosine_pairs_over_t(s: SparkSession, d: str) -> DataFrame:
    """All vectors at 0.35 or above for every vector whose id is divisible by 20."""
    e = load(s, d, "embeddings").select("vec_id", "embedding")
    return search(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", threshold=0.35).select("q", "key", F.round("cos", 6).alias("cos"))


def _template_words(s: SparkSession, d: str) -> DataFrame:
    t = load(s, d, "event_templates")
    w = F.filter(F.split(F.lower(F.regexp_replace("EventTemplate", "<[^<>]*>", "")), r"[^\p{L}]+"), lambda x: x != "")
    return t.select(F.substring("EventId", 2, 10).cast("bigint").alias("id"), w.alias("words")).where(F.size("words") > 0)


_TW = "tw AS (SELECT substr(EventId, 2)::BIGINT AS id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(EventTemplate, '<[^<>]*>', '', 'g')), '[^a-z]+'), lambda x: x <> '')) AS w FROM event_templates), tc AS (SELECT id, w, count(*) AS c FROM tw GROUP BY ALL), tn AS (SELECT id, sqrt(sum(c * c)) AS nm FROM tc GROUP BY id)"


@query(f"WITH {_TW} SELECT a.id AS a, b.id AS b, round(sum(a.c * b.c) / max(x.nm) / max(y.nm), 6) AS cos FROM tc a JOIN tc b ON a.w = b.w AND a.id < b.id JOIN tn x ON x.id = a.id JOIN tn y ON y.id = b.id GROUP BY a.id, b.id HAVING sum(a.c * b.c) / max(x.nm) / max(y.nm) >= 0.8 - 1e-12")
def template_pairs(s: SparkSession, d: str) -> DataFrame:
    """Templates whose words have a cosine of 0.8 or more."""
    return graph.bag_cosine_pairs(_template_words(s, d), 0.8).select("a", "b", F.round("cos", 6).alias("cos"))


_ALIGN = "STRUCT(id BIGINT, nb BIGINT[], reps BIGINT[], o STRUCT(rep BIGINT, member BIGINT)[])"
_FIRST = "list_min(list_filter(x.nb, lambda n: list_contains(a.reps, n)))"


@query(f"""WITH {_TW}, pr AS (SELECT a.id AS a, b.id AS b FROM tc a JOIN tc b ON a.w = b.w AND a.id < b.id JOIN tn x ON x.id = a.id JOIN tn y ON y.id = b.id GROUP BY a.id, b.id HAVING sum(a.c * b.c) / max(x.nm) / max(y.nm) >= 0.8 - 1e-12),
nd AS (SELECT tn.id, coalesce(list(pr.a) FILTER (WHERE pr.a IS NOT NULL), []) AS nb FROM tn LEFT JOIN pr ON pr.b = tn.id GROUP BY tn.id), el AS (SELECT list({{'id': id, 'nb': nb, 'reps': [], 'o': []}}::{_ALIGN} ORDER BY id) AS l FROM nd),
rd AS (SELECT list_reduce(l, lambda a, x: {{'id': x.id, 'nb': x.nb, 'reps': CASE WHEN {_FIRST} IS NULL THEN list_append(a.reps, x.id) ELSE a.reps END, 'o': list_append(a.o, {{'rep': coalesce({_FIRST}, x.id), 'member': x.id}})}}, {{'id': 0, 'nb': [], 'reps': [], 'o': []}}::{_ALIGN}) AS r FROM el)
SELECT z.rep, z.member FROM (SELECT unnest(r.o) AS z FROM rd)""")
def greedy_align(s: SparkSession, d: str) -> DataFrame:
    """Representatives of the templates by the greedy rule."""
    w = _template_words(s, d)
    return graph.greedy_align(w.select("id"), graph.bag_cosine_pairs(w, 0.8))


_KG = "se AS (SELECT DISTINCT sid, unnest(event_ids) AS e FROM bgl_sessions), kg AS (SELECT a.e AS src, b.e AS dst, count(*) AS n FROM se a JOIN se b ON a.sid = b.sid AND a.e < b.e GROUP BY ALL)"


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrence(load(s, d, "bgl_sessions").select("sid", F.explode("event_ids").alias("e")), "sid", "e")


@query(f"WITH {_KG} SELECT * FROM kg")
def kg_edges(s: SparkSession, d: str) -> DataFrame:
    """Events that occur in one session."""
    return _edges(s, d)


@query(f"WITH {_KG} SELECT node, count(*) AS degree, sum(n)::BIGINT AS weight FROM (SELECT src AS node, n FROM kg UNION ALL SELECT dst, n FROM kg) GROUP BY node")
def kg_degree(s: SparkSession, d: str) -> DataFrame:
    """Degree and weight of each event."""
    return graph.degree(_edges(s, d))


@query(f"""WITH RECURSIVE {_KG}, ed AS (SELECT src, dst FROM kg WHERE n >= 3 UNION SELECT dst, src FROM kg WHERE n >= 3),
r AS (SELECT 'E1' AS node, 0 AS hops UNION SELECT ed.dst, r.hops + 1 FROM r JOIN ed ON ed.src = r.node WHERE r.hops < 4) SELECT node, min(hops)::INT AS hops FROM r GROUP BY node""")
def kg_paths(s: SparkSession, d: str) -> DataFrame:
    """Events within four steps of one, over edges of weight three and more."""
    return graph.reach(_edges(s, d).where("n >= 3"), s.createDataFrame([("E1",)], "node string"), 4)


@query("""SELECT doc_id, 'Find the root cause of this failure.' || chr(10) || 'Failure: ' || coalesce(text, '') || chr(10) || 'Related entities:' || chr(10) || coalesce(incident_key, '') || chr(10) || 'Answer with the root cause and with knowledge triples (head, relation, tail).' AS prompt FROM documents""")
def prompt_text(s: SparkSession, d: str) -> DataFrame:
    """Prompts with their summary and entities filled in."""
    return graph.prompt(load(s, d, "documents").select("doc_id", "text", F.array("incident_key").alias("e")), "text", "e").select("doc_id", "prompt")


@query()
def template_miner(s: SparkSession, d: str) -> DataFrame:
    """Templates of the log lines' content, mined file by file."""
    return templates.mine(load(s, d, "log_lines"), "Logrecord", "LineId", "Content")


# ---- text and citations -----------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _norm_sql(c: str) -> str:
    e = f"strip_accents({c})"
    for p, r in ((r"\$[^$]*\$", ""), (r"\\[A-Za-z]+\{([^{}]*)\}", r"\1"), (r"\\[A-Za-z]+", "")):
        e = f"regexp_replace({e}, '{p}', '{r}', 'g')"
    e = f"lower({e})"
    for b in T.EDITION_OF:
        e = rf"regexp_replace({e}, '(^|\s)({b})\s+(edition|ed\.)(\s|$)', ' ', 'g')"
    e = rf"regexp_replace({e}, '(^|\s)rev\.?\s+ed\.?(\s|$)', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({e}, '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: list_contains(" + _STOP + ", x)))::INT AS n_stop FROM documents WHERE text IS NOT NULL")
def stopword_counts(s: SparkSession, d: str) -> DataFrame:
    """Stopwords in each document."""
    stop = F.array(*[F.lit(w) for w in T.STOPWORDS])
    return load(s, d, "documents").where("text is not null").select("doc_id", F.size(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.array_contains(stop, x))).alias("n_stop"))


@query(f"SELECT citation_id, {_norm_sql('title')} AS norm FROM citations")
def title_normalised(s: SparkSession, d: str) -> DataFrame:
    """Normal form of every title."""
    return load(s, d, "citations").select("citation_id", T.normalise_title(F.col("title")).alias("norm"))


_REC = """rec AS (SELECT response_id, citation_id, json_extract_string(body, '$.message.title[0]') AS ct FROM api_responses WHERE status_code = 200 AND citation_id IS NOT NULL AND json_valid(body))"""

_SCORED = f"""pr AS (SELECT r.response_id, c.citation_id, {_norm_sql('c.title')} AS en, {_norm_sql('r.ct')} AS cn FROM rec r JOIN citations c USING (citation_id) WHERE c.title IS NOT NULL AND r.ct IS NOT NULL),
tk AS (SELECT *, list_filter(string_split(en, ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x)) AS ew, list_filter(string_split(cn, ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x)) AS cw FROM pr),
it AS (SELECT *, len(ew) AS e, len(cw) AS c, list_sum([0] || list_transform(list_distinct(ew), lambda x: least(len(list_filter(ew, lambda y: y = x)), len(list_filter(cw, lambda y: y = x)))))::INT AS inter FROM tk),
sc AS (SELECT *, CASE WHEN en = cn AND en <> '' THEN 1.0 WHEN e < 3 OR c = 0 OR inter = 0 THEN 0.0 ELSE round(2.0 * (inter / c) * (inter / e) / (inter / c + inter / e), 6) END AS f1, round(coalesce(inter / nullif(least(e, c), 0), 0.0), 2) AS containment FROM it)"""
_PAIR = f"{_REC},\n{_SCORED}"

#: As _PAIR, over the first work of every readable answer instead.
_WORKS_PAIR = f"{first_titles_sql()}, rec AS (SELECT response_id, citation_id, title AS ct FROM ft JOIN api_responses USING (response_id) WHERE citation_id IS NOT NULL),\n{_SCORED}"


def _compared(s: SparkSession, d: str) -> DataFrame:
    r = load(s, d, "api_responses").where("status_code = 200 and citation_id is not null").select("response_id", "citation_id", F.try_variant_get(F.try_parse_json("body"), "$.message.title[0]", "string").alias("ct")).where("ct is not null")
    return _scored(s, d, r)


def _scored(s: SparkSession, d: str, r: DataFrame) -> DataFrame:
    c = load(s, d, "citations").where("title is not null").select("citation_id", "title")
    return match.title_match(r.join(c, "citation_id"), "title", "ct")


def _works_compared(s: SparkSession, d: str) -> DataFrame:
    r = nested.first_titles(load(s, d, "api_responses").where("citation_id is not null"), ["citation_id"])
    return _scored(s, d, r.withColumnRenamed("title", "ct"))


@query(f"WITH {_PAIR} SELECT response_id, citation_id, e::INT AS e, c::INT AS c, inter, f1::DOUBLE AS f1, containment FROM sc")
def token_multiset_f1(s: SparkSession, d: str) -> DataFrame:
    """Multiset F1 of a citation's title and the record looked up for it."""
    return _compared(s, d).select("response_id", "citation_id", "e", "c", "inter", "f1", "containment")


@query(f"WITH {_PAIR} SELECT response_id, citation_id, CASE WHEN en = cn AND en <> '' THEN 'EXACT' WHEN e < 3 OR c = 0 THEN 'INSUFFICIENT' WHEN f1 >= 0.85 THEN 'STRONG_MATCH' WHEN f1 >= 0.70 THEN 'MATCH' WHEN f1 >= 0.40 THEN 'WEAK_MATCH' ELSE 'MISMATCH' END AS verdict FROM sc")
def title_verdict(s: SparkSession, d: str) -> DataFrame:
    """Verdict on each looked-up title."""
    return _compared(s, d).select("response_id", "citation_id", "verdict")


@query(f"WITH {_PAIR} SELECT response_id, citation_id, f1 >= 0.60 AND f1 < 0.70 AND containment >= 0.90 AS advisory FROM sc")
def containment_advisory(s: SparkSession, d: str) -> DataFrame:
    """Advisory where the shorter title lies in the longer."""
    return match.containment_advisory(_compared(s, d)).select("response_id", "citation_id", "advisory")


@query(f"WITH {_WORKS_PAIR} SELECT response_id, citation_id, e::INT AS e, c::INT AS c, inter, f1::DOUBLE AS f1, containment FROM sc")
def works_token_multiset_f1(s: SparkSession, d: str) -> DataFrame:
    """Multiset F1 of a citation's title and the first work of every readable answer for it."""
    return _works_compared(s, d).select("response_id", "citation_id", "e", "c", "inter", "f1", "containment")


@query(f"WITH {_WORKS_PAIR} SELECT response_id, citation_id, CASE WHEN en = cn AND en <> '' THEN 'EXACT' WHEN e < 3 OR c = 0 THEN 'INSUFFICIENT' WHEN f1 >= 0.85 THEN 'STRONG_MATCH' WHEN f1 >= 0.70 THEN 'MATCH' WHEN f1 >= 0.40 THEN 'WEAK_MATCH' ELSE 'MISMATCH' END AS verdict FROM sc")
def works_title_verdict(s: SparkSession, d: str) -> DataFrame:
    """Verdict on the first work of every readable answer."""
    return _works_compared(s, d).select("response_id", "citation_id", "verdict")


@query(f"WITH {_WORKS_PAIR} SELECT response_id, citation_id, f1 >= 0.60 AND f1 < 0.70 AND containment >= 0.90 AS advisory FROM sc")
def works_containment_advisory(s: SparkSession, d: str) -> DataFrame:
    """Advisory where the shorter title lies in the longer, over the first work of every readable answer."""
    return match.containment_advisory(_works_compared(s, d)).select("response_id", "citation_id", "advisory")


@query(r"""SELECT citation_id, nullif(regexp_replace(regexp_extract(raw, '10\.[0-9]+/[A-Za-z0-9._:;()/-]+'), '[.,;:)\]]+$', ''), '') AS doi,
coalesce(nullif(regexp_extract(raw, '\(((?:18|19|20)[0-9]{2})[a-z]?\)', 1), ''), nullif(regexp_extract(raw, '(?:^|[^0-9A-Za-z.])((?:18|19|20)[0-9]{2})(?:[^0-9A-Za-z]|$)', 1), ''))::INT AS year,
nullif(regexp_extract(raw, '(?:^|[^0-9./])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:[^0-9]|$)', 1), '') AS arxiv_id FROM citations""")
def citation_fields(s: SparkSession, d: str) -> DataFrame:
    """DOI, year and arXiv number of raw citations."""
    r = F.col("raw")
    return load(s, d, "citations").select("citation_id", T.extract_doi(r).alias("doi"), T.extract_year(r).alias("year"), T.extract_arxiv(r).alias("arxiv_id"))


@query()
def citation_parsed(s: SparkSession, d: str) -> DataFrame:
    """All fields of raw citations by the text rules, over the whole texts."""
    r = T.squeeze(F.col("raw"))
    return load(s, d, "citations").select("citation_id", T.extract_surnames(r, None, None).alias("authors"), T.extract_year(r).alias("year"), T.extract_title(r, None).alias("title"), T.extract_doi(r).alias("doi"), T.extract_nber(r).alias("nber_number"), T.extract_arxiv(r).alias("arxiv_id"))


@query(r"SELECT citation_id, coalesce(regexp_full_match(doi, '10\.[0-9]+/[A-Za-z0-9._:;()/-]+') AND length(doi) <= 500 AND NOT contains(doi, '..'), false) AS valid FROM citations")
def doi_valid(s: SparkSession, d: str) -> DataFrame:
    """Whether each DOI is a plain one."""
    return load(s, d, "citations").select("citation_id", T.doi_valid(F.col("doi")).alias("valid"))


@query("SELECT citation_id, CASE WHEN regexp_full_match(regexp_replace(nber_number, '^[wW]', ''), '[0-9]{1,7}') THEN '10.3386/w' || regexp_replace(nber_number, '^[wW]', '') END AS doi FROM citations WHERE nber_number IS NOT NULL")
def nber_to_doi(s: SparkSession, d: str) -> DataFrame:
    """DOIs of working-paper numbers."""
    return load(s, d, "citations").where("nber_number is not null").select("citation_id", T.nber_doi(F.col("nber_number")).alias("doi"))


_ROUTE = "CASE WHEN length(doi) > 0 THEN 'doi' WHEN length(nber_number) > 0 THEN 'nber' WHEN length(title) >= 10 THEN 'search' ELSE 'insufficient_data' END"


@query(f"SELECT citation_id, {_ROUTE} AS route FROM citations")
def lookup_route(s: SparkSession, d: str) -> DataFrame:
    """How each citation is looked up."""
    return load(s, d, "citations").select("citation_id", T.lookup_route(F.col("doi"), F.col("nber_number"), F.col("title")).alias("route"))


_STATUS = f"""vd AS (SELECT citation_id, CASE max(CASE WHEN (en = cn AND en <> '') OR (f1 >= 0.70 AND e >= 3 AND c > 0) THEN 4 WHEN e < 3 OR c = 0 THEN 1 WHEN f1 >= 0.40 THEN 3 ELSE 2 END) WHEN 4 THEN 'MATCH' WHEN 3 THEN 'WEAK_MATCH' WHEN 2 THEN 'MISMATCH' ELSE 'INSUFFICIENT' END AS v FROM sc GROUP BY citation_id),
st AS (SELECT c.citation_id, CASE WHEN {_ROUTE} = 'insufficient_data' THEN 'NEEDS_MANUAL_VERIFICATION' WHEN v IS NULL THEN 'NOT_FOUND' WHEN v = 'MATCH' THEN 'VERIFIED' WHEN v = 'WEAK_MATCH' THEN 'PARTIAL_MATCH' WHEN v = 'MISMATCH' AND {_ROUTE} IN ('doi', 'nber') THEN 'METADATA_MISMATCH' WHEN v = 'MISMATCH' THEN 'NOT_FOUND' ELSE 'NEEDS_MANUAL_VERIFICATION' END AS status FROM citations c LEFT JOIN vd USING (citation_id))"""
_VERD = f"{_PAIR}, {_STATUS}"
_WORKS_VERD = f"{_WORKS_PAIR}, {_STATUS}"


def _verdicts(s: SparkSession, d: str, compared: DataFrame) -> DataFrame:
    rank = F.when(F.col("verdict").isin("EXACT", "STRONG_MATCH", "MATCH"), 4).when(F.col("verdict") == "WEAK_MATCH", 3).when(F.col("verdict") == "MISMATCH", 2).otherwise(1)
    best = compared.groupBy("citation_id").agg(F.max(rank).alias("k"))
    c = load(s, d, "citations").select("citation_id", "raw", T.lookup_route(F.col("doi"), F.col("nber_number"), F.col("title")).alias("lookup_mode")).join(best, "citation_id", "left")
    v = F.when(F.col("k") == 4, "MATCH").when(F.col("k") == 3, "WEAK_MATCH").when(F.col("k") == 2, "MISMATCH").when(F.col("k") == 1, "INSUFFICIENT")
    return c.select(F.col("citation_id").alias("index"), "raw", "lookup_mode", match.status_of(v, F.col("lookup_mode"), F.col("k").isNotNull()).alias("status"))


@query(f"WITH {_VERD} SELECT citation_id, status FROM st")
def verdict_case(s: SparkSession, d: str) -> DataFrame:
    """Status of each citation against the records looked up for it."""
    return _verdicts(s, d, _compared(s, d)).select(F.col("index").alias("citation_id"), "status")


@query(f"WITH {_VERD} SELECT v.status, count(st.status) AS n FROM (VALUES ('VERIFIED'), ('PARTIAL_MATCH'), ('METADATA_MISMATCH'), ('NOT_FOUND'), ('NEEDS_MANUAL_VERIFICATION')) v(status) LEFT JOIN st USING (status) GROUP BY v.status")
def status_counts(s: SparkSession, d: str) -> DataFrame:
    """Citations by status."""
    return match.status_counts(_verdicts(s, d, _compared(s, d)))


@query(f"WITH {_WORKS_VERD} SELECT citation_id, status FROM st")
def works_verdict_case(s: SparkSession, d: str) -> DataFrame:
    """Status of each citation against the first work of every readable answer for it."""
    return _verdicts(s, d, _works_compared(s, d)).select(F.col("index").alias("citation_id"), "status")


@query(f"WITH {_WORKS_VERD} SELECT v.status, count(st.status) AS n FROM (VALUES ('VERIFIED'), ('PARTIAL_MATCH'), ('METADATA_MISMATCH'), ('NOT_FOUND'), ('NEEDS_MANUAL_VERIFICATION')) v(status) LEFT JOIN st USING (status) GROUP BY v.status")
def works_status_counts(s: SparkSession, d: str) -> DataFrame:
    """Citations by status, against the first work of every readable answer."""
    return match.status_counts(_verdicts(s, d, _works_compared(s, d)))


@query("SELECT coalesce(doi, raw) AS key, count(*) AS n FROM citations GROUP BY 1 HAVING count(*) > 1 AND coalesce(doi, raw) IS NOT NULL")
def duplicate_keys(s: SparkSession, d: str) -> DataFrame:
    """Keys that occur more than once."""
    return match.duplicate_keys(load(s, d, "citations"))


@query("SELECT coalesce(c.citation_id, a.citation_id) AS citation_id, c.citation_id IS NULL AS unexpected, a.citation_id IS NULL AS missing, coalesce(a.n, 0) AS answers FROM citations c FULL OUTER JOIN (SELECT citation_id, count(*) AS n FROM api_responses WHERE citation_id IS NOT NULL GROUP BY 1) a USING (citation_id)")
def expected_vs_actual(s: SparkSession, d: str) -> DataFrame:
    """Citations against the answers that came for them."""
    a = load(s, d, "api_responses").where("citation_id is not null").groupBy("citation_id").agg(F.count("*").alias("n")).withColumn("in_a", F.lit(True))
    c = load(s, d, "citations").select("citation_id", F.lit(True).alias("in_c"))
    return c.join(a, "citation_id", "full").select("citation_id", F.col("in_c").isNull().alias("unexpected"), F.col("in_a").isNull().alias("missing"), F.coalesce("n", F.lit(0)).alias("answers"))


@query("SELECT citation_id, 'sha256:' || sha256(raw) AS citation_hash FROM citations")
def sha_audit(s: SparkSession, d: str) -> DataFrame:
    """Hashes of the audit log."""
    return load(s, d, "citations").select("citation_id", F.concat(F.lit("sha256:"), F.sha2("raw", 256)).alias("citation_hash"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def nested_projection(s: SparkSession, d: str) -> DataFrame:
    """A field of nested properties."""
    return load(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


_MARKS = [(1, "yes", "part", "no"), (2, "part", "part", "yes"), (3, "yes", "no", "no"), (4, "yes", "yes", "part")]


@query("WITH m(paper, t1, t2, t3) AS (VALUES " + ", ".join(map(str, _MARKS)) + ") SELECT topic, count_if(mark = 'yes')::BIGINT AS full_marks, count_if(mark = 'part')::BIGINT AS part_marks, round(count_if(mark <> 'no') / count(*), 6) AS coverage FROM (UNPIVOT m ON t1, t2, t3 INTO NAME topic VALUE mark) GROUP BY topic")
def coverage_unpivot(s: SparkSession, d: str) -> DataFrame:
    """Coverage by topic of an evidence matrix."""
    m = s.createDataFrame(_MARKS, "paper int, t1 string, t2 string, t3 string").unpivot("paper", ["t1", "t2", "t3"], "topic", "mark")
    return m.groupBy("topic").agg(F.count_if(F.col("mark") == "yes").alias("full_marks"), F.count_if(F.col("mark") == "part").alias("part_marks"), F.round(F.count_if(F.col("mark") != "no") / F.count("*"), 6).alias("coverage"))


@query(r"SELECT citation_id, CASE WHEN regexp_extract(raw, '^\s*(\S)', 1) = '@' THEN 'bibtex' WHEN regexp_extract(raw, '^\s*(\S)', 1) = '{' THEN 'json' ELSE 'text' END AS kind, '@' || type || '{' || entry_key || '}' AS synthetic FROM citations")
def input_kinds(s: SparkSession, d: str) -> DataFrame:
    """Kind of each raw citation, and the text that stands in where there is none."""
    return load(s, d, "citations").select("citation_id", small.input_kind(F.lit(""), F.col("raw")).alias("kind"), small.synthetic_raw(F.col("type"), F.col("entry_key")).alias("synthetic"))


@query("SELECT citation_id, list_aggregate(list_sort(list_transform(authors, lambda a: lower(trim(string_split(a, ',')[1])))), 'string_agg', '|') AS surnames FROM citations WHERE len(authors) > 0")
def surname_keys(s: SparkSession, d: str) -> DataFrame:
    """Author keys for comparing records."""
    return load(s, d, "citations").where(F.size("authors") > 0).select("citation_id", F.array_join(small.surname_key(F.col("authors")), "|").alias("surnames"))


@query("SELECT count(*) AS n_lines, max(length(l)) AS longest, (SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_split_to_array(l, ' +')) AS w FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE w <> '') AS vocabulary FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)")
def line_stats(s: SparkSession, d: str) -> DataFrame:
    """Lines, longest line and vocabulary of the documents."""
    return small.line_stats(load(s, d, "documents"), "text")


@query("SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source")
def source_histogram(s: SparkSession, d: str) -> DataFrame:
    """Documents by source with their shares."""
    return small.histogram_share(load(s, d, "documents"), "source")


@query("SELECT event_id, user_id FROM events ORDER BY md5(event_id::VARCHAR || ':42'), event_id LIMIT 2048")
def replay_sample(s: SparkSession, d: str) -> DataFrame:
    """2,048 events without replacement: the sample is the feature."""
    return small.replay_sample(load(s, d, "events").select("event_id", "user_id"), "event_id", 2048)


@query("SELECT state, count(*) AS n FROM (SELECT event_id % 7 AS state FROM events) GROUP BY state")
def one_hot_sums(s: SparkSession, d: str) -> DataFrame:
    """One-hot vectors summed by position."""
    v = load(s, d, "events").select(F.posexplode(small.one_hot((F.col("event_id") % 7).cast("int"), 7)).alias("state", "x"))
    return v.groupBy(F.col("state").cast("bigint").alias("state")).agg(F.sum("x").cast("bigint").alias("n"))


# ---- time -------------------------------------------------------------------------------------


@query("SELECT date_trunc('minute', ts) AS bin, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM events GROUP BY 1")
def minute_bins(s: SparkSession, d: str) -> DataFrame:
    """Events by minute."""
    return temporal.bins(load(s, d, "events"), "ts", "event_type")


@query("WITH b AS (SELECT date_trunc('hour', ts) AS bin, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM events GROUP BY 1), e AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), INTERVAL 1 HOUR)) AS bin) SELECT bin, coalesce(n, 0) AS n, coalesce(items, '') AS items FROM e LEFT JOIN b USING (bin)")
def hour_bins_filled(s: SparkSession, d: str) -> DataFrame:
    """Events by hour, empty hours included."""
    return temporal.bins(load(s, d, "events"), "ts", "event_type", "hour", fill=True)


@query("SELECT a.event_type AS cause, b.event_type AS effect, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts < b.ts GROUP BY ALL")
def causal_pairs(s: SparkSession, d: str) -> DataFrame:
    """How often one kind of event comes before another for a user."""
    return temporal.ordered_pair_counts(load(s, d, "events").select("user_id", "ts", "event_type"), "user_id", "ts", "event_type")


@query("SELECT a.user_id AS entity, a.event_id AS cause_id, b.event_id AS effect_id, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 3) AS gap_s FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' AND a.ts < b.ts AND b.ts - a.ts <= INTERVAL 1 HOUR")
def cause_within_t(s: SparkSession, d: str) -> DataFrame:
    """Clicks at most an hour before an error of the same user."""
    return temporal.within(load(s, d, "events"), "user_id", "ts", "event_id", "event_type", "click", "error", 3600)


@query("SELECT user_id AS entity, date_trunc('minute', ts) AS at, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 1")
def same_instant_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Minutes in which a user has several kinds of event."""
    return temporal.conflicts(load(s, d, "events"), "user_id", "ts", "event_type")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def ring_buffer_last_n(s: SparkSession, d: str) -> DataFrame:
    """The last 1,000 events."""
    return temporal.last_n(load(s, d, "events"), ["ts", "event_id"], 1000).select("event_id", "ts")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts by a stream over what is there; equal to the batch."""
    st = streaming.event_stream(s, f"{d}/events.parque[t]", load(s, d, "events").schema)
    out = streaming.run_to_end(streaming.windowed_counts(st, "ts", "event_type"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id::VARCHAR AS entity, unnest(range(0, count(*) // 20)) AS session, 20 AS rows FROM events GROUP BY user_id")
def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    """Full sessions of 20 events a user, by a stateful stream."""
    st = streaming.event_stream(s, f"{d}/events.parque[t]", load(s, d, "events").schema)
    return streaming.run_to_end(streaming.count_sessions(st, "user_id", "ts"))


@query()
def document_clusters(s: SparkSession, d: str) -> DataFrame:
    """k-means over the vectors, sizes by cluster and label."""
    return learning.clusters(load(s, d, "embeddings"), "embedding", 8).groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query()
def document_entities(s: SparkSession, d: str) -> DataFrame:
    """Names in each document."""
    return learning.entities(load(s, d, "documents").where("text is not null").select("doc_id", "text"), "text").select("doc_id", "entities")


