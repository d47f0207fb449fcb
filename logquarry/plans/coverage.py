"""Further queries: readers and writers there and back, filters, joins of two tables, text rules, learned parts, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import text as T
from logquarry.operators import graph, match, metrics, sessions, small, temporal, templates, value
from logquarry.plans import learning
from logquarry.plans.catalog import _KG, _LI, _POS, _TW, _TYPE, _WORKS_VERD, _edges, _line_transitions, _template_words, _typed, _verdicts, _works_compared, query
from logquarry.session import delete_at_exit, load, shared_dir
from logquarry.sources import bibtex, logs, sinks


def _folder(s: SparkSession) -> str:
    """A folder for what a query writes and reads again, deleted when the driver ends."""
    path = f"{shared_dir(s).rstrip('/')}/logquarry-out-{uuid.uuid4().hex}"
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(s._jsc.hadoopConfiguration()).mkdirs(p)
    delete_at_exit(s, path)
    return path


# ---- readers and writers ----------------------------------------------------------------------


@query("""WITH l AS (SELECT *, Label || ' ' || Date || '  ' || Time || ' [' || EventId || '] ' || NodeRepeat AS line FROM bgl_log)
SELECT Date AS file, row_number() OVER (PARTITION BY Date ORDER BY idx) AS LineId, Label, Time, EventId, NodeRepeat AS Node FROM l WHERE line IS NOT NULL""")
def log_scan(s: SparkSession, d: str) -> DataFrame:
    """Log lines read by their format; fitting lines are numbered in their file, those without a node do not fit."""
    line = F.concat("Label", F.lit(" "), "Date", F.lit("  "), "Time", F.lit(" ["), "EventId", F.lit("] "), "NodeRepeat")
    lines = load(s, d, "bgl_log").select(F.col("Date").alias("file"), F.col("idx").alias("line_no"), F.coalesce(line, F.lit("cut off")).alias("value"))
    return logs.scan_log(lines, r"<Label> <Date> <Time> \[<EventId>\] <Node>", line_id="LineId").select("file", "LineId", "Label", "Time", "EventId", "Node")


@query("SELECT list_aggregate(list_transform(event_ids, lambda x: substr(x, 2)), 'string_agg', ' ') AS ids, count(*) AS n FROM bgl_sessions WHERE len(event_ids) > 0 GROUP BY 1")
def session_text_there_and_back(s: SparkSession, d: str) -> DataFrame:
    """Sessions written as lines of ids and read again."""
    path = _folder(s) + "/text"
    ids = load(s, d, "bgl_sessions").where(F.size("event_ids") > 0).select(F.transform("event_ids", lambda x: F.substring(x, 2, 20).cast("int")).alias("ids"))
    sinks.write_session_text(ids, "ids", path)
    got = logs.scan_sessions(s, path)
    return got.groupBy(F.concat_ws(" ", F.transform("event_ids", lambda x: x.cast("string"))).alias("ids")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(EventId, '') AS EventId, coalesce(EventTemplate, '') AS EventTemplate, count(*) AS n FROM log_lines GROUP BY ALL")
def csv_there_and_back(s: SparkSession, d: str) -> DataFrame:
    """The structured log and its templates as CSV and read again; empty fields stay empty texts."""
    path = _folder(s)
    lines = load(s, d, "log_lines").select("LineId", "EventId", "ParameterList", "EventTemplate")
    sinks.write_structured(lines, lines.groupBy("EventId", "EventTemplate").agg(F.count("*").alias("Occurrences")), path)
    back = logs.scan_csv(s, f"{path}/structured", "LineId bigint, EventId string, ParameterList string, EventTemplate string", lines=False)
    return back.groupBy("EventId", "EventTemplate").agg(F.count("*").alias("n"))


@query("SELECT citation_id, title, year FROM citations")
def json_lines_there_and_back(s: SparkSession, d: str) -> DataFrame:
    """Citations as JSON lines, NULL fields left out, and read again."""
    path = _folder(s) + "/json"
    sinks.write_json(load(s, d, "citations").select("citation_id", "title", "year"), path)
    return logs.scan_json(s, path, "citation_id bigint, title string, year int")


@query("SELECT n_nationkey, n_name FROM nation")
def json_array_there_and_back(s: SparkSession, d: str) -> DataFrame:
    """A JSON array a region, read as one table."""
    path = _folder(s) + "/arrays"
    arrays = load(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    arrays.write.partitionBy("n_regionkey").text(path)
    return logs.scan_json(s, path + "/*", "n_nationkey int, n_name string", lines=False)


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth, paragraph FROM (SELECT doc_id, i, trim(regexp_replace(p[i], '\\s+', ' ', 'g')) AS paragraph FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS p FROM documents))) WHERE length(paragraph) >= 10")
def document_paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the documents, blanks squeezed, short ones left out."""
    from pyspark.sql import Window as W

    p = logs.paragraphs(load(s, d, "documents").select("doc_id", "text"), "text")
    return p.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).alias("nth"), "paragraph")


_FIELD = r"nullif(trim(regexp_replace(regexp_replace(regexp_extract(raw, '(?is)\b{}\s*=\s*(.*?),?\n\s*(?:\w+\s*=|\}}\s*$)', 1), '^\"|\"$', '', 'g'), '[{{}}]', '', 'g')), '')"


def _tidy(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("SELECT citation_id, regexp_extract(raw, '^\\s*@\\s*(\\w+)\\s*\\{\\s*([^,\\s]+)\\s*,', 1) AS type, regexp_extract(raw, '^\\s*@\\s*(\\w+)\\s*\\{\\s*([^,\\s]+)\\s*,', 2) AS entry_key, " + _tidy(_FIELD.format("title")) + " AS title, " + _tidy(_FIELD.format("doi")) + " AS doi, list_aggregate(list_filter(list_transform(regexp_split_to_array(" + _tidy(_FIELD.format("author")) + ", '\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> ''), 'string_agg', '|') AS authors, try_cast(nullif(regexp_extract(" + _FIELD.format("year") + ", '(1[89]|20)\\d\\d'), '') AS INT) AS year FROM citations WHERE ltrim(raw) LIKE '@%'")
def bibtex_records(s: SparkSession, d: str) -> DataFrame:
    """Records of the BibTeX citations."""
    raw = load(s, d, "citations").where(F.ltrim("raw").startswith("@")).select(F.col("citation_id").cast("string").alias("path"), F.col("raw").alias("text"))
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return bibtex.scan_bibtex(raw).select(F.col("path").cast("bigint").alias("citation_id"), "type", "entry_key", tidy(F.col("title")).alias("title"), tidy(F.col("doi")).alias("doi"), F.nullif(F.concat_ws("|", "authors"), F.lit("")).alias("authors"), "year")


@query("SELECT n_nationkey::VARCHAR AS no, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def markdown_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of a Markdown table, its head and rule left out."""
    n = load(s, d, "nation").select(F.format_string("| %s | %s | %s |", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    head = s.createDataFrame([("| no | name | region |",), ("|---|---|---|",), ("text",)], "value string")
    return logs.scan_markdown_table(head.unionByName(n), ["no", "name", "region"])


_SPLIT = "k AS (SELECT DISTINCT sid FROM bgl_sessions), o AS (SELECT sid, row_number() OVER (ORDER BY md5(sid::VARCHAR || ':42'), sid) AS pos, count(*) OVER () AS n FROM k), sp AS (SELECT sid, CASE WHEN pos <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM o)"


@query(f"WITH {_SPLIT} SELECT split || CASE WHEN split = 'train' THEN '' WHEN list_contains(labels, 1) THEN '_abnormal' ELSE '_normal' END AS split, count(*) AS n, sum(len(event_ids))::BIGINT AS events FROM sp JOIN bgl_sessions USING (sid) GROUP BY 1")
def split_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions joined to their split, written one folder a split and read again."""
    b = load(s, d, "bgl_sessions")
    path = _folder(s) + "/splits"
    part = F.when(F.col("split") == "train", "train").when(F.array_contains("labels", 1), "test_abnormal").otherwise("test_normal")
    sinks.write_splits(b.join(sessions.md5_split(b, "sid"), "sid").withColumn("split", part), path)
    return s.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.size("event_ids")).alias("events"))


@query(f"WITH {_KG} SELECT src, dst, n AS weight FROM kg")
def edge_list_there_and_back(s: SparkSession, d: str) -> DataFrame:
    """The graph as an edge list and read again."""
    path = _folder(s) + "/edges"
    sinks.write_edges(_edges(s, d).withColumnRenamed("n", "weight"), path)
    return s.read.text(path).select(F.split("value", " ", 3).alias("p")).select(F.get("p", F.lit(0)).alias("src"), F.get("p", F.lit(1)).alias("dst"), F.get_json_object(F.get("p", F.lit(2)), "$.weight").cast("bigint").alias("weight"))


@query(f"WITH {_LI}, {_POS} SELECT state, round(q, 6) AS q FROM q5")
def session_value_resumed(s: SparkSession, d: str) -> DataFrame:
    """Event values saved after three sweeps, loaded and taken two sweeps further."""
    path = _folder(s) + "/values"
    t = _line_transitions(s, d)
    value.save_values(value.values(t, 3), path)
    return value.values(t, 2, value.load_values(s, path)).select("state", F.round("q", 6).alias("q"))


@query("SELECT citation_id, 'sha256:' || sha256(raw) AS citation_hash, coalesce(type, '') AS status FROM citations WHERE raw IS NOT NULL")
def audit_there_and_back(s: SparkSession, d: str) -> DataFrame:
    """Audit rows appended to a log and read again."""
    path = _folder(s) + "/audit"
    c = load(s, d, "citations").where("raw is not null")
    rows = sinks.audit_rows(c.select("citation_id", "raw", F.coalesce("type", F.lit("")).alias("status"), F.lit("doi").alias("lookup_mode")), keep=["citation_id"])
    sinks.write_json(rows.where("citation_id % 2 = 0"), path, append=True)
    sinks.write_json(rows.where("citation_id % 2 = 1"), path, append=True)
    return logs.scan_json(s, path, "citation_id bigint, citation_hash string, status string, timestamp string").where("timestamp is not null").drop("timestamp")


# ---- filters, unions, comparisons -------------------------------------------------------------


@query("SELECT text AS msg FROM documents WHERE text IS NOT NULL")
def message_records(s: SparkSession, d: str) -> DataFrame:
    """Records that have a message."""
    return logs.messages(load(s, d, "documents").select(F.col("text").alias("message")))


@query("SELECT citation_id FROM citations WHERE year BETWEEN 2010 AND 2016 AND type IN ('journal-article', 'book') AND doi IS NOT NULL")
def literature(s: SparkSession, d: str) -> DataFrame:
    """Citations of the years and kinds asked for that can be read openly."""
    c = load(s, d, "citations").select("citation_id", "year", F.col("type").alias("tier"), F.col("doi").isNotNull().alias("has_code"))
    return small.literature_filter(c, 2010, 2016, ("journal-article", "book")).select("citation_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(0.25 * l_discount + 0.25 * l_tax + 0.30 * l_quantity / 50 - 0.10 * l_discount + 0.10 * l_tax, 6) AS score FROM lineitem")
def weighted_scores(s: SparkSession, d: str) -> DataFrame:
    """A weighted score of each line."""
    li = load(s, d, "lineitem")
    score = small.weighted_score(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))


@query("SELECT 'bgl' AS source, EventId, count(*) AS n FROM bgl_log GROUP BY ALL UNION ALL SELECT 'lines', EventId, count(*) FROM log_lines GROUP BY ALL")
def batch_union(s: SparkSession, d: str) -> DataFrame:
    """Batches of two logs in one table, counted."""
    a = load(s, d, "bgl_log").select(F.lit("bgl").alias("source"), "EventId")
    b = load(s, d, "log_lines").select(F.lit("lines").alias("source"), "EventId")
    return a.unionByName(b).groupBy("source", "EventId").agg(F.count("*").alias("n"))


@query("SELECT source, n, 'a' AS side FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1 EXCEPT ALL SELECT source, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1) UNION ALL SELECT source, n, 'b' FROM (SELECT source, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 EXCEPT ALL SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def tables_differ(s: SparkSession, d: str) -> DataFrame:
    """Rows that one of two results has and the other lacks."""
    docs = load(s, d, "documents")
    per = lambda x: x.groupBy("source").agg(F.count("*").alias("n"))
    return sinks.manifest_differs(per(docs), per(docs.where("lang is not null")))


@query(f"WITH {_TYPE}, l AS (SELECT truth AS c FROM t UNION SELECT guess FROM t), g AS (SELECT l.c, count_if(t.truth = l.c) AS nt, count_if(t.guess = l.c) AS np, count_if(t.truth = l.c AND t.guess = l.c) AS h FROM l, t GROUP BY l.c), p AS (SELECT coalesce(h / nullif(np, 0), 0.0) AS p, coalesce(h / nullif(nt, 0), 0.0) AS r FROM g) SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0.0)), 6) AS f1, (SELECT round(avg((truth = guess)::INT), 6) FROM t) AS accuracy FROM p")
def metric_bundle(s: SparkSession, d: str) -> DataFrame:
    """Macro metrics and accuracy in one row."""
    return metrics.bundle(_typed(s, d), "truth", "guess")


@query("""WITH x AS (SELECT [value, value / 2, 1.0] AS z, (event_id % 3)::INT AS y FROM events), m AS (SELECT *, list_max(z) AS mx FROM x), l AS (SELECT y, z[y + 1] - mx - ln(exp(z[1] - mx) + exp(z[2] - mx) + exp(z[3] - mx)) AS lp FROM m)
SELECT round(sum(-([0.2, 0.3, 0.5][y + 1]) * pow(1 - exp(lp), 2) * lp), 2) AS focal FROM l""")
def focal_loss_weighted(s: SparkSession, d: str) -> DataFrame:
    """Focal loss with a weight for each class, summed."""
    x = load(s, d, "events").select(F.array(F.col("value"), F.col("value") / 2, F.lit(1.0)).alias("z"), (F.col("event_id") % 3).cast("int").alias("y"))
    return metrics.focal_loss(x, "z", "y", alpha=[0.2, 0.3, 0.5]).agg(F.round(F.sum("focal"), 2).alias("focal"))


@query("SELECT count(*) AS n_sessions, count_if(list_contains(labels, 1)) AS n_abnormal, sum(len(event_ids))::BIGINT AS n_events FROM (SELECT DISTINCT sid, event_ids, labels FROM bgl_sessions)")
def session_totals(s: SparkSession, d: str) -> DataFrame:
    """Sessions, abnormal ones and events."""
    b = load(s, d, "bgl_sessions").select("sid", "event_ids", "labels").distinct()
    return b.agg(F.count("*").alias("n_sessions"), F.count_if(F.array_contains("labels", 1)).alias("n_abnormal"), F.sum(F.size("event_ids")).alias("n_events"))


@query("SELECT citation_id FROM citations ORDER BY citation_id LIMIT 60")
def first_citations(s: SparkSession, d: str) -> DataFrame:
    """The first 60 citations of a run: the cap is the feature."""
    return load(s, d, "citations").orderBy("citation_id").limit(60).select("citation_id")


# ---- templates and graph ----------------------------------------------------------------------


@query(f"WITH {_TW}, n AS (SELECT id, count(*) AS k FROM tc GROUP BY id), s AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM tc a JOIN tc b ON a.w = b.w AND a.id <> b.id GROUP BY ALL) SELECT s.a, s.b, shared, shared = x.k AS within, shared >= 0.5 * y.k AS half FROM s JOIN n x ON x.id = s.a JOIN n y ON y.id = s.b")
def template_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Templates that share words: whether all of one lie within the other, and whether they are half of it."""
    return graph.set_overlaps(_template_words(s, d))


@query(f"WITH {_KG}, {_TW}, co AS (SELECT a.id AS a, b.id AS b, sum(a.c * b.c) / max(x.nm) / max(y.nm) AS cos FROM tc a JOIN tc b ON a.w = b.w AND a.id < b.id JOIN tn x ON x.id = a.id JOIN tn y ON y.id = b.id GROUP BY a.id, b.id) SELECT a, b, round(cos, 6) AS weight FROM co JOIN (SELECT DISTINCT least(substr(src, 2)::BIGINT, substr(dst, 2)::BIGINT) AS a, greatest(substr(src, 2)::BIGINT, substr(dst, 2)::BIGINT) AS b FROM kg) USING (a, b) WHERE cos > 0.8 + 1e-12")
def similarity_graph(s: SparkSession, d: str) -> DataFrame:
    """Events that occur together and whose texts have a cosine over 0.8, with it as the weight."""
    number = lambda c: F.substring(c, 2, 20).cast("bigint")
    together = _edges(s, d).select(F.least(number("src"), number("dst")).alias("a"), F.greatest(number("src"), number("dst")).alias("b")).distinct()
    return graph.similarity_edges(together, _template_words(s, d), 0.8).select("a", "b", F.round("weight", 6).alias("weight"))


@query(f"WITH {_KG} SELECT CASE WHEN src = 'E1' THEN dst ELSE src END AS node, n FROM kg WHERE src = 'E1' OR dst = 'E1'")
def kg_direct(s: SparkSession, d: str) -> DataFrame:
    """Events next to one in the graph."""
    return graph.direct(_edges(s, d), "E1")


# ---- text rules -------------------------------------------------------------------------------


@query(r"SELECT LineId, regexp_replace(regexp_replace(coalesce(Content, ''), '\b(?:\d{1,3}\.){3}\d{1,3}\b', '<*>', 'g'), '\b[0-9a-f]{8,}\b', '<*>', 'g') AS masked FROM log_lines")
def masked_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines with addresses and long hexadecimal numbers masked."""
    return load(s, d, "log_lines").select("LineId", templates.masked(F.col("Content"), [templates.MASKS[0], templates.MASKS[2]]).alias("masked"))


@query(r"SELECT citation_id, trim(regexp_replace(regexp_replace(raw, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\s+', ' ', 'g')) AS squeezed, nullif(regexp_extract(raw, '(?:[Nn][Bb][Ee][Rr][^0-9]{0,40}|(?:^|[^A-Za-z0-9_])w)([0-9]{3,7})(?:[^0-9A-Za-z_]|$)', 1), '') AS nber_number FROM citations")
def squeezed_citations(s: SparkSession, d: str) -> DataFrame:
    """Raw citations with blanks squeezed, and the working-paper number in them."""
    return load(s, d, "citations").select("citation_id", T.squeeze(F.col("raw")).alias("squeezed"), T.extract_nber(F.col("raw")).alias("nber_number"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '([\\`*_{}\[\]()#+!|<>~])', '\\\1', 'g'), ' +', ' ', 'g')) AS safe, url_encode(source) AS encoded FROM documents")
def sanitised_documents(s: SparkSession, d: str) -> DataFrame:
    """Texts made harmless for a report, and sources as parts of an address."""
    return load(s, d, "documents").select("doc_id", T.sanitise(F.col("text")).alias("safe"), T.percent_encode(F.col("source")).alias("encoded"))


@query("SELECT citation_id, url_encode(title) AS encoded FROM citations")
def encoded_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles as parts of an address."""
    return load(s, d, "citations").select("citation_id", T.percent_encode(F.col("title")).alias("encoded"))


@query("SELECT LineId, coalesce(try_strptime(Date || ' ' || Time, '%Y-%m-%d %H:%M:%S.%f'), try_strptime(Date || ' ' || Time, '%Y-%m-%d %H:%M:%S')) AS ts FROM log_lines WHERE Date IS NOT NULL")
def line_times(s: SparkSession, d: str) -> DataFrame:
    """Times of the lines from their date and time."""
    t = F.regexp_replace(F.concat_ws(" ", "Date", "Time"), ",(?=[0-9])", ".")
    return load(s, d, "log_lines").where("Date is not null").select("LineId", F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]")).cast("timestamp_ntz").alias("ts"))


@query("SELECT event_id, json_extract_string(m, '$.k') AS k, json_extract_string(m, '$.kind') AS kind FROM (SELECT event_id, json_merge_patch(props, json_object('kind', event_type)) AS m FROM events)")
def merged_objects(s: SparkSession, d: str) -> DataFrame:
    """Properties with another object merged into them."""
    m = T.merge_objects(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("kind"))))
    return load(s, d, "events").select("event_id", m.alias("m")).select("event_id", F.get_json_object("m", "$.k").alias("k"), F.get_json_object("m", "$.kind").alias("kind"))


@query("SELECT LineId, array_to_string(ParameterList, '|') AS parameters FROM log_lines WHERE ParameterList IS NOT NULL")
def line_parameters(s: SparkSession, d: str) -> DataFrame:
    """What stands at the wildcards of each parsed line's template; remnants of other characters are no part of a line."""
    lines = load(s, d, "log_lines").where("ParameterList is not null").withColumn("Content", F.regexp_replace("Content", f" ?{logs.NON_ASCII}", ""))
    return templates.with_parameters(lines, "Content", "EventTemplate").select("LineId", F.array_join("parameters", "|").alias("parameters"))


_YEAR = r"coalesce(nullif(regexp_extract(sq, '\(((?:18|19|20)[0-9]{2})[a-z]?\)', 1), ''), nullif(regexp_extract(sq, '(?:^|[^0-9A-Za-z.])((?:18|19|20)[0-9]{2})(?:[^0-9A-Za-z]|$)', 1), ''))"


@query(rf"""WITH q AS (SELECT citation_id, trim(regexp_replace(regexp_replace(raw, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\s+', ' ', 'g')) AS sq FROM citations), y AS (SELECT *, {_YEAR} AS yr FROM q),
c AS (SELECT *, CASE WHEN yr IS NOT NULL AND instr(sq, yr) > 1 THEN substr(sq, 1, instr(sq, yr) - 1) ELSE sq END AS chunk, regexp_replace(regexp_replace(substr(sq, instr(sq, yr) + 4), '^[a-z]([).,:;\s])', '\1'), '^[).,:;]*\s*', '') AS rest FROM y)
SELECT citation_id, nullif(list_aggregate(list_filter(regexp_split_to_array(translate(chunk, ',&', '  '), ' +'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z''-]{{2,}}') AND NOT list_contains({T.NO_SURNAMES}, x)), 'string_agg', '|'), '') AS surnames,
yr::INT AS year, CASE WHEN yr IS NOT NULL THEN regexp_replace(regexp_replace(regexp_extract(rest, '(?s)^(.*?)(?:\. [A-Z].*)?$', 1), '^["''`{{]+', ''), '["''`}}]+$', '') END AS title FROM c""")
def citation_text_fields(s: SparkSession, d: str) -> DataFrame:
    """Surnames, year and title of raw citations by the text rules."""
    r = T.squeeze(F.col("raw"))
    return load(s, d, "citations").select("citation_id", F.nullif(F.array_join(T.extract_surnames(r, None, None), "|"), F.lit("")).alias("surnames"), T.extract_year(r).alias("year"), T.extract_title(r, None).alias("title"))


def _icon_sql() -> str:
    return "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in match.ICONS.items()) + " END"


def _safe_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '[\x00-\x1F\x7F]', ' ', 'g'), '([\\`*_{{}}\[\]()#+!|<>~])', '\\\1', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH {_WORKS_VERD}, x AS (SELECT citation_id, status, coalesce(authors[1], '') || ' ' || coalesce(year::VARCHAR, '') || ' ' || coalesce(title, '') AS t FROM st JOIN citations USING (citation_id)),
l AS (SELECT citation_id, status, {_icon_sql()} || ' **[' || status || ']** ' || citation_id || ' -- ' || substr({_safe_sql('t')}, 1, 100) AS line FROM x)
SELECT 'all' AS section, citation_id AS index, line FROM l UNION ALL SELECT 'critical', citation_id, line FROM l WHERE status IN ('METADATA_MISMATCH', 'NOT_FOUND')""")
def report_findings(s: SparkSession, d: str) -> DataFrame:
    """Lines of the report: the critical findings, and all of them."""
    return match.findings(_verdict_rows(s, d))


@query(f"WITH {_WORKS_VERD} SELECT bool_or(status IN ('METADATA_MISMATCH', 'NOT_FOUND')) AS failed FROM st")
def run_failed(s: SparkSession, d: str) -> DataFrame:
    """Whether any citation was mismatched or not found."""
    return _verdict_rows(s, d).agg(F.bool_or(F.col("status").isin("METADATA_MISMATCH", "NOT_FOUND")).alias("failed"))


def _verdict_rows(s: SparkSession, d: str) -> DataFrame:
    v = _verdicts(s, d, _works_compared(s, d)).select("index", "status")
    return v.join(load(s, d, "citations").select(F.col("citation_id").alias("index"), "authors", "year", "title"), "index")


# ---- learned parts ----------------------------------------------------------------------------


@query(r"SELECT doc_id, len(e)::INT AS n, list_aggregate(list_sort(e), 'string_agg', ' ') AS entities FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '\b([A-Za-z][A-Za-z0-9]*(?:[._-][A-Za-z0-9]+)+)\b', 1)) AS e FROM documents WHERE text IS NOT NULL)")
def document_names(s: SparkSession, d: str) -> DataFrame:
    """Names in each document, counted and in order."""
    e = learning.entities(load(s, d, "documents").where("text is not null").select("doc_id", "text"), "text")
    return e.select("doc_id", F.size("entities").alias("n"), F.nullif(F.array_join(F.array_sort("entities"), " "), F.lit("")).alias("entities"))


@query(r"SELECT doc_id, b.bucket, count(*) AS n FROM (SELECT doc_id, ('0x' || substr(md5(w), 1, 7))::BIGINT % 64 AS bucket FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE w <> '') b GROUP BY ALL")
def document_vectors(s: SparkSession, d: str) -> DataFrame:
    """Words of each document counted in 64 hash buckets, the buckets that are not empty."""
    return learning.hashed_vectors(load(s, d, "documents"), "doc_id", "text").select("doc_id", "bucket", "n")


@query("SELECT doc_id, 'Root Cause: undetermined (' || length(text) || ' characters)' AS answer FROM documents WHERE length(text) > 0")
def stub_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers by the hook, here its fixed stub; texts without an answer are left out."""
    return learning.answers(load(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", "answer")


# ---- time -------------------------------------------------------------------------------------


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id AS entity, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM h GROUP BY user_id, no".replace("AS end,", 'AS "end",'))
def gap_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of a user that a gap of half an hour ends."""
    from logquarry.streaming import sessions as streaming

    g = streaming.gap_sessions(load(s, d, "events"), "ts", "user_id")
    return g.select("entity", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT date_trunc('hour', ts) + o * INTERVAL 30 MINUTE AS start, event_type AS kind, count(*) AS n FROM events, (VALUES (-1), (0), (1)) v(o) WHERE ts >= date_trunc('hour', ts) + o * INTERVAL 30 MINUTE AND ts < date_trunc('hour', ts) + o * INTERVAL 30 MINUTE + INTERVAL 1 HOUR GROUP BY ALL")
def sliding_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts in windows of an hour, one every half hour."""
    return temporal.sliding_counts(load(s, d, "events"), "ts", "event_type", "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH b AS (SELECT date_trunc('minute', ts) AS bin, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM events GROUP BY 1), e AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), INTERVAL 1 MINUTE)) AS bin) SELECT bin, coalesce(n, 0) AS n, coalesce(items, '') AS items FROM e LEFT JOIN b USING (bin)")
def minute_bins_filled(s: SparkSession, d: str) -> DataFrame:
    """Events by minute, empty minutes included."""
    return temporal.bins(load(s, d, "events"), "ts", "event_type", "minute", fill=True)


@query("SELECT src, dst, count(*) AS n FROM (SELECT user_id AS src, event_type AS dst FROM events) GROUP BY ALL".replace("user_id AS src", "user_id::VARCHAR AS src"))
def stream_edges(s: SparkSession, d: str) -> DataFrame:
    """An edge table that a stream keeps up to date; batches are added up, one delivered again counts once."""
    from logquarry.streaming import sessions as streaming

    st = streaming.event_stream(s, f"{d}/events.parque[t]", load(s, d, "events").schema)
    edges = st.select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"))
    return streaming.keep_edges(edges, _folder(s))
