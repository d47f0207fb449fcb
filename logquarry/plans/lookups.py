"""Queries that look citations up in the recorded works, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators import match, nested, records
from logquarry.plans.catalog import _ROUTE, _STOP, _norm_sql, query
from logquarry.plans.nested_sql import _els, works_sql
from logquarry.session import load


def _one(x: str) -> str:
    """First of an array, or the value itself."""
    return f"(CASE WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[0]') ELSE {x} END)"


def _str(x: str) -> str:
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN json_extract_string({x}, '$') END)"


def _year(name: str) -> str:
    y = _one(_one(f"""json_extract(w, '$.{name}."date-parts"')"""))
    return f"(CASE WHEN json_type({y}) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT') AND regexp_full_match(json_extract_string({y}, '$'), '-?[0-9]{{1,9}}') THEN json_extract_string({y}, '$')::INT END)"


_AUTHORS = f"list_filter({_els('au')}, lambda x: json_type(x) <> 'NULL')"
#: CTEs ending in rec(response_id, item_pos, doi, type, title, publisher, container, year, n_authors, first_author).
_RECORDS = f"""{works_sql()}, wo AS (SELECT response_id, item_pos, w, json_extract(w, '$.author') AS au FROM wk WHERE json_type(w) = 'OBJECT'),
wa AS (SELECT *, CASE WHEN au IS NULL OR json_type(au) = 'NULL' THEN [] ELSE {_AUTHORS} END AS al FROM wo),
rec AS (SELECT response_id, item_pos::INT AS item_pos, {_str("json_extract(w, '$.DOI')")} AS doi, {_str("json_extract(w, '$.type')")} AS type, {_str(_one("json_extract(w, '$.title')"))} AS title, {_str("json_extract(w, '$.publisher')")} AS publisher,
{_str(_one('''json_extract(w, '$."container-title"')'''))} AS container, coalesce({_year('issued')}, {_year('created')}, {_year('published')}) AS year, len(al)::INT AS n_authors,
CASE WHEN len(al) > 0 AND json_type(al[1]) = 'OBJECT' THEN coalesce(nullif({_str("json_extract(al[1], '$.family')")}, ''), {_str("json_extract(al[1], '$.name')")}) END AS first_author FROM wa)"""


@query(f"WITH {_RECORDS} SELECT * FROM rec")
def canonical_records(s: SparkSession, d: str) -> DataFrame:
    """One flat record of every recorded work."""
    return records.records(load(s, d, "api_responses"))


_IDS = f"""{_RECORDS}, one AS (SELECT lower(doi) AS doi, min((response_id, item_pos)) AS spot FROM rec WHERE length(doi) > 0 GROUP BY lower(doi)),
ci AS (SELECT citation_id, title, CASE WHEN length(doi) > 0 THEN 'doi' WHEN length(nber_number) > 0 THEN 'nber' END AS route,
CASE WHEN length(doi) > 0 THEN lower(doi) WHEN regexp_full_match(regexp_replace(nber_number, '^[wW]', ''), '[0-9]{{1,7}}') THEN '10.3386/w' || regexp_replace(nber_number, '^[wW]', '') END AS doi FROM citations),
found AS (SELECT citation_id, title, route, doi, spot[1] AS response_id, spot[2] AS item_pos FROM ci LEFT JOIN one USING (doi))"""


@query(f"WITH {_IDS} SELECT citation_id, route, doi, response_id, item_pos FROM found")
def lookup_by_identifier(s: SparkSession, d: str) -> DataFrame:
    """The recorded work of each citation's DOI or working-paper number."""
    return records.by_identifier(load(s, d, "citations"), records.records(load(s, d, "api_responses")))


@query(f"WITH {_IDS} SELECT coalesce(route, 'none') AS route, count(*) AS n, count(response_id) AS hits FROM found GROUP BY 1")
def lookup_hits(s: SparkSession, d: str) -> DataFrame:
    """Citations by way of lookup and how many were found."""
    return lookup_by_identifier(s, d).groupBy(F.coalesce("route", F.lit("none")).alias("route")).agg(F.count("*").alias("n"), F.count("response_id").alias("hits"))


def _bag(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({_norm_sql(c)}, ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x))))"


_F1 = "2.0 * len(list_intersect(l.w, r.w)) / (len(l.w) + len(r.w))"


@query(f"""WITH {_IDS}, l AS (SELECT citation_id, {_bag('title')} AS w FROM found WHERE response_id IS NULL AND title IS NOT NULL AND citation_id % 20 = 0), r AS (SELECT response_id, item_pos, {_bag('title')} AS w FROM rec WHERE title IS NOT NULL),
p AS (SELECT citation_id, response_id, item_pos, round({_F1}, 6) AS f1 FROM l, r WHERE len(l.w) > 0 AND len(r.w) > 0 AND {_F1} >= 0.70 - 1e-12),
k AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY f1 DESC, response_id, item_pos) AS rank FROM p)
SELECT citation_id, route AS how, 1 AS rank, response_id, item_pos, 1.0 AS f1 FROM found WHERE response_id IS NOT NULL AND citation_id % 20 = 0
UNION ALL SELECT citation_id, 'search', rank, response_id, item_pos, f1 FROM k WHERE rank <= 5""")
def exact_then_fuzzy_match(s: SparkSession, d: str) -> DataFrame:
    """Recorded works of the citations whose id is divisible by 20: by identifier, else the five best by title."""
    return records.exact_then_fuzzy(load(s, d, "citations").where("citation_id % 20 = 0"), records.records(load(s, d, "api_responses")))


@query(f"""WITH l AS (SELECT citation_id AS id, {_bag('title')} AS w FROM citations WHERE title IS NOT NULL AND citation_id % 20 = 0), r AS (SELECT citation_id AS other, {_bag('title')} AS w FROM citations WHERE title IS NOT NULL),
p AS (SELECT id, other, round({_F1}, 6) AS f1 FROM l, r WHERE id <> other AND len(l.w) > 0 AND len(r.w) > 0 AND {_F1} >= 0.70 - 1e-12)
SELECT id, other, f1, row_number() OVER (PARTITION BY id ORDER BY f1 DESC, other) AS rank FROM p QUALIFY rank <= 5""")
def title_search(s: SparkSession, d: str) -> DataFrame:
    """The five other citations that match each title whose citation_id is divisible by 20 best, at a word F1 of 0.70 or more."""
    t = load(s, d, "citations").where("title is not null")
    return match.best_by_tokens(t.where("citation_id % 20 = 0").select(F.col("citation_id").alias("id"), "title"), t.select(F.col("citation_id").alias("other"), "title"), itself=False)


_SCORE = f"""tk AS (SELECT *, list_filter(string_split(en, ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x)) AS ew, list_filter(string_split(cn, ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x)) AS cw FROM pr),
it AS (SELECT *, len(ew) AS e, len(cw) AS c, list_sum([0] || list_transform(list_distinct(ew), lambda x: least(len(list_filter(ew, lambda y: y = x)), len(list_filter(cw, lambda y: y = x)))))::INT AS inter FROM tk),
sc AS (SELECT *, CASE WHEN en = cn AND en <> '' THEN 1.0 WHEN e < 3 OR c = 0 OR inter = 0 THEN 0.0 ELSE round(2.0 * (inter / c) * (inter / e) / (inter / c + inter / e), 6) END AS f1 FROM it)"""


@query(f"""WITH {_RECORDS}, ch AS (SELECT response_id FROM rec WHERE item_pos = 0 AND type = 'book-chapter'),
pr AS (SELECT c.citation_id, a.response_id, r.item_pos, {_norm_sql('c.title')} AS en, {_norm_sql('r.title')} AS cn FROM api_responses a JOIN ch USING (response_id) JOIN rec r USING (response_id) JOIN citations c ON c.citation_id = a.citation_id
WHERE r.item_pos > 0 AND r.type IN ('book', 'monograph') AND r.title IS NOT NULL AND c.title IS NOT NULL AND split_part(replace(trim(c.authors[1]), ',', ' '), ' ', 1) <> '' AND contains(lower(r.first_author), lower(split_part(replace(trim(c.authors[1]), ',', ' '), ' ', 1)))),
{_SCORE}, bs AS (SELECT citation_id, response_id, min((item_pos, f1)) AS z FROM sc WHERE f1 > 0.85 GROUP BY ALL) SELECT citation_id, response_id, z[1] AS item_pos, z[2]::DOUBLE AS f1 FROM bs""")
def book_siblings(s: SparkSession, d: str) -> DataFrame:
    """Books that stand beside a chapter in an answer and fit the citation better."""
    api = load(s, d, "api_responses")
    return records.siblings(load(s, d, "citations"), api.where("citation_id is not null").select("citation_id", "response_id"), records.records(api))


@query(f"""WITH {_RECORDS} SELECT c.type AS truth, r.type AS guess, count(*) AS n FROM citations c JOIN api_responses a ON a.citation_id = c.citation_id JOIN rec r ON r.response_id = a.response_id AND r.item_pos = 0 WHERE r.type IS NOT NULL GROUP BY ALL""")
def type_confusion(s: SparkSession, d: str) -> DataFrame:
    """Types of citations against those of the works that were looked up for them: two tables joined by their key."""
    api = load(s, d, "api_responses")
    r = records.records(api).where("item_pos = 0 and type is not null").select("response_id", F.col("type").alias("guess"))
    j = load(s, d, "citations").select("citation_id", F.col("type").alias("truth")).join(api.select("citation_id", "response_id"), "citation_id").join(r, "response_id")
    return j.groupBy("truth", "guess").agg(F.count("*").alias("n"))


_NODES = f"""WITH {works_sql()}, f AS (SELECT response_id, item_pos, w, json_extract(w, '$.title') AS t, json_extract(w, '$.author') AS a, json_extract(w, '$.indexed."date-parts"') AS dp FROM wk)"""


@query(f"""{_NODES}, full_ AS (SELECT response_id, item_pos, w,
CASE WHEN t IS NULL THEN [] ELSE list_filter({_els('t')}, lambda x: CAST(x AS VARCHAR) NOT IN ('null', '""', '[]', '{{}}')) END AS tl,
CASE WHEN a IS NULL THEN [] ELSE list_filter({_els('a')}, lambda x: CAST(x AS VARCHAR) NOT IN ('null', '""', '[]', '{{}}')) END AS al,
CASE WHEN dp IS NULL THEN [] ELSE list_filter(flatten(list_transform(list_filter({_els('dp')}, lambda x: CAST(x AS VARCHAR) NOT IN ('null', '""', '[]', '{{}}')), lambda y: {_els('y')})), lambda z: CAST(z AS VARCHAR) NOT IN ('null', '""', '[]', '{{}}')) END AS dl FROM f)
SELECT response_id, item_pos::INT AS item_pos, {_str('tl[1]')} AS title, {_str("json_extract(w, '$.DOI')")} AS doi, len(al) AS n_authors, json_extract_string(dl[1], '$') AS indexed_year FROM full_""")
def canonical_works(s: SparkSession, d: str) -> DataFrame:
    """Works from their nodes: first title that is not empty, DOI, number of authors, first date part."""
    f = nested.works_flat(load(s, d, "api_responses"))
    pick = lambda node: F.min(F.when(F.col("node") == node, F.struct("pos", "subpos", "value")))
    g = f.groupBy("response_id", "item_pos").agg(pick("title")["value"].alias("title"), pick("doi")["value"].alias("doi"), F.count_if(F.col("node") == "author").alias("n_authors"), pick("date_part")["value"].alias("indexed_year"))
    return g.select("response_id", "item_pos", "title", "doi", "n_authors", "indexed_year")
