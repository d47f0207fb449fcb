"""SQL for nested answers: the works of every readable answer and their nodes."""

from __future__ import annotations


def _els(x: str) -> str:
    return f"(CASE WHEN json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON[]) ELSE [CAST({x} AS JSON)] END)"


def _full(x: str) -> str:
    return f"({x} IS NOT NULL AND CAST({x} AS VARCHAR) NOT IN ('null', '\"\"', '[]', '{{}}'))"


def works_sql() -> str:
    """CTEs ending in ``wk(response_id, item_pos, w)``."""
    return f"""b AS (SELECT response_id, CAST(body AS JSON) AS j FROM api_responses WHERE (status_code IS NULL OR status_code BETWEEN 200 AND 299) AND json_valid(body)),
m AS (SELECT response_id, CASE WHEN json_type(j, '$.message') = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.message') AS JSON) ELSE json_extract(j, '$.message') END AS m FROM b WHERE json_type(j) = 'OBJECT' AND lower(coalesce(json_extract_string(j, '$.status'), 'ok')) NOT IN ('failed', 'error')),
o AS (SELECT response_id, m, json_extract(m, '$.items') AS it FROM m WHERE json_type(m) = 'OBJECT'),
wl AS (SELECT response_id, CASE WHEN list_contains(json_keys(m), 'items') THEN CASE WHEN json_type(it) = 'NULL' THEN CAST([] AS JSON[]) ELSE {_els('it')} END ELSE [m] END AS ws FROM o),
wk AS (SELECT response_id, i - 1 AS item_pos, ws[i] AS w FROM (SELECT response_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM wl) WHERE json_type(ws[i]) <> 'NULL')"""


def _value(x: str) -> str:
    return f"CASE WHEN json_type({x}) NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string({x}, '$') END"


def nodes_sql(values: bool = False) -> str:
    """(response_id, item_pos, node, pos, subpos[, value]) of every node."""
    v = (lambda x: f", {_value(x)} AS value") if values else (lambda x: "")
    return f"""WITH {works_sql()},
f AS (SELECT response_id, item_pos, json_extract(w, '$.title') AS t, json_extract(w, '$.DOI') AS d, json_extract(w, '$.author') AS a, json_extract(w, '$.indexed."date-parts"') AS dp FROM wk),
tt AS (SELECT response_id, item_pos, unnest(range(len({_els('t')}))) AS pos, unnest({_els('t')}) AS x FROM f WHERE {_full('t')}),
au AS (SELECT response_id, item_pos, unnest(range(len({_els('a')}))) AS pos, unnest({_els('a')}) AS x FROM f WHERE {_full('a')}),
al AS (SELECT response_id, item_pos, pos, json_extract(x, '$.affiliation') AS al FROM au WHERE json_type(x) = 'OBJECT'),
af AS (SELECT response_id, item_pos, pos, unnest(range(len({_els('al')}))) AS subpos, unnest({_els('al')}) AS x FROM al WHERE {_full('al')}),
dl AS (SELECT response_id, item_pos, unnest(range(len({_els('dp')}))) AS pos, unnest({_els('dp')}) AS x FROM f WHERE {_full('dp')}),
di AS (SELECT response_id, item_pos, pos, unnest(range(len({_els('x')}))) AS subpos, unnest({_els('x')}) AS y FROM dl WHERE {_full('x')})
SELECT response_id, item_pos, 'item' AS node, -1 AS pos, -1 AS subpos{v('w')} FROM wk
UNION ALL SELECT response_id, item_pos, 'doi', -1, -1{v('d')} FROM f WHERE {_full('d')}
UNION ALL SELECT response_id, item_pos, 'title', pos, -1{v('x')} FROM tt WHERE {_full('x')}
UNION ALL SELECT response_id, item_pos, 'author', pos, -1{v('x')} FROM au WHERE {_full('x')}
UNION ALL SELECT response_id, item_pos, 'affiliation', pos, subpos{v('x')} FROM af WHERE {_full('x')}
UNION ALL SELECT response_id, item_pos, 'date_part', pos, subpos{v('y')} FROM di WHERE {_full('y')}"""


def leaves_sql() -> str:
    """(response_id, path, value) of every scalar and null of every answer."""
    return f"""WITH {works_sql()} SELECT response_id, replace(t.fullkey, '"', '') AS path, json_extract_string(t.atom, '$') AS value FROM o, json_tree(o.m) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')"""


def first_titles_sql() -> str:
    """CTEs ending in ``ft(response_id, title)``: first title of the first work."""
    return f"""{works_sql()}, fw AS (SELECT response_id, json_extract(arg_min(w, item_pos), '$.title') AS t FROM wk GROUP BY response_id), fl AS (SELECT response_id, list_filter({_els('t')}, lambda x: json_type(x) = 'VARCHAR' AND json_extract_string(x, '$') <> '') AS l FROM fw WHERE t IS NOT NULL), ft AS (SELECT response_id, json_extract_string(l[1], '$') AS title FROM fl WHERE len(l) > 0)"""
