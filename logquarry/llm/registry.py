"""Names of the training-data queries and their SQL."""

from __future__ import annotations

from logquarry.llm import chars, dedup, mix, names, pack, runs, split
from logquarry.llm.chars import titles_sql
from logquarry.registry import Query
from logquarry.session import load


def queries() -> dict[str, Query]:
    """Training-data queries by name."""
    return {
        "p1_found": lambda s, d: chars.found(load(s, d, "citations"), load(s, d, "api_responses")),
        "p1_canonical": lambda s, d: chars.canonicalise(load(s, d, "citations").select("citation_id", "title"), "title"),
        "p2_found": lambda s, d: names.found(load(s, d, "citations"), load(s, d, "author_registry")),
        "p2_links": lambda s, d: names.link(load(s, d, "citations"), load(s, d, "author_registry")),
        "p5_found": lambda s, d: runs.found(load(s, d, "bgl_sessions"), load(s, d, "event_templates")),
        "p5_runs": lambda s, d: runs.collapse(load(s, d, "bgl_sessions"), load(s, d, "event_templates"), load(s, d, "bgl_log")),
        "p6_found": lambda s, d: dedup.found(load(s, d, "citations")),
        "p6_collapsed": lambda s, d: dedup.collapse(load(s, d, "citations")),
        "p7_packed": lambda s, d: pack.pack(load(s, d, "documents")),
        "p7_usage": lambda s, d: pack.usage(pack.pack(load(s, d, "documents"))),
        "p8_mixture": lambda s, d: mix.mixture(load(s, d, "documents"), load(s, d, "mix_targets")),
        "p8_shares": lambda s, d: mix.shares(mix.mixture(load(s, d, "documents"), load(s, d, "mix_targets")), load(s, d, "mix_targets")),
        "p8_entropy": lambda s, d: mix.shares(mix.mixture(load(s, d, "documents"), load(s, d, "mix_targets"), entropy_of_targets=True), load(s, d, "mix_targets")),
        "p8_budget": lambda s, d: mix.shares(mix.mixture(load(s, d, "documents"), load(s, d, "mix_targets"), stretch=1.5), load(s, d, "mix_targets")),
        "p9_found": lambda s, d: split.found(load(s, d, "documents")),
        "p9_pieces": lambda s, d: split.split(load(s, d, "documents")),
    }


_RUNS = r"""WITH s AS (SELECT DISTINCT sid, event_ids, labels FROM bgl_sessions),
t AS (SELECT EventId, lower(regexp_replace(regexp_replace(EventTemplate, '<[^<>]*>', '', 'g'), '[^\p{L}]+', '', 'g')) AS ev FROM event_templates),
p AS (SELECT sid, unnest(range(len(event_ids))) AS pos, unnest(event_ids) AS EventId, unnest(labels) AS label FROM s),
e AS (SELECT sid, pos, label, coalesce('t:' || nullif(ev, ''), 'i:' || EventId) AS ev FROM p LEFT JOIN t USING (EventId)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY sid, ev, label ORDER BY pos) AS isle FROM e)
SELECT sid, min(pos) AS start_pos, count(*) AS n_events FROM g GROUP BY sid, ev, label, isle HAVING count(*) >= 2"""

_RUN_TIMES = r"""WITH s AS (SELECT DISTINCT sid, event_ids, labels, idx FROM bgl_sessions),
t AS (SELECT EventId, lower(regexp_replace(regexp_replace(EventTemplate, '<[^<>]*>', '', 'g'), '[^\p{L}]+', '', 'g')) AS ev FROM event_templates),
p AS (SELECT sid, pos, event_ids[pos + 1] AS EventId, labels[pos + 1] AS label, idx[pos + 1] AS i FROM (SELECT *, unnest(range(len(event_ids))) AS pos FROM s)),
e AS (SELECT sid, pos, label, i, coalesce('t:' || nullif(ev, ''), 'i:' || EventId) AS event FROM p LEFT JOIN t USING (EventId)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY sid, event, label ORDER BY pos) AS isle FROM e),
l AS (SELECT idx AS i, try_strptime(Time, '%Y-%m-%d-%H.%M.%S.%f') AS ts FROM bgl_log)
SELECT sid, min(pos) AS start_pos, count(*) AS n_events, event, label, first(i ORDER BY pos) AS first_idx, last(i ORDER BY pos) AS last_idx, min(ts) AS started, max(ts) AS ended, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us
FROM g LEFT JOIN l USING (i) GROUP BY sid, event, label, isle"""

_WIDE = "＂＃＄％＆＇（）＊＋，－．／０１２３４５６７８９：；＜＝＞？＠ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ［＼］＾＿｀ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ｛｜｝～！"
_ASCII = "\"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{{|}}~!"
_BARE = rf"nullif(regexp_replace(replace(lower(upper(regexp_replace(nfc_normalize(translate({{}}, '{_WIDE}', '{_ASCII}')), 'ß|ẞ', 'ss', 'g'))), 'ς', 'σ'), '[\p{{{{P}}}}\p{{{{S}}}}\p{{{{Z}}}}\p{{{{C}}}}\s]+', '', 'g'), '')"
_FIELD = r"regexp_extract(raw, '(?is)\b{}\s*=\s*(.*?),?\n\s*(?:\w+\s*=|\}}\s*$)', 1)"


def _json_field(name: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(raw, '$.{n}')" for n in (name, name.upper(), name.capitalize())) + ")"


def _copies(collapsed: bool = False) -> str:
    pick = lambda n: f"CASE WHEN title IS NULL AND doi IS NULL AND ltrim(raw) LIKE '{{%' THEN CASE WHEN json_valid(raw) THEN {_json_field(n)} END WHEN title IS NULL AND doi IS NULL AND ltrim(raw) LIKE '@%' THEN {_FIELD.format(n)} ELSE {n} END"
    return f"""WITH r AS (SELECT citation_id, {pick('title')} AS t, {pick('doi')} AS d FROM citations),
k AS (SELECT citation_id, {_BARE.format('t')} AS t, coalesce(regexp_replace({_BARE.format('d')}, '^(https?(dx)?doiorg|doi)10', '10'), '') AS d FROM r),
g AS (SELECT citation_id, min(citation_id) OVER (PARTITION BY t, d) AS a FROM k WHERE t IS NOT NULL)
""" + ("SELECT min(citation_id) AS citation_id, t AS title_key, nullif(d, '') AS doi_key, count(*) AS n_copies FROM k WHERE t IS NOT NULL GROUP BY t, d UNION ALL SELECT citation_id, NULL, NULL, 1 FROM k WHERE t IS NULL" if collapsed else """SELECT DISTINCT a AS citation_id_a, citation_id AS citation_id_b FROM g WHERE a <> citation_id""")


#: Code points of letters drawn like others, and those letters; the SQL's own list, letter by letter.
_DRAWN_LIKE = (
    "1040:A 1042:B 1045:E 1029:S 1030:I 1032:J 1050:K 1052:M 1053:H 1054:O 1056:P 1057:C 1058:T 1059:Y 1061:X 1292:G "
    "1306:Q 1308:W 1198:Y 1072:a 1077:e 1109:s 1110:i 1112:j 1086:o 1088:p 1089:c 1091:y 1093:x 1281:d 1211:h 1307:q "
    "1309:w 1231:l 913:A 914:B 917:E 918:Z 919:H 921:I 922:K 924:M 925:N 927:O 929:P 932:T 933:Y 935:X "
    "1017:C 1011:j 959:o 1010:c 957:v 1025:Ë 1031:Ï 1105:ë 1111:ï 1365:O 1357:U 1400:n 1405:u 1413:o 1409:g 1392:h "
)


def _look(x: str) -> str:
    """The one form of a text, character by character, as DuckDB's CASE says it."""
    drawn = " ".join(f"WHEN {a} THEN '{b}'" for a, b in (p.split(":") for p in _DRAWN_LIKE.split()))
    ligatures = " ".join(f"WHEN {a} THEN '{b}'" for a, b in ((64256, "ff"), (64257, "fi"), (64258, "fl"), (64259, "ffi"), (64260, "ffl"), (64261, "st"), (64262, "st")))
    one = f"""CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) = 65293 THEN '-' WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248)
WHEN unicode(c) IN (173, 847, 1564, 4447, 4448, 6068, 6069, 65279) OR unicode(c) BETWEEN 6155 AND 6158 OR unicode(c) BETWEEN 8203 AND 8207 OR unicode(c) BETWEEN 8234 AND 8238 OR unicode(c) BETWEEN 8288 AND 8303 OR unicode(c) BETWEEN 65024 AND 65039 OR unicode(c) BETWEEN 917504 AND 917631 THEN ''
WHEN unicode(c) IN (160, 5760, 8239, 8287, 12288) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' ' WHEN unicode(c) IN (8208, 8209, 65123) THEN '-' ELSE CASE unicode(c) {ligatures} {drawn} ELSE c END END"""
    # what is composed only once the invisible is gone is looked at again
    through = lambda y: f"nfc_normalize(array_to_string(list_transform(string_split({y}, ''), lambda c: {one}), ''))"
    return through(through(f"nfc_normalize({x})"))


def oracle_sql() -> dict[str, str]:
    """SQL of the training-data queries that SQL can express."""
    look = _look
    return {
        "p1_found": f"WITH {titles_sql()}, c AS (SELECT citation_id, title AS s FROM citations WHERE title IS NOT NULL), cc AS (SELECT citation_id, s, {look('s')} AS look FROM c), ii AS (SELECT response_id, item_pos, title, {look('title')} AS look FROM it) SELECT DISTINCT citation_id, response_id, item_pos FROM cc JOIN ii USING (look) WHERE s <> title",
        "p1_canonical": f"SELECT citation_id, title, {look('title')} AS canonical FROM citations",
        "p5_found": _RUNS,
        "p5_runs": _RUN_TIMES,
        "p6_found": _copies(),
        "p6_collapsed": _copies(collapsed=True),
    }
