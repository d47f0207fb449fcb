"""SQL for log entries: the layouts of this data, each written out, which the operator does not know."""

from __future__ import annotations

#: Layouts: name, pattern of the first line, and what gives level and component ('' for none).
_HEADS = [
    ("cluster", r"^\S+ \d{10} \d{4}\.\d\d\.\d\d \S+ \d{4}-\d\d-\d\d-\d\d\.\d\d\.\d\d\.\d+ \S+ \S+ (\S+) ([A-Z]+)( |$)", 2, 1),
    ("dashed", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d[,.]\d+ - (\S+) - ([A-Z]+) -( |$)", 2, 1),
    ("bracketed", r"^\[[^\]]+\] \[([A-Za-z]+)\] \[([^\]]+)\]( |$)", 1, 2),
    ("pooled", r"^\d\d?-[A-Z][a-z]{2}-\d{4} [\d:.,]+ ([A-Z]+) \[[^\]]*\] (\S+)( |$)", 1, 2),
    ("compact", r"^\d{6} \d{6} \d+ ([A-Z]+) (\S+):( |$)", 1, 2),
    ("lettered", r"^([A-Z])\d{4} [\d:.]+ +\d+ (\S+):\d+\]( |$)", 1, 2),
    ("barred", r"^\d{13}\|([A-Za-z])\|([^|]+)\|", 1, 2),
    ("syslog5", r"^<(\d{1,3})>\d \S+ \S+ (\S+) \S+ \S+ ", 1, 2),
    ("syslog3", r"^(?:<(\d{1,3})>)?[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d \S+ ([^\s\[]+)\[\d+\]:( |$)", 1, 2),
    ("twoline", r"^[A-Z][a-z]{2} \d{1,2}, \d{4} \d{1,2}:\d\d:\d\d [AP]M (\S+)$", 0, 1),
    ("keyed", r"^[A-Za-z_]+=.*", 0, 0),
]
_TIME, _LEVEL, _COMPONENT, _MESSAGE = ("time", "ts", "@timestamp", "timestamp"), ("level", "severity", "lvl"), ("component", "logger", "name"), ("message", "msg")


def _member(js: str, names: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"""json_extract_string({js}, '$."{n}"')""" for n in names) + ")"


def _key(name: str) -> str:
    return f"""nullif(trim(regexp_extract(f, '(?:^| ){name}=("[^"]*"|\\S+)', 1), '"'), '')"""


def entries_sql() -> str:
    """(first_line, last_line, level, component) of every entry."""
    kinds = " ".join(f"WHEN regexp_matches(f, '{p}'){' AND ' + _key('time') + ' IS NOT NULL AND ' + _key('msg') + ' IS NOT NULL AND coalesce(' + _key('level') + ', ' + _key('component') + ') IS NOT NULL' if n == 'keyed' else ''} THEN '{n}'" for n, p, _, _ in _HEADS)
    level = " ".join(f"WHEN '{n}' THEN regexp_extract(f, '{p}', {lv})" for n, p, lv, _ in _HEADS if lv)
    comp = " ".join(f"WHEN '{n}' THEN regexp_extract(f, '{p}', {c})" for n, p, _, c in _HEADS if c)
    names = "|".join(_TIME + _LEVEL + _COMPONENT + _MESSAGE)
    return f"""WITH b AS (SELECT LineId, coalesce(Logrecord, '~') AS rec, Date, Level, Component, coalesce(Content, '') AS t, regexp_replace(split_part(coalesce(Content, ''), chr(10), 1), '\\r$', '') AS f FROM log_lines),
h AS (SELECT *, CASE WHEN Date IS NOT NULL THEN 'parsed' WHEN f = '{{' THEN 'open' WHEN regexp_matches(f, '^\\{{.*\\}}\\s*$') THEN CASE WHEN json_valid(f) THEN CASE WHEN {_member('f', _TIME)} IS NOT NULL AND {_member('f', _MESSAGE)} IS NOT NULL THEN 'json' END END {kinds} END AS kind FROM b),
p AS (SELECT *, max(CASE WHEN kind IS NOT NULL THEN LineId END) OVER (PARTITION BY rec ORDER BY LineId) AS prov, lead(f) OVER (PARTITION BY rec ORDER BY LineId) AS below, lead(kind) OVER (PARTITION BY rec ORDER BY LineId) AS next_kind FROM h),
c AS (SELECT rec, prov, min(LineId) AS closing FROM p WHERE LineId > prov AND starts_with(f, '}}') GROUP BY ALL),
o AS (SELECT rec, prov, '{{' || string_agg(regexp_replace(f, ',\\s*$', ''), ',' ORDER BY LineId) || '}}' AS js FROM p JOIN c USING (rec, prov) WHERE LineId > prov AND LineId < closing AND regexp_matches(f, '^\\s*"({names})"\\s*:') GROUP BY ALL),
j AS (SELECT p.*, CASE kind WHEN 'json' THEN f WHEN 'open' THEN CASE WHEN contains(t, chr(10)) THEN regexp_extract(t, '(?s)^(\\{{.*?\\n\\}})', 1) ELSE o.js END END AS js0 FROM p LEFT JOIN o ON o.rec = p.rec AND o.prov = p.LineId),
v AS (SELECT *, CASE WHEN json_valid(js0) THEN js0 END AS js FROM j),
w AS (SELECT *, kind IS NOT NULL AND (kind <> 'open' OR ({_member('js', _TIME)} IS NOT NULL AND {_member('js', _MESSAGE)} IS NOT NULL)) AS head,
CASE kind WHEN 'parsed' THEN trim(Level) WHEN 'json' THEN {_member('js', _LEVEL)} WHEN 'open' THEN {_member('js', _LEVEL)} WHEN 'keyed' THEN {_key('level')}
WHEN 'twoline' THEN CASE WHEN contains(t, chr(10)) THEN regexp_extract(split_part(t, chr(10), 2), '^([A-Z]+): ', 1) WHEN next_kind IS NULL THEN regexp_extract(below, '^([A-Z]+): ', 1) END {level} END AS lv,
CASE kind WHEN 'parsed' THEN Component WHEN 'json' THEN {_member('js', _COMPONENT)} WHEN 'open' THEN {_member('js', _COMPONENT)} WHEN 'keyed' THEN {_key('component')} {comp} END AS comp FROM v),
x AS (SELECT *, CASE WHEN kind IN ('syslog5', 'syslog3') THEN ['FATAL', 'FATAL', 'FATAL', 'ERROR', 'WARN', 'INFO', 'INFO', 'DEBUG'][try_cast(lv AS INT) % 8 + 1]
ELSE CASE upper(lv) WHEN 'WARNING' THEN 'WARN' WHEN 'W' THEN 'WARN' WHEN 'WARN' THEN 'WARN' WHEN 'CRITICAL' THEN 'FATAL' WHEN 'FATAL' THEN 'FATAL' WHEN 'C' THEN 'FATAL' WHEN 'F' THEN 'FATAL' WHEN 'ERROR' THEN 'ERROR' WHEN 'E' THEN 'ERROR' WHEN 'INFO' THEN 'INFO' WHEN 'I' THEN 'INFO' WHEN 'DEBUG' THEN 'DEBUG' WHEN 'D' THEN 'DEBUG' WHEN 'TRACE' THEN 'TRACE' WHEN 'T' THEN 'TRACE' END END AS lvl,
max(CASE WHEN head THEN LineId END) OVER (PARTITION BY rec ORDER BY LineId) AS first_line FROM w),
l AS (SELECT first_line, max(LineId) AS last_line FROM x WHERE first_line IS NOT NULL GROUP BY first_line)
SELECT l.first_line, l.last_line, coalesce(lvl, '') AS level, coalesce(comp, '') AS component FROM l JOIN x ON x.LineId = l.first_line"""
