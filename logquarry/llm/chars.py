"""Problem 1: text that looks the same brought to one form of characters.

DuckDB runs inside the Arrow partitions: ``nfc_normalize`` composes accents,
``translate`` maps compatibility forms, odd blanks and look-alike letters, and
regular expressions drop what cannot be seen.  What a reader can see - case,
accents, punctuation, ordinary blanks, tabs, line breaks - stays as it is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.plans.nested_sql import _els, _full, works_sql
from logquarry.session import durable

#: Letters of other scripts drawn like Latin ones.
LOOKALIKES = (
    ("АВЕЅІЈКМНОРСТУХԌԚԜҮ", "ABESIJKMHOPCTYXGQWY"),  # Cyrillic capitals
    ("аеѕіјорсухԁһԛԝӏ", "aesijopcyxdhqwl"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj"),  # Greek capitals
    ("οϲν", "ocv"),  # Greek small letters
    ("ЁЇёї", "ËÏëï"),  # with dots
    ("ՕՍոսօցհ", "OUnuogh"),  # Armenian
)
#: Hyphens drawn like the ordinary one, and blanks drawn like the ordinary one.
HYPHENS = "\u2010\u2011\ufe63\uff0d"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Kinds of compatibility forms that look like what they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>")
#: Characters that leave no mark: soft hyphen, joiners, direction marks, word joiner, BOM, variation selectors.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0000}-\x{E007F}]"


@lru_cache(1)
def tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """``(from, to, expansions)``: one-to-one mappings for ``translate`` and the one-to-many ones (ligatures)."""
    one: dict[str, str] = {}
    many: list[tuple[str, str]] = []
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        d = unicodedata.decomposition(ch)
        if not d.startswith("<"):
            if 0x2100 <= cp < 0x2200 and len(d.split()) == 1:  # Kelvin, Angstrom, Ohm: letters under a second number
                one[ch] = unicodedata.normalize("NFC", ch)
            continue
        if d.split(" ", 1)[0] not in SAME_LOOK:
            continue
        to = unicodedata.normalize("NFKC", ch)
        if not to or to[0] == " " or unicodedata.combining(to[0]):
            continue
        if len(to) == 1:
            one[ch] = to
        elif 0xFB00 <= cp <= 0xFB06 or 0x0132 <= cp <= 0x01F3 or 0x2160 <= cp <= 0x217F:
            many.append((ch, to))
    for a, b in LOOKALIKES:
        one |= dict(zip(a, b, strict=True))
    one |= {c: "-" for c in HYPHENS} | {c: " " for c in BLANKS}
    for k in list(one):  # a mapped form may itself look like a Latin letter
        one[k] = one.get(one[k], one[k])
    one = {k: v for k, v in one.items() if k != v}
    return "".join(one), "".join(one.values()), tuple(many)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def canonical_sql(col: str = "s") -> str:
    """The embedded SQL expression that gives the one form of column ``col``."""
    a, b, many = tables()
    e = f"nfc_normalize(regexp_replace({col}, {_quote(INVISIBLE)}, '', 'g'))"
    e = f"translate({e}, {_quote(a)}, {_quote(b)})"
    ligs = "".join(k for k, _ in many)
    deep = e
    for k, v in many:
        deep = f"replace({deep}, {_quote(k)}, {_quote(v)})"
    e = f"CASE WHEN regexp_matches({col}, {_quote('[' + ligs + ']')}) THEN {deep} ELSE {e} END"
    return f"nfc_normalize({e})"


def canonicalise(df: DataFrame, col: str, out: str = "canonical") -> DataFrame:
    """Adds ``out``: column ``col`` in one form of characters.

    NULL stays NULL and '' stays ''; texts of any length are taken whole; all
    other columns pass unchanged; an empty table stays empty.  Rows are not
    moved: every Arrow batch is one embedded query.
    """
    if out in df.columns:
        raise ValueError(f"column {out} exists")
    schema = df.withColumn(out, F.lit(None).cast("string")).schema
    at = df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        try:
            for b in batches:
                t = pa.table({"i": pa.array(range(b.num_rows), pa.int64()), "s": b.column(at)})  # noqa: F841
                got = con.sql(f"SELECT i, {canonical_sql()} AS c FROM t ORDER BY i").to_arrow_table()
                c = got.column("c").combine_chunks().cast(pa.string())
                c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
                yield pa.RecordBatch.from_arrays([*b.columns, c], names=[*b.schema.names, out])
        finally:
            con.close()

    return df.mapInArrow(run, schema)


def titles_sql() -> str:
    """CTEs ending in ``it(response_id, item_pos, title)``."""
    titles = f"SELECT response_id, item_pos, unnest({_els('t')}) AS x FROM tj WHERE {_full('t')}"
    return f"{works_sql()}, tj AS (SELECT response_id, item_pos, json_extract(w, '$.title') AS t FROM wk), it AS (SELECT DISTINCT response_id, item_pos, json_extract_string(x, '$') AS title FROM ({titles}) WHERE json_type(x) = 'VARCHAR')"


def titles_of_items(api: DataFrame) -> DataFrame:
    """(response_id, item_pos, title) of every title of every work, read by DuckDB inside the Arrow partitions.

    Error answers, broken and NULL bodies give no rows; a bare title counts as
    a list of one; null and empty titles give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        try:
            for b in batches:
                con.register("api_responses", pa.Table.from_batches([b]))
                got = con.sql(f"WITH {titles_sql()} SELECT response_id, item_pos::BIGINT AS item_pos, title FROM it").to_arrow_table()
                con.unregister("api_responses")
                yield from got.cast(pa.schema([("response_id", pa.int64()), ("item_pos", pa.int64()), ("title", pa.string())])).combine_chunks().to_batches()
        finally:
            con.close()

    return api.select(F.col("response_id").cast("bigint"), F.col("status_code").cast("int"), "body").mapInArrow(run, "response_id bigint, item_pos bigint, title string")


def found(citations: DataFrame, api: DataFrame) -> DataFrame:
    """(citation_id, response_id, item_pos) with a title that looks the same but is another string of code points.

    Distinct titles are canonicalised once and joined in one form; the
    expansion to citations and to items comes last.  A title that a third of
    all rows carry is one row in the first join; in both expansions its rows
    are spread by a salt, the other side being copied to every salt.
    """
    c = citations.where("title is not null").select(F.col("title").alias("ct"), "citation_id")
    i = durable(titles_of_items(api))  # read twice
    cd = canonicalise(c.select("ct").distinct(), "ct", "look")
    idd = canonicalise(i.select(F.col("title").alias("it")).distinct(), "it", "look")
    pairs = cd.join(idd, "look").where("ct <> it").select("ct", "it")
    salts = 8
    spread = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = spread.join(c.withColumn("salt", F.pmod(F.xxhash64("citation_id"), F.lit(salts)).cast("int")), ["ct", "salt"]).select("it", "citation_id")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    items = i.withColumnRenamed("title", "it").withColumn("salt", F.pmod(F.xxhash64("response_id", "item_pos"), F.lit(salts)).cast("int"))
    return left.join(items, ["it", "salt"]).select("citation_id", "response_id", "item_pos").distinct()
