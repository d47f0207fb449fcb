"""Readers: logs by format, session text, JSON, CSV, paragraphs, Markdown tables, arrays, configuration."""

from __future__ import annotations

import io
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

NON_ASCII = "<NASCII>"


def format_fields(fmt: str) -> tuple[list[str], str]:
    """Fields of a format such as ``<Date> <Time> \\[<Addr>\\] <Content>`` and the pattern of a whole line.

    The format is read from left to right: ``<Name>`` is a field of any text,
    the shortest that fits; a run of blanks is any blank space; all else is a
    regular expression as it stands.
    """
    fields, pattern, rest = [], "", fmt
    while rest:
        if (name := re.match(r"<(\w+)>", rest)) is not None:
            fields.append(name[1])
            pattern += "(.*?)"
            rest = rest[name.end() :]
        elif rest[0] == " ":
            pattern += r"\s+"
            rest = rest.lstrip(" ")
        else:
            pattern += rest[0]
            rest = rest[1:]
    return fields, f"^{pattern}$"


def scan_log(lines: DataFrame, fmt: str, text: str = "value", line_id: str | None = None) -> DataFrame:
    """Lines that fit a format, one column a field; others are dropped, as are blank ones.

    Runs of characters outside ASCII become '<NASCII>'.  Other columns stay.
    ``line_id`` names a new column that numbers the fitting lines of each file
    from 1; the lines then need file and line_no, as ``number_lines`` gives.
    """
    fields, pattern = format_fields(fmt)
    v = F.regexp_replace(F.trim(text), r"[^\x00-\x7F]+", NON_ASCII)
    d = lines.withColumn(text, v).where(F.col(text).rlike(pattern))
    groups = "\u0001".join(f"${i + 1}" for i in range(len(fields)))  # one match gives all fields; the mark is no ASCII text of a log
    d = d.withColumn("_f", F.split(F.regexp_replace(text, pattern, groups), "\u0001"))
    d = d.withColumns({n: F.get("_f", F.lit(i)) for i, n in enumerate(fields)}).drop("_f", *([] if text in fields else [text]))
    if line_id:
        d = _number(d, ["file", F.floor(F.col("line_no") / BLOCK_LINES).alias("_block")], "line_no", line_id)
    return d


#: Lines of a file that are numbered in one window.
BLOCK_LINES = 1_000_000


def _number(d: DataFrame, block: list, order: str, out: str) -> DataFrame:
    """Numbers rows from 1 inside each file: block by block, each moved up by the rows of the file's blocks before it."""
    d = d.select("*", block[1])
    counts = d.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_own", F.row_number().over(W.partitionBy("file", "_block").orderBy(order)))
    d = d.join(counts.select("file", "_block", before.alias("_before")), ["file", "_block"])
    return d.withColumn(out, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_own", "_before", "_block")


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines of text files numbered from 1 inside each file.

    A large file is read by many tasks: the lines of each split are numbered
    as they are read and moved up by the lines of the splits before.
    """
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"), "value")
    return _number(d, ["file", F.col("_start").alias("_block")], "_row", "line_no").select("file", "line_no", "value")


def scan_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, event_ids): sessions written as ids separated by blanks, one a line."""
    d = number_lines(spark, path).where(F.trim("value") != "")
    return d.select("line_no", F.transform(F.split(F.trim("value"), " +"), lambda x: x.cast("int")).alias("event_ids"))


#: How CSV files are written and read: blanks kept, quotes doubled.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def scan_csv(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """CSV with a header; empty strings stay '' instead of NULL.

    With ``lines`` a record is a line and large files are read by many tasks;
    without, fields may hold line breaks and a file is read by one.
    """
    d = spark.read.csv(path, schema=schema, multiLine=not lines, **CSV)
    return d.na.fill("", [f.name for f in d.schema if isinstance(f.dataType, T.StringType)])


def scan_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    """JSON lines, or one array a file with ``lines=False``; give a schema to read a large input once."""
    r = spark.read.option("multiLine", not lines)
    return (r.schema(schema) if schema else r).json(path)


def messages(d: DataFrame) -> DataFrame:
    """(msg): records that have a message; a null one counts as missing."""
    return d.where("message is not null").select(F.col("message").alias("msg"))


def paragraphs(texts: DataFrame, text: str = "value", least: int = 10) -> DataFrame:
    """(.., pos, paragraph): parts between blank lines, blanks squeezed, those under ``least`` characters dropped."""
    d = texts.select("*", F.posexplode(F.split(text, r"\n\s*\n")).alias("pos", "paragraph"))
    return d.withColumn("paragraph", F.trim(F.regexp_replace("paragraph", r"\s+", " "))).where(F.length("paragraph") >= least)


def scan_markdown_table(lines: DataFrame, columns: list[str], text: str = "value") -> DataFrame:
    """Rows '| 1 | .. |' of Markdown tables as columns; other lines are dropped."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(text), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    d = lines.where(F.col(text).rlike(r"^\s*\|\s*[0-9]+\s*\|")).select(cells.alias("c"))
    return d.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)])


def scan_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, values ARRAY<DOUBLE>, shape ARRAY<INT>) of saved numeric arrays; pickled objects are refused."""

    @F.pandas_udf(T.StructType().add("values", T.ArrayType(T.DoubleType())).add("shape", T.ArrayType(T.IntegerType())))
    def read(content: pd.Series) -> pd.DataFrame:
        import numpy as np

        got = [np.load(io.BytesIO(c), allow_pickle=False) for c in content]
        return pd.DataFrame({"values": [a.astype("float64").ravel().tolist() for a in got], "shape": [list(map(int, a.shape)) for a in got]})

    return spark.read.format("binaryFile").load(path).select("path", read("content").alias("z")).select("path", "z.values", "z.shape")


def load_config(path: str, overrides: dict | None = None) -> dict:
    """Configuration from JSON, or from YAML where its library is there; values of ``overrides`` that are not None replace the keys they name, 'a.b' going deeper."""
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("YAML needs its library; write the configuration as JSON") from e
            conf = yaml.safe_load(f) or {}
        else:
            conf = json.load(f)
    for k, v in (overrides or {}).items():
        if v is None:
            continue
        at = conf
        *up, last = k.split(".")
        for u in up:
            at = at.setdefault(u, {})
        at[last] = v
    return conf
