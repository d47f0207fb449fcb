import numpy as np
import pandas as pd

from logquarry.sources import bibtex, logs, sinks
from logquarry.streaming import sessions as streaming

BIB = r"""﻿@string{jx = "Journal of X"}
@article{a1, author = {Garc\'{i}a, Jos\'e and The Committee, and Friends}, title = {A {{Nested} Title}}, year = {2022a}, journal = jx # " B", doi = {10.1/a}}
@article{bad, title = {never closed
@book(b2, title = "Quoted {"}inside", year = 1999)
"""


def test_bibtex(spark):
    r = bibtex.parse_bibtex(BIB)
    assert [x["entry_key"] for x in r] == ["a1", "b2"]
    assert r[0]["title"] == "A Nested Title" and r[0]["journal"] == "Journal of X B" and r[0]["author"].startswith("García, José")
    d = bibtex.scan_bibtex(spark.createDataFrame([("p", BIB), ("q", None), ("r", "")], "path string, text string")).collect()
    assert len(d) == 2 and d[0]["year"] == 2022 and d[0]["authors"] == ["García, José", "The Committee, and Friends"]
    assert bibtex.parse_bibtex("@") == [] and bibtex.parse_bibtex("@a{") == []


def test_log_formats(spark, tmp_path):
    df = spark.createDataFrame([("x.log 2025-01-01 [a1] hello wörld",), ("no match",), ("",)], "value string")
    r = logs.scan_log(df, r"<File> <Date> \[<Addr>\] <Content>").collect()
    assert [tuple(x) for x in r] == [("x.log", "2025-01-01", "a1", "hello w<NASCII>rld")]
    assert logs.format_fields(r"<A>  \[<B>\]") == (["A", "B"], r"^(.*?)\s+\[(.*?)\]$")
    big = [f"k{i} v{i}" if i % 3 else "-" for i in range(3000)]
    (tmp_path / "big.txt").write_text("\n".join(big) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = logs.number_lines(spark, str(tmp_path / "big.txt"))
        assert [r["value"] for r in got.orderBy("line_no").collect()] == big
        ids = logs.scan_log(got, "<K> <V>", line_id="LineId").orderBy("LineId").select("LineId", "K", "V", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = [i for i in range(3000) if i % 3]
    assert [tuple(r) for r in ids] == [(n + 1, f"k{i}", f"v{i}", i + 1) for n, i in enumerate(kept)]
    p = tmp_path / "s.txt"
    p.write_text("5 5 22 \n\n7\n")
    assert [tuple(x) for x in logs.scan_sessions(spark, str(p)).collect()] == [(1, [5, 5, 22]), (3, [7])]


def test_other_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n,1\nx,2\n")
    assert sorted(r["a"] for r in logs.scan_csv(spark, str(tmp_path / "c.csv"), "a string, b int").collect()) == ["", "x"]
    (tmp_path / "j.json").write_text('[{"message": "m"}, {"other": 1}]')
    assert [r["msg"] for r in logs.messages(logs.scan_json(spark, str(tmp_path / "j.json"), lines=False)).collect()] == ["m"]
    d = logs.paragraphs(spark.createDataFrame([("one  two\nthree\n\n short \n \nlast paragraph",)], "value string"))
    assert [r["paragraph"] for r in d.collect()] == ["one two three", "last paragraph"]
    t = logs.scan_markdown_table(spark.createDataFrame([("| # | p |",), ("|---|---|",), ("| 1 | x |",)], "value string"), ["no", "paper"])
    assert [tuple(r) for r in t.collect()] == [("1", "x")]
    np.save(tmp_path / "v.npy", np.arange(6.0).reshape(2, 3))
    v = logs.scan_arrays(spark, str(tmp_path / "v.npy")).first()
    assert v["values"] == [0, 1, 2, 3, 4, 5] and v["shape"] == [2, 3]
    (tmp_path / "k.json").write_text('{"a": {"b": 1}, "c": 2}')
    assert logs.load_config(str(tmp_path / "k.json"), {"a.b": 5, "c": None}) == {"a": {"b": 5}, "c": 2}


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, weight double")
    sinks.write_edges(e, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first()[0] == 'a b {"weight":0.5}'
    v = spark.createDataFrame([("raw", "OK", "doi")], "raw string, status string, lookup_mode string")
    sinks.write_json(sinks.audit_rows(v), str(tmp_path / "log"), append=True)
    sinks.write_json(sinks.audit_rows(v), str(tmp_path / "log"), append=True)
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    m = sinks.manifest(spark, str(tmp_path / "e"))
    assert sinks.manifest_differs(m, m).count() == 0
    s = spark.createDataFrame([([1, 2], "train")], "ids array<int>, split string")
    sinks.write_splits(s, str(tmp_path / "sp"))
    sinks.write_session_text(s, "ids", str(tmp_path / "tx"))
    sinks.write_structured(s, s, str(tmp_path / "st"))
    assert spark.read.parquet(str(tmp_path / "sp")).count() == 1


def test_streams_equal_batches(spark, tmp_path):
    rows = pd.DataFrame({"g": ["f"] * 45, "o": range(45), "t": [f"lease {i} lost" for i in range(45)]})
    for i in range(3):
        rows[i * 15 : i * 15 + 15].to_parquet(tmp_path / f"p{i}.parquet")
    st = streaming.event_stream(spark, str(tmp_path), spark.read.parquet(str(tmp_path)).schema)
    got = streaming.run_to_end(streaming.count_sessions(st, "g", "o")).collect()
    assert sorted(r["session"] for r in got) == [0, 1]
    mined = streaming.run_to_end(streaming.mine_stream(st, "g", "o", "t"))
    assert mined.count() == 45 and mined.where("o > 0").select("template").distinct().count() == 1


def test_streams_sessions_and_edges(spark, tmp_path):
    from logquarry.streaming import sessions as streaming

    rows = [(1, "a", "2025-01-01 00:00:00"), (1, "b", "2025-01-01 00:20:00"), (1, "a", "2025-01-01 02:00:00"), (2, "a", "2025-01-01 05:00:00"), (2, "a", "2025-01-02 05:00:00")]
    df = spark.createDataFrame(rows, "u long, k string, t string").selectExpr("u", "k", "cast(t as timestamp) t")
    df.orderBy("t").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = sorted((r["entity"], r["n"]) for r in streaming.gap_sessions(df, "t", "u").collect())
    assert batch == [(1, 1), (1, 2), (2, 1), (2, 1)]
    st = streaming.event_stream(spark, str(tmp_path / "in"), df.schema)
    got = sorted((r["entity"], r["n"]) for r in streaming.run_to_end(streaming.gap_sessions(st, "t", "u")).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]  # the last one may still go on
    edges = streaming.keep_edges(streaming.event_stream(spark, str(tmp_path / "in"), df.schema).selectExpr("cast(u as string) src", "k dst"), str(tmp_path / "out"))
    assert sorted(map(tuple, edges.collect())) == [("1", "a", 2), ("1", "b", 1), ("2", "a", 2)]
    again = streaming.keep_edges(streaming.event_stream(spark, str(tmp_path / "in"), df.schema).selectExpr("cast(u as string) src", "k dst"), str(tmp_path / "out"))
    assert again.count() == 3


def test_mining_a_stream(spark, tmp_path):
    from logquarry.streaming import sessions as streaming

    df = spark.createDataFrame([("f", i, f"lease {'xyz'[i % 3]}{i} lost now") for i in range(6)] + [("f", 6, None)], "g string, o long, t string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    st = streaming.event_stream(spark, str(tmp_path / "in"), df.schema)
    got = {r["o"]: r["template"] for r in streaming.run_to_end(streaming.mine_stream(st, "g", "o", "t")).collect()}
    assert len(got) == 7 and got[5] == "lease <*> lost now" and got[6] == "<empty>"


def test_command_line(spark, tmp_path, capsys):
    from logquarry.__main__ import main

    assert main(["list"]) == 0 and "event_transitions" in capsys.readouterr().out
    assert main(["run", "nothing", "--data", "x"]) == 1
    assert main(["run", "markdown_rows", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "o"), "--format", "csv"]) == 0
    assert logs.scan_csv(spark, str(tmp_path / "o"), "no string, name string, region string").count() == 25


def test_links_and_clusters_are_refused(spark, tmp_path):
    import types

    import pytest

    from logquarry import session
    from logquarry.sources import sinks

    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    with pytest.raises(ValueError):
        sinks.write_json(spark.range(1), str(tmp_path / "link"))
    jsc = types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: False)))
    fake = types.SimpleNamespace(conf={}, sparkContext=types.SimpleNamespace(_jsc=jsc, master="spark://host:7077"))
    fake.conf = types.SimpleNamespace(get=lambda k, v: v)
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)
    fake.conf = types.SimpleNamespace(get=lambda k, v: "hdfs:///shared")
    assert session.shared_dir(fake) == "hdfs:///shared"
