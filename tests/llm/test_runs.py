from datetime import datetime

from logquarry.llm import runs

SES = "sid long, event_ids array<string>, labels array<int>, idx array<long>, key string, m string"
TPL = [("E1", "Fan speed <*> low"), ("E2", "FAN-SPEED low <num>"), ("E3", "Fan speed lower"), ("E4", "<*>"), ("E5", None), (None, "x")]


def sessions(spark, rows):
    return spark.createDataFrame([(*r, "k", "m") for r in rows], SES)


def templates(spark):
    return spark.createDataFrame(TPL, "EventId string, EventTemplate string")


def found(spark, rows):
    return sorted(map(tuple, runs.found(sessions(spark, rows), templates(spark)).collect()))


def test_runs(spark):
    rows = [
        (1, ["E1", "E2", "E3", "E3", "E3", "E1"], [0, 0, 0, 0, 1, 1], [1, 2, 3, 4, 5, 6]), (1, ["E1", "E2", "E3", "E3", "E3", "E1"], [0, 0, 0, 0, 1, 1], [1, 2, 3, 4, 5, 6]),
        (2, ["E4", "E4", "E5", "E4"], [0] * 4, [1, 2, 3, 4]), (3, ["E9", "E9", None, None], [0, 0, None, None], [1, 2, 3, 4]), (4, [], [], []), (5, None, None, None), (6, ["E1", "E1"], [0], []), (7, ["E1"], [0], [1]),
    ]
    assert found(spark, rows) == [(1, 0, 2), (1, 2, 2), (2, 0, 2), (3, 0, 2), (3, 2, 2)]
    assert found(spark, []) == []
    assert runs.found(sessions(spark, rows), templates(spark).limit(0)).count() == 4


def test_large_dictionary_takes_the_join(spark, monkeypatch):
    rows = [(1, ["E1", "E2", "E3"], [0, 0, 0], [1, 2, 3]), (2, [None, "E4", "E4"], [0, 0, 0], [1, 2, 3])]
    a = found(spark, rows)
    monkeypatch.setattr(runs, "BROADCAST_TEMPLATES", 0)
    assert found(spark, rows) == a == [(1, 0, 2), (2, 1, 2)]


def test_long_session_and_many_symbols(spark):
    ids = [f"X{i // 2}" for i in range(60_000)]
    got = found(spark, [(1, ids[:6000], [0] * 6000, list(range(6000)))])
    assert len(got) == 3000 and got[-1] == (1, 5998, 2)
    assert found(spark, [(1, ["E1"] * 50_000, [0] * 50_000, None)]) == [(1, 0, 50_000)]


def test_durations(spark):
    log = spark.createDataFrame([(i, f"2025-01-01-00.00.{i:02d}.000500", "z") for i in (1, 3, 2)] + [(1, "2025-01-01-00.00.01.000500", "z"), (None, "x", "z"), (9, "junk", "z")], "idx long, Time string, sid string")
    rows = [(1, ["E1", "E2", "E3"], [0, 0, 0], [3, 1, 2]), (2, ["E1", "E1"], [0, 0], [1, 77])]
    got = {(r["sid"], r["start_pos"]): (r["n_events"], r["duration_us"], r["started"]) for r in runs.collapse(sessions(spark, rows), templates(spark), log).collect()}
    assert got[1, 0] == (2, 2_000_000, datetime(2025, 1, 1, 0, 0, 1, 500)) and got[1, 2][1] == 0
    assert got[2, 0][0] == 2 and got[2, 0][1] == 0


def test_duration_spans_all_rows_of_a_run(spark):
    log = spark.createDataFrame([(i, f"2025-01-01-00.00.{t:02d}.000000") for i, t in ((1, 20), (2, 5), (3, 21), (4, 30))], "idx long, Time string")
    rows = [(1, ["E1"] * 3, [0] * 3, [1, 2, 3]), (2, ["E1"] * 4, [0] * 4, [77, 1, 4, 78]), (3, ["E1"] * 2, [0] * 2, [77, 78])]
    got = {r["sid"]: (r["n_events"], r["first_idx"], r["last_idx"], r["duration_us"]) for r in runs.collapse(sessions(spark, rows), templates(spark), log).collect()}
    assert got == {1: (3, 1, 3, 16_000_000), 2: (4, 77, 78, 10_000_000), 3: (2, 77, 78, None)}
