from logquarry.operators import logparse

SCHEMA = "LineId long, Logrecord string, Date string, Time string, Level string, Component string, Content string, layout string"


def parse(spark, rows, whole=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, (logparse.entries(df).select("first_line", "message", "ts") if whole else logparse.found(df)).collect()))


def raw(i, text, rec="a.log"):
    return (i, rec, None, None, None, None, text, "x")


LINES = [
    ("2025-01-02 03:04:05,678 - app.x - WARNING - slow", "WARN", "app.x"),
    ("[2025-01-02T03:04:05.678+0200] [error] [a.B] oops", "ERROR", "a.B"),
    ("02-Jan-2025 03:04:05.678 INFO [pool-1] netio hello", "INFO", "netio"),
    ("250102 030405 77 FATAL core: bye", "FATAL", "core"),
    ("E0102 03:04:05.678901 77 core:12] bad", "ERROR", "core"),
    ("1755996220948|C|graphd|x|y", "FATAL", "graphd"),
    ("<27>1 2025-01-02T03:04:05Z h app 12 - - m", "ERROR", "app"),
    ("Jan  2 03:04:05 h app.y[12]: m", "", "app.y"),
    ("- 1737007264 2025.01.16 n1 2025-01-16-06.01.04.489682 n1 RAS KERNEL INFO up", "INFO", "KERNEL"),
    ('msg="a b" level=debug time=2025-01-02T03:04:05Z component=c', "DEBUG", "c"),
    ('{"lvl": "warn", "ts": "2025-01-02T03:04:05Z", "msg": "m", "name": "n"}', "WARN", "n"),
]


def test_layouts(spark):
    got = parse(spark, [raw(i, t) for i, (t, _, _) in enumerate(LINES)])
    assert got == [(i, i, lv, c) for i, (_, lv, c) in enumerate(LINES)]


def test_messages_and_times(spark):
    got = parse(spark, [raw(0, LINES[0][0] + "\n  more"), raw(1, LINES[10][0]), raw(2, LINES[7][0])], whole=True)
    assert [g[1] for g in got] == ["slow\n  more", "m", "m"]
    assert got[0][2].isoformat() == "2025-01-02T03:04:05.678000" and got[2][2] is None


def test_continuations_stay_with_their_file(spark):
    rows = [
        raw(1, "before any entry"), raw(2, LINES[0][0]), raw(3, LINES[2][0], "b.log"), raw(4, "Traceback (most recent call last):"), raw(5, ""), raw(6, None),
        raw(7, "  > 2025-02-02 00:08:25,120 - q - INFO - quoted"), raw(8, "tail", "b.log"), raw(9, "{"), raw(10, '  "k0": 3,'), raw(11, "}"),
        (12, "a.log", "2025-01-02", "03:04:05", "crazy", "comp", "text", "x"), raw(13, "INFO: not a header"), raw(14, LINES[3][0], None), raw(15, "x", None),
    ]
    assert parse(spark, rows) == [(2, 11, "WARN", "app.x"), (3, 8, "INFO", "netio"), (12, 13, "", "comp"), (14, 15, "FATAL", "core")]


def test_headers_over_several_rows(spark):
    rows = [
        raw(1, "{"), raw(2, ' "time": "2025-01-02T03:04:05Z",'), raw(3, ' "severity": "INFO",'), raw(4, ' "message": "m",'), raw(5, ' "component": "c"'), raw(6, "}"), raw(7, "{"), raw(8, '  "k": 1'), raw(9, "}"),
        raw(10, "Jan 2, 2025 3:04:05 PM comp"), raw(11, "CRITICAL: m"), raw(12, "Jan 2, 2025 3:04:05 PM comp\nDEBUG: m"), raw(13, '{\n "ts": "2025-01-02T03:04:05Z",\n "msg": "m",\n "level": "error",\n "logger": "l"\n}\nmore'),
    ]
    assert parse(spark, rows) == [(1, 9, "INFO", "c"), (10, 11, "FATAL", "comp"), (12, 12, "DEBUG", "comp"), (13, 13, "ERROR", "l")]


def test_empty_long_and_repeated(spark):
    assert parse(spark, []) == []
    long = LINES[0][0] + " w" * 20_000
    assert parse(spark, [raw(1, long), raw(1, long), raw(2, "y" * 100_000)]) == [(1, 2, "WARN", "app.x")]


def test_order_of_rows_does_not_matter(spark):
    rows = [raw(i, t) for i, (t, _, _) in enumerate(LINES)]
    assert parse(spark, rows[::-1]) == parse(spark, rows)


def test_carry_over_chunks(spark):
    far = logparse.CHUNK * 3 + 5
    assert parse(spark, [raw(1, LINES[0][0]), raw(far, "tail")]) == [(1, far, "WARN", "app.x")]


def test_templates_have_constants_and_slots(spark):
    rows = [(f"2025-01-02 03:04:05,678 - c{'abcdefgh'[i % 8]} - INFO - user {w} left",) for i, w in enumerate(["ann", "bob", "cy", "di"] * 8)]
    shapes, words = logparse.templates(spark.createDataFrame(rows, "first string"))
    got = shapes.collect()
    assert sum(r["rows"] for r in got) == 32 and all("INFO <*> user" in r["template"] for r in got)
    assert logparse.layouts(shapes, words)["DT"] == {"hththt": {"level": 3, "comp": 1, "end": 5}}


def test_leaves_of_the_partitioning():
    plain = [("a", "x", c, w, v) for c in "pqstu" for w, v in (("one", "two"), ("six", "ten"), ("red", "sea"), ("old", "man"))]
    leaves = logparse.split_shapes(plain)
    assert sorted(i for leaf in leaves for i in leaf) == list(range(20))
    assert {" ".join(logparse.template_of([plain[i] for i in leaf])[3:]) for leaf in leaves} == {"one two", "six ten", "red sea", "old man"}
    assert len(logparse.split_shapes([("a",)])) == 1


MESSAGES = ["pool low on disk", "lease lost by peer", "index rebuilt after crash", "ERROR flag set again", "quota check passed late", "volume attached to node"]


def other_layouts():
    """Three layouts that no rule names: (text, level, component); messages come round in another step than components."""
    comps = ["disk.pool", "lease-mgr", "netio", "store", "core.Audit"]
    out = []
    for i in range(60):
        m, c, lv = MESSAGES[i % 6] + f" {i}", comps[i // 6 % 5], ["INFO", "WARN", "ERROR"][i % 3]
        at = f"10:{i % 60:02d}:{(i * 7) % 60:02d}"
        out += [
            (f"2026/01/05 {at} {lv} {c}: {m}", lv, c),
            (f"{at}.{i:03d} [main-{i % 4}] {lv} {c} - {m}", lv, c),
            (f"2026-01-05T{at}Z {lv} {c} {m}", lv, c),
            (f"[05/Jan/2026:{at}] {lv} {m}", lv, ""),  # no component: the words after the level are message
        ]
    return out


def test_layouts_that_no_rule_names(spark):
    lines = other_layouts()
    got = parse(spark, [raw(i, t) for i, (t, _, _) in enumerate(lines)])
    assert got == [(i, i, lv, c) for i, (_, lv, c) in enumerate(lines)]


def test_rows_rest_on_the_partitioning(spark, monkeypatch):
    """Without it, values after a message's first word look like other words, and that word like a component."""
    hosts = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    lines = [f"2026/01/05 10:00:{i:02d} INFO {a} {hosts[i % 6]} {b}" for i in range(24) for a, b in [(("lease", "was lost"), ("volume", "was attached"), ("worker", "has restarted"))[i % 3]]]
    rows = [raw(i, t) for i, t in enumerate(lines)]
    with_it = parse(spark, rows)
    assert with_it == [(i, i, "INFO", "") for i in range(24)]
    df = spark.createDataFrame([(t,) for t in lines], "first string")
    shapes, words = logparse.templates(df)
    each = words.select("opening", "prefix", "word", "follower", "rows")
    assert {r["follower"] for r in each.where("word in ('lease', 'volume', 'worker')").collect()} == {"<*>"}
    # the same evidence from lines that are no leaves: every shape its own template
    spec = logparse.layouts(shapes, spark.createDataFrame([("DT", "t", a, h, 4) for a in ("lease", "volume", "worker") for h in hosts[:2]], words.schema.simpleString()[7:-1].replace(":", " ")))
    assert logparse.read_header(lines[0], lines[0], spec).component == "lease"


def test_message_has_the_text_of_all_rows(spark):
    rows = [
        raw(1, LINES[0][0]), raw(2, LINES[3][0], "b.log"), raw(3, "Traceback:"), raw(4, None), raw(5, "  at x\n  at y"), raw(6, "tail", "b.log"), raw(7, "{"), raw(8, '  "k": 1'), raw(9, "}"),
        raw(10, "Jan 2, 2025 3:04:05 PM comp"), raw(11, "CRITICAL: m"), raw(12, "  at z"), raw(13, "Jan 2, 2025 3:04:05 PM comp\nCRITICAL: m\n  at z"), raw(14, "Jan 2, 2025 3:04:05 PM comp"), raw(15, "no level"),
        raw(16, "{"), raw(17, ' "time": "2025-01-02T03:04:05Z",'), raw(18, ' "message": "m"'), raw(19, "}"), raw(20, "more"), raw(21, '{\n "ts": "2025-01-02T03:04:05Z",\n "msg": "m"\n}\nmore'),
        (22, "a.log", "2025-01-02", "03:04:05", "INFO", "comp", "text", "x"), raw(23, "wrapped"), raw(24, "{"), raw(25, "open"),
    ]
    got = {i: m for i, m, _ in parse(spark, rows, whole=True)}
    assert got == {1: 'slow\nTraceback:\n\n  at x\n  at y\n{\n  "k": 1\n}', 2: "bye\ntail", 10: "m\n  at z", 13: "m\n  at z", 14: "\nno level", 16: "m\nmore", 21: "m\nmore", 22: "text\nwrapped\n{\nopen"}
