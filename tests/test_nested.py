import json

import duckdb

from logquarry.operators import nested
from logquarry.plans.nested_sql import first_titles_sql

SCHEMA = "response_id long, status_code int, body string, extra string, root string"


def flat(spark, rows):
    df = spark.createDataFrame([(i, c, b, "x", "y") for i, (c, b) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, nested.found(df).collect()))


def test_shapes(spark):
    work = {"title": "T", "author": {"name": "a", "affiliation": ["x", None, {"name": "y"}]}, "DOI": "d", "indexed": {"date-parts": [2009, [None, 5]]}}
    got = flat(spark, [(200, json.dumps({"status": "ok", "message": work}))])
    assert got == sorted(
        [(0, 0, "item", -1, -1), (0, 0, "title", 0, -1), (0, 0, "author", 0, -1), (0, 0, "affiliation", 0, 0), (0, 0, "affiliation", 0, 2), (0, 0, "doi", -1, -1), (0, 0, "date_part", 0, 0), (0, 0, "date_part", 1, 1)]
    )


def test_list_text_and_single(spark):
    w = {"title": [None, "B", ""], "author": [], "DOI": None}
    bodies = [
        (200, json.dumps({"message": {"items": [w, None, w]}})),
        (200, json.dumps({"message": json.dumps({"items": w})})),
        (200, json.dumps({"message": {"items": None}})),
    ]
    assert flat(spark, bodies) == sorted([(0, 0, "item", -1, -1), (0, 0, "title", 1, -1), (0, 2, "item", -1, -1), (0, 2, "title", 1, -1), (1, 0, "item", -1, -1), (1, 0, "title", 1, -1)])


def test_errors_broken_null_and_empty(spark):
    bad = [(404, '{"message": {"title": "x"}}'), (200, '{"message": {"title": "x"'), (200, None), (200, ""), (200, "[]"), (200, '{"status": "failed", "message": {"title": "x"}}'), (200, '{"message": [1]}'), (200, '{"message": {"title": NaN}}')]
    assert flat(spark, bad) == []
    assert flat(spark, []) == []


def test_equal_subtrees_are_stored_once(spark):
    a = '{"message": {"author": [{"name": "q", "affiliation": []}, {"affiliation": [], "name": "q"}]}}'
    df = spark.createDataFrame([(1, 200, a), (2, 200, a.replace(" ", "  "))], "response_id long, status_code int, body string")
    t = nested.shred(df)
    assert t["answers"].count() == 2 and t["answers"].select("root").distinct().count() == 1
    authors = t["members"].where("key is null").collect()
    assert len(authors) == 2 and authors[0]["child"] == authors[1]["child"]
    assert nested.nodes(t["members"]).where("n_used = 2").count() >= 1
    assert t["works"].count() == 2 and t["nodes"].count() == 1


def test_documents_are_rebuilt_from_the_bridge(spark):
    """An exact round trip: every document comes back from its root and the members of distinct objects."""
    docs = [
        {"title": ["a", None, ""], "x": {"y": [1, 2.5, True, False, None, [], {}], "ü": "\u0000\n"}, "items": {"b": [[["deep"]]]}}, {"a": 1}, {"a": 1.0}, {"a": "1"}, {"a": True}, {"a": [1]}, {"a": {"": [1]}}, {"a": ["1", "2"]}, {"a": ["12", ""]}, {"a": None}, {},
    ]
    df = spark.createDataFrame([(i, 200, json.dumps({"message": d}), "x") for i, d in enumerate(docs * 2)], "response_id long, status_code int, body string, parent string")
    t = nested.shred(df.repartition(3))
    kids: dict = {}
    for r in t["members"].collect():
        kids.setdefault(bytes(r["parent"]), {})[r["ordinal"]] = r
    empty: dict = {}

    def build(ident, kind):
        rows = [kids.get(ident, empty)[i] for i in sorted(kids.get(ident, empty))]
        scalar = {"string": str, "number": json.loads, "bool": lambda v: v == "true", "null": lambda v: None}
        got = [(r["key"], build(bytes(r["child"]), r["kind"]) if r["child"] is not None else scalar[r["kind"]](r["value"])) for r in rows]
        return dict(got) if kind == "object" else [v for _, v in got]

    rebuilt = {r["response_id"]: build(bytes(r["root"]), "object") for r in t["answers"].collect()}
    assert all(json.dumps(rebuilt[i], sort_keys=True) == json.dumps(d, sort_keys=True) for i, d in enumerate(docs * 2))
    roots = {r["response_id"]: bytes(r["root"]) for r in t["answers"].collect()}
    assert len(set(roots.values())) == len(docs) and all(roots[i] == roots[i + len(docs)] for i in range(len(docs)))


def test_deep_and_long(spark):
    deep = '{"message": {"title": "t", "x": ' + "[" * 500 + "]" * 500 + "}}"
    long = json.dumps({"message": {"title": "z" * 300_000}})
    assert len(flat(spark, [(200, deep), (200, long)])) == 4


def test_a_hot_answer(spark):
    body = json.dumps({"message": {"items": [{"title": ["a"]}] * 3}})
    assert len(flat(spark, [(200, body)] * 2000)) == 12_000


def test_first_titles_of_every_envelope(spark):
    w = {"title": [None, "B", "C"]}
    bodies = [
        (200, json.dumps({"message": w})), (200, json.dumps({"message": {"title": "bare"}})), (200, json.dumps({"message": {"items": [None, w, {"title": "later"}]}})),
        (200, json.dumps({"message": json.dumps({"items": {"title": "text"}})})), (200, json.dumps({"message": {"items": [{"DOI": "d"}, w]}})), (200, json.dumps({"message": {"items": []}})),
        (404, json.dumps({"message": w})), (200, "{"), (None, json.dumps({"message": w})), (200, json.dumps({"message": {"items": ["x"], "title": "no"}})), (200, None),
    ]
    df = spark.createDataFrame([(i, c, b, i * 10) for i, (c, b) in enumerate(bodies)], "response_id long, status_code int, body string, citation_id long")
    got = sorted(map(tuple, nested.first_titles(df, ["citation_id"]).collect()))
    assert got == [(0, 0, "B"), (1, 10, "bare"), (2, 20, "B"), (3, 30, "text"), (8, 80, "B")]
    con = duckdb.connect()
    con.register("api_responses", df.toArrow())
    assert sorted(con.execute(f"WITH {first_titles_sql()} SELECT response_id, title FROM ft").fetchall()) == [(i, t) for i, _, t in got]
