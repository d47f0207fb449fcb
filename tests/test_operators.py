import math
import random

import pytest
from pyspark.sql import functions as F

from logquarry.functions import text as T
from logquarry.functions.vectors import cosine, search
from logquarry.operators import graph, match, metrics, sessions, temporal, templates, value


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr).first()[0]


def test_numbering_equals_a_global_order(spark):
    xs = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    got = {r["x"]: r["rn"] for r in sessions.number_rows(df, ["x"], F.floor(F.col("x") / 100)).collect()}
    assert got == {x: i + 1 for i, x in enumerate(sorted(xs))}
    s = sessions.fixed_sessions(sessions.number_rows(df, ["x"], F.floor(F.col("x") / 100))).groupBy("sid").count().collect()
    assert sorted(r["count"] for r in s) == [20] * 25


def test_transitions(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 22), (1, 3, 11), (2, 1, 7)], "s long, o long, e long")
    got = sorted(map(tuple, sessions.transitions(df, "s", ["o"], "e").collect()))
    assert got == [(1, 1, 5, 22, 1.0, False), (1, 2, 22, 11, 50.0, True)]
    assert {r["reward"] for r in sessions.transitions(df, "s", ["o"], "e", negative=True).collect()} == {-1.0}
    assert sessions.transitions(df.limit(0), "s", ["o"], "e").count() == 0


def test_values_and_flags(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 22), (1, 3, 11), (2, 1, 22), (2, 2, 11), (3, 1, 9)], "s long, o long, e long")
    q = value.values(sessions.transitions(df, "s", ["o"], "e"), 12, cut_every=4)
    v = {r["state"]: r["q"] for r in q.collect()}
    assert v[22] == pytest.approx(50) and v[5] == pytest.approx(1 + 0.99 * 50)
    f = value.flag_sessions(df, "s", ["o"], "e", q, spark.createDataFrame([(11,)], "final_state long"), 50.2)
    assert sorted(map(tuple, f.collect())) == [(1, True, False, True), (2, True, False, True), (3, False, True, True)]


def test_split_and_text(spark):
    k = spark.createDataFrame([(i,) for i in range(50)], "k long")
    s = sessions.md5_split(k, "k")
    assert s.where("split = 'train'").count() == 40
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, sessions.md5_split(k.repartition(7), "k").collect()))
    t = spark.createDataFrame([([1, 2],), ([],)], "ids array<int>")
    assert sorted(r[0] for r in sessions.session_text(t, "ids", True).collect()) == [" ", "1 2 "]


def test_metrics(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "t boolean, g boolean")
    assert tuple(metrics.prf_percent(df, F.col("t"), F.col("g")).first()) == (1, 1, 1, 50.0, 50.0, 50.0)
    none = df.where("not t and not g")
    assert tuple(metrics.prf_percent(none, F.col("t"), F.col("g")).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    m = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "t string, g string")
    assert tuple(metrics.macro_prf(m, "t", "g").first()) == (round(1 / 3, 6), round(0.5 / 3, 6), round(2 / 9, 6))
    ap = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1)], "q int, rank int, hit int")
    assert metrics.average_precision(ap, 5).first()["ap"] == pytest.approx(0.833333)
    e = spark.createDataFrame([(0.5,), (-3.0,), (800.0,)], "e double")
    r = metrics.losses(e, F.col("e")).first()
    assert r["huber"] == pytest.approx((0.125 + 2.5 + 799.5) / 3, abs=1e-5) and not math.isinf(r["logcosh"])
    z = spark.createDataFrame([([2.0, 1.0, 0.0], 1)], "z array<double>, y int")
    p = math.exp(1) / sum(map(math.exp, [2, 1, 0]))
    assert metrics.focal_loss(z, "z", "y").first()["focal"] == pytest.approx(-((1 - p) ** 2) * math.log(p))


TITLES = [
    ("Large Language Models", "Large Language Models: An Applied Econometric Framework", "WEAK_MATCH", 0.666667),
    ("Very Very Deep Learning for Images", "Very Deep Learning for Images", "STRONG_MATCH", 0.888889),
    ("Can You Build a Better Cop", "Can You Build a Better Cop Experimental Evidence on Supervision Training and Policing in the Community", "WEAK_MATCH", 0.625),
    ("Deep Learning", "Deep Learning for Causal Inference in Tax Fraud Detection", "INSUFFICIENT", 0.0),
    ("Capital", "Capital in the Twenty-First Century", "INSUFFICIENT", 0.0),
    ("Capital", "Capital", "EXACT", 1.0),
    ("Regression Modeling Strategies, 2nd edition", "Regression Modeling Strategies", "EXACT", 1.0),
    ("Über graph learning", "Uber Graph Learning", "EXACT", 1.0),
    (r"The $\alpha$ \emph{Stable} Process Noise", "the stable process noise", "EXACT", 1.0),
    ("Neural topic models for text", "Sparse signal recovery in radar", "MISMATCH", 0.0),
    (None, "Anything at all here", "INSUFFICIENT", 0.0),
]


def test_title_match(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(TITLES)], "i int, a string, b string")
    got = {r["i"]: (r["verdict"], r["f1"]) for r in match.title_match(df, "a", "b").collect()}
    assert got == {i: (v, f) for i, (_, _, v, f) in enumerate(TITLES)}
    adv = match.containment_advisory(match.title_match(df, "a", "b")).where("advisory").select("i").collect()
    assert {r[0] for r in adv} == {0, 2}


def test_citation_text(spark):
    raw = "Card, David and Smith-Jones, A. (2022a). A Title: Of Work. Journal X. NBER Working Paper 33344 10.1000/ab.c1."
    df = spark.createDataFrame([(raw,), ("no year here",), (None,), ("",)], "r string")
    r = F.col("r")
    got = df.select(T.extract_surnames(r), T.extract_year(r), T.extract_title(r), T.extract_doi(r), T.extract_nber(r), T.extract_arxiv(r)).collect()
    assert tuple(got[0]) == (["Card", "David", "Smith-Jones"], 2022, "A Title: Of Work", "10.1000/ab.c1", "33344", None)
    assert tuple(got[1])[1:] == (None,) * 5 and tuple(got[3])[1:] == (None,) * 5
    assert one(spark, T.extract_arxiv(F.col("x")), x="see arXiv:1706.03762v5 ok") == "1706.03762"
    assert one(spark, T.extract_arxiv(F.col("x")), x="10.5555/3295222.3295349") is None
    assert [one(spark, T.doi_valid(F.col("x")), x=x) for x in ("10.1/a", "10.1/a..b", "11.1/a", None)] == [True, False, False, False]
    assert one(spark, T.nber_doi(F.col("x")), x="w33344") == "10.3386/w33344"


def test_status_report_and_sibling(spark):
    rows = [(1, "VERIFIED", "a", None, ["Card, D."], 2001, "T"), (2, "NOT_FOUND", "b", None, None, None, "b *x*"), (3, "NOT_FOUND", "b", None, [], None, None)]
    v = spark.createDataFrame(rows, "index int, status string, raw string, doi string, authors array<string>, year int, title string")
    text = match.report(v)
    assert "[X] NOT_FOUND: 2" in text and "[!] METADATA_MISMATCH: 0" in text and r"\*x\*" in text and "b: 2 times" in text
    assert text.index("## Critical issues") < text.index("## All findings") and text.count("**[NOT_FOUND]**") == 4 and text.count("Card, D. 2001 T") == 1
    assert match.failed(v) and not match.failed(v.where("index = 1"))
    d = spark.sql("""SELECT named_struct('type', 'book-chapter', 'doi', 'd', 'title', 't') top, array(named_struct('type', 'book', 'doi', 'e', 'title', 't', 'first_author', 'David Card', 'f1', 0.9D)) siblings, 'Card, David' first_author""")
    assert match.book_sibling(d).first()["sibling"]["doi"] == "e"


def test_search_blocks_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if any(a) and any(b) else 0.0
    want = {(q, k) for q, a in rows if a and q % 20 == 0 for k in sorted((k for k, b in rows if b and k != q), key=lambda k: (-round(cos(a, dict(rows)[k]), 12), k))[:4]}
    got = {(r["q"], r["key"]) for r in search(df, df.where("id % 20 = 0"), "id", "v", k=4).collect()}
    assert got == want
    c = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert c.select(cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_pairs_and_greedy_alignment(spark):
    rnd = random.Random(5)
    bags = {i: [rnd.choice("abcdef") for _ in range(rnd.randint(1, 5))] for i in range(40)}
    df = spark.createDataFrame(list(bags.items()), "id long, words array<string>")

    def cos(a, b):
        ca, cb = {w: a.count(w) for w in a}, {w: b.count(w) for w in b}
        return sum(n * cb.get(w, 0) for w, n in ca.items()) / math.sqrt(sum(n * n for n in ca.values()) * sum(n * n for n in cb.values()))

    want = {(i, j) for i in bags for j in bags if i < j and cos(bags[i], bags[j]) >= 0.8 - 1e-12}
    pairs = graph.bag_cosine_pairs(df, 0.8)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    used, rep = set(), {}
    for i in sorted(bags):
        if i not in used:
            for j in sorted(bags):
                if j == i or (j > i and j not in used and (i, j) in want):
                    used.add(j)
                    rep[j] = i
    assert {r["member"]: r["rep"] for r in graph.greedy_align(df.select("id"), pairs).collect()} == rep


def test_graph(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "c"), (3, None)], "g long, x string")
    e = graph.cooccurrence(df, "g", "x")
    assert sorted(map(tuple, e.collect())) == [("a", "b", 1), ("a", "c", 1)]
    assert {r["node"]: r["degree"] for r in graph.degree(e).collect()} == {"a": 2, "b": 1, "c": 1}
    r = graph.reach(e, spark.createDataFrame([("b",)], "node string"), 2)
    assert {x["node"]: x["hops"] for x in r.collect()} == {"b": 0, "a": 1, "c": 2}
    t = graph.triples(spark.createDataFrame([("so (disk, fills, node) and (a, b, c)",)], "t string"), "t").first()["triples"]
    assert [tuple(x) for x in t] == [("disk", "fills", "node"), ("a", "b", "c")]
    p = graph.prompt(spark.createDataFrame([("sum", ["e1", "e2"], [0.5, 0.25])], "s string, e array<string>, c array<double>"), "s", "e", "c").first()["prompt"]
    assert "sum" in p and "e2" in p and "0.2500" in p


def test_temporal(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2025, 1, 1)
    ev = [(i, t0 + timedelta(seconds=s), u, k) for i, (s, u, k) in enumerate([(0, 1, "a"), (10, 1, "b"), (10, 1, "a"), (4000, 1, "b"), (5, 2, "b"), (7300, 2, "a")])]
    df = spark.createDataFrame(ev, "id long, ts timestamp_ntz, u long, k string")
    want = {}
    for _, ta, ua, ka in ev:
        for _, tb, ub, kb in ev:
            if ua == ub and ta < tb:
                want[ka, kb] = want.get((ka, kb), 0) + 1
    assert {(r["cause"], r["effect"]): r["n"] for r in temporal.ordered_pair_counts(df.drop("id"), "u", "ts", "k").collect()} == want
    w = temporal.within(df, "u", "ts", "id", "k", "a", "b", 3990)
    assert {(r["cause_id"], r["effect_id"]) for r in w.collect()} == {(0, 1), (2, 3)}
    assert temporal.bins(df, "ts", "k", "hour", fill=True).count() == 3
    assert temporal.bins(df.limit(0), "ts", "k", "hour", fill=True).count() == 0
    assert temporal.conflicts(df, "u", "ts", "k").count() == 1
    assert {r["id"] for r in temporal.last_n(df, ["ts", "id"], 2).collect()} == {3, 5}


def test_a_chain_that_is_too_long_is_refused(spark):
    ids = spark.range(4)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert {r["member"]: r["rep"] for r in graph.greedy_align(ids, pairs, rounds=4).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    with pytest.raises(ValueError):
        graph.greedy_align(ids, pairs, rounds=3)


def test_whole_citations_are_read_without_caps(spark):
    many = ", ".join(f"Name{chr(97 + i)}" for i in range(15))
    df = spark.createDataFrame([(f"{many} (2001). {'word ' * 150}end. Journal",), ("x " * 120 + "Late",)], "raw string")
    a, b = df.select(T.extract_surnames(F.col("raw"), None, None), T.extract_title(F.col("raw"), None)).collect()
    assert len(a[0]) == 15 and a[1] == "word " * 150 + "end" and b[0] == ["Late"] and b[1] is None


def test_a_row_takes_no_place_in_its_own_search(spark):
    t = spark.createDataFrame([(i, "deep graph mining") for i in range(7)], "id long, title string")
    got = match.best_by_tokens(t.where("id = 2"), t.withColumnRenamed("id", "other"), itself=False)
    assert [(r["other"], r["rank"]) for r in got.orderBy("rank").collect()] == [(0, 1), (1, 2), (3, 3), (4, 4), (5, 5)]


def test_miner():
    m = templates.Miner(0.5)
    assert m.add("a b c d".split()) == 0 and m.add("a b x d".split()) == 0
    assert m.templates[0] == ["a", "b", "<*>", "d"]
    assert m.add("q r s".split()) == 1 and m.add([]) == -1
    assert m.tree() == ["a (1)", "  b (1)", "    d (1, template 0)", "q (1)", "  r (1)", "    s (1, template 1)"]
    a = templates.Alignment(list("abcbdab"), list("bdcaba"))
    assert a.length == 4 and a.words() == list("bcba") and templates.Alignment(["a"], []).words() == []
    assert templates.widen(list("abca"), ["a"]) == ["a", "<*>"] and templates.widen(list("xaby"), ["a", "y"]) == ["<*>", "a", "<*>", "y"] and templates.widen(["a"], []) == []
    assert templates.parameters("worker 12 up in 3 s", "worker <*> up in <*> s") == ["12", "3"]
    assert templates.parameters(None, "a <*>") == [] and templates.parameters("b", "a <*>") == []
    assert templates.parameters("x a  b a", "<*> a") == ["x a b"] and templates.parameters("a b", "a b") == []


def test_miner_numbers_only_grow_and_fit(spark):
    """Against plain readings of the rules: subsequence lengths by dynamic programming, the set rule by a scan."""
    rnd = random.Random(3)

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    m = templates.Miner()
    for _ in range(400):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))]
        for t in m.templates[:20]:
            a = templates.Alignment(words, t)
            kept, rest, place = a.words(), iter(words), iter(t)
            assert a.length == plain(words, t) == len(kept) and all(w in rest for w in kept) and all(w in place for w in kept)
        want = next((n for n, t in enumerate(m.templates) if len(t) >= 0.5 * len(words) and {*words, "<*>"}.issuperset(t)), None)
        assert m._by_words(words) == want
        n = m.add(words)
        assert all({*m.templates[n]} <= m.having.keys() and n in m.having[w] for w in m.templates[n])
    df = spark.createDataFrame([("worker 12 up", "worker <*> up"), (None, "x"), ("a", None)], "t string, p string")
    assert [r["parameters"] for r in templates.with_parameters(df, "t", "p").collect()] == [["12"], [], []]


def test_a_small_file_is_mined_whole_wherever_its_lines_lie(spark):
    texts = ["open file a now", "close b", "open file c now", "x y z w", "open dir c now", "x q z w", "close b fast", "open dir d soon"]
    m = templates.Miner()
    at = [m.add(t.split()) for t in texts]
    for start in (0, 5, 6, 8, 100):
        df = spark.createDataFrame([("g", start + 2 * i, t) for i, t in enumerate(texts)] + [("h", start + 2 * i + 1, "x") for i in range(20)], "g string, LineId long, t string")
        got = templates.mine(df, "g", "LineId", "t", chunk=8).where("event_id like 'g:%'").orderBy("LineId").collect()
        assert [(r["template"], r["event_id"]) for r in got] == [(" ".join(m.templates[n]), f"g:{n + 1}") for n in at]


def test_mining_lines(spark):
    rows = [(i, "f", f"lease {'xyz'[i % 3]}{i} lost now") for i in range(30)] + [(30, "f", ""), (31, None, None)]
    df = spark.createDataFrame(rows, "LineId long, g string, t string")
    got = {r["LineId"]: r["template"] for r in templates.mine(df, "g", "LineId", "t", chunk=7).collect()}
    assert len(got) == 32 and {got[i] for i in range(30)} == {"lease <*> lost now"} and got[30] == got[31] == "<empty>"


def test_title_search_is_exact(spark):
    rnd = random.Random(11)
    words = ["deep", "sparse", "graph", "log", "event", "session", "storage", "kernel", "trace", "queue"]
    rows = [(i, " ".join(rnd.sample(words, rnd.randint(1, 6)))) for i in range(80)] + [(80, None), (81, "of the and")]
    df = spark.createDataFrame(rows, "other long, title string")
    sets = {i: set(t.split()) for i, t in rows[:80]}
    f1 = lambda a, b: round(2 * len(a & b) / (len(a) + len(b)), 6)
    want = {(q, o) for q in sets if q % 20 == 0 for o in sorted((o for o in sets if f1(sets[q], sets[o]) >= 0.7), key=lambda o: (-f1(sets[q], sets[o]), o))[:5]}
    got = match.best_by_tokens(df.where("other % 20 = 0").withColumnRenamed("other", "id"), df).collect()
    assert {(r["id"], r["other"]) for r in got} == want


def test_small_operators(spark):
    from logquarry.operators import small

    d = spark.createDataFrame([(0,), (2,), (None,)], "s int")
    assert [r[0] for r in d.select(small.one_hot(F.col("s"), 3)).collect()] == [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0], None]
    with pytest.raises(Exception, match="not in"):
        spark.createDataFrame([(3,)], "s int").select(small.one_hot(F.col("s"), 3)).collect()
    p = spark.createDataFrame([(2025, "I", True), (2023, "I", True), (2025, "II", True), (2025, "I", None)], "year int, tier string, has_code boolean")
    assert small.literature_filter(p).count() == 1
    assert one(spark, small.input_kind(F.col("a"), F.col("b")), a="x.BIB", b="text") == "bibtex"
    w = spark.range(1).select(small.weighted_score(*[F.lit(x) for x in (1.0, 1.0, 1.0, 1.0, 1.0)])).first()[0]
    assert w == pytest.approx(0.8)
    assert small.line_stats(spark.createDataFrame([("a b\nccc",), (None,)], "t string"), "t").first() == (2, 3, 3)


def test_lookup_by_identifier_then_title(spark):
    import json

    from logquarry.operators import records

    works = [{"DOI": "10.1/AB", "title": ["Deep Sparse Graph Search"], "type": "book-chapter", "author": [{"family": "Card"}]}, None, {"title": "Deep Sparse Graph Search Again", "type": "book", "author": {"name": "David Card"}, "issued": {"date-parts": [[2020, 1]]}}]
    api = spark.createDataFrame([(1, 200, json.dumps({"message": {"items": works}})), (2, 200, json.dumps({"message": {"DOI": "10.3386/w123", "title": [], "created": {"date-parts": 1999}}})), (3, 404, "{}"), (4, 200, None)], "response_id long, status_code int, body string")
    r = records.records(api)
    assert sorted((x["response_id"], x["item_pos"], x["doi"], x["title"], x["year"], x["n_authors"], x["first_author"]) for x in r.collect()) == [
        (1, 0, "10.1/AB", "Deep Sparse Graph Search", None, 1, "Card"), (1, 2, None, "Deep Sparse Graph Search Again", 2020, 1, "David Card"), (2, 0, "10.3386/w123", None, 1999, 0, None),
    ]
    c = spark.createDataFrame([(10, "10.1/ab", None, "x", ["David Card"]), (11, None, "w123", "y", None), (12, "10.9/none", None, "deep sparse graph search", ["Card, D."]), (13, None, None, None, []), (14, "", "", "nothing like it", None)], "citation_id long, doi string, nber_number string, title string, authors array<string>")
    got = sorted((x["citation_id"], x["how"], x["rank"], x["response_id"], x["item_pos"]) for x in records.exact_then_fuzzy(c, r).collect())
    assert got == [(10, "doi", 1, 1, 0), (11, "nber", 1, 2, 0), (12, "search", 1, 1, 0), (12, "search", 2, 1, 2)]
    looked = spark.createDataFrame([(12, 1), (10, 1)], "citation_id long, response_id long")
    assert [(x["citation_id"], x["item_pos"]) for x in records.siblings(c, looked, r).collect()] == [(12, 2)]
    assert records.records(api.limit(0)).count() == 0 and records.by_identifier(c, r.limit(0)).where("response_id is not null").count() == 0


def test_titles_that_many_rows_carry(spark):
    rows = [(i, "deep sparse graph search") for i in range(600)] + [(600, "deep sparse graph"), (601, None), (602, "")]
    df = spark.createDataFrame(rows, "other long, title string")
    got = match.best_by_tokens(df.where("other in (0, 599, 600)").withColumnRenamed("other", "id"), df, itself=False).collect()
    by = {q: sorted((r["rank"], r["other"]) for r in got if r["id"] == q) for q in (0, 599, 600)}
    assert by[0] == [(i, i) for i in range(1, 6)] and by[599] == [(i + 1, i) for i in range(5)] and by[600] == [(i + 1, i) for i in range(5)]


def test_small_text_operators(spark):
    from logquarry.functions import text as T

    assert one(spark, T.percent_encode(F.col("x")), x="a b*~/é+") == "a%20b%2A~%2F%C3%A9%2B"
    assert one(spark, T.merge_objects(F.col("a"), F.col("b")), a='{"k": 1, "x": [1]}', b='{"k": "v"}') in ('{"x":[1],"k":"v"}', '{"k":"v","x":[1]}')


def test_word_vectors_and_clusters(spark):
    from logquarry.plans import learning

    d = spark.createDataFrame([(["disk", "full", "node", "down"],)] * 20, "w array<string>")
    v = learning.word_vectors(d, "w", size=8)
    assert {r["word"] for r in v.getVectors().collect()} == {"disk", "full", "node", "down"} and len(v.getVectors().first()["vector"]) == 8
    pts = spark.createDataFrame([(i, [float(i % 2) * 10 + i / 100, 1.0]) for i in range(20)], "i int, e array<double>")
    got = {r["i"]: r["cluster"] for r in learning.clusters(pts, "e", 2).collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == 1 and got[0] != got[1]
    got = learning.hashed_vectors(spark.createDataFrame([(1, "a A b"), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert sum(r["n"] for r in got) == 3 and {r["k"] for r in got} == {1} and max(r["n"] for r in got) >= 2
