import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logquarry.llm import mix, pack, split
from logquarry.llm.tokens import count_tokens, tokens

T = tokens()
PIECES = st.lists(st.sampled_from(["word", "don't", " ", "  ", "\n", "\n\n", "\t", "。", "中文", "1234", "é", "🙂", "...", "\r\n", " ", "'s", " (x)", "longer-word,", "　"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_counts_equal_the_tokenizer(text):
    want = len(T.encode(text))
    assert T.count(text) == want
    starts, sizes = T.units(text, 4) if text else ([0], [0])
    assert sum(sizes) == want and starts == sorted(set(starts))


def _check(text, limit, overlap):
    got = split.split_text(text, T, limit, overlap)
    assert got[0][0] == 0 and got[-1][2] == len(text)
    assert "".join(text[c:e] for _, c, e, _ in got) == text
    for (ps, _, pe, _), (s, c, _, _) in zip(got, got[1:]):
        assert pe == c
        if len(T.encode(text[ps:pe])) > overlap + 3:  # a piece that is shorter than the overlap is repeated whole
            assert overlap <= len(T.encode(text[s:c])) + 3
        else:
            assert overlap <= len(T.encode(text[s:c])) + 3 or s == ps
    assert all(n == len(T.encode(text[s:e])) and n <= limit for s, _, e, n in got)
    return got


@settings(max_examples=150, deadline=None)
@given(PIECES.filter(bool), st.integers(1, 20))
def test_pieces_rebuild_the_text(text, times):
    _check(text * times, 64, 8)


@settings(max_examples=150, deadline=None)
@given(PIECES.filter(bool), st.integers(1, 60), st.integers(32, 2048), st.integers(0, 16))
def test_pieces_under_any_limit(text, times, limit, share):
    _check(text * times, limit, limit * share // 64)


def test_limits_without_room_raise():
    with pytest.raises(ValueError):
        split.split_text("word " * 100, T, 20, 16)


def test_pieces_of_hard_texts():
    for text in ("a" * 30_000, "中" * 9_000, "word " * 9_000, "\n" * 9_000, "x" * 10 + " " * 20_000, "🙂" * 5_000, "line one.\n" * 4_000):
        assert len(_check(text, split.LIMIT, split.OVERLAP)) > 1 or T.count(text) <= split.LIMIT


def test_cuts_at_natural_breaks():
    text = "\n\n".join(" ".join(["Some plain words of a sentence."] * 30) for _ in range(40))
    got = _check(text, 2048, 128)
    assert all(text[c - 2 : c] == "\n\n" for _, c, _, _ in got[1:])


def test_split_table(spark):
    rows = [(1, "word " * 5000, 9), (2, "short", 9), (3, None, 9), (4, "", 9), (1, "word " * 5000, 9), (None, "word " * 3000, 9), (5, "a" * 2100, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = split.split(df).collect()
    per = defaultdict(list)
    for r in got:
        per[r["doc_id"]].append(r["piece"])
        assert r["n_tokens"] <= 2048 and r["text"]
    assert set(per) == {1, None} and sorted(per[1]) == sorted(2 * list(range(len(per[1]) // 2)))
    assert {r["doc_id"] for r in split.found(df).collect()} == {1, None}
    assert split.split(df.limit(0)).count() == 0


def test_count_table(spark):
    df = spark.createDataFrame([("a b", 1), (None, 2), ("", 3)], "text string, n_tokens_ int")
    assert {r["n_tokens_"]: r["n_tokens"] for r in count_tokens(df, ["n_tokens_"]).collect()} == {1: 2, 2: 0, 3: 0}


def test_pack(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice(["disk", "node", "lease", "graph", "queue"]) + str(rnd.randint(0, 9)) for _ in range(rnd.choice([1, 5, 200, 900, 3000])))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, docs[0][1]), (302, docs[0][1])]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, container int").repartition(3)
    rows = pack.pack(df).collect()
    box, doc = defaultdict(int), defaultdict(list)
    for r in rows:
        box[r["container"]] += r["n_tokens"]
        doc[r["doc_id"]].append((r["start_token"], r["n_tokens"]))
    assert max(box.values()) <= 2048 and not {300, 301} & set(doc)
    for i, t in docs[:300]:
        n, parts = T.count(t), sorted(doc[i])
        assert sum(k for _, k in parts) == n and len(parts) == -(-n // 2048)
        assert [a for a, _ in parts] == [2048 * j for j in range(len(parts))]
    assert len(doc[302]) == 2 * -(-T.count(docs[0][1]) // 2048)
    need = sum(box.values()) / 2048
    assert len(box) <= need * 1.05 + 6
    assert pack.usage(pack.pack(df)).first()["n_containers"] == len(box)
    assert pack.pack(df.limit(0)).count() == 0


def test_packing_does_not_depend_on_partitions(spark):
    """Documents are routed by their words: the fill and the containers are the same however the input lies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    boxes = []
    for n in (1, 32):
        rows = pack.pack(docs.repartition(n)).collect()
        boxes.append(sorted((r["container"], r["doc_id"], r["segment"], r["place"]) for r in rows))
        assert sum(r["n_tokens"] for r in rows) / (2048 * len({r["container"] for r in rows})) > 0.99
    assert boxes[0] == boxes[1]


def test_related_documents_meet():
    """Of two subjects, each lies in a stretch of the chain of its own."""
    rnd = random.Random(1)
    words = [[a + b + c for a in "bdkl" for b in "aeio" for c in s] for s in ("mnr", "stv")]
    texts = [" ".join(rnd.choice(words[i % 2]) for _ in range(80)) for i in range(400)]
    import numpy as np

    router = pack.Router(pack.features(texts[:200]))
    at = router.places(texts, np.full(400, 0.5))
    low, high = sorted((at[::2], at[1::2]), key=lambda a: a.mean())
    assert (low < 0.5).mean() > 0.95 and (high > 0.5).mean() > 0.95
    assert len(pack.Router(np.zeros((0, pack.CLASSES))).places(["a"], np.zeros(1))) == 1


def test_bm25_scores():
    from collections import Counter

    bags = [Counter({"a": 2, "x": 1}), Counter({"a": 1, "y": 3}), Counter({"z": 1}), Counter({"q": 1}), Counter({"r": 1})]
    ix = pack.Index(bags)
    import math

    n, df = 5, 2
    avg = sum(sum(b.values()) for b in bags) / n
    idf = math.log((n - df + 0.5) / (df + 0.5))
    want = idf * 1 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / avg))
    assert ix.scores(0)[1] == pytest.approx(want) and ix.scores(0)[2] == 0 and not ix.scores(3).any()


def test_exponents():
    nat = {"a": 0.9, "b": 0.1}
    even = {"a": 0.5, "b": 0.5}
    assert mix.weights(nat, even, 1.0) == pytest.approx(nat) and mix.weights(nat, even, 0.0) == pytest.approx(even)
    e = mix.exponent_for_entropy(nat, 0.6)
    assert mix.entropy(mix.weights(nat, even, e)) == pytest.approx(0.6)
    a = mix.exponent_for_limits({"a": 900, "b": 100}, even, {"a": 2, "b": 2}, 1000)
    assert 1000 * mix.weights(nat, even, a)["b"] == pytest.approx(200, rel=1e-6)
    assert mix.exponent_for_limits({"a": 900, "b": 100}, even, {"a": 2, "b": 9}, 1000) == 0.0
    assert mix.plan({"a": 900, "b": 100}, even, {"a": 1, "b": 4}) == pytest.approx({"a": 400, "b": 400})
    more = mix.plan({"a": 900, "b": 100}, even, {"a": 1, "b": 4}, stretch=1.25)
    assert sum(more.values()) == pytest.approx(1000) and more["b"] == pytest.approx(400, rel=1e-6)
    heat = mix.plan({"a": 900, "b": 100}, even, {"a": 1, "b": 4}, target_entropy=0.6)
    total = sum(heat.values())
    assert mix.entropy({k: v / total for k, v in heat.items()}) == pytest.approx(0.6) and all(heat[k] <= n * 1.000001 for k, n in (("a", 900), ("b", 400)))
    assert mix.plan({"a": 0}, {"a": 1.0}, {"a": 3}) == {} and mix.plan({}, {}, {}) == {}
    assert mix.plan({"a": 10, "b": 10}, {"a": 0.7, "b": 0.0, "c": 0.3}, {"a": 2, "b": 2}) == pytest.approx({"a": 20})


def test_mixture(spark):
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.randint(1, 60), rnd.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(1500)] + [(1500, None, "a", 0), (1501, "", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    t = spark.createDataFrame([("a", 0.3, 1, 1), ("b", 0.5, 3, 1), ("c", 0.2, 4, 1), ("none", 0.0, 2, 1), (None, 0.0, 1, 1)], "source string, target_share double, max_repeats int, passes int")
    m = mix.mixture(df, t)
    rows = m.collect()
    uses = defaultdict(set)
    for r in rows:
        assert r["pass"] not in uses[r["doc_id"]]
        uses[r["doc_id"]].add(r["pass"])
        assert r["pass"] < {"a": 1, "b": 3, "c": 4}[r["source"]]
    s = {r["source"]: r for r in mix.shares(m, t).collect()}
    assert all(abs(s[k]["share"] - w) < 0.002 for k, w in (("a", 0.3), ("b", 0.5), ("c", 0.2)))
    assert s["none"]["n_tokens"] == 0 and 1500 not in uses and 1501 not in uses
    assert sorted(map(tuple, mix.mixture(df.repartition(5), t).collect())) == sorted(map(tuple, rows))
    halves = {h: sum(r["n_tokens"] for r in rows if (r["block"] < 512) == h and r["source"] == "b") for h in (True, False)}
    assert 0.7 < halves[True] / halves[False] < 1.4
    big = mix.shares(mix.mixture(df, t, budget=s["b"]["n_tokens"] * 3), t).collect()
    assert all(r["most_passes"] <= {"a": 1, "b": 3, "c": 4}.get(r["source"], 0) for r in big)
    even = mix.shares(mix.mixture(df, t, entropy_of_targets=True), t).collect()
    got = {r["source"]: r["share"] for r in even if r["share"]}
    assert set(got) == {"a", "b", "c"} and abs(mix.entropy(got) - mix.entropy({"a": 0.3, "b": 0.5, "c": 0.2})) < 0.02
    wide = {r["source"]: r for r in mix.shares(mix.mixture(df, t, stretch=1.3), t).collect()}
    assert sum(r["n_tokens"] for r in wide.values()) > sum(r["n_tokens"] for r in s.values()) and all(wide[k]["most_passes"] <= n for k, n in (("a", 1), ("b", 3), ("c", 4)))
    assert mix.mixture(df.limit(0), t).count() == 0 and mix.mixture(df, t.limit(0)).count() == 0
