import random

from logquarry.llm import names

REG = "author_id long, kind string, given string, family string, display_name string, name string"
PEOPLE = [
    (1, "person", "William", "Ødegård", "William Ødegård", ""), (2, "person", "Wilhelm", "Tarkovand", "Wilhelm Tarkovand", ""), (3, "person", "Rosa", "van der Klemgond", "Rosa van der Klemgond", ""),
    (4, "person", "Anna", "Shared", "Anna Shared", ""), (5, "person", "Arno", "Shared", "Arno Shared", ""), (6, "org", None, None, "Dartfort Academy of Kernel Inference", ""), (7, "person", "Lars", "Brömmelund", "Lars Brömmelund", ""),
]


def links(spark, xs):
    c = spark.createDataFrame([(0, xs, 1)], "citation_id long, authors array<string>, author_id int")
    r = spark.createDataFrame(PEOPLE, REG)
    return {r["name"]: r["author_id"] for r in names.link(c, r).collect()}, names.found(c, r)


CASES = {
    "William Ødegård": 1, "Bill Odegard": 1, "W. Ødegård": 1, "Ødegård, W.": 1, "ØDEGÅRD, William": 1, "Odegard William": 1, "Dr. William X. Ødegård Jr.": 1, "Willaim Ødegård": 1, "William Ødegådr": 1, "Ødegård": 1, "WX Ødegård": 1, "MD Nobody": None, "W.Ødegård": 1,
    "Tarkovand, Wilhelm P.": 2, "Wilhelm Tarkvoand": 2, "Wilhelm Tarkxyand": None, "Rosa VAN DER KLEMGOND": 3, "van der Klemgond, R.": 3, "van der Klemgond Rosa": 3, "A. Shared": None, "Anna Shared": 4, "Shared, Arno": 5, "Bruno Shared": None,
    "DAKI": 6, "D.A.K.I.": 6, "Dartfort Acad. of Kernel Inference": 6, "Kernel Inference Academy, Dartfort": 6, "Dartfort Kernel Inference Academy": 6, "The Dartfort Academy of Kernel Inference": 6, "Dartfort Academy of Kernel Inference (DAKI)": 6, "Datrfort Academy of Kernel Inference": 6, "Dartfort Academy of Signal Inference": None,
    "Lars Bromelund": 7, "Somebody Else": None, "": None, "  ": None, "123": None, "?": None, "x" * 5000: None,
}


def test_cases(spark):
    got, found = links(spark, [*CASES, None, "Bill Odegard"])
    assert got == CASES
    rows = found.collect()
    assert {(r["author_pos"], r["author_id"]) for r in rows} == {(i, CASES[n]) for i, n in enumerate([*CASES, None, "Bill Odegard"]) if n is not None and CASES[n] and n not in {p[4] for p in PEOPLE}}


def test_empty_and_null(spark):
    c = spark.createDataFrame([(1, None), (2, []), (3, [None])], "citation_id long, authors array<string>")
    r = spark.createDataFrame(PEOPLE, REG)
    assert names.found(c, r).count() == 0
    assert names.found(c.where("citation_id = 9"), r).count() == 0
    some = spark.createDataFrame([(1, ["Bill Odegard"])], "citation_id long, authors array<string>")
    assert names.found(some, r.where("author_id = 99")).count() == 0


def test_radius_join_is_exact(spark):
    rnd = random.Random(7)
    for letters, most, n in (("abc", 6, 60), ("abcdefghijklm", 9, 400)):
        word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))
        ps = sorted({word() for _ in range(n)})
        near = [x[:i] + x[i + 1 : i + 2] + x[i : i + 1] + x[i + 2 :] for x in ps[::3] for i in [rnd.randrange(len(x) + 1)]] + [x[:i] + "b" + x[i:] for x in ps[::4] for i in [rnd.randrange(len(x) + 1)]]
        qs = sorted({word() for _ in range(80)} | {*near})
        p = spark.createDataFrame([(i, "person", x, []) for i, x in enumerate(ps)], "author_id long, kind string, r_point string, r_rest array<string>")
        q = spark.createDataFrame([(x, "person", x, []) for x in qs], "name string, kind string, point string, rest array<string>")
        got = [(r["point"], r["r_point"]) for r in names.radius_join(q, p).collect()]
        assert sorted(got) == [(a, b) for a in qs for b in ps if names.slip(a, b) <= 1]


def test_bag_distance_is_a_metric_below_the_edits():
    rnd = random.Random(5)
    ws = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 6))) for _ in range(60)]
    d = names.bag_distances(names.letters(ws), names.letters(ws))
    assert (d == d.T).all() and (d.diagonal() == 0).all()
    assert all(d[i, k] <= d[i, j] + d[j, k] for i in range(60) for j in range(60) for k in range(60))
    assert all(d[i, j] <= 1 for i, a in enumerate(ws) for j, b in enumerate(ws) if names.slip(a, b) <= 1)


def test_cells_prune(spark):
    """A word is copied to few cells, which hold few of the points."""
    rnd = random.Random(9)
    syllables = [a + b + c for a in "bdklmnrstv" for b in "aeiou" for c in ("", "n", "r", "s")]
    ps = sorted({"".join(rnd.sample(syllables, 3)) for _ in range(1200)})
    cells, x = names.make_cells(spark.createDataFrame([(w,) for w in ps], "r_point string"))
    size = {r["cell"]: r["count"] for r in x.groupBy("cell").count().collect()}
    qs = ["".join(rnd.sample(syllables, 3)) for _ in range(500)]
    to = cells.of(qs, names.RADIUS)
    assert sum(map(len, to)) / len(qs) < 3 and sum(size.get(c, 0) for t in to for c in t) / len(qs) / len(ps) < 0.15


def test_nicknames_are_a_parameter(spark):
    r = spark.createDataFrame([(1, "person", "Aurelia", "Tarkovand", "Aurelia Tarkovand", ""), (2, "person", "Zebulon", "Ostergad", "Zebulon Ostergad", "")], REG)
    c = spark.createDataFrame([(0, ["Lia Tarkovand", "Zeb Ostergad", "Rela Tarkovand"])], "citation_id long, authors array<string>")
    got = lambda **kw: {x["name"]: x["author_id"] for x in names.link(c, r, **kw).collect()}
    assert got() == {"Lia Tarkovand": None, "Zeb Ostergad": 2, "Rela Tarkovand": None}  # a beginning of a name needs no entry
    assert got(nicknames={"lia": "aurelia", "rela": ("x", "aurelia")}) == {"Lia Tarkovand": 1, "Zeb Ostergad": 2, "Rela Tarkovand": 1}


def test_slip():
    def osa1(a, b):
        if a == b:
            return 0
        near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in set(b)} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in set(b)} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return 1 if b in near else 2

    rnd = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 5))) for _ in range(2))
        assert names.slip(a, b) == osa1(a, b), (a, b)
