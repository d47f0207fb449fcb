import json

from logquarry.llm import chars, dedup

API = "response_id long, status_code int, body string"


def canon(spark, xs):
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(xs)], "i long, s string, look string")
    return [r["canonical"] for r in sorted(chars.canonicalise(df, "s").collect(), key=lambda r: r["i"])]


def test_same_look_same_form(spark):
    pairs = [
        ("Ａbc： x", "Abc: x"), ("é", "é"), ("a​b­c﻿", "abc"), ("a b　c d", "a b c d"),
        ("Сору", "Copy"), ("Οο", "Oo"), ("ﬁn", "fin"), ("a‐b‑c", "a-b-c"), ("K", "K"), ("Ё e​́", "Ë é"), ("Ⅳ", "IV"),
    ]
    assert canon(spark, [a for a, _ in pairs]) == [b for _, b in pairs]
    assert canon(spark, [b for _, b in pairs]) == [b for _, b in pairs]


def test_visible_differences_stay(spark):
    xs = ["Abc", "abc", "e", "é", "a b", "a  b", "a\tb", "a\nb", "a-b", "a—b", "a,b", "x²", "x2", "α", "a", "…", "..."]
    assert canon(spark, xs) == xs


def test_null_empty_long(spark):
    long = "ａ" * 200_000
    assert canon(spark, [None, "", long, "it''s '$1' \\1"]) == [None, "", "a" * 200_000, "it''s '$1' \\1"]
    assert canon(spark, []) == []


def test_found(spark):
    c = spark.createDataFrame([(1, "Abc d", "r"), (2, "Abc d", "r"), (3, None, "r"), (4, "abc d", "r"), (5, "Abc d", "r")], "citation_id long, title string, response_id string")
    body = json.dumps({"message": {"items": [{"title": ["x", "Ａbc d"]}, {"title": "Abc d"}]}})
    a = spark.createDataFrame([(7, 200, body), (8, 500, body)], API)
    assert sorted(map(tuple, chars.found(c, a).collect())) == [(1, 7, 0), (2, 7, 0), (2, 7, 1), (5, 7, 0)]
    assert chars.found(c.limit(0), a).count() == 0 and chars.found(c, a.limit(0)).count() == 0


CIT = "citation_id long, raw string, title string, doi string, h string, salt int"


def copies(spark, rows):
    return sorted(map(tuple, dedup.found(spark.createDataFrame([(*r, "h", 1) for r in rows], CIT)).collect()))


def test_copies(spark):
    rows = [
        (5, "", " A  Title: of (things)! ", "DOI: 10.1/AB"), (3, "", "a title of things", "10.1 / ab."), (9, "", "A TITLE OF THINGS", None), (10, "", "a-title of things", ""),
        (4, '{"Title": "A\\u0020title of things", "DOI": "<10.1/ab>", "Year": 1}', None, None), (6, '@article{k,\n doi = "https://doi.org/10.1/ab",\n TITLE = {{A Title} Of Things}\n}', None, None),
        (11, "[no title]", None, "10.1/ab"), (12, "plain", None, None), (13, '{"broken', None, None), (14, "@article{x", None, None), (15, None, None, None), (16, "", "", "10.1/ab"), (17, "", "?!", "10.1/ab"), (3, "", "a title of things", "10.1/ab"),
    ]
    assert copies(spark, rows) == [(3, 4), (3, 5), (3, 6), (9, 10)]
    one = dedup.collapse(spark.createDataFrame([(*r, "h", 1) for r in rows], CIT)).collect()
    by = {r["citation_id"]: r["n_copies"] for r in one}
    assert by[3] == 5 and by[9] == 2 and by[11] == by[12] == by[16] == 1
    assert copies(spark, []) == []


def test_copies_in_other_characters(spark):
    """Composed, decomposed and full-width spellings are one record; letters that only look alike are not."""
    rows = [(1, "", "Café systems ABC", "10.1/x"), (2, "", "Cafe\u0301 systems ABC", "10.1/x"), (3, "", "Ｃａｆé　ｓｙｓｔｅｍｓ　ＡＢＣ", "１０．１／ｘ"), (4, "", "Cafe systems ABC", "10.1/x"), (5, "", "Саfé systems ABC", "10.1/x")]
    rows += [(6, "", "Straße ΟΔΟΣ A", None), (7, "", "STRASSE οδος-a", None), (8, '{"title": "Stra\\u00dfe ο\u0301δος", "doi": ""}', None, None), (9, "", "strasse όΔΟΣ", "")]
    assert copies(spark, rows) == [(1, 2), (1, 3), (6, 7), (8, 9)]
    one = dedup.collapse(spark.createDataFrame([(*r, "h", 1) for r in rows], CIT)).where("citation_id = 1").first()
    assert (one["title_key"], one["doi_key"], one["n_copies"]) == ("caf\u00e9systemsabc", "101x", 3)


def test_hot_group(spark):
    rows = [(i, "", "Hot title" if i % 3 else f"t{i}", "10.1/x") for i in range(3000)]
    got = copies(spark, rows)
    assert len(got) == 1999 and {a for a, _ in got} == {1}


def test_collisions_are_split(spark):
    from pyspark.sql import functions as F

    df = dedup.canonical(spark.createDataFrame([(1, "", "a", None, "", 0), (2, "", "b", None, "", 0), (3, "", "b", None, "", 0)], CIT)).withColumn("h", F.unhex(F.lit("00")))
    assert sorted((r["first_id"], r["n_copies"]) for r in dedup.groups(df).collect()) == [(1, 1), (2, 2)]
