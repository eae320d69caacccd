import itertools

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagecask.llm import visual_form as V

SAME = {
    "Ｈｅｌｌｏ　ｗｏｒｌｄ": "Hello world", "café": "café", "zero​width­soft﻿": "zerowidthsoft", "no break thin": "no break thin", "ﬁne ﬂow": "fine flow",
    "раssword": "password", "КK": "KK", "Μοsk": "Mosk", "ά": "ά", "ạ́": "ạ́", "x‐y‑z": "x-y-z", "a\r\nb c": "a\nb\nc", "й": "й",
}
DIFFERENT = [("a b", "a  b"), ("A", "a"), ("e", "é"), ("a\nb", "a b"), ("①", "1"), ("x²", "x2"), ("ſ", "s"), ("мир", "mup"), ("–", "-")]
ALPHABET = list("abcoeipTKН сор ежЖαοπ\n-.é") + ["́", "̣", "​", " ", "ﬁ", "ａ", "K", "ё", "한", "ᄒ", "ᅡ", "…", "\r", "\t", "😀"]


@pytest.mark.parametrize("text", SAME)
def test_same_look(text):
    assert V.canonical(text) == V.canonical(SAME[text]), (V.canonical(text), V.canonical(SAME[text]))


@pytest.mark.parametrize("pair", DIFFERENT)
def test_different_look(pair):
    assert V.canonical(pair[0]) != V.canonical(pair[1])


def test_words_with_letters_of_other_scripts():
    for text in ("ᅡоᅡ", "字о字 и Москва", "ᅡоᅡ λόγος"):
        assert V.canonical(text) == V._rebuilt(text, None)


def test_real_words_keep_their_script():
    for text in ("Москва и море", "Ο λόγος του", "plain English with a лодка", "Ελληνικά and English"):
        assert V.canonical(text) == text
    assert V.canonical(None) is None and V.canonical("") == ""


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=30))
def test_form_is_a_fixed_point(text):
    form = V.canonical(text)
    assert V.canonical(form) == form


@settings(max_examples=8, deadline=None, phases=(Phase.explicit, Phase.reuse, Phase.generate))  # a smaller example is not worth its time on Spark
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=25), min_size=20, max_size=60))
def test_operator_agrees_with_its_definition(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r.k: r.form for r in V.canonical_forms(df, "k", "t").collect()}
    assert got == {k: V.canonical(t) for k, t in rows}
    forms = spark.createDataFrame([(k, t, V.canonical(t)) for k, t in rows], "k long, t string, f string")
    assert forms.where(V.look_profile(F.col("t")) != V.look_profile(F.col("f"))).count() == 0


SCHEMA = "field string, id long, text string, _h string, _p int"


def brute(rows):
    out = set()
    for (f, i, s, *_), (g, j, t, *_) in itertools.combinations(sorted(rows, key=lambda r: (r[0], r[1])), 2):
        if f == g and s and t and s != t and V.canonical(s) == V.canonical(t):
            out.add((f, min(i, j), max(i, j)))
    return out


def test_pairs(spark):
    texts = ["Hello there", "Ｈello there", "Hello​ there", "Hello there", None, "", "​", "other", "оther", "long " * 3000, "long " + "long " * 2999]
    rows = [(f, k, t, "x", 1) for f in ("title", "body") for k, t in enumerate(texts)]
    got = [tuple(r) for r in V.lookalike_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert V.lookalike_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_third_of_all_rows_are_one_string(spark):
    rows = [("title", k, "The same old title", "", 0) for k in range(700)] + [("title", 10_000 + k, f"Title number {k}", "", 0) for k in range(1400)] + [("title", 99_999, "Тhe same old title", "", 0)]
    assert V.lookalike_pairs(spark.createDataFrame(rows, SCHEMA)).count() == 700


def test_query(spark, data):
    assert V.p5_found(spark, data).columns == ["field", "id_a", "id_b"]


def test_one_form_of_every_text(spark):
    texts = [*SAME, *SAME.values(), *(x for pair in DIFFERENT for x in pair), None, "", "plain\nlines", "tab\there", "Ｈｅｌｌｏ　ｗｏｒｌｄ " * 3000]
    rows = [("title", k, t, "clash", 1) for k, t in enumerate([*texts, *texts])]
    got = {r.id: r.form for r in V.one_form(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: V.canonical(t) for _, k, t, *_ in rows if t is not None}
    assert V.one_form(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_string_that_a_third_of_all_rows_have(spark, monkeypatch):
    from pagecask.operators import skew

    monkeypatch.setattr(skew.paired_members, "__defaults__", (7,))
    rows = [("title", k, "Home" if k % 3 == 0 else "Ｈｏｍｅ" if k % 31 == 1 else f"word {k}", None, None) for k in range(150)]
    got = [tuple(r) for r in V.lookalike_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_pairs_within_large_groups(spark):
    from pagecask.operators.skew import pairs_within

    rows = [(k % 2 * 7, k) for k in range(90)] + [(3, 100)]
    got = [tuple(r) for r in pairs_within(spark.createDataFrame(rows, "group long, id long"), per=8).collect()]
    want = {(g, a, b) for (g, a), (h, b) in itertools.product(rows, rows) if g == h and a < b}
    assert len(got) == len(set(got)) and set(got) == want
