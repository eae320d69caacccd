import math

import pytest

from pagecask.operators import search as S
from pagecask.operators.snippets import excerpt, merged_spans, spans_of
from pagecask.plans.query import parse_query

NOW = 1_791_028_800_000
DAY = 86_400_000
PAGES = [
    (1, "https://a.example/one", "a.example", "Old bridge in town", NOW - DAY, 5, 3),
    (2, "https://b.example/two", "b.example", "Recipes", NOW - 2 * DAY, 1, 3),
    (3, "https://sub.a.example/three", "sub.a.example", "Γέφυρα στην πόλη", NOW - 40 * DAY, 1, 7),
    (4, "https://c.example/four", "c.example", None, NOW - 400 * DAY, 9, 1),
]
CONTENTS = [
    (1, "Heading", "", "The old bridge crosses the river. A bridge too far.", 10),
    (2, "", "bread and butter", "How to bake bread near the old bridge", 10),
    (3, None, None, None, 0),
]
SNIPPETS = [(7, "https://a.example/one", "a.example", "Old bridge in town", "a quote about the bridge", ":~:text=x", False, NOW - DAY)]


@pytest.fixture(scope="module")
def indexes(tables):
    return {"page_idx": S.page_index(*tables[:2]), "snippet_idx": S.snippet_index(tables[2])}


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame(PAGES, "id long, url string, domain string, title string, last_visit long, visit_count long, flags int")
    contents = spark.createDataFrame(CONTENTS, "page_id long, headings string, description string, body string, bytes long")
    snippets = spark.createDataFrame(SNIPPETS, "id long, url string, domain string, page_title string, text string, fragment string, truncated boolean, created_at long")
    return pages, contents, snippets


@pytest.fixture()
def run(tables, indexes):
    return lambda line, limit=50: [(r.kind, r.id) for r in S.search(*tables, parse_query(line, NOW), NOW, limit, **indexes).collect()]


@pytest.fixture()
def rows_of(tables, indexes):
    return lambda line: S.search(*tables, parse_query(line, NOW), NOW, **indexes).collect()


def test_all_words_in_any_field(run):
    found = run("bread recipes")
    assert found[0] == ("page", 2)


def test_prefix_of_the_last_word_only(rows_of):
    assert ("page", 1) in [(r.kind, r.id) for r in rows_of("old brid") if not r.approximate]
    assert not [r for r in rows_of("brid old") if not r.approximate]
    exact = [r for r in rows_of('"brid"') if not r.approximate]
    assert not exact


def test_accents_and_sites(run):
    assert run("γεφυρα")[0] == ("page", 3)
    assert set(run("site:a.example")) == {("page", 1), ("page", 3), ("snippet", 7)}
    assert set(run("site:a.example -site:sub.a.example")) == {("page", 1), ("snippet", 7)}


def test_exclusion_and_tiers(run):
    assert ("page", 2) not in run("bridge -bread")
    assert run("is:snippet bridge") == [("snippet", 7)]
    assert run("is:saved") == [("page", 3)]
    assert run("-bridge") == []


def test_dates(run):
    assert ("page", 4) not in run("when:year") and ("page", 4) in run("before:1y")


def test_relaxed_results_come_after_exact_ones(rows_of):
    rows = rows_of("river recipes")
    assert rows and all(r.approximate for r in rows)
    rows = rows_of("crosses")
    assert not rows[0].approximate and rows[0].snippet.text.startswith("The old bridge")


def test_substring_search_is_the_last_resort(run):
    assert ("page", 1) in run("ridg")


def test_bm25_formula(indexes):
    index = indexes["page_idx"]
    rows = {r.id: r.strength for r in S.bm25_matches(index, [(["bread"], False)], True).collect()}
    lengths = {1: 4 + 1 + 0 + 10, 2: 1 + 0 + 3 + 8, 3: 3, 4: 0}
    mean = sum(lengths.values()) / 4
    tf = 3.0 + 1.0
    want = max(math.log((4 - 1 + 0.5) / 1.5), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[2] / mean))
    assert rows == {2: pytest.approx(want)}


def test_empty_archive(spark, tables):
    empty = [t.limit(0) for t in tables]
    assert S.search(*empty, parse_query("bridge", NOW), NOW).collect() == []


def test_suggestions(indexes):
    vocab = indexes["page_idx"].vocabulary
    assert S.suggestions(vocab, parse_query("brigde", NOW)) == [("brigde", "bridge")]
    assert S.suggestions(vocab, parse_query("brid", NOW)) == [] and S.suggestions(vocab, parse_query("xyz", NOW)) == []


def test_relevance(spark):
    rows = spark.createDataFrame([("t", 1, None), ("t", 4, True), ("t", None, False), ("u", 2, None)], "kind string, place int, suggested boolean")
    got = {r.kind: (r.n, r.hit1, r.hit5, r.mrr, r.suggestion_rate) for r in S.relevance(rows).collect()}
    assert got["t"] == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx((1 + 0.25) / 3), pytest.approx(1 / 3)) and got["u"][3] == 0.5
    assert got["total"][:2] == (4, 0.25)


def test_excerpt():
    text = "x " * 100 + "Η Γέφυρα είναι εδώ" + " y" * 200
    out, marks = excerpt(text, ["γεφυρα"], -1)
    assert out.startswith("…") and out.endswith("…") and [out[a:b] for a, b in marks] == ["Γέφυρα"]
    assert excerpt("", ["a"], 0) is None and excerpt("b", ["a"], 0) is None and excerpt(None, ["a"], 0) is None
    assert spans_of("ab abc", ["ab"], 0, 50) == [(0, 2, 0), (3, 6, 0)]
    assert merged_spans([(5, 9), (-3, 2), (2, 4), (8, 99)], 10) == [(0, 4), (5, 10)]
