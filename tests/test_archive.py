import pytest
from pyspark.sql import functions as F

from pagecask.operators import archive as A
from pagecask.operators import reports as R
from pagecask.operators.index import page_index

NOW = 1_791_028_800_000
DAY = 86_400_000
PAGE = "id long, url string, domain string, title string, first_seen long, last_visit long, visit_count long, typed_count long, lang string, flags int, saved_at long, content_hash string, content_indexed_at long"
CONTENT = "page_id long, headings string, description string, body string, bytes long"
QUOTE = "id long, url string, domain string, page_title string, text string, fragment string, truncated boolean, created_at long"
VISIT = "url string, title string, last_visit_time double, visit_count long, typed_count long, seq long"


def page(i, flags, age, domain="a.example", h=None):
    return (i, f"https://{domain}/{i}", domain, f"t{i}", NOW - age * DAY, NOW - age * DAY, 1, 0, "en", flags, NOW if flags & 4 else None, h, NOW if flags & 2 else None)


@pytest.fixture
def state(spark):
    pages = spark.createDataFrame([page(1, 1, 10), page(2, 3, 50, h="h2"), page(3, 7, 200), page(4, 6, 300), page(5, 2, 5, "sub.a.example"), page(6, 1, 400, "b.example")], PAGE)
    contents = spark.createDataFrame([(i, "", "", "x" * 10 * i, 10 * i) for i in (2, 3, 4, 5)], CONTENT)
    snippets = spark.createDataFrame([(1, "https://a.example/1", "a.example", "t", "q", None, False, NOW)], QUOTE)
    return A.Archive(pages, contents, snippets)


def flags(s):
    return {r.id: r.flags for r in s.pages.collect()}


def upsert(spark, state, rows):
    out, summary = A.upsert_history(state, spark.createDataFrame(rows, VISIT), F.col("seq"))
    return {r.url: r for r in out.pages.collect()}, tuple(summary.first())


def test_history_merges_by_arrival(spark, state):
    got, summary = upsert(spark, state, [
        ("https://a.example/1#x", "new", NOW - 20.0 * DAY, 7, 2, 1), ("https://a.example/1", "", NOW - 90.0 * DAY, None, None, 2), ("https://c.example/", None, 5.5, 3, None, 3),
        ("https://c.example/?utm_source=z", "C", 2.4, None, 1, 4), ("ftp://x", "t", 1.0, 1, 1, 5), (None, None, None, None, None, 6),
    ])
    one = got["https://a.example/1"]
    assert (one.title, one.last_visit, one.visit_count, one.typed_count, one.first_seen) == ("new", NOW - 10 * DAY, 1, 0, NOW - 10 * DAY)
    c = got["https://c.example/"]
    assert (c.title, c.first_seen, c.last_visit, c.visit_count, c.typed_count, c.flags, c.domain) == ("C", 6, 6, 1, 1, 1, "c.example")
    assert summary == (1, 3, 2) and len(got) == 7


def test_history_is_idempotent(spark, state):
    rows = [("https://a.example/1", "n", 1.0, 2, 0, 1), ("https://d.example/", "d", 2.0, 1, 0, 2)]
    df = spark.createDataFrame(rows, VISIT)
    once, _ = A.upsert_history(state, df, F.col("seq"))
    twice, summary = A.upsert_history(once, df, F.col("seq"))
    key = lambda s: sorted(map(tuple, s.pages.collect()), key=repr)
    assert key(once) == key(twice) and tuple(summary.first()) == (0, 2, 0)


def test_empty_batch(spark, state):
    got, summary = upsert(spark, state, [])
    assert len(got) == 6 and summary == (0, 0, 0)


CAPTURE = "url string, title string, headings string, description string, body string, lang string, content_hash string, at double, extra string"


def test_content(spark, state):
    batch = spark.createDataFrame([("https://a.example/2", "x", None, None, "same", None, "h2", 1.0, "e"), ("https://a.example/1", "", "h", None, "body", None, "h1", 9.0, "e"), ("https://n.example/", "N", None, None, "n", "de", "hn", 9.0, "e"), ("https://n.example/#2", "M", None, None, "m", "de", "hm", 8.0, "e")], CAPTURE)
    out, summary = A.upsert_content(state, batch)
    p = {r.url: r for r in out.pages.collect()}
    assert p["https://a.example/1"].flags == 3 and p["https://a.example/1"].title == "t1" and p["https://a.example/1"].lang is None
    assert p["https://a.example/2"].title == "t2" and (p["https://n.example/"].visit_count, p["https://n.example/"].flags, p["https://n.example/"].title) == (0, 2, "N")
    assert summary.first().changed == 2
    texts = {r.page_id: r for r in out.contents.collect()}
    assert texts[1].body == "body" and texts[1].bytes == 5 and texts[2].bytes == 20
    saved, _ = A.upsert_content(state, batch, save=True)
    p = {r.url: r for r in saved.pages.collect()}
    assert p["https://a.example/2"].flags == 7 and p["https://a.example/2"].lang == "en" and p["https://a.example/2"].saved_at == 1


def test_removals(spark, state):
    urls = spark.createDataFrame([("https://a.example/1#f",), ("https://a.example/3",), ("https://a.example/3",), ("bad",), (None,)], "url string")
    out, summary = A.delete_urls(state, urls)
    assert flags(out) == {2: 3, 3: 6, 4: 6, 5: 2, 6: 1} and tuple(summary.first()) == (1, 1)
    out, summary = A.delete_domain(state, "a.example")
    assert flags(out) == {3: 6, 4: 6, 6: 1} and {r.page_id for r in out.contents.collect()} == {3, 4}
    out, _ = A.delete_domain(state, "a.example", True)
    assert flags(out) == {6: 1} and out.snippets.count() == 0
    assert flags(A.delete_range(state, NOW - 50 * DAY, NOW - 10 * DAY)[0]).keys() == {1, 3, 4, 5, 6}
    assert flags(A.delete_all_except_saved(state)[0]) == {3: 6, 4: 6}
    everything, summary = A.delete_everything(state)
    assert everything.pages.count() == 0 and tuple(summary.first()) == (6, 0)
    assert flags(A.apply_retention(state, None, NOW)[0]) == flags(state)
    assert flags(A.apply_retention(state, 1, NOW)[0]) == {1: 1, 3: 6, 4: 6, 5: 2}


def test_unsave_and_clear(spark, state):
    urls = spark.createDataFrame([("https://a.example/3",), ("https://a.example/4",), ("https://a.example/1",)], "url string")
    out, summary = A.unsave(state, urls)
    assert flags(out) == {1: 1, 2: 3, 3: 1, 5: 2, 6: 1} and tuple(summary.first()) == (1, 1)
    assert {r.page_id for r in out.contents.collect()} == {2, 5} and out.pages.where("id = 3 and saved_at is null").count() == 1
    out, summary = A.clear_deep_content(state)
    assert flags(out) == {1: 1, 2: 1, 3: 7, 4: 6, 6: 1} and tuple(summary.first()) == (1, 1)
    assert flags(A.clear_deep_content(state, "sub.a.example")[0]).keys() == {1, 2, 3, 4, 6}


def test_snippets(spark, state):
    rows = spark.createDataFrame([("https://a.example/9#q", None, "x" * 6000, None, 1.0), ("nope", "t", "y", None, 1.0)], "url string, page_title string, text string, fragment string, created_at double")
    out = A.add_snippets(state, rows)
    got = out.snippets.where("url = 'https://a.example/9'").first()
    assert len(got.text) == 5000 and got.truncated and got.page_title == "" and out.snippets.count() == 2
    assert A.delete_snippets(out, spark.createDataFrame([(1,)], "id long")).snippets.count() == 1


def test_removal_plan(spark, state):
    events = spark.createDataFrame([(False, ["https://a.example/1", "https://a.example/3", "https://x.example/"], NOW), (False, None, NOW), (True, None, NOW), (False, ["https://b.example/6", "https://b.example/6"], NOW - 320 * DAY)], "all_history boolean, urls array<string>, at long")
    got = {r.url: r.action for r in A.plan_removals(state.pages, events, F.col("at")).collect()}
    assert got == {"https://a.example/1": "delete", "https://a.example/3": "expired", "https://x.example/": "unknown", "https://b.example/6": "delete"}


def cap_state(spark, n, keep):
    pages = spark.range(n).selectExpr(
        "id", "'u123' as url", "'d' as domain", "'t' as title", "0L as first_seen", "id as last_visit", "1L as visit_count", "0L as typed_count", "'en' as lang",
        f"if(id % {keep} = 0, 7, 3) as flags", "0L as saved_at", "'h' as content_hash", "0L as content_indexed_at",
    )
    contents = spark.range(n).selectExpr("id as page_id", "'' as headings", "'' as description", "'b' as body", "10L as bytes")
    return A.Archive(pages, contents, spark.createDataFrame([], QUOTE))


def cap_by_hand(n, keep, cap, batch=200):
    left, trim, gone = 80 * n, [], []
    old = [i for i in range(n) if i % keep]
    for size, out in ((10, trim), (70, gone)):
        todo = list(old)
        while left > cap and todo:  # whole steps, the oldest first
            out += todo[:batch]
            left -= size * len(todo[:batch])
            todo = todo[batch:]
    return set(trim), set(gone), max(0, left - cap)


@pytest.mark.parametrize("cap", [80 * 950, 80 * 950 - 2500, 71 * 950, 30 * 950, 100])
def test_cap(spark, cap):
    n, state = 950, cap_state(spark, 950, 10)
    trim, gone, over = cap_by_hand(n, 10, cap)
    out, summary = A.enforce_cap(state, cap)
    left = {r.id: r for r in out.pages.collect()}
    assert set(left) == set(range(n)) - gone and {i for i, r in left.items() if not r.flags & 2} == trim - gone
    assert tuple(summary.first()) == (len(trim), len(gone), 10 * len(trim) + 70 * len(gone), over)
    assert {r.page_id for r in out.contents.collect()} == set(range(n)) - trim - gone and all(r.content_indexed_at == 0 for r in left.values())


def test_cap_takes_as_many_batches_as_needed(spark):
    n = 10_600
    state = cap_state(spark, n, 100)
    for cap in (80 * n - 10 * 10_100, 72 * n - 70 * 10_050):
        trim, gone, _ = cap_by_hand(n, 100, cap)
        plan = A.cap_plan(state, cap)
        got = {step: {r.id for r in plan.where(F.col("step") == step).collect()} for step in ("trim", "delete")}
        assert got == {"trim": trim, "delete": gone} and len(trim) > 10_000
    assert A.cap_plan(state, 80 * n - 301 * 10, batch=2).count() == 302


def test_export_import(spark, state, tmp_path):
    from pagecask.sources import exchange

    exchange.write_export(state, str(tmp_path / "e"))
    empty = A.Archive(state.pages.limit(0), state.contents.limit(0), state.snippets.limit(0))
    once, summary = exchange.import_export(empty, str(tmp_path / "e"))
    assert tuple(summary.first()) == (6, 1, 0)
    twice, summary = exchange.import_export(once, str(tmp_path / "e"))
    key = lambda s: sorted(map(tuple, s.pages.collect()), key=repr)
    assert key(once) == key(twice) and twice.snippets.count() == 1
    assert {r.url for r in A.export_pages(state, "saved").collect()} == {"https://a.example/3", "https://a.example/4"}
    assert A.export_pages(state, "saved").where("flags & 1 <> 0").count() == 0


def test_reports(spark, state):
    rows = {r.domain: r for r in R.domain_stats(state.pages, state.contents).collect()}
    assert (rows["a.example"].pages, rows["a.example"].saved, rows["a.example"].bytes, rows["a.example"].last_activity) == (4, 2, 90, NOW)
    assert R.domain_stats(state.pages, state.contents, 1).first().domain == "a.example"
    assert R.archive_stats(state.pages, state.contents, state.snippets).first().text_bytes == 140
    info = R.page_info(state.pages, state.contents, state.snippets, "https://a.example/1").first()
    assert (info.bytes, info.preview, info.snippets) == (0, "", 1)
    assert R.page_info(state.pages, state.contents, state.snippets, "x").first() is None
    index = page_index(state.pages, state.contents)
    assert all(r.problems == 0 for r in R.integrity(state.pages, state.contents, index).collect())
    assert R.integrity(state.pages.where("id <> 2"), state.contents, index).where("problems > 0").count() == 2


def test_last_visits(spark, state):
    urls = spark.createDataFrame([("https://a.example/1#a",), ("https://a.example/1",), ("zzz",)], "url string")
    assert [tuple(r) for r in A.last_visits(state.pages, urls).collect()] == [("https://a.example/1", NOW - 10 * DAY)]
