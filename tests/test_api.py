import pytest

from pagecask.api import BadRequest, Service
from pagecask.operators.archive import Archive
from pagecask.operators.reports import nearest_rank, random_rows
from pagecask.sources import snapshot
from pagecask.streaming.pipeline import Pipeline
from pagecask.streaming.state import PipelineState
from tests.test_archive import CONTENT, NOW, PAGE, QUOTE


@pytest.fixture
def root(spark, tmp_path):
    empty = Archive(spark.createDataFrame([], PAGE), spark.createDataFrame([], CONTENT), spark.createDataFrame([], QUOTE))
    snapshot.write_snapshot(empty, str(tmp_path / "r"), extra={"state": PipelineState().granted().dumps()})
    return str(tmp_path / "r")


def test_a_day_with_the_service(spark, root, tmp_path):
    s = Service(spark, root, lambda: NOW)
    assert s.call("ping") == "pong"
    assert s.call("upsert_history", rows=[{"url": "https://a.example/1", "title": "Old bridge", "last_visit_time": float(NOW)}, {"url": "bad", "last_visit_time": 1.0}]) == {"inserted": 1, "updated": 0, "skipped": 1}
    s.call("remember", url="https://b.example/2", title="fallback", html="<title>River</title><main><h1>Head</h1><p>The river crosses the town</p></main>")
    quote = s.call("save_selection", url="https://a.example/1", page_title="Old bridge", text="a  bridge")
    assert quote["truncated"] is False
    assert [(r.kind, r.url[-1]) for r in s.call("search", query="river").collect()] == [("page", "2")]
    assert s.call("suggest", term="rivver") == ["river"]
    told = s.call("respond", query="rivver site:b.example")
    assert told.suggestions == [("rivver", "river")] and told.filters["sites"] == ["b.example"] and told.took_ms >= 0
    assert s.call("stats")["saved"] == 1 and s.call("page_info", url="https://a.example/1#x")["snippets"] == 1
    assert not any(s.call("integrity_check").values())
    s.call("export_data", folder=str(tmp_path / "e"))
    assert s.call("delete_everything") == {"deleted_pages": 2, "kept_saved": 0}
    assert s.call("import_data", folder=str(tmp_path / "e"))["pages"] == 2
    assert s.call("delete_domain", domain="www.a.example") == {"deleted_pages": 1, "kept_saved": 0}
    assert s.call("unsave_page", url="https://b.example/2") == {"saved_flag": 0, "page": 1}
    done = s.call("maintenance", merge_at=2)
    assert done["merged"] and done["dropped"] and not any(s.call("integrity_check").values())


def test_bad_requests(spark, root):
    s = Service(spark, root, lambda: NOW)
    for method, params in (("nothing", {}), ("_change", {"make": 1}), ("search", {"query": "x" * 2000}), ("search", {}), ("delete_domain", {"domain": "no site"}), ("add_snippet", {"quote": {"url": "https://a.example/", "text": ""}}), ("apply_retention", {"months": 0}), ("export_data", {"folder": "x", "scope": "y"})):
        with pytest.raises(BadRequest):
            s.call(method, **params)


def test_capture(spark, root):
    from dataclasses import replace

    pipe = Pipeline(spark, root, lambda: NOW)
    page = "<title>T</title><main>" + " ".join(f"word{k}" for k in range(60)) + "</main>"
    rows = [("https://a.example/1", page, False, True), ("https://a.example/2", page, True, True), ("https://x.bad.example/", page, False, True), ("http://10.0.0.1/", page, False, True), ("https://a.example/3", page, False, False), ("https://a.example/4", "<p>short", False, True)]
    batch = spark.createDataFrame([(*r, NOW) for r in rows], "url string, html string, incognito boolean, permitted boolean, at long")
    assert {r.gate for r in pipe.capture_reasons(batch).collect()} == {"disabled"}
    pipe.save(None, replace(pipe.state.excluding("bad.example"), deep_enabled=True))
    assert [r.gate for r in pipe.capture_reasons(batch).collect()] == [None, "incognito", "excluded", "ineligible", "no-permission", None]
    pipe.take_pages(batch)
    pipe.take_pages(batch)
    assert [r.url for r in pipe.archive().pages.collect()] == ["https://a.example/1"] and pipe.archive().contents.count() == 1
    pipe.exclude("a.example")
    assert pipe.archive().pages.count() == 0 and pipe.state.excluded == ("bad.example", "a.example")


def test_migration(spark, root):
    steps = [lambda a: a, lambda a: Archive(a.pages.withColumn("note", a.pages.url), a.contents, a.snippets)]

    def fails(a):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        snapshot.migrate(spark, root, [*steps, fails])
    assert snapshot.read_manifest(spark, root)["format"] == 1
    assert snapshot.migrate(spark, root, steps) == 2 and "note" in snapshot.read_snapshot(spark, root, newest=2).pages.columns
    with pytest.raises(snapshot.TooNewError):
        snapshot.read_snapshot(spark, root)


def test_percentiles_and_samples(spark):
    df = spark.range(1, 11)
    assert tuple(nearest_rank(df, "id", [0.5, 0.95]).first()) == (5, 10, 10)
    once, twice = ([r.id for r in random_rows(spark.range(100).repartition(n), "id", 5).collect()] for n in (1, 4))
    assert once == twice and len(set(once)) == 5
