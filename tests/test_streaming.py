import datetime as dt

import pytest

from pagecask.operators.archive import Archive
from pagecask.sources import snapshot
from pagecask.streaming.pipeline import REMOVAL_SCHEMA, VISIT_SCHEMA, Pipeline
from pagecask.streaming.state import CONSENT_VERSION, PipelineState

NOW = 1_791_028_800_000
DAY = 86_400_000
PAGE = "id long, url string, domain string, title string, first_seen long, last_visit long, visit_count long, typed_count long, lang string, flags int, saved_at long, content_hash string, content_indexed_at long"


def visit(k, age, at=0, title="t"):
    return (f"https://a.example/{k}", title, float(NOW - age * DAY), 1, 0, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=at))


@pytest.fixture
def pipe(spark, tmp_path):
    empty = Archive(spark.createDataFrame([], PAGE), spark.createDataFrame([], "page_id long, headings string, description string, body string, bytes long"), spark.createDataFrame([], "id long, url string, domain string, page_title string, text string, fragment string, truncated boolean, created_at long"))
    root = str(tmp_path / "root")
    snapshot.write_snapshot(empty, root, extra={"state": PipelineState().granted().dumps()})
    return Pipeline(spark, root, lambda: NOW)


def test_state_survives_and_broken_state_has_no_consent():
    s = PipelineState().granted().excluding("a.com").excluding("b.com").excluding("a.com")
    assert PipelineState.loads(s.dumps()) == s and s.excluded == ("b.com", "a.com") and s.consent == CONSENT_VERSION
    assert not PipelineState.loads("{broken").allowed and not s.revoked().allowed and s.revoked().excluded == s.excluded


def test_import_stops_and_resumes(spark, pipe):
    visits = spark.createDataFrame([visit(k, age) for k, age in enumerate((1, 3, 9, 15, 20))] + [("ftp://x", None, float(NOW - DAY), None, None, None)], VISIT_SCHEMA)
    calls = iter([False, True])
    assert pipe.run_import(visits, lambda: next(calls)) == "stopped"
    h = pipe.state.history
    assert (h.windows, h.processed, h.skipped) == (1, 2, 1) and 0 < h.progress < 1
    assert pipe.run_import(visits) == "complete" and pipe.archive().pages.count() == 5
    assert pipe.state.history.progress == 1 and pipe.run_import(visits) == "complete"
    assert pipe.reconcile(visits) == "done" and pipe.archive().pages.count() == 5


def test_nothing_without_consent(spark, pipe):
    pipe.save(None, pipe.state.revoked())
    assert pipe.run_import(spark.createDataFrame([visit(1, 1)], VISIT_SCHEMA)) == "no-consent" and pipe.maintain() == "no-consent"
    pipe.take_visits(spark.createDataFrame([visit(1, 1)], VISIT_SCHEMA))
    assert pipe.archive().pages.count() == 0


def test_live_stream_and_removals(spark, pipe, tmp_path):
    spark.createDataFrame([visit(1, 1), visit(2, 2), visit(3, 100)], VISIT_SCHEMA).write.parquet(str(tmp_path / "visits"))
    source = spark.readStream.schema(VISIT_SCHEMA).parquet(str(tmp_path / "visits"))
    pipe.stream_visits(source, str(tmp_path / "c1"), once=True).awaitTermination()
    assert {r.url[-1] for r in pipe.archive().pages.collect()} == {"1", "2", "3"}
    spark.createDataFrame([visit(1, 50, 9, "")], VISIT_SCHEMA).write.mode("append").parquet(str(tmp_path / "visits"))
    pipe.stream_visits(source, str(tmp_path / "c1"), once=True).awaitTermination()  # late, without a title
    one = pipe.archive().pages.where("url like '%1'").first()
    assert one.title == "t" and one.last_visit == NOW - DAY
    spark.createDataFrame([(1, False, ["https://a.example/1", "https://a.example/3"], None)], REMOVAL_SCHEMA).write.parquet(str(tmp_path / "gone"))
    pipe.stream_removals(spark.readStream.schema(REMOVAL_SCHEMA).parquet(str(tmp_path / "gone")), str(tmp_path / "c2"), once=True).awaitTermination()
    assert {r.url[-1] for r in pipe.archive().pages.collect()} == {"2", "3"}  # the third had expired


def test_pause_and_upkeep(spark, pipe):
    from dataclasses import replace

    pipe.take_visits(spark.createDataFrame([visit(1, 1), visit(2, 500)], VISIT_SCHEMA))
    pipe.save(None, replace(pipe.state, settings=replace(pipe.state.settings, paused=True)))
    pipe.take_visits(spark.createDataFrame([visit(3, 1)], VISIT_SCHEMA))
    assert pipe.state.reconcile_due and pipe.archive().pages.count() == 2
    assert pipe.maintain() == "done" and pipe.archive().pages.count() == 1
    assert pipe.state.last_integrity == (NOW, True) and pipe.state.last_maintenance_at == NOW
