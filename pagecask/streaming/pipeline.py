"""Backfill, live visits, removals and upkeep over a snapshot.

Each step is idempotent, so a replayed batch changes nothing: visits merge by
arrival order, removals ask for what is already gone, the backfill notes after
every window how far it came.  A step reads and writes the parts of the archive
that hold its addresses; if another writer was first, it starts again from that
one's state.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagecask.functions.text import content_hash
from pagecask.functions.urls import capture_reason, normalized_url
from pagecask.operators import archive as A
from pagecask.operators.reports import integrity
from pagecask.shipping import ship
from pagecask.sources import snapshot
from pagecask.sources.html import extract_pages
from pagecask.sources.scratch import written
from pagecask.streaming.schedule import due, rearmed
from pagecask.streaming.state import PipelineState

WINDOW_MS = 7 * A.DAY_MS
TITLES_AFTER_MS = 30_000
OVERLAP_MS = A.DAY_MS
INTEGRITY_EVERY_MS = 7 * A.DAY_MS
TRIES = 5
VISIT_SCHEMA = "url string, title string, last_visit_time double, visit_count long, typed_count long, received_at timestamp_ntz"
REMOVAL_SCHEMA = "removal_id long, all_history boolean, urls array<string>, received_at timestamp_ntz"


def arrival(batch: DataFrame):
    return F.struct("received_at", "last_visit_time", F.coalesce("title", F.lit("")), F.coalesce("visit_count", F.lit(1)), F.coalesce("typed_count", F.lit(0)))


def retried(step):
    """One step at a time in this process; begun again if another process made the next version first."""

    @functools.wraps(step)
    def run(self, *args, **kwargs):
        with snapshot.writer_lock(self.root):
            for left in range(TRIES - 1, -1, -1):
                try:
                    return step(self, *args, **kwargs)
                except snapshot.ConflictError:
                    if not left:
                        raise

    return run


def addresses(batch: DataFrame, column: str = "url") -> DataFrame:
    return batch.select(normalized_url(F.col(column)).alias("url")).where(F.col("url").isNotNull())


def capture_gates(state: PipelineState, batch: DataFrame) -> DataFrame:
    """``batch`` (url, html, incognito, permitted, at) with ``gate``: null, or the first reason against a capture."""
    closed = "disabled" if not state.deep_enabled else "no-consent" if not state.allowed else "paused" if state.settings.paused else None
    if closed:
        return batch.withColumn("gate", F.lit(closed))
    own, excluded = capture_reason(F.col("url")), capture_reason(F.col("url"), list(state.excluded))
    gate = F.when(own.isNotNull(), own).when(F.col("incognito"), "incognito").when(excluded.isNotNull(), excluded).when(~F.col("permitted"), "no-permission")
    return batch.withColumn("gate", gate)


class Pipeline:
    """One writer over one snapshot folder; the import goes by windows of ``window_ms``."""

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], int], window_ms: int = WINDOW_MS) -> None:
        self.spark, self.root, self.now, self.window_ms = spark, root, now, window_ms
        ship(spark)

    @property
    def state(self) -> PipelineState:
        manifest = snapshot.read_manifest(self.spark, self.root)
        return PipelineState.loads((manifest or {}).get("extra", {}).get("state"))

    def archive(self) -> A.Archive:
        return snapshot.read_snapshot(self.spark, self.root)

    def save(self, archive: A.Archive | None, state: PipelineState, base: snapshot.Opened | None = None) -> None:
        """The archive, if it changed, and the state become visible together; ``base`` is what the archive was made of."""
        if archive is not None:
            snapshot.write_snapshot(archive, self.root, base=base, extra={"state": state.dumps()})
            snapshot.drop_old_versions(self.spark, self.root)
        else:
            manifest = snapshot.read_manifest(self.spark, self.root)
            snapshot.write_manifest(self.spark, self.root, manifest | {"extra": manifest["extra"] | {"state": state.dumps()}})

    # --- backfill ---

    def _import(self, visits: DataFrame, start: int, end: int) -> tuple[A.Archive, snapshot.Opened, int, int]:
        part = visits.where((F.col("last_visit_time") >= start) & (F.col("last_visit_time") < end))
        base = snapshot.open_for(self.spark, self.root, addresses(part))
        archive, summary = A.upsert_history(base.archive, part, arrival(part))
        s = summary.first()
        return archive, base, s.inserted + s.updated, s.skipped

    @retried
    def run_import(self, visits: DataFrame, stop: Callable[[], bool] = lambda: False) -> str:
        """Newest window first; may be stopped and goes on where it was."""
        state = self.state
        if not state.allowed:
            return "no-consent"
        h = state.history
        if h.status == "complete":
            return "complete"
        if h.status != "running":
            now = self.now()
            first = visits.agg(F.min("last_visit_time")).first()[0]
            h = replace(h, status="running", range_start=now + 1 if first is None else max(0, int(first)), next_end=now + 1, started_at=now)
            state = replace(state, history=h, last_reconcile_at=now)
            self.save(None, state)
        while h.next_end > h.range_start:
            if stop():
                return "stopped"
            start = max(h.range_start, h.next_end - self.window_ms)
            archive, base, processed, skipped = self._import(visits, start, h.next_end)
            h = replace(h, next_end=start, processed=h.processed + processed, skipped=h.skipped + skipped, windows=h.windows + 1)
            state = replace(state, history=h)
            self.save(archive, state, base)
        self.save(None, replace(state, reconcile_due=False, history=replace(h, status="complete", completed_at=self.now())))
        return "complete"

    @retried
    def reconcile(self, visits: DataFrame) -> str:
        """Reads again from a day before the last time; merging makes the overlap harmless."""
        state = self.state
        if not state.allowed:
            return "no-consent"
        if state.history.status != "complete":
            return "not-ready"
        now = self.now()
        since = max(0, (state.last_reconcile_at or now) - OVERLAP_MS)
        archive, base, _, _ = self._import(visits, since, now + 1)
        self.save(archive, replace(state, last_reconcile_at=now, reconcile_due=False), base)
        return "done"

    # --- live ---

    @retried
    def take_visits(self, batch: DataFrame, batch_id: int = 0) -> None:
        """A micro-batch of visits; dropped without consent, kept for the reconcile while paused. Visits without a title ask for a refresh of titles."""
        state = self.state
        if not state.allowed:
            return
        if state.settings.paused:
            if not state.reconcile_due:
                self.save(None, replace(state, reconcile_due=True))
            return
        base = snapshot.open_for(self.spark, self.root, addresses(batch))
        archive, _ = A.upsert_history(base.archive, batch, arrival(batch))
        if state.titles_at is None and batch.where(F.coalesce("title", F.lit("")) == "").limit(1).count():
            state = replace(state, titles_at=self.now() + TITLES_AFTER_MS)
        self.save(archive, state, base)

    @retried
    def take_removals(self, batch: DataFrame, batch_id: int = 0) -> None:
        """A micro-batch of removals, each judged at its own time; a removal of everything comes last. Works while paused."""
        state = self.state
        if not state.allowed or not state.settings.mirror_deletion:
            return
        own_time = F.coalesce(F.unix_millis(F.col("received_at").cast("timestamp")), F.lit(self.now()))
        if batch.where("all_history").limit(1).count():
            base = snapshot.open_snapshot(self.spark, self.root)
        else:
            base = snapshot.open_for(self.spark, self.root, addresses(batch.select(F.explode("urls").alias("url"))), contents=True)
        archive = base.archive
        plan = A.plan_removals(archive.pages, batch, own_time)
        archive, _ = A.delete_urls(archive, plan.where("action = 'delete'").select("url"))
        if not base.parts:
            archive, _ = A.delete_all_except_saved(archive)
        self.save(archive, state, base)

    def capture_reasons(self, batch: DataFrame) -> DataFrame:
        return capture_gates(self.state, batch)

    @retried
    def take_pages(self, batch: DataFrame, batch_id: int = 0) -> None:
        """A micro-batch of loaded pages: gates, extraction, and texts that are new."""
        open_ = self.capture_reasons(batch).where(F.col("gate").isNull()).select("url", "html", F.col("at").cast("double").alias("at"))
        texts = extract_pages(open_).where(F.col("reason").isNull())
        hashed = texts.withColumn("content_hash", content_hash(*(F.col(c) for c in ("title", "headings", "description", "body"))))
        hashed = written(hashed, "captured")  # extracted once
        base = snapshot.open_for(self.spark, self.root, addresses(hashed), contents=True)
        archive, _ = A.upsert_content(base.archive, hashed)
        self.save(archive, self.state, base)

    @retried
    def exclude(self, site: str) -> None:
        """Captures of a site stop, and what was captured of it goes."""
        state = self.state.excluding(site)
        base = snapshot.open_snapshot(self.spark, self.root)
        archive, _ = A.clear_deep_content(base.archive, site)
        self.save(archive, state, base)

    @retried
    def refresh_titles(self, visits: DataFrame, minutes: int = 20) -> None:
        """Reads the latest visits again, for titles that came after the visit."""
        now = self.now()
        archive, base, _, _ = self._import(visits, now - minutes * 60_000, now + 1)
        self.save(archive, replace(self.state, titles_at=None), base)

    def resume(self, visits: DataFrame) -> str:
        """After a pause: goes on with the import, or fills the gap."""
        state = self.state
        self.save(None, replace(state, settings=replace(state.settings, paused=False)))
        return self.run_import(visits) if state.history.status != "complete" else self.reconcile(visits)

    def stream_pages(self, source: DataFrame, checkpoint: str, *, once: bool = False) -> StreamingQuery:
        return self._stream(source, self.take_pages, checkpoint, once)

    def stream_visits(self, source: DataFrame, checkpoint: str, *, once: bool = False) -> StreamingQuery:
        return self._stream(source, self.take_visits, checkpoint, once)

    def stream_removals(self, source: DataFrame, checkpoint: str, *, once: bool = False) -> StreamingQuery:
        return self._stream(source, self.take_removals, checkpoint, once)

    def _stream(self, source: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
        writer = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()

    # --- upkeep ---

    @retried
    def maintain(self) -> str:
        """Retention, then the cap, bounded compaction and a merge of the indexes, then once a week a check; runs while paused too."""
        state = self.state
        if not state.allowed:
            return "no-consent"
        now, s = self.now(), state.settings
        base = snapshot.open_snapshot(self.spark, self.root)
        archive, _ = A.apply_retention(base.archive, s.retention_months, now)
        archive, _ = A.enforce_cap(archive, s.cap_mb * 1_000_000)
        state = replace(state, last_maintenance_at=now)
        self.save(archive, state, base)
        snapshot.compact(self.spark, self.root)
        snapshot.merge_indexes(self.spark, self.root)
        if state.last_integrity is None or now - state.last_integrity[0] >= INTEGRITY_EVERY_MS:
            opened = snapshot.open_snapshot(self.spark, self.root)
            a, index = opened.archive, snapshot.read_index(self.spark, opened.manifest, "pages")
            bad = integrity(a.pages, a.contents, index).agg(F.sum("problems")).first()[0]
            self.save(None, replace(state, last_integrity=(now, not bad)))
        return "done"

    def tick(self, visits: DataFrame) -> list[str]:
        """Does what is due by the schedule; called every minute, or whenever a trigger fires. The names of what was done."""
        now, done = self.now(), []
        for name in due(self.state, now):
            {"import": self.run_import, "reconcile": self.reconcile, "titles": self.refresh_titles, "maintain": lambda _: self.maintain()}[name](visits)
            done.append(name)
        armed = rearmed(self.state, now, done)
        if armed != self.state:
            self.save(None, armed)
        return done
