"""The archive's calls over one snapshot folder: each reads the current version, and writers make the next.

``call`` takes a method's name and parameters, checks them, and returns a plain
value or a DataFrame; mistakes of the caller raise ``BadRequest``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecask.functions.text import fold_text
from pagecask.functions.urls import normalize_url
from pagecask.operators import archive as A
from pagecask.operators import index as I
from pagecask.operators import reports as R
from pagecask.operators import search as S
from pagecask.plans.query import parse_query, site_value
from pagecask.shipping import ship
from pagecask.sources import exchange, snapshot
from pagecask.streaming.pipeline import TRIES, addresses

QUERY, BATCH, RESULTS = 1000, 5000, 200
VISITS = "url string, title string, last_visit_time double, visit_count long, typed_count long"
TEXTS = "url string, title string, headings string, description string, body string, lang string, content_hash string, at double"
QUOTES = "url string, page_title string, text string, fragment string, created_at double"


class BadRequest(ValueError):
    """A call with parameters that mean nothing."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise BadRequest(what)


class Service:
    """Each change reads and writes the parts of the archive that hold its addresses; changes that choose by other columns read all pages."""

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], int]) -> None:
        self.spark, self.root, self.now = spark, root, now
        ship(spark)

    # --- plumbing ---

    def call(self, method: str, **params: Any) -> Any:
        f = getattr(self, method, None)
        _need(not method.startswith("_") and method not in ("call",) and callable(f), f"no method {method}")
        try:
            inspect.signature(f).bind(**params)
        except TypeError as e:
            raise BadRequest(str(e)) from e
        return f(**params)

    def _open(self, parts: dict | None = None) -> snapshot.Opened:
        opened = snapshot.open_snapshot(self.spark, self.root, parts=parts)
        _need(opened is not None, "no archive here")
        return opened

    def _state(self) -> A.Archive:
        return self._open().archive

    def _change(self, make: Callable[[A.Archive], tuple[A.Archive, DataFrame]], urls: DataFrame | None = None, contents: bool = True) -> dict:
        """Writes what ``make`` makes of the archive, or of the parts that hold ``urls``; begun again if another writer was first."""
        with snapshot.writer_lock(self.root):
            for left in range(TRIES - 1, -1, -1):
                base = self._open() if urls is None else snapshot.open_for(self.spark, self.root, addresses(urls), contents)
                state, summary = make(base.archive)
                done = summary.first().asDict()
                try:
                    snapshot.write_snapshot(state, self.root, base=base)
                    return done
                except snapshot.ConflictError:
                    if not left:
                        raise
        return {}

    def _rows(self, rows: list[dict], schema: str) -> DataFrame:
        _need(len(rows) <= BATCH, f"at most {BATCH} rows a call")
        names = [c.split()[0] for c in schema.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    # --- writes ---

    def ping(self) -> str:
        return "pong"

    def upsert_history(self, rows: list[dict]) -> dict:
        batch = self._rows([r | {"seq": k} for k, r in enumerate(rows)], VISITS + ", seq long")
        return self._change(lambda a: A.upsert_history(a, batch, F.col("seq")), batch, contents=False)

    def upsert_content(self, page: dict) -> dict:
        batch = self._rows([page], TEXTS)
        return self._change(lambda a: A.upsert_content(a, batch), batch)

    def save_page(self, page: dict) -> dict:
        batch = self._rows([page], TEXTS)
        return self._change(lambda a: A.upsert_content(a, batch, save=True), batch)

    def add_snippet(self, quote: dict) -> dict:
        _need(0 < len(quote.get("text") or "") <= 100_000, "a quote has 1 to 100,000 characters")
        batch = self._rows([quote], QUOTES)
        fresh = A.new_snippets(batch)
        row = fresh.first()
        if row is None:
            return {"skipped": True}
        done = fresh.select("id", "truncated")
        return self._change_snippets(lambda a: (A.add_snippets(a, batch), done), [row.id])

    def unsave_page(self, url: str) -> dict:
        urls = self._rows([{"url": url}], "url string")
        return self._change(lambda a: A.unsave(a, urls), urls)

    def delete_snippet(self, id: int) -> dict:
        ids = self._rows([{"id": id}], "id long")
        return self._change_snippets(lambda a: (A.delete_snippets(a, ids), a.snippets.where(F.col("id") == id).agg((F.count("*") > 0).alias("deleted"))), [id])

    def _change_snippets(self, make: Callable[[A.Archive], tuple[A.Archive, DataFrame]], ids: list[int]) -> dict:
        """As ``_change``, for the parts that hold the quotes ``ids``."""
        parts = {"snippets": snapshot.parts_of(self._rows([{"id": i} for i in ids], "id long"))}
        with snapshot.writer_lock(self.root):
            base = self._open(parts)
            state, summary = make(base.archive)
            done = summary.first().asDict()
            snapshot.write_snapshot(state, self.root, base=base)
            return done

    def clear_deep_content(self, domain: str | None = None) -> dict:
        return self._change(lambda a: A.clear_deep_content(a, self._site(domain) if domain else None))

    def delete_urls(self, urls: list[str]) -> dict:
        rows = self._rows([{"url": u} for u in urls], "url string")
        return self._change(lambda a: A.delete_urls(a, rows), rows)

    def delete_domain(self, domain: str, include_saved: bool = False) -> dict:
        return self._change(lambda a: A.delete_domain(a, self._site(domain), include_saved))

    def delete_range(self, start: int, end: int) -> dict:
        return self._change(lambda a: A.delete_range(a, start, end))

    def delete_all_except_saved(self) -> dict:
        return self._change(lambda a: A.delete_all_except_saved(a))

    def delete_everything(self) -> dict:
        return self._change(lambda a: A.delete_everything(a))

    def apply_retention(self, months: int | None) -> dict:
        _need(months is None or months >= 1, "months are at least 1")
        return self._change(lambda a: A.apply_retention(a, months, self.now()))

    def enforce_cap(self, max_bytes: int) -> dict:
        _need(max_bytes >= 0, "a cap is not negative")
        return self._change(lambda a: A.enforce_cap(a, max_bytes))

    def maintenance(self, most_files: int = 8, parts: int = 4, merge_at: int = snapshot.MERGE_AT, keep: int = 2) -> dict:
        """One bounded step: compacts the parts with most files, merges indexes of many segments, drops old versions."""
        _need(most_files >= 1 and parts >= 1 and merge_at >= 2 and keep >= 1, "maintenance parameters are at least 1, merge_at 2")
        compacted = snapshot.compact(self.spark, self.root, most_files, parts)
        merged = snapshot.merge_indexes(self.spark, self.root, merge_at)
        return {"compacted": compacted, "merged": merged, "dropped": snapshot.drop_old_versions(self.spark, self.root, keep)}

    # --- reads ---

    def _index(self, name: str, opened: snapshot.Opened | None = None) -> I.Index:
        return snapshot.read_index(self.spark, (opened or self._open()).manifest, name)

    def respond(self, query: str, limit: int = 50, tz_minutes: int = 0) -> S.Found:
        """Results, suggestions, the filters understood, and the time taken."""
        _need(len(query) <= QUERY and 1 <= limit <= RESULTS and abs(tz_minutes) <= 840, "query, limit or time zone out of range")
        opened, now = self._open(), self.now()
        a = opened.archive
        return S.find(a.pages, a.contents, a.snippets, parse_query(query, now, tz_minutes), now, limit, self._index("pages", opened), self._index("snippets", opened))

    def search(self, query: str, limit: int = 50, tz_minutes: int = 0) -> DataFrame:
        return self.respond(query, limit, tz_minutes).results

    def suggest(self, term: str, limit: int = 3) -> list[str]:
        return [r.term for r in S.suggest(self._index("pages").vocabulary, fold_text(term), limit).collect()]

    def last_visits(self, urls: list[str]) -> DataFrame:
        return A.last_visits(self._state().pages, self._rows([{"url": u} for u in urls], "url string"))

    def stats(self) -> dict:
        s = self._state()
        return R.archive_stats(s.pages, s.contents, s.snippets).first().asDict()

    def domain_stats(self, limit: int = 100) -> DataFrame:
        s = self._state()
        return R.domain_stats(s.pages, s.contents, limit)

    def page_info(self, url: str) -> dict | None:
        s = self._state()
        row = R.page_info(s.pages, s.contents, s.snippets, normalize_url(url) or url).first()
        return row and row.asDict()

    def integrity_check(self) -> dict:
        s = self._state()
        return {r.check: r.problems for r in R.integrity(s.pages, s.contents, self._index("pages")).collect()}

    def export_data(self, folder: str, scope: str = "all") -> None:
        _need(scope in ("all", "saved"), "scope is all or saved")
        exchange.write_export(self._state(), folder, scope)

    def import_data(self, folder: str) -> dict:
        return self._change(lambda a: exchange.import_export(a, folder))

    # --- compositions ---

    def remember(self, url: str, title: str | None, html: str | None) -> dict:
        """Saves a page with its text, or by title alone if none can be had."""
        from pagecask.sources.html import extract

        got = extract(html, deep=False, least=0) if html else {"reason": "too-little-text"}
        page = {k: got.get(k) for k in ("headings", "description", "body", "lang")}
        return self.save_page({"url": url, "title": got.get("title") or title, "at": float(self.now())} | page)

    def save_selection(self, url: str, page_title: str | None, text: str) -> dict:
        """Keeps a selected passage with a link that reopens it."""
        from pagecask.functions.display import text_fragment

        link = self.spark.range(1).select(text_fragment(F.lit(text))).first()[0]
        return self.add_snippet({"url": url, "page_title": page_title, "text": text, "fragment": link, "created_at": float(self.now())})

    @staticmethod
    def _site(domain: str) -> str:
        site = site_value(domain)
        _need(site is not None, f"no site: {domain}")
        return site

