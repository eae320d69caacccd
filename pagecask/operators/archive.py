"""The archive as immutable tables: every change is a function from state to state.

State is pages, contents and snippets.  A change returns the new state and a
one-row summary; nothing is overwritten until the caller writes the new state
(``sources.snapshot``).  Keys are addresses in normal form.  Batches carry an
arrival order, since titles and counts go by the last arrival, dates by the
extremes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagecask.functions.text import clip, half_up, text_bytes
from pagecask.functions.urls import domain_of, in_site, normalized_url
from pagecask.operators.ordered import in_ranges, running_total
from pagecask.operators.search import CONTENT, HISTORY, SAVED, has_flag
from pagecask.sources.scratch import written

DAY_MS = 86_400_000
TITLE, BODY, HEADINGS, DESCRIPTION, SNIPPET, LANG = 2000, 50_000, 5000, 1000, 5000, 35
#: The browser forgets visits after 90 days by itself; removals of older pages are no wish of the user.
EXPIRY_DAYS = 85
PAGE_COLUMNS = ["id", "url", "domain", "title", "first_seen", "last_visit", "visit_count", "typed_count", "lang", "flags", "saved_at", "content_hash", "content_indexed_at"]
CONTENT_COLUMNS = ["page_id", "headings", "description", "body", "bytes"]


@dataclass(frozen=True)
class Archive:
    pages: DataFrame
    contents: DataFrame
    snippets: DataFrame


def page_id(url: Column) -> Column:
    """Id of a new page: a hash of its address, so that it is the same in every run."""
    return F.xxhash64(url)


def _clear(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(7 & ~bits)


def _set(flags: Column, bits: int) -> Column:
    return flags.bitwiseOR(bits)


def _pages(df: DataFrame) -> DataFrame:
    return df.select(*PAGE_COLUMNS)


# --- history -----------------------------------------------------------------


def history_by_page(batch: DataFrame, order: Column) -> DataFrame:
    """One row an address: earliest and latest visit, what the last arrival says, the last title that says something.

    A hot address is merged map-side before the shuffle.
    """
    rows = batch.withColumn("_url", normalized_url(F.col("url"))).where(F.col("_url").isNotNull()).select(
        F.col("_url").alias("url"), clip(F.col("title"), TITLE).alias("title"), half_up(F.col("last_visit_time")).alias("at"),
        F.coalesce("visit_count", F.lit(1)).alias("visits"), F.coalesce("typed_count", F.lit(0)).alias("typed"), order.alias("seq"),
    )
    named = F.when(F.col("title") != "", F.col("seq"))
    return rows.groupBy("url").agg(
        F.min_by("at", "seq").alias("first_at"), F.max("at").alias("last_at"), F.max_by("visits", "seq").alias("visits"),
        F.max_by("typed", "seq").alias("typed"), F.max_by("title", named).alias("title"), F.count("*").alias("n"),
    )


def upsert_history(state: Archive, batch: DataFrame, order: Column) -> tuple[Archive, DataFrame]:
    """Visits into pages: dates by extremes, counts by the last arrival even if it leaves them out, titles never emptied."""
    seen = history_by_page(batch, order)
    old = state.pages
    both = old.join(seen.select(F.col("url").alias("s_url"), F.col("title").alias("s_title"), "first_at", "last_at", "visits", "typed", "n"), old["url"] == F.col("s_url"), "full_outer")
    new, hit = F.col("url").isNull(), F.col("s_url").isNotNull()
    url = F.coalesce("url", "s_url")
    merged = both.select(
        F.coalesce("id", page_id(F.col("s_url"))).alias("id"), url.alias("url"), F.coalesce("domain", domain_of(F.col("s_url"))).alias("domain"),
        F.when(hit & F.col("s_title").isNotNull(), F.col("s_title")).when(new, "").otherwise(F.col("title")).alias("title"),
        F.coalesce("first_seen", "first_at").alias("first_seen"), F.greatest("last_visit", "last_at").alias("last_visit"),
        F.when(hit, F.col("visits")).otherwise(F.col("visit_count")).cast("long").alias("visit_count"),
        F.when(hit, F.col("typed")).otherwise(F.col("typed_count")).cast("long").alias("typed_count"), "lang",
        F.when(hit, _set(F.coalesce("flags", F.lit(0)), HISTORY)).otherwise(F.col("flags")).cast("int").alias("flags"), "saved_at", "content_hash", "content_indexed_at",
    )
    known = seen.join(old.select("url"), "url", "left_semi").agg(F.count("*").alias("known"))
    counts = seen.agg(F.count("*").alias("addresses"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    total = batch.agg(F.count("*").alias("total"))
    summary = counts.withColumns({"known": known.scalar(), "total": total.scalar()}).select(
        (F.col("addresses") - F.col("known")).alias("inserted"), (F.col("rows") - F.col("addresses") + F.col("known")).alias("updated"),
        (F.col("total") - F.col("rows")).alias("skipped"),
    )
    return replace(state, pages=merged), summary


# --- content -----------------------------------------------------------------


def _texts(rows: DataFrame) -> DataFrame:
    cut = {"headings": HEADINGS, "description": DESCRIPTION, "body": BODY}
    own = rows.select("url", *(clip(F.col(c), n).alias(c) for c, n in cut.items()))
    return own.withColumn("bytes", text_bytes(*(F.col(c) for c in cut)))


def _one_row_each(rows: DataFrame, *order: str) -> DataFrame:
    """The last row of each address in ``order``; equal ones are told apart by all they say."""
    whole = F.struct(*rows.columns)
    best = rows.groupBy("url").agg(F.max_by(whole, F.struct(*order, whole)).alias("_row"))
    return best.select("_row.*")


def upsert_content(state: Archive, batch: DataFrame, *, save: bool = False) -> tuple[Archive, DataFrame]:
    """Texts into the archive; of several rows of an address in ``batch`` the latest counts (url, title, headings, description, body, lang, content_hash, at).

    Captured texts are left alone if the hash is known and the text is there;
    saved ones are always written and keep an older language.
    """
    norm = _one_row_each(batch.withColumn("url", normalized_url(F.col("url"))).where(F.col("url").isNotNull()), "at")
    old = state.pages
    same = old.where(F.col("content_hash").isNotNull() & has_flag(F.col("flags"), CONTENT)).select("url", "content_hash")
    todo = norm if save else norm.join(same, ["url", "content_hash"], "left_anti")
    b = todo.select(
        F.col("url").alias("n_url"), clip(F.col("title"), TITLE).alias("n_title"), F.substring("lang", 1, LANG).alias("n_lang"),
        F.col("content_hash").alias("n_hash"), half_up(F.col("at")).alias("n_at"),
    )
    hit = F.col("n_url").isNotNull()
    j = old.join(b, old["url"] == b["n_url"], "full_outer")
    flags = _set(F.coalesce("flags", F.lit(0)), CONTENT | SAVED if save else CONTENT)
    merged = j.select(
        F.coalesce("id", page_id(F.col("n_url"))).alias("id"), F.coalesce("url", "n_url").alias("url"), F.coalesce("domain", domain_of(F.col("n_url"))).alias("domain"),
        F.when(hit & (F.col("n_title") != ""), F.col("n_title")).otherwise(F.coalesce("title", F.lit(""))).alias("title"),
        F.coalesce("first_seen", "n_at").alias("first_seen"), F.coalesce("last_visit", "n_at").alias("last_visit"),
        F.coalesce("visit_count", F.lit(0)).cast("long").alias("visit_count"), F.coalesce("typed_count", F.lit(0)).cast("long").alias("typed_count"),
        F.when(hit, F.coalesce("n_lang", "lang") if save else F.col("n_lang")).otherwise(F.col("lang")).alias("lang"),
        F.when(hit, flags).otherwise(F.col("flags")).cast("int").alias("flags"),
        (F.when(hit, F.col("n_at")).otherwise(F.col("saved_at")) if save else F.col("saved_at")).alias("saved_at"),
        F.when(hit, F.col("n_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(hit, F.col("n_at")).otherwise(F.col("content_indexed_at")).alias("content_indexed_at"),
    )
    ids = merged.select(F.col("id").alias("page_id"), "url")
    texts = _texts(todo).join(ids, "url").select(*CONTENT_COLUMNS)
    contents = state.contents.join(texts, "page_id", "left_anti").select(*CONTENT_COLUMNS).unionByName(texts)
    done = todo.agg(F.count("*").alias("changed"))
    summary = batch.agg(F.count("*").alias("given")).withColumn("changed", done.scalar()).select("changed", (F.col("given") - F.col("changed")).alias("unchanged_or_skipped"))
    return replace(state, pages=merged, contents=contents), summary


def new_snippets(batch: DataFrame) -> DataFrame:
    """Quotes (url, page_title, text, fragment, created_at) as rows of the snippets table; those without an address are left out."""
    rows = batch.withColumn("url", normalized_url(F.col("url"))).where(F.col("url").isNotNull() & (F.col("text") != ""))
    key = F.xxhash64("url", "text", F.col("created_at"))
    return rows.select(
        key.alias("id"), "url", domain_of(F.col("url")).alias("domain"), clip(F.col("page_title"), TITLE).alias("page_title"),
        F.substring("text", 1, SNIPPET).alias("text"), "fragment", (F.length("text") > SNIPPET).alias("truncated"), half_up(F.col("created_at")).alias("created_at"),
    )


def add_snippets(state: Archive, batch: DataFrame) -> Archive:
    return replace(state, snippets=state.snippets.unionByName(new_snippets(batch)))


def delete_snippets(state: Archive, ids: DataFrame) -> Archive:
    return replace(state, snippets=state.snippets.join(ids.select("id"), "id", "left_anti"))


# --- removal -------------------------------------------------------------------


def _without(contents: DataFrame, gone: DataFrame) -> DataFrame:
    """Texts but those of the pages that go; ``gone`` may know a part of the archive only."""
    return contents.join(gone.select(F.col("id").alias("page_id")), "page_id", "left_anti")


def remove_history(state: Archive, chosen: Column) -> tuple[Archive, DataFrame]:
    """Chosen pages go; saved ones only lose their place in the history. ``chosen`` is a condition on pages."""
    saved, picked = has_flag(F.col("flags"), SAVED), F.coalesce(chosen, F.lit(False))
    kept = state.pages.where(~(picked & ~saved)).withColumn("flags", F.when(picked & saved, _clear(F.col("flags"), HISTORY)).otherwise(F.col("flags")).cast("int"))
    summary = state.pages.where(picked).agg(F.count_if(~saved).alias("deleted_pages"), F.count_if(saved).alias("kept_saved"))
    return replace(state, pages=_pages(kept), contents=_without(state.contents, state.pages.where(picked & ~saved))), summary


def delete_urls(state: Archive, urls: DataFrame) -> tuple[Archive, DataFrame]:
    """``urls``: one column, url, in any form."""
    keys = urls.select(normalized_url(F.col("url")).alias("url")).where(F.col("url").isNotNull()).distinct().withColumn("_gone", F.lit(True))
    marked = state.pages.join(keys, "url", "left")
    out, summary = remove_history(replace(state, pages=marked), F.col("_gone"))
    return out, summary


def delete_domain(state: Archive, site: str, include_saved: bool = False) -> tuple[Archive, DataFrame]:
    own = in_site(F.col("domain"), site)
    if not include_saved:
        return remove_history(state, own)
    summary = state.pages.agg(F.count_if(own).alias("deleted_pages"), F.lit(0).cast("long").alias("kept_saved"))
    return Archive(state.pages.where(~own), _without(state.contents, state.pages.where(own)), state.snippets.where(~own)), summary


def delete_range(state: Archive, start: int, end: int) -> tuple[Archive, DataFrame]:
    return remove_history(state, (F.col("last_visit") >= start) & (F.col("last_visit") < end))


def delete_all_except_saved(state: Archive) -> tuple[Archive, DataFrame]:
    return remove_history(state, F.lit(True))


def delete_everything(state: Archive) -> tuple[Archive, DataFrame]:
    summary = state.pages.agg(F.count("*").alias("deleted_pages"), F.lit(0).cast("long").alias("kept_saved"))
    return Archive(state.pages.limit(0), state.contents.limit(0), state.snippets.limit(0)), summary


def apply_retention(state: Archive, months: int | None, now: int) -> tuple[Archive, DataFrame]:
    """Months have 30 days; None keeps everything."""
    return remove_history(state, F.lit(False)) if months is None else delete_range(state, 0, now - months * 30 * DAY_MS)


def unsave(state: Archive, urls: DataFrame) -> tuple[Archive, DataFrame]:
    """Saved pages lose their text and mark if the history has them, else go."""
    keys = urls.select(normalized_url(F.col("url")).alias("url")).where(F.col("url").isNotNull()).distinct().withColumn("_pick", F.lit(True))
    marked = state.pages.join(keys, "url", "left")
    pick = F.coalesce("_pick", F.lit(False)) & has_flag(F.col("flags"), SAVED)
    visited = has_flag(F.col("flags"), HISTORY)
    nothing = lambda c: F.when(~pick, F.col(c)).alias(c)
    kept = marked.where(~(pick & ~visited)).select(
        *[c for c in PAGE_COLUMNS if c not in ("flags", "saved_at", "content_hash", "content_indexed_at")],
        F.when(pick, _clear(F.col("flags"), SAVED | CONTENT)).otherwise(F.col("flags")).cast("int").alias("flags"), nothing("saved_at"), nothing("content_hash"), nothing("content_indexed_at"),
    )
    gone = marked.where(pick).select(F.col("id").alias("page_id"))
    summary = marked.where(pick).agg(F.count_if(visited).alias("saved_flag"), F.count_if(~visited).alias("page"))
    return replace(state, pages=_pages(kept), contents=state.contents.join(gone, "page_id", "left_anti")), summary


def clear_deep_content(state: Archive, site: str | None = None) -> tuple[Archive, DataFrame]:
    """Captured texts of pages that are not saved go, of one site or of all; pages known by text alone go with them."""
    flags = F.col("flags")
    pick = has_flag(flags, CONTENT) & ~has_flag(flags, SAVED) & (in_site(F.col("domain"), site) if site else F.lit(True))
    visited = has_flag(flags, HISTORY)
    hidden = {c: F.when(~pick, F.col(c)) for c in ("content_hash", "content_indexed_at")}
    kept = state.pages.where(~(pick & ~visited)).withColumns(hidden | {"flags": F.when(pick, _clear(flags, CONTENT)).otherwise(flags).cast("int")})
    gone = state.pages.where(pick).select(F.col("id").alias("page_id"))
    summary = state.pages.where(pick).agg(F.count_if(~visited).alias("deleted_pages"), F.count_if(visited).alias("demoted_pages"))
    return replace(state, pages=_pages(kept), contents=state.contents.join(gone, "page_id", "left_anti")), summary


#: What a page takes beside its address, site and title: its numbers.
ROW_BYTES = 64


def page_bytes() -> Column:
    return text_bytes(F.col("url"), F.col("domain"), F.col("title")) + ROW_BYTES


def _oldest_batches(rows: DataFrame, over: Column, batch: int, name: str) -> DataFrame:
    """(id, bytes): of ``rows`` (id, last_visit, bytes) the oldest, in whole batches, until ``over`` bytes are freed or none is left."""
    order = [F.col("last_visit"), F.col("id")]
    ranked = running_total(running_total(in_ranges(rows, order, name), order, F.lit(1), "place"), order, F.col("bytes"), "freed")
    ranked = ranked.withColumn("_batch", F.floor((F.col("place") - 1) / batch))
    by = ranked.groupBy("_batch").agg(F.max("freed").alias("_freed"))
    by = in_ranges(by, [F.col("_batch")], f"{name}-batches")
    prior = F.lag("_freed").over(Window.partitionBy("_range").orderBy("_batch"))
    edges = by.groupBy("_range").agg(F.max("_freed").alias("_edge"))  # a row a range
    before = F.max("_edge").over(Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = edges.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    needed = by.join(starts, "_range").select("_batch", F.coalesce(prior, "_start").alias("_before")).where(over > F.col("_before")).agg(F.max("_batch").alias("last"))
    return ranked.where(F.col("_batch") <= needed.scalar()).select("id", "bytes")


def cap_plan(state: Archive, max_bytes: int, batch: int = 200) -> DataFrame:
    """(id, bytes, step): pages to touch so that the archive takes at most ``max_bytes``; oldest first, whole batches, as many as it takes.

    Step ``trim`` drops the texts of captured pages that are not saved.  If that
    is not enough, step ``delete`` removes pages that are not saved.  Size is
    logical, the one that does not depend on storage: the bytes of the texts,
    and of a page its address, site, title and ROW_BYTES.  Saved pages and their
    texts stay, so an archive of saved pages may stay over its cap; the summary
    of ``enforce_cap`` says by how much.
    """
    texts = state.contents.select(F.col("page_id").alias("id"), F.col("bytes").alias("text")).hint("merge")
    sized = written(
        state.pages.join(texts, "id", "left").select(
            "id", "last_visit", "flags", F.coalesce("text", F.lit(0)).alias("text"), page_bytes().alias("page")
        ), "cap-sizes",
    )
    total = sized.agg(F.coalesce(F.sum(F.col("text") + F.col("page")), F.lit(0)).alias("total"))
    free = ~has_flag(F.col("flags"), SAVED)
    can = sized.where(has_flag(F.col("flags"), CONTENT) & free).select("id", "last_visit", F.col("text").alias("bytes"))
    trim = written(_oldest_batches(can, total.scalar() - max_bytes, batch, "cap-texts"), "cap-trim")
    freed = trim.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("freed"))
    pages = sized.where(free).select("id", "last_visit", F.col("page").alias("bytes"))
    delete = _oldest_batches(pages, total.scalar() - freed.scalar() - max_bytes, batch, "cap-pages")
    return trim.withColumn("step", F.lit("trim")).unionByName(delete.withColumn("step", F.lit("delete")))


def enforce_cap(state: Archive, max_bytes: int) -> tuple[Archive, DataFrame]:
    """Trims and deletes by ``cap_plan``; trimmed pages lose text and hash, the time of capture stays."""
    plan = written(cap_plan(state, max_bytes), "cap-plan")
    steps = plan.groupBy("id").agg(F.bool_or(F.col("step") == "trim").alias("_trim"), F.bool_or(F.col("step") == "delete").alias("_delete"))
    marked = state.pages.join(steps.hint("merge"), "id", "left")
    trim, gone = F.coalesce("_trim", F.lit(False)), F.coalesce("_delete", F.lit(False))
    pages = marked.where(~gone).withColumns({"content_hash": F.when(~trim, F.col("content_hash")), "flags": F.when(trim, _clear(F.col("flags"), CONTENT)).otherwise(F.col("flags")).cast("int")})
    contents = _without(state.contents, plan.select("id"))
    left = pages.agg(F.coalesce(F.sum(page_bytes()), F.lit(0)).alias("n")).scalar() + contents.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).scalar()
    step = F.col("step")
    summary = plan.agg(
        F.count_if(step == "trim").alias("trimmed_pages"), F.count_if(step == "delete").alias("deleted_pages"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("freed_bytes"),
    ).withColumn("over_bytes", F.greatest(F.lit(0), left - max_bytes))
    return replace(state, pages=_pages(pages), contents=contents), summary


def last_visits(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, last_visit) of the known ones among ``urls``, each once, in normal form."""
    keys = urls.select(normalized_url(F.col("url")).alias("url")).where(F.col("url").isNotNull()).distinct()
    return pages.join(keys, "url", "left_semi").select("url", "last_visit")


def plan_removals(pages: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """(url, action) for removal events (all_history, urls, received_at).

    Expired pages, which the browser drops by itself, and unknown ones are
    ignored; a removal of everything spares saved pages and names no address.
    """
    each = events.where(~F.col("all_history")).select(F.explode("urls").alias("raw"), now.alias("now"))
    keyed = each.select(normalized_url(F.col("raw")).alias("url"), "now").where(F.col("url").isNotNull()).groupBy("url").agg(F.min("now").alias("now"))
    known = keyed.join(pages.select("url", "last_visit"), "url", "left")
    old = F.col("last_visit") < F.col("now") - EXPIRY_DAYS * DAY_MS
    return known.select("url", F.when(F.col("last_visit").isNull(), "unknown").when(old, "expired").otherwise("delete").alias("action"))


# --- export and import ------------------------------------------------------------


def export_pages(state: Archive, scope: str = "all") -> DataFrame:
    """Pages with their texts; scope ``saved`` has the saved ones, without their place in the history."""
    pages = state.pages if scope == "all" else state.pages.where(has_flag(F.col("flags"), SAVED)).withColumn("flags", _clear(F.col("flags"), HISTORY).cast("int"))
    texts = state.contents.select(F.col("page_id").alias("id"), "headings", "description", "body")
    return pages.join(texts, "id", "left").select(
        "url", "title", "first_seen", "last_visit", "visit_count", "typed_count", "lang", "flags", "saved_at", "content_hash", "content_indexed_at", "headings", "description", "body"
    )


def export_snippets(state: Archive) -> DataFrame:
    """All quotes, whatever the scope."""
    return state.snippets.select("url", "page_title", "text", "fragment", "truncated", "created_at")


def import_data(state: Archive, pages: DataFrame, snippets: DataFrame) -> tuple[Archive, DataFrame]:
    """An export merged in: dates by extremes, counts by the larger, flags together; doing it again changes nothing."""
    raw = pages.withColumn("url", normalized_url(F.col("url"))).where(F.col("url").isNotNull())
    sums = raw.groupBy("url").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_visit").alias("last_visit"), F.max("visit_count").alias("visit_count"),
        F.max("typed_count").alias("typed_count"), F.bit_or("flags").alias("flags"), F.min("saved_at").alias("saved_at"),
    )
    norm = _one_row_each(raw, "last_visit")  # of addresses that become one, the latest says title and text
    given = norm.select("url", "title", "lang", "content_hash", "content_indexed_at").join(sums, "url")
    given = given.select(*(F.col(c).alias(f"g_{c}") for c in given.columns))
    old = state.pages
    hit = F.col("g_url").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"g_{c}")).otherwise(F.col(c)).alias(c)
    merged = old.join(given, old["url"] == given["g_url"], "full_outer").select(
        F.coalesce("id", page_id(F.col("g_url"))).alias("id"), F.coalesce("url", "g_url").alias("url"), F.coalesce("domain", domain_of(F.col("g_url"))).alias("domain"),
        pick("title"), F.least("first_seen", "g_first_seen").alias("first_seen"), F.greatest("last_visit", "g_last_visit").alias("last_visit"),
        F.greatest("visit_count", "g_visit_count").alias("visit_count"), F.greatest("typed_count", "g_typed_count").alias("typed_count"), pick("lang"),
        F.coalesce("flags", F.lit(0)).bitwiseOR(F.coalesce("g_flags", F.lit(0))).cast("int").alias("flags"), F.coalesce("saved_at", "g_saved_at").alias("saved_at"),
        pick("content_hash"), pick("content_indexed_at"),
    )
    texts = _texts(norm).join(merged.select(F.col("id").alias("page_id"), "url"), "url").select(*CONTENT_COLUMNS)
    contents = state.contents.join(texts, "page_id", "left_anti").select(*CONTENT_COLUMNS).unionByName(texts)
    quotes = new_snippets(snippets).dropDuplicates(["url", "text", "created_at"])
    fresh = quotes.join(state.snippets, ["url", "text", "created_at"], "left_anti").select(*state.snippets.columns)
    counts = raw.agg(F.count("*").alias("pages"))
    both = {"pages": counts.scalar(), "snippets": fresh.agg(F.count("*").alias("snippets")).scalar()}
    summary = pages.agg(F.count("*").alias("given")).withColumns(both).select(
        "pages", "snippets", (F.col("given") - F.col("pages")).alias("skipped")
    )
    return Archive(merged, contents, state.snippets.unionByName(fresh)), summary

