"""Ranked search: match, weighted BM25, candidates, features, relaxation, spelling.

A query reads the postings of its words from the inverted index
(``operators.index``); filters reach the scan of pages, candidates are cut by
TakeOrderedAndProject, and texts are read only for the few rows that are shown.
What is cut to a fixed number of rows is held on the driver, so that later
steps know its ids and its size.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagecask.functions.text import clip, fold, tokens
from pagecask.functions.urls import in_any_site
from pagecask.operators.index import Index, Phrases, matching_ids, page_index, phrase_weights, snippet_index
from pagecask.operators.snippets import excerpts, highlight_spans
from pagecask.plans.query import DAY_MS, Query
from pagecask.sources.scratch import written

T = TypeVar("T")
HISTORY, CONTENT, SAVED = 1, 2, 4
K1, B = 1.2, 0.75
CANDIDATES, RELAXED, SUBSTRING = 200, 40, 20
EXCERPTS, RELAXED_EXCERPTS = 50, 10
RELAX_BELOW = 5
TAU_DAYS = 45
W_BM25, W_TITLE, W_RECENT, W_VISITS, W_SAVED, W_PHRASE = 1.0, 0.35, 0.25, 0.08, 0.2, 0.2
#: Values of one list that a Parquet scan compares with its statistics one by one.
PUSHED_VALUES = 10


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def held(df: DataFrame) -> tuple[DataFrame, list[Row]]:
    """``df``, which is cut to a fixed number of rows, computed once and held by the driver; and its rows."""
    rows = df.collect()
    return df.sparkSession.createDataFrame(rows, df.schema), rows


def at_once(spark: SparkSession, *steps: Callable[[], T]) -> list[T]:
    """The results of steps that need not wait for each other."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def picked(column: Column, values: list) -> Column:
    """Whether a column is one of a few values, in lists so short that a scan skips what cannot hold them."""
    lists = [values[k : k + PUSHED_VALUES] for k in range(0, len(values), PUSHED_VALUES)]
    return reduce(lambda a, b: a | b, (column.isin(x) for x in lists), F.lit(False))


def all_phrases(q: Query) -> Phrases:
    last = len(q.phrases) - 1
    return [(list(p.tokens), k == last and not p.quoted) for k, p in enumerate(q.phrases)]


def any_words(q: Query) -> Phrases:
    return [([t], False) for t in dict.fromkeys(q.terms) if len(t) >= 3]


def excluded_ids(index: Index, q: Query) -> DataFrame:
    """(id) of the records that hold a phrase that the query excludes."""
    return matching_ids(index, [(list(p), False) for p in q.excluded], False)


def bm25_groups(index: Index, groups: list[tuple[Phrases, bool]], excluded: tuple[tuple[str, ...], ...] = ()) -> list[DataFrame]:
    """For each (phrases, every): (id, strength) of the records that match all of its phrases, or any.

    The statistics are those of the whole index: totals are kept with it, and
    the frequencies of the phrases are observed while the matches of all groups
    are written, so the postings of each word are read once.
    """
    names = [[f"w{g}_{k}" for k in range(len(phrases))] for g, (phrases, _) in enumerate(groups)]
    flat = [(n, p, x) for own, (phrases, _) in zip(names, groups, strict=True) for n, (p, x) in zip(own, phrases, strict=True)]
    outs = [(f"x{k}", list(p), False) for k, p in enumerate(excluded)]
    hits = phrase_weights(index, [(p, x) for _, p, x in flat + outs], [n for n, _, _ in flat + outs])
    seen = Observation()
    counted = hits.observe(seen, *(F.count_if(F.col(n) > 0).alias(n) for n, _, _ in flat))
    wanted = [reduce(lambda a, b: (a & b) if every else (a | b), (F.col(n) > 0 for n in own)) for own, (_, every) in zip(names, groups, strict=True)]  # noqa: B023
    out = reduce(lambda a, b: a | b, (F.col(n) > 0 for n, _, _ in outs), F.lit(False))
    found = written(counted.where(~out & reduce(lambda a, b: a | b, wanted)).drop(*(n for n, _, _ in outs)), "matches")
    stats = seen.get
    mean = index.total / index.rows if index.rows else 0

    def part(n: str) -> Column:
        idf = max(math.log((index.rows - stats[n] + 0.5) / (stats[n] + 0.5)), 1e-6)
        norm = K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0))
        return F.lit(idf) * F.col(n) * (K1 + 1) / (F.col(n) + norm)

    return [found.where(w).select("id", reduce(lambda a, b: a + b, map(part, own)).alias("strength")) for own, w in zip(names, wanted, strict=True)]


def bm25_matches(index: Index, phrases: Phrases, every: bool, excluded: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    return bm25_groups(index, [(phrases, every)], excluded)[0]


def filters_rows(q: Query) -> bool:
    return bool(q.sites or q.not_sites or q.after is not None or q.before is not None or q.saved)


def page_filters(q: Query, domain: Column, at: Column, flags: Column | None) -> Column:
    keep = F.lit(True)
    if q.sites:
        keep = keep & in_any_site(domain, list(q.sites))
    if q.not_sites:
        keep = keep & ~in_any_site(domain, list(q.not_sites))
    if q.after is not None:
        keep = keep & (at >= q.after)
    if q.before is not None:
        keep = keep & (at < q.before)
    if q.saved and flags is not None:
        keep = keep & has_flag(flags, SAVED)
    return keep


def title_url_hit(terms: list[str], title: Column, url: Column) -> Column:
    """1 if each term begins a token of title or address, 0.5 if some do."""
    if not terms:
        return F.lit(0.0)
    hay = F.concat(tokens(title), tokens(url))

    def begins(term: str) -> Column:
        return F.exists(hay, lambda w: w.startswith(term)).cast("int")

    hits = reduce(lambda a, b: a + b, map(begins, terms))
    return F.when(hits == len(terms), 1.0).when(hits > 0, 0.5).otherwise(0.0)


def recency(at: Column, now: int) -> Column:
    return F.exp(-F.greatest(F.lit(0), F.lit(now) - at) / F.lit(DAY_MS * TAU_DAYS * 1.0))


def base_score(norm: Column, hit: Column, at: Column, visits: Column, saved: Column, now: int) -> Column:
    return (
        W_BM25 * norm + W_TITLE * hit + W_RECENT * recency(at, now) + W_VISITS * F.log1p(F.greatest(F.lit(0), visits).cast("double"))
        + F.when(saved, W_SAVED).otherwise(0.0)
    )


def strength_norm(strength: Column) -> Column:
    """Strength as a share of the best candidate's; 1 for all if none has any."""
    best = F.max(strength).over(Window.partitionBy())  # over at most CANDIDATES rows
    return F.when(best > 0, strength / best).otherwise(1.0)


def adjacent(terms: list[str], folded: Column) -> Column:
    """Whether all terms stand one after the other, also inside longer words."""
    return folded.rlike("[^\\p{L}\\p{N}]+".join(terms))


def rank_pages(candidates: DataFrame, contents: DataFrame, q: Query, now: int, *, matched: bool, approximate: bool) -> DataFrame:
    """Scored result rows of ``candidates`` (CANDIDATES rows at most); excerpts and adjacency for the best few only, whose texts are read by id."""
    terms, open_term = q.terms, len(q.terms) - 1 if q.open_end else -1
    norm = strength_norm(F.col("strength")) if matched else F.lit(0.0)
    title = fold(F.coalesce("title", F.lit("")))
    pre = candidates.withColumn(
        "pre", base_score(norm, title_url_hit(terms, title, F.lower("url")), F.col("last_visit"), F.col("visit_count"), has_flag(F.col("flags"), SAVED), now)
    ).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("pre"), F.desc("last_visit"), "url")))
    if matched:
        pre, rows = held(pre)
        most = RELAXED_EXCERPTS if approximate else EXCERPTS
        ids = [r.id for r in rows if r.place <= most]
        texts = contents.where(picked(F.col("page_id"), ids)).select(F.col("page_id").alias("id"), "headings", "description", "body")
        best = pre.where(F.col("place") <= most).join(F.broadcast(texts), "id", "left")  # EXCERPTS texts at most
        own = [excerpts(F.col(c), terms, open_term) for c in ("body", "description", "headings")]
        best = best.withColumns({"e0": own[0], "e1": own[1], "e2": own[2]})
        phrase = (
            (F.length("body") > 0) & (adjacent(terms, F.substring(fold(F.col("body")), 1, 20_000)) | adjacent(terms, title)) if len(terms) > 1 else F.lit(False)
        )
        pick = F.when(F.col("e0.text").isNotNull(), F.col("e0")).when(F.col("e1.text").isNotNull(), F.col("e1")).when(F.col("e2.text").isNotNull(), F.col("e2"))
        extra = best.select("id", pick.alias("snippet"), F.coalesce(phrase, F.lit(False)).alias("phrase"))
        pre = pre.join(F.broadcast(extra), "id", "left").withColumn("title_highlights", highlight_spans(F.col("title"), terms, open_term))
    else:
        pre = pre.withColumns({"snippet": F.lit(None).cast("struct<text:string,highlights:array<struct<start:int,end:int>>>"), "phrase": F.lit(False), "title_highlights": F.lit(None).cast("array<struct<start:int,end:int>>")})
    score = F.col("pre") + F.when(F.coalesce("phrase", F.lit(False)), W_PHRASE).otherwise(0.0)
    flags = F.col("flags")
    return pre.select(
        F.lit("page").alias("kind"), "id", "url", "title", "domain",
        F.when(has_flag(flags, SAVED), "saved").when(has_flag(flags, CONTENT), "deep").otherwise("history").alias("source"),
        "flags", F.col("last_visit").alias("timestamp"), "visit_count", (score * 0.5 if approximate else score).alias("score"),
        F.lit(approximate).alias("approximate"),
        (F.when(F.col("snippet").isNotNull(), "content").otherwise("title-url") if matched else F.lit("filter")).alias("match_kind"),
        "snippet", "title_highlights", F.lit(None).cast("string").alias("fragment"),
    )


def _best_matches(matches: DataFrame, most: int) -> DataFrame:
    """Those of which, by strength alone, ``most`` can be chosen; equal ones are all kept."""
    least = matches.orderBy(F.desc("strength")).limit(most).agg(F.min("strength").alias("least"))
    return matches.where(F.col("strength") >= least.scalar())


def page_candidates(pages: DataFrame, index: Index, q: Query, *, matches: DataFrame | None, most: int = CANDIDATES) -> DataFrame:
    """The best of ``matches`` under the filters; without them the latest pages."""
    kept = pages.where(page_filters(q, F.col("domain"), F.col("last_visit"), F.col("flags")))
    if matches is None:
        if q.excluded:
            kept = kept.join(excluded_ids(index, q), "id", "left_anti")
        return kept.withColumn("strength", F.lit(0.0)).orderBy(F.desc("last_visit"), "id").limit(most)
    if not filters_rows(q):
        matches = _best_matches(matches, most)
    return kept.join(matches, "id").orderBy(F.desc("strength"), F.desc("last_visit"), "id").limit(most)


def substring_matches(pages: DataFrame, probe: str) -> DataFrame:
    """Pages whose folded title or address contains ``probe``."""
    return pages.where(fold(F.coalesce("title", F.lit(""))).contains(probe) | fold(F.col("url")).contains(probe))


def substring_candidates(pages: DataFrame, index: Index, q: Query) -> DataFrame | None:
    """Pages whose folded title or address contains the words as one string; the latest twenty."""
    probe = " ".join(q.terms)
    if len(probe.replace(" ", "")) < 3:
        return None
    kept = substring_matches(pages.where(page_filters(q, F.col("domain"), F.col("last_visit"), F.col("flags"))), probe)
    if q.excluded:
        kept = kept.join(excluded_ids(index, q), "id", "left_anti")
    return kept.withColumn("strength", F.lit(0.0)).orderBy(F.desc("last_visit"), "id").limit(SUBSTRING)


def snippet_candidates(snippets: DataFrame, index: Index, q: Query) -> DataFrame:
    """The best matching quotes under the filters; without words the latest ones."""
    kept = snippets.where(page_filters(q, F.col("domain"), F.col("created_at"), None))
    if q.phrases:
        kept = kept.join(bm25_matches(index, all_phrases(q), True, q.excluded), "id")
        return kept.orderBy(F.desc("strength"), F.desc("created_at"), "id").limit(CANDIDATES)
    if q.excluded:
        kept = kept.join(excluded_ids(index, q), "id", "left_anti")
    return kept.withColumn("strength", F.lit(0.0)).orderBy(F.desc("created_at"), "id").limit(CANDIDATES)


def rank_snippets(kept: DataFrame, q: Query, now: int) -> DataFrame:
    """Scored result rows of candidates (CANDIDATES rows at most)."""
    terms, open_term = q.terms, len(q.terms) - 1 if q.open_end else -1
    matched = bool(q.phrases)
    norm = strength_norm(F.col("strength")) if matched else F.lit(0.0)
    head = F.struct(clip(F.col("text"), 400).alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("highlights"))
    if matched:
        kept = kept.withColumns({"e": excerpts(F.col("text"), terms, open_term, 400), "marks": highlight_spans(F.col("page_title"), terms, open_term)})
        shown = F.when(F.col("e.text").isNotNull(), F.col("e")).otherwise(head)
    else:
        kept = kept.withColumn("marks", F.lit(None).cast("array<struct<start:int,end:int>>"))
        shown = head
    hit = title_url_hit(terms, fold(F.coalesce("page_title", F.lit(""))), fold(F.col("url")))
    return kept.select(
        F.lit("snippet").alias("kind"), "id", "url", F.col("page_title").alias("title"), "domain", F.lit("snippet").alias("source"), F.lit(SAVED).alias("flags"),
        F.col("created_at").alias("timestamp"), F.lit(0).cast("long").alias("visit_count"),
        base_score(norm, hit, F.col("created_at"), F.lit(0), F.lit(True), now).alias("score"), F.lit(False).alias("approximate"),
        F.lit("content" if matched else "filter").alias("match_kind"), shown.alias("snippet"), F.col("marks").alias("title_highlights"), "fragment",
    )


def ordered(results: DataFrame, limit: int) -> DataFrame:
    return results.orderBy("approximate", F.desc("score"), F.desc("timestamp"), "url", "id").limit(max(1, min(200, limit)))


@dataclass(frozen=True)
class Found:
    """Results in order, and words that the archive has instead of some of the query's."""

    results: DataFrame
    suggestions: list[tuple[str, str]]
    took_ms: int
    filters: dict


def find(
    pages: DataFrame, contents: DataFrame, snippets: DataFrame, q: Query, now: int, limit: int = 50,
    page_idx: Index | None = None, snippet_idx: Index | None = None,
) -> Found:
    """A whole search over kept indexes, or over ones made for it.

    A query without criteria has no results; fewer than five exact ones are
    topped up by looser matches, then words are suggested.
    """
    began = time.monotonic()
    filters = {
        "sites": list(q.sites), "exclude_sites": list(q.not_sites), "after": q.after, "before": q.before, "is_saved": q.saved, "is_snippet": q.snippets,
    }

    def done(results: DataFrame, words: list[tuple[str, str]] | None = None) -> Found:
        return Found(ordered(results, limit), words or [], round((time.monotonic() - began) * 1000), filters)

    if not q.asks:
        nothing = pages.limit(0).withColumn("strength", F.lit(0.0))
        return done(rank_pages(nothing, contents, Query(saved=True), now, matched=False, approximate=False))
    with_pages, with_quotes, words = not q.snippets or q.saved, q.snippets or not q.saved, any_words(q)
    searched = bool(q.phrases or q.excluded)
    pi = (page_idx or page_index(pages, contents)) if with_pages and searched else None
    si = (snippet_idx or snippet_index(snippets)) if with_quotes and searched else None

    def of_pages() -> tuple[DataFrame | None, int, DataFrame | None]:
        """Ranked pages, how many, and the matches of any word."""
        if not with_pages:
            return None, 0, None
        if not q.phrases:
            return rank_pages(page_candidates(pages, pi, q, matches=None), contents, q, now, matched=False, approximate=False), 0, None
        exact, *rest = bm25_groups(pi, [(all_phrases(q), True), *([(words, False)] if words else [])], q.excluded)
        chosen, rows = held(page_candidates(pages, pi, q, matches=exact))
        return rank_pages(chosen, contents, q, now, matched=True, approximate=False), len(rows), rest[0] if rest else None

    def of_quotes() -> tuple[DataFrame | None, int]:
        if not with_quotes:
            return None, 0
        quotes, rows = held(snippet_candidates(snippets, si, q))
        return rank_snippets(quotes, q, now), len(rows)

    (ranked, n_pages, loose_matches), (quotes, n_quotes) = at_once(pages.sparkSession, of_pages, of_quotes)
    have = n_pages + n_quotes
    exact = reduce(DataFrame.unionByName, [x for x in (ranked, quotes) if x is not None])
    if not q.phrases or not with_pages or have >= RELAX_BELOW:
        return done(exact)

    def of_any_word() -> tuple[DataFrame | None, int]:
        if loose_matches is None:
            return None, 0
        found, rows = held(page_candidates(pages, pi, q, matches=loose_matches, most=RELAXED))
        return rank_pages(found, contents, q, now, matched=True, approximate=True).withColumn("turn", F.lit(0)), len(rows)

    (exact, _), (near, n_near), instead = at_once(pages.sparkSession, lambda: held(exact), of_any_word, lambda: suggestions(pi.vocabulary, q))
    loose = [near] if near is not None else []
    if have + n_near < RELAX_BELOW and (found := substring_candidates(pages, pi, q)) is not None:
        loose.append(rank_pages(held(found)[0], contents, q, now, matched=True, approximate=True).withColumn("turn", F.lit(1)))
    if not loose:
        return done(exact, instead)
    first = F.row_number().over(Window.partitionBy("kind", "id").orderBy("turn"))
    fresh = reduce(DataFrame.unionByName, loose).withColumn("_first", first).where("_first = 1").drop("_first", "turn")
    return done(exact.unionByName(fresh.join(exact, ["kind", "id"], "left_anti")), instead)


def search(*args, **kwargs) -> DataFrame:
    """The results of ``find``."""
    return find(*args, **kwargs).results


def suggest(vocab: DataFrame, term: str, limit: int = 3, as_prefix: bool = False) -> DataFrame:
    """(term, doc, distance): the nearest known words of the same first letter, within two edits; none for a known word."""
    known = vocab.where(F.col("term").startswith(term) if as_prefix else F.col("term") == term).agg(F.count("*").alias("known"))
    near = (
        vocab.where(F.col("term").startswith(term[:1]) & F.length("term").between(len(term) - 2, len(term) + 2))
        .orderBy(F.desc("doc"), "term").limit(3000)
        .withColumn("distance", F.levenshtein(F.col("term"), F.lit(term), 2)).where("distance >= 0")
    )
    return near.where(known.scalar() == 0).select("term", "doc", "distance").orderBy("distance", F.desc("doc"), "term").limit(limit)


def suggestions(vocab: DataFrame, q: Query) -> list[tuple[str, str]]:
    """(word, replacement) for each unquoted single word of at least four letters that nothing contains."""
    asked = [(p.tokens[0], k == len(q.phrases) - 1) for k, p in enumerate(q.phrases) if not p.quoted and len(p.tokens) == 1 and len(p.tokens[0]) >= 4]
    if not asked:
        return []
    best = [suggest(vocab, word, 1, prefix).select(F.lit(k).alias("k"), "term") for k, (word, prefix) in enumerate(asked)]
    return [(asked[r.k][0], r.term) for r in reduce(DataFrame.unionByName, best).orderBy("k").collect()]


def reciprocal_rank(place: Column) -> Column:
    return F.when(place.isNotNull(), 1 / place).otherwise(0.0)


def relevance(places: DataFrame) -> DataFrame:
    """hit@1, hit@5, MRR and the share of queries with a right suggestion, by kind of query and in total.

    ``place`` is the rank of the wanted page or null, ``suggested`` whether the word meant was suggested.
    """
    return places.unionByName(places.withColumn("kind", F.lit("total"))).groupBy("kind").agg(
        F.count("*").alias("n"), F.avg((F.coalesce("place", F.lit(math.inf)) <= 1).cast("int")).alias("hit1"),
        F.avg((F.coalesce("place", F.lit(math.inf)) <= 5).cast("int")).alias("hit5"), F.avg(reciprocal_rank(F.col("place"))).alias("mrr"),
        F.avg(F.coalesce("suggested", F.lit(False)).cast("int")).alias("suggestion_rate"),
    )
