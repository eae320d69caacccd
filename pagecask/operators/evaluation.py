"""Labelled queries of seven kinds for an archive, and how well the search answers them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecask.functions.text import fold_text
from pagecask.operators.index import Index
from pagecask.operators.search import find, relevance
from pagecask.plans.query import parse_query

KINDS = ("title", "two-words", "phrase", "site-and-word", "prefix", "greek", "typo")
#: Words of at least so many letters are rare enough to ask for.
LONG = 8


@dataclass(frozen=True)
class Labelled:
    """A query, the page it is meant for, and the word a mistaken one is meant to be."""

    kind: str
    query: str
    page: int
    word: str | None = None


def _long_words(text: str) -> list[str]:
    return [w for w in dict.fromkeys(text.split()) if len(w) >= LONG]


def _ask(kind: str, title: str, domain: str, body: str) -> tuple[str, str | None] | None:
    """The query of one kind for one page, and the word meant; None if its texts give none."""
    words, rare = body.split(), _long_words(body)
    if kind == "title":
        return title, None
    if kind == "two-words":
        return (f"{rare[0]} {rare[-1]}", None) if len(rare) > 1 else None
    if kind == "phrase":
        at = len(words) // 2
        return (f'"{" ".join(words[at : at + 4])}"', None) if len(words) >= at + 4 else None
    if kind == "site-and-word":
        return (f"site:{domain} {rare[0]}", None) if rare else None
    if kind == "prefix":
        longest = max(title.split(), key=len, default="")
        return (longest[:5], None) if len(longest) > 5 else None
    if kind == "greek":
        return (fold_text(" ".join(title.split()[:3])), None) if not title.isascii() else None
    if not rare:
        return None
    word = rare[0]
    return word[:3] + word[4] + word[3] + word[5:], fold_text(word)


def labelled_queries(pages: DataFrame, contents: DataFrame, each: int, seed: int = 7) -> list[Labelled]:
    """``each`` queries of every kind, for pages chosen by a seeded hash; a few rows of a sample, on the driver."""
    texts = contents.select(F.col("page_id").alias("id"), "body")
    chosen = pages.join(texts, "id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(40 * each).select("id", "title", "domain", "body").collect()
    out = []
    for n, kind in enumerate(KINDS):
        turn = chosen[n * len(chosen) // len(KINDS) :] + chosen[: n * len(chosen) // len(KINDS)]
        asked = ((r.id, _ask(kind, r.title or "", r.domain, r.body or "")) for r in turn)
        some = [Labelled(kind, q[0], i, q[1]) for i, q in asked if q]
        out += some[:each]
    return out


def evaluate(pages: DataFrame, contents: DataFrame, snippets: DataFrame, queries: list[Labelled], now: int, page_idx: Index, snippet_idx: Index) -> DataFrame:
    """hit@1, hit@5, MRR and suggestion rate by kind and in total; every query is a whole search."""
    rows = []
    for q in queries:
        got = find(pages, contents, snippets, parse_query(q.query, now), now, 50, page_idx, snippet_idx)
        ids = [r.id for r in got.results.where("kind = 'page'").select("id").collect()]
        place = ids.index(q.page) + 1 if q.page in ids else None
        rows.append((q.kind, place, q.word is not None and q.word in [b for _, b in got.suggestions]))
    return relevance(pages.sparkSession.createDataFrame(rows, "kind string, place int, suggested boolean"))
