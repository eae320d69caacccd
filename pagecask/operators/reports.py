"""Reports over the archive: sites, totals, one page, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecask.operators.index import Index
from pagecask.operators.search import CONTENT, HISTORY, SAVED, has_flag

PREVIEW = 600


def domain_stats(pages: DataFrame, contents: DataFrame, limit: int | None = None) -> DataFrame:
    """By site: pages, saved, with text, bytes of text, and the latest visit or capture of any of its pages."""
    flags = F.col("flags")
    joined = pages.join(contents.select(F.col("page_id").alias("id"), "bytes"), "id", "left")
    out = joined.groupBy("domain").agg(
        F.count("*").alias("pages"), F.count_if(has_flag(flags, SAVED)).alias("saved"), F.count_if(has_flag(flags, CONTENT)).alias("with_content"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max(F.greatest("last_visit", F.coalesce("content_indexed_at", F.lit(0)))).alias("last_activity"),
    )
    return out if limit is None else out.orderBy(F.desc("bytes"), F.desc("pages"), "domain").limit(limit)


def archive_stats(pages: DataFrame, contents: DataFrame, snippets: DataFrame) -> DataFrame:
    """One row of totals."""
    flags = F.col("flags")
    p = pages.agg(
        F.count("*").alias("pages"), F.count_if(has_flag(flags, HISTORY)).alias("history"), F.count_if(has_flag(flags, CONTENT)).alias("with_content"),
        F.count_if(has_flag(flags, SAVED)).alias("saved"), F.min("first_seen").alias("first_seen"), F.max("last_visit").alias("last_visit"),
    )
    c = contents.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("text_bytes"))
    return p.withColumns({"text_bytes": c.scalar(), "snippets": snippets.agg(F.count("*").alias("snippets")).scalar()})


def page_info(pages: DataFrame, contents: DataFrame, snippets: DataFrame, url: str) -> DataFrame:
    """One page with the size and beginning of its text and the number of quotes; no row if it is unknown."""
    one = pages.where(F.col("url") == url).join(contents.select(F.col("page_id").alias("id"), "bytes", F.substring("body", 1, PREVIEW).alias("preview")), "id", "left")
    n = snippets.where(F.col("url") == url).agg(F.count("*").alias("snippets"))
    return one.withColumn("snippets", n.scalar()).select("id", "url", "domain", "title", "first_seen", "last_visit", "visit_count", "lang", "flags", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("preview", F.lit("")).alias("preview"), "snippets")


def integrity(pages: DataFrame, contents: DataFrame, index: Index) -> DataFrame:
    """Counts that must be zero: contents without a page, pages that the kept index does not have and the other way round, postings
    that do not add up to a record's length, words whose counts are not those of the postings, repeated keys."""
    ids = pages.select("id")
    rows = index.docs.select("id")
    lengths = index.postings.groupBy("id").agg(F.sum(F.size("positions")).alias("n")).join(index.docs, "id", "full_outer")
    words = index.postings.groupBy(F.col("token").alias("term")).agg(F.count("*").alias("n")).join(index.vocabulary, "term", "full_outer")
    checks = {
        "contents_without_page": contents.select(F.col("page_id").alias("id")).join(ids, "id", "left_anti"),
        "pages_not_indexed": ids.join(rows, "id", "left_anti"),
        "indexed_without_page": rows.join(ids, "id", "left_anti"),
        "postings_against_lengths": lengths.where("coalesce(n, 0) <> coalesce(length, -1)"),
        "vocabulary_against_postings": words.where("coalesce(n, 0) <> coalesce(doc, -1)"),
        "repeated_urls": pages.groupBy("url").count().where("count > 1"),
        "content_flag_without_text": pages.where(has_flag(F.col("flags"), CONTENT)).select("id").join(contents.select(F.col("page_id").alias("id")), "id", "left_anti"),
    }
    parts = [d.agg(F.count("*").alias("problems")).select(F.lit(n).alias("check"), "problems") for n, d in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nearest_rank(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Percentiles by nearest rank: the smallest value that at least the share of all values do not exceed."""
    parts = [F.expr(f"percentile_disc({s}) within group (order by `{value}`)").alias(f"p{round(s * 100)}") for s in shares]
    return df.groupBy(*(by or [])).agg(*parts, F.max(value).alias("max"))


def random_rows(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows chosen by a seeded hash of their key: the same ones in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
