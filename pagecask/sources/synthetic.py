"""A seeded synthetic archive for relevance and speed tests, made by column expressions on a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY, HOSTS = 30_000, 200
#: Share of pages in Greek.
GREEK = 0.2
_SYLLABLES = ["ba", "ke", "di", "fo", "gu", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "zo", "xa", "ly"]


def _uniform(seed: int, *key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))


def _zipf(u: Column, n: int, exponent: float) -> Column:
    """A rank below n, by inverting the continuous Zipf distribution."""
    top = float(n) ** (1 - exponent) if exponent != 1 else 0.0
    return F.least(F.lit(n - 1), F.floor(F.pow((top - 1) * u + 1, 1 / (1 - exponent))) - 1).cast("int")


_GREEK_SYLLABLES = ["μα", "κέ", "δι", "φό", "γου", "λα", "με", "νί", "πο", "ρού", "σα", "τέ", "βι", "ζό", "ξα", "λη"]


def word(rank: Column, greek: bool = False) -> Column:
    parts = F.array(*map(F.lit, _GREEK_SYLLABLES if greek else _SYLLABLES))
    digit = lambda k: F.element_at(parts, (F.floor(rank / (16**k)) % 16 + 1).cast("int"))
    return F.concat(digit(0), digit(1), digit(2), F.when(rank >= 4096, digit(3)).otherwise(""))


def corpus(spark: SparkSession, n: int, now: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(pages, contents) of ``n`` pages: Zipf words and hosts, a share of Greek, uneven lengths, visits within a year."""
    ids = spark.range(n)
    u = lambda s: _uniform(seed + s, F.col("id"))
    length = F.greatest(F.lit(20), F.floor(F.exp(4 + 1.2 * (u(1) + u(2) + u(3) - 1.5)))).cast("int")
    greek = u(13) < GREEK

    def text(salt: int, count: Column) -> Column:
        own = lambda g: F.transform(F.sequence(F.lit(1), count), lambda k: word(_zipf(_uniform(seed + salt, F.col("id"), k), VOCABULARY, 1.05), g))
        return F.array_join(F.when(greek, own(True)).otherwise(own(False)), " ")

    host = F.concat(word(_zipf(u(4), HOSTS, 0.9) + 300), F.lit(".example"))
    age = F.floor(u(5) * u(6) * 365 * 86_400_000).cast("long")
    pages = ids.select(
        "id", F.concat(F.lit("https://"), host, F.lit("/p/"), F.col("id")).alias("url"), host.alias("domain"), text(7, F.lit(6)).alias("title"),
        (F.lit(now) - age).alias("first_seen"), (F.lit(now) - age).alias("last_visit"), (1 + _zipf(u(8), 50, 1.5)).cast("long").alias("visit_count"),
        F.lit(0).cast("long").alias("typed_count"), F.when(greek, "el").otherwise("en").alias("lang"), F.when(u(9) < 0.1, 7).otherwise(3).alias("flags"),
        F.lit(None).cast("long").alias("saved_at"), F.lit(None).cast("string").alias("content_hash"), F.lit(now).alias("content_indexed_at"),
    )
    contents = ids.select(F.col("id").alias("page_id"), text(10, F.lit(8)).alias("headings"), text(11, F.lit(15)).alias("description"), text(12, length).alias("body"))
    return pages, contents.withColumn("bytes", F.octet_length("headings") + F.octet_length("description") + F.octet_length("body"))
