"""How results are shown: ages, short addresses, letter marks, links to passages. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
WHOLE, EDGE = 300, 6


def relative_time(at: Column, now: Column) -> Column:
    """struct(unit, n) of an age that is never negative; days up to sixty, then months of thirty."""
    age = F.greatest(F.lit(0).cast("long"), now - at)
    part = lambda unit, ms: F.struct(F.lit(unit).alias("unit"), F.floor(age / ms).cast("long").alias("n"))
    now_ = F.struct(F.lit("now").alias("unit"), F.lit(0).cast("long").alias("n"))
    return (
        F.when(age < MINUTE, now_).when(age < HOUR, part("minutes", MINUTE)).when(age < DAY, part("hours", HOUR))
        .when(age < 60 * DAY, part("days", DAY)).otherwise(part("months", 30 * DAY))
    )


def display_url(url: Column, longest: int = 48) -> Column:
    """struct(domain, path): host without ``www.``, path and query decoded and cut."""
    host = F.regexp_replace(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1), r"^www\.", "")
    raw = F.regexp_extract(url, r"^https?://[^/?#]+([^#]*)", 1)
    path = F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)
    path = F.when(path == "/", "").otherwise(path)
    cut = F.when(F.length(path) > longest, F.concat(F.substring(path, 1, longest - 1), F.lit("…"))).otherwise(path)
    return F.when(host == "", F.struct(F.substring(url, 1, 60).alias("domain"), F.lit("").alias("path"))).otherwise(F.struct(host.alias("domain"), cut.alias("path")))


def avatar(domain: Column) -> Column:
    """struct(letter, hue): the first letter and a hue from a 32-bit hash with factor 31 over the name."""
    name = F.regexp_replace(domain, r"^www\.", "")
    codes = F.transform(F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    hashed = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
    return F.struct(F.when(name == "", "?").otherwise(F.upper(F.substring(name, 1, 1))).alias("letter"), (hashed % 360).cast("int").alias("hue"))


def _encoded(text: Column) -> Column:
    out = F.regexp_replace(F.url_encode(text), r"\+", "%20")
    out = F.regexp_replace(out, r"\*", "%2A")
    return F.regexp_replace(F.regexp_replace(out, r"-", "%2D"), "%7E", "~")


def text_fragment(selection: Column) -> Column:
    """``#:~:text=`` link part for a passage: all of it, or its first and last words; null without text."""
    text = F.trim(F.regexp_replace(selection, r"\s+", " "))
    words = F.split(text, " ")
    edges = F.concat(_encoded(F.array_join(F.slice(words, 1, EDGE), " ")), F.lit(","), _encoded(F.array_join(F.slice(words, -EDGE, EDGE), " ")))
    body = F.when(F.length(text) <= WHOLE, _encoded(text)).when(F.size(words) <= 2 * EDGE, _encoded(F.substring(text, 1, WHOLE))).otherwise(edges)
    return F.when(text != "", F.concat(F.lit("#:~:text="), body))


def result_href(kind: Column, url: Column, fragment: Column) -> Column:
    """Quotes open at their passage."""
    mark = F.when(fragment.startswith("#"), fragment).otherwise(F.concat(F.lit("#"), fragment))
    return F.when((kind == "snippet") & (F.coalesce(fragment, F.lit("")) != ""), F.concat(url, mark)).otherwise(url)
