"""Accent-insensitive text: folding, tokens, lengths. All JVM-side column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


@lru_cache(1)
def _base_letters() -> tuple[str, str]:
    """Precomposed letters and their bases, as the two arguments of translate(); generated from the Unicode tables."""
    pairs = {}
    for o in range(0xC0, 0x30000):
        ch = chr(o)
        if 0xAC00 <= o < 0xD7A4 or 0xD800 <= o < 0xE000:
            continue
        bases = [c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c)[0] != "M"]
        if len(bases) == 1 and bases[0] != ch:
            pairs[ch] = bases[0]
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Decomposed, without marks, lower case, with one form of sigma. Null stays null."""
    plain = F.regexp_replace(F.translate(text, *_base_letters()), r"\p{M}", "")
    return F.translate(F.lower(plain), "ς", "σ")


def fold_text(text: str) -> str:
    """The same for one string on the driver (queries)."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M")
    return plain.lower().replace("ς", "σ")


def tokens(folded: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def padded(text: Column) -> Column:
    """Tokens each between blanks of its own, so that a phrase is a substring: `` a  b  c ``; two blanks without tokens."""
    own = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  ")
    return F.concat(F.lit(" "), F.trim(own), F.lit(" "))


def token_count(pad: Column) -> Column:
    """Number of tokens of a ``padded`` text: each but the last is followed by two blanks."""
    gaps = (F.octet_length(pad) - F.octet_length(F.replace(pad, F.lit("  "), F.lit("")))) / 2
    return F.when(pad == "  ", 0).otherwise(gaps + 1).cast("int")


def _overlaps_itself(phrase: list[str]) -> bool:
    return any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase)))


def phrase_hits(pad: Column, phrase: list[str], prefix: bool = False) -> Column:
    """How often a phrase stands in a ``padded`` text, overlapping places too; with ``prefix`` its last token may go on."""
    needle = " " + "  ".join(phrase) + ("" if prefix else " ")
    if len(phrase) > 1 and (prefix or _overlaps_itself(phrase)):
        return F.regexp_count(pad, F.lit(f"(?={needle})"))
    without = F.octet_length(F.replace(pad, F.lit(needle), F.lit("")))
    return ((F.octet_length(pad) - without) / len(needle.encode())).cast("int")


def clip(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def half_up(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def text_bytes(*parts: Column) -> Column:
    """UTF-8 size of texts together; nulls have none."""
    total = F.lit(0).cast("long")
    for p in parts:
        total = total + F.coalesce(F.octet_length(p), F.lit(0))
    return total


def content_hash(title: Column, headings: Column, description: Column, body: Column) -> Column:
    """SHA-256 of the four texts, each on its line; nulls are empty."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(x, F.lit("")) for x in (title, headings, description, body))), 256)
