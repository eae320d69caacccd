"""One form for texts that look alike (problem 5).

Two texts that show a reader the same thing get the same string.  The
DataFrame operator explodes each text to positioned code points,
broadcast-joins a decomposition map and a look-alike map (both are fixed
tables generated from the Unicode database, independent of the data), orders
combining marks by class inside each cluster, recomposes and rebuilds the
string.  ``canonical`` is the same definition for one Python string; it serves
operators that are in Python anyway, and the tests as brute force.

Defined results
    null text stays null; an empty text stays empty; line feeds, letter case,
    accents and the number of blanks are kept; invisible characters vanish;
    every kind of blank becomes one ordinary blank; a letter that has
    look-alikes in other scripts takes the script of the unambiguous letters of
    its word, else of its text, else Latin.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagecask.operators.skew import paired_members, pairs_within, spread_join
from pagecask.sources.scratch import written

# Letters that look the same, in the order Latin, Greek, Cyrillic; "-" where the script has none.
LOOKALIKES = """
A Α А
B Β В
C - С
E Ε Е
H Η Н
I Ι І
J - Ј
K Κ К
M Μ М
N Ν -
O Ο О
P Ρ Р
S - Ѕ
T Τ Т
X Χ Х
Y Υ У
Z Ζ -
a - а
c - с
e - е
i - і
j - ј
o ο о
p - р
s - ѕ
x - х
y - у
"""
# Hyphens drawn as the ASCII hyphen, separators drawn as a line break, fillers drawn as nothing.
HYPHENS = "‐‑"
LINE_ENDS = "\x85  "
INVISIBLE = "\r͏ᅟᅠ឴឵ㅤﾠ"
# Compatibility decompositions that keep the look: width, no-break, ligature and presentation forms.
SAME_LOOK = {"", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}

LATIN, GREEK, CYRILLIC = 0, 1, 2
_TRIPLES = [line.split() for line in LOOKALIKES.split("\n") if line]
#: letter -> its form in each script; a script without one uses the first that there is.
_CLASS = {
    ch: tuple(x if x != "-" else next(y for y in triple if y != "-") for x in triple)
    for triple in _TRIPLES
    for ch in triple
    if ch != "-"
}


@lru_cache(10_000)
def _script(ch: str) -> int:
    """Script of an unambiguous letter, or -1."""
    if ch in _CLASS or not ch.isalpha():
        return -1
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return LATIN
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return GREEK
    return CYRILLIC if 0x400 <= o < 0x530 else -1


def _keeps_look(ch: str, kind: str, whole: str) -> bool:
    if kind not in SAME_LOOK:
        return False
    if kind == "<compat>":  # not spacing accents, the long s, Greek symbol variants, or letters and numbers set in a sign, which look different
        o = ord(ch)
        sign = 0x3D0 <= o < 0x400 or 0x2100 <= o < 0x2150 or 0x2460 <= o < 0x2500 or 0x3200 <= o < 0x3400 or 0x1F100 <= o < 0x1F300
        return not (whole.startswith(" ") and len(whole) > 1) and ch != "ſ" and not sign
    return True


@lru_cache(1)
def decompositions() -> dict[str, str]:
    """Every code point that is not itself: its parts, possibly none."""
    out = {c: "-" for c in HYPHENS} | {c: "\n" for c in LINE_ENDS} | {c: "" for c in INVISIBLE} | {"\t": " "}
    for o in range(0x80, 0x30000):
        ch = chr(o)
        cat = unicodedata.category(ch)
        if cat in ("Cs", "Cn", "Co") or ch in out:
            continue
        if cat == "Cf" or 0xFE00 <= o <= 0xFE0F:
            out[ch] = ""
        elif cat == "Zs":
            out[ch] = " "
        else:
            whole = unicodedata.normalize("NFKD", ch)
            spec = unicodedata.decomposition(ch)
            kind = spec.split(" ")[0] if spec.startswith("<") else ""
            parts = whole if _keeps_look(ch, kind, whole) and not (" " in whole and len(whole) > 1) else unicodedata.normalize("NFD", ch)
            parts = "".join(out.get(p, p) if p in HYPHENS else p for p in parts)
            if parts != ch:
                out[ch] = parts
    return out


@lru_cache(1)
def compositions() -> dict[str, str]:
    """Decomposed cluster (a base and its marks in order) -> the character it composes to."""
    out = {}
    for ch in decompositions():
        nfd = unicodedata.normalize("NFD", ch)
        if len(nfd) > 1 and unicodedata.normalize("NFC", nfd) == ch and not _is_mark(nfd[0]) and all(map(_is_mark, nfd[1:])):
            out[nfd] = ch
    return out


@lru_cache(10_000)
def _is_mark(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "M"


def _compose(base: str, marks: list[str]) -> str:
    table = compositions()
    ordered = sorted(marks, key=unicodedata.combining)
    whole = base + "".join(ordered)
    if whole in table:
        return table[whole]
    two = whole[:2]
    return (table[two] + whole[2:]) if len(whole) > 2 and two in table else whole


@lru_cache(1)
def _needs_work() -> re.Pattern:
    """Finds a character that decomposes to something else than a plain accented letter, or a mark."""
    table = compositions()
    odd = [c for c, parts in decompositions().items() if table.get(parts) != c and not 0xAC00 <= ord(c) < 0xD7A4]
    odd += [chr(o) for o in range(0x300, 0x30000) if not 0xD800 <= o < 0xE000 and _is_mark(chr(o))]
    odd += [chr(o) for o in range(0xAC00, 0xD7A4)]
    # one range for all beyond the basic plane: they are rare, and a class with many ranges there is slow for every text
    return re.compile("[" + _spans({c for c in odd if ord(c) < 0x10000}) + "\U00010000-\U0002ffff]")


_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯἀ-῿]")
_WORD = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")


def _best(votes: Counter) -> int:
    return min(votes, key=lambda s: (-votes[s], s))


@lru_cache(50_000)
def _in_script(word: str, overall: int) -> str:
    if _CLASS.keys().isdisjoint(word):
        return word
    votes = Counter(s for s in map(_script, word) if s >= 0)
    s = _best(votes) if votes else overall
    return "".join(_CLASS[c][s] if c in _CLASS else c for c in word)


def _settle_scripts(text: str) -> str:
    """Bases without their marks, each look-alike in the script of its word, else of the text."""
    votes = Counter(s for s in map(_script, text) if s >= 0)
    overall = _best(votes) if votes else LATIN
    return _WORD.sub(lambda m: _in_script(m.group(0), overall), text)


def _spans(chars) -> str:
    points = sorted(map(ord, chars))
    spans, start = [], points[0]
    for a, b in zip(points, [*points[1:], sys.maxunicode + 9], strict=True):
        if b != a + 1:
            spans.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}")
            start = b
    return "".join(spans)


@lru_cache(1)
def _script_patterns() -> tuple[list[re.Pattern], re.Pattern, re.Pattern, re.Pattern]:
    """Runs of each script's unambiguous letters; two scripts side by side; words of ambiguous letters only; letters of other scripts."""
    by: dict[int, list[str]] = {LATIN: [], GREEK: [], CYRILLIC: [], -1: []}
    blocks: dict[int, list[str]] = {LATIN: [], GREEK: [], CYRILLIC: []}
    for o in [*range(0x41, 0x530), *range(0x1E00, 0x2000)]:
        ch = chr(o)
        if ch.isalpha():
            base = decompositions().get(ch, ch)[:1] or ch
            by[-1 if base in _CLASS else _script(base)].append(ch)
            block = GREEK if 0x370 <= o < 0x400 or o >= 0x1F00 else CYRILLIC if 0x400 <= o else LATIN
            blocks[block].append(ch)
    latin, greek, cyrillic = (f"[{_spans(blocks[s])}]" for s in (LATIN, GREEK, CYRILLIC))
    pairs = [(latin, greek), (latin, cyrillic), (greek, cyrillic)]
    mixed = "|".join(f"{a}{b}|{b}{a}" for a, b in pairs)
    ambiguous = [c for c in by[-1] if decompositions().get(c, c)[:1] in _CLASS]
    runs = [re.compile(f"[{_spans(by[s])}]+") for s in (LATIN, GREEK, CYRILLIC)]
    other = re.compile(rf"[^\W\d_{_spans([c for own in blocks.values() for c in own])}]")
    return runs, re.compile(mixed), re.compile(rf"(?<![^\W\d_])[{_spans(ambiguous)}]+(?![^\W\d_])"), other


def _one_script(text: str) -> bool:
    """Whether no letter can change: all are Latin."""
    return not _FOREIGN.search(text)


def latin_skeleton(text: str) -> str:
    """Every look-alike as its Latin form, whatever its word; for lookups in lists of Latin words."""
    return text if not _FOREIGN.search(text) else "".join(_CLASS[c][LATIN] if c in _CLASS else c for c in text)


@lru_cache(1)
def _odd_latin() -> str:
    return "".join(c for c, parts in decompositions().items() if ord(c) < 256 and compositions().get(parts) != c)


def _plain_latin(text: str) -> bool:
    """A quick test for the commonest texts that are their own form."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in _odd_latin())


def canonical(text: str | None) -> str | None:
    """The one form of a text; see the module's docstring."""
    if text is None or text.isascii() and "\t" not in text and "\r" not in text:
        return text
    if _plain_latin(text):
        return text
    if not _needs_work().search(text) and "\t" not in text and "\r" not in text:
        if _one_script(text):
            return text
        *counts, odd = zip(*map(_CHUNKS.__getitem__, text.split()), strict=True)
        if not any(odd):  # only words of ambiguous letters can change
            votes = Counter({s: n for s, own in enumerate(counts) if (n := sum(own))})
            overall = _best(votes) if votes else LATIN
            ambiguous = _script_patterns()[2]
            return ambiguous.sub(lambda m: _rebuilt_word(m.group(0), overall), text)
    return _rebuilt(text, None)


class _Chunks(dict):
    """Of what stands between two blanks, the unambiguous letters of each script, and whether two scripts stand side by side or a letter is of
    another one; remembers what was seen and is not long, up to a bound."""

    def __missing__(self, chunk: str) -> tuple[int, int, int, bool]:
        runs, mixed, _, other = _script_patterns()
        out = (*(sum(map(len, run.findall(chunk))) for run in runs), bool(mixed.search(chunk) or other.search(chunk)))
        if len(chunk) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[chunk] = out
        return out


_CHUNKS = _Chunks()


@lru_cache(50_000)
def _rebuilt_word(word: str, overall: int) -> str:
    """The same few words in every text."""
    return _rebuilt(word, overall)


def _rebuilt(text: str, overall: int | None) -> str:
    """Every step, one code point at a time; ``overall`` is the script of the text if this is a word of it."""
    table = decompositions()
    parts = "".join([table.get(c, c) for c in text])
    first = next((k for k, c in enumerate(parts) if not _is_mark(c)), len(parts))
    lead = "".join(sorted(parts[:first], key=unicodedata.combining))  # marks without a letter
    bases: list[str] = []
    marks: dict[int, list[str]] = {}
    for part in parts[first:]:
        if ord(part) >= 0x300 and _is_mark(part):
            marks.setdefault(len(bases) - 1, []).append(part)
        else:
            bases.append(part)
    plain = "".join(bases)
    if overall is not None:
        settled = list(_in_script(plain, overall))
    else:
        settled = list(plain if _one_script(plain) else _settle_scripts(plain))
    for k, own in marks.items():
        settled[k] = _compose(settled[k], own)
    return lead + "".join(settled)


# --- the DataFrame operator -------------------------------------------------


def _letter_rows() -> list[tuple]:
    """(character, class order of a mark or -1, script of an unambiguous letter or -1, forms or null) of every code point that has one of these."""
    rows = []
    for o in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xAA, 0x30000)]:
        ch = chr(o)
        if 0xD800 <= o < 0xE000:
            continue
        mark = unicodedata.combining(ch) if _is_mark(ch) else -1
        script = _script(ch)
        if mark >= 0 or script >= 0 or ch in _CLASS:
            rows.append((ch, mark, script, list(_CLASS[ch]) if ch in _CLASS else None))
    return rows


def mapping_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decomposition, letter and composition maps; fixed size (under 20,000 rows each)."""
    parts = spark.createDataFrame(
        [(c, list(p)) for c, p in decompositions().items()],
        T.StructType([T.StructField("_ch", T.StringType()), T.StructField("_parts", T.ArrayType(T.StringType()))]),
    )
    letters = spark.createDataFrame(_letter_rows(), "_part string, _mark int, _script int, _forms array<string>")
    whole = spark.createDataFrame(list(compositions().items()), "_whole string, _composed string")
    return F.broadcast(parts), F.broadcast(letters), F.broadcast(whole)


#: Characters that one task explodes, about.
CHARS_IN_TASK = 400_000


def canonical_forms(df: DataFrame, key: str, text: str, out: str = "form") -> DataFrame:
    """(key, out) for every row of ``df`` whose text is not null; ``key`` must be unique.

    One shuffle, on ``key``, to as many tasks as the number of characters asks
    for; everything after it (marks, scripts, rebuilding) stays in that
    partitioning.  A text is one cell of the input, so the rows exploded from it
    are bounded by it.
    """
    parts, letters, whole = mapping_tables(df.sparkSession)
    chars_in = df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first().n
    tasks = 1 + chars_in // CHARS_IN_TASK
    chars = (
        df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
        .where(F.col("_t").isNotNull())
        .repartition(tasks, "_k")
        .select("_k", F.posexplode_outer(F.expr("regexp_extract_all(_t, '(?s).', 0)")).alias("_pos", "_ch"))
    )
    split = (
        chars.join(parts, "_ch", "left")
        .select("_k", "_pos", F.posexplode_outer(F.coalesce("_parts", F.array("_ch"))).alias("_sub", "_part"))
        .join(letters, "_part", "left")
        .select(
            "_k",
            (F.col("_pos") * 64 + F.coalesce("_sub", F.lit(0))).alias("_at"),
            "_part",
            F.coalesce("_mark", F.lit(-1)).alias("_mark"),
            F.coalesce("_script", F.lit(-1)).alias("_script"),
            "_forms",
        )
    )
    order = Window.partitionBy("_k").orderBy("_at")
    starts = (F.col("_mark") < 0) & F.col("_part").isNotNull()
    cluster = F.sum(F.when(starts, 1).otherwise(0)).over(order)  # 0: marks before any letter
    clusters = (
        split.withColumn("_no", cluster)
        .groupBy("_k", "_no")
        .agg(
            F.min_by("_part", "_at").alias("_base"),
            F.min_by("_script", "_at").alias("_script"),
            F.min_by("_forms", "_at").alias("_forms"),
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.when(F.col("_mark") >= 0, F.struct("_mark", "_at", "_part")))),
                    lambda x: x["_part"],
                ),
                "",
            ).alias("_marks"),
        )
    )
    letter = F.col("_base").rlike(r"^\p{L}$")
    word_no = F.sum(F.when(letter, 0).otherwise(1)).over(Window.partitionBy("_k").orderBy("_no"))
    votes = lambda s, w: F.sum(F.when(F.col("_script") == s, 1).otherwise(0)).over(w)
    word, all_ = Window.partitionBy("_k", "_word"), Window.partitionBy("_k")

    def best(w) -> Column:
        a, b, c = (votes(s, w) for s in (LATIN, GREEK, CYRILLIC))
        return F.when(a + b + c == 0, None).when((a >= b) & (a >= c), LATIN).when(b >= c, GREEK).otherwise(CYRILLIC)

    # a word without an unambiguous letter asks the text; only letters' words matter
    settled = clusters.withColumn("_word", word_no).withColumn("_own", best(word)).withColumn("_all", best(all_))
    base = F.when(
        F.col("_forms").isNotNull(), F.expr("element_at(_forms, coalesce(_own, _all, 0) + 1)")
    ).otherwise(F.col("_base"))
    settled = settled.select(
        "_k", "_no", F.concat(F.when(F.col("_no") > 0, base).otherwise(""), "_marks").alias("_whole")
    )
    two = whole.select(F.col("_whole").alias("_two"), F.col("_composed").alias("_composed2"))
    rebuilt = (
        settled.join(whole, "_whole", "left")
        .withColumn("_two", F.when(F.length("_whole") > 2, F.substring("_whole", 1, 2)))
        .join(two, "_two", "left")
        .select(
            "_k",
            "_no",
            F.coalesce("_composed", F.concat("_composed2", F.expr("substring(_whole, 3)")), "_whole").alias("_s"),
        )
    )
    return rebuilt.groupBy(F.col("_k").alias(key)).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_no", "_s"))), lambda x: x["_s"]), "").alias(out)
    )


# --- finding look-alike pairs ------------------------------------------------


@lru_cache(1)
def _stable_keys() -> tuple[str, str]:
    """translate() arguments that keep what every spelling of a text shares, and delete the rest.

    Kept are characters that only single code points stand for; letters with
    look-alikes, parts of ligatures, marks and invisible characters go.
    """
    table = decompositions()
    unsure = set(_CLASS) | {p for parts in table.values() if sum(not _is_mark(p) for p in parts) != 1 for p in parts}
    keep, drop = {}, set(unsure)
    for ch, parts in table.items():
        if 0xAC00 <= ord(ch) < 0xD7A4:
            drop.update((ch, *parts))
            continue
        bases = [p for p in parts if not _is_mark(p)]
        drop.update(p for p in parts if _is_mark(p))
        if len(bases) == 1 and bases[0] not in unsure:
            keep[ch] = bases[0]
        else:
            drop.add(ch)
    drop.update(chr(o) for o in range(0x300, 0x30000) if not 0xD800 <= o < 0xE000 and _is_mark(chr(o)))
    drop -= set(keep)
    return "".join(keep) + "".join(sorted(drop)), "".join(keep.values())


def look_profile(text: Column) -> Column:
    """A hash that texts of one form always share, of the whole text.

    Candidates only: it separates texts that cannot have one form without
    exploding them.  Computed in the JVM, without a shuffle.
    """
    return F.xxhash64(F.translate(text, *_stable_keys()))


def _string_key() -> Column:
    """A key of a string of a field that no other string has."""
    return F.unhex(F.md5(F.concat_ws("|", F.base64(F.encode("field", "UTF-8")), "text")))


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """(field, id_a, id_b): ids of a field whose texts differ as strings but have one form.

    ``texts``: field, id (unique in a field), text.  Null and empty texts make
    no pair; equal strings make no pair; rows that repeat make a pair once.
    Every text is profiled; only texts that share their profile with a
    different string are exploded, once per distinct string.  Strings of one
    form are paired, then expanded to the rows that have them, a large group a
    part at a time.
    """
    rows = texts.where(F.col("text").isNotNull() & (F.col("text") != "")).select("field", "id", "text")
    keyed = rows.select("field", "id", look_profile(F.col("text")).alias("_p"), _string_key().alias("_h"))
    keyed = written(keyed, "look-profiles")
    kinds = keyed.groupBy("field", "_p", "_h").agg(F.min("id").alias("_rep"))
    shared = kinds.groupBy("field", "_p").agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi")).where("_lo <> _hi")
    reps = kinds.join(shared.select("field", "_p"), ["field", "_p"], "left_semi")
    wanted = rows.join(reps.select("field", F.col("_rep").alias("id"), "_h"), ["field", "id"]).where(F.col("_h") == _string_key())
    wanted = written(wanted.select("_h", "text").dropDuplicates(["_h"]), "look-texts")
    forms = written(canonical_forms(wanted, "_h", "text").select("_h", F.md5("form").alias("_form")), "look-forms")
    members = keyed.join(forms, "_h").select(F.col("_h").alias("group"), "id", "field", "_form").distinct()
    strings = members.select(F.concat_ws("|", "field", "_form").alias("group"), F.col("group").alias("id")).distinct()
    unlike = pairs_within(strings).select("a", "b")  # strings of one form, not rows
    pairs = paired_members(unlike, members.select("group", "id"))
    named = members.select(F.col("group").alias("a"), "field").distinct()
    pairs = pairs.join(named.hint("merge"), "a").where("x <> y")
    return pairs.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def one_form(texts: DataFrame) -> DataFrame:
    """(field, id, form) of every row of ``texts`` (field, id, text): equal look is equal ``form``; null texts have none.

    A text of printable ASCII and line feeds is its own form by definition; all
    others are exploded, once per distinct string.
    """
    rows = texts.select("field", "id", "text").where(F.col("text").isNotNull())
    plain = F.col("text").rlike(r"\A[\n\x20-\x7E]*\z")
    own = rows.where(plain).select("field", "id", F.col("text").alias("form"))
    odd = rows.where(~plain).select("field", "id", "text", F.unhex(F.md5("text")).alias("_h"))
    forms = canonical_forms(written(odd.groupBy("_h").agg(F.any_value("text").alias("text")), "odd-texts"), "_h", "text")
    return own.unionByName(spread_join(odd.select("field", "id", "_h"), forms, "_h", "id", parts=4).select("field", "id", "form"))


def archive_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, id, text) of all titles, bodies and quotes."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return (
        read("pages")
        .select(F.lit("title").alias("field"), F.col("id"), F.col("title").alias("text"))
        .unionByName(read("contents").select(F.lit("body").alias("field"), F.col("page_id").alias("id"), F.col("body").alias("text")))
        .unionByName(read("snippets").select(F.lit("snippet").alias("field"), "id", "text"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(archive_texts(spark, sf_dir))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title, body and quote in its one form."""
    return one_form(archive_texts(spark, sf_dir))
