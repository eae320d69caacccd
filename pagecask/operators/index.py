"""Inverted indexes: postings with positions, the collection's totals, and its vocabulary.

A posting is a row a token and record: ``token, id, length, positions``; a
position holds its field in the bits above FIELD_BITS, so that a phrase never
crosses fields and one array serves all fields.  Postings are sorted by token,
so a query for a word or a beginning of words reads the row groups of its
tokens only.  An index is kept in segments: a change adds the postings of the
records it touched, and the postings of older segments for these records are
dead.  Vocabulary and totals are signed and add up.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecask.functions.text import fold, tokens
from pagecask.sources.scratch import scratch_path

FIELD_BITS = 24
PAGE_WEIGHTS = {"title": 10.0, "headings": 4.0, "description": 3.0, "body": 1.0}
SNIPPET_WEIGHTS = {"text": 5.0, "page_title": 2.0}
POSTINGS = "token string, id long, length int, positions array<int>"
DOCS = "id long, length int"
VOCABULARY = "term string, doc long, cnt long"


@dataclass(frozen=True)
class Index:
    """``docs`` has every record (id, length), also those without a token; ``rows`` and ``total`` are their number and tokens."""

    postings: DataFrame
    docs: DataFrame
    vocabulary: DataFrame
    rows: int
    total: int
    weights: dict[str, float]


@dataclass(frozen=True)
class Segment:
    """One folder of an index and what it adds to the totals."""

    path: str
    rows: int
    total: int


def page_texts(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """Every page with its texts; both tables grow alike, so the join is by shuffle whatever their size."""
    texts = contents.select(F.col("page_id").alias("id"), "headings", "description", "body").hint("merge")
    return pages.select("id", "title").join(texts, "id", "left")


def _tokenised(texts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, length, marked): the tokens of all fields with their positions."""

    def marked(k: int, field: str) -> Column:
        own = tokens(fold(F.coalesce(field, F.lit(""))))
        return F.transform(own, lambda t, i: F.struct(t.alias("token"), (i + F.lit(k << FIELD_BITS)).alias("position")))

    out = texts.select("id", F.concat(*(marked(k, f) for k, f in enumerate(weights))).alias("marked"))
    return out.select("id", F.size("marked").alias("length"), "marked")


def _postings(tokenised: DataFrame) -> DataFrame:
    each = tokenised.select("id", "length", F.explode("marked").alias("m")).select("id", "length", "m.token", "m.position")
    return each.groupBy("token", "id").agg(F.first("length").alias("length"), F.sort_array(F.collect_list("position")).alias("positions"))


def _counts(postings: DataFrame, sign: int) -> DataFrame:
    return postings.groupBy(F.col("token").alias("term")).agg((F.count("*") * sign).alias("doc"), (F.sum(F.size("positions")) * sign).cast("long").alias("cnt"))


def _write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_segment(path: str, weights: dict[str, float], texts: DataFrame, before: DataFrame | None = None, touched: DataFrame | None = None, old_docs: DataFrame | None = None) -> Segment:
    """Writes the postings of ``texts`` (id and the fields).

    A change passes the old texts of the records it touched, their ids (which
    may be gone now) and the index's records as they were.
    """
    spark = texts.sparkSession
    _write_sorted(_postings(_tokenised(texts, weights)), f"{path}/postings", "token", "id")
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    lengths = postings.select("id", "length").distinct()
    own = texts.select("id").join(lengths.hint("merge"), "id", "left").select("id", F.coalesce("length", F.lit(0)).alias("length"))
    vocabulary = _counts(postings, 1)
    if before is None or touched is None or old_docs is None:
        own.write.mode("overwrite").parquet(f"{path}/docs")
    else:
        touched.select("id").join(own, "id", "left").write.mode("overwrite").parquet(f"{path}/docs")
        gone = _counts(_postings(_tokenised(before, weights)), -1)
        vocabulary = vocabulary.unionByName(gone).groupBy("term").agg(F.sum("doc").alias("doc"), F.sum("cnt").alias("cnt"))
    _write_sorted(vocabulary, f"{path}/vocabulary", "term")
    size = spark.read.schema(DOCS).parquet(f"{path}/docs").where("length is not null").agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
    now = size.first()
    rows, total = now.rows, now.total
    if touched is not None and old_docs is not None:
        was = old_docs.join(touched.select("id"), "id", "left_semi").agg(F.count("*").alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
        rows, total = rows - was.rows, total - was.total
    return Segment(path, rows, total)


def read_index(spark: SparkSession, segments: list[Segment], weights: dict[str, float]) -> Index:
    """The index of all segments, oldest first; a record counts as its latest segment has it."""
    read = lambda s, name, schema: spark.read.schema(schema).parquet(f"{s.path}/{name}")
    postings, docs, vocabulary = [], [], []
    later: DataFrame | None = None
    for s in reversed(segments):
        p, d = read(s, "postings", POSTINGS), read(s, "docs", DOCS)
        if later is not None:
            p, d = p.join(later, "id", "left_anti"), d.join(later, "id", "left_anti")
        postings.append(p.select("token", "id", "length", "positions"))
        docs.append(d.select("id", "length"))
        vocabulary.append(read(s, "vocabulary", VOCABULARY))
        own = read(s, "docs", DOCS).select("id")
        later = own if later is None else later.unionByName(own)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    words = union(vocabulary)
    if len(segments) > 1:
        words = words.groupBy("term").agg(F.sum("doc").alias("doc"), F.sum("cnt").alias("cnt")).where("doc > 0")
    return Index(union(postings), union(docs).where("length is not null"), words, sum(s.rows for s in segments), sum(s.total for s in segments), weights)


def merged_segment(index: Index, path: str) -> Segment:
    """All segments of an index as one, without reading a text."""
    _write_sorted(index.postings, f"{path}/postings", "token", "id")
    _write_sorted(index.vocabulary, f"{path}/vocabulary", "term")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    return Segment(path, index.rows, index.total)


def build_index(texts: DataFrame, weights: dict[str, float]) -> Index:
    """An index of texts that is kept nowhere else, in the shared folder."""
    segment = write_segment(scratch_path(texts.sparkSession, "index"), weights, texts)
    return read_index(texts.sparkSession, [segment], weights)


def page_index(pages: DataFrame, contents: DataFrame) -> Index:
    return build_index(page_texts(pages, contents), PAGE_WEIGHTS)


def snippet_index(snippets: DataFrame) -> Index:
    return build_index(snippets.select("id", *SNIPPET_WEIGHTS), SNIPPET_WEIGHTS)


# --- matching -------------------------------------------------------------------

Phrases = list[tuple[list[str], bool]]


def _is(word: str, prefix: bool) -> Column:
    return F.col("token").startswith(word) if prefix else F.col("token") == word


def _wanted(phrases: Phrases) -> Column:
    """The tokens of all phrases, as a filter that the scan can use."""
    exact = {t for p, x in phrases for k, t in enumerate(p) if not (x and k == len(p) - 1)}
    parts = [F.col("token").isin(sorted(exact))] if exact else []
    parts += [F.col("token").startswith(t) for t in sorted({p[-1] for p, x in phrases if x})]
    return reduce(lambda a, b: a | b, parts)


def phrase_weights(index: Index, phrases: Phrases, names: list[str]) -> DataFrame:
    """(id, length, one column a phrase): the weighted number of places of each phrase in the records that have any of its tokens.

    With ``prefix`` a phrase's last token may go on; overlapping places count.
    """
    field = list(index.weights.values())
    weight = lambda x: F.element_at(F.array(*map(F.lit, field)), F.shiftright(x, FIELD_BITS) + 1)
    slots: dict[tuple[str, bool, int], str] = {}
    for p, x in phrases:
        for k, t in enumerate(p):
            slots.setdefault((t, x and k == len(p) - 1, k), f"_s{len(slots)}")

    def starts(word: str, prefix: bool, shift: int) -> Column:
        own = F.transform("positions", lambda at: at - shift) if shift else F.col("positions")
        return F.flatten(F.collect_list(F.when(_is(word, prefix), own)))

    rows = index.postings.where(_wanted(phrases)).groupBy("id").agg(F.first("length").alias("length"), *(starts(*key).alias(name) for key, name in slots.items()))

    def places(phrase: list[str], prefix: bool) -> Column:
        own = [F.col(slots[(t, prefix and k == len(phrase) - 1, k)]) for k, t in enumerate(phrase)]
        return F.aggregate(reduce(F.array_intersect, own), F.lit(0.0), lambda total, at: total + weight(at))

    return rows.select("id", "length", *(places(p, x).alias(n) for (p, x), n in zip(phrases, names, strict=True)))


def matching_ids(index: Index, phrases: Phrases, every: bool) -> DataFrame:
    """(id) of the records that have all of the phrases, or any."""
    names = [f"w{k}" for k in range(len(phrases))]
    found = phrase_weights(index, phrases, names)
    return found.where(reduce(lambda a, b: (a & b) if every else (a | b), (F.col(n) > 0 for n in names))).select("id")
