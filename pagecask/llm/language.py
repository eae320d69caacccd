"""Languages of documents and of their segments (problem 1).

A byte convolutional network (``byte_cnn``), trained in numpy on a bounded
sample of labelled documents, classifies fixed-length overlapping windows of
every text.  Windows never cross a sentence; the windows of a sentence decide
together, sentences and lines without enough evidence take the language of the
nearest decided one, and runs of one language are the segments.

Defined results
    null, empty and letterless texts give no segment, nor does a text in which
    nothing is decided (filler, code); a segment's confidence is the mean
    probability of its language over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagecask.llm.byte_cnn import BLOCK, REACH, STRIDE, ByteCnn, train
from pagecask.llm.visual_form import LINE_ENDS, canonical

LANGUAGES = ["de", "el", "en", "es", "fr", "nl", "pt", "ru"]
#: Bound of the labelled sample the network is fitted on, documents and characters of each; and windows drawn from it.
SAMPLE_DOCUMENTS = 3000
SAMPLE_CHARS = 1200
SAMPLE_WINDOWS = 20_000
#: Words of a language from which a page counts as having it.
MIN_WORDS = 40
#: A unit decides its language if its blocks are this sure on average and it has so many words; others inherit.
SURE = 0.72
UNIT_WORDS = 5
#: Share of a language's words that must lie in units that decided for it.
SURE_SHARE = 0.5
#: Longest unit, in blocks.
UNIT_BLOCKS = 8

# Frequent invisible characters and blanks.
_ODD = "\u00a0\u00ad\u2002\u2003\u2007\u2009\u200b\u200c\u200d\u200e\u202f\u2060\u3000\ufeff"
_STOP_BYTE = np.zeros(256, bool)
_STOP_BYTE[[ord(c) for c in ".!?"]] = True
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def labelled_sample(documents: DataFrame) -> list[tuple[str, str]]:
    """(text, language): at most SAMPLE_DOCUMENTS labelled documents, those with the smallest hashes.

    The labels are counted first, so that each task passes on only the hashes
    below a bound; what reaches the driver does not grow with the data.
    """
    labelled = documents.where(F.col("lang").isin(LANGUAGES))
    n = labelled.count()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    rows = (
        labelled.select("doc_id", "text", "lang", place.alias("h")).where(F.col("h") < min(1.0, 1.5 * SAMPLE_DOCUMENTS / max(1, n)))
        .where(F.length("text") >= 40).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), "lang", "h", "doc_id")
        .orderBy("h", "doc_id").limit(SAMPLE_DOCUMENTS).collect()
    )
    return [(r.text, r.lang) for r in rows]


def fit(sample: list[tuple[str, str]], *, seed: int = 7) -> ByteCnn:
    """Two rounds: the second leaves out documents whose label the first round's network contradicts."""
    rng = np.random.default_rng(seed)
    texts = [t.lower().encode() for t, _ in sample]
    labels = np.array([LANGUAGES.index(x) for _, x in sample], int)

    def windows(own: np.ndarray, n: int) -> tuple[list[bytes], np.ndarray]:
        by = [own[labels[own] == k] for k in range(len(LANGUAGES))]
        by = [x for x in by if len(x)]
        out, lab = [], []
        for k in rng.integers(0, len(by), n):  # as many windows of each language
            d = rng.choice(by[k])
            size = int(rng.choice([2 * BLOCK, 2 * BLOCK, BLOCK, rng.integers(8, 2 * BLOCK)]))
            at = int(rng.integers(0, max(1, len(texts[d]) - size)))
            piece = max(texts[d][at : at + size].split(b"\n"), key=len)
            out.append(piece)
            lab.append(labels[d])
        return out, np.array(lab)

    everything = np.arange(len(texts))
    first = train(*windows(everything, SAMPLE_WINDOWS // 2), LANGUAGES, epochs=2, seed=seed)
    agrees = []
    for d in everything:
        blocks, _, unit = unit_blocks(texts[d])
        lp = window_log_probs(first, blocks, unit).sum(0)
        agrees.append(lp[labels[d]] >= lp.max() - 1e-6)
    kept = everything[np.array(agrees)]
    return train(*windows(kept if len(kept) else everything, SAMPLE_WINDOWS), LANGUAGES, epochs=5, seed=seed)


def unit_blocks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all units: bytes with reach, start, and number of the unit.

    A unit is a sentence of a line, cut after UNIT_BLOCKS blocks.
    """
    raw = np.frombuffer(data, np.uint8)
    feed = raw == 10
    stop = _STOP_BYTE[raw]
    if len(raw) > 1:  # a stop before a blank, a quotation mark or a line's end
        stop[:-1] &= (raw[1:] == 32) | (raw[1:] == 0xE2) | (raw[1:] == 34) | feed[1:]
    cuts = np.flatnonzero(feed | stop)
    ends = np.append(cuts + ~feed[cuts], len(raw))  # a stop belongs to its sentence, a line feed to none
    begins = np.append(0, np.append(cuts + 1, len(raw))[:-1])
    full = ends > begins
    begins, ends = begins[full], ends[full]
    pieces = -(-(ends - begins) // (UNIT_BLOCKS * BLOCK))
    of = np.repeat(np.arange(len(begins)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begins = begins[of] + nth * UNIT_BLOCKS * BLOCK
    ends = np.minimum(ends[of], begins + UNIT_BLOCKS * BLOCK)
    count = -(-(ends - begins) // BLOCK)
    unit = np.repeat(np.arange(len(begins)), count)
    nth = np.arange(len(unit)) - np.repeat(np.cumsum(count) - count, count)
    start = begins[unit] + nth * BLOCK
    padded = np.append(raw, np.zeros(BLOCK + REACH, np.uint8))
    blocks = np.lib.stride_tricks.sliding_window_view(padded, BLOCK + REACH - STRIDE)[start]
    rows = np.flatnonzero((start + BLOCK + REACH - STRIDE) > ends[unit])
    if len(rows):
        blocks[rows] *= (start[rows, None] + np.arange(BLOCK + REACH - STRIDE)) < ends[unit[rows], None]
    return blocks, start, unit


def window_log_probs(model: ByteCnn, blocks: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Log probabilities of each block: the mean of the windows that it lies in."""
    if not len(blocks):
        return np.zeros((0, len(model.classes)), np.float32)
    f = model.block_features(blocks)
    joined = unit[1:] == unit[:-1]
    pair = np.maximum(f[:-1], f[1:])
    alone = np.ones(len(f), bool)
    alone[:-1] &= ~joined
    alone[1:] &= ~joined
    total = np.zeros((len(f), len(model.classes)), np.float32)
    parts = np.zeros(len(f), np.float32)
    lp = model.log_probs(pair[joined]) if joined.any() else np.zeros((0, len(model.classes)), np.float32)
    at = np.flatnonzero(joined)
    total[at] += lp
    total[at + 1] += lp
    parts[at] += 1
    parts[at + 1] += 1
    if alone.any():
        total[alone] = model.log_probs(f[alone])
        parts[alone] = 1
    return total / parts[:, None]


def word_starts(raw: np.ndarray) -> np.ndarray:
    """Whether a word begins at each byte; punctuation of two and three bytes is no word."""
    word = _WORD_BYTE[raw]
    for lead, size in ((0xC2, 2), (0xE2, 3)):
        at = np.flatnonzero(raw == lead)
        for k in range(size):
            word[np.minimum(at + k, len(raw) - 1)] = False
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    return begins


def _readable(text: str) -> str:
    """Without invisible characters and odd blanks, which break words up; other texts as they are."""
    if any(c in text for c in _ODD) and not any(c in text for c in LINE_ENDS):
        return canonical(text)
    return text


def segments_of(model: ByteCnn, texts: list[str]) -> dict[str, np.ndarray]:
    """Segments of many texts at once: text, line_from, line_to, lang (-1: none), confidence, words, sure_words (of units that decided it)."""
    data = [_readable(t).lower().encode() for t in texts]
    size = np.array([len(d) for d in data])
    whole = b"\n".join(data)
    raw = np.frombuffer(whole, np.uint8)
    blocks, start, unit = unit_blocks(whole)
    if not len(blocks):
        return {k: np.zeros(0, int) for k in ("text", "line_from", "line_to", "lang", "words", "sure_words")} | {"confidence": np.zeros(0)}
    lp = window_log_probs(model, blocks, unit)
    first = np.append(0, np.flatnonzero(unit[1:] != unit[:-1]) + 1)
    length = np.diff(np.append(first, len(unit)))
    at = start[first]
    words = np.add.reduceat(word_starts(raw), at)
    text_start = np.append(0, np.cumsum(size + 1)[:-1])
    text = np.searchsorted(text_start, at, "right") - 1
    total = np.add.reduceat(lp, first)
    label = total.argmax(1)
    mean = np.add.reduceat(np.exp(lp.max(1)), first) / length
    sure = (mean >= SURE) & (words >= UNIT_WORDS)
    # units with weak evidence take the nearest decided unit of their text, the one before at equal distance
    k = np.arange(len(first))
    back = np.maximum.accumulate(np.where(sure, k, -1))
    back = np.where((back >= 0) & (text[back] == text), back, -1)
    ahead = np.minimum.accumulate(np.where(sure, k, len(k))[::-1])[::-1]
    ahead = np.where(ahead < len(k), ahead, -1)
    ahead = np.where((ahead >= 0) & (text[ahead] == text), ahead, -1)
    nearest = np.where((ahead < 0) | ((back >= 0) & (k - back <= ahead - k)), back, ahead)
    weak = (mean < SURE) & ~sure
    label = np.where(sure, label, np.where(nearest >= 0, label[nearest], np.where(weak, -1, label)))
    own = np.add.reduceat(np.exp(lp)[np.arange(len(lp)), np.repeat(np.maximum(label, 0), length)], first) / length
    change = np.append(True, (label[1:] != label[:-1]) | (text[1:] != text[:-1]))
    run = np.flatnonzero(change)
    many = np.diff(np.append(run, len(label)))
    feeds = np.cumsum(raw == 10)  # line feeds up to each byte
    line = feeds[at] - np.where(text_start[text] > 0, feeds[np.maximum(text_start[text] - 1, 0)], 0) + 1
    return {
        "text": text[run],
        "line_from": line[run],
        "line_to": line[run + many - 1],
        "lang": label[run],
        "words": np.add.reduceat(words, run),
        "sure_words": np.add.reduceat(np.where(sure, words, 0), run),
        "confidence": np.add.reduceat(own, run) / many,
    }


#: Characters classified at once.
_BATCH_CHARS = 2_000_000


def language_segments(texts: DataFrame, model: ByteCnn, key: str, text: str) -> DataFrame:
    """(key, segment, line_from, line_to, lang, confidence, words, sure_words) of every text; a map without a shuffle."""

    def one(ids: list, own: list[str]) -> pa.RecordBatch:
        s = segments_of(model, own)
        keep = (s["words"] > 0) & (s["lang"] >= 0)
        t = s["text"][keep]
        nth = np.arange(len(t)) - np.searchsorted(t, t, "left") if len(t) else t
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[k] for k in t], pa.int64()),
                pa.array(nth + 1, pa.int32()),
                pa.array(s["line_from"][keep], pa.int32()),
                pa.array(s["line_to"][keep], pa.int32()),
                pa.array([LANGUAGES[k] for k in s["lang"][keep]], pa.string()),
                pa.array(s["confidence"][keep], pa.float64()),
                pa.array(s["words"][keep], pa.int32()),
                pa.array(s["sure_words"][keep], pa.int32()),
            ],
            [key, "segment", "line_from", "line_to", "lang", "confidence", "words", "sure_words"],
        )

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                own.append(t)
                size += len(t)
                if size >= _BATCH_CHARS:
                    yield one(ids, own)
                    ids, own, size = [], [], 0
            if own:
                yield one(ids, own)

    return (
        texts.select(key, text)
        .where(F.col(text).isNotNull() & (F.col(text) != ""))
        .mapInArrow(classify, f"{key} long, segment int, line_from int, line_to int, lang string, confidence double, words int, sure_words int")
    )


def stated_language(label):
    """The language that a label states, or null: a two-letter code alone, or before ``-`` or ``_`` and a region."""
    code = F.regexp_extract(F.lower(label), r"^([a-z]{2})(?:[-_][a-z0-9]+)*$", 1)
    return F.when(code != "", code)


def model_for(spark: SparkSession, sf_dir: str) -> ByteCnn:
    return fit(labelled_sample(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def document_languages(segments: DataFrame, key: str) -> DataFrame:
    """(key, lang, words, share, confidence): the languages of each document, from its segments.

    A language counts if at least half of its words lie in units that decided
    for it by themselves; filler and code, which no language claims surely,
    so have none.  The confidence is the mean over the words.
    """
    by = segments.groupBy(key, "lang").agg(
        F.sum("words").alias("words"), F.sum("sure_words").alias("_sure"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence")
    )
    kept = by.where(F.col("_sure") >= F.col("words") * SURE_SHARE)
    share = F.col("words") / F.sum("words").over(Window.partitionBy(key))  # at most a row a language
    return kept.select(key, "lang", "words", share.alias("share"), "confidence")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = spark.read.parquet(f"{sf_dir}/contents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("id").alias("page_id"), stated_language(F.col("lang")).alias("stated"))
    segments = language_segments(contents, model_for(spark, sf_dir), "page_id", "body")
    found = document_languages(segments, "page_id").where(F.col("words") >= MIN_WORDS).join(pages, "page_id")
    return found.where(~F.col("lang").eqNullSafe(F.col("stated"))).select("page_id", "lang")


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every body with its language and confidence."""
    contents = spark.read.parquet(f"{sf_dir}/contents.parquet")
    return language_segments(contents, model_for(spark, sf_dir), "page_id", "body")
