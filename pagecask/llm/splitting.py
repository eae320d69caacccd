"""Splitting oversized texts at natural boundaries (problem 8).

Content-defined chunking over tokens: a rolling hash of the last WINDOW tokens
marks landmarks that depend on nothing but those tokens; a piece ends at the
first landmark between its smallest and largest size, moved to the nearest
paragraph end there, else sentence end, else word end.  So an edit changes the
pieces around it, and the cuts after it fall where they did.  Each piece but
the first begins ``overlap`` tokens before the cut.

Defined results
    null and empty texts give no piece; a text within the limit is one piece;
    pieces without their overlaps, put together, are the text; an overlap
    above half the limit is refused, since pieces would hardly advance; a text without white space is cut between tokens, never inside a character; a piece's
    tokens are those of its own text, and are at most the limit.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecask.llm.tokens import VOCABULARY, encoding, limits, token_bytes, vocabulary

WINDOW = 12
#: Smallest piece as a share of the largest, and landmarks to expect between them.
SMALLEST = 0.5
LANDMARKS = 3
NONE, WORD, SENTENCE, PARAGRAPH = 0, 1, 2, 3
#: Texts are marked together until they have so many tokens.
TOGETHER = 1 << 15

_BLANK = b" \t\r\n\x0b\x0c"
_CONTINUED = bytes(range(0x80, 0xC0))
_STOPS = tuple(s.encode() for s in (".", "!", "?", "…", ";", ":", '."', '!"', '?"', ".”", ".»", ".)", "。"))


#: What a token's bytes are like, one bit each.
STARTS_BLANK, ENDS_BLANK, FEED, STOP, INSIDE, ENDS_SOLID = 1, 2, 4, 8, 16, 32


def _ends_solid(token: bytes) -> bool:
    """Whether its last character is whole and certainly no white space."""
    if not token or token[-1] < 0x80:
        return token[-1:] > b" " and token[-1:] != b"\x7f"
    try:
        return not token.decode()[-1].isspace()
    except UnicodeDecodeError:
        return False


@functools.lru_cache(2)
def _token_table(ranks: bytes) -> tuple[np.ndarray, ...]:
    """By token id: kind (bits), number of characters that start in it, random word. The last stands between texts and has none of them."""
    raw = [*token_bytes(ranks), b""]
    rng = np.random.default_rng(11)
    kinds = (
        (STARTS_BLANK, [t[:1] in _BLANK for t in raw]),
        (ENDS_BLANK, [t[-1:] in _BLANK for t in raw]),
        (FEED, [b"\n" in t for t in raw]),
        (STOP, [t.rstrip(_BLANK).endswith(_STOPS) for t in raw]),
        (INSIDE, [b"\x80" <= t[:1] < b"\xc0" for t in raw]),
        (ENDS_SOLID, [_ends_solid(t) for t in raw]),
    )
    used = np.array([t != b"" for t in raw])
    return (
        sum((np.array(holds) & used) * np.uint8(bit) for bit, holds in kinds),
        np.array([len(t.translate(None, _CONTINUED)) for t in raw]),
        np.append(rng.integers(0, 1 << 63, len(raw) - 1, dtype=np.uint64), np.uint64(0)),
    )


def boundaries(ids: np.ndarray, ranks: bytes) -> np.ndarray:
    """Level of the boundary before each token; -1 inside a character."""
    level = np.zeros(len(ids), np.int8)
    if len(ids) < 2:
        return level
    kind = _token_table(ranks)[0][ids]
    a, b = kind[:-1], kind[1:]
    gap = ((a & ENDS_BLANK) | (b & STARTS_BLANK)) > 0
    stop = (a & STOP) > 0
    blank_only = (a & (STARTS_BLANK | ENDS_BLANK | STOP)) == STARTS_BLANK | ENDS_BLANK
    before_stop = stop.copy()
    before_stop[1:] |= blank_only[1:] & stop[:-1]
    out = level[1:]
    out += gap
    out += gap & before_stop
    out[((a ^ b) & FEED > 0) & (((a & FEED) | (b & STARTS_BLANK)) > 0)] = PARAGRAPH
    out[(b & INSIDE) > 0] = -1
    return level


def rolling(ids: np.ndarray, ranks: bytes) -> np.ndarray:
    """Hash of the WINDOW tokens before each position: the sum of their words, the k-th last shifted by k."""
    part, h, at = _token_table(ranks)[-1][ids], np.zeros(len(ids), np.uint64), 0
    width = 1  # part has the sum over so many tokens up to each; WINDOW is put together of powers of two
    while True:
        if WINDOW & width:
            h[at + 1 :] += (part << np.uint64(at))[: max(0, len(ids) - at - 1)]
            at += width
        if at == WINDOW:
            break
        wider = part.copy()
        wider[width:] += part[:-width] << np.uint64(width)
        part, width = wider, 2 * width
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class Marks(NamedTuple):
    """What the pieces of a text under every limit are made from."""

    level: np.ndarray
    h: np.ndarray
    #: Token positions of each level.
    places: dict[int, np.ndarray]
    #: Token positions at which a word ends and a blank begins, with both ends of the text. Whatever stands before or after,
    #: the tokenizer divides there: no part of its pattern goes on from a character to a blank.
    sure: np.ndarray
    #: Character at which each token begins, and the text's end.
    char: np.ndarray


def marks(texts: Sequence[Sequence[int]], ranks: bytes) -> list[Marks]:
    """Those of each text, given its tokens; all are made at once, with WINDOW tokens between two texts that are none."""
    kind, leads, _ = _token_table(ranks)
    between = [len(kind) - 1] * WINDOW
    size = np.array([len(x) for x in texts], int)
    end = np.cumsum(size + WINDOW)
    begin = end - size
    ids = np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable((between, x) for x in texts)), int, int(end[-1]) if len(end) else 0)
    level, h, kind = boundaries(ids, ranks), rolling(ids, ranks), kind[ids]
    level[begin[size > 0]] = NONE
    char = np.append(0, np.cumsum(leads[ids]))
    sure = (((kind[:-1] & ENDS_SOLID) > 0) & ((kind[1:] & STARTS_BLANK) > 0)).nonzero()[0] + 1

    def by_text(at: np.ndarray) -> list[np.ndarray]:
        return [at[i:j] - b for i, j, b in zip(at.searchsorted(begin).tolist(), at.searchsorted(end).tolist(), begin, strict=True)]

    levels = (PARAGRAPH, SENTENCE, WORD, NONE)
    places = zip(*(by_text((level == v).nonzero()[0]) for v in levels), strict=True)
    return [
        Marks(level[b:e], h[b:e], dict(zip(levels, p, strict=True)), np.concatenate(([0], s, [e - b])), char[b : e + 1] - char[b])
        for b, e, p, s in zip(begin.tolist(), end.tolist(), places, by_text(sure), strict=True)
    ]


class OverlapError(ValueError):
    """An overlap of more than half the limit."""


def cuts(ids: Sequence[int], limit: int, overlap: int, ranks: bytes, known: Marks | None = None) -> list[int]:
    """Token positions at which pieces begin, their overlap not counted; the first is 0. ``known`` are the marks of the tokens."""
    if overlap > limit // 2:
        raise OverlapError(f"overlap {overlap} with limit {limit}")
    out = [0]
    n = len(ids)
    if n <= limit:
        return out
    level, h, places, _, _ = known or marks([ids], ranks)[0]
    # sizes as if every piece had an overlap, so that they don't depend on the place in the text
    most = limit - overlap
    least = max(1, int(most * SMALLEST))
    spacing = max(2, (most - least) // LANDMARKS)
    landmark = (h % np.uint64(spacing) == 0).nonzero()[0]
    at = 0
    while n - at > most:
        low, high = at + least, min(at + most, n - 1)
        k = landmark.searchsorted(low)
        mark = int(landmark[k]) if k < len(landmark) and landmark[k] <= high else low + int(h[low : high + 1].argmax())
        cut = None
        for p in places.values():
            i = p.searchsorted(mark)
            near = [int(x) for x in p[max(i - 1, 0) : i + 1] if low <= x <= high]
            if near:
                cut = min(near, key=lambda x: (abs(x - mark), x))
                break
        if cut is None:  # a character over the whole window stays whole
            whole = np.flatnonzero(level[low:] >= 0)
            if not len(whole):
                break
            cut = low + int(whole[0])
        out.append(cut)
        at = cut
    return out


def count_between(text: str, start: int, end: int, known: Marks, enc: tiktoken.Encoding) -> int:
    """Tokens of the text from one token to another, taken by itself: those between the first and the last sure place are
    as in the whole text, only what is left at either end is tokenized again."""
    _, _, _, sure, char = known
    first, last = int(sure[sure.searchsorted(start)]), int(sure[sure.searchsorted(end, "right") - 1])
    if first > last:
        return len(enc.encode_ordinary(text[char[start] : char[end]]))
    n = last - first
    if start < first:
        n += len(enc.encode_ordinary(text[char[start] : char[first]]))
    if last < end:
        n += len(enc.encode_ordinary(text[char[last] : char[end]]))
    return n


def pieces(text: str, limit: int, overlap: int, ranks: bytes, ids: Sequence[int] | None = None, known: Marks | None = None) -> list[tuple[int, int, int, int, str]]:
    """(begin, new_from, end, tokens, piece): characters begin..end are the piece, of which those before new_from are the overlap."""
    enc = encoding(ranks)
    if ids is None:
        ids = enc.encode_ordinary(text)
    if not len(ids):
        return []
    if len(ids) <= limit:
        return [(0, 0, len(text), len(ids), text)]
    known = known or marks([ids], ranks)[0]
    begins = cuts(ids, limit, overlap, ranks, known)
    ends = [*begins[1:], len(ids)]
    level, char = known.level, known.char
    out: list[tuple[int, int, int, int, str]] = []
    for k, (a, e) in enumerate(zip(begins, ends, strict=True)):
        start = a if k == 0 else max(0, a - overlap)
        while start < a and level[start] < 0:
            start += 1
        tokens = count_between(text, start, e, known, enc)
        while tokens > limit and start < a:  # the overlap gives way
            start += 1
            while start < a and level[start] < 0:
                start += 1
            tokens = count_between(text, start, e, known, enc)
        begin, new, end = int(char[start]), int(char[a]), int(char[e])
        out.append((begin, new, end, tokens, text[begin:end]))
    return out


def split_texts(documents: DataFrame, key: str, text: str, settings: list[tuple[str, int, int]], ranks: bytes) -> DataFrame:
    """Pieces of every text under every (limit_name, limit, overlap); a map, a text is tokenized once for all of them."""
    for _, limit, overlap in settings:
        if overlap > limit // 2:
            raise OverlapError(f"overlap {overlap} with limit {limit}")
    least = min((limit for _, limit, _ in settings), default=0)
    share = documents.sparkSession.sparkContext.broadcast(ranks)
    names = ["limit_name", key, "piece_no", "char_from", "new_from", "char_to", "tokens", "piece"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = share.value
        enc = encoding(table)
        kinds = [pa.string(), pa.int64(), *[pa.int32()] * 5, pa.string()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def groups(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
            group, n = [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                group.append((i, t, ids := enc.encode_ordinary(t)))
                n += len(ids)
                if n >= TOGETHER:
                    yield group
                    group, n = [], 0
            yield group

        def marked(group: list[tuple]) -> Iterator[tuple]:
            known = iter(marks([ids for *_, ids in group if len(ids) > least], table))
            return ((*x, next(known) if len(x[2]) > least else None) for x in group)

        for batch in batches:
            rows, size = [], 0
            for i, t, ids, known in itertools.chain.from_iterable(map(marked, groups(batch))):
                for name, limit, overlap in settings:
                    for no, (a, new, b, n, piece) in enumerate(pieces(t, limit, overlap, table, ids, known)):
                        rows.append((name, i, no + 1, a, new, b, n, piece))
                        size += len(piece)
                if size > 4_000_000:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)

    rows = documents.select(key, text).where(F.col(text).isNotNull() & (F.col(text) != ""))
    return rows.mapInArrow(split, f"limit_name string, `{key}` long, piece_no int, char_from int, new_from int, char_to int, tokens int, piece string")


def p8_pieces(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    settings = limits(spark.read.parquet(f"{sf_dir}/token_limits.parquet"), "split_")
    return split_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", settings, vocabulary(path))
