"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of the tokenizer, read on the driver only; its bytes travel with the tasks.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level tokenizers split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("parameter", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@functools.lru_cache(2)
def token_bytes(ranks: bytes) -> list[bytes]:
    """The bytes of each token id; ids without a token are empty."""
    pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, ranks.splitlines())]
    out = [b""] * (max(i for i, _ in pairs) + 1)
    for i, raw in pairs:
        out[i] = raw
    return out


def count_tokens(df: DataFrame, text: str, out: str, ranks: bytes) -> DataFrame:
    """Adds the number of tokens of ``text`` to the other columns, in place of the text; null texts have 0."""
    keep = [c for c in df.columns if c not in (text, out)]
    share = df.sparkSession.sparkContext.broadcast(ranks)  # one file of fixed size
    at = len(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(share.value)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(np.array(n, np.int32))], [*keep, out])

    rows = df.select(*keep, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep), f"`{out}` int"])
    return rows.mapInArrow(count, schema)


def limits(token_limits: DataFrame, prefix: str) -> list[tuple[str, int, int]]:
    """(name, max_tokens, overlap_tokens) of the settings whose name starts with ``prefix``; a table of settings, four rows."""
    rows = token_limits.where(F.col("limit_name").startswith(prefix)).where("max_tokens > 0").orderBy("limit_name").collect()
    return [(r.limit_name, r.max_tokens, r.overlap_tokens or 0) for r in rows]
