"""Filling containers of a fixed number of tokens (problem 6).

Multiway differencing (Karmarkar-Karp): every item starts as a partition of its
own over k containers; the two partitions with the largest imbalance are merged
again and again, the fullest containers of one with the emptiest of the other.
The sums come out nearly equal, so with k containers of total size just under
k times the capacity all are nearly full; k rises until none is over.

Items are dealt to buckets of about BUCKET_ITEMS by a hash of their key, text
and, among repeated rows, ordinal, so a bucket's size does not grow with the
data, no key can be hot, and the containers do not depend on how the files are
laid out; each bucket leaves at most a few containers partly empty.

Defined results
    an item above the capacity is cut: its whole multiples fill containers
    alone, the rest is an item like others; no other item is cut; texts that
    are null or empty have no tokens and are in no container; repeated rows
    are items of their own.
"""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecask.llm.tokens import VOCABULARY, count_tokens, limits, vocabulary
from pagecask.sources.scratch import written

BUCKET_ITEMS = 1024


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Container (0..k-1) of each item, by multiway differencing over k containers."""
    n = len(sizes)
    follow = np.full(n, -1)  # items of one container are a chain
    # a partition: loads above its emptiest container, largest first, and the head and tail of each container's chain
    heap = []
    one = np.zeros(1, int)
    for i in range(n):
        heap.append((-int(sizes[i]), i, np.array([sizes[i]]), one + i, one + i))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, la, ha, ta = heapq.heappop(heap)
        _, _, lb, hb, tb = heapq.heappop(heap)
        both = len(la) + len(lb) - k
        if both <= 0:
            load, head, tail = np.concatenate([la, lb]), np.concatenate([ha, hb]), np.concatenate([ta, tb])
        else:  # the emptiest of each meet the fullest of the other
            meet_a, meet_b = slice(len(la) - both, None), slice(len(lb) - both, None)
            xa, xb = la[meet_a], lb[meet_b][::-1]
            follow[ta[meet_a]] = hb[meet_b][::-1]
            load = np.concatenate([la[: len(la) - both], xa + xb, lb[: len(lb) - both]])
            head = np.concatenate([ha[: len(la) - both], ha[meet_a], hb[: len(lb) - both]])
            tail = np.concatenate([ta[: len(la) - both], tb[meet_b][::-1], tb[: len(lb) - both]])
        order = np.argsort(-load, kind="stable")
        load, head, tail = load[order], head[order], tail[order]
        if len(load) == k and load[-1] > 0:
            load = load - load[-1]
        serial += 1
        heapq.heappush(heap, (-int(load[0]), serial, load, head, tail))
    out = np.zeros(n, int)
    if heap:
        for c, i in enumerate(heap[0][3]):
            while i >= 0:
                out[i] = c
                i = follow[i]
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, none over the capacity; sizes are between 1 and the capacity."""
    if not len(sizes):
        return np.zeros(0, int)
    fails = max(1, -(-int(sizes.sum()) // capacity)) - 1  # so few cannot do
    step, best, fits = 1, None, 0
    while best is None:  # the count rises, in growing steps, while a container is over ...
        k = fails + step
        where = differencing(sizes, k)
        if np.bincount(where, sizes, k).max() <= capacity:
            best, fits = where, k
        else:
            fails, step = k, 2 * step
    while fits - fails > 1:  # ... and then the smallest that does is looked for
        k = (fits + fails) // 2
        where = differencing(sizes, k)
        if np.bincount(where, sizes, k).max() <= capacity:
            best, fits = where, k
        else:
            fails = k
    return best


def pack_documents(documents: DataFrame, key: str, tokens: str, capacity: int) -> DataFrame:
    """(container, key, part, from_token, tokens): ``documents`` has key, ``_row``, a name of the row that no other has, and the tokens of each."""
    n = F.col(tokens).cast("long")
    full, rest = F.floor(n / capacity), n % capacity
    items = documents.where(n > 0).select("_row", F.col(key), full.alias("_full"), rest.alias("_rest"))
    alone = items.where("_full > 0").select(
        F.col("_row"), key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_full"))).alias("part")
    ).select(
        F.concat_ws("-", F.lit("f"), "_row", "part").alias("container"), key, F.col("part").cast("int").alias("part"),
        ((F.col("part") - 1) * capacity).cast("int").alias("from_token"), F.lit(capacity).alias("tokens"),
    )
    small = items.where("_rest > 0").withColumn("_bucket", F.xxhash64("_row"))
    buckets = max(1, round(small.count() / BUCKET_ITEMS))
    small = small.select(F.pmod("_bucket", F.lit(buckets)).alias("_bucket"), "_row", key, "_full", "_rest")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row", ignore_index=True)
        where = pack(group["_rest"].to_numpy(), capacity)
        return pd.DataFrame(
            {
                "container": [f"b-{b}-{c}" for b, c in zip(group["_bucket"], where, strict=True)],
                key: group[key],
                "part": (group["_full"] + 1).astype("int32"),
                "from_token": (group["_full"] * capacity).astype("int32"),
                "tokens": group["_rest"].astype("int32"),
            }
        )

    kind = dict(documents.dtypes)[key]
    schema = f"container string, `{key}` {kind}, part int, from_token int, tokens int"
    return alone.unionByName(small.groupBy("_bucket").applyInPandas(fill, schema))


def counted_documents(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(documents.withColumn("_text", F.xxhash64("text")), "text", "tokens", vocabulary(path))
    return written(with_row_names(counted), "token-counts")


def with_row_names(counted: DataFrame) -> DataFrame:
    """(doc_id, tokens, _row): repeated rows (doc_id, _text, tokens) are counted map-side and numbered, without a window over a key."""
    each = counted.groupBy("doc_id", "_text", "tokens").agg(F.count("*").alias("_n"))
    numbered = each.withColumn("_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    name = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("_text"), F.col("_no").cast("string"))
    return numbered.select("doc_id", "tokens", name.alias("_row"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """limit_name, container, doc_id, part, from_token, tokens for every ``pack_`` limit."""
    counted = counted_documents(spark, sf_dir)
    out = None
    for name, capacity, _ in limits(spark.read.parquet(f"{sf_dir}/token_limits.parquet"), "pack_"):
        packed = pack_documents(counted, "doc_id", "tokens", capacity).select(F.lit(name).alias("limit_name"), "*")
        out = packed if out is None else out.unionByName(packed)
    if out is None:
        return spark.createDataFrame([], "limit_name string, container string, doc_id long, part int, from_token int, tokens int")
    return out


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each limit are."""
    limit = spark.read.parquet(f"{sf_dir}/token_limits.parquet").select("limit_name", "max_tokens")
    loads = p6_packed(spark, sf_dir).groupBy("limit_name", "container").agg(F.sum("tokens").alias("load"))
    return (
        loads.groupBy("limit_name")
        .agg(F.count("*").alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("fullest"))
        .join(F.broadcast(limit), "limit_name")
        .select("limit_name", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 6).alias("fill"))
    )
