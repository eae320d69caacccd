import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagecask.llm import mixing as M
from pagecask.llm import packing as P
from pagecask.llm import splitting as S
from pagecask.llm import tokens as K


@pytest.fixture(scope="module")
def ranks():
    try:
        return K.vocabulary()
    except OSError:
        pytest.skip("no tokenizer file")


# --- packing ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 512), max_size=120))
def test_no_container_is_over(sizes):
    where = P.pack(np.array(sizes, int), 512)
    assert len(where) == len(sizes) and (not sizes or np.bincount(where, sizes).max() <= 512)


def test_nearly_equal_loads():
    sizes = np.random.default_rng(0).integers(20, 200, 1000)
    load = np.bincount(P.differencing(sizes, 100), sizes, 100)
    assert load.max() - load.min() <= 5
    where = P.pack(sizes, 2048)
    assert sizes.sum() / (2048 * (where.max() + 1)) > 0.97


def test_pack_documents(spark):
    rows = [(1, 5000, "x"), (2, 300, "x"), (3, 0, "x"), (4, None, "x"), (5, 512, "x"), (5, 512, "x"), (6, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens int, container string").selectExpr("*", "uuid() as _row")
    got = P.pack_documents(df, "doc_id", "tokens", 512).collect()
    assert all(sum(x.tokens for x in got if x.container == c) <= 512 for c in {x.container for x in got})
    assert sum(x.tokens for x in got) == 5000 + 300 + 1024 + 1 and sorted(x.from_token for x in got if x.doc_id == 1) == list(range(0, 5000, 512))
    assert P.pack_documents(df.limit(0), "doc_id", "tokens", 512).collect() == []


def test_fill_query(spark, data, ranks):
    for r in P.p6_fill(spark, data).collect():
        assert r.fill > 0.9 and r.fullest <= (512 if r.limit_name == "pack_short" else 2048)


# --- mixing ---


def test_poisson_inversion():
    for rate, cap in ((0.3, 1), (1.7, 3), (3.0, 4)):
        assert M.capped_mean(M.mean_for(rate, cap), cap) == pytest.approx(rate, abs=1e-6)
    assert M.thresholds(M.mean_for(2, 2), 2) == [0.0, 0.0]


def test_mix(spark):
    rows = [("a", k, 10 + k % 7, k / 997 % 1) for k in range(997)] + [("b", k, 100, k / 50) for k in range(50)]
    texts = spark.createDataFrame(rows, "source string, doc_id long, tokens int, u double")
    got = M.mix(texts, [("a", 0.6, 3), ("b", 0.4, 4), ("none", 0.0, 2)]).collect()
    total = sum(r.tokens for r in got)
    assert sum(r.tokens for r in got if r.source == "a") / total == pytest.approx(0.6, abs=0.01)
    assert max(r.repeat for r in got if r.source == "b") <= 4 and [r.position for r in got] == sorted(r.position for r in got)
    assert M.mix(texts.limit(0), [("a", 1.0, 3)]).collect() == []


def test_copies_share_their_cap(spark, ranks):
    rows = [(k, "the same text", "s", "u") for k in range(50)] + [(100, None, "s", "u"), (101, "", "s", "u"), (102, "other", None, "u"), (103, "alone", "s", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    got = M.distinct_texts(df, ["s"], ranks).collect()
    assert sorted(r.doc_id for r in got) == [0, 103]


def test_shares_query(spark, data, ranks):
    rows = M.p7_shares(spark, data).collect()
    assert sum(r.reached_share for r in rows) == pytest.approx(1, abs=1e-3) and all(r.most_repeats <= r.max_repeats for r in rows)


# --- splitting ---

TEXTS = ["", "short", "One sentence here. Another one there! " * 80, "para one line.\n\npara two line.\r\n\r\n" * 90, "a" * 5000, "слово " * 900, "😀" * 700, "\n" * 3000, " " * 3000, "x" * 50 + "\n" * 700 + "y" * 900, "mixed 😀 τέλος.\tкод{}; " * 200]


def test_an_overlap_above_half_the_limit_is_refused(ranks, spark):
    with pytest.raises(S.OverlapError):
        S.pieces("word " * 200, 16, 9, ranks)
    with pytest.raises(S.OverlapError):
        S.split_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text", [("x", 16, 9)], ranks)


def test_containers_do_not_depend_on_the_layout(spark, ranks):
    rng = random.Random(6)
    rows = [(k % 900, "word " * rng.randrange(1, 90)) for k in range(1000)] + [(1, "same")] * 40 + [(None, "none"), (None, None), (2, "long " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def packed(d):
        counted = P.with_row_names(K.count_tokens(d.withColumn("_text", F.xxhash64("text")), "text", "tokens", ranks))
        return sorted(map(tuple, P.pack_documents(counted, "doc_id", "tokens", 256).collect()), key=repr)

    one = packed(df)
    assert one == packed(df.orderBy(F.desc("text")).repartition(7)) and sum(r[1] == 1 for r in one) == 42
    loads = {}
    for c, _, _, _, n in one:
        loads[c] = loads.get(c, 0) + n
    assert max(loads.values()) <= 256


@pytest.mark.parametrize("limit,overlap", [(64, 8), (256, 32), (32, 16), (17, 8)])
def test_round_trip_and_limit(ranks, limit, overlap):
    enc = K.encoding(ranks)
    for text in TEXTS:
        got = S.pieces(text, limit, overlap, ranks)
        assert "".join(text[new:end] for _, new, end, _, _ in got) == text
        for k, (begin, new, end, n, piece) in enumerate(got):
            assert piece == text[begin:end] and n == len(enc.encode_ordinary(piece)) <= limit and begin <= new < end
            assert k == 0 or len(enc.encode_ordinary(text[begin:new])) <= min(overlap, limit) + 1


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab .\n!é😀я,\t"), max_size=800))
def test_any_text(ranks, text):
    enc = K.encoding(ranks)
    got = S.pieces(text, 24, 4, ranks)
    assert "".join(text[new:end] for _, new, end, _, _ in got) == text and all(n <= 24 and n == len(enc.encode_ordinary(p)) for *_, n, p in got)


def test_pieces_are_not_tokenized_again(ranks, monkeypatch):
    enc, lengths = K.encoding(ranks), []

    class Counted:
        def encode_ordinary(self, text):
            lengths.append(len(text))
            return enc.encode_ordinary(text)

    monkeypatch.setattr(S, "encoding", lambda _: Counted())
    for text in ("One sentence here. Another one there! " * 400, "para one line.\n\npara two line.\r\n\r\n" * 400, "μια πρόταση.\n\nслово и дело " * 400):
        for limit, overlap in ((256, 32), (1024, 96)):
            lengths.clear()
            assert len(S.pieces(text, limit, overlap, ranks)) > 1 and len(text) <= sum(lengths) < 1.1 * len(text)


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab's .\n\r\t\x0c\x85\xa0\u3000!é😀я世1"), min_size=1, max_size=60), st.data())
def test_tokens_between_any_two_places(ranks, text, data):
    enc = K.encoding(ranks)
    ids = np.array(enc.encode_ordinary(text), int)
    known = S.marks([ids], ranks)[0]
    whole = [k for k in range(len(ids)) if known.level[k] >= 0] + [len(ids)]
    start, end = sorted(data.draw(st.lists(st.sampled_from(whole), min_size=2, max_size=2)))
    assert S.count_between(text, start, end, known, enc) == len(enc.encode_ordinary(text[known.char[start] : known.char[end]]))


def test_rolling_hash_is_that_of_the_tokens_before(ranks):
    words = S._token_table(ranks)[-1]
    for n in (1, 5, 12, 13, 60):
        ids = np.random.default_rng(n).integers(0, len(words), n)
        for i, h in enumerate(S.rolling(ids, ranks)):
            want = sum(int(words[ids[i - 1 - k]]) << k for k in range(min(S.WINDOW, i))) * 0x9E3779B97F4A7C15 % 2**64
            assert int(h) == want ^ want >> 32


def test_texts_marked_together_are_marked_as_alone(ranks):
    enc = K.encoding(ranks)
    texts = [enc.encode_ordinary(t) for t in (" starts blank. \n", "\n\nfeeds first", "", "ends with a stop.", " \n", "слово 😀", *TEXTS)]
    for got, ids in zip(S.marks(texts, ranks), texts, strict=True):
        (alone,) = S.marks([ids], ranks)
        assert (got.level == S.boundaries(np.array(ids, int), ranks)).all() and (got.h == S.rolling(np.array(ids, int), ranks)).all()
        assert all((got.places[v] == alone.places[v]).all() for v in got.places) and sum(map(len, got.places.values())) == (got.level >= 0).sum()
        assert got.sure.tolist() == alone.sure.tolist() and got.char.tolist() == alone.char.tolist() and got.char[-1] == len(enc.decode(ids))
    assert S.marks([], ranks) == []


def test_a_limit_below_the_window(ranks):
    text = "one two three four five six seven eight nine ten"
    assert "".join(text[new:end] for _, new, end, _, _ in S.pieces(text, 8, 2, ranks)) == text


def test_natural_boundaries_and_local_edits(ranks):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("ber", "dan", "fel", "gor", "hum")]
    sentence = lambda: " ".join(rng.choice(words, 9)).capitalize() + "."
    text = " ".join(sentence() for _ in range(400))
    before = S.pieces(text, 256, 32, ranks)
    assert all(text[:new].rstrip().endswith(".") for _, new, _, _, _ in before[1:])
    at = text.index(". ", len(text) // 2) + 2
    after = S.pieces(text[:at] + "An inserted sentence of a few words. " + text[at:], 256, 32, ranks)
    same = {p for *_, p in before} & {p for *_, p in after}
    assert len(same) >= len(before) - 6


def test_operator(spark, ranks):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "word " * 2000, "c"), (3, "word " * 2000, "c"), (None, "x", None)], "doc_id long, text string, piece string")
    got = S.split_texts(df, "doc_id", "text", [("s", 100, 10), ("l", 400, 40)], ranks).collect()
    assert {r.doc_id for r in got} == {3, None} and max(r.tokens for r in got if r.limit_name == "s") <= 100
    assert S.split_texts(df.limit(0), "doc_id", "text", [("s", 100, 10)], ranks).collect() == []


def test_count_tokens(spark, ranks):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "<|endoftext|>", 9)], "i long, text string, tokens int")
    got = {r.i: r.tokens for r in K.count_tokens(df, "text", "tokens", ranks).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] > 1


def test_query(spark, data, ranks):
    limit = {n: m for n, m, _ in K.limits(spark.read.parquet(f"{data}/token_limits.parquet"), "split_")}
    assert all(r.m <= limit[r.limit_name] for r in S.p8_pieces(spark, data).groupBy("limit_name").agg({"tokens": "max"}).toDF("limit_name", "m").collect())
