import numpy as np
import pytest

from pagecask.llm import byte_cnn as C
from pagecask.llm import language as L


@pytest.fixture(scope="module")
def split(spark, data):
    sample = L.labelled_sample(spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet"))
    assert 0 < len(sample) <= L.SAMPLE_DOCUMENTS
    return sample[::2], sample[1::2]


@pytest.fixture(scope="module")
def model(split):
    return L.fit(split[0])


def languages(model, texts):
    s = L.segments_of(model, texts)
    words = np.zeros((len(texts), len(L.LANGUAGES) + 1), int)
    np.add.at(words, (s["text"], s["lang"]), s["words"])
    return words[:, :-1]


def test_held_out_accuracy(model, split):
    texts = [t for t, _ in split[1]]
    words = languages(model, texts)
    right = [L.LANGUAGES[w.argmax()] == lang for w, (_, lang) in zip(words, split[1], strict=True) if w.sum()]
    assert np.mean(right) > 0.93  # some of the labels themselves are wrong


def test_gradients():
    rng = np.random.default_rng(0)
    windows = [bytes(rng.choice([97, 98] if k % 2 else [120, 121], 40).tolist()) for k in range(200)]
    m = C.train(windows, np.arange(200) % 2, ["x", "a"], epochs=4)
    blocks = np.concatenate([C.cut(w)[:1] for w in windows])
    assert (m.log_probs(m.block_features(blocks)).argmax(1) == np.arange(200) % 2).mean() > 0.98
    assert not (m.filters * (1 - C.filter_mask())).any()


def test_mixed_text_and_lines(model):
    en = "The old bridge crosses the river and the people walk over it in the morning. "
    ru = "Старый мост соединяет берега реки, и люди ходят по нему каждое утро. "
    s = L.segments_of(model, [en * 3 + "\n" + ru * 3 + "\n" + en * 2, "", "123 456", ru + en])
    own = s["text"] == 0
    assert [L.LANGUAGES[k] for k in s["lang"][own]] == ["en", "ru", "en"] and s["line_from"][own].tolist() == [1, 2, 3]
    assert s["words"][own].tolist() == [45, 36, 30]
    assert [L.LANGUAGES[k] for k in s["lang"][s["text"] == 3]] == ["ru", "en"]


def test_word_counts():
    import re

    text = "Ein Satz, mit «Wörtern» — und 12 Zahlen… “so”·viel ελληνικά слова"
    raw = np.frombuffer(text.encode(), np.uint8)
    assert L.word_starts(raw).sum() == len(re.findall(r"[^\W_]+", text))


def test_operator(spark, model):
    schema = "page_id long, body string, lang string, words string"
    rows = [(1, "The old bridge crosses the river and the people walk over it in the morning. " * 5, "de", "clash"), (2, None, None, None), (3, "", None, None), (None, "Der alte Fluss und die neue Brücke sind hier nicht zu sehen. " * 3, None, None)]
    df = spark.createDataFrame(rows + rows[:1], schema)
    got = sorted(((r.page_id, r.segment, r.lang, r.words, round(r.confidence) if r.confidence else 0) for r in L.language_segments(df, model, "page_id", "body").collect()), key=repr)
    assert got == sorted([(1, 1, "en", 75, 1)] * 2 + [(None, 1, "de", 36, 1)], key=repr)
    assert L.language_segments(df.limit(0), model, "page_id", "body").collect() == []
    assert L.segments_of(model, ["wort " * 100_000])["words"].sum() == 100_000


def test_filler_has_no_language(spark, model):
    rng = np.random.default_rng(3)
    filler = " ".join(rng.choice("lorem ipsum dolor veniam nostrud aliquip exercitation commodo eiusmod labore".split(), 90))
    df = spark.createDataFrame([(1, filler), (2, "The old bridge crosses the river and the people walk over it in the morning. " * 4)], "k long, body string")
    got = L.document_languages(L.language_segments(df, model, "k", "body"), "k").collect()
    assert [(r.k, r.lang, r.words, r.share) for r in got if r.k == 2] == [(2, "en", 60, 1.0)]


def test_stated_language(spark):
    labels = {"en": "en", "EN": "en", "en-US": "en", "en_EN": "en", "pt-BR": "pt", "": None, "??": None, "und": None, "unknown": None, None: None, "null": None, "xx": "xx", "en-": None}
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert {r.l: r.s for r in df.select("l", L.stated_language(df.l).alias("s")).collect()} == labels


def test_query(spark, data):
    assert L.p1_found(spark, data).columns == ["page_id", "lang"]
