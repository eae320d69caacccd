import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagecask.functions import display as D
from pagecask.functions import text as X
from pagecask.functions import urls as U

URLS = {
    "HTTPS://Www.Example.COM/Path?utm_source=x&b=1#top": "https://www.example.com/Path?b=1",
    "http://a.com": "http://a.com/",
    "http://a.com?": "http://a.com/",
    "http://a.com?x=1": "http://a.com/?x=1",
    "http://a.com:80/x": "http://a.com/x",
    "https://a.com:8443/x/../y/./z": "https://a.com:8443/y/z",
    "https://u:p@a.com/": "https://a.com/",
    "https://a.com/?gclid=1": "https://a.com/",
    "https://a.com/?a=1&fbclid=2&b=3": "https://a.com/?a=1&b=3",
    "  https://a.com/x y  ": "https://a.com/x%20y",
    "https://a.com/?q=a b&utm_medium=m": "https://a.com/?q=a+b",
    "https://bücher.example/": "https://xn--bcher-kva.example/",
    "ftp://a.com/": None,
    "chrome://settings": None,
    "javascript:alert(1)": None,
    "https://": None,
    "https://a b/": None,
    "": None,
    "x" * 5000: None,
}


@pytest.mark.parametrize("raw", URLS)
def test_normalize(raw):
    assert U.normalize_url(raw) == URLS[raw]


def test_normalized_column_agrees(spark):
    raw = [*URLS, None, "https://a.example/p/1?ref=feed#s3", "https://m.a_b.example/?ID=1&T=2&mc_eid=9", "https://a.example/?utm_x=1&&b", "http://1.2.3.4/", "http://a.com/%7Eb/..", "https://a.com/?b=1&"]
    df = spark.createDataFrame([(r,) for r in raw], "u string")
    for r in df.select("u", U.normalized_url(F.col("u")).alias("n")).collect():
        assert r.n == U.normalize_url(r.u), r.u


def test_capture_reason(spark):
    cases = {
        "https://a.example/x": None, "https://u@a.example/": "ineligible", "http://10.0.0.1/": "ineligible", "http://[::1]/": "ineligible", "http://router/": "ineligible",
        "http://nas.local/": "ineligible", "file:///x": "ineligible", "https://www.bad.example/": "excluded", "https://sub.bad.example/": "excluded", "https://notbad.example/": None, None: "ineligible",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: r.reason for r in df.select("u", U.capture_reason(F.col("u"), ["bad.example"]).alias("reason")).collect()}
    assert got == cases


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_fold_column_agrees(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    texts = ["".join(c for c in t if ord(c) < 0x2000 and c != "\x00") for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.fold(F.col("t")).alias("f")).collect():
        same = X.fold_text(r.t)
        assert r.f == same or not r.t.isascii()  # tables of Python and the JVM may differ in age outside ASCII


def test_padded_and_hits(spark):
    df = spark.createDataFrame([("A b, a b! Ab",), (None,), ("",)], "t string").select(X.padded(F.col("t")).alias("p"))
    rows = df.select("p", X.phrase_hits(F.col("p"), ["a", "b"]).alias("n"), X.phrase_hits(F.col("p"), ["a"], True).alias("m"), X.phrase_hits(F.col("p"), ["b", "a"]).alias("k")).collect()
    assert rows[0].p == " a  b  a  b  ab " and (rows[0].n, rows[0].m, rows[0].k) == (2, 3, 1)
    assert [r.p for r in rows[1:]] == ["  ", "  "] and not rows[1].n
    assert [r.n for r in df.select(X.token_count(F.col("p")).alias("n")).collect()] == [5, 0, 0]
    again = spark.sql("select 'a a a b a a' as t").select(X.phrase_hits(X.padded(F.col("t")), ["a", "a"]).alias("n"), X.phrase_hits(X.padded(F.col("t")), ["a", "a"], True).alias("m")).first()
    assert tuple(again) == (3, 3)


def test_half_up_and_bytes(spark):
    df = spark.createDataFrame([(2.5, "é", None), (-2.5, "", "a")], "x double, a string, b string")
    rows = df.select(X.half_up(F.col("x")).alias("r"), X.text_bytes(F.col("a"), F.col("b")).alias("n")).collect()
    assert [(r.r, r.n) for r in rows] == [(3, 2), (-2, 1)]


def test_display(spark):
    df = spark.createDataFrame([("https://www.a.com/x%20y?q=1#z",), ("https://a.com/",), ("nonsense",)], "u string")
    assert [tuple(r.d) for r in df.select(D.display_url(F.col("u")).alias("d")).collect()] == [("a.com", "/x y?q=1"), ("a.com", ""), ("nonsense", "")]
    one = spark.range(1).select(D.text_fragment(F.lit("it's - a\n test")).alias("f"), D.text_fragment(F.lit("  ")).alias("n"), D.text_fragment(F.lit("word " * 100)).alias("l")).first()
    assert one.f == "#:~:text=it%27s%20%2D%20a%20test" and one.n is None and one.l.count(",") == 1
