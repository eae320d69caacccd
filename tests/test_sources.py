import json

import pytest

from pyspark.sql import functions as F

from pagecask.operators import archive, index
from pagecask.operators.archive import Archive
from pagecask.sources import snapshot
from pagecask.sources.html import extract, extract_pages
from pagecask.sources.synthetic import corpus

NOW = 1_791_028_800_000
QUOTE = "id long, url string, domain string, page_title string, text string, fragment string, truncated boolean, created_at long"
PAGE = """<html lang="el"><head><title> A  title </title><meta property="og:description" content="Said"></head><body><header>Top</header><nav>Menu</nav>
<main><h1>One</h1><p>First</p><p hidden>no</p><div style="display: none">no <b>deep</b></div><script>var x</script><h2>Two <i>three</i></h2>text<br>more<form><input type=text></form></main><footer>F</footer></body></html>"""


def test_extract():
    got = extract(PAGE, least=0)
    assert got == {"reason": None, "title": "A title", "description": "Said", "headings": "One · Two three", "body": "One First Two three text more", "lang": "el", "truncated": False}


def test_elements_that_end_without_an_end_tag():
    body = lambda html: extract(html, least=0)["body"]
    assert body("<p hidden>secret<p>visible text") == "visible text"
    assert body("<ul><li hidden>no<li>yes<ul><li hidden>no<li>inner</ul><li>last</ul>after") == "yes inner last after"
    assert body("<table><tr><td hidden>no<td>yes<tr hidden><td>no<tr><td>more</table>") == "yes more"
    assert body("<dl><dt hidden>no<dd>yes<dt>term</dl>") == "yes term"
    assert body("<p hidden>no<div>yes</div>") == "yes" and body("<div hidden><p>no<p>no</div>yes") == "yes"
    assert body("<p hidden><table><tr><td><p>cell</table>") == "cell"
    assert body("<head><title>t</title><body>yes") == "yes"


def test_reasons():
    assert extract(None)["reason"] == "too-little-text" and extract("<p>a", content_type="application/pdf")["reason"] == "not-html"
    assert extract('<input type="password"><p>x')["reason"] == "password-field" and extract('<input autocomplete="cc-number">')["reason"] == "payment-field"
    assert extract('<input type="password"><p>x', deep=False, least=0)["body"] == "x"


def test_long_and_repeated():
    got = extract("<body>" + "spam " * 9 + "end " + "w " * 0 + "".join(f"t{k} " for k in range(20_000)), least=0)
    assert got["truncated"] and len(got["body"]) == 50_000 and got["body"].startswith("spam end t0")
    assert extract("<div><p>unclosed <b>x</div> tail", least=0)["body"] == "unclosed x tail"


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, PAGE * 1, "k"), (2, None, None)], "id long, html string, other string")
    rows = {r.id: r for r in extract_pages(df, deep=False).collect()}
    assert rows[1].reason == "too-little-text" and rows[1].other == "k" and rows[2].reason == "too-little-text"


def small_archive(spark, n=50):
    pages, contents = corpus(spark, n, NOW)
    return Archive(pages, contents, spark.createDataFrame([(1, "https://a.example/", "a.example", "Title", "a quote", None, False, NOW)], QUOTE))


def test_snapshot(spark, tmp_path):
    root = str(tmp_path / "s")
    assert snapshot.read_snapshot(spark, root) is None
    assert [snapshot.write_snapshot(small_archive(spark), root, extra={"k": n}) for n in range(3)] == [1, 2, 3]
    assert snapshot.read_snapshot(spark, root).pages.count() == 50 and snapshot.read_manifest(spark, root)["extra"] == {"k": 2}
    assert snapshot.drop_old_versions(spark, root) == ["v1"] and not (tmp_path / "s" / "pages" / "v1").exists()
    (tmp_path / "s" / "manifest-9.json").write_text(json.dumps({"format": 99, "version": 9, "extra": {}}))
    with pytest.raises(snapshot.TooNewError):
        snapshot.read_manifest(spark, root)


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_writer_that_stops_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    snapshot.write_snapshot(small_archive(spark), root)
    before = files(tmp_path / "s")

    def stops(*_):
        raise RuntimeError("power cut")

    monkeypatch.setattr(snapshot, "_publish", stops)
    with pytest.raises(RuntimeError):
        snapshot.write_snapshot(small_archive(spark, 7), root)
    monkeypatch.undo()
    assert snapshot.read_manifest(spark, root)["version"] == 1 and snapshot.read_snapshot(spark, root).pages.count() == 50
    assert {k: v for k, v in files(tmp_path / "s").items() if k in before} == before
    assert snapshot.write_snapshot(small_archive(spark, 7), root) == 2 and snapshot.read_snapshot(spark, root).pages.count() == 7


def test_one_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    snapshot.write_snapshot(small_archive(spark), root)
    base = snapshot.open_snapshot(spark, root)
    snapshot.write_manifest(spark, root, base.manifest)  # another one was first
    with pytest.raises(snapshot.ConflictError):
        snapshot.write_snapshot(base.archive, root, base=base)
    (tmp_path / "s" / "claim-3").touch()  # a writer at work, or dead
    with pytest.raises(snapshot.ConflictError):
        snapshot.write_manifest(spark, root, snapshot.read_manifest(spark, root))
    monkeypatch.setattr(snapshot, "CLAIM_MS", 0)
    snapshot.write_manifest(spark, root, snapshot.read_manifest(spark, root))
    assert snapshot.read_manifest(spark, root)["version"] == 3


def test_a_visit_touches_its_part_only_and_the_index_follows(spark, tmp_path):
    root = str(tmp_path / "s")
    snapshot.write_snapshot(small_archive(spark), root)
    before = files(tmp_path / "s")
    url = snapshot.read_snapshot(spark, root).pages.orderBy("id").first().url
    batch = spark.createDataFrame([(url, "Entirely new words", float(NOW), 3, 0, 1)], "url string, title string, last_visit_time double, visit_count long, typed_count long, seq long")
    base = snapshot.open_for(spark, root, batch.select("url"))
    state, _ = archive.upsert_history(base.archive, batch, F.col("seq"))
    snapshot.write_snapshot(state, root, base=base)
    fresh = {k for k in files(tmp_path / "s") if k not in before}
    assert not [k for k in fresh if k.startswith(("contents", "snippets", "index/snippets"))]
    assert len({k.split("/")[2] for k in fresh if k.startswith("pages")}) == 1
    opened = snapshot.open_snapshot(spark, root)
    same_index(spark, opened)
    assert len(opened.manifest["index"]["pages"]) == 2 and [r.id for r in index.matching_ids(snapshot.read_index(spark, opened.manifest, "pages"), [(["entirely", "new"], False)], True).collect()] == [0]
    assert snapshot.merge_indexes(spark, root, at=2) == ["pages"]
    same_index(spark, snapshot.open_snapshot(spark, root))
    assert snapshot.compact(spark, root, most_files=0, parts=2)["pages"] and snapshot.read_snapshot(spark, root).pages.count() == 50


def same_index(spark, opened):
    """The kept index is the one that would be built now."""
    kept, a = snapshot.read_index(spark, opened.manifest, "pages"), opened.archive
    built = index.page_index(a.pages, a.contents)
    assert (kept.rows, kept.total) == (built.rows, built.total)
    for name in ("postings", "docs", "vocabulary"):
        x, y = (sorted(map(tuple, getattr(i, name).collect()), key=repr) for i in (kept, built))
        assert x == y, name


def test_index_after_texts_and_removals(spark, tmp_path):
    root = str(tmp_path / "s")
    snapshot.write_snapshot(small_archive(spark, 30), root)
    base = snapshot.open_snapshot(spark, root)
    rows = [(r.url, "Changed", "", "", f"text number {k}", "en", f"h{k}", float(NOW)) for k, r in enumerate(base.archive.pages.orderBy("id").limit(5).collect())] + [("https://new.example/", None, None, None, None, None, None, float(NOW))]
    batch = spark.createDataFrame(rows, "url string, title string, headings string, description string, body string, lang string, content_hash string, at double")
    opened = snapshot.open_for(spark, root, batch.select("url"), contents=True)
    snapshot.write_snapshot(archive.upsert_content(opened.archive, batch)[0], root, base=opened)
    same_index(spark, snapshot.open_snapshot(spark, root))
    base = snapshot.open_snapshot(spark, root)
    state, _ = archive.delete_range(base.archive, 0, NOW - 30 * 86_400_000)
    snapshot.write_snapshot(state, root, base=base)
    opened = snapshot.open_snapshot(spark, root)
    assert opened.archive.pages.count() < 31 and opened.archive.contents.count() < 31
    same_index(spark, opened)
    state, _ = archive.delete_everything(opened.archive)
    snapshot.write_snapshot(state, root, base=opened)
    same_index(spark, snapshot.open_snapshot(spark, root))


def test_corpus_is_the_same_each_time(spark):
    a, b = (sorted(map(tuple, corpus(spark, 40, NOW)[1].repartition(n).collect())) for n in (1, 3))
    assert a == b and len({r[3] for r in a}) > 30
