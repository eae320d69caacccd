from pagecask.operators import evaluation as E
from pagecask.operators.index import page_index, snippet_index
from pagecask.sources.synthetic import corpus

NOW = 1_791_028_800_000


def test_seven_kinds_of_queries(spark):
    pages, contents = (t.cache() for t in corpus(spark, 300, NOW))
    assert 30 < pages.where("lang = 'el'").count() < 90
    snippets = spark.createDataFrame([], "id long, url string, domain string, page_title string, text string, fragment string, truncated boolean, created_at long")
    queries = E.labelled_queries(pages, contents, 1)
    assert [q.kind for q in queries] == list(E.KINDS) and E.labelled_queries(pages, contents, 1) == queries
    got = {r.kind: r for r in E.evaluate(pages, contents, snippets, queries, NOW, page_index(pages, contents), snippet_index(snippets)).collect()}
    assert set(got) == {*E.KINDS, "total"} and got["total"].n == len(queries)
    assert got["title"].hit1 == 1 and got["phrase"].hit5 == 1 and got["greek"].hit5 == 1
    assert got["typo"].hit5 == 0 and 0 <= got["total"].suggestion_rate <= 1
