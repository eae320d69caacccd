"""The registered queries over the archive's tables and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecask.functions import display as D
from pagecask.functions import text as X
from pagecask.functions import urls as U
from pagecask.operators import archive as A
from pagecask.operators import index as I
from pagecask.operators import reports as R
from pagecask.operators import search as S
from pagecask.operators.ordered import in_ranges, running_total
from pagecask.operators.snippets import excerpts, highlight_spans
from pagecask.plans.query import parse_query
from pagecask.sources.html import extract_pages
from pagecask.sources import snapshot
from pagecask.sources.scratch import scratch_path, shared_folder, written

#: The moment all queries are asked at, and the user's minutes east of UTC.
NOW, TZ = 1_791_028_800_000, 180
DAY = A.DAY_MS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive(spark: SparkSession, sf_dir: str) -> A.Archive:
    return A.Archive(*(table(spark, sf_dir, t) for t in ("pages", "contents", "snippets")))


# --- SQL fragments -------------------------------------------------------------

_FOLD = "replace(lower(strip_accents(coalesce({0}, ''))), 'ς', 'σ')"
_TOKENS = f"regexp_extract_all({_FOLD}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def _pad(c: str) -> str:
    t = _TOKENS.format(c)
    return f"(case when len({t}) > 0 then ' ' || array_to_string({t}, '  ') || ' ' else '' end)"


def _hits(c: str, phrase: str, prefix: bool = False) -> str:
    return f"len(regexp_extract_all({c}, ' {phrase}{'' if prefix else ' '}'))"


_PAGE_INDEX = f"""page_index as (
  select p.id, {_pad('p.title')} as title, {_pad('c.headings')} as headings, {_pad('c.description')} as description, {_pad('c.body')} as body
  from pages p left join contents c on c.page_id = p.id)"""
_LENGTH = " + ".join(f"len(string_split(trim({c}), '  ')) - (case when {c} = '' then 1 else 0 end)" for c in ("title", "headings", "description", "body"))
_SITE = "(domain = '{0}' or domain like '%.{0}')"
_NORM = rf"""
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''),
    '(?i)([?&]){U.TRACKING}=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?'), '[?&]+$', '')"""


def _sql_wtf(phrase: str, prefix: bool = False) -> str:
    return " + ".join(f"{w} * {_hits(c, phrase, prefix)}" for c, w in I.PAGE_WEIGHTS.items())


def _sql_bm25(phrases: list[tuple[str, bool]], every: bool = True) -> str:
    names = [f"w{k}" for k in range(len(phrases))]
    cols = ", ".join(f"{_sql_wtf(p, x)} as {n}" for n, (p, x) in zip(names, phrases, strict=True))
    dfs = ", ".join(f"count(*) filter (where {n} > 0) as df_{n}" for n in names)
    part = " + ".join(
        f"greatest(ln((n_rows - df_{n} + 0.5) / (df_{n} + 0.5)), 1e-6) * {n} * 2.2 / ({n} + 1.2 * (0.25 + 0.75 * length / mean))" for n in names
    )
    glue = " and " if every else " or "
    return f"""{_PAGE_INDEX},
hits as (select id, {_LENGTH} as length, {cols} from page_index),
stats as (select count(*) as n_rows, avg(length) as mean, {dfs} from hits),
found as (select id, {part} as strength from hits, stats where {glue.join(f'{n} > 0' for n in names)})"""


# --- text and matching -----------------------------------------------------------


@_query(f"select term, count(*) as doc, sum(n) as cnt from (select term, doc_id, count(*) as n from (select doc_id, unnest({_TOKENS.format('text')}) as term from documents) group by 1, 2) group by 1")
def vocab_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every folded token of the documents."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(X.fold(F.col("text")))).alias("term"))
    return own.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("doc"), F.sum("n").alias("cnt"))


@_query(f"select id, {_FOLD.format('title')} as folded, len({_TOKENS.format('title')}) as n_tokens from pages")
def fold_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = X.fold(F.coalesce("title", F.lit("")))
    return table(spark, sf_dir, "pages").select("id", folded.alias("folded"), F.size(X.tokens(folded)).cast("long").alias("n_tokens"))


_KEPT: dict[tuple[str, str], tuple[I.Index, I.Index]] = {}


def build_indexes(spark: SparkSession, sf_dir: str) -> tuple[I.Index, I.Index]:
    """Indexes of the pages and of the quotes of an archive."""
    a = archive(spark, sf_dir)
    return I.page_index(a.pages, a.contents), I.snippet_index(a.snippets)


def kept_indexes(spark: SparkSession, sf_dir: str) -> tuple[I.Index, I.Index]:
    """The same, written once a session in the shared folder and read by every query after."""
    key = (spark.sparkContext.applicationId + shared_folder(spark), sf_dir)
    if key not in _KEPT:
        _KEPT[key] = build_indexes(spark, sf_dir)
    return _KEPT[key]


def _index(spark: SparkSession, sf_dir: str) -> I.Index:
    return kept_indexes(spark, sf_dir)[0]


def _matching(spark: SparkSession, sf_dir: str, phrases: I.Phrases, every: bool) -> DataFrame:
    return I.matching_ids(_index(spark, sf_dir), phrases, every)


_W = lambda p, x=False: f"({_sql_wtf(p, x)}) > 0"


@_query(f"with {_PAGE_INDEX} select id from page_index where {_W('lantern')} and {_W('library')}")
def match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word in some field, not the same one for all."""
    return _matching(spark, sf_dir, [(["lantern"], False), (["library"], False)], True)


@_query(f"with {_PAGE_INDEX} select id from page_index where {_W('lantern')} or {_W('βιβλιοθηκη')}")
def match_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, S.any_words(parse_query("lantern βιβλιοθήκη of", NOW)), False)


@_query(f"with {_PAGE_INDEX} select id from page_index where {_W('bibli', True)}")
def match_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, S.all_phrases(parse_query("bibli", NOW)), True)


@_query(f"with {_PAGE_INDEX} select id from page_index where {_W('the  wooden  bridge')}")
def match_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir, S.all_phrases(parse_query('"The wooden bridge"', NOW)), True)


@_query(f"with {_PAGE_INDEX} select id from page_index where {_W('museum')} and not ({_W('bridge')} or {_W('old  town')})")
def exclude_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, index = parse_query('"museum" -bridge -"old town"', NOW), _index(spark, sf_dir)
    return I.matching_ids(index, S.all_phrases(q), True).join(S.excluded_ids(index, q), "id", "left_anti")


@_query(f"select id from pages where contains({_FOLD.format('title')}, 'distant lant') or contains({_FOLD.format('url')}, 'distant lant') order by last_visit desc, id limit 20")
def trigram_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest twenty pages with a part of a title or address."""
    return S.substring_candidates(table(spark, sf_dir, "pages"), _index(spark, sf_dir), parse_query("distant lant", NOW)).select("id")


@_query(f"with {_sql_bm25([('lantern', False), ('library', True)])} select f.id, round(strength, 6) as strength from found f join pages p using (id) order by f.strength desc, last_visit desc, f.id limit 200")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 best pages for ``lantern library*`` by weighted BM25."""
    q = parse_query("lantern library", NOW)
    index = _index(spark, sf_dir)
    found = S.page_candidates(table(spark, sf_dir, "pages"), index, q, matches=S.bm25_matches(index, S.all_phrases(q), True))
    return found.select("id", F.round("strength", 6).alias("strength"))


_HAY = f"list_concat({_TOKENS.format('title')}, regexp_extract_all(lower(url), '[\\p{{L}}\\p{{N}}]+'))"


@_query(f"""with {_sql_bm25([('lantern', False), ('library', True)])},
cand as (select p.*, strength from found f join pages p using (id) where {_SITE.format('katrefaforum.example')} is not null and last_visit >= {NOW - 365 * DAY} order by strength desc, last_visit desc, id limit 200),
feat as (select *, strength / max(strength) over () as norm,
  len([x for x in {_HAY} if starts_with(x, 'lantern')]) > 0 as h1, len([x for x in {_HAY} if starts_with(x, 'library')]) > 0 as h2 from cand)
select id, round(norm + 0.35 * (case when h1 and h2 then 1 when h1 or h2 then 0.5 else 0 end) + 0.25 * exp(-greatest(0, {NOW} - last_visit) / ({DAY} * 45.0))
  + 0.08 * ln(1 + greatest(0, visit_count)) + (case when flags & 4 != 0 then 0.2 else 0 end), 6) as score from feat""")
def rank_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the best 200 pages of a year, without the adjacency bonus."""
    q = parse_query("lantern library when:year", NOW)
    index = _index(spark, sf_dir)
    found = S.page_candidates(table(spark, sf_dir, "pages"), index, q, matches=S.bm25_matches(index, S.all_phrases(q), True))
    hit = S.title_url_hit(q.terms, X.fold(F.coalesce("title", F.lit(""))), F.lower("url"))
    score = S.base_score(S.strength_norm(F.col("strength")), hit, F.col("last_visit"), F.col("visit_count"), S.has_flag(F.col("flags"), S.SAVED), NOW)
    return found.select("id", F.round(score, 6).alias("score"))


def _results(df: DataFrame) -> DataFrame:
    return df.select("kind", "id", "url", "source", F.round("score", 6).alias("score"), "approximate", "match_kind")


def _excerpts(df: DataFrame) -> DataFrame:
    return df.select("kind", "id", "url", "source", F.round("score", 6).alias("score"), "approximate", "match_kind", F.col("snippet.text").alias("excerpt"), F.size("snippet.highlights").alias("n_highlights"))


def run_search(spark: SparkSession, sf_dir: str, line: str, limit: int = 50) -> DataFrame:
    a = archive(spark, sf_dir)
    pages, snippets = kept_indexes(spark, sf_dir)
    return S.search(a.pages, a.contents, a.snippets, parse_query(line, NOW, TZ), NOW, limit, pages, snippets)


def _sql_strength(names: list[str]) -> str:
    return " + ".join(f"greatest(ln((n_rows - df_{n} + 0.5) / (df_{n} + 0.5)), 1e-6) * {n} * 2.2 / ({n} + 1.2 * (0.25 + 0.75 * length / mean))" for n in names)


def _sql_hit(terms: list[str], title: str, url: str) -> str:
    """1 if each term begins a token of title or address, 0.5 if some do; texts already folded."""
    hay = rf"list_concat(regexp_extract_all({title}, '[\p{{L}}\p{{N}}]+'), regexp_extract_all({url}, '[\p{{L}}\p{{N}}]+'))"
    n = " + ".join(f"(len([x for x in {hay} if starts_with(x, '{t}')]) > 0)::int" for t in terms)
    return f"(case when {n} = {len(terms)} then 1 when {n} > 0 then 0.5 else 0 end)"


def _sql_rank(tag: str, where: str, names: list[str], phrases: list[str], terms: list[str], most: int, shown: int, approximate: bool) -> str:
    """CTEs that rank the pages of ``hits`` that satisfy ``where``; the result is the table ``tag``."""
    words = r"[^\p{L}\p{N}]+".join(terms)
    shows = " or ".join(f"contains({f}, ' {t} ')" for f in ("w_body", "w_description", "w_headings") for t in terms[:-1])
    shows = " or ".join(filter(None, [shows, *(f"contains({f}, ' {terms[-1]}')" for f in ("w_body", "w_description", "w_headings"))]))
    near = f"(coalesce(body, '') <> '' and (regexp_matches(substring({_FOLD.format('body')}, 1, 20000), '{words}') or regexp_matches({_FOLD.format('title')}, '{words}')))"
    return f"""{tag}_c as (select h.id, {_sql_strength(names)} as strength, p.url, p.title, p.domain, p.last_visit, p.visit_count, p.flags from hits h, stats s, pages p where p.id = h.id and {where}
  order by strength desc, p.last_visit desc, h.id limit {most}),
{tag}_f as (select *, strength / max(strength) over () + 0.35 * {_sql_hit(terms, _FOLD.format('title'), 'lower(url)')} + 0.25 * exp(-greatest(0, {NOW} - last_visit) / ({DAY} * 45.0))
  + 0.08 * ln(1 + greatest(0, visit_count)) + (case when flags & 4 != 0 then 0.2 else 0 end) as pre from {tag}_c),
{tag}_p as (select *, row_number() over (order by pre desc, last_visit desc, url) as place from {tag}_f),
{tag} as (select 'page' as kind, f.id, f.url, case when flags & 4 <> 0 then 'saved' when flags & 2 <> 0 then 'deep' else 'history' end as source,
  (pre + (case when place <= {shown} and {len(terms) > 1} and {near} then 0.2 else 0 end)) * {0.5 if approximate else 1.0} as score, {approximate} as approximate,
  case when place <= {shown} and ({shows}) then 'content' else 'title-url' end as match_kind, last_visit as ts
  from {tag}_p f left join contents c on c.page_id = f.id left join (select id as w_id, headings as w_headings, description as w_description, body as w_body from page_index) w on w.w_id = f.id)"""


def _sql_hits(phrases: dict[str, tuple[str, bool]]) -> str:
    cols = ", ".join(f"{_sql_wtf(p, x)} as {n}" for n, (p, x) in phrases.items())
    dfs = ", ".join(f"count(*) filter (where {n} > 0) as df_{n}" for n in phrases)
    return f"""{_PAGE_INDEX},
hits as (select id, {_LENGTH} as length, {cols} from page_index),
stats as (select count(*) as n_rows, avg(length) as mean, {dfs} from hits)"""


def _sql_quotes(phrases: dict[str, tuple[str, bool]], terms: list[str], excluded: list[str]) -> str:
    """CTE ``quotes``: ranked quotes that hold all phrases."""
    w = ", ".join(f"5.0 * {_hits('a', p, x)} + 2.0 * {_hits('b', p, x)} as {n}" for n, (p, x) in phrases.items())
    dfs = ", ".join(f"count(*) filter (where {n} > 0) as df_{n}" for n in phrases)
    out = " + ".join([f"{_hits('a', e)} + {_hits('b', e)}" for e in excluded] or ["0"])
    fold_title, fold_url = _FOLD.format("page_title"), _FOLD.format("url")
    return f"""q_t as (select *, {_pad('text')} as a, {_pad('page_title')} as b from snippets),
q_h as (select *, len(string_split(trim(a), '  ')) - (a = '')::int + len(string_split(trim(b), '  ')) - (b = '')::int as length, {w}, {out} as out from q_t),
q_s as (select count(*) as n_rows, avg(length) as mean, {dfs} from q_h),
q_c as (select *, {_sql_strength(list(phrases))} as strength from q_h, q_s where {' and '.join(f'{n} > 0' for n in phrases)} and out = 0 order by strength desc, created_at desc, id limit 200),
quotes as (select 'snippet' as kind, id, url, 'snippet' as source, strength / max(strength) over () + 0.35 * {_sql_hit(terms, fold_title, fold_url)}
  + 0.25 * exp(-greatest(0, {NOW} - created_at) / ({DAY} * 45.0)) + 0.2 as score, false as approximate, 'content' as match_kind, created_at as ts from q_c)"""


_BEST = "select kind, id, url, source, round(score, 6) as score, approximate, match_kind from ({0}) order by approximate, score desc, ts desc, url, id limit 50"
_EXACT = {"w0": ("of  the", False), "w1": ("la", True), "x0": ("orchard", False)}


@_query(f"""with {_sql_hits(_EXACT)}, {_sql_rank('exact', 'w0 > 0 and w1 > 0 and x0 = 0', ['w0', 'w1'], [], ['of', 'the', 'la'], 200, 50, False)},
{_sql_quotes(dict(list(_EXACT.items())[:2]), ['of', 'the', 'la'], ['orchard'])} {_BEST.format('select * from exact union all select * from quotes')}""")
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: pages and quotes that hold a phrase and a beginning, and not a word, ranked together."""
    return _results(run_search(spark, sf_dir, '"of the" la -orchard'))


_LOOSE = {"w0": ("katrefaforum", False), "w1": ("lanterrn", False), "w2": ("βιβλιοθηκη", False)}


@_query(f"""with {_sql_hits(_LOOSE)}, {_sql_rank('loose', 'w0 + w1 + w2 > 0', list(_LOOSE), [], ['katrefaforum', 'lanterrn', 'βιβλιοθηκη'], 40, 10, True)} {_BEST.format('select * from loose')}""")
def search_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without exact results, answered by pages that hold any of its words."""
    return _results(run_search(spark, sf_dir, "katrefaforum lanterrn βιβλιοθηκη"))


@_query()
def search_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with its excerpts and highlights."""
    return _excerpts(run_search(spark, sf_dir, '"of the" la -orchard'))


@_query(f"""with c as (select * from pages where flags & 4 != 0 and last_visit >= {NOW - 90 * DAY} order by last_visit desc, id limit 200)
select id, round(0.25 * exp(-greatest(0, {NOW} - last_visit) / ({DAY} * 45.0)) + 0.08 * ln(1 + greatest(0, visit_count)) + 0.2, 6) as score from c""")
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No words: the latest saved pages of three months, by recency, visits and mark."""
    q = parse_query("is:saved after:90d", NOW)
    pages = table(spark, sf_dir, "pages")
    found = S.page_candidates(pages, _index(spark, sf_dir), q, matches=None)
    ranked = S.rank_pages(found, table(spark, sf_dir, "contents"), q, NOW, matched=False, approximate=False)
    return ranked.select("id", F.round("score", 6).alias("score"))


@_query(f"""with t as (select *, {_pad('text')} as a, {_pad('page_title')} as b from snippets),
h as (select id, created_at, len(string_split(trim(a), '  ')) - (a = '')::int + len(string_split(trim(b), '  ')) - (b = '')::int as length, 5.0 * {_hits('a', 'lantern', True)} + 2.0 * {_hits('b', 'lantern', True)} as w from t),
s as (select count(*) as n, avg(length) as mean, count(*) filter (where w > 0) as df from h)
select id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * length / mean)), 6) as strength from h, s where w > 0""")
def snippet_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted BM25 of every quote with a word that begins with ``lantern``."""
    found = S.bm25_matches(kept_indexes(spark, sf_dir)[1], [(["lantern"], True)], True)
    return found.select("id", F.round("strength", 6).alias("strength"))


@_query(f"""with {_PAGE_INDEX}, v as (select term, count(distinct id) as doc from (
  select id, unnest(regexp_extract_all(title || headings || description || body, '[^ ]+')) as term from page_index) group by 1),
near as (select term, doc from v where starts_with(term, 'l') and length(term) between 6 and 10 order by doc desc, term limit 3000)
select term, doc, levenshtein(term, 'lanterrn') as distance from near where levenshtein(term, 'lanterrn') <= 2
  and not exists (select 1 from v where term = 'lanterrn') order by 3, doc desc, term limit 3""")
def suggest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.suggest(_index(spark, sf_dir).vocabulary, "lanterrn", 3)
    return out.select("term", "doc", F.col("distance").cast("long").alias("distance"))


@_query(f"select id from pages where {_SITE.format('vofi-forum.example')} and not {_SITE.format('docs.vofi-forum.example')}")
def site_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = parse_query("site:vofi-forum.example -site:docs.vofi-forum.example", NOW)
    return table(spark, sf_dir, "pages").where(S.page_filters(q, F.col("domain"), F.col("last_visit"), F.col("flags"))).select("id")


@_query(f"select id from pages where last_visit >= {1788220800000 - TZ * 60_000} and last_visit < {NOW - 7 * DAY} and flags & 4 != 0")
def date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages from 1 September, user's time, until a week ago."""
    q = parse_query("after:2026-09-01 before:1w is:saved", NOW, TZ)
    return table(spark, sf_dir, "pages").where(S.page_filters(q, F.col("domain"), F.col("last_visit"), F.col("flags"))).select("id")


# --- history and changes -----------------------------------------------------------

_VALID = "regexp_matches(trim(url), '^https?://[a-z0-9_]')"
_SEQ = "struct_pack(r := received_at, t := last_visit_time, n := coalesce(title, ''), v := coalesce(visit_count, 1), y := coalesce(typed_count, 0))"


def visit_order():
    """Order of arrival; rows that arrive together are told apart by all they say."""
    return F.struct("received_at", "last_visit_time", F.coalesce("title", F.lit("")), F.coalesce("visit_count", F.lit(1)), F.coalesce("typed_count", F.lit(0)))


@_query(f"select url as raw, case when {_VALID} then {_NORM} end as url from (select distinct url from visit_items)")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "visit_items").select("url").distinct()
    return raw.select(F.col("url").alias("raw"), U.normalized_url(F.col("url")).alias("url"))


@_query(f"""with v as (select *, {_NORM} as u, {_SEQ} as seq from visit_items where {_VALID}),
s as (select u, arg_min(floor(last_visit_time + 0.5)::bigint, seq) as first_at, max(floor(last_visit_time + 0.5)::bigint) as last_at, arg_max(coalesce(visit_count, 1), seq) as visits,
  arg_max(coalesce(typed_count, 0), seq) as typed, arg_max(substring(title, 1, 2000), seq) filter (where coalesce(title, '') <> '') as t from v group by u)
select coalesce(p.url, s.u) as url, case when s.t is not null then s.t when p.url is null then '' else p.title end as title, coalesce(p.first_seen, s.first_at) as first_seen,
  greatest(p.last_visit, s.last_at) as last_visit, case when s.u is not null then s.visits else p.visit_count end as visit_count,
  case when s.u is not null then s.typed else p.typed_count end as typed_count, case when s.u is not null then coalesce(p.flags, 0) | 1 else p.flags end as flags
from pages p full join s on p.url = s.u""")
def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visits merged into the pages."""
    state, _ = A.upsert_history(archive(spark, sf_dir), table(spark, sf_dir, "visit_items"), visit_order())
    return state.pages.select("url", "title", "first_seen", "last_visit", "visit_count", "typed_count", "flags")


@_query(f"""with v as (select {_NORM} as u from visit_items where {_VALID}), d as (select u, count(*) as n from v group by u)
select count(*) filter (where p.url is null) as inserted, sum(n) - count(*) + count(p.url) as updated, (select count(*) from visit_items) - sum(n) as skipped from d left join pages p on p.url = d.u""")
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.upsert_history(archive(spark, sf_dir), table(spark, sf_dir, "visit_items"), visit_order())[1]


@_query(f"select p.url, p.last_visit from pages p where p.url in (select {_NORM} from (select unnest(urls) as url from removals where not all_history) where {_VALID})")
def last_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "removals").where("not all_history").select(F.explode("urls").alias("url"))
    return A.last_visits(table(spark, sf_dir, "pages"), urls)


@_query(f"""with r as (select {_NORM} as u, min(epoch_ms(received_at)) as at from (select unnest(urls) as url, received_at from removals where not all_history) where {_VALID} group by 1)
select u as url, case when p.url is null then 'unknown' when p.last_visit < r.at - {85 * DAY} then 'expired' else 'delete' end as action from r left join pages p on p.url = r.u""")
def expiry_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each removed address asks for: nothing if the browser dropped it by itself."""
    return A.plan_removals(table(spark, sf_dir, "pages"), table(spark, sf_dir, "removals"), F.unix_millis(F.col("received_at").cast("timestamp")))


def _state(change: tuple[A.Archive, DataFrame]) -> DataFrame:
    return change[0].pages.select("id", "flags")


def _sql_removed(cond: str) -> str:
    return f"select id, case when {cond} then flags & 6 else flags end as flags from pages where not (coalesce({cond}, false) and flags & 4 = 0)"


@_query(_sql_removed(f"url in (select {_NORM} from (select unnest(urls) as url from removals where not all_history) where {_VALID})"))
def delete_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "removals").where("not all_history").select(F.explode("urls").alias("url"))
    return _state(A.delete_urls(archive(spark, sf_dir), urls))


@_query(_sql_removed(_SITE.format("katrefaforum.example")))
def delete_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(A.delete_domain(archive(spark, sf_dir), "katrefaforum.example"))


@_query(_sql_removed(f"last_visit >= {NOW - 60 * DAY} and last_visit < {NOW - 30 * DAY}"))
def delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(A.delete_range(archive(spark, sf_dir), NOW - 60 * DAY, NOW - 30 * DAY))


@_query(_sql_removed(f"last_visit >= 0 and last_visit < {NOW - 3 * 30 * DAY}"))
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(A.apply_retention(archive(spark, sf_dir), 3, NOW))


@_query(f"select count(*) filter (where flags & 4 = 0) as deleted_pages, count(*) filter (where flags & 4 <> 0) as kept_saved from pages where last_visit >= 0 and last_visit < {NOW - 3 * 30 * DAY}")
def retention_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.apply_retention(archive(spark, sf_dir), 3, NOW)[1]


@_query("select id, flags & 6 as flags from pages where flags & 4 <> 0")
def delete_all_except_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(A.delete_all_except_saved(archive(spark, sf_dir)))


@_query("select id, url from snippets where not (domain = 'katrefaforum.example' or domain like '%.katrefaforum.example')")
def delete_domain_with_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes left after a site is removed together with what was saved of it."""
    return A.delete_domain(archive(spark, sf_dir), "katrefaforum.example", True)[0].snippets.select("id", "url")


@_query("""select id, case when url in (select url from snippets) and flags & 4 <> 0 then flags & 1 else flags end as flags,
  case when not (url in (select url from snippets) and flags & 4 <> 0) then saved_at end as saved_at from pages where not (url in (select url from snippets) and flags & 4 <> 0 and flags & 1 = 0)""")
def unsave_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages that have quotes are no longer saved."""
    state, _ = A.unsave(archive(spark, sf_dir), table(spark, sf_dir, "snippets").select("url"))
    return state.pages.select("id", "flags", "saved_at")


@_query("""select id, case when flags & 2 <> 0 and flags & 4 = 0 then flags & 5 else flags end as flags, case when not (flags & 2 <> 0 and flags & 4 = 0) then content_hash end as content_hash
  from pages where not (flags & 2 <> 0 and flags & 4 = 0 and flags & 1 = 0)""")
def clear_deep_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = A.clear_deep_content(archive(spark, sf_dir))
    return state.pages.select("id", "flags", "content_hash")


_PAGE_BYTES = "strlen(url) + strlen(domain) + coalesce(strlen(title), 0) + 64"


def _sql_cap(cap: str) -> str:
    """Both steps of the cap in SQL; ``cap`` from the sums t (saved texts, all texts, pages)."""

    def step(name: str, rows: str, over: str) -> str:
        return f"""{name}_c as (select id, bytes, row_number() over w as place, sum(bytes) over (w rows unbounded preceding) as freed from ({rows}) window w as (order by last_visit, id)),
{name}_b as (select (place - 1) // 200 as batch, max(freed) as freed from {name}_c group by 1),
{name}_n as (select batch from (select batch, coalesce(max(freed) over (order by batch rows between unbounded preceding and 1 preceding), 0) as prior from {name}_b), k where {over} > prior),
{name} as (select id, bytes from {name}_c where (place - 1) // 200 in (select batch from {name}_n))"""

    texts = "select p.id, last_visit, coalesce(bytes, 0) as bytes from pages p left join contents c on c.page_id = p.id where flags & 2 <> 0 and flags & 4 = 0"
    pages = f"select id, last_visit, {_PAGE_BYTES} as bytes from pages where flags & 4 = 0"
    return f"""with t as (select sum(coalesce(bytes, 0)) as texts, sum(case when flags & 4 <> 0 then coalesce(bytes, 0) else 0 end) as saved, sum({_PAGE_BYTES}) as pages from pages p left join contents c on c.page_id = p.id),
k as (select texts + pages as total, {cap} as cap from t),
{step('trim', texts, 'total - cap')},
{step('del', pages, 'total - cap - (select coalesce(sum(bytes), 0) from trim)')}
select id, bytes, 'trim' as step from trim union all select id, bytes, 'delete' from del"""


def _archive_bytes(a: A.Archive) -> dict[str, int]:
    """Bytes of saved texts, of all texts, and of pages."""
    sized = a.pages.join(a.contents.select(F.col("page_id").alias("id"), "bytes"), "id", "left")
    text = F.coalesce("bytes", F.lit(0))
    return sized.agg(F.sum(text).alias("texts"), F.sum(F.when(S.has_flag(F.col("flags"), S.SAVED), text).otherwise(0)).alias("saved"), F.sum(A.page_bytes()).alias("pages")).first().asDict()


@_query(_sql_cap("(texts + pages) // 2"))
def cap_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes if the archive may take half of what it does."""
    a = archive(spark, sf_dir)
    size = _archive_bytes(a)
    return A.cap_plan(a, (size["texts"] + size["pages"]) // 2).select("id", "bytes", "step")


@_query(_sql_cap("saved + pages // 2"))
def cap_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes if only the saved texts and half of the pages have room: all other texts, then the oldest pages."""
    a = archive(spark, sf_dir)
    size = _archive_bytes(a)
    return A.cap_plan(a, size["saved"] + size["pages"] // 2).select("id", "bytes", "step")


@_query("""select url, sha256(coalesce(title, '') || chr(10) || coalesce(headings, '') || chr(10) || coalesce(description, '') || chr(10) || coalesce(body, '')) as content_hash
from pages p join contents c on c.page_id = p.id""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "pages").join(table(spark, sf_dir, "contents").withColumnRenamed("page_id", "id"), "id")
    return joined.select("url", X.content_hash(*(F.col(c) for c in ("title", "headings", "description", "body"))).alias("content_hash"))


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as captured texts."""
    return table(spark, sf_dir, "documents").select(
        "url", "title", F.lit("").alias("headings"), F.lit("").alias("description"), F.col("text").alias("body"), "lang", F.sha2("text", 256).alias("content_hash"),
        F.unix_millis(F.col("captured_at").cast("timestamp")).cast("double").alias("at"),
    )


_CAPTURED = f"""d as (select u, arg_max(h, k) as h, arg_max(t, k) as t, arg_max(l, k) as l, max(epoch_us(captured_at) // 1000) as at_ms, arg_max(b, k) as b
  from (select {_NORM} as u, sha256(text) as h, substring(coalesce(title, ''), 1, 2000) as t, coalesce(lang, '') as l, substring(text, 1, 50000) as b, captured_at, struct_pack(c := captured_at, d := doc_id) as k from documents where {_VALID}) group by u),
todo as (select d.* from d where not exists (select 1 from pages p where p.url = d.u and p.content_hash = d.h and p.flags & 2 <> 0))"""


@_query(f"""with {_CAPTURED} select coalesce(p.url, u) as url, case when t <> '' then t else coalesce(p.title, '') end as title, case when u is null then p.flags else coalesce(p.flags, 0) | 2 end as flags,
  case when u is null then coalesce(p.lang, '') else substring(l, 1, 35) end as lang, case when u is null then p.content_hash else h end as content_hash, case when u is null then p.content_indexed_at else at_ms end as content_indexed_at,
  coalesce(p.visit_count, 0) as visit_count from pages p full join todo on p.url = todo.u""")
def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages after every document was captured; texts whose hash is known change nothing."""
    state, _ = A.upsert_content(archive(spark, sf_dir), _captured(spark, sf_dir))
    return state.pages.select("url", "title", "flags", F.coalesce("lang", F.lit("")).alias("lang"), "content_hash", "content_indexed_at", "visit_count")


@_query(f"""with {_CAPTURED}, after as (select coalesce(p.url, u) as url, case when t <> '' then t else coalesce(p.title, '') end as title, u, p.id as old, b from pages p full join todo on p.url = todo.u),
texts as (select a.url, a.title, coalesce(case when u is null then c.headings else '' end, '') as headings, coalesce(case when u is null then c.description else '' end, '') as description, case when u is null then c.body else b end as body
  from after a left join contents c on c.page_id = a.old),
w as (select url, unnest(list_concat({_TOKENS.format('title')}, {_TOKENS.format('headings')}, {_TOKENS.format('description')}, {_TOKENS.format('body')})) as term from texts)
select term, count(distinct url) as doc, count(*) as cnt from w group by term""")
def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of a kept index after all documents were captured: a first segment, and one for what changed."""
    root = scratch_path(spark, "index-update")
    snapshot.write_snapshot(archive(spark, sf_dir), root)
    base = snapshot.open_snapshot(spark, root)
    state, _ = A.upsert_content(base.archive, _captured(spark, sf_dir))
    snapshot.write_snapshot(state, root, base=base)
    return snapshot.read_index(spark, snapshot.read_manifest(spark, root), "pages").vocabulary


@_query(f"""select {_NORM} as url, regexp_extract({_NORM}, '^https?://([^/:?#]*)', 1) as domain, substring(coalesce(title, ''), 1, 2000) as page_title, substring(text, 1, 5000) as text, length(text) > 5000 as truncated,
  epoch_us(captured_at) // 1000 as created_at from documents where {_VALID} and text <> ''""")
def add_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as quotes."""
    batch = table(spark, sf_dir, "documents").select("url", F.col("title").alias("page_title"), "text", F.lit(None).cast("string").alias("fragment"), F.unix_millis(F.col("captured_at").cast("timestamp")).cast("double").alias("created_at"))
    a = archive(spark, sf_dir)
    empty = A.Archive(a.pages, a.contents, a.snippets.where(F.lit(False)))
    return A.add_snippets(empty, batch).snippets.select("url", "domain", "page_title", "text", "truncated", "created_at")


@_query("select id, url, text from snippets where not truncated and id not in (select min(id) from snippets group by url, text, created_at having count(*) > 1)")
def delete_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes left after those that were cut and one of each that was imported twice are deleted."""
    a = archive(spark, sf_dir)
    twice = a.snippets.groupBy("url", "text", "created_at").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id")
    return A.delete_snippets(a, a.snippets.where("truncated").select("id").unionByName(twice)).snippets.select("id", "url", "text")


@_query("select 0 as pages, 0 as texts, 0 as quotes, count(*) as deleted_pages, 0 as kept_saved from pages")
def delete_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, summary = A.delete_everything(archive(spark, sf_dir))
    n = lambda df: df.agg(F.count("*").alias("n")).scalar()
    return summary.select(n(state.pages).alias("pages"), n(state.contents).alias("texts"), n(state.snippets).alias("quotes"), "deleted_pages", "kept_saved")


@_query(f"""with b as (select distinct {_NORM} as u from (select url from pages where id in (select page_id from contents where headings <> '')))
select coalesce(p.url, u) as url, case when u is null then p.flags else coalesce(p.flags, 0) | 6 end as flags from pages p full join b on p.url = b.u""")
def save_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags after every page whose text has headings is saved."""
    a = archive(spark, sf_dir)
    texts = a.contents.where("headings <> ''").withColumnRenamed("page_id", "id")
    batch = a.pages.join(texts, "id").select("url", "title", "headings", "description", "body", "lang", F.lit(None).cast("string").alias("content_hash"), F.lit(NOW).cast("double").alias("at"))
    return A.upsert_content(a, batch, save=True)[0].pages.select("url", "flags")


@_query("select url, page_title, text, fragment, created_at from snippets")
def export_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.export_snippets(archive(spark, sf_dir)).drop("truncated")


@_query("""select url, title, first_seen, last_visit, visit_count, typed_count, lang, flags & 6 as flags, saved_at, content_hash, content_indexed_at, headings, description, body
from pages p left join contents c on c.page_id = p.id where flags & 4 <> 0""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.export_pages(archive(spark, sf_dir), "saved")


@_query(f"""with g as (select {_NORM} as u, bit_or(flags) as f from pages group by 1), s as (select distinct {_NORM} as u, text, created_at from snippets)
select count(*) as pages, count(*) filter (where (coalesce(p.flags, 0) | coalesce(g.f, 0)) & 4 <> 0) as saved, (select count(*) from s) as snippets from pages p full join g on p.url = g.u""")
def import_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive without quotes into which its own export is merged: the same pages, each quote once."""
    a = archive(spark, sf_dir)
    state, _ = A.import_data(A.Archive(a.pages, a.contents, a.snippets.where(F.lit(False))), A.export_pages(a), A.export_snippets(a))
    p = state.pages.agg(F.count("*").alias("pages"), F.count_if(S.has_flag(F.col("flags"), S.SAVED)).alias("saved"))
    return p.withColumn("snippets", state.snippets.agg(F.count("*").alias("snippets")).scalar())


@_query(f"""with g as (select {_NORM} as u, min(first_seen) as first_seen, max(last_visit) as last_visit, max(visit_count) as visit_count, max(typed_count) as typed_count, bit_or(flags) as flags from pages group by 1)
select u as url, first_seen, last_visit, visit_count, typed_count, flags from g""")
def import_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive exported as JSON and read into an empty one."""
    from pagecask.sources import exchange

    a, folder = archive(spark, sf_dir), scratch_path(spark, "export")
    exchange.write_export(a, folder)
    none = F.lit(False)
    state, _ = exchange.import_export(A.Archive(a.pages.where(none), a.contents.where(none), a.snippets.where(none)), folder)
    return state.pages.select("url", "first_seen", "last_visit", "visit_count", "typed_count", "flags")


# --- reports -------------------------------------------------------------------------


@_query("select page_id, bytes from contents")
def content_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 bytes of the three texts, counted again."""
    return table(spark, sf_dir, "contents").select("page_id", X.text_bytes(F.col("headings"), F.col("description"), F.col("body")).alias("bytes"))


@_query("select domain, quantile_disc(visit_count, 0.5) as p50, quantile_disc(visit_count, 0.95) as p95, max(visit_count) as max from pages group by domain")
def visit_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest_rank(table(spark, sf_dir, "pages"), "visit_count", [0.5, 0.95], ["domain"])


@_query("""select domain, count(*) as pages, count(*) filter (where flags & 4 <> 0) as saved, count(*) filter (where flags & 2 <> 0) as with_content, coalesce(sum(bytes), 0) as bytes,
  max(greatest(last_visit, coalesce(content_indexed_at, 0))) as last_activity from pages p left join contents c on c.page_id = p.id group by domain""")
def domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.domain_stats(table(spark, sf_dir, "pages"), table(spark, sf_dir, "contents"))


@_query("""select count(*) as pages, count(*) filter (where flags & 1 <> 0) as history, count(*) filter (where flags & 2 <> 0) as with_content, count(*) filter (where flags & 4 <> 0) as saved,
  min(first_seen) as first_seen, max(last_visit) as last_visit, (select coalesce(sum(bytes), 0) from contents) as text_bytes, (select count(*) from snippets) as snippets from pages""")
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return R.archive_stats(a.pages, a.contents, a.snippets)


@_query("""select p.id, p.url, domain, title, first_seen, last_visit, visit_count, lang, flags, coalesce(bytes, 0) as bytes, coalesce(substring(body, 1, 600), '') as preview,
  (select count(*) from snippets s where s.url = p.url) as snippets from pages p left join contents c on c.page_id = p.id where p.url = (select min(url) from snippets)""")
def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return R.page_info(a.pages, a.contents, a.snippets, a.snippets.agg(F.min("url")).first()[0])


@_query("""select 'contents_without_page' as "check", count(*) as problems from contents where page_id not in (select id from pages)
union all select 'pages_not_indexed', 0 union all select 'indexed_without_page', 0 union all select 'postings_against_lengths', 0 union all select 'vocabulary_against_postings', 0
union all select 'repeated_urls', count(*) from (select url from pages group by url having count(*) > 1)
union all select 'content_flag_without_text', count(*) from pages where flags & 2 <> 0 and id not in (select page_id from contents)""")
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.integrity(table(spark, sf_dir, "pages"), table(spark, sf_dir, "contents"), _index(spark, sf_dir))


@_query(f"select (epoch_ms(received_at) // {7 * DAY}) * {7 * DAY} as window_start, count(*) as rows, count(*) filter (where {_VALID}) as processed, count(distinct url) as urls from visit_items group by 1")
def reconcile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each seven-day window of the backfill reads and keeps."""
    v = table(spark, sf_dir, "visit_items")
    start = F.floor(F.unix_millis(F.col("received_at").cast("timestamp")) / (7 * DAY)) * (7 * DAY)
    ok = F.trim("url").rlike("^https?://[a-z0-9_]")
    return v.groupBy(start.cast("long").alias("window_start")).agg(F.count("*").alias("rows"), F.count_if(ok).alias("processed"), F.count_distinct("url").alias("urls"))


_INELIGIBLE = r"not regexp_matches(domain, '\.') or regexp_matches(domain, '^[0-9.]+$') or regexp_matches(domain, '\.(local|localdomain|internal|lan|home|corp)$')"
_GATE = rf"""case when {_INELIGIBLE} then 'ineligible' when id % 7 = 0 then 'incognito' when regexp_replace(domain, '^www\.', '') = 'katrefaforum.example' or domain like '%.katrefaforum.example' then 'excluded'
  when id % 5 = 0 then 'no-permission' end"""


@_query(f"""select 'open' as mode, id, {_GATE} as gate from pages union all select 'off', id, 'disabled' from pages union all select 'paused', id, 'paused' from pages union all select 'revoked', id, 'no-consent' from pages""")
def capture_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against capturing each page, by the state of the pipeline."""
    from dataclasses import replace

    from pagecask.streaming.pipeline import capture_gates as gates
    from pagecask.streaming.state import PipelineState

    open_ = replace(PipelineState().granted().excluding("katrefaforum.example"), deep_enabled=True)
    states = {"open": open_, "off": replace(open_, deep_enabled=False), "paused": replace(open_, settings=replace(open_.settings, paused=True)), "revoked": open_.revoked()}
    batch = table(spark, sf_dir, "pages").select("id", "url", (F.col("id") % 7 == 0).alias("incognito"), (F.col("id") % 5 != 0).alias("permitted"))
    parts = [gates(state, batch).select(F.lit(mode).alias("mode"), "id", "gate") for mode, state in states.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _pipeline(spark: SparkSession, state: A.Archive, name: str, window_ms: int | None = None, **told):
    """A pipeline over a new snapshot of ``state``."""
    from dataclasses import replace

    from pagecask.streaming.pipeline import WINDOW_MS, Pipeline
    from pagecask.streaming.state import PipelineState

    root = scratch_path(spark, name)
    snapshot.write_snapshot(state, root, extra={"state": replace(PipelineState().granted(), **told).dumps()})
    return Pipeline(spark, root, lambda: NOW, window_ms or WINDOW_MS)


_UPSERTED = "url, title, first_seen, last_visit, visit_count, typed_count, flags"


def _sql_upserted(where: str) -> str:
    """History merged into the pages, of the visits that satisfy ``where``."""
    return f"""with v as (select *, {_NORM} as u, {_SEQ} as seq from visit_items where {_VALID} and {where}),
s as (select u, arg_min(floor(last_visit_time + 0.5)::bigint, seq) as first_at, max(floor(last_visit_time + 0.5)::bigint) as last_at, arg_max(coalesce(visit_count, 1), seq) as visits,
  arg_max(coalesce(typed_count, 0), seq) as typed, arg_max(substring(title, 1, 2000), seq) filter (where coalesce(title, '') <> '') as t from v group by u)
select coalesce(p.url, s.u) as url, case when s.t is not null then s.t when p.url is null then '' else p.title end as title, coalesce(p.first_seen, s.first_at) as first_seen,
  greatest(p.last_visit, s.last_at) as last_visit, case when s.u is not null then s.visits else p.visit_count end as visit_count,
  case when s.u is not null then s.typed else p.typed_count end as typed_count, case when s.u is not null then coalesce(p.flags, 0) | 1 else p.flags end as flags
from pages p full join s on p.url = s.u"""


_SINCE = NOW - 30 * DAY


@_query(_sql_upserted(f"last_visit_time >= {_SINCE - DAY} and last_visit_time < {NOW + 1}"))
def reconcile_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages after a reconcile a month after the last one: visits from a day before it on are read again."""
    from pagecask.streaming.state import ImportState

    pipe = _pipeline(spark, archive(spark, sf_dir), "reconcile", history=ImportState(status="complete"), last_reconcile_at=_SINCE)
    assert pipe.reconcile(table(spark, sf_dir, "visit_items")) == "done"
    return pipe.archive().pages.select(*_UPSERTED.split(", "))


_WINDOW = 180 * DAY


@_query(f"""with v as (select {_NORM} as u, floor(last_visit_time + 0.5)::bigint as t_ms, title, coalesce(visit_count, 1) as vc, coalesce(typed_count, 0) as tc,
  struct_pack(w := ceil(({NOW + 1} - last_visit_time) / {_WINDOW})::bigint, s := {_SEQ}) as k from visit_items where {_VALID} and last_visit_time < {NOW + 1})
select v.u as url, coalesce(arg_max(substring(title, 1, 2000), k) filter (where coalesce(title, '') <> ''), '') as title, arg_min(t_ms, k) as first_seen, max(t_ms) as last_visit, arg_max(vc, k) as visit_count, arg_max(tc, k) as typed_count, 1 as flags
from v group by v.u""")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of an archive that was empty before the import, half a year at a time, newest first."""
    a, none = archive(spark, sf_dir), F.lit(False)
    pipe = _pipeline(spark, A.Archive(a.pages.where(none), a.contents.where(none), a.snippets.where(none)), "backfill", _WINDOW)
    assert pipe.run_import(table(spark, sf_dir, "visit_items")) == "complete"
    return pipe.archive().pages.select(*_UPSERTED.split(", "))


# --- display, extraction, live visits, relevance ---------------------------------------


@_query(f"""select id, case when a < 60000 then 'now' when a < 3600000 then 'minutes' when a < {DAY} then 'hours' when a < {60 * DAY} then 'days' else 'months' end as unit,
  case when a < 60000 then 0 when a < 3600000 then a // 60000 when a < {DAY} then a // 3600000 when a < {60 * DAY} then a // {DAY} else a // {30 * DAY} end as n
from (select id, greatest(0, {NOW} - last_visit) as a from pages)""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = D.relative_time(F.col("last_visit"), F.lit(NOW))
    return table(spark, sf_dir, "pages").select("id", age["unit"].alias("unit"), age["n"].alias("n"))


@_query(r"""select distinct domain, upper(substring(d, 1, 1)) as letter, (list_reduce([ord(x) for x in string_split(d, '')], lambda h, c: (h * 31 + c) % 4294967296, 0) % 360)::int as hue
from (select domain, regexp_replace(domain, '^www\.', '') as d from pages)""")
def avatars(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = D.avatar(F.col("domain"))
    return table(spark, sf_dir, "pages").select("domain").distinct().select("domain", mark["letter"].alias("letter"), mark["hue"].alias("hue"))


_ENC = "replace(url_encode({0}), '-', '%2D')"


@_query(rf"""with t as (select id, url, fragment, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from snippets), w as (select *, string_split(t, ' ') as w from t)
select id, case when t = '' then null when length(t) <= 300 then '#:~:text=' || {_ENC.format('t')} when len(w) <= 12 then '#:~:text=' || {_ENC.format('substring(t, 1, 300)')}
  else '#:~:text=' || {_ENC.format("array_to_string(w[1:6], ' ')")} || ',' || {_ENC.format("array_to_string(w[-6:], ' ')")} end as link,
  case when coalesce(fragment, '') <> '' then url || (case when starts_with(fragment, '#') then '' else '#' end) || fragment else url end as href from w""")
def text_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "snippets")
    return s.select("id", D.text_fragment(F.col("text")).alias("link"), D.result_href(F.lit("snippet"), F.col("url"), F.col("fragment")).alias("href"))


def _as_html(pages: DataFrame, contents: DataFrame) -> DataFrame:
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    both = pages.join(contents.withColumnRenamed("page_id", "id"), "id")
    heads = F.concat(F.lit("<h2>"), F.array_join(F.split(safe(F.col("headings")), " · "), "</h2><h2>"), F.lit("</h2>"))
    paragraphs = F.concat(F.lit("<p>"), F.array_join(F.split(safe(F.col("body")), "\n"), "</p><p>"), F.lit("</p>"))
    return both.select("id", F.concat(
        F.lit('<html lang="'), F.coalesce("lang", F.lit("")), F.lit('"><head><title>'), safe(F.col("title")), F.lit('</title><meta name="description" content="'),
        F.replace(safe(F.col("description")), F.lit('"'), F.lit("&quot;")), F.lit('"></head><body><nav>Home</nav><main>'), heads, paragraphs, F.lit("</main><footer>©</footer></body></html>"),
    ).alias("html"))


_BLANK = r"[\x00-\x20\x7f-\xa0\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"


def _sql_clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_BLANK}+', ' ', 'g'))"


@_query(f"""with t as (select p.id, {_sql_clean("replace(coalesce(headings, ''), ' · ', ' ') || ' ' || coalesce(body, '')")} as x, {_sql_clean("coalesce(title, '')")} as title,
  {_sql_clean("coalesce(description, '')")} as description, {_sql_clean("coalesce(headings, '')")} as headings, coalesce(lang, '') as lang from pages p join contents c on c.page_id = p.id),
w as (select id, unnest(string_split(x, ' ')) as w, generate_subscripts(string_split(x, ' '), 1) as k from t),
r as (select *, k - row_number() over (partition by id, w order by k) as run from w),
n as (select id, w, min(k) as k, count(*) as n from r group by id, w, run),
b as (select id, string_agg(case when n >= 4 and length(w) <= 40 then w else array_to_string(list_transform(range(n), lambda i: w), ' ') end, ' ' order by k) as body from n group by id)
select id, case when length(body) < 200 then 'too-little-text' end as reason, case when length(body) >= 200 then substring(title, 1, 500) end as title, case when length(body) >= 200 then substring(description, 1, 1000) end as description,
  case when length(body) >= 200 then substring(headings, 1, 5000) end as headings, case when length(body) >= 200 then substring(body, 1, 50000) end as body, case when length(body) >= 200 then substring(lang, 1, 35) end as lang,
  length(body) > 50000 as truncated from t join b using (id)""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored page written as HTML and extracted again."""
    return extract_pages(_as_html(table(spark, sf_dir, "pages"), table(spark, sf_dir, "contents")))


_MARKS = "len([x for x in {0} if x = 'wooden' or starts_with(x, 'lantern')])"


@_query(f"select id, {_MARKS.format(_TOKENS.format('body'))} > 0 as has_excerpt, least(50, {_MARKS.format(_TOKENS.format('title'))}) as n_title_highlights from pages join contents on page_id = id")
def snippet_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every page has an excerpt for one query, and the marks of its title."""
    q = parse_query("wooden lantern", NOW)
    joined = table(spark, sf_dir, "pages").join(table(spark, sf_dir, "contents").withColumnRenamed("page_id", "id"), "id")
    e = joined.select("id", excerpts(F.col("body"), q.terms, len(q.terms) - 1).alias("e"), highlight_spans(F.col("title"), q.terms, len(q.terms) - 1).alias("marks"))
    return e.select("id", F.col("e.text").isNotNull().alias("has_excerpt"), F.size("marks").cast("long").alias("n_title_highlights"))


@_query(_sql_upserted("true"))
def visit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages after all visits came through Structured Streaming, a micro-batch at a time."""
    from pagecask.streaming.pipeline import VISIT_SCHEMA

    pipe = _pipeline(spark, archive(spark, sf_dir), "visit-stream")
    source = spark.readStream.schema(VISIT_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/visit_items.parquet*")
    pipe.stream_visits(source, f"{pipe.root}-checkpoint", once=True).awaitTermination()
    return pipe.archive().pages.select(*_UPSERTED.split(", "))


@_query(f"""with own as (select id, last_visit, unnest(list_distinct({_TOKENS.format('title')})) as term from pages where title <> ''),
df as (select term, count(*) as df from own group by term), q as (select id, arg_min(term, struct_pack(d := df, t := term)) as term from own join df using (term) group by id),
placed as (select id, term, row_number() over (partition by term order by last_visit desc, id) as place from own)
select kind, count(*) as n, avg((coalesce(place, 1e9) <= 1)::int) as hit1, avg((coalesce(place, 1e9) <= 5)::int) as hit5, avg(coalesce(1.0 / place, 0)) as mrr, 0.0::double as suggestion_rate
from pages p left join (select q.id, place from q join placed using (id, term)) f using (id), (values ('rarest title word'), ('total')) k(kind) where title <> '' group by kind""")
def relevance_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hit@1, hit@5 and MRR of finding every page by its rarest title word, latest first.

    A page's place is its position in its word's list; positions come from one
    running count over all lists, so neither pairs of queries and pages nor a
    frequent word's whole list are in one task.
    """
    pages = table(spark, sf_dir, "pages").where("title <> ''")
    own = pages.select("id", "last_visit", F.explode(F.array_distinct(X.tokens(X.fold(F.col("title"))))).alias("term"))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    query = own.join(df, "term").groupBy("id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    order = [F.col("term"), F.desc("last_visit"), F.col("id")]
    counted = running_total(in_ranges(own, order, "title-words"), order, F.lit(1), "position").select("id", "term", "position")
    first = counted.groupBy("term").agg(F.min("position").alias("first"))
    found = counted.join(query, ["id", "term"]).join(first, "term").select("id", (F.col("position") - F.col("first") + 1).alias("place"))
    return S.relevance(pages.join(found, "id", "left").select(F.lit("rarest title word").alias("kind"), "place", F.lit(False).alias("suggested")))


@_query()
def relevance_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hit@1, hit@5, MRR and suggestion rate of whole searches, by seven kinds of query, over the synthetic archive."""
    from pagecask.operators import evaluation
    from pagecask.sources import synthetic

    pages, contents = (written(t, "corpus") for t in synthetic.corpus(spark, 1000, NOW))
    quotes = table(spark, sf_dir, "snippets").where(F.lit(False))
    asked = evaluation.labelled_queries(pages, contents, 2)
    return evaluation.evaluate(pages, contents, quotes, asked, NOW, I.page_index(pages, contents), I.snippet_index(quotes))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _excerpts(run_search(spark, sf_dir, "wooden lantern"))
