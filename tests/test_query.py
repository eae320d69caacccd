from hypothesis import given, settings
from hypothesis import strategies as st

from pagecask.functions.text import fold_text
from pagecask.plans.query import DAY_MS, Phrase, date_value, parse_query, start_of_day, when_value

NOW = 1_791_028_800_000 + 5 * 3_600_000


def parse(line):
    return parse_query(line, NOW, 180)


def test_words_phrases_exclusions():
    q = parse('Café "old town" foo-bar -"not this" -x')
    assert q.phrases == (Phrase(("cafe",)), Phrase(("old", "town"), True), Phrase(("foo", "bar")))
    assert q.excluded == (("not", "this"), ("x",))
    assert q.open_end and q.terms == ["cafe", "old", "town", "foo", "bar"]


def test_unfinished_quote_takes_the_rest():
    assert parse('a "b c').phrases == (Phrase(("a",)), Phrase(("b", "c"), True))


def test_operators():
    q = parse("site:www.Example.com -site:b.example.com after:2026-09-01 before:7d is:saved")
    assert q.sites == ("example.com",) and q.not_sites == ("b.example.com",) and q.saved
    assert q.after == 1788220800000 - 180 * 60_000 and q.before == NOW - 7 * DAY_MS


def test_later_dates_win_and_sites_add_up():
    q = parse("after:1d after:2d site:a.com site:b.com")
    assert q.after == NOW - 2 * DAY_MS and q.sites == ("a.com", "b.com")


def test_what_is_no_operator_is_words():
    for line, terms in (("is:open", ["is", "open"]), ("after:2026-02-30", ["after", "2026", "02", "30"]), ("site:x", ["site", "x"]), ("http://a.com/b", ["http", "a", "com", "b"])):
        assert parse(line).terms == terms
    assert parse("-is:saved").excluded == (("is", "saved"),) and not parse("-is:saved").saved
    assert parse('"site:a.com"').terms == ["site", "a", "com"]


def test_exclusions_alone_ask_for_nothing():
    assert not parse("-a -b").asks and not parse("  ...  ").asks and parse("is:snippet").asks


def test_dates():
    midnight = 1_790_985_600_000
    assert start_of_day(NOW, 180) == midnight - 180 * 60_000
    assert date_value("1Y", NOW) == NOW - 365 * DAY_MS and date_value("7x", NOW) is None
    assert when_value("Yesterday", NOW) == {"after": midnight - DAY_MS, "before": midnight}
    assert when_value("never", NOW) is None


def test_fold():
    assert fold_text("ΛΌΓΟΣ Ünï") == "λογοσ uni"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_every_line_is_a_query(line):
    q = parse(line)
    assert all(p.tokens for p in q.phrases) and all(q.excluded)
