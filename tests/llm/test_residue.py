import random
import re

import pyarrow as pa
import pytest

from pagecask.llm import residue as R

CASES = [
    "{{title}} - Some Site", "Hello ${user.name} and so on", "[Insert title here]", "%%CITY%% is nice", "text {0} text", "<!-- slot: main --> words", "[[SUMMARY]] words", "Page not found", "404 Not Found",
    "Please enable JavaScript to view this page.", "You need to enable JavaScript to run this app", "Verify you are human by completing the action below. Ray 9ab8c7d6", "Seite nicht gefunden",
    "Sorry! The page is empty because its script was blocked. (status 12)", "Some Site\nAccess denied", "Your title goes here", "Untitled document", "xxxx xxxx xxxx", "TODO write article",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt.", '{"error": "not_found", "status": 404, "trace": "0327a743"}', "ＰＡＧＥ​ ＮＯＴ ＦＯＵＮＤ", "some-site.example - 404",
]
REAL = [
    "In the manual, `{{ title }}` prints the heading.", 'They wrote "lorem ipsum" until the copy came and everybody was content with that.', "A short history of lorem ipsum: Anna", "Access denied: Anna, a novel by Bert",
    "JavaScript notes for Anna and Bert", "Error 404 explained by Anna", "The quiet market of the old town", "Some features of this page need JavaScript.\nThe quiet market of the old town was never finished.", "50 % off and 20 % more",
    "[Anna] (15%) [183.00]", "", "   ",
]


def found(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, field string, domain string, text string, message string, hash long")
    out = [tuple(r) for r in R.residue_fields(df.drop("domain"), df.select("page_id", "domain", "message")).collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_cases_and_real_texts(spark):
    rows = [(k, "title", "some-site.example", t, "clash", 1) for k, t in enumerate([*CASES, *REAL])]
    got = {k for k, _ in found(spark, rows)}
    assert [t for k, t in enumerate([*CASES, *REAL]) if (k < len(CASES)) != (k in got)] == []


def test_nulls_repeats_and_long_texts(spark):
    rows = [(1, "body", None, "Page not found", None, None), (1, "body", None, "Page not found", None, None), (2, "body", "a.example", None, None, None), (3, "title", None, "word " * 50_000 + "{{slot}}", None, None), (None, "title", None, "Page not found", None, None)]
    assert found(spark, rows) == {(1, "body"), (3, "title"), (None, "title")}
    assert found(spark, []) == set()


def test_unseen_notices_that_recur(spark):
    n = R.RECURRING_SOURCES
    unseen = ["The lantern desk gives no answer today. Ring the bell twice.", "Το φανάρι της γέφυρας έχει σφάλμα", "The orchard of the third bell has an error."]
    rows = [(100 * m + k, "body", f"site{k}.example", text, None, None) for m, text in enumerate(unseen) for k in range(n)]
    rows += [(900, "body", "one.example", "The garden path gives no answer today.", None, None), (901, "title", "one.example", "The lantern desk gives no answer today, said Anna", None, None)]
    rows += [(910 + k, "body", f"site{k}.example", "The old bridge and the mill. Ring the bell twice.", None, None) for k in range(n)]  # recurs without a cue
    assert {i for i, _ in found(spark, rows)} == {100 * m + k for m in range(3) for k in range(n)}


def test_long_sentences_without_a_cue(spark):
    """Sentences are counted in every text, and a long one beside a notice counts as known if it recurs."""
    n = R.RECURRING_SOURCES
    long = "The lantern desk by the old bridge is closed until the keeper of the mill comes home from the market in the morning."
    article = "The quiet market of the old town was never finished and the river is still open until the evening of the fair. "
    rows = [(k, "body", f"site{k}.example", f"Page not found. {long}", None, None) for k in range(n)]
    rows += [(100 + k, "body", f"site{k}.example", f"The lantern has an error. {long}", None, None) for k in range(n)]
    rows += [(200 + k, "body", f"site{k}.example", f"{article}\nThe bell by the mill.", None, None) for k in range(n)]  # counted, though no case
    rows += [(300, "body", "one.example", "Page not found. The bell by the mill.", None, None), (301, "body", "one.example", "Page not found. The bell by the fair.", None, None)]
    rows += [(400 + k, "body", f"site{k}.example", f"{article}{long} The orchard has an error.", None, None) for k in range(n)]  # an article that is copied
    assert {i for i, _ in found(spark, rows)} == {*range(n), *range(100, 100 + n), 300}


def test_words_of_cues_and_guards_of_masks():
    """What is looked up first leaves out nothing that the patterns would find."""
    for name, cue in R._CUE.items():
        for text in [*CASES, *REAL, "time-out", "timed out", "my_errors", "don't", "d'exemple", "(copy)", "no se hemos encontrada", "your text goes here", "não foi encontrado"]:
            for m in cue.finditer(text.lower()):
                assert any(name in R._CUE_WORDS[w] for w in R._WORD_OR_MARK.findall(m.group())), (name, text)
    text = "See /srv/a.b and x.php at a.example, deadbeef or 12.5 on 2024-01-02: 404"
    assert R.masked(text, "") == "see ¤ and ¤ at §, ¤ or # on #: ‡"


def test_messages_of_any_length(spark):
    trace = "Traceback (most recent call last):\n" + "\n".join(f'File "/srv/app/module_{k}.py", line {k}, in render' for k in range(2000)) + "\nKeyError: 'x'"
    error = "Internal server error\n" + "\n".join(f"at /srv/app/part{k}.js: line {k}" for k in range(500))
    rows = [(1, "body", "a.example", trace, None, None), (2, "body", "a.example", error, None, None), (3, "body", "a.example", "Page not found. " * 400, None, None)]
    rows += [(4, "body", "a.example", "Page not found. " * 400 + "The quiet market of the old town was never finished and the river is still open until the evening.", None, None)]
    assert {i for i, _ in found(spark, rows)} == {1, 2, 3}


def test_a_message_that_a_third_of_all_rows_hold(spark):
    rows = [(k, "title", f"s{k % 7}.example", "The lantern desk gives no answer today" if k % 3 == 0 else f"The market of word{k}", None, None) for k in range(900)]
    assert {i for i, _ in found(spark, rows)} == {k for k in range(900) if k % 3 == 0}


def test_decision_of_one_message_is_that_of_the_operator(spark):
    for text in [*CASES, *REAL]:
        parts = R.message_parts(R.masked(R.canonical(text), "some-site.example"))
        if text.strip() and not R.slot_in(text) and not R.filler_in(text):
            assert R.message_is_case(parts, lambda p: False) <= R.may_be_notice(R.canonical(text)), text


@pytest.mark.parametrize("text", ["Katrefa Forum", "katrefaforum.example", "Katrefa-Forum"])
def test_site_is_masked(text):
    assert R.masked(f"{text} error 12.5 on 2024-01-02 a0b1c2d3", "www.katrefaforum.example") == "§ error # on # ¤"


def test_fast_patterns_find_what_the_plain_ones_find():
    """Patterns that begin with a character, and guards, against the plain forms of the same rules."""
    rng = random.Random(1)
    plain = {
        R._DATE: r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b", R._STATUS: r"(?<![\w.,-])[45]\d\d(?![\w.,-])", R._SPLIT: r"\n+|(?<=[.!?:])\s+",
        R._SLOT_SIGN: r"(?i:[{<%$@\[&]|__|_p)", R._FILE_SIGN: r"/[\w.]|\.(?:p|js|htm)", R._site("www.ab4a.example"): r"\ba[\s_-]?b[\s_-]?4[\s_-]?a\b",
    }
    for _ in range(4000):
        text = "".join(rng.choice(["4", "04", "12", "a", "b", "ab4a", "-", ".", ",", "/", "_", "p", "P", " ", "\n", "!", "{", "js", "δ", "\x85", "deadbee", "f0"]) for _ in range(rng.randrange(14)))
        for fast, rule in plain.items():
            assert [m.span() for m in fast.finditer(text)] == [m.span() for m in re.finditer(rule, text)], (rule, text)
        assert R._IDENT_SIGN.search(text) or not R._IDENT.search(text)
        words = R._WORD_OR_MARK.findall(text)
        tells = any(not R._TELLS_NOT(R._CUE_WORDS[w]) for w in words) or len(words) >= 3 and len(set(words)) <= 2
        assert R._may_tell(text) == tells, text


def test_each_message_is_split_once(monkeypatch):
    split, own = [], R.sentences
    monkeypatch.setattr(R, "sentences", lambda message: split.append(message) or own(message))
    texts = [t for t in [*CASES, *REAL, *["The quiet market of the old town. The limit of the river."] * 20] if t.strip()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), *(pa.array([x] * len(texts)) for x in ("body", "some-site.example")), pa.array(texts)], ["page_id", "field", "domain", "text"])
    assert sum(b.num_rows for b in R._features(iter([batch]))) == len(split) == len(texts)


def test_query(spark, data):
    found = R.p2_found(spark, data)
    assert found.columns == ["page_id", "field"]
    assert found.count() <= R.p2_reasons(spark, data).groupBy().sum("fields").first()[0]
