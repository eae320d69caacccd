"""Template residue and error-page text (problem 2).

Each field is brought to one look, its site name, addresses, identifiers, dates
and numbers are masked, and equal masked sentences are grouped by an exact hash
over all sources; every sentence of every field is counted.  A message is a
case if each of its sentences recurs in RECURRING_SHARE of all sources (at
least RECURRING_SOURCES) or says by its cues that it is a notice or stands
beside one, one of them names a fault, a script, a check or a stand-in text,
and, if one without a cue has more than BESIDE_WORDS words, those without are
no more than those with one: an article that several sites copy recurs as a
notice does, but it says something else.  Unfilled slots and filler paragraphs are found by
placeholder rules.  Texts that are no case by their own sentences, whatever
recurs, are not sent on; their sentences are counted.

Defined results
    null and empty fields are no case; a slot between quotes or backticks is
    quoted and no case; a notice beside real text is no case; a field counts
    once however often it matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecask.llm.visual_form import canonical
from pagecask.llm.wording import ADDRESS, STOP_WORDS
from pagecask.operators.skew import spread_join
from pagecask.sources.scratch import written

#: Sources in which a masked sentence recurs: a share of all sources, at least so many.
RECURRING_SHARE, RECURRING_SOURCES = 0.001, 3
#: Share of a sentence's words that are cues from which it is a notice wherever it stands.
COVERED = 0.5
#: A sentence of more words is a long one; beside a long one without a cue, sentences without may not be more than those with one.
BESIDE_WORDS = 12

# The usual filler words.
FILLER_WORDS = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
    aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute
    irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non
    proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
)

# Placeholder rules: the notations in which template languages write a slot, and words that editors put in brackets.
SLOT = re.compile(
    r"""\{\{\{?\s*[#/&>^]?[\w.\- |:'"]{1,60}\}?\}\}        # {{ name }}, {{{raw}}}, {{#each items}}
    | \{%[^%{}]{1,80}%\}                                  # {% include 'x' %}
    | <%[=\-]?[^%<>]{1,80}%>                              # <%= item.price %>
    | [$\#]\{[\w.\-]{1,60}\}                              # ${a.b}, #{a}
    | (?<![\w}])\{\w{1,40}\}                              # {0}, {first_name}
    | %%\w{2,40}%% | %[A-Za-z_]{3,40}% | %\d{1,2}\$[sdf]  # %%CITY%%, %NAME%, %1$s
    | @@\w{2,40}@@ | __[A-Za-z]{3,40}__ | \$[A-Z_]{3,40}\$
    | \[\[[A-Z_]{3,40}\]\] | \[object\ Object\]
    | <!--\s*(?:slot|placeholder|insert|content|block)\b[^<>]{0,60}-->
    | (?:<|&lt;)\s*tmpl:[^<>&]{1,40}(?:>|&gt;)
    | \[(?:your|insert|quote|enter|add|title|name|tk|tbd|todo|placeholder|company|address|date|author|headline|image|link|text)
        (?:\ [\w ]{1,40})?\]
    | \b\w+_placeholder\b""",
    re.X | re.I,
)
_SLOT_SIGN = re.compile(r"[{<%$@\[&_](?:(?<!_)|[_pP])")
_SLOT_SIGNS = "{<%$@[&_"
_QUOTES = "`\"'“”„«»‘’"

_WORD = re.compile(r"[^\W_]+")
_FILLER_SIGNS = ("ipsum", "nostrud", "consectetur", "incididunt", "reprehenderit", "exercitation", "voluptate", "eiusmod")

_HOST = re.compile(r"\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b")
_FILE = re.compile(r"(?:/[\w.]+)+|\b\w+\.(?:php|py|js|html?)\b")
_IDENT = re.compile(r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{6,}\b|\b[0-9a-f]{8}\b|\b[0-9a-f]{8}(?=[a-z])")
# These begin with the character itself and look back past it, so that a search skips to where one stands.
_DATE = re.compile(r"\d(?<!\w\d)\d{0,3}[./-]\d{1,2}[./-]\d{1,4}\b")
_STATUS = re.compile(r"[45](?<![\w.,-][45])\d\d(?![\w.,-])")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_FILE_SIGN, _INNER_DOT, _DIGIT = re.compile(r"[/.](?:(?<=/)[\w.]|(?<=\.)(?:p|js|htm))"), re.compile(r"\.[a-z]"), re.compile(r"\d")
_IDENT_SIGN = re.compile(r"[0-9a-f]{6}")
_SPLIT = re.compile(r"\s(?:(?<=\n)\n*|(?<=[.!?:]\s)\s*)")
_TRIM = " \t.!?:;,…*–—-|·/\"'()«»[]"


def slot_in(text: str) -> bool:
    """Whether an unfilled slot stands in the text, other than as a quotation."""
    if not any(map(text.__contains__, _SLOT_SIGNS)) or not _SLOT_SIGN.search(text):
        return False
    for m in SLOT.finditer(text):
        before, after = text[: m.start()].rstrip()[-1:], text[m.end() :].lstrip()[:1]
        if not (before and before in _QUOTES and after and after in _QUOTES):
            return True
    return False


def filler_in(text: str) -> bool:
    """Whether a line of the text is filler: at least six words, three in four from the filler vocabulary."""
    if not any(w in text or w.upper() in text for w in _FILLER_SIGNS):
        return False
    for line in text.split("\n"):
        words = _WORD.findall(line.lower())
        if len(words) >= 6 and 4 * sum(w in FILLER_WORDS for w in words) >= 3 * len(words):
            return True
    return bool(re.fullmatch(r"lorem ipsum(?: dolor)?(?: sit)?(?: amet)?", text.strip(_TRIM).lower()))


@lru_cache(20_000)
def _site(domain: str) -> re.Pattern | None:
    """Finds the site's name: the letters of the address, with blanks or hyphens anywhere between."""
    label = domain.lower().removeprefix("www.").removeprefix("blog.").removeprefix("docs.").split(".")[0]
    letters = re.sub(r"[^a-z0-9]", "", label)
    return re.compile(rf"{letters[0]}(?<!\w{letters[0]})[\s_-]?" + r"[\s_-]?".join(letters[1:]) + r"\b") if 4 <= len(letters) <= 60 else None


def masked(text: str, domain: str) -> str:
    """Lower case; the site's name, addresses, files, identifiers, dates and numbers replaced by their kind."""
    t = text.lower()
    if _FILE_SIGN.search(t):
        t = _FILE.sub("¤", t)
    if _INNER_DOT.search(t):
        t = _HOST.sub("§", t)
    site = _site(domain or "")
    if site:
        t = site.sub("§", t)
    if _IDENT_SIGN.search(t):
        t = _IDENT.sub("¤", t)
    if _DIGIT.search(t):
        t = _NUMBER.sub("#", _STATUS.sub("‡", _DATE.sub("#", t)))
    return "\n".join(" ".join(line.split()) for line in t.split("\n")).strip()


# Cue words by what they name. Word beginnings and short phrases of notices, in the eight languages.
_CUES = {
    "fault": r"""\w*errors? \w*exception fault\w* fail\w* not\Wfound vanished nowhere withdrawn unavailable broken expired timed\Wout time-?out too\W(?:many|busy) denied
        forbidden refused blocked permission allowed answer wrong unexpected unauthori[sz]ed bad\Wgateway undefined null nan traceback stack\Wtrace problem limit\w* automated
        invalid disabled maintenance required supported switched\Woff could\Wnot cannot can't don't did\Wnot does\Wnot doesn't isn't uncaught fatal oops whoops ‡ access down
        unable removed deleted busy
        \w*fehler\w* (?:nicht|niet)\W(?:gefunden|gevonden|verfügbar) existiert\Wnicht verweigert gesperrt erreurs? introuvable ne\Wrépond\Wpas refusé indisponible
        no\W(?:se\W)?(?:hemos\W)?(?:encontrad\w*|existe) denegado erro não\W(?:foi\W)?(?:encontrad\w*|existe) negado fout\w* bestaat\Wniet geweigerd
        δεν\Wβρέθηκε δεν\Wυπάρχει σφάλμα\w* απαγορεύεται не\Wнайден\w* не\Wсуществует ошибк\w* запрещ\w* недоступ\w* interner internal""",
    "script": r"""javascript scripts? scripting noscript cookies browsers? navigateur navegador браузер\w* client""",
    "check": r"""robots? humans? captcha verify verif\w* attention\Wrequired checking\Wyour just\Wa\Wmoment one\Wmoment security\Wcheck""",
    "standin": r"""placeholder sample dummy untitled todo tbd tba fixme blindtext d'exemple exemple remplacer ersetzen replace your\Wnew first\Wpost ignore hello\Wworld \(copy
        add\Wa\W(?:description|title|text|headline)
        (?:your\W)?(?:text|title|content|copy|description|name|headline)\W(?:goes\W)?here (?:your|my)\W(?:text|title|content|headline|name) hier\W(?:steht|folgt|kommt) titre\Wde\Wla\Wpage vul\Whier tekst\Whier
        aquí\W(?:su|el)\Wtexto (?:su\W)?texto\Waquí escriba escreva\Waqui seu\Wtexto votre\Wtexte εδώ\Wμπαίνει здесь\W(?:будет|ваш)\w* введите test""",
    "action": r"""enable activate allow permit\w* switch\w* turn reload\w* retry after refresh try again log\Win sign\Win contact update check go\Wback search complet\w* below please loading wait continue
        return closed add edit delete aktivieren\w* bitte versuchen activer activez veuillez vérifiez revenez active ative schakel bekijken ενεργοποιήστε включите просмотра""",
    "thing": r"""pages? sites? websites? documents? files? links? address articles? content\w* item server gateway service connection database network requests? session resource app application
        view reader text title titel tekst texte titre texto κείμενο текст block paragraph post body seite\w* serveur adresse servidor página pagina σελίδα\w* страниц\w* code visits status http""",
}
_CUE = {name: re.compile(r"(?<![^\W_])(?:" + "|".join(words.split()) + r")(?![^\W_])") for name, words in _CUES.items()}
#: Classes of which one must be named by a notice.
TELLING = ("fault", "script", "check", "standin")
_TELLS_NOT = frozenset(TELLING).isdisjoint


def _last_word(cue: str) -> str:
    """What matches the last word of a cue; every text with the cue has such a word."""
    cue = re.sub(r"(\w+)-\?(\w+)", r"(?:\1)?\2", cue.removeprefix(r"\(").rsplit("'", 1)[-1])
    depth, start = 0, 0
    for k, c in enumerate(cue):
        depth += (c == "(") - (c == ")")
        if not depth and cue.startswith(r"\W", k):
            start = k + 2
    return cue[start:]


_LAST_WORD = {name: re.compile("|".join(map(_last_word, words.split()))) for name, words in _CUES.items()}


class _CueWords(dict):
    """Of a word, the classes of which it can end a cue; remembers the words seen, up to a bound."""

    def __missing__(self, word: str) -> frozenset[str]:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = frozenset(name for name, last in _LAST_WORD.items() if last.fullmatch(word))
        return out


_CUE_WORDS = _CueWords()
#: What may stand beside a notice: marks, numbers and the names of codes.
_CODE_NAMES = "trace|ray|ticket|request|id|reference|ref|block reference|code|incident|status|vorgang|referencia|номер обращения|код|line|line no|minutes|seconds"
_CODE_NAME = re.compile(rf"\b(?:{_CODE_NAMES})\b")
_CODE_WORDS = frozenset(re.findall(r"\w+", _CODE_NAMES)) | {"‡"}
_SIGNS = re.compile(r"[§¤#‡\W_]+")
_WORD_OR_MARK = re.compile(r"[^\W_]+|‡")
_INTERJECTION = re.compile(r"sorry|hm+|whoops|oops|ouch|uh oh|notice|alert|attention|warning")
_IDENTIFIER_FAULT = re.compile(r"\b[a-z]{3,}(?:error|exception)\b|\btraceback\b|\bstack trace\b")
_STRUCTURE = re.compile(r"""(?:§\s+)?(?:\{"(?:error|message|status)":.*\}|traceback \(most recent call last\):.*|§ [-–—|·:] ‡)""", re.S)
LONG, UNKNOWN, CUED, STRONG, BESIDE = -1, 0, 1, 2, 3


@lru_cache(50_000)
def sentence_kind(sentence: str) -> int:
    """What a masked sentence says by its cues: nothing, something if it recurs, a notice by itself, or a mere mark or number.

    It is a notice by itself if its cues are of two classes and make up half of
    its words without function words, or all of them; if it is an identifier
    of a fault; or if one or two words are repeated throughout.
    """
    words = _WORD_OR_MARK.findall(sentence)
    if all(w in _CODE_WORDS for w in words) and not _SIGNS.sub("", _CODE_NAME.sub("", sentence)):
        return CUED if "‡" in sentence else BESIDE
    if _INTERJECTION.fullmatch(sentence):
        return BESIDE
    if ("error" in sentence or "exception" in sentence or "trace" in sentence) and _IDENTIFIER_FAULT.search(sentence):
        return STRONG
    if len(words) >= 3 and len(set(words)) <= 2 and max(map(len, words)) <= 5:
        return STRONG
    names = set().union(*map(_CUE_WORDS.__getitem__, words))
    if "action" not in names and _TELLS_NOT(names):
        names = ()
    content = [] if not names else [w for w in words if w not in STOP_WORDS and w not in ADDRESS and not (w in _CODE_WORDS and _CODE_NAME.fullmatch(w))]
    named, covered = set(), set()
    for name in names:
        for m in _CUE[name].finditer(sentence):
            named.add(name)
            covered.update(_WORD_OR_MARK.findall(m.group()))
    tells = any(name in named for name in TELLING)
    share = sum(w in covered for w in content) / len(content) if content else 1.0
    if tells and share >= COVERED and (len(named) > 1 or share == 1.0):
        return STRONG
    all_words = "".join(words)
    if (len(all_words) if all_words.isalpha() else sum(map(str.isalpha, sentence))) < 0.75 * len(sentence.replace(" ", "")):
        return BESIDE if not tells else STRONG  # code rather than words
    if tells:
        return CUED
    return BESIDE if "action" in named and share >= COVERED else UNKNOWN


def sentences(message: str) -> list[str]:
    return [p.strip(_TRIM + "§") or "§" for p in _SPLIT.split(message)]


def may_be_notice(message: str, own: list[str] | None = None) -> bool:
    """Whether the sentences with a cue that tells may be enough; words alone are looked up. If not, a text is no case, whatever recurs.

    ``own``: the sentences of a masked message, which are in lower case, where they are known.
    """
    low = message.lower()
    if _STRUCTURE.fullmatch(low) or _STATUS.search(low):
        return True
    own = sentences(low) if own is None else own
    rest = [p for p in own if not _may_tell(p)]
    return len(rest) < len(own) and not _outweighed(map(_kind_or_long, rest), len(own) - len(rest))


def _kind_or_long(sentence: str) -> int:
    kind = sentence_kind(sentence)
    return LONG if kind == UNKNOWN and sentence.count(" ") >= BESIDE_WORDS else kind


def _outweighed(kinds: Iterable[int], telling: int) -> bool:
    """Whether one sentence without a cue is long and those without are more than those that tell."""
    without, long = 0, False
    for k in kinds:
        without += k <= UNKNOWN
        long |= k == LONG
        if long and without > telling:
            return True
    return False


class _Telling(dict):
    """Of what stands between two blanks, whether a word of it can end a cue that tells; remembers what was seen, up to a bound."""

    def __missing__(self, chunk: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        words = _WORD_OR_MARK.findall(chunk)
        out = self[chunk] = "‡" in words or not all(map(_TELLS_NOT, map(_CUE_WORDS.__getitem__, words)))
        return out


_TELLING = _Telling()


def _may_tell(sentence: str) -> bool:
    chunks = sentence.split()
    if any(map(_TELLING.__getitem__, chunks)):
        return True
    if len(set(filter(str.isalpha, chunks[:8]))) > 2:
        return False  # three different words
    words = _WORD_OR_MARK.findall(sentence)
    return len(words) >= 3 and len(set(words)) <= 2


def message_parts(message: str, own: list[str] | None = None) -> list[tuple[str, int]]:
    """The sentences (``own``, where they are known) of a masked message and their kinds; an error object, a stack trace or a bare status is one."""
    if _STRUCTURE.fullmatch(message):
        return [(message, STRONG)]
    return [(p, _kind_or_long(p)) for p in (sentences(message) if own is None else own)]


def message_is_case(parts: list[tuple[str, int]], recurs: Callable[[str], bool]) -> bool:
    """Every sentence is a notice, stands beside one, or recurs; and one of them is a notice or recurs with a cue.

    Beside a notice any cue will do.  If one without a cue is long and those
    without are more than those with one, it is a real text, on however many sites.
    """
    if _outweighed((k for _, k in parts), sum(k in (CUED, STRONG) for _, k in parts)):
        return False
    least = CUED if any(k == STRONG for _, k in parts) else STRONG
    return all(k >= least or recurs(p) for p, k in parts) and any(k == STRONG or k == CUED and recurs(p) for p, k in parts)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every field: what it has by itself (slot, filler), the hashes of its masked sentences, and of one that may be a message its hash and the kinds of its sentences."""
    for batch in batches:
        verdicts, messages, hashes, kinds = [], [], [], []
        for domain, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            look = canonical(text)
            verdict = "slot" if slot_in(look) else "filler" if filler_in(look) else None
            message = masked(look, domain)
            own = sentences(message)
            parts = message_parts(message, own) if verdict is None and may_be_notice(message, own) else [(p, UNKNOWN) for p in own]
            telling = sum(k in (CUED, STRONG) for _, k in parts)
            told = telling > 0 and not _outweighed((k for _, k in parts), telling)
            verdicts.append(verdict)
            messages.append(_hash(message) if told else None)
            hashes.append([_hash(p) for p, _ in parts])
            kinds.append([k for _, k in parts] if told else None)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k) for k in range(3)), pa.array(verdicts, pa.string()), pa.array(messages, pa.int64()),
                pa.array(hashes, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int32())),
            ],
            ["page_id", "field", "domain", "verdict", "message", "hashes", "kinds"],
        )


def residue_reasons(fields: DataFrame, sites: DataFrame) -> DataFrame:
    """(page_id, field, reason) of every field that is a case; a field with several reasons has a row for each.

    ``fields``: page_id, field, text; ``sites``: page_id, domain.  The sentences
    of all fields are counted by (hash, source) with map-side partial sums
    before they are counted by hash, messages are decided once a distinct
    message, and the verdict goes back to the rows in parts, so a message that
    holds a third of all rows is in no single task.
    """
    texts = fields.select("page_id", "field", "text").where(F.col("text").isNotNull() & (F.trim("text") != ""))
    domains = sites.select("page_id", F.coalesce("domain", F.lit("")).alias("domain")).hint("merge")  # grows with the pages
    found = (
        texts.join(domains, "page_id", "left").select("page_id", "field", F.coalesce("domain", F.lit("")).alias("domain"), "text")
        .mapInArrow(_features, "page_id long, field string, domain string, verdict string, message long, hashes array<long>, kinds array<int>")
    )
    found = written(found, "residue-features")
    direct = found.where("verdict is not null").select("page_id", "field", F.col("verdict").alias("reason"))
    told = found.where("message is not null").select("page_id", "field", "message", "hashes", "kinds")
    all_sources = sites.select("domain").distinct().agg(F.count("*").alias("n"))
    sources = found.select(F.xxhash64("domain").alias("source"), F.explode("hashes").alias("hash")).distinct().groupBy("hash").agg(F.count("*").alias("sources"))
    enough = F.greatest(F.lit(RECURRING_SOURCES), F.ceil(all_sources.scalar() * RECURRING_SHARE))
    recurring = sources.where(F.col("sources") >= enough).select("hash", F.lit(True).alias("_recurs"))
    kinds = told.groupBy("message").agg(F.any_value(F.arrays_zip("hashes", "kinds")).alias("parts")).select("message", F.explode("parts").alias("p"))
    kinds = kinds.select("message", F.col("p.hashes").alias("hash"), F.col("p.kinds").alias("kind"))
    each = spread_join(kinds, recurring, "hash", "message", "left").withColumn("_recurs", F.coalesce("_recurs", F.lit(False)))
    strong, cued = F.col("kind") == STRONG, F.col("kind") == CUED
    decided = each.groupBy("message").agg(
        F.bool_or(strong).alias("says"), F.bool_or(cued & F.col("_recurs")).alias("says_often"),
        F.bool_and((F.col("kind") >= STRONG) | F.col("_recurs")).alias("known"), F.bool_and((F.col("kind") >= CUED) | F.col("_recurs")).alias("known_beside"),
        F.bool_and(F.col("kind") >= CUED).alias("by_itself"),
    )
    phrase = F.col("says") & F.col("by_itself")
    case = (F.col("says") & F.col("known_beside")) | (F.col("says_often") & F.col("known"))
    cases = decided.where(case).select("message", F.when(phrase, "phrase").otherwise("recurrence").alias("reason"))
    recurs = spread_join(told.select("page_id", "field", "message"), cases, "message", "page_id").select("page_id", "field", "reason")
    return direct.unionByName(recurs)


def residue_fields(fields: DataFrame, sites: DataFrame) -> DataFrame:
    """(page_id, field) of every field that is a case, once."""
    return residue_reasons(fields, sites).select("page_id", "field").distinct()


def page_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Titles and bodies as fields, and the site of each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    titles = pages.select(F.col("id").alias("page_id"), F.lit("title").alias("field"), F.col("title").alias("text"))
    bodies = spark.read.parquet(f"{sf_dir}/contents.parquet").select("page_id", F.lit("body").alias("field"), F.col("body").alias("text"))
    return titles.unionByName(bodies), pages.select(F.col("id").alias("page_id"), "domain")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_fields(*page_fields(spark, sf_dir))


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By field and reason: how many fields are cases."""
    return residue_reasons(*page_fields(spark, sf_dir)).groupBy("field", "reason").agg(F.countDistinct("page_id").alias("fields"))
