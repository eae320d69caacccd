"""Main content of pages without the site's furniture (problem 3).

Each line of a body is a block.  The first pass classifies blocks by stop-word
density, length, link density, and the density of words that address the
reader or speak of the site; the second lets the short and the addressed
blocks that it leaves undecided inherit the label of the nearest decided
neighbour.  Usual menu entries and notices, as lists, add what stands alone
between paragraphs; ``wording=False`` leaves the lists out.  All evidence lies in the page itself, so a
page is one row in and its blocks out, without a shuffle, whatever the number
of pages.

Defined results
    null and empty bodies and headings have no furniture; an empty line is no
    furniture; a text of undecided blocks only is kept; at equal distance the
    block after decides, since a heading stands before its text; item numbers count from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagecask.llm.residue import page_fields, residue_fields
from pagecask.llm.visual_form import canonical, latin_skeleton
from pagecask.llm.wording import ADDRESS, STOP_WORDS

#: A line of so many words with STOP_DENSITY of them stop words, or ending as a sentence, is the page's own text.
LONG_WORDS = 12
STOP_DENSITY = 0.18
#: Ambiguous blocks have at most so many words; longer ones that are no list of links are text.
SHORT_WORDS = 7
#: A block with an end mark and more words than this is a sentence even without stop words.
SHORT_SENTENCE = 4
#: Share of a line's words that lie in link-like items from which it is a list of links.
LINK_DENSITY = 0.75
#: A short line without an end mark and function words is a list of entries if so many of its words are capitalised.
CAPITAL_DENSITY, CAPITAL_WORDS = 0.5, 14
#: A line of at most so many words, of which so many address the reader or speak of the site, follows its neighbours; with more it is furniture.
ADDRESS_DENSITY, TALK_DENSITY, ADDRESS_WORDS = 0.04, 0.15, 30
#: So many short undecided lines in a row, of at most so many words each, are a menu.
RUN_LINES, RUN_WORDS = 3, 3
#: Longest line that a legal sign, an e-mail address or a telephone number makes furniture.
MARKED_WORDS = 15

# Words with which a site speaks of itself, in the eight languages.
SITE_TALK = ADDRESS | frozenset(
    """website site page email e-mail newsletter cookie cookies javascript scripts menu privacy account partners
    webseite seite datenschutz konto gerät daten privée confidentialité courriel sitio boletín privacidad correo
    boletim privacidade nieuwsbrief gegevens apparaat ιστότοπος ιδιωτικότητα ιδιωτικότητά ενημερωτικό δελτίο
    сайт приватность приватности рассылка рассылку файлы""".split()
)

# Entries of menus, footers and share bars, and titles of side boxes.
MENU = frozenset(
    x.strip()
    for x in """home|news|search|shop|topics|sign in|subscribe|contact|contact us|archive|archives|about us|about|my account|help|cart|blog|items|read|articles|guides|login|log in|register|faq|sitemap|menu
    |skip to main content|skip to content|back to top|advertisement|sponsored|email|print|copy link|share|share this|terms of use|privacy policy|privacy|imprint|cookies|cookie policy|english|deutsch|français|español|português|nederlands|ελληνικά|русский
    |leave a comment|leave a reply|comments|newsletter|categories|follow us|about this site|related posts|related articles|tags|most read this week|most read|you might also like|recent posts
    |startseite|aktuelles|suche|laden|themen|anmelden|kontakt|archiv|über uns|mein konto|hilfe|warenkorb|zum inhalt springen|nach oben|anzeige|werbung|drucken|e-mail|beitrag teilen|teilen|impressum|datenschutz|agb
    |kommentar schreiben|kategorien|ähnliche beiträge|schlagwörter|das könnte sie auch interessieren
    |accueil|actualités|rechercher|boutique|rubriques|connexion|qui sommes-nous|mon compte|aide|panier|aller au contenu|haut de page|publicité|courriel|imprimer|partager|mentions légales|confidentialité|plan du site
    |laisser un commentaire|lettre d'information|à lire aussi|sur le même sujet|mots-clés
    |inicio|noticias|buscar|tienda|temas|iniciar sesión|contacto|hemeroteca|quiénes somos|mi cuenta|ayuda|carrito|saltar al contenido|volver arriba|publicidad|correo|imprimir|compartir|aviso legal|privacidad|mapa del sitio
    |deje un comentario|boletín|secciones|artículos relacionados|también le puede interesar|etiquetas|síganos
    |início|notícias|loja|assuntos|entrar|contato|acervo|quem somos|minha conta|ajuda|carrinho|ir para o conteúdo|voltar ao topo|publicidade|compartilhar|privacidade|mapa do site
    |deixe um comentário|boletim|seções|leia também|talvez você goste
    |nieuws|zoeken|winkel|onderwerpen|inloggen|archief|over ons|mijn account|hulp|winkelwagen|naar de inhoud|naar boven|advertentie|afdrukken|delen|voorwaarden|colofon
    |reageer|nieuwsbrief|rubrieken|lees ook|misschien ook interessant|trefwoorden
    |αρχική|νέα|εύρεση|κατάστημα|θέματα|σύνδεση|επικοινωνία|παλαιότερα|ποιοι είμαστε|ο λογαριασμός μου|βοήθεια|καλάθι|μετάβαση στο περιεχόμενο|επιστροφή στην κορυφή|διαφήμιση|εκτύπωση|κοινοποίηση|όροι χρήσης|απόρρητο|χάρτης
    |αφήστε σχόλιο|ενημερωτικό δελτίο|κατηγορίες|σχετικά άρθρα|ετικέτες|διαβάστε επίσης
    |главная|новости|найти|магазин|темы|войти|контакты|подшивка|о нас|мой кабинет|помощь|корзина|перейти к содержанию|наверх|реклама|почта|печать|поделиться|условия|конфиденциальность|карта сайта
    |оставить комментарий|рассылка|разделы|читайте также|похожие материалы|метки""".replace("\n", "").split("|")
)
_LONGEST_ENTRY = max(len(x.split()) for x in MENU)

# Phrase rules for notices, prompts and legal lines. Their usual wording, by language, from the start of the line.
_NOTICES = r"""
(?:this (?:web)?site|we) (?:uses?|stores?|sets?)\b.{0,40}\bcookies\b.* | .{1,60} and our \d* ?partners value your privacy.* | (?:we|.{1,40}) (?:value|respect)s? your privacy.* | by continuing (?:to|you)\b.*
sign up for (?:our|the)\b.*newsletter.* | subscribe to (?:our|the)\b.* | leave a (?:reply|comment)\b.* | your email address will not be published.* | (?:please )?(?:log|sign) in to (?:comment|reply).* | follow us(?: on .{0,30})? | share this(?: page| article| post)?(?::.*)?
scripts are off, so .* | some features of this (?:page|site) need javascript.* | enable javascript for .* | (?:please )?(?:enable|allow) (?:javascript|cookies)\b.{0,60} | powered by .{1,80}(?:made with .*)? | (?:©|\(c\)|copyright) ?\d{4}.* | © .*
.{1,60} speichert daten auf ihrem gerät.* | wir verwenden cookies.* | jetzt unseren newsletter abonnieren.* | (?:melden|abonnieren) sie .{0,40}newsletter.* | alle rechte vorbehalten.*
.{1,60} respecte votre vie privée.* | nous utilisons des cookies.* | inscrivez-vous à notre .* | tous droits réservés.* | abonnez-vous à .{0,60}
.{1,60} cuida su privacidad.* | usamos cookies .* | utilizamos cookies.* | suscríbase a .{0,60} | todos los derechos reservados.*
.{1,60} respeita a sua privacidade.* | assine o nosso .{0,40} | todos os direitos reservados.* | inscreva-se .{0,60}
.{1,60} bewaart gegevens op uw apparaat.* | wij gebruiken cookies.* | schrijf u in voor .{0,60} | alle rechten voorbehouden.*
(?:το )?.{1,60} σέβεται την ιδιωτικότητά σας.* | χρησιμοποιούμε cookies.* | εγγραφείτε στο .{0,60} | με επιφύλαξη παντός δικαιώματος.*
.{1,60} заботится о вашей приватности.* | мы используем файлы cookie.* | подпишитесь на .{0,60} | все права защищены.*
.{1,60}\btel\. ?[\d +()/-]{6,}.* | .{0,80}\bmail@[\w.-]+ | .{0,80}\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\s*
"""
NOTICE = re.compile("|".join(f"(?:{p.strip()})" for line in _NOTICES.strip().split("\n") for p in line.split(" | ")))

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_ITEMS = re.compile(r"\s+[·|>›»•]\s+|\s{2,}|\s*/\s*")
_MARKS = re.compile(r"[©®℗]|\(c\) ?\d{4}|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b(?:tel|fax)\b\W{0,3}\d|(?:^|\s)(?:[a-z0-9-]+\.)+[a-z]{2,}\.?$|\+?\d[\d ()/-]{7,}\d")
_MARK_SIGN = re.compile(r"[©®℗(@.\d]")
_WRAP = ",.;:()'\"!?…"
_DATED = re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\s|\d{4}-\d{2}-\d{2}\s")
_LABEL = re.compile(r"([^:;.!?]{2,40}?)\s*:\s+(.+)")
_ENTRY_TAIL = re.compile(r"\s*\(\d+\)$|\s+\d+$")
_BULLET = re.compile(r"(?:[-*•]|\d{1,2}[.)])\s+")
_SENTENCE_END = (".", "!", "?", ":", "…", '."', ".”", ".»", ";")
_COUNTS = re.compile(r"[★♥↗☆✓»«%€$£]|\[[\d.,]+\]|\(\d+ ?%\)")


def _entry(item: str) -> str:
    return _ENTRY_TAIL.sub("", item.strip(" .:·|>›»#")).strip()


@lru_cache(50_000)
def _only_menu(line: str) -> bool:
    """Whether a line is nothing but menu entries, with or without separators."""
    words = _ENTRY_TAIL.sub("", re.sub(r"\(\d+\)", " ", line)).replace(":", " ").replace("/", " ").split()
    k = 0
    while k < len(words):
        for n in range(min(_LONGEST_ENTRY, len(words) - k), 0, -1):
            if " ".join(words[k : k + n]).strip(" .·|>›") in MENU:
                k += n
                break
        else:
            return False
    return bool(words)


def _link_density(line: str) -> float:
    """Share of the line's words that lie in link-like items: short, between separators, not a sentence."""
    items = [x for x in _ITEMS.split(line) if x]
    if len(items) < 2:
        return 0.0
    total = linked = 0
    for item in items:
        n = len(item.split())
        total += n
        if n <= 4 and not item.endswith((".", ",")):
            linked += n
    return linked / total if total else 0.0


MAIN, FURNITURE, UNDECIDED, ADDRESSED = 0, 1, 2, 3


def by_density(line: str, low: str, words: list[str]) -> int:
    """Label of one block by its densities: list items, function words, sentences, link-like items, capitals, address of the reader."""
    n = len(words)
    if _BULLET.match(low) and n > 2:
        return MAIN  # list items of the page's own text
    if n <= MARKED_WORDS and _MARK_SIGN.search(low) and _MARKS.search(low):
        return FURNITURE  # legal and contact lines
    ends = low.endswith(_SENTENCE_END)
    if ends and n > ADDRESS_WORDS:
        return MAIN
    plain = [w.strip(_WRAP) for w in words]
    talk = sum(w in SITE_TALK for w in plain) if n <= ADDRESS_WORDS and not SITE_TALK.isdisjoint(plain) else 0
    addressed = talk > 0 and sum(w in ADDRESS for w in plain) >= max(1, ADDRESS_DENSITY * n)
    if talk >= max(2, TALK_DENSITY * n) or addressed and not ends:
        return FURNITURE
    if n > LONG_WORDS and ends and not addressed:
        return MAIN
    link = _link_density(low) if n <= 30 else 0.0
    if addressed and link > 0:
        return FURNITURE
    stops = sum(w in STOP_WORDS for w in plain) / n
    if _DATED.match(low) and n <= 8 and not low.endswith("."):
        return FURNITURE  # a dated link to another page
    if all(w.startswith("#") and len(w) > 1 for w in words):
        return FURNITURE  # tags
    label = _LABEL.fullmatch(low)
    if label and not low.endswith("."):
        parts = label.group(2).split("; ")
        if len(parts) > 1 and all(len(p.split()) <= 6 for p in parts):
            return FURNITURE  # a labelled list of links
    if link >= LINK_DENSITY:
        return FURNITURE
    if n <= 10 and _COUNTS.search(low) and not low.endswith("."):
        return FURNITURE  # counters and offers
    if addressed:
        return ADDRESSED
    if ends and (stops >= STOP_DENSITY or n > SHORT_SENTENCE):
        return MAIN
    capitals = sum(w[:1].isupper() for w in line.split() if w[:1].isalpha())
    if not ends and 3 <= n <= CAPITAL_WORDS and stops < STOP_DENSITY and capitals >= max(3, CAPITAL_DENSITY * n):
        return FURNITURE  # entries without separators
    if n > SHORT_WORDS:
        return MAIN
    # a subheading: short, without an end mark, with a function word or an elided article
    if n >= 3 and (stops >= STOP_DENSITY or "'" in words[0] or "’" in words[0]):
        return MAIN
    return UNDECIDED


def by_wording(line: str, low: str, n: int) -> bool:
    """Whether a block is made of usual menu entries or is a usual notice, in plain letters or look-alikes."""
    if n > ADDRESS_WORDS:
        return n <= 40 and _only_menu(low)
    if NOTICE.fullmatch(low) or _only_menu(low):
        return True
    label = _LABEL.fullmatch(low)
    if label and label.group(1).strip() in MENU and not low.endswith("."):
        return True
    latin = latin_skeleton(line) if n <= LONG_WORDS else line
    if latin == line:
        return False
    latin = latin.strip().lower()
    return _only_menu(latin) or bool(NOTICE.fullmatch(latin))


def first_pass(line: str, wording: bool = True) -> int:
    """Label of one block by itself: by its densities, and where these leave it short or addressed, by its wording."""
    low = line.strip().lower()
    if not low:
        return UNDECIDED
    words = low.split()
    label = by_density(line, low, words)
    if not wording or label == FURNITURE or label == MAIN and (len(words) > LONG_WORDS or _BULLET.match(low)):
        return label
    if by_wording(line, low, len(words)):
        return FURNITURE
    return label


def _mark_runs(lines: list[str], labels: list[int]) -> None:
    """Short undecided lines in a row become a menu; headings stand alone."""
    k = 0
    while k < len(labels):
        e = k
        while e < len(labels) and labels[e] == UNDECIDED and 0 < len(lines[e].split()) <= RUN_WORDS:
            e += 1
        if e - k >= RUN_LINES:
            labels[k:e] = [FURNITURE] * (e - k)
        k = max(e, k + 1)


def label_blocks(lines: list[str], wording: bool = True) -> list[int]:
    """Both passes: MAIN or FURNITURE for every line; without ``wording`` by densities and neighbours alone."""
    labels = [first_pass(x, wording) for x in lines]
    _mark_runs(lines, labels)
    decided = [k for k, x in enumerate(labels) if x < UNDECIDED]
    if len(decided) == len(labels):
        return labels
    out = list(labels)
    before = None
    following = iter(decided)
    after = next(following, None)
    for k, x in enumerate(labels):
        if x < UNDECIDED:
            before = k
            continue
        while after is not None and after < k:
            after = next(following, None)
        if not lines[k].strip() or before is None and after is None:
            out[k] = MAIN
        elif before is not None and after is not None and k - before == after - k:
            # a heading stands before its text, a prompt beside the furniture
            out[k] = max(labels[before], labels[after]) if x == ADDRESSED else labels[after]
        elif after is None or before is not None and k - before < after - k:
            out[k] = labels[before]
        else:
            out[k] = labels[after]
    return out


@lru_cache(50_000)
def furniture_heading(item: str) -> bool:
    """Whether a heading is the title of a side box; all others are the page's own."""
    low = _entry(item.lower())
    return bool(low) and (low in MENU or bool(NOTICE.fullmatch(low)))


def body_lines(text: str) -> list[str]:
    """The lines as they look; as many as the text itself has."""
    own = text.split("\n")
    look = canonical(text).split("\n")
    return look if len(look) == len(own) else [canonical(x).replace("\n", " ") for x in own]


def _furniture(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, fields, numbers = [], [], []
        for i, body, headings in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for k, x in enumerate(label_blocks(body_lines(body)) if body else ()):
                if x == FURNITURE:
                    ids.append(i), fields.append("body"), numbers.append(k + 1)
            for k, item in enumerate(headings.split(" · ") if headings else ()):
                if furniture_heading(canonical(item)):
                    ids.append(i), fields.append("headings"), numbers.append(k + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(numbers, pa.int32())], ["page_id", "field", "item_no"]
        )


def page_furniture(contents: DataFrame) -> DataFrame:
    """(page_id, field, item_no) of every line of ``body`` and item of ``headings`` that belongs to the site."""
    return contents.select("page_id", "body", "headings").mapInArrow(_furniture, "page_id long, field string, item_no int")


def main_text(contents: DataFrame) -> DataFrame:
    """(page_id, body, headings) with only the page's own lines and headings."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies, heads = [], [], []
            for i, body, headings in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(i)
                bodies.append(None if body is None else "\n".join(
                    x for x, own in zip(body.split("\n"), label_blocks(body_lines(body)), strict=True) if own == MAIN
                ))
                heads.append(None if headings is None else " · ".join(x for x in headings.split(" · ") if not furniture_heading(canonical(x))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.string()), pa.array(heads, pa.string())], ["page_id", "body", "headings"])

    return contents.select("page_id", "body", "headings").mapInArrow(keep, "page_id long, body string, headings string")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    unusable = residue_fields(*page_fields(spark, sf_dir)).where("field = 'body'").select("page_id").hint("merge")  # a share of all pages
    contents = spark.read.parquet(f"{sf_dir}/contents.parquet")
    return page_furniture(contents).join(unusable, "page_id", "left_anti")
