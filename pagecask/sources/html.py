"""Web pages to text records: a tolerant HTML parse in an Arrow map.

Defined results: null and empty documents are ``too-little-text``; broken
markup is read as far as it goes; lengths are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

BODY, HEADINGS, DESCRIPTION, TITLE, LANG = 50_000, 5000, 1000, 500, 35
LEAST_TEXT = 200
# Elements without content of the page, elements that end a line, elements without an end tag.
SKIPPED = set("script style noscript template iframe object embed svg canvas video audio nav aside footer header form select option button input textarea dialog".split())
BLOCKS = set("p div section article main li ul ol tr table h1 h2 h3 h4 h5 h6 blockquote pre br figure figcaption dd dt dl summary details".split())
# Elements that an open element is ended by, and the ancestors beyond which this does not reach.
ENDS = {
    "p": set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "head": {"body"},
}
SCOPES = {
    "p": {"button", "table", "td", "th", "object", "template", "html"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
    "thead": {"table"}, "tbody": {"table"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "head": {"html"},
}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f​-‏ -‮⁠-⁯﻿]")
_REPEATED = re.compile(r"(^|\s)(\S{1,40})(?:\s+\2){3,}(?=\s|$)")
SCHEMA = "reason string, title string, description string, headings string, body string, lang string, truncated boolean"


def clean(text: str) -> str:
    return " ".join(_CONTROL.sub(" ", text).split())


def _hidden(attrs: dict[str, str | None]) -> bool:
    style = re.sub(r"\s", "", attrs.get("style") or "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


class _Reader(HTMLParser):
    """Keeps the texts inside and outside of the first main element, so that one pass serves both."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # tag, hides its content, is the root
        self.texts: dict[bool, list[str]] = {True: [], False: []}
        self.heads: dict[bool, list[str]] = {True: [], False: []}
        self.title = ""
        self.metas: dict[str, str] = {}
        self.lang = ""
        self.password = self.payment = self.rooted = False
        self.in_title = False
        self.head: list[str] | None = None

    @property
    def hiding(self) -> bool:
        return any(h for _, h, _ in self.stack)

    @property
    def inside(self) -> bool:
        return any(r for _, _, r in self.stack)

    def _add(self, text: str) -> None:
        self.texts[False].append(text)
        if self.inside:
            self.texts[True].append(text)

    def _end_implied(self, tag: str) -> None:
        """Ends the open elements that ``tag`` ends without an end tag of theirs."""
        again = True
        while again:
            again = False
            for open_, ended_by in ENDS.items():
                if tag not in ended_by:
                    continue
                for k in range(len(self.stack) - 1, -1, -1):
                    name = self.stack[k][0]
                    if name == open_:
                        del self.stack[k:]
                        again = True
                        break
                    if name in SCOPES[open_]:
                        break

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        attrs = dict(attributes)
        self._end_implied(tag)
        if tag == "html":
            self.lang = self.lang or (attrs.get("lang") or "")
        elif tag == "meta":
            for key in ("name", "property"):
                if attrs.get(key):
                    self.metas.setdefault(attrs[key] or "", attrs.get("content") or "")
        elif tag == "input":
            self.password |= (attrs.get("type") or "").lower() == "password"
            self.payment |= (attrs.get("autocomplete") or "").startswith("cc-")
        self.in_title = tag == "title" and not self.title
        root = not self.rooted and (tag in ("main", "article") or attrs.get("role") == "main")
        self.rooted |= root
        hides = _hidden(attrs) or tag in SKIPPED and not root
        if tag in BLOCKS and not self.hiding and not hides:
            self._add(" ")
        if tag not in VOID:
            self.stack.append((tag, hides, root))
        if tag in ("h1", "h2", "h3") and not _hidden(attrs):
            self.head = []

    def handle_endtag(self, tag: str) -> None:
        self.in_title = False
        if tag in ("h1", "h2", "h3") and self.head is not None:
            self.heads[False].append("".join(self.head))
            if self.inside:
                self.heads[True].append("".join(self.head))
            self.head = None
        if any(t == tag for t, _, _ in self.stack):
            if tag in BLOCKS and not self.hiding:
                self._add(" ")
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
            return
        if self.head is not None:
            self.head.append(data)
        if not self.hiding and not any(t == "head" for t, _, _ in self.stack):
            self._add(_CONTROL.sub(" ", data))


def extract(html: str | None, *, deep: bool = True, least: int | None = None, content_type: str | None = None) -> dict:
    """One page as a record; ``reason`` says why there is none."""
    nothing = dict.fromkeys(("title", "description", "headings", "body", "lang")) | {"truncated": False}
    if content_type and "html" not in content_type.lower():
        return nothing | {"reason": "not-html"}
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    if deep and reader.password:
        return nothing | {"reason": "password-field"}
    if deep and reader.payment:
        return nothing | {"reason": "payment-field"}
    body, truncated = clean("".join(reader.texts[reader.rooted])), False
    body = _REPEATED.sub(r"\1\2", body)
    if len(body) > BODY:
        body, truncated = body[:BODY], True
    if len(body) < (LEAST_TEXT if least is None else least):
        return nothing | {"reason": "too-little-text"}
    description = reader.metas.get("description") or reader.metas.get("og:description") or ""
    return {
        "reason": None,
        "title": clean(reader.title)[:TITLE],
        "description": clean(description)[:DESCRIPTION],
        "headings": clean(" · ".join(reader.heads[reader.rooted]))[:HEADINGS],
        "body": body,
        "lang": reader.lang[:LANG],
        "truncated": truncated,
    }


def extract_pages(pages: DataFrame, html: str = "html", *, deep: bool = True) -> DataFrame:
    """The other columns and the record of each page."""
    keep = [f for f in pages.schema if f.name != html]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            records = pd.DataFrame([extract(h, deep=deep) for h in f[html]], columns=[c.split()[0] for c in SCHEMA.split(", ")], index=f.index)
            yield pd.concat([f.drop(columns=html), records], axis=1)

    return pages.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), SCHEMA]))
