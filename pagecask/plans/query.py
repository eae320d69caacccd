"""The search language: one line of text becomes a frozen description of what to look for.

Runs on the driver; every input gives a result, nothing is refused.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, replace

from pagecask.functions.text import fold_text

DAY_MS = 86_400_000
_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}
_PRESETS = {"week": 7, "month": 30, "year": 365}
_SITE = re.compile(r"(?:(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9-]{2,}|localhost)")
_LEX = re.compile(r'(-(?=\S))?(?:"([^"]*)"?|(\S+))')
_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    quoted: bool = False


@dataclass(frozen=True)
class Query:
    phrases: tuple[Phrase, ...] = ()
    excluded: tuple[tuple[str, ...], ...] = ()
    sites: tuple[str, ...] = ()
    not_sites: tuple[str, ...] = ()
    after: int | None = None
    before: int | None = None
    saved: bool = False
    snippets: bool = False
    raw: str = field(default="", compare=False)

    @property
    def terms(self) -> list[str]:
        return [t for p in self.phrases for t in p.tokens]

    @property
    def open_end(self) -> bool:
        """Whether the last word also matches as a beginning."""
        return bool(self.phrases) and not self.phrases[-1].quoted

    @property
    def asks(self) -> bool:
        """Exclusions alone ask for nothing."""
        return bool(self.phrases or self.sites or self.not_sites or self.after is not None or self.before is not None or self.saved or self.snippets)


def start_of_day(ms: int, tz_minutes: int = 0) -> int:
    shift = tz_minutes * 60_000
    return (ms + shift) // DAY_MS * DAY_MS - shift


def date_value(text: str, now: int, tz_minutes: int = 0) -> int | None:
    """``2026-09-01`` (start of that local day) or ``7d 2w 3m 1y`` ago."""
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        try:
            day = dt.datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=dt.timezone.utc)
        except ValueError:
            return None
        return int(day.timestamp()) * 1000 - tz_minutes * 60_000
    m = re.fullmatch(r"([0-9]{1,4})([dwmy])", text.lower())
    return now - int(m[1]) * _DAYS[m[2]] * DAY_MS if m else None


def when_value(text: str, now: int, tz_minutes: int = 0) -> dict[str, int] | None:
    name, today = text.lower(), start_of_day(now, tz_minutes)
    if name == "today":
        return {"after": today}
    if name == "yesterday":
        return {"after": today - DAY_MS, "before": today}
    return {"after": now - _PRESETS[name] * DAY_MS} if name in _PRESETS else None


def site_value(text: str) -> str | None:
    site = re.sub(r"^www\.", "", fold_text(text).strip("."))
    return site if _SITE.fullmatch(site) else None


def _operator(q: Query, key: str, value: str, negated: bool, now: int, tz: int) -> Query | None:
    """The query with one operator applied, or None if the words are not an operator."""
    if key == "site":
        site = site_value(value)
        if site is None:
            return None
        return replace(q, not_sites=(*q.not_sites, site)) if negated else replace(q, sites=(*q.sites, site))
    if negated:
        return None
    if key in ("after", "before"):
        at = date_value(value, now, tz)
        return None if at is None else replace(q, **{key: at})
    if key == "when":
        span = when_value(value, now, tz)
        return None if span is None else replace(q, **span)
    if key == "is":
        flag = {"saved": "saved", "snippet": "snippets"}.get(value.lower())
        return replace(q, **{flag: True}) if flag else None
    return None


def parse_query(text: str, now: int, tz_minutes: int = 0) -> Query:
    """Words and "phrases", each negated by a leading ``-``; site: after: before: when: is: while unquoted.

    Later dates win over earlier ones, sites add up; what is no valid operator
    is words; a word with marks inside is a phrase of its parts.
    """
    q = Query(raw=text)
    for m in _LEX.finditer(text):
        negated, quoted = m[1] is not None, m[3] is None
        word = m[2] if quoted else m[3]
        key, colon, value = word.partition(":")
        if not quoted and colon and re.fullmatch("[A-Za-z]+", key):
            applied = _operator(q, key.lower(), value, negated, now, tz_minutes)
            if applied is not None:
                q = applied
                continue
        own = tuple(_TOKEN.findall(fold_text(word)))
        if own and negated:
            q = replace(q, excluded=(*q.excluded, own))
        elif own:
            q = replace(q, phrases=(*q.phrases, Phrase(own, quoted)))
    return q
