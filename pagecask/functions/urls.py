"""Addresses: one form for the archive's key, site filters, eligibility for capture.

Addresses made of plain characters are normalised by column expressions; only
the others go through an Arrow UDF, which gets null for the plain ones.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST_INPUT, LONGEST = 4096, 2048
# Parameters that only track where a visit came from.
TRACKING = r"(?:utm_[a-z0-9_]+|fbclid|gclid|dclid|gbraid|wbraid|msclkid|yclid|igshid|mc_eid|mc_cid|_ga|_gl|vero_id|oly_enc_id|oly_anon_id)"
_TRACKING = re.compile(TRACKING, re.I)
_PLAIN = r"^https?://[a-z0-9_](?:[a-z0-9._-]*[a-z0-9_])?(?:/[A-Za-z0-9._~/-]*)?(?:\?[A-Za-z0-9._~=&-]*)?(?:#.*)?$"
_DOTS = r"/\.{1,2}(?:/|\?|#|$)"
_NUMERIC_HOST = r"^https?://[0-9.]+(?:/|\?|#|$)"
_DEFAULT_PORT = {"http": 80, "https": 443}


def normalize_url(raw: str | None) -> str | None:
    """One address in normal form, or None if it is none of the web."""
    if raw is None or len(raw) > LONGEST_INPUT:
        return None
    text = re.sub(r"[\t\r\n]", "", raw.strip("".join(map(chr, range(33)))))
    scheme, _, rest = text.partition(":")
    scheme = scheme.lower()
    if scheme not in _DEFAULT_PORT:
        return None
    try:
        parts = urlsplit(f"{scheme}://" + rest.replace("\\", "/").lstrip("/"))
        host, port = parts.hostname, parts.port
        host = _host(host or "")
    except (ValueError, UnicodeError):
        return None
    if not host:
        return None
    site = host if port in (None, _DEFAULT_PORT[scheme]) else f"{host}:{port}"
    path = _without_dots(quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._|[]^\\"))
    query = quote(parts.query, safe="%/?:@!$&()*+,;=~-._|[]^\\`{}")
    pairs = parse_qsl(query, keep_blank_values=True)
    if any(_TRACKING.fullmatch(k) for k, _ in pairs):
        query = urlencode([(k, v) for k, v in pairs if not _TRACKING.fullmatch(k)], safe="*-._")
    url = urlunsplit((scheme, site, path, query, ""))
    return url if len(url) <= LONGEST else None


def _host(host: str) -> str:
    if host.startswith("[") or ":" in host:
        return f"[{ipaddress.IPv6Address(host.strip('[]')).compressed}]"
    if not host.isascii():
        host = host.encode("idna").decode()
    if not host or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|]", host):
        raise ValueError(host)
    if re.fullmatch(r"[0-9.]+", host):
        nums = [int(x) for x in host.rstrip(".").split(".")]
        if len(nums) > 4 or any(n > 255 for n in nums[:-1]) or nums[-1] >= 256 ** (5 - len(nums)):
            raise ValueError(host)
        value = nums[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(nums[:-1]))
        return str(ipaddress.IPv4Address(value))
    return host.lower()


def _without_dots(path: str) -> str:
    out: list[str] = []
    steps = path.split("/")[1:]
    for k, step in enumerate(steps):
        last = k == len(steps) - 1
        low = step.lower().replace("%2e", ".")
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(step)
    return "/" + "/".join(out)


@F.pandas_udf(T.StringType())
def _normalize_rest(raw: pd.Series) -> pd.Series:
    return raw.map(normalize_url, na_action="ignore")


def normalized_url(raw: Column) -> Column:
    """``normalize_url`` of a column."""
    text = F.trim(raw)
    plain = text.rlike(_PLAIN) & ~text.rlike(_DOTS) & ~text.rlike(_NUMERIC_HOST) & (F.length(text) <= LONGEST)
    bare = F.regexp_replace(text, r"#.*$", "")
    bare = F.when(bare.rlike(r"^https?://[^/?]+$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"^(https?://[^/?]+)\?", "$1/?"))
    has = bare.rlike(rf"(?i)[?&]{TRACKING}(?:=|&|$)")
    # a deleted parameter has the others written again, name=value
    kept = F.regexp_replace(bare, rf"(?i)(?<=[?&]){TRACKING}(?:=[^&]*)?(?:&|$)", "")
    simple = F.regexp_replace(F.when(has, F.regexp_replace(kept, r"&$", "")).otherwise(bare), r"\?$", "")
    odd_query = has & (bare.rlike(r"[?&][^=&]+(?:&|$)") | bare.rlike(r"&&|\?&|[?&]=|~"))
    easy = plain & ~odd_query
    other = _normalize_rest(F.when(raw.isNotNull() & ~easy, raw))
    return F.when(easy, simple).otherwise(other)


def domain_of(url: Column) -> Column:
    """Host of a normalised address, with ``www.`` if it has it."""
    return F.regexp_extract(url, r"^https?://(\[[^\]]*\]|[^/:?#]*)", 1)


def in_site(domain: Column, site: str) -> Column:
    """The site itself or a subdomain of it."""
    return (domain == site) | domain.endswith("." + site)


def in_any_site(domain: Column, sites: list[str]) -> Column:
    out = F.lit(False)
    for s in sites:
        out = out | in_site(domain, s)
    return out


def capture_reason(url: Column, excluded: list[str] | None = None) -> Column:
    """Null if a page may be captured, else why not: ineligible (no public web address) or excluded."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^@/?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    public = (
        url.rlike(r"^(?i:https?)://") & ~url.rlike(r"^[^/]+//[^/?#]*@") & host.rlike(r"\.") & ~host.rlike(r"^\[") & ~host.rlike(r"^[0-9.]+$")
        & ~host.rlike(r"\.(?:local|localdomain|internal|lan|home|corp)$")  # fixed values: names of private networks
    )
    bare = F.regexp_replace(host, r"^www\.", "")
    reason = F.when(~F.coalesce(public, F.lit(False)), "ineligible")
    return reason.when(in_any_site(bare, excluded), "excluded") if excluded else reason
