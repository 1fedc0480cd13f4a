"""URL canonicalisation, host and registered domain, as Arrow-batched column functions.

The canonical form is the key of the frontier, so every step is deterministic: control characters out,
scheme inferred and lower-cased, host lower-cased and punycoded, default ports, tracking parameters and
fragments dropped, escapes and dot segments resolved, parameters sorted.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass, field
from urllib.parse import quote, quote_from_bytes, unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track, beside the prefix utm_.
TRACKING = frozenset("fbclid gclid gclsrc dclid msclkid mc_cid mc_eid _ga _gl igshid ref ref_src ref_url source yclid wickedid".split())
#: Path endings that are never pages.
NON_HTML = frozenset(
    """.jpg .jpeg .png .gif .webp .svg .ico .bmp .tiff .css .js .mjs .map .json .xml .rss .atom .zip .gz .tar .rar .7z .bz2 .exe .dmg .pkg .deb
.rpm .msi .mp3 .mp4 .avi .mov .mkv .webm .flac .wav .ogg .pdf .doc .docx .xls .xlsx .ppt .pptx .woff .woff2 .ttf .eot .otf""".split()
)
MAX_URL = 2048
#: Labels under which registries of countries give names; a.<label>.<country> is a name then.
SECOND_LEVEL = frozenset("ac biz co com edu firm gen go gob gouv gov govt gub idf ind info int k12 ltd me mil mod muni museum name ne net nhs nic nom or org plc police pro res sch school web".split())
#: Countries that register names of these labels directly.
FLAT = frozenset("de fr nl ch at be se no dk fi cz ie lu li ca us eu es it ru me co tv io ai".split())
#: Exceptions to FLAT, and suffixes of hosting services.
SUFFIXES = frozenset(
    """gov.it edu.it gov.ie gc.ca com.es nom.es org.es gob.es edu.es com.fr asso.fr nom.fr gouv.fr co.at or.at ac.at gv.at co.no com.ru org.ru net.ru pp.ru ac.be
com.co net.co nom.co org.co edu.co gov.co mil.co co.me net.me org.me edu.me ac.me gov.me com.io gov.us fed.us k12.ca.us github.io gitlab.io blogspot.com pages.dev web.app netlify.app vercel.app herokuapp.com""".split()
)


def load_suffixes(path: str) -> frozenset:
    """Rules of a public suffix list file (one a line, comments with //, wildcards and exceptions kept)."""
    with open(path, encoding="utf-8") as f:
        return frozenset(x.split()[0].lower() for x in f if x.strip() and not x.startswith("//"))


_PARTS = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)
_SCHEME = re.compile(r"[^/?#]*:")
_AUTHORITY = re.compile(r"(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::(\d*))?$", re.S)
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|[^A-Za-z0-9\-._~/:@!$&'()*+,;=]")
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


@dataclass(frozen=True)
class UrlRules:
    """What a run may change: the default scheme, further tracking parameters, prefilter switches."""

    default_scheme: str = "https"
    tracking: frozenset = TRACKING
    allow_ip_hosts: bool = False
    allow_nonhtml: bool = False
    exclude_hosts: frozenset = field(default_factory=frozenset)


class Rejected(ValueError):
    """No canonical form; the message is the reason."""


def _escape(m: re.Match) -> str:
    s = m.group()
    if len(s) == 3 and s[0] == "%":
        c = chr(int(s[1:], 16))
        return c if c in _PLAIN else s.upper()
    return quote(s, safe="", errors="replace")


def _resolve_dots(path: str) -> str:
    """Dot segments out, as RFC 3986 section 5.2.4 orders; empty segments stay."""
    if "." not in path:
        return path
    rooted = path.startswith("/")
    todo = path[1:].split("/") if rooted else path.split("/")
    kept: list[str] = []
    for k, seg in enumerate(todo):
        final = k == len(todo) - 1
        if seg == "..":
            if kept:
                kept.pop()
            if final:
                kept.append("")
        elif seg == ".":
            if final:
                kept.append("")
        else:
            kept.append(seg)
    return ("/" if rooted else "") + "/".join(kept)


def canonical_host(host: str) -> str:
    """Lower case without final dots; names beyond ASCII as punycode; addresses as they are."""
    host = host.lower()
    if host.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(host[1:-1].split('%')[0]) and host[1:-1]}]"
        except ValueError:
            raise Rejected("bad_host") from None
    host = host.rstrip(".")
    if host.isascii():
        return host
    try:
        import idna

        return idna.encode(host, uts46=True).decode("ascii")
    except Exception:  # noqa: BLE001 - any refusal falls back
        try:
            return host.encode("idna").decode("ascii")
        except (UnicodeError, ValueError):
            return host


def canonical_url(raw: str | None, rules: UrlRules = UrlRules()) -> str:
    """The canonical form of one URL; raises Rejected with a reason."""
    s = "".join(c for c in raw or "" if unicodedata.category(c)[0] != "C").strip()
    if not s:
        raise Rejected("empty")
    if "://" not in s.split("?", 1)[0].split("#", 1)[0] and not _SCHEME.match(s.split("/", 1)[0]):
        s = f"{rules.default_scheme}://{s}"
    m = _PARTS.match(s)
    if not m:
        raise Rejected("bad_scheme")
    scheme, authority, path, query = m.group(1).lower(), m.group(2), m.group(3), m.group(4)
    if scheme not in ("http", "https"):
        raise Rejected("bad_scheme")
    a = _AUTHORITY.match(authority)
    if not a:
        raise Rejected("bad_port")
    user, host, port = a.groups()
    host = canonical_host(host)
    if not host:
        raise Rejected("no_host")
    if port and int(port) > 65535:
        raise Rejected("bad_port")
    shown = "" if not port or int(port) == {"http": 80, "https": 443}[scheme] else f":{int(port)}"
    path = _resolve_dots(_ESCAPE.sub(_escape, path))
    out = f"{scheme}://{user + '@' if user is not None else ''}{host}{shown}{'' if path == '/' else path}"
    if query:
        pairs = []
        for part in query.split("&"):
            if part:
                k, _, v = part.partition("=")
                k, v = unquote_plus(k, errors="replace"), unquote_plus(v, errors="replace")
                if k.lower() not in rules.tracking and not k.lower().startswith("utm_"):
                    pairs.append((k, v))
        if pairs:
            enc = lambda x: quote_from_bytes(x.encode("utf-8", "replace"), safe="-._~")
            out += "?" + "&".join(f"{enc(k)}={enc(v)}" for k, v in sorted(pairs))
    return out


def canonical(c: Column, rules: UrlRules = UrlRules()) -> Column:
    """struct(url_norm, reject_reason) of a raw URL column; one of the two is null.

    Nulls and blanks are rejected as empty, malformed addresses and ports by their reason; no input
    raises.  Marked non-deterministic so that reading both fields evaluates it once."""

    @F.pandas_udf("url_norm string, reject_reason string")
    def run(s: pd.Series) -> pd.DataFrame:
        norm, why = [], []
        for x in s:
            try:
                norm.append(canonical_url(x, rules))
                why.append(None)
            except Rejected as e:
                norm.append(None)
                why.append(str(e))
            except Exception:  # noqa: BLE001 - one bad row must not fail a task
                norm.append(None)
                why.append("malformed")
        return pd.DataFrame({"url_norm": norm, "reject_reason": why})

    return run.asNondeterministic()(c)


# Native expressions on canonical URLs (ASCII, one shape), which the optimizer sees through.


def host_of(c: Column) -> Column:
    """Host of a canonical URL: user part and port off."""
    return F.regexp_extract(c, r"^[a-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)


def path_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def path_depth(c: Column) -> Column:
    """Number of non-empty path segments."""
    return F.size(F.filter(F.split(path_of(c), "/"), lambda x: x != ""))


def is_ip(host: Column) -> Column:
    """IPv4 of four numbers up to 255, or a bracketed IPv6 address."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return host.rlike(rf"^{octet}(?:\.{octet}){{3}}$") | host.rlike(r"^\[[0-9a-fA-F:.]+\]$")


def registered_domain(host: Column, suffixes: frozenset | None = None) -> Column:
    """The label before the public suffix, and the suffix; the host where there is none.

    ``suffixes`` are the rules of a list (load_suffixes): the longest one that the host ends with counts,
    *.x takes one label more, !y.x none.  Without a list a suffix is the last label, or two labels where a
    country gives names below the usual labels (com.my, gov.pl) or the small table says so."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - (k - 1), F.lit(1)), k), ".")
    whole = host.isNull() | (host == "") | is_ip(host)
    if suffixes is None:
        tld, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
        two = last(2).isin(sorted(SUFFIXES)) | ((F.length(tld) == 2) & ~tld.isin(sorted(FLAT)) & second.isin(sorted(SECOND_LEVEL)))
        return F.when(whole | (n <= 2), host).when(last(3).isin(sorted(x for x in SUFFIXES if x.count(".") == 2)), last(4)).when(two, last(3)).otherwise(last(2))
    depth = max((x.count(".") + 1 for x in suffixes), default=1)
    rules = {k: sorted(x for x in suffixes if x.count(".") == k - 1) for k in range(1, depth + 1)}
    out = None
    for k in range(depth, 0, -1):  # the longest suffix first
        plain = [x for x in rules[k] if x[0] not in "*!"]
        wild, exempt = [x[2:] for x in rules[k] if x.startswith("*.")], [x[1:] for x in rules[k] if x.startswith("!")]
        hit = F.lit(False)
        if plain:
            hit = last(k).isin(plain)
        if wild:
            hit = hit | ((n >= k) & last(k - 1).isin(wild))
        cases = [(last(k).isin(exempt), last(k))] if exempt else []
        for cond, value in [*cases, ((n >= k) & hit, last(k + 1))]:
            out = F.when(cond, value) if out is None else out.when(cond, value)
    return F.when(whole, host).otherwise(out.otherwise(last(2)))


def prefilter(url: Column, rules: UrlRules = UrlRules()) -> Column:
    """Why a canonical URL is not fetched, or null; the first reason wins."""
    host = host_of(url)
    out = F.when(F.length(url) > MAX_URL, "url_too_long").when(~url.rlike(r"^https?:"), "bad_scheme").when(host == "", "no_host")
    if rules.exclude_hosts:
        out = out.when(host.isin(sorted(rules.exclude_hosts)), "excluded_host")
    if not rules.allow_ip_hosts:
        out = out.when(is_ip(host), "ip_literal_host")
    if not rules.allow_nonhtml:
        out = out.when(F.regexp_extract(F.lower(path_of(url)), r"(\.[^.]*)$", 1).isin(sorted(NON_HTML)), "non_html_extension")
    return out
