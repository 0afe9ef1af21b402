"""URL functions: a parser after the URL standard in plain Python, and column expressions for the rest.

Normalising needs the standard's parser (relative references, dot segments,
percent-encoding, form re-serialising), so it runs in Arrow batches. What works
on absolute URLs is plain column arithmetic.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.js import trim

#: Parameters that only track, two-part suffixes, schemes that leave the site, social hosts.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "ref_src")
SECOND_LEVEL = ("co", "com", "org", "gov", "edu", "net", "mil", "int", "ac", "ad", "ae", "af", "ag")
LEAVING = ("mailto:", "tel:", "ftp:", "file:", "data:", "javascript:")
SOCIAL = ("facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "pinterest.com", "tiktok.com", "snapchat.com", "reddit.com")
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}

_CONTROLS = "".join(map(chr, range(33)))
_BREAKS = re.compile(r"[\t\n\r]")
_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):")
_PATH_OK = frozenset(b"!$%&'()*+,-./0123456789:;=@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]_abcdefghijklmnopqrstuvwxyz|~^")
_QUERY_OK = frozenset(range(0x21, 0x7F)) - frozenset(b"\"#<>'")
_FRAGMENT_OK = frozenset(range(0x21, 0x7F)) - frozenset(b'"<>`')
_USER_OK = frozenset(b"!$%&'()*+,-.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~")
_FORM_OK = frozenset(b"*-.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
_FORM_SPACED = _FORM_OK | {32}


class Url(NamedTuple):
    scheme: str
    user: str
    host: str | None
    port: str
    path: str
    query: str | None
    fragment: str | None

    def text(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//" + (self.user + "@" if self.user else "") + self.host + (":" + self.port if self.port else "")
        out += self.path
        if self.query is not None:
            out += "?" + self.query
        return out + ("#" + self.fragment if self.fragment is not None else "")

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port else "")


@lru_cache(None)
def _class(ok: frozenset) -> re.Pattern:
    """Strings of these characters alone; there are only the sets above."""
    return re.compile("[" + "".join(re.escape(chr(b)) for b in sorted(ok)) + "]*")


def _encode(s: str, ok: frozenset) -> str:
    if _class(ok).fullmatch(s):
        return s
    return "".join(chr(b) if b in ok else f"%{b:02X}" for b in s.encode("utf-8", "replace"))


def _dots(path: str) -> str:
    if "/." not in path and "%" not in path and path.startswith("/"):
        return path  # no segment begins with a dot
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        last = i == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def _number(part: str) -> int | None:
    try:
        if re.fullmatch(r"0[xX][0-9a-fA-F]*", part):
            return int(part[2:] or "0", 16)
        if re.fullmatch(r"0[0-7]+", part):
            return int(part, 8)
        return int(part) if part.isascii() and part.isdigit() else None
    except ValueError:
        return None


@lru_cache(4096)
def _host(raw: str) -> str | None:
    from urllib.parse import unquote_to_bytes

    if raw.startswith("["):
        import ipaddress

        try:
            return "[" + ipaddress.IPv6Address(raw[1:-1]).compressed + "]" if raw.endswith("]") else None
        except ValueError:
            return None
    if "%" in raw:
        raw = unquote_to_bytes(raw).decode("utf-8", "replace")
    raw = raw.lower().replace("\u3002", ".").replace("\u00ad", "")
    if not raw.isascii():
        try:
            raw = ".".join(p.encode("idna").decode() if not p.isascii() else p for p in raw.split("."))
        except UnicodeError:
            return None
    if not raw or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]", raw):
        return None
    labels = raw.rstrip(".").split(".") if raw.endswith(".") else raw.split(".")
    if labels and (labels[-1].isdigit() or re.fullmatch(r"0[xX][0-9a-fA-F]*", labels[-1])):
        numbers = [_number(p) for p in labels]
        if len(numbers) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        value = sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1])) + numbers[-1]
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    return raw


@lru_cache(4096)
def parse(href: str, base: str | None = None) -> Url | None:
    """Parse href against base as browsers do; None where that fails."""
    s = _BREAKS.sub("", href.strip(_CONTROLS))
    m = _SCHEME.match(s)
    rest, fragment = (s.split("#", 1) + [None])[:2]
    if fragment is not None:
        fragment = _encode(fragment, _FRAGMENT_OK)
    b = parse(base) if base else None
    if m:
        scheme = m[1].lower()
        rest = rest[m.end() :]
        if scheme in PORTS:
            same = b is not None and b.scheme == scheme and not re.match(r"[/\\]", rest)
            if not same:
                rest = "//" + rest.lstrip("/\\")
                return _special(scheme, rest, fragment, None)
            return _special(scheme, rest, fragment, b)
        path, query = (rest.split("?", 1) + [None])[:2]
        if path.startswith("//"):
            authority, slash, tail = path[2:].partition("/")
            return Url(scheme, "", authority.lower(), "", (slash + tail) and _dots(slash + tail), query, fragment)
        return Url(scheme, "", None, "", path, query, fragment)
    if b is None or b.host is None:
        return None
    return _special(b.scheme, rest, fragment, b)


def _special(scheme: str, rest: str, fragment: str | None, b: Url | None) -> Url | None:
    path, query = (rest.split("?", 1) + [None])[:2]
    path = path.replace("\\", "/") if scheme in PORTS else path
    query = _encode(query, _QUERY_OK) if query is not None else None
    if path.startswith("//"):
        authority, slash, tail = path.lstrip("/").partition("/")
        user, at, place = authority.rpartition("@")
        m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", place)
        host = _host(m[1]) if m else None
        if host is None or (m[2] and int(m[2]) > 65535):
            return None
        port = str(int(m[2])) if m[2] else ""
        user = ":".join(_encode(u, _USER_OK) for u in user.split(":", 1)) if at else ""
        return Url(scheme, user.removesuffix(":"), host, "" if port == PORTS.get(scheme) else port, _dots("/" + _encode(tail, _PATH_OK)), query, fragment)
    if b is None:
        return None
    if not path:
        return b._replace(query=query if query is not None else b.query, fragment=fragment)
    if not path.startswith("/"):
        path = b.path.rsplit("/", 1)[0] + "/" + path
    return b._replace(path=_dots(_encode(path, _PATH_OK)), query=query, fragment=fragment)


def _form(query: str) -> list[tuple[str, str]]:
    pairs = [(p.partition("=")[0], p.partition("=")[2]) for p in query.split("&") if p]
    return [(unquote_plus(k), unquote_plus(v)) for k, v in pairs]


def _serialise(pairs: list[tuple[str, str]]) -> str:
    enc = lambda s: _encode(s, _FORM_SPACED).replace(" ", "+")
    return "&".join(f"{enc(k)}={enc(v)}" for k, v in pairs)


def normalize(href: str | None, base: str | None, keep_fragment: bool = False, sort_query: bool = False) -> str | None:
    """The canonical form of a link, or None where it cannot be resolved."""
    if not href:
        return None
    u = parse(trim(href), base)
    if u is None:
        return None
    query = u.query
    if query is not None:
        pairs = _form(query)
        kept = [p for p in pairs if p[0].lower() not in TRACKING]
        if len(kept) < len(pairs):
            query = _serialise(kept)
        if sort_query and kept:
            query = _serialise(sorted(kept, key=lambda p: p[0]))
        query = query or None
    return u._replace(query=query, fragment=u.fragment if keep_fragment else None, path=u.path or ("/" if u.host is not None else "")).text()


def base_domain(url_or_host: str | None) -> str:
    """The registrable part of an absolute URL's host or of a bare host."""
    s = url_or_host or ""
    if "://" in s:
        u = parse(s)
        if u is None or u.host is None:
            return ""
        s = u.host
    return _registrable(s)


@lru_cache(4096)
def _registrable(s: str) -> str:
    s = s.lower().split(":", 1)[0].removeprefix("www.")
    labels = s.split(".")
    if len(labels) > 2:
        return ".".join(labels[-3:] if labels[-2] in SECOND_LEVEL else labels[-2:])
    return s


def is_external(url: str, domain: str) -> bool:
    if url.lower().startswith(LEAVING):
        return True
    u = parse(url)
    if u is None or not u.host:
        return False
    if not domain:
        return True
    mine, theirs = base_domain(domain), base_domain(u.host)
    return not (theirs == mine or theirs.endswith("." + mine))


def is_social(url: str, domains: tuple[str, ...] = SOCIAL) -> bool:
    u = parse(url)
    host = (u.host or "") if u else ""
    return any(host == d or host.endswith("." + d) for d in domains)


def normalize_col(href: Column, base: Column, keep_fragment: bool = False, sort_query: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([normalize(x, y, keep_fragment, sort_query) for x, y in zip(h, b)], dtype=object)

    return run(href, base)


def host_col(url: Column) -> Column:
    """Lower-case host of an absolute URL, '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\\]*)", 1))


def path_col(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def origin_col(url: Column) -> Column:
    """Scheme, host and port, default ports left out."""
    o = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(o, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")


def base_domain_col(url_or_host: Column) -> Column:
    s = F.when(url_or_host.contains("://"), host_col(url_or_host)).otherwise(F.lower(url_or_host))
    s = F.regexp_replace(F.substring_index(F.coalesce(s, F.lit("")), ":", 1), r"^www\.", "")
    labels = F.split(s, r"\.", -1)
    n = F.when(F.element_at(labels, -2).isin(*SECOND_LEVEL), 3).otherwise(2)
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -n, n), ".")).otherwise(s)


def is_external_col(url: Column, domain: Column) -> Column:
    low, host = F.lower(url), host_col(url)
    leaves = F.lit(False)
    for p in LEAVING:
        leaves = leaves | low.startswith(p)
    mine, theirs = base_domain_col(domain), base_domain_col(host)
    return F.when(leaves, True).when(host == "", False).when(F.coalesce(domain, F.lit("")) == "", True).otherwise(~((theirs == mine) | theirs.endswith(F.concat(F.lit("."), mine))))


def is_social_col(url: Column, domains: tuple[str, ...] = SOCIAL) -> Column:
    host, out = host_col(url), F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def depth_col(url: Column) -> Column:
    return F.size(F.filter(F.split(path_col(url), "/"), lambda x: x != ""))


def extension_col(url: Column) -> Column:
    return F.lower(F.regexp_extract(path_col(url), r"\.([^./]*)$", 1))
