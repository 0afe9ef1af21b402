"""Scalar rules of the web platform that results depend on: white space, lengths, numbers, patterns."""

from __future__ import annotations

import re

#: White space as web pages' scripts see it; fixed values of the language.
WS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_RUN = re.compile(f"[{WS}]+")
_EDGES = "".join(chr(c) for c in range(0x3001) if _RUN.fullmatch(chr(c))) + "\ufeff"
#: The same class for Spark's and DuckDB's regular expressions.
WS_CLASS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(s: str | None) -> str:
    return s.strip(_EDGES) if s else ""


def collapse(s: str) -> str:
    return trim(_RUN.sub(" ", s))


def words(s: str) -> list[str]:
    return [w for w in _RUN.split(s) if w]


def units(s: str) -> int:
    """Length in UTF-16 units."""
    return len(s) if s.isascii() else len(s.encode("utf-16-le", "surrogatepass")) // 2


def cut(s: str, n: int) -> str:
    """The first n UTF-16 units."""
    return s[:n] if s.isascii() else s.encode("utf-16-le", "surrogatepass")[: 2 * n].decode("utf-16-le", "ignore")


def parse_int(s: str | None) -> int | None:
    m = re.match(f"[{WS}]*([+-]?[0-9]+)", s or "")
    return int(m[1]) if m else None


def pattern(source: str, flags: str = "") -> re.Pattern:
    """A script pattern as a Python one: named groups, input end, ASCII classes."""
    out = re.sub(r"\(\?<(?![=!])", "(?P<", source)
    out = re.sub(r"\\k<(\w+)>", r"(?P=\1)", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\$(?![^\[]*\])", r"\1\\Z", out) if "m" not in flags else out
    out = re.sub(r"\\u\{?([0-9a-fA-F]{4,6})\}?", lambda m: re.escape(chr(int(m[1], 16))), out)
    out = re.sub(r"\\d", "[0-9]", out) if "[" not in out else out
    return re.compile(out, (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0) | (re.S if "s" in flags else 0))
