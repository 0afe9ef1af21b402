"""HTML to Markdown, and links to numbered citations."""

from __future__ import annotations

import re

from corpusloom.functions.dom import Comment, Element, Node, Text, parse
from corpusloom.functions.js import trim
from corpusloom.functions.urls import parse as parse_url

LINK = re.compile(r'(!?)\[([^\]]*)\]\(([^)\s]+)(?:\s+"([^"]*)")?\)')
BLOCKS = frozenset(
    "address article aside audio blockquote body canvas center dd dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html isindex li main menu nav noframes noscript ol output p pre section table tbody td tfoot th thead tr ul video".split()
)
REMOVED = frozenset(("script", "style", "noscript", "iframe"))
MEANINGFUL = frozenset("a table thead tbody tfoot th td iframe script audio video img br hr input".split())
#: What plain text must escape so that it does not read as markup.
ESCAPES = (
    (re.compile(r"\\"), r"\\\\"),
    (re.compile(r"\*"), r"\\*"),
    (re.compile(r"^-", re.M), r"\\-"),
    (re.compile(r"^\+ ", re.M), r"\\+ "),
    (re.compile(r"^(=+)", re.M), r"\\\1"),
    (re.compile(r"^(#{1,6}) ", re.M), r"\\\1 "),
    (re.compile(r"`"), r"\\`"),
    (re.compile(r"^~~~", re.M), r"\\~~~"),
    (re.compile(r"\["), r"\\["),
    (re.compile(r"\]"), r"\\]"),
    (re.compile(r"^>", re.M), r"\\>"),
    (re.compile(r"_"), r"\\_"),
    (re.compile(r"^(\d+)\. ", re.M), r"\1\\. "),
)


#: A text without any of these needs no escapes.
_MAY_NEED = re.compile(r"[\\*`\[\]_]|^[-+=#~>\d]", re.M)
_SPACES = re.compile("[ \r\n\t]+")


def escape(text: str) -> str:
    if not _MAY_NEED.search(text):
        return text
    for what, by in ESCAPES:
        text = what.sub(by, text)
    return text


def _collapse(root: Element) -> None:
    """White space as a browser shows it: runs become one space, none at block edges."""
    last: Text | None = None
    keep_leading = False
    stack: list = list(reversed(root.children))
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            e = n[0]
            if last is not None and e.tag in BLOCKS:
                last.data = last.data.rstrip(" ")
                last, keep_leading = None, False
            continue
        if isinstance(n, Comment):
            continue
        if isinstance(n, Text):
            t = _SPACES.sub(" ", n.data)
            if (last is None or last.data.endswith(" ")) and not keep_leading and t.startswith(" "):
                t = t[1:]
            n.data = t
            if t:
                last, keep_leading = n, False
            continue
        if n.tag == "pre":
            if last is not None:
                last.data = last.data.rstrip(" ")
            last, keep_leading = None, False
            continue
        if n.tag in BLOCKS or n.tag == "br":
            if last is not None:
                last.data = last.data.rstrip(" ")
            last, keep_leading = None, False
        elif n.tag in ("img", "input", "video", "audio") or n.tag == "code" and not n.children:
            last, keep_leading = None, True
        stack.append((n,))
        stack.extend(reversed(n.children))
    if last is not None:
        last.data = last.data.rstrip(" ")


def _is_code_block(e: Element) -> bool:
    return e.tag == "pre" and len(e.children) > 0 and isinstance(e.children[0], Element) and e.children[0].tag == "code"


class _Joined:
    """Pieces of text joined one by one; between two there are as many line ends as the more of the two has, two at most."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.ends = 0

    def add(self, piece: str) -> None:
        rest = piece.lstrip("\n")
        gap = min(2, max(self.ends, len(piece) - len(rest)))
        core = rest.rstrip("\n")
        if core:
            self.parts.append("\n" * gap + core)
            gap = len(rest) - len(core)
        self.ends = gap

    def text(self) -> str:
        return "".join(self.parts) + "\n" * self.ends


def _blank(e: Element) -> bool:
    return e.tag not in MEANINGFUL and not trim(e.text) and not any(c.tag in MEANINGFUL for c in e.walk())


def _inside(e: Element) -> str:
    out, number = _Joined(), 0
    for at, c in enumerate(e.children):
        if isinstance(c, Text):
            out.add(c.data if _in_code(c) else escape(c.data))
        elif isinstance(c, Element):
            out.add(_element(c, at, number))
            number += 1
    return out.text()


def _in_code(n: Node) -> bool:
    p = n.parent
    while p is not None:
        if p.tag in ("code", "pre"):
            return p.tag == "code" or _is_code_block(p)
        p = p.parent
    return False


def _element(e: Element, at: int, number: int) -> str:
    """The Markdown of an element that is child `at` of its parent, and element `number` there."""
    if e.tag in REMOVED:
        return ""
    if _blank(e):
        return "\n\n" if e.tag in BLOCKS else (" " if e.text else "")
    content = _inside(e)
    lead = trail = ""
    if e.tag not in BLOCKS:
        m = re.match(r"^([ \t\r\n]*)(.*?)([ \t\r\n]*)$", e.text, re.S)
        if m[2] and e.tag != "code":
            lead, trail = ("" if _flanked(e, at - 1, -1) else m[1] and " "), ("" if _flanked(e, at + 1, 1) else m[3] and " ")
            content = content.strip(" \t\r\n") if e.tag != "br" else content
    return lead + _rule(e, content, number) + trail


def _flanked(e: Element, i: int, side: int) -> bool:
    """Whether white space stands next to an inline element already, in child i of its parent."""
    kids = e.parent.children if e.parent is not None else []
    if 0 <= i < len(kids):
        n = kids[i]
        if isinstance(n, Text):
            return n.data.endswith(" ") if side < 0 else n.data.startswith(" ")
        if isinstance(n, Element) and n.tag not in BLOCKS:
            return n.text.endswith(" ") if side < 0 else n.text.startswith(" ")
    return False


def _last(e: Element) -> Element | None:
    return next((c for c in reversed(e.children) if isinstance(c, Element)), None)


def _rule(e: Element, content: str, number: int) -> str:
    t = e.tag
    if t == "p":
        return f"\n\n{content}\n\n"
    if t == "br":
        return "  \n"
    if len(t) == 2 and t[0] == "h" and t[1] in "123456":
        return f"\n\n{'#' * int(t[1])} {content}\n\n"
    if t == "hr":
        return "\n\n---\n\n"
    if t == "blockquote":
        return "\n\n" + re.sub("^", "> ", content.strip("\n"), flags=re.M) + "\n\n"
    if t in ("ul", "ol"):
        last = e.parent is not None and e.parent.tag == "li" and _last(e.parent) is e
        return "\n" + content if last else f"\n\n{content}\n\n"
    if t == "li":
        return _item(e, content, number)
    if t == "pre" and _is_code_block(e):
        code = e.children[0]
        m = re.search(r"language-(\S+)", code.get("class") or "")
        body = code.text
        fence = "`" * max([3, *(len(x) + 1 for x in re.findall(r"^`{3,}", body, re.M))])
        return f"\n\n{fence}{m[1] if m else ''}\n{body.removesuffix(chr(10))}\n{fence}\n\n"
    if t == "a" and e.get("href"):
        title = re.sub(r"(\n+\s*)+", "\n", (e.get("title") or "").replace('"', '\\"'))
        href = e.get("href").replace("(", "\\(").replace(")", "\\)")
        return f"[{content}]({href}{f' {chr(34)}{title}{chr(34)}' if title else ''})"
    if t == "img":
        alt, src, title = (re.sub(r"(\n+\s*)+", "\n", e.get(k) or "") for k in ("alt", "src", "title"))
        return f"![{alt}]({src}{f' {chr(34)}{title}{chr(34)}' if title else ''})" if src else ""
    if t in ("em", "i"):
        return f"_{content}_" if content.strip() else ""
    if t in ("strong", "b"):
        return f"**{content}**" if content.strip() else ""
    if t in ("del", "s", "strike"):
        return f"~{content}~"
    if t == "code" and not (e.parent is not None and e.parent.tag == "pre"):
        if not content:
            return ""
        content = re.sub(r"\r?\n|\r", " ", content)
        pad = " " if re.search(r"^`|^ .*?[^ ].* $|`$", content) else ""
        fence = "`"
        while fence in re.findall(r"`+", content):
            fence += "`"
        return fence + pad + content + pad + fence
    if t == "input" and (e.get("type") or "").lower() == "checkbox" and e.parent is not None and e.parent.tag == "li":
        return ("[x]" if "checked" in e.attrs else "[ ]") + " "
    if t == "table":
        return _table(e)
    if t in ("td", "th"):
        return _cell(content, e)
    if t == "tr":
        return "\n" + content
    if t in ("thead", "tbody", "tfoot", "caption", "colgroup"):
        return content
    return f"\n\n{content}\n\n" if t in BLOCKS else content


def _item(e: Element, content: str, number: int) -> str:
    parent = e.parent
    mark = "-   "
    if parent is not None and parent.tag == "ol":
        start = parent.get("start")
        mark = f"{(int(start) if start and start.lstrip('-').isdigit() else 1) + number}.  "
    content = re.sub(r"\n", "\n    ", re.sub(r"\n+\Z", "\n", content.lstrip("\n")))
    more = parent is not None and _last(parent) is not e and not content.endswith("\n")
    return mark + content.rstrip(" ") + ("\n" if more else "") if content.endswith("\n    ") else mark + content + ("\n" if more else "")


def _cell(content: str, e: Element) -> str:
    first = e.parent is None or next(c for c in e.parent.children if isinstance(c, Element) and c.tag in ("td", "th")) is e
    return ("| " if first else " ") + re.sub(r"\s*\n\s*", " ", content.strip()).replace("|", "\\|") + " |"


def _table(e: Element) -> str:
    """A table with a heading row becomes a pipe table; one without keeps its HTML."""
    rows = e.select("tr")
    if not rows:
        return "\n\n" + _inside(e).strip() + "\n\n"
    first = [c for c in rows[0].elements if c.tag in ("td", "th")]
    heading = rows[0].parent is not None and rows[0].parent.tag == "thead" or bool(first) and all(c.tag == "th" for c in first)
    if not heading:
        return "\n\n" + e.outer_html + "\n\n"
    sides = {"left": ":--", "right": "--:", "center": ":-:"}
    lines = []
    for i, r in enumerate(rows):
        cells = [c for c in r.elements if c.tag in ("td", "th")]
        lines.append("".join(_cell(_inside(c), c) for c in cells))
        if i == 0:
            lines.append("| " + " | ".join(sides.get((c.get("align") or "").lower(), "---") for c in cells) + " |")
    caption = e.first("caption")
    return "\n\n" + (trim(caption.text) + "\n\n" if caption is not None else "") + "\n".join(lines) + "\n\n"


def to_markdown(html: str | None) -> str:
    if not html or not trim(html):
        return ""
    try:
        doc = parse(html)
        body = doc.body or doc.root
        _collapse(body)
        out = _inside(body)
        doc.release()
        return trim(out.strip("\n").replace("    ```", "```"))
    except Exception as e:  # a page that cannot be converted must not fail its batch
        return f"<!-- markdown conversion failed: {e} -->"


def cite(markdown: str, base_url: str) -> tuple[str, str]:
    """(text with numbered citations for its links, list of references)."""
    told: dict[str, tuple[str, str | None]] = {}
    numbers: dict[str, int] = {}

    def number(m: re.Match) -> str:
        bang, text, url, title = m.groups()
        if not re.match(r"(https?:|mailto:)", url, re.I):
            found = parse_url(url, base_url)
            if found is None:
                return m[0]
            url = found.text()
        told.setdefault(url, (text, title))
        return f"{bang}{text}⟨{numbers.setdefault(url, len(told))}⟩"

    body = LINK.sub(number, markdown)
    lines = []
    for i, (url, (text, title)) in enumerate(told.items(), 1):
        about = [x for x in (title, text if text != title else None) if x]
        lines.append(f"⟨{i}⟩ {url}" + (": " + " - ".join(about) if about else ""))
    return body, "\n\n## References\n\n" + "\n".join(lines) + "\n" if lines else ""


def variants(cleaned_html: str, base_url: str, fit_html: str = "", citations: bool = True) -> dict[str, str]:
    raw = to_markdown(cleaned_html)
    cited, references = cite(raw, base_url) if citations and raw else (raw, "")
    return {"raw_markdown": raw, "markdown_with_citations": cited, "references_markdown": references, "fit_markdown": to_markdown(fit_html), "fit_html": fit_html}
