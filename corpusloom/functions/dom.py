"""An HTML tree in plain Python: parser, serialiser and CSS selectors.

The parser covers what real pages need of the standard's tree construction:
implied html, head, body, tbody and rows, implied end tags, void and raw text
elements, re-opened formatting elements, the repair of misnested ones, and
text in tables moved out. It never fails on any input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.entities import html5

from corpusloom.functions.js import units

VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen frame basefont bgsound".split())
RAW = frozenset(("script", "style", "xmp", "iframe", "noembed", "noframes"))
TEXT_ONLY = frozenset(("title", "textarea"))
HEAD = frozenset(("title", "meta", "link", "base", "style", "script", "template"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre listing search section summary table ul plaintext xmp li dd dt".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SPECIAL = CLOSES_P | VOID | RAW | frozenset("body html head table tbody thead tfoot tr td th caption colgroup template textarea title select button applet marquee object".split())
SCOPE = frozenset("html table td th caption applet marquee object template".split())
TABLE_PARTS = frozenset(("table", "tbody", "thead", "tfoot", "tr"))
P_SCOPE = SCOPE | {"button"}
WITH_TEXT = RAW | TEXT_ONLY
#: Starts that take steps of their own, blocks whose start only closes an open p, and ends that only close the current node if it is theirs.
BRANCHED = HEADINGS | frozenset("li dd dt option optgroup button a table caption colgroup tbody thead tfoot tr td th".split())
PLAIN_BLOCKS = CLOSES_P - BRANCHED
PLAIN_ENDS = (CLOSES_P | frozenset("span label abbr cite dfn q sub sup time var kbd samp mark del ins bdi bdo data".split())) - frozenset(("table",))

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


class Node:
    __slots__ = ("parent",)

    def __init__(self) -> None:
        self.parent: Element | None = None

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def index(self) -> int:
        return self.parent.children.index(self)

    def replace_with(self, other: Node) -> None:
        parent, i = self.parent, self.index()
        parent.children[i] = other
        other.parent, self.parent = parent, None


class Text(Node):
    __slots__ = ("data",)

    def __init__(self, data: str):
        self.parent, self.data = None, data


class Comment(Node):
    __slots__ = ("data",)

    def __init__(self, data: str):
        self.parent, self.data = None, data


class Element(Node):
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.parent = None
        self.tag = tag
        self.attrs = attrs or {}
        self.children = []

    def append(self, node: Node) -> Node:
        if node.parent is not None:
            node.remove()
        node.parent = self
        self.children.append(node)
        return node

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    @property
    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def all(self) -> list[Element]:
        """This element and all below it, as `release` takes them."""
        return [self, *self.walk()]

    def walk(self) -> Iterator[Element]:
        """All elements below this one in document order."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            if isinstance(n, Element):
                yield n
                if n.children:
                    stack += n.children[::-1]

    @property
    def text(self) -> str:
        if not self.children:
            return ""
        if len(self.children) == 1 and isinstance(self.children[0], Text):
            return self.children[0].data
        out, stack = [], self.children[::-1]
        while stack:
            n = stack.pop()
            if isinstance(n, Text):
                out.append(n.data)
            elif isinstance(n, Element):
                stack.extend(reversed(n.children))
        return "".join(out)

    @property
    def inner_html(self) -> str:
        return _serialise(self.children, self.tag in RAW)

    @property
    def outer_html(self) -> str:
        return _serialise([self])

    def clone(self) -> Element:
        top = Element(self.tag, dict(self.attrs))
        stack = [(self, top)]
        while stack:
            a, b = stack.pop()
            for c in a.children:
                if isinstance(c, Element):
                    made = Element(c.tag, dict(c.attrs))
                    stack.append((c, made))
                else:
                    made = type(c)(c.data)
                made.parent = b
                b.children.append(made)
        return top

    def ancestors(self) -> Iterator[Element]:
        p = self.parent
        while p is not None:
            if p.tag != "#document":
                yield p
            p = p.parent

    def under(self, root: Element) -> bool:
        p = self.parent
        while p is not None and p is not root:
            p = p.parent
        return p is not None

    def closest(self, selector: str) -> Element | None:
        test = compiled(selector)
        return next((e for e in [self, *self.ancestors()] if test(e)), None)

    def matches(self, selector: str) -> bool:
        return compiled(selector)(self)

    def select(self, selector: str) -> list[Element]:
        test, out = compiled(selector), []
        tags = tags_alone(selector)
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            if isinstance(n, Element):
                if n.tag in tags if tags else test(n):
                    out.append(n)
                if n.children:
                    stack += n.children[::-1]
        return out

    def first(self, selector: str) -> Element | None:
        test = compiled(selector)
        return next((e for e in self.walk() if test(e)), None)


def remove_all(gone: list[Element]) -> None:
    """Take elements out, each parent's children walked once however many go."""
    if not gone:
        return
    if len(gone) == 1:
        return gone[0].remove()
    ids, parents = {id(e) for e in gone}, {id(e.parent): e.parent for e in gone if e.parent is not None}
    for p in parents.values():
        p.children = [c for c in p.children if id(c) not in ids]
    for e in gone:
        e.parent = None


def release(made: list[Element]) -> None:
    """Part elements that nobody needs any more from what they hold.

    Parents and children name each other, so a page left as it is stays until
    the garbage collector walks over it; parted, it is gone at once.
    """
    for e in made:
        e.children.clear()
    made.clear()


def measured(root: Element) -> dict[int, tuple[str, int]]:
    """By id of each element below root: its text, and the length of the markup inside it in UTF-16 units.

    One walk from the leaves up: an element's text and length come from its children's.
    """
    out: dict[int, tuple[str, int]] = {}
    for e in reversed(list(root.walk())):
        texts, size = [], 0
        for c in e.children:
            if isinstance(c, Element):
                text, inside = out[id(c)]
                texts.append(text)
                size += len(c.tag) + 2 + sum(len(k) + 4 + units(_value(v)) for k, v in c.attrs.items())
                size += inside + len(c.tag) + 3 if c.tag not in VOID else 0
            elif isinstance(c, Text):
                texts.append(c.data)
                size += units(c.data if e.tag in RAW else _text(c.data))
            else:
                size += units(c.data) + 7
        out[id(e)] = ("".join(texts), size)
    return out


class Document(Element):
    def __init__(self) -> None:
        super().__init__("#document")
        self.made: list[Element] = []  # the elements made for it, in it or not

    def matches_in(self, root: Element, selector: str) -> list[Element]:
        """What root.select finds, in any order; tags alone are looked up among the elements made for the page."""
        tags = tags_alone(selector)
        if not tags or not self.made:
            return root.select(selector)
        return [e for e in self.made if e.tag in tags and e.under(root)]

    def release(self) -> None:
        """Let go of a page that is done with."""
        release(self.made)
        self.children.clear()

    @property
    def root(self) -> Element:
        for e in self.children:
            if isinstance(e, Element):
                return e
        raise IndexError("no element")

    @property
    def body(self) -> Element | None:
        for e in self.root.children:
            if isinstance(e, Element) and e.tag == "body":
                return e
        return None


_MARKUP = re.compile("[&\xa0<>\"]")


def _text(s: str) -> str:
    return s.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;") if _MARKUP.search(s) else s


def _value(s: str) -> str:
    return s.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;") if _MARKUP.search(s) else s


def _serialise(nodes: list[Node], raw: bool = False) -> str:
    out: list[str] = []
    stack: list = nodes[::-1]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif isinstance(n, Text):
            out.append(n.data if raw or (n.parent is not None and n.parent.tag in RAW) else _text(n.data))
        elif isinstance(n, Comment):
            out.append(f"<!--{n.data}-->")
        else:
            tag = n.tag
            out.append(f"<{tag}{''.join([f' {k}="{_value(v)}"' for k, v in n.attrs.items()])}>" if n.attrs else f"<{tag}>")
            if tag not in VOID:
                if n.children:
                    stack.append(f"</{tag}>")
                    stack += n.children[::-1]
                else:
                    out.append(f"</{tag}>")
    return "".join(out)


class _Builder:
    def __init__(self) -> None:
        self.doc = Document()
        self.made = self.doc.made
        self.html = self.doc.append(self.make("html"))
        self.head = self.html.append(self.make("head"))
        self.body: Element | None = None
        self.open: list[Element] = [self.html, self.head]
        self.active: list[Element | None] = []  # formatting elements that text re-opens; None is a marker

    @property
    def at(self) -> Element:
        return self.open[-1]

    def make(self, tag: str, attrs: dict[str, str] | None = None) -> Element:
        e = Element(tag, attrs)
        self.made.append(e)
        return e

    def start_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body is None:
            self.body = self.html.append(self.make("body", attrs))
            self.open = [self.html, self.body]

    def in_scope(self, tags, stops: frozenset = SCOPE) -> bool:
        for e in reversed(self.open):
            if e.tag in tags:
                return True
            if e.tag in stops:
                return False
        return False

    def pop_to(self, tags) -> None:
        while len(self.open) > 2:
            if self.open.pop().tag in tags:
                return

    def close_p(self) -> None:
        if self.in_scope(("p",), P_SCOPE):
            self.pop_to(("p",))

    def place(self, node: Node) -> None:
        """Insert at the current node; what tables cannot hold goes before the table."""
        at = self.open[-1]
        if at.tag in TABLE_PARTS and not (isinstance(node, Element) and node.tag in ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup", "col", "script", "style", "template", "form", "input")) and not isinstance(node, Comment):
            if not isinstance(node, Text) or node.data.strip("\t\n\f\r "):
                table = next((e for e in reversed(self.open) if e.tag == "table"), None)
                if table is not None and table.parent is not None:
                    node.parent = table.parent
                    kids, i = table.parent.children, table.index()
                    if isinstance(node, Text) and i and isinstance(kids[i - 1], Text):
                        kids[i - 1].data += node.data
                    else:
                        kids.insert(i, node)
                    return
        if isinstance(node, Text) and at.children and isinstance(at.children[-1], Text):
            at.children[-1].data += node.data
        else:
            node.parent = at
            at.children.append(node)

    def push(self, tag: str, attrs: dict[str, str]) -> Element:
        e = Element(tag, attrs)
        self.made.append(e)
        at = self.open[-1]
        if at.tag in TABLE_PARTS:
            self.place(e)
        else:
            e.parent = at
            at.children.append(e)
        if tag not in VOID:
            self.open.append(e)
        return e

    def reopen(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.open:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.open:
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.push(old.tag, dict(old.attrs))

    def text(self, data: str) -> None:
        if not data:
            return
        if self.body is None and self.at.tag not in WITH_TEXT:
            if not data.strip("\t\n\f\r "):
                return
            self.start_body()
        if self.active and (self.open[-1].tag not in TABLE_PARTS or data.strip("\t\n\f\r ")):
            self.reopen()
        at = self.open[-1]
        if at.tag in TABLE_PARTS:
            self.place(Text(data))
        elif at.children and isinstance(at.children[-1], Text):
            at.children[-1].data += data
        else:
            node = Text(data)
            node.parent = at
            at.children.append(node)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in PLAIN_BLOCKS and self.body is not None:
            for e in reversed(self.open):
                if e.tag in P_SCOPE:
                    break
                if e.tag == "p":
                    self.pop_to(("p",))
                    break
            self.push(tag, attrs)
            return
        if tag == "html":
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            return
        if tag == "body":
            if self.body is None:
                self.start_body(attrs)
            else:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag in HEAD or tag == "noscript" or self.at.tag == "noscript" and tag in ("link", "meta", "style"):
                e = self.make(tag, attrs)
                self.at.append(e)
                if tag not in VOID:
                    self.open.append(e)
                return
            self.start_body()
        if tag in CLOSES_P:
            self.close_p()
        if tag not in BRANCHED:
            pass
        elif tag in HEADINGS and self.at.tag in HEADINGS:
            self.open.pop()
        elif tag in ("li", "dd", "dt"):
            ends = ("li",) if tag == "li" else ("dd", "dt")
            for e in reversed(self.open):
                if e.tag in ends:
                    self.pop_to((e.tag,))
                    break
                if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        elif tag in ("option", "optgroup"):
            if self.at.tag == "option":
                self.open.pop()
            if tag == "optgroup" and self.at.tag == "optgroup":
                self.open.pop()
        elif tag == "button" and self.in_scope(("button",)):
            self.pop_to(("button",))
        elif tag == "a":
            old = next((e for e in reversed(self.active) if e is not None and e.tag == "a"), None)
            if old is not None:
                self.end("a")
                if old in self.active:
                    self.active.remove(old)
                if old in self.open:
                    self.open.remove(old)
        elif tag == "table":
            pass
        elif tag in ("caption", "colgroup", "tbody", "thead", "tfoot"):
            if not self.in_scope(("table",), frozenset(("html",))):
                return
            while self.at.tag not in ("table", "template", "html"):
                self.open.pop()
        elif tag in ("tr", "td", "th"):
            if not self.in_scope(("table",), frozenset(("html",))):
                return
            stop = {"tr": ("tbody", "thead", "tfoot", "table"), "td": ("tr", "tbody", "thead", "tfoot", "table")}["tr" if tag == "tr" else "td"]
            while self.at.tag not in stop and self.at.tag != "html":
                self.open.pop()
            if self.at.tag == "table":
                self.push("tbody", {})
            if tag != "tr" and self.at.tag != "tr":
                self.push("tr", {})
            self.clear_marker()
        if tag in FORMATTING or tag not in SPECIAL or tag in ("br", "img", "input", "button", "select", "textarea"):
            if self.at.tag not in TABLE_PARTS or tag in FORMATTING:
                self.reopen()
        e = self.push("img" if tag == "image" else tag, attrs)
        if tag in FORMATTING:
            same = [x for x in self.active if x is not None and x.tag == tag and x.attrs == attrs]
            if len(same) >= 3:
                self.active.remove(same[0])
            self.active.append(e)
        elif tag in ("td", "th", "caption", "applet", "marquee", "object"):
            self.active.append(None)

    def clear_marker(self) -> None:
        if None in self.active and not any(e.tag in ("td", "th", "caption") for e in self.open):
            while self.active and self.active.pop() is not None:
                pass

    def end(self, tag: str) -> None:
        at = self.open[-1]
        if tag in FORMATTING and self.active and self.active[-1] is at and at.tag == tag:
            self.open.pop()
            self.active.pop()
            return
        if tag in ("html", "body", "head"):
            if tag == "head" and self.body is None:
                self.open = [self.html, self.head]
            return
        if self.body is None:
            if any(e.tag == tag for e in self.open[2:]):
                while self.open.pop().tag != tag:
                    pass
            elif tag in ("br", "p"):
                self.start_body()
                self.end(tag)
            return
        if tag == "p":
            if not self.in_scope(("p",), P_SCOPE):
                self.push("p", {})
            self.pop_to(("p",))
        elif tag == "br":
            self.reopen()
            self.push("br", {})
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
            if self.in_scope((tag,), frozenset(("html",)) if tag == "table" else frozenset(("html", "table"))):
                self.pop_to((tag,))
                if tag in ("td", "th", "caption"):
                    while self.active and self.active.pop() is not None:
                        pass
                else:
                    self.clear_marker()
        else:
            for e in reversed(self.open[2:]):
                if e.tag == tag:
                    if tag not in SPECIAL or self.in_scope((tag,)):
                        self.pop_to((tag,))
                    return
                if e.tag in SPECIAL and tag not in SPECIAL:
                    return

    def adopt(self, tag: str) -> None:
        """Close a formatting element; blocks that it wrongly spans get copies of their own."""
        for _ in range(8):
            f = None
            for e in reversed(self.active):
                if e is None:
                    break
                if e.tag == tag:
                    f = e
                    break
            if f is None or f not in self.open:
                if f is not None:
                    self.active.remove(f)
                elif any(e.tag == tag for e in self.open[2:]) and self.at.tag == tag:
                    self.open.pop()
                return
            at = self.open.index(f)
            block = next((e for e in self.open[at + 1 :] if e.tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.active.remove(f)
                return
            above = self.open[at - 1]
            mark = self.active.index(f)
            last = block
            for node in reversed(self.open[at + 1 : self.open.index(block)]):
                if node not in self.active:
                    self.open.remove(node)
                    continue
                copy = self.make(node.tag, dict(node.attrs))
                if last is block:
                    mark = self.active.index(node) + 1
                self.active[self.active.index(node)] = copy
                self.open[self.open.index(node)] = copy
                copy.append(last)
                last = copy
            above.append(last)
            copy = self.make(f.tag, dict(f.attrs))
            for c in list(block.children):
                copy.append(c)
            block.append(copy)
            i = self.active.index(f)
            self.active.insert(mark, copy)
            del self.active[i if i < mark else i + 1]
            self.open.remove(f)
            self.open.insert(self.open.index(block) + 1, copy)


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | TEXT_ONLY}


_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def unescape_ended(s: str) -> str:
    """Decode only references that a semicolon ends; the standard also takes '&amp' and '&copy' without one."""
    return _REFERENCE.sub(lambda m: unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html5 else m[0], s)


def _text_of(b: _Builder, tag: str, html: str, i: int, decode: Callable[[str], str]) -> int:
    """Take the text of an element that holds nothing else; says where the page goes on."""
    n, end = len(html), _ENDS[tag].search(html, i)
    k = end.start() if end else n
    data = html[i:k]
    if tag in TEXT_ONLY:
        data = decode(data.removeprefix("\n") if tag == "textarea" else data)
    if data and b.at.tag == tag:
        b.at.append(Text(data))
    close = html.find(">", k) if end else n - 1
    if b.at.tag == tag:
        b.open.pop()
    return n if close < 0 else close + 1


#: Tags met before, by their source: whether it ends an element, its name, its attributes. Pages repeat a few short ones.
_MET: dict[str, tuple[str, str, dict[str, str]]] = {}
MET, MET_LENGTH = 4096, 64


def _remember(source: str, closing: str, tag: str, attrs: dict[str, str]) -> None:
    if len(_MET) >= MET:
        _MET.clear()
    _MET[source] = (closing, tag, attrs)


def parse(html: str, decode: Callable[[str], str] = unescape) -> Document:
    b = _Builder()
    html = html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd").removeprefix("\ufeff")
    i, n = 0, len(html)
    find, known, start, end, text = html.find, _MET.get, b.start, b.end, b.text
    swallow = False  # a newline right after <pre> or <textarea>
    while i < n:
        j = find("<", i)
        if j < 0:
            j = n
        if j > i:
            data = html[i:j]
            if swallow and data.startswith("\n"):
                data = data[1:]
            text(decode(data) if "&" in data else data)
        swallow = False
        if j >= n:
            break
        right = find(">", j) + 1
        met = known(html[j:right]) if right - j <= MET_LENGTH else None
        if met is not None:
            i = right
            closing, tag, attrs = met
            if closing:
                # What `end` does at once where the current node is the one to close.
                if tag in PLAIN_ENDS and b.open[-1].tag == tag and b.body is not None and len(b.open) > 2:
                    b.open.pop()
                else:
                    end(tag)
                continue
            start(tag, attrs.copy() if attrs else attrs)
            if tag in WITH_TEXT:
                i = _text_of(b, tag, html, i, decode)
            swallow = tag == "pre" or tag == "listing"
            continue
        kind = html[j + 1 : j + 2]
        plain = kind.isalpha() or (kind == "/" and html[j + 2 : j + 3].isalpha())
        if not plain and html.startswith("<!--", j):
            if html.startswith(("<!-->", "<!--->"), j):
                i = html.index(">", j) + 1
                data = ""
            else:
                k = html.find("-->", j + 4)
                data, i = (html[j + 4 : k], k + 3) if k >= 0 else (html[j + 4 :], n)
            b.place(Comment(data)) if b.body is not None or len(b.open) > 2 else b.head.append(Comment(data))
            continue
        if not plain and kind in ("!", "?", "/") and kind:
            k = html.find(">", j)
            i = n if k < 0 else k + 1
            continue
        m = _TAG.match(html, j)
        if not m:
            if plain:
                break  # an unfinished tag at the end is dropped
            b.text("<")
            i = j + 1
            continue
        i = m.end()
        closing, tag, rest, closing2, tag2, rest2 = m.groups()
        # Up to its first ">" such a tag reads the same wherever it stands: no quote is open there.
        lasting = tag and i == right and right - j <= MET_LENGTH and '"' not in tag and "'" not in tag
        if not tag:
            closing, tag, rest = closing2, tag2, rest2
        tag = tag.lower()
        attrs = attributes(rest) if not closing and rest and rest.strip("/ \t\n\f") else {}
        if lasting:
            _remember(m[0], closing, tag, attrs)
        if closing:
            b.end(tag)
            continue
        b.start(tag, dict(attrs))
        if tag in WITH_TEXT:
            i = _text_of(b, tag, html, i, decode)
        swallow = tag in ("pre", "listing")
    b.start_body()
    return b.doc


class SelectorError(ValueError):
    pass


Test = Callable[[Element], bool]
_COMPILED: dict[str, Test] = {}
_TOKEN = re.compile(
    r"\s*(?P<comb>[>+~,])\s*|(?P<space>\s+)|(?P<star>\*)|#(?P<id>(?:[\w-]|[^\x00-\x7f]|\\.)+)|\.(?P<cls>(?:[\w-]|[^\x00-\x7f]|\\.)+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]\"']+))\s*(?P<flag>[iIsS])?\s*)?\]"
    r"|:(?P<pseudo>[\w-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?|(?P<tag>(?:[\w-]|[^\x00-\x7f])+)"
)


#: A selector of tags alone.
_TAGS = re.compile(r"[a-zA-Z][a-zA-Z0-9]*(?:\s*,\s*[a-zA-Z][a-zA-Z0-9]*)*")


@lru_cache(500)
def tags_alone(selector: str) -> frozenset[str]:
    """The tags of a selector that is nothing else."""
    s = selector.strip()
    return frozenset(t.strip().lower() for t in s.split(",")) if _TAGS.fullmatch(s) else frozenset()


def compiled(selector: str) -> Test:
    test = _COMPILED.get(selector)
    if test is None:
        if len(_COMPILED) > 500:
            _COMPILED.clear()
        test = _COMPILED[selector] = _selector(selector)
    return test


def _nth(arg: str) -> Callable[[int], bool]:
    s = arg.replace(" ", "").lower()
    s = {"odd": "2n+1", "even": "2n"}.get(s, s)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", s)
    if not m or not s:
        raise SelectorError(arg)
    a = 0 if m[1] is None else {"": 1, "+": 1, "-": -1}.get(m[1]) or int(m[1])
    c = int(m[2] or 0)
    return lambda k: k == c if a == 0 else (k - c) % a == 0 and (k - c) // a >= 0


def _siblings(e: Element, same: bool = False) -> list[Element]:
    kids = e.parent.elements if e.parent is not None else [e]
    return [k for k in kids if k.tag == e.tag] if same else kids


def _place(e: Element, kids: list[Element]) -> int:
    return next(i for i, k in enumerate(kids) if k is e)


def _pseudo(name: str, arg: str | None) -> Test:
    if name in ("not", "is", "where") and arg:
        inner = _selector(arg)
        return (lambda e: not inner(e)) if name == "not" else inner
    if name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type") and arg:
        ok, typed, back = _nth(arg), "type" in name, "last" in name
        return lambda e: ok((len(k) - _place(e, k)) if back else _place(e, k) + 1) if (k := _siblings(e, typed)) else False
    simple: dict[str, Test] = {
        "first-child": lambda e: _siblings(e)[0] is e,
        "last-child": lambda e: _siblings(e)[-1] is e,
        "only-child": lambda e: len(_siblings(e)) == 1,
        "first-of-type": lambda e: _siblings(e, True)[0] is e,
        "last-of-type": lambda e: _siblings(e, True)[-1] is e,
        "empty": lambda e: not any(isinstance(c, Element) or isinstance(c, Text) and c.data for c in e.children),
        "root": lambda e: e.tag == "html",
    }
    if name in simple and arg is None:
        return simple[name]
    raise SelectorError(f":{name}")


def _attribute(name: str, op: str | None, value: str | None, flag: str | None) -> Test:
    name = name.lower()
    if op is None:
        return lambda e: name in e.attrs
    fold = flag in ("i", "I")
    want = value.lower() if fold else value

    def test(e: Element) -> bool:
        got = e.attrs.get(name)
        if got is None:
            return False
        got = got.lower() if fold else got
        if op == "=":
            return got == want
        if op == "~=":
            return want in got.split()
        if op == "|=":
            return got == want or got.startswith(want + "-")
        return bool(want) and (got.startswith(want) if op == "^=" else got.endswith(want) if op == "$=" else want in got)

    return test


def _selector(source: str) -> Test:
    """A test for elements; raises SelectorError where the selector is not valid."""
    s = source.strip()
    if not s:
        raise SelectorError(source)
    tags = tags_alone(s)
    if tags:
        return lambda e: e.tag in tags
    groups: list[list[tuple[str, list[Test]]]] = [[(" ", [])]]
    i = 0
    while i < len(s):
        m = _TOKEN.match(s, i)
        if not m:
            raise SelectorError(source)
        i = m.end()
        now = groups[-1][-1][1]
        if m["comb"] or m["space"]:
            if not now:
                raise SelectorError(source)
            groups.append([(" ", [])]) if m["comb"] == "," else groups[-1].append((m["comb"] or " ", []))
        elif m["star"]:
            now.append(lambda e: True)
        elif m["id"]:
            now.append(lambda e, v=re.sub(r"\\(.)", r"\1", m["id"]): e.attrs.get("id") == v)
        elif m["cls"]:
            now.append(lambda e, v=re.sub(r"\\(.)", r"\1", m["cls"]): v in e.attrs.get("class", "").split())
        elif m["attr"]:
            value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)
            now.append(_attribute(m["attr"], m["op"], value, m["flag"]))
        elif m["pseudo"]:
            now.append(_pseudo(m["pseudo"].lower(), m["arg"]))
        else:
            if now:
                raise SelectorError(source)
            now.append(lambda e, v=m["tag"].lower(): e.tag == v)
    if any(not tests for g in groups for _, tests in g):
        raise SelectorError(source)

    def fits(e: Element, g: list[tuple[str, list[Test]]], k: int) -> bool:
        if not all(t(e) for t in g[k][1]):
            return False
        if k == 0:
            return True
        comb = g[k][0]
        if comb == ">":
            return e.parent is not None and e.parent.tag != "#document" and fits(e.parent, g, k - 1)
        if comb == " ":
            return any(fits(p, g, k - 1) for p in e.ancestors())
        kids = _siblings(e)
        at = _place(e, kids)
        return (at > 0 and fits(kids[at - 1], g, k - 1)) if comb == "+" else any(fits(x, g, k - 1) for x in kids[:at])

    def of(g: list[tuple[str, list[Test]]]) -> Test:
        if len(g) > 1:
            return lambda e: fits(e, g, len(g) - 1)
        tests = g[0][1]
        return tests[0] if len(tests) == 1 else lambda e: all(t(e) for t in tests)

    each = [of(g) for g in groups]
    return each[0] if len(each) == 1 else lambda e: any(t(e) for t in each)
