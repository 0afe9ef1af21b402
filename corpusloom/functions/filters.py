"""Content filters: from a page to the HTML of its main content."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from corpusloom.functions.dom import Document, Element, measured, release
from corpusloom.functions.js import collapse, cut, trim, units, words

#: Fixed values of the pruning score.
PRUNED_TAGS = ("nav", "footer", "header", "aside", "script", "style", "form", "iframe", "noscript")
TAG_WEIGHTS = {"div": 0.5, "p": 1.0, "article": 1.5, "section": 1.0, "span": 0.3, "li": 0.5, "ul": 0.5, "ol": 0.5, "h1": 1.2, "h2": 1.1, "h3": 1.0, "h4": 0.9, "h5": 0.8, "h6": 0.7}
TAG_WEIGHT = 0.5
TAG_IMPORTANCE = {"article": 1.5, "main": 1.4, "section": 1.3, "p": 1.2, "h1": 1.4, "h2": 1.3, "h3": 1.2, "div": 0.7, "span": 0.6}
IMPORTANCE = 0.7
DENSITY, LINKS, TAG, CLASS, LENGTH = 0.4, 0.2, 0.2, 0.1, 0.1

#: Fixed values of the relevance score.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will "
    "with from has have had we you your our can"
).split()
BOOSTS = {"h1": 5.0, "h2": 4.0, "h3": 3.0, "title": 4.0, "strong": 2.0, "b": 1.5, "em": 1.5, "blockquote": 2.0, "code": 2.0, "pre": 1.5, "th": 1.5}
CHUNK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "section", "article")


Sizes = dict[int, tuple[str, int]]


def _sizes(e: Element, sizes: Sizes | None = None) -> tuple[str, int, int, int]:
    """The text, its length, the length of the markup inside, and that of the text of plain direct links."""
    sizes = sizes if sizes is not None and id(e) in sizes else measured_with(e)
    text, markup = sizes[id(e)]
    links = sum(units(trim(sizes[id(c)][0])) for c in e.elements if c.tag == "a" and not c.elements)
    text = trim(text)
    return text, units(text), markup, links


def measured_with(e: Element) -> Sizes:
    """What `measured` says of an element and all below it."""
    box = Element("div")
    box.children = [e]
    return measured(box)


def composite_score(e: Element, min_words: int | None = None, sizes: Sizes | None = None) -> float:
    told, text, markup, links = _sizes(e, sizes)
    if min_words and len(words(told)) < min_words:
        return -1.0
    score = (
        DENSITY * (text / markup if markup else 0)
        + LINKS * (1 - (links / text if text else 0))
        + TAG * TAG_WEIGHTS.get(e.tag, TAG_WEIGHT)
        + CLASS * 0
        + LENGTH * math.log(text + 1)
    )
    return score / (DENSITY + LINKS + TAG + CLASS + LENGTH)


def score_limit(e: Element, threshold: float, kind: str, sizes: Sizes | None = None) -> float:
    if kind == "fixed":
        return threshold
    _, text, markup, links = _sizes(e, sizes)
    for applies, factor in (
        (TAG_IMPORTANCE.get(e.tag, IMPORTANCE) > 1, 0.8),
        ((text / markup if markup else 0) > 0.4, 0.9),
        ((links / text if text else 1) > 0.6, 1.2),
    ):
        threshold = threshold * factor if applies else threshold
    return threshold


def pruning(doc: Document, threshold: float = 0.48, threshold_type: str = "fixed", min_word_threshold: int | None = None, preserve_tags: tuple[str, ...] = (), preserve_classes: tuple[str, ...] = ()) -> str:
    """Top-down: an element below its limit goes with all it holds."""
    body = doc.body or doc.root
    for e in body.select(", ".join(PRUNED_TAGS)):
        e.remove()
    # An element is judged before anything inside it goes, so one measure at the start serves all.
    sizes = measured(body)
    todo = list(body.elements)
    while todo:
        e = todo.pop()
        if e.tag in preserve_tags or set((e.get("class") or "").split()) & set(preserve_classes):
            continue
        if composite_score(e, min_word_threshold, sizes) < score_limit(e, threshold, threshold_type, sizes):
            e.remove()
        else:
            todo += e.elements
    return "\n".join(e.outer_html for e in body.elements if trim(e.text))


def tokens(text: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) > 1 and t not in STOPWORDS]


def chunks(doc: Document) -> list[tuple[Element, str]]:
    """The innermost block elements with text, and their text with single spaces."""
    body = doc.body or doc.root
    inside = ", ".join(CHUNK_TAGS)
    out = []
    for e in body.select(inside):
        if e.first(inside) is None:
            text = collapse(e.text)
            if text:
                out.append((e, text))
    return out


def page_query(doc: Document) -> str:
    """What a page says it is about."""

    def content(name: str) -> str:
        e = doc.first(f'meta[name="{name}" i]')
        return trim(e.get("content")) if e is not None else ""

    title, h1 = doc.first("title"), doc.first("h1")
    keywords, description = content("keywords"), content("description")
    parts = [trim(e.text) for e in (title, h1) if e is not None] + [keywords, description]
    if not keywords and not description:
        long = next((t for t in (trim(p.text) for p in doc.select("p")) if units(t) > 150), None)
        parts.append(cut(long, 150) if long else "")
    return " ".join(p for p in parts if p)


def idf(df: int, n: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(doc: Document, query: str | None = None, threshold: float = 1.0, k1: float = 1.2, b: float = 0.75) -> str:
    terms = list(dict.fromkeys(tokens(query or page_query(doc))))
    found = chunks(doc) if terms else []
    if not found:
        return ""
    counted = [Counter(tokens(t)) for _, t in found]
    lengths = [c.total() for c in counted]
    mean = sum(lengths) / len(lengths) or 1
    df = Counter(t for c in counted for t in c)
    kept = []
    for (e, _), c, n in zip(found, counted, lengths):
        score = sum(idf(df[t], len(found)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * n / mean)) for t in terms if c[t])
        if score * BOOSTS.get(e.tag, 1.0) >= threshold:
            kept.append(e.outer_html)
    return "\n".join(kept)


_UNLIKELY = re.compile(r"banner|breadcrumbs?|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup", re.I)
_MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.I)
_GOOD = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
_BAD = re.compile(r"-ad-|hidden|^hid$| hid$| hid |banner|combx|comment|com-|contact|foot|footer|footnote|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|tool|widget", re.I)
_DIVS = ("blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul", "select")


def _named(e: Element) -> str:
    return f"{e.get('class') or ''} {e.get('id') or ''}"


def _link_density(e: Element) -> float:
    n = units(trim(e.text))
    return sum(units(trim(a.text)) * (0.3 if (a.get("href") or "").startswith("#") else 1) for a in e.select("a")) / n if n else 0.0


def _start_score(e: Element) -> float:
    by_tag = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
    score = float(by_tag.get(e.tag, 0))
    for name in (e.get("class") or "", e.get("id") or ""):
        score += (25 if name and _GOOD.search(name) else 0) - (25 if name and _BAD.search(name) else 0)
    return score


def article(doc: Document, char_threshold: int = 500) -> dict | None:
    """The page's article after the published readability method: html, title, byline, excerpt, length; None if there is none."""
    about = doc.first("title")
    heading = doc.first("h1")
    title = trim(about.text) if about is not None else trim(heading.text) if heading is not None else ""
    told = doc.first('meta[name="description" i]') or doc.first('meta[property="og:description" i]')
    by = doc.first('meta[name="author" i]')
    best: tuple[int, Element] | None = None
    for strict in (True, False):
        copy = doc.clone()
        made = copy.all()
        body = next((e for e in copy.walk() if e.tag == "body"), copy)
        for e in body.select("script, style, noscript, nav, footer, aside, form, iframe, link, object, embed"):
            e.remove()
        if strict:
            for e in list(body.walk()):
                name = _named(e)
                if e.tag not in ("body", "a") and _UNLIKELY.search(name) and not _MAYBE.search(name) and e.closest("table, code") is None:
                    e.remove()
        scores: dict[int, float] = {}
        seen: dict[int, Element] = {}
        for e in body.walk():
            block = e.tag in ("p", "td", "pre", "section", "h2", "h3", "h4", "h5", "h6") or (e.tag == "div" and not any(c.tag in _DIVS for c in e.elements))
            text = trim(e.text) if block else ""
            if units(text) < 25:
                continue
            points = 1 + len(re.split("[,،﹐︐︑⸁⸴⸲，]", text)) + min(units(text) // 100, 3)
            for level, a in enumerate(e.ancestors()):
                if level > 4 or a.parent is None or a.tag in ("html", "#document"):
                    break
                if id(a) not in scores:
                    scores[id(a)], seen[id(a)] = _start_score(a), a
                scores[id(a)] += points / (1 if level == 0 else 2 if level == 1 else level * 3)
        ranked = sorted(((s * (1 - _link_density(seen[k])), -n, seen[k]) for n, (k, s) in enumerate(scores.items())), key=lambda x: x[:2], reverse=True)
        top, score = (ranked[0][2], ranked[0][0]) if ranked else (body, 0.0)
        out = Element("div", {"id": "readability-page-1", "class": "page"})
        limit = max(10.0, score * 0.2)
        around = top.parent.elements if top.parent is not None and top is not body else [top]
        for e in list(around):
            text = trim(e.text)
            density = _link_density(e)
            good = e is top or scores.get(id(e), 0.0) * (1 - density) + (score * 0.2 if e.get("class") and e.get("class") == top.get("class") else 0) >= limit
            if not good and e.tag == "p":
                good = (units(text) > 80 and density < 0.25) or (0 < units(text) <= 80 and density == 0 and re.search(r"\.( |$)", text) is not None)
            if good:
                part = e.clone()
                part.tag = "div" if part.tag == "body" else part.tag
                out.append(part)
        for e in list(out.walk()):
            e.attrs.pop("class", None)
            e.attrs.pop("style", None)
        release(made)
        size = units(trim(out.text))
        if best is None or size > best[0]:
            best, out = (size, out), best[1] if best else None
        if out is not None and out is not best[1]:
            release(out.all())
        if size >= char_threshold:
            break
    size, out = best
    first, html = out.first("p"), out.outer_html
    excerpt = trim(told.get("content")) if told is not None else trim(first.text) if first is not None else ""
    release(out.all())
    if not size:
        return None
    return {"html": html, "title": title, "byline": trim(by.get("content")) if by is not None else None, "excerpt": excerpt, "length": size}


def readability(doc: Document, char_threshold: int = 500) -> str:
    found = article(doc, char_threshold)
    return found["html"] if found else ""


FILTERS: dict[str, Callable[..., str]] = {"readability": readability, "pruning-legacy": pruning, "bm25": bm25, "none": lambda doc, **_: ""}


def apply_filter(doc: Document, name: str, options: dict | None = None) -> str:
    """Run a filter on a copy; a filter that fails gives ''."""
    if name not in FILTERS:
        raise ValueError(f"Unknown content filter: {name}")
    copy = Document()
    for c in doc.clone().children:
        copy.children.append(c)
        c.parent = copy
    copy.made = list(copy.walk())
    try:
        return FILTERS[name](copy, **(options or {}))
    except Exception:
        return ""
    finally:
        copy.release()

