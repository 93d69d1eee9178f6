"""Links of a page: all of them, those of its best group of repeating siblings, those of its item lists."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

from . import urls
from .dom import Element
from .structured import jsonld_scripts

LEAST = 3
_JUNK = frozenset(("iframe", "noscript", "script", "style"))
_AROUND = frozenset(("aside", "footer", "header", "nav"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4"))
_CHORES = frozenset(("buy", "comment", "copy link", "email", "facebook", "linkedin", "pin", "pinterest", "print", "reddit", "save", "share", "tweet"))
_STRONG = _HEADINGS | {"b", "strong"}
_QUOTE = re.compile(r"&(?:quot|apos|#34|#39);|\\")


def page_links(root: Element, url: str) -> list[str]:
    """Every http(s) link in document order, repeated ones too."""
    base = urls.parse(url)
    if base is None:
        return []
    out = []
    for a in root.iter():
        if a.tag == "a" and "href" in a.attrs:
            link = urls.resolve(a.attrs["href"].strip().strip('"').strip("'").strip(), base)
            if link is not None:
                out.append(link)
    return out


# ---- the link that stands for a piece of a page -----------------------------------------------------------------


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)


def _squeeze(text: str) -> str:
    return _lower(" ".join(text.split()))


def _below(tops: Iterable[Element], own: bool) -> Iterable[Element]:
    for top in tops:
        if own:
            yield top
        yield from top.iter()


def primary_link(tops: list[Element], base: urls.Url, own: bool = True) -> str | None:
    """The main link among these elements (with own: themselves counted) and what is below them: one that makes up a
    heading, else the first with a text that isn't a chore like sharing, else the first."""
    every = list(_below(tops, own))
    headings = [t for t in (_squeeze(e.text()) for e in every if e.tag in _HEADINGS) if t]
    inside = {id(e) for e in every}
    named: list[tuple[str, str]] = []
    worded = fallback = None
    for a in every:
        if a.tag != "a" or "href" not in a.attrs:
            continue
        href = _QUOTE.sub("", a.attrs["href"]).strip().strip('"').strip("'").strip()
        link = urls.resolve(href, base)
        if link is None:
            continue
        fallback = fallback or link
        raw = a.text()
        text = _squeeze(raw)
        core = raw.strip()
        strong = bool(core) and (any(e.tag in _STRONG and (not own or id(e) in inside) for e in a.ancestors()) or any(e.tag in _STRONG for e in a.iter()))
        if strong or (text and any(text in h or h in text for h in headings)):
            named.append((link, text))
        if worded is None and core and _lower(core) not in _CHORES:
            worded = link
    if len(named) > 1:
        tests = (lambda t, h: t == h, lambda t, h: h in t, lambda t, h: bool(t) and t in h)
        for fits in tests:
            for link, text in named:
                if any(fits(text, h) for h in headings):
                    return link
    return named[-1][0] if named else worded or fallback


# ---- repeating siblings ---------------------------------------------------------------------------------------


def _groups(kids: list[Element]) -> Iterable[tuple[int, list[list[Element]]]]:
    """(elements a member, members) for each group of alike children of one element."""
    shapes = [tuple([c.tag for c in k.children if type(c) is Element]) for k in kids]
    # single elements: alike in the tags of their children, at least two, as far as the shorter goes
    open_groups: list[list] = []
    for kid, shape in zip(kids, shapes):
        for g in open_groups:
            n = min(len(g[0]), len(shape))
            if n >= 2 and g[0][:n] == shape[:n]:
                g[0] = g[0][:n]
                g[1].append([kid])
                break
        else:
            open_groups.append([shape, [[kid]]])
    for shape, members in open_groups:
        if len(members) >= LEAST and shape:
            yield 1, members
    # runs of several elements
    numbers: dict[tuple, int] = {}
    row = array("I", (numbers.setdefault(s, len(numbers)) for s in shapes))
    raw, unit = row.tobytes(), row.itemsize
    n = len(kids)
    for size in range(2, n // LEAST + 1):
        starts: dict[bytes, list[int]] = {}
        for i in range(n - size + 1):
            starts.setdefault(raw[i * unit : (i + size) * unit], []).append(i)
        # a run that isn't of one shape throughout holds a shorter such run (of two shapes at least), as often as itself
        starts = {key: found for key, found in starts.items() if len(found) >= LEAST and key != key[:unit] * size}
        if not starts:
            return
        for found in starts.values():
            kept, free = [], 0
            for i in found:
                if i >= free:
                    kept.append(i)
                    free = i + size
            if len(kept) >= LEAST:
                yield size, [kids[i : i + size] for i in kept]


def sibling_links(root: Element, base: urls.Url) -> list[str]:
    """The main link of each member of the best group of repeating siblings."""
    best, most = None, None
    stack = [root]
    while stack:
        e = stack.pop()
        kids = [c for c in e.children if type(c) is Element and c.tag not in _JUNK]
        over = None
        for size, members in _groups(kids) if len(kids) >= LEAST else ():
            if over is None:
                over = {e.tag} | {x.tag for x in e.ancestors()}
            score = (not over & _AROUND, "main" in over, size * len(members), len(members), size)
            if most is None or score >= most:
                best, most = members, score
        stack += reversed(kids)
    links = (primary_link(m, base) for m in best or [])
    return [x for x in links if x is not None]


# ---- item lists in JSON-LD ------------------------------------------------------------------------------------


def _item_lists(value) -> Iterable[dict]:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            kind = v.get("@type")
            if isinstance(kind, str) and kind.lower() == "itemlist":
                yield v
            stack += [v[key] for key in ("mainEntity", "@graph") if key in v]


def itemlist_links(root: Element, base: urls.Url) -> list[str]:
    anchors: dict[str, Element] | None = None

    def anchored(name: str) -> str | None:
        nonlocal anchors
        if anchors is None:
            anchors = {}
            for e in root.iter():
                if "id" in e.attrs:
                    anchors.setdefault(e.attrs["id"], e)
        e = anchors.get(name)
        return None if e is None else primary_link([e], base, own=False)

    here = (base.scheme, urls.normalize_domain(base.host or ""))
    out = []
    for value in jsonld_scripts(root):
        for found in _item_lists(value):
            items = found.get("itemListElement")
            for item in items if isinstance(items, list) else []:
                href = item.get("url") if isinstance(item, dict) else None
                if not isinstance(href, str):
                    continue
                if href.startswith("#"):
                    link = anchored(href[1:])
                else:
                    url = urls.parse(href)
                    if url is not None and url.scheme in ("http", "https"):
                        own = url.fragment is not None and (url.scheme, urls.normalize_domain(url.host or "")) == here
                        link = anchored(url.fragment) if own else str(url)
                    else:
                        url = urls.parse(href, base)
                        link = str(url) if url is not None and url.scheme in ("http", "https") else None
                if link is not None:
                    out.append(link)
    return out


def child_links(root: Element, url: str) -> list[str]:
    """Sibling links, then item-list links; the page itself if it has neither."""
    base = urls.parse(url)
    out = [] if base is None else sibling_links(root, base) + itemlist_links(root, base)
    return out or [url]

