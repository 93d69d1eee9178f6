"""An HTML tree as browsers build it, for pages as they come: implied and misnested tags, tables, raw text, entities.

`document(html)` and `fragment(html)` return the root element. Children are elements, comments and strings.
"""

from __future__ import annotations

import html as _html
import re
import sys
from collections.abc import Iterator

#: Some functions of a page's tree call themselves for each level; frames of Python functions lie on the heap, so a page
#: may be this deep.
DEPTH = 1_000_000
sys.setrecursionlimit(max(DEPTH, sys.getrecursionlimit()))

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript plaintext script style xmp".split())
_RCDATA = frozenset(("title", "textarea"))
_TEXT_ONLY = RAW | _RCDATA
_FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_BLOCK = frozenset("address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_SPECIAL = _BLOCK | _HEADINGS | VOID | RAW | _RCDATA | frozenset("applet body caption colgroup dd dt form head html li marquee object p select table tbody td template tfoot th thead tr".split())
_SCOPE = frozenset("applet caption html marquee object table td template th".split())
_BUTTON, _LIST, _TABLE = _SCOPE | {"button"}, _SCOPE | {"ol", "ul"}, frozenset(("html", "table", "template"))
_IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: What an end tag closes without more ado if it is the innermost open element, and start tags that only close a paragraph.
_CLOSED = _BLOCK | _HEADINGS | frozenset("dd dt li p".split())
_SIMPLE = _BLOCK - {"button"} | {"p"}
_SECTION = frozenset(("tbody", "tfoot", "thead"))
_PARTS = _SECTION | frozenset("caption col colgroup td th tr".split())
_CONTEXT = _SECTION | frozenset("caption colgroup html table td template th tr".split())
_SPACE = " \t\n\f\r"


class Comment:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def elements(self) -> list[Element]:
        return [c for c in self.children if type(c) is Element]

    def iter(self) -> Iterator[Element]:
        """Elements below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            e = stack.pop()
            yield e
            if e.children:
                stack += [c for c in reversed(e.children) if type(c) is Element]

    def texts(self) -> Iterator[str]:
        stack = self.children[::-1]
        while stack:
            c = stack.pop()
            if type(c) is str:
                yield c
            elif type(c) is Element:
                stack += c.children[::-1]

    def text(self) -> str:
        if len(self.children) == 1 and type(self.children[0]) is str:
            return self.children[0]
        return "".join(self.texts())

    def first(self, tag: str) -> Element | None:
        return next((e for e in self.iter() if e.tag == tag), None)

    def ancestors(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    def inner(self) -> str:
        out: list[str] = []
        _print(self.children, self.tag, out)
        return "".join(out)

    def outer(self) -> str:
        out: list[str] = []
        _print([self], "", out)
        return "".join(out)


def _print(children: list, parent: str, out: list[str]) -> None:
    todo: list = [(c, parent) for c in reversed(children)]
    while todo:
        c, inside = todo.pop()
        if type(c) is tuple:
            out.append(c[0])
        elif type(c) is str:
            out.append(c if inside in RAW else c.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif type(c) is Comment:
            out.append(f"<!--{c.text}-->")
        else:
            out.append("<" + c.tag + "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(160), "&nbsp;").replace(chr(34), "&quot;")}"' for k, v in c.attrs.items()) + ">")
            if c.tag not in VOID:
                todo.append(((f"</{c.tag}>",), ""))
                todo += [(x, c.tag) for x in reversed(c.children)]


# ---- tokens ---------------------------------------------------------------------------------------------------

_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*")
_PLAIN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)>")
_ATTR = re.compile(r"""[\t\n\f\r /]*(?:(>)|([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >]*)))?)""")
_BARE = re.compile(r"&[A-Za-z0-9]+(?=[=A-Za-z0-9])(?!;)")
_CLOSE = {}


def _unescape_value(s: str) -> str:
    """In attributes, a name without its semicolon that goes on stays as it is."""
    if "&" not in s:
        return s
    return re.sub(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))", lambda m: _html.unescape(m.group()), s)


def tokens(s: str) -> Iterator[tuple]:
    """("text", s), ("start", name, attrs, closed), ("end", name), ("comment", s), ("doctype",)"""
    s = s.replace("\r\n", "\n").replace("\r", "\n") if "\r" in s else s
    at, n = 0, len(s)
    while at < n:
        lt = s.find("<", at)
        if lt < 0:
            yield "text", _html.unescape(s[at:])
            return
        if lt > at:
            text = s[at:lt]
            yield "text", _html.unescape(text) if "&" in text else text
        plain = _PLAIN.match(s, lt)
        if plain:  # without attributes, as most tags are
            slash, tag = plain.groups()
            tag = tag.lower()
            if slash or tag not in _TEXT_ONLY:
                yield ("end", tag) if slash else ("start", tag, {}, False)
                at = plain.end()
                continue
        c = s[lt + 1 : lt + 2]
        if c == "!":
            if s.startswith("<!--", lt):
                if s.startswith((">", "->"), lt + 4):
                    at = s.index(">", lt + 4) + 1
                    yield "comment", ""
                    continue
                end = re.compile(r"--!?>").search(s, lt + 4)
                yield "comment", s[lt + 4 : end.start()] if end else s[lt + 4 :]
                at = end.end() if end else n
                continue
            end = s.find(">", lt)
            end = n if end < 0 else end
            yield ("doctype",) if s[lt + 2 : lt + 9].lower() == "doctype" else ("comment", s[lt + 2 : end])
            at = end + 1
            continue
        if c == "?" or (c == "/" and not s[lt + 2 : lt + 3].isalpha() and s[lt + 2 : lt + 3]):
            end = s.find(">", lt)
            end = n if end < 0 else end
            if not s.startswith("</>", lt):
                yield "comment", s[lt + (1 if c == "?" else 2) : end]
            at = end + 1
            continue
        closing = c == "/"
        name = _NAME.match(s, lt + 1 + closing)
        if not name or not (s[lt + 1 + closing].isascii()):
            yield "text", "<"
            at = lt + 1
            continue
        tag, at, attrs, ended = name.group().lower(), name.end(), {}, False
        while True:
            m = _ATTR.match(s, at)
            if not m:
                break
            at = m.end()
            if m.group(1):
                ended = True
                break
            key = m.group(2).lower()
            if key not in attrs:
                value = m.group(3) if m.group(3) is not None else m.group(4) if m.group(4) is not None else m.group(5) or ""
                attrs[key] = _unescape_value(value)
        if not ended:
            return  # a tag that doesn't end is dropped
        if closing:
            yield "end", tag
            continue
        yield "start", tag, attrs, "/" in s[m.start() : at]
        if tag in _TEXT_ONLY:
            if tag == "plaintext":
                yield "text", s[at:]
                return
            close = _CLOSE.get(tag) or _CLOSE.setdefault(tag, re.compile(rf"</{tag}(?=[\t\n\f\r />])[^>]*>", re.I))
            end = close.search(s, at)
            body = s[at : end.start()] if end else s[at:]
            if body:
                yield "text", _html.unescape(body) if tag in _RCDATA else body
            yield "end", tag
            at = end.end() if end else n


# ---- the tree -------------------------------------------------------------------------------------------------


class _Open(list):
    """The open elements. How many there are of each tag, and which, is kept beside them, so that most questions needn't
    go through all of a deep page's."""

    def __init__(self, elements=()):
        super().__init__(elements)
        self.tags: dict[str, int] = {}
        self.here: set[int] = set()
        self.contexts = [e.tag for e in self if e.tag in _CONTEXT]
        for e in self:
            self._count(e, 1)

    def _count(self, e: Element, by: int) -> None:
        self.tags[e.tag] = self.tags.get(e.tag, 0) + by
        (self.here.add if by > 0 else self.here.discard)(id(e))

    def __contains__(self, e) -> bool:
        return id(e) in self.here

    def append(self, e: Element) -> None:
        list.append(self, e)
        tag = e.tag
        self.tags[tag] = self.tags.get(tag, 0) + 1
        self.here.add(id(e))
        if tag in _CONTEXT:
            self.contexts.append(tag)

    def pop(self) -> Element:
        e = list.pop(self)
        tag = e.tag
        self.tags[tag] -= 1
        self.here.discard(id(e))
        if tag in _CONTEXT:
            self.contexts.pop()
        return e

    def insert(self, i: int, e: Element) -> None:
        rest = [self.pop() for _ in range(len(self) - i)]
        for x in [e, *reversed(rest)]:
            self.append(x)

    def __delitem__(self, at) -> None:
        first = at.start if isinstance(at, slice) else at
        gone = {id(e) for e in (self[at] if isinstance(at, slice) else [self[at]])}
        rest = [self.pop() for _ in range(len(self) - first)]
        for x in reversed(rest):
            if id(x) not in gone:
                self.append(x)

    def __setitem__(self, i: int, e: Element) -> None:
        rest = [self.pop() for _ in range(len(self) - i)]
        for x in [e, *reversed(rest[:-1])]:
            self.append(x)

    def any(self, tags) -> bool:
        count = self.tags
        for t in tags:
            if t in count and count[t]:
                return True
        return False


class _Builder:
    def __init__(self, fragment: bool):
        self.root = Element("html")
        self.stack = _Open([self.root])
        self.active: list[Element | None] = []
        self.head: Element | None = None
        self.body: Element | None = self.root if fragment else None
        self.fragment, self.form, self.foster, self.quirks, self.skip = fragment, None, False, not fragment, False

    # placing

    def place(self) -> tuple[Element, int]:
        top = self.stack[-1]
        if self.foster and top.tag in ("table", "tr") or self.foster and top.tag in _SECTION:
            table = next((e for e in reversed(self.stack) if e.tag == "table"), None)
            if table is not None and table.parent is not None:
                return table.parent, next(i for i, c in enumerate(table.parent.children) if c is table)
            if table is not None:
                top = self.stack[self.stack.index(table) - 1]
        return top, len(top.children)

    def add(self, node) -> None:
        if self.foster:
            parent, i = self.place()
        else:
            parent = self.stack[-1]
            i = len(parent.children)
        if type(node) is str:
            if i and type(parent.children[i - 1]) is str:
                parent.children[i - 1] += node
                return
        elif type(node) is Element:
            node.parent = parent
        if i == len(parent.children):
            parent.children.append(node)
        else:
            parent.children.insert(i, node)

    def open(self, tag: str, attrs: dict | None = None) -> Element:
        e = Element(tag, attrs)
        if self.foster:
            self.add(e)
        else:
            e.parent = self.stack[-1]
            e.parent.children.append(e)
        self.stack.append(e)
        return e

    def scoped(self, tags, scope=_SCOPE) -> bool:
        if not self.stack.any(tags):
            return False
        for e in reversed(self.stack):
            if e.tag in tags:
                return True
            if e.tag in scope:
                return False
        return False

    def pop_to(self, tags) -> None:
        while len(self.stack) > 1 and self.stack.pop().tag not in tags:
            pass

    def implied(self, but: str = "") -> None:
        while self.stack[-1].tag in _IMPLIED and self.stack[-1].tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.stack.tags.get("p") and self.scoped(("p",), _BUTTON):
            self.implied("p")
            self.pop_to(("p",))

    def back_to(self, tags) -> None:
        while self.stack[-1].tag not in tags and len(self.stack) > 1:
            self.stack.pop()

    # formatting

    def remember(self, e: Element) -> None:
        same = []
        for x in reversed(self.active):
            if x is None:
                break
            if x.tag == e.tag and x.attrs == e.attrs:
                same.append(x)
        if len(same) >= 3:
            self.forget(same[-1])
        self.active.append(e)

    def forget(self, e: Element) -> None:
        self.active = [x for x in self.active if x is not e]

    def to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(self.active)):
            self.active[k] = self.open(self.active[k].tag, dict(self.active[k].attrs))

    def adopt(self, tag: str) -> None:
        """The adoption agency: ends a formatting element that other elements may straddle."""
        if self.stack[-1].tag == tag and self.active and self.active[-1] is self.stack[-1]:
            self.stack.pop()
            self.active.pop()
            return
        if self.stack[-1].tag == tag and not any(x is self.stack[-1] for x in self.active):
            self.stack.pop()
            return
        for _ in range(8):
            mark = max((i for i, x in enumerate(self.active) if x is None), default=-1)
            where = next((i for i in range(len(self.active) - 1, mark, -1) if self.active[i].tag == tag), None)
            if where is None:
                self.other_end(tag)
                return
            target = self.active[where]
            at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i] is target), None) if target in self.stack else None
            if at is None:
                self.forget(target)
                return
            if not self.scoped((tag,)):
                return
            far = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].tag in _SPECIAL), None)
            if far is None:
                del self.stack[at:]
                self.forget(target)
                return
            block, ancestor, bookmark = self.stack[far], self.stack[at - 1], where
            last, i, count = block, far, 0
            while True:
                i -= 1
                node = self.stack[i]
                if node is target:
                    break
                count += 1
                listed = next((k for k, x in enumerate(self.active) if x is node), None)
                if listed is not None and count > 3:
                    del self.active[listed]
                    bookmark -= listed < bookmark
                    listed = None
                if listed is None:
                    del self.stack[i]
                    continue
                fresh = Element(node.tag, dict(node.attrs))
                self.active[listed] = self.stack[i] = fresh
                if last is block:
                    bookmark = listed + 1
                _move(last, fresh, len(fresh.children))
                last = fresh
            if ancestor.tag in ("table", "tr") or ancestor.tag in _SECTION:
                keep, self.foster = (self.stack, self.foster), True
                self.stack = _Open(self.stack[: next(k for k, e in enumerate(self.stack) if e is ancestor) + 1])
                _detach(last)
                parent, where_to = self.place()
                self.stack, self.foster = keep
            else:
                _detach(last)
                parent, where_to = ancestor, len(ancestor.children)
            _move(last, parent, where_to)
            fresh = Element(target.tag, dict(target.attrs))
            fresh.children, block.children = block.children, [fresh]
            for c in fresh.children:
                if type(c) is Element:
                    c.parent = fresh
            fresh.parent = block
            listed = next(k for k, x in enumerate(self.active) if x is target)
            del self.active[listed]
            self.active.insert(bookmark - (listed < bookmark), fresh)
            self.stack = _Open(e for e in self.stack if e is not target)
            self.stack.insert(next(k for k, e in enumerate(self.stack) if e is block) + 1, fresh)

    def other_end(self, tag: str) -> None:
        if not self.stack.any((tag,)):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            e = self.stack[i]
            if e.tag == tag:
                self.implied(tag)
                del self.stack[i:]
                return
            if e.tag in _SPECIAL:
                return

    # before the body

    def into_body(self) -> None:
        if self.body is None:
            if self.head is None:
                self.head = Element("head")
                self.add_to_root(self.head)
            self.body = Element("body")
            self.add_to_root(self.body)
            self.stack = _Open([self.root, self.body])

    def add_to_root(self, e: Element) -> None:
        e.parent = self.root
        self.root.children.append(e)

    def early(self, token: tuple) -> bool:
        """What comes before the body; True if that was all there is to do."""
        kind = token[0]
        if kind == "doctype":
            self.quirks = False
            return True
        if kind == "start":
            tag, attrs = token[1], token[2]
            if tag == "html":
                self.root.attrs = attrs | self.root.attrs
                return True
            if tag == "head":
                if self.head is None:
                    self.head = Element("head", attrs)
                    self.add_to_root(self.head)
                    self.stack = _Open([self.root, self.head])
                return True
            if tag == "body":
                self.into_body()
                self.body.attrs = attrs
                return True
            if tag in _HEAD:
                if self.head is None:
                    self.head = Element("head")
                    self.add_to_root(self.head)
                self.stack = _Open([self.root, self.head])
                self.open(tag, attrs)
                if tag in VOID:
                    self.stack.pop()
                return True
        elif kind == "end":
            if token[1] == "head":
                self.stack = _Open([self.root])
                return True
            if token[1] in _HEAD and len(self.stack) > 2 and self.stack[-1].tag == token[1]:
                self.stack.pop()
                return True
            if token[1] not in ("body", "html", "br"):
                return True
        elif kind == "comment":
            self.add(Comment(token[1]))
            return True
        elif self.stack[-1].tag in _HEAD:
            self.add(token[1])
            return True
        elif not token[1].strip(_SPACE):
            if self.head is not None:
                self.add(token[1])
            return True
        self.into_body()
        return False

    # tokens

    def feed(self, token: tuple) -> None:
        if self.body is None and self.early(token):
            return
        kind = token[0]
        skip, self.skip = self.skip, False
        if kind == "text":
            text = token[1].replace("\0", "") if "\0" in token[1] else token[1]
            if skip and text.startswith("\n"):
                text = text[1:]
            if text:
                self.text(text)
        elif kind == "comment":
            self.add(Comment(token[1]))
        elif kind == "start":
            self.start(token[1], token[2], token[3])
        elif kind == "end":
            self.end(token[1])

    def context(self) -> str:
        return self.stack.contexts[-1] if self.stack.contexts else "html"

    def text(self, text: str) -> None:
        top = self.stack[-1].tag
        if top in _TEXT_ONLY:
            self.add(text)
            return
        if top in ("table", "tr") or top in _SECTION:
            if not text.strip(_SPACE):
                self.add(text)
                return
            self.foster = True
        self.reconstruct()
        self.add(text)
        self.foster = False

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        context = self.context()
        if context == "html":  # the innermost element is no part of a table
            self.body_start(tag, attrs, closed)
            return
        if context != "template" and self.table_start(context, tag, attrs):
            return
        top = self.stack[-1].tag
        self.foster = top in ("table", "tr") or top in _SECTION
        self.body_start(tag, attrs, closed)
        self.foster = False

    def table_start(self, context: str, tag: str, attrs: dict) -> bool:
        if context in ("td", "th", "caption"):
            if tag in _PARTS:
                self.implied()
                self.pop_to((context,))
                self.to_marker()
                self.start(tag, attrs, False)
                return True
            return False
        if tag in ("td", "th"):
            if context == "tr":
                self.back_to(("tr",))
                self.open(tag, attrs)
                self.active.append(None)
            else:
                self.start("tr", {}, False)
                self.start(tag, attrs, False)
            return True
        if tag == "tr":
            if context in _SECTION:
                self.back_to((context,))
                self.open(tag, attrs)
            elif context == "tr":
                self.pop_to(("tr",))
                self.start(tag, attrs, False)
            else:
                self.start("tbody", {}, False)
                self.start(tag, attrs, False)
            return True
        if tag in _SECTION or tag in ("caption", "colgroup", "col"):
            if context == "colgroup" and tag == "col":
                self.open(tag, attrs)
                self.stack.pop()
            elif context != "table":
                self.pop_to((context,))
                self.start(tag, attrs, False)
            elif tag == "col":
                self.start("colgroup", {}, False)
                self.start(tag, attrs, False)
            else:
                self.back_to(("table",))
                self.open(tag, attrs)
                if tag == "caption":
                    self.active.append(None)
            return True
        if context == "colgroup":
            self.pop_to(("colgroup",))
            self.start(tag, attrs, False)
            return True
        if tag == "table" and self.stack[-1].tag in _CONTEXT:
            self.pop_to(("table",))
            self.start(tag, attrs, False)
            return True
        if tag in ("script", "style", "template") and self.stack[-1].tag in _CONTEXT:
            self.open(tag, attrs)
            return True
        if tag == "form" and self.stack[-1].tag in _CONTEXT:
            return True
        if tag == "input" and attrs.get("type", "").lower() == "hidden" and self.stack[-1].tag in _CONTEXT:
            self.open(tag, attrs)
            self.stack.pop()
            return True
        return False

    def body_start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in _SIMPLE:
            self.close_p()
            self.skip = tag in ("pre", "listing")
            self.open(tag, attrs)
            if closed and self.stack.any(("svg", "math")):
                self.stack.pop()
            return
        if tag == "html" or tag == "body":
            e = self.root if tag == "html" else self.body
            if not (self.fragment and tag == "body"):
                e.attrs = e.attrs | {k: v for k, v in attrs.items() if k not in e.attrs}
            return
        if tag in ("head", "frame", "frameset") or tag in _PARTS:
            return
        if tag in _HEAD:
            self.open(tag, attrs)
            if tag in VOID:
                self.stack.pop()
            return
        if tag == "image":
            tag = "img"
        if tag == "button":
            if self.scoped(("button",)):
                self.implied()
                self.pop_to(("button",))
            self.reconstruct()
        elif tag in _HEADINGS:
            self.close_p()
            if self.stack[-1].tag in _HEADINGS:
                self.stack.pop()
        elif tag == "form":
            if self.form is not None:
                return
            self.close_p()
            self.form = self.open(tag, attrs)
            return
        elif tag in ("li", "dd", "dt"):
            ends = ("li",) if tag == "li" else ("dd", "dt")
            for e in reversed(self.stack) if self.stack.any(ends) else ():
                if e.tag in ends:
                    self.implied(e.tag)
                    self.pop_to((e.tag,))
                    break
                if e.tag in _SPECIAL and e.tag not in ("address", "div", "p"):
                    break
            self.close_p()
        elif tag == "plaintext" or tag == "xmp":
            self.close_p()
            if tag == "xmp":
                self.reconstruct()
        elif tag == "a":
            mark = max((i for i, x in enumerate(self.active) if x is None), default=-1)
            for x in self.active[mark + 1 :]:
                if x.tag == "a":
                    self.adopt("a")
                    self.forget(x)
                    self.stack = _Open(e for e in self.stack if e is not x)
                    break
            self.reconstruct()
            self.remember(self.open(tag, attrs))
            return
        elif tag in _FORMAT:
            self.reconstruct()
            if tag == "nobr" and self.scoped(("nobr",)):
                self.adopt("nobr")
                self.reconstruct()
            self.remember(self.open(tag, attrs))
            return
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.open(tag, attrs)
            self.active.append(None)
            return
        elif tag == "table":
            if not self.quirks:
                self.close_p()
        elif tag == "hr":
            self.close_p()
        elif tag in ("param", "source", "track", "iframe", "noembed"):
            pass
        elif tag == "textarea":
            self.skip = True
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.stack[-1].tag == "optgroup":
                self.stack.pop()
            self.reconstruct()
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.scoped(("ruby",)):
                self.implied("rtc" if tag in ("rp", "rt") else "")
        else:
            self.reconstruct()
        self.open(tag, attrs)
        if tag in VOID:
            self.stack.pop()
        elif closed and (tag in ("svg", "math") or self.stack.any(("svg", "math"))):
            self.stack.pop()

    def end(self, tag: str) -> None:
        if tag in _CLOSED and self.stack[-1].tag == tag:
            self.stack.pop()
            return
        context = self.context()
        if tag in _TEXT_ONLY:
            if self.stack[-1].tag == tag and len(self.stack) > 1:
                self.stack.pop()
            return
        if tag == "table" or tag in _PARTS:
            if tag in ("td", "th", "caption"):
                if self.scoped((tag,), _TABLE):
                    self.implied()
                    self.pop_to((tag,))
                    self.to_marker()
            elif tag not in ("col", "colgroup") and self.scoped((tag,), _TABLE) and (tag != "tr" or context in ("tr", "td", "th")):
                while self.context() in ("td", "th", "caption"):
                    self.pop_to((self.context(),))
                    self.to_marker()
                self.pop_to((tag,))
            elif tag == "colgroup" and context == "colgroup":
                self.pop_to((tag,))
            return
        top = self.stack[-1].tag
        self.foster = top in ("table", "tr") or top in _SECTION
        if tag in ("body", "html"):
            pass
        elif tag in _FORMAT:
            self.adopt(tag)
        elif tag == "p":
            if not self.scoped(("p",), _BUTTON):
                self.open("p")
            self.close_p()
        elif tag == "br":
            self.reconstruct()
            self.open("br")
            self.stack.pop()
        elif tag == "li":
            if self.scoped(("li",), _LIST):
                self.implied("li")
                self.pop_to(("li",))
        elif tag in ("dd", "dt"):
            if self.scoped((tag,)):
                self.implied(tag)
                self.pop_to((tag,))
        elif tag in _HEADINGS:
            if self.scoped(_HEADINGS):
                self.implied()
                self.pop_to(_HEADINGS)
        elif tag == "form":
            form, self.form = self.form, None
            if form is not None and form in self.stack:
                self.implied()
                self.stack = _Open(e for e in self.stack if e is not form)
        elif tag in _BLOCK:
            if self.scoped((tag,)):
                self.implied()
                self.pop_to((tag,))
        elif tag in ("applet", "marquee", "object"):
            if self.scoped((tag,)):
                self.implied()
                self.pop_to((tag,))
                self.to_marker()
        else:
            self.other_end(tag)
        self.foster = False


def _detach(e: Element) -> None:
    if e.parent is not None:
        e.parent.children = [c for c in e.parent.children if c is not e]
        e.parent = None


def _move(e: Element, to: Element, at: int) -> None:
    _detach(e)
    e.parent = to
    to.children.insert(at, e)


def release(root: Element) -> None:
    """Takes a tree apart. Elements and their parents hold each other, so trees would else stay until a full collection."""
    stack = [root]
    while stack:
        e = stack.pop()
        stack += [c for c in e.children if type(c) is Element]
        e.parent, e.children = None, []


def document(html: str) -> Element:
    b = _Builder(False)
    for t in tokens(html):
        b.feed(t)
    b.into_body()
    return b.root


def fragment(html: str) -> Element:
    b = _Builder(True)
    for t in tokens(html):
        b.feed(t)
    return b.root
