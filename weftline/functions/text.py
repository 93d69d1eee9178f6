"""Text of pages: entities, Unicode, contacts in it, body, metadata, Markdown. Plain functions on strings and trees."""

from __future__ import annotations

import html
import re
import unicodedata

from .dom import Comment, Element

_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_DROPPED = re.compile("[\u200b\u200c\u200d\ufeff]")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def decode_entities(s: str) -> str:
    """Named and numeric entities that end in a semicolon; unknown names stay."""

    def one(m: re.Match) -> str:
        got = html.unescape(m.group())
        return m.group() if m.group()[1] != "#" and got.endswith(";") and len(got) > 1 else got

    return _ENTITY.sub(one, s) if "&" in s else s


def normalize_text(s: str) -> str:
    s = unicodedata.normalize("NFC", decode_entities(s))
    s = _CONTROL.sub("", _DROPPED.sub("", s).replace("\r", "\n"))
    return " ".join(re.sub("[\x1c-\x1f]", "", s).split())


# ---- contacts -------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,24}\b", re.I)
_LOCAL = re.compile(r"[a-z0-9._%+-]", re.I)
_WORD = re.compile(r"\w")
_PHONE = re.compile(r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}")


def _hrefs(root: Element, scheme: str) -> list[str]:
    found = (e.attrs["href"] for e in root.iter() if e.tag == "a" and e.attrs.get("href", "").startswith(scheme))
    return [x for x in (h[len(scheme) :].partition("?")[0].strip() for h in found) if x]


def find_emails(text: str) -> list[str]:
    """All addresses in a text, from left to right; a name begins at a word's edge. Every @ is looked at once, so long
    runs of name characters cost no more than their length."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            first = at
            while first > free and _LOCAL.match(text[first - 1]):
                first -= 1
            edge = next((i for i in range(first, at) if bool(_WORD.match(text[i])) != (i > 0 and bool(_WORD.match(text[i - 1])))), None)
            if edge is not None:
                out.append(text[edge : m.end()])
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def emails(root: Element, text: str | None = None) -> list[str]:
    """Addresses in mailto links, then those in the text; as they stand, repeated ones too."""
    text = " ".join(root.texts()) if text is None else text
    return _hrefs(root, "mailto:") + find_emails(text)


def phones(root: Element, text: str | None = None) -> list[str]:
    return _hrefs(root, "tel:") + _PHONE.findall(" ".join(root.texts()) if text is None else text)


# ---- parts of a page ------------------------------------------------------------------------------------------


def body(root: Element) -> str:
    found = root.first("body")
    return (root if found is None else found).outer()


def metadata(root: Element) -> list[tuple[str, str]]:
    """Title, meta tags in order, language."""
    out = []
    title = root.first("title")
    if title is not None and title.text().strip():
        out.append(("title", title.text().strip()))
    for e in root.iter():
        if e.tag == "meta":
            name, value = e.attrs.get("name", e.attrs.get("property")), e.attrs.get("content")
            if name is not None and value is not None and value.strip():
                out.append((name, value))
    if "lang" in root.attrs:
        out.append(("lang", root.attrs["lang"]))
    return out


# ---- Markdown -------------------------------------------------------------------------------------------------

_SKIPPED = frozenset(("head", "iframe", "noscript", "script", "style", "svg"))
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_ESCAPE = re.compile(r"([\\`*_\[\]])")


def _rows(table: Element) -> list[Element]:
    """A table's own rows; those of tables in its cells are text there."""
    out, stack = [], table.elements()[::-1]
    while stack:
        e = stack.pop()
        if e.tag == "tr":
            out.append(e)
        elif e.tag != "table":
            stack += e.elements()[::-1]
    return out


class _Markdown:
    def __init__(self):
        self.marks: set[str] = set()  # emphasis within emphasis of the same kind isn't marked again

    def marked(self, e: Element) -> str:
        """The text of an element, between its marks."""
        mark = "**" if e.tag in ("b", "strong") else "*" if e.tag in ("em", "i") else "~~" if e.tag in ("del", "s", "strike") else ""
        fresh = mark and mark not in self.marks
        if fresh:
            self.marks.add(mark)
        text = self.inline(e.children)
        if fresh:
            self.marks.discard(mark)
        core = text.strip()
        if not fresh or not core:
            return text
        return " " * text[0].isspace() + mark + core + mark + " " * text[-1].isspace()

    def inline(self, nodes: list) -> str:
        out = []
        for c in nodes:
            if type(c) is str:
                out.append(_ESCAPE.sub(r"\\\1", re.sub(r"[ \t\n\r\f]+", " ", c)))
            elif type(c) is Element and c.tag not in _SKIPPED:
                out.append(self.piece(c))
        return re.sub(" *\n *", "\n", re.sub(r"[ \t]+", " ", "".join(out)).replace(" \x00", "\x00")).replace("\x00", "  \n")

    def piece(self, e: Element) -> str:
        if e.tag == "br":
            return "\x00"
        if e.tag == "img":
            return f"![{e.attrs.get('alt', '')}]({e.attrs['src']})" if e.attrs.get("src") else ""
        if e.tag in ("code", "kbd", "samp", "tt"):
            return f"`{' '.join(e.text().split())}`" if e.text().strip() else ""
        text = self.marked(e)
        core = text.strip()
        if not core:
            return " " if text else ""
        left, right = " " * text[0].isspace(), " " * text[-1].isspace()
        if e.tag == "a" and "href" in e.attrs:
            title = e.attrs.get("title", "").replace('"', '\\"')
            core = f"[{core}]({e.attrs['href']}" + (f' "{title}"' if title else "") + ")"
        return left + core + right

    def blocks(self, nodes: list) -> list[str]:
        out: list[str] = []
        line: list = []

        def flush() -> None:
            text = self.inline(line).strip()
            if text:
                out.append(text)
            line.clear()

        for c in nodes:
            if type(c) is Comment or (type(c) is Element and c.tag in _SKIPPED):
                continue
            if type(c) is str or (c.tag in _INLINE and not any(x.tag not in _INLINE for x in c.iter())):
                line.append(c)
                continue
            flush()
            out += self.block(c)
        flush()
        return out

    def block(self, e: Element) -> list[str]:
        if re.fullmatch("h[1-6]", e.tag):
            text = self.inline(e.children).strip().replace("\n", " ")
            return [f"{'#' * int(e.tag[1])} {text}"] if text else []
        if e.tag in ("ul", "ol", "menu", "dir"):
            start = int(e.attrs["start"]) if e.attrs.get("start", "").isdigit() else 1
            items = []
            for k, li in enumerate(x for x in e.elements() if x.tag == "li"):
                mark = f"{start + k}. " if e.tag == "ol" else "* "
                inner = self.blocks(li.children)
                lists = all(re.match(r"(\* |\d+\. )", b) for b in inner[1:])
                items.append(mark + ("\n" if lists else "\n\n").join(inner).replace("\n", "\n" + " " * len(mark)))
            return ["\n".join(items)] if items else []
        if e.tag == "blockquote":
            inner = "\n\n".join(self.blocks(e.children))
            return ["\n".join(("> " + x).rstrip() for x in inner.split("\n"))] if inner else []
        if e.tag in ("pre", "listing"):
            return ["```\n" + e.text().strip("\n") + "\n```"]
        if e.tag == "hr":
            return ["---"]
        if e.tag == "table":
            rows = [[self.inline(c.children).strip().replace("|", "\\|").replace("\n", " ") for c in r.elements() if c.tag in ("td", "th")] for r in _rows(e)]
            rows = [r for r in rows if r]
            if not rows:
                return []
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            return ["\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])]
        return self.blocks(e.children)


def to_markdown(root: Element) -> str:
    return "\n\n".join(_Markdown().blocks(root.children))
