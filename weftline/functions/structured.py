"""Structured data of a page as schema.org objects: JSON-LD, Microdata, RDFa Lite and microformats, folded by identity.

Objects are dicts with text, lists and dicts as values; `dump` prints them with sorted keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from .dom import Element, fragment


def _no_constant(name: str):
    raise ValueError(name)


def load(text: str):
    """The JSON value, or ValueError."""
    return json.loads(text, parse_constant=_no_constant)


def dump(value) -> str:
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except RecursionError:
        return _dump_deep(value)


def _dump_deep(value) -> str:
    """The same for values nested deeper than the library goes."""
    out, stack = [], [(False, value)]
    while stack:
        done, v = stack.pop()
        if done or not isinstance(v, (dict, list)):
            out.append(v if done else dump(v))
            continue
        parts: list = [(True, "{" if isinstance(v, dict) else "[")]
        for k, x in enumerate(sorted(v.items()) if isinstance(v, dict) else v):
            parts += [(True, ",")] * (k > 0) + ([(True, dump(x[0]) + ":"), (False, x[1])] if isinstance(v, dict) else [(False, x)])
        parts.append((True, "}" if isinstance(v, dict) else "]"))
        stack += reversed(parts)
    return "".join(out)


# ---- JSON-LD --------------------------------------------------------------------------------------------------


def jsonld_scripts(root: Element) -> Iterable:
    """The value of every JSON-LD script that holds JSON."""
    for e in root.iter():
        if e.tag == "script" and e.attrs.get("type", "").lower() == "application/ld+json":
            try:
                yield load(e.inner())
            except (ValueError, RecursionError):
                continue


def flatten(value) -> list[dict]:
    """The objects of a JSON-LD value: lists are opened, and objects with a @graph list stand for its members."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            graph = v.get("@graph")
            if isinstance(graph, list):
                stack.append(graph)
            else:
                out.append({k: x for k, x in v.items() if k != "@graph"})
    return out


# ---- Microdata and RDFa ---------------------------------------------------------------------------------------


def short_type(name: str) -> str | None:
    """The last part of a type's name that isn't empty."""
    return next((p for p in reversed(re.split("[:/#]", name)) if p), None)


def _properties(item: Element, scope: str, prop: str) -> list[tuple[Element, str]]:
    """The elements that are properties of an item: below it, but not below another item."""
    out, stack = [], item.elements()[::-1]
    while stack:
        e = stack.pop()
        if prop in e.attrs:
            out.append((e, e.attrs[prop]))
        if scope not in e.attrs:
            stack += e.elements()[::-1]
    return out


_LINKED = {t: "src" for t in ("audio", "embed", "iframe", "img", "source", "track", "video")} | {t: "href" for t in ("a", "area", "link")} | {"object": "data"}


def _microdata_value(e: Element) -> str:
    at = "content" if e.tag == "meta" else "value" if e.tag in ("data", "meter") else _LINKED.get(e.tag)
    if at:
        return e.attrs.get(at, "")
    if e.tag == "time" and "datetime" in e.attrs:
        return e.attrs["datetime"]
    return e.text().strip()


def _rdfa_value(e: Element) -> str:
    if "content" in e.attrs:
        return e.attrs["content"]
    at = _LINKED.get(e.tag)
    if at:
        return e.attrs.get(at, "")
    if e.tag == "time" and "datetime" in e.attrs:
        return e.attrs["datetime"]
    return e.text().strip()


def _insert(obj: dict, name: str, value) -> None:
    if name not in obj:
        obj[name] = value
    elif isinstance(obj[name], list):
        obj[name].append(value)
    else:
        obj[name] = [obj[name], value]


def _item(e: Element, scope: str, prop: str, kind: str, names: tuple[str, ...], value) -> dict:
    obj: dict = {}
    types = [t for t in map(short_type, e.attrs.get(kind, "").split()) if t]
    if types:
        obj["@type"] = types if len(types) > 1 else types[0]
    ident = next((e.attrs[n] for n in names if n in e.attrs), "").strip()
    if ident:
        obj["@id"] = ident
    for p, called in _properties(e, scope, prop):
        for name in called.split():
            _insert(obj, name, _item(p, scope, prop, kind, names, value) if scope in p.attrs else value(p))
    return obj


def microdata(root: Element) -> list[dict]:
    return [_item(e, "itemscope", "itemprop", "itemtype", ("itemid",), _microdata_value) for e in root.iter() if "itemscope" in e.attrs and "itemprop" not in e.attrs]


def rdfa(root: Element) -> list[dict]:
    return [_item(e, "typeof", "property", "typeof", ("resource", "about"), _rdfa_value) for e in root.iter() if "typeof" in e.attrs and "property" not in e.attrs]


# ---- microformats ---------------------------------------------------------------------------------------------

_ROOTS = frozenset("h-" + x for x in "adr app card cite entry event feed geo item listing measure news price product recipe resume review review-aggregate x-app".split())
#: The older formats: root class, what it is called now, and its properties as kind:class[=name].
_OLD = {
    "adr": ("h-adr", "p:country-name p:extended-address p:locality p:post-office-box p:postal-code p:region p:street-address"),
    "geo": ("h-geo", "p:latitude p:longitude"),
    "hentry": ("h-entry", "p:author p:category e:entry-content=content p:entry-summary=summary p:entry-title=name dt:published dt:updated u:url"),
    "hfeed": ("h-feed", "p:category"),
    "hrecipe": ("h-recipe", "p:author dt:duration p:fn=name p:ingredient e:instructions p:nutrition u:photo dt:published p:summary p:yield"),
    "vcard": ("h-card", "p:adr dt:bday p:category p:country-name u:email p:fn=name p:geo p:label p:locality u:logo p:nickname p:note p:org u:photo p:postal-code p:region p:role p:street-address p:tel p:title=job-title u:uid u:url"),
}


def _table(text: str) -> dict[str, tuple[str, str]]:
    out = {}
    for entry in text.split():
        kind, _, rest = entry.partition(":")
        old, _, new = rest.partition("=")
        out[old] = (kind, new or old)
    return out


_OLD_ROOTS = {k: (new, _table(props)) for k, (new, props) in _OLD.items()}


def _classes(e: Element) -> list[str]:
    return e.attrs["class"].split() if "class" in e.attrs else []


def _is_root(e: Element) -> bool:
    return any(t in _ROOTS or t in _OLD_ROOTS for t in _classes(e))


def _kinds(e: Element, table: dict | None) -> list[tuple[str, str]]:
    """(kind, name) of each property class of an element."""
    if table is not None:
        return [table[t] for t in _classes(e) if t in table]
    out = []
    for t in _classes(e):
        kind, dash, name = t.partition("-")
        if dash and kind in ("dt", "e", "p", "u") and re.search("[A-Za-z]", name):
            out.append((kind, name))
    return out


def _words(e: Element) -> str:
    return " ".join(e.text().split())


_P = {"abbr": "title", "link": "title", "data": "value", "input": "value"}
_U = {"a": "href", "area": "href", "link": "href", "audio": "src", "img": "src", "source": "src", "video": "src", "object": "data"}
_DT = {"del": "datetime", "ins": "datetime", "time": "datetime", "abbr": "title", "data": "value", "input": "value"}


def _mf_value(e: Element, kind: str):
    if kind == "e":
        return {"html": e.inner().strip(), "value": _words(e)}
    if kind == "p" and e.tag in ("area", "img"):
        return e.attrs.get("alt", "").strip()
    at = {"p": _P, "u": _U, "dt": _DT}[kind].get(e.tag)
    return e.attrs[at].strip() if at and at in e.attrs else _words(e)


def _mf_item(e: Element) -> dict:
    tokens = _classes(e)
    types, table = [t for t in tokens if t in _ROOTS], None
    if not types:
        types, table = next(([_OLD_ROOTS[t][0]], _OLD_ROOTS[t][1]) for t in tokens if t in _OLD_ROOTS)
    props: dict[str, list] = {}
    children: list[dict] = []
    stack = e.elements()[::-1]
    while stack:
        c = stack.pop()
        kinds = _kinds(c, table)
        if _is_root(c):
            nested = _mf_item(c)
            if not kinds:
                children.append(nested)
                continue
            name = nested["properties"].get("name", [None])[0]
            nested = nested | {"value": name if isinstance(name, str) else _words(c)}
            for _, called in kinds:
                props.setdefault(called, []).append(nested)
        else:
            for kind, called in kinds:
                props.setdefault(called, []).append(_mf_value(c, kind))
            stack += c.elements()[::-1]
    out: dict = {"type": types, "properties": props}
    return out | {"children": children} if children else out


def microformats(root: Element) -> list[dict]:
    """The page's outermost microformats, in their canonical form."""
    out = []
    stack = [root]
    while stack:
        e = stack.pop()
        if _is_root(e):
            item = _mf_item(e)
            if item["type"][0] in ("h-adr", "h-geo") and not item["properties"] and "children" not in item:
                continue
            out.append(item)
        else:
            stack += e.elements()[::-1]
    return out


_SCHEMA = {"h-adr": "PostalAddress", "h-card": "Person", "h-entry": "Article", "h-event": "Event", "h-geo": "GeoCoordinates", "h-product": "Product", "h-recipe": "Recipe", "h-review": "Review"}
_ANY = {"author": "author", "featured": "image", "name": "name", "photo": "image", "published": "datePublished", "summary": "description", "updated": "dateModified", "url": "url"}
_OWN = {
    "h-card": {"adr": "address", "email": "email", "job-title": "jobTitle", "org": "worksFor", "tel": "telephone"},
    "h-entry": {"category": "keywords", "content": "articleBody"},
    "h-event": {"end": "endDate", "location": "location", "start": "startDate"},
    "h-product": {"brand": "brand", "identifier": "productID", "price": "price", "review": "review"},
    "h-recipe": {"category": "recipeCategory", "cuisine": "recipeCuisine", "duration": "totalTime", "ingredient": "recipeIngredient", "instructions": "recipeInstructions", "nutrition": "nutrition", "yield": "recipeYield"},
    "h-review": {"item": "itemReviewed", "rating": "reviewRating"},
}


def _steps(html: str) -> list[str]:
    root = fragment(html)
    for tag in ("li", "p"):
        found = [t for t in (_words(e) for e in root.iter() if e.tag == tag) if t]
        if found:
            return found
    return []


def _schema_values(values: list, steps: bool):
    out: list[str] = []
    for v in values:
        if isinstance(v, dict):
            parts = _steps(v["html"]) if steps and isinstance(v.get("html"), str) else []
            if len(parts) > 1:
                out += parts
                continue
            v = v["value"] if isinstance(v.get("value"), str) else parts[0] if parts else ""
        if isinstance(v, str) and v.strip():
            out.append(v.strip())
    return out[0] if len(out) == 1 else out


def to_schema(items: list[dict]) -> list[dict]:
    """Microformats as schema.org objects; those without a counterpart are left out."""
    out = []
    for item in items:
        kind = next((t for t in item["type"] if t.startswith("h-")), None)
        if kind not in _SCHEMA:
            continue
        obj: dict = {"@type": _SCHEMA[kind]}
        for name in sorted(item["properties"]):
            key = _OWN.get(kind, {}).get(name) or _ANY.get(name)
            if key is None:
                continue
            value = _schema_values(item["properties"][name], key == "recipeInstructions")
            if value and key not in obj:
                obj[key] = value
        if len(obj) > 1:
            out.append(obj)
    return out


# ---- folding --------------------------------------------------------------------------------------------------


def _name(obj: dict) -> str | None:
    name = obj.get("name")
    if isinstance(name, list):
        name = name[0] if name else None
    return ("".join(c.lower() if c.isascii() else c for c in name.strip()) or None) if isinstance(name, str) else None


def _last_type(obj: dict) -> str | None:
    kind = obj.get("@type")
    if isinstance(kind, list):
        kind = kind[0] if kind else None
    return re.split("[:/#]", kind)[-1] if isinstance(kind, str) else None


def fold(base: list[dict], extra: list[dict]) -> list[dict]:
    """base with each of extra: into the first object of the same name and type (what that lacks is filled in), or
    after it."""
    out = list(base)
    for obj in extra:
        name = _name(obj)
        at = next((i for i, x in enumerate(out) if name is not None and _name(x) == name and _last_type(x) == _last_type(obj)), None)
        if at is None:
            out.append(obj)
            continue
        empty = lambda v: v is None or v == [] or (isinstance(v, str) and not v.strip())
        out[at] = out[at] | {k: v for k, v in obj.items() if empty(out[at].get(k))}
    return out


def entities(root: Element) -> list[dict]:
    """All structured data of a page."""
    found = [x for v in jsonld_scripts(root) for x in flatten(v)]
    for more in (microdata(root), rdfa(root), to_schema(microformats(root))):
        found = fold(found, more)
    return found
