"""URLs as browsers read them: parsing, resolving, printing and canonical forms. Plain functions on strings.

Covers the WHATWG rules that web pages exercise: default ports, dot segments, backslashes, percent-encoding by
component, IPv4 in its odd spellings, IPv6, international host names. A URL that can't be read gives None.
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import idna

PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_EDGE = "".join(map(chr, range(33)))
_FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_PLAIN = re.compile(r"[a-z0-9.-]+")


class Url(NamedTuple):
    scheme: str
    user: str
    host: str | None
    port: int | None
    path: str
    query: str | None
    fragment: str | None
    opaque: bool

    def __str__(self) -> str:
        out = [self.scheme, ":"]
        if self.host is not None:
            out += ["//", f"{self.user}@" if self.user else "", self.host, f":{self.port}" if self.port is not None else ""]
        elif not self.opaque and self.path.startswith("//"):
            out.append("/.")
        out += [self.path, "" if self.query is None else f"?{self.query}", "" if self.fragment is None else f"#{self.fragment}"]
        return "".join(out)


def _encoder(more: str):
    bad = re.compile("[^\\x21-\\x7e]|[" + "".join(f"\\x{ord(c):02x}" for c in more) + "]")

    def encode(s: str) -> str:
        return bad.sub(lambda m: "".join(f"%{b:02X}" for b in m.group().encode("utf-8", "replace")), s)

    return encode


_fragment_of, _path_of, _query_of, _query_plain, _user_of = (_encoder(x) for x in ('"<>`', '"<>`#?{}', "\"<>#'", '"<>#', "\"<>`#?{}/:;=@[\\]^|"))


def _opaque(s: str) -> str:
    return re.sub(r"[^\x20-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode("utf-8", "replace")), s)


def _ipv4(host: str) -> str | bool | None:
    """The address in its usual form; None if the host is no address; False if it is a broken one."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not (parts[-1].isdigit() and parts[-1].isascii() or re.fullmatch(r"0[xX][0-9a-fA-F]*", parts[-1])):
        return None
    if len(parts) > 4:
        return False
    numbers = []
    for p in parts:
        try:
            if p[:2].lower() == "0x":
                numbers.append(int(p[2:] or "0", 16))
            elif len(p) > 1 and p[0] == "0":
                numbers.append(int(p, 8))
            else:
                numbers.append(int(p) if p.isdigit() and p.isascii() else int("x"))
        except ValueError:
            return False
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return False
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


@lru_cache(1 << 14)
def ascii_host(host: str) -> str | None:
    """The host as it travels: lower case, international names in their ASCII form."""
    if host.isascii():
        out = host.lower()
    else:
        try:
            mapped = idna.uts46_remap(host, std3_rules=False, transitional=False)
        except idna.IDNAError:
            return None
        labels = []
        for label in re.split("[.。．｡]", mapped):
            if label.isascii():
                labels.append(label.lower())
                continue
            try:
                labels.append(idna.alabel(label).decode())
            except idna.IDNAError:
                labels.append("xn--" + label.encode("punycode").decode())
        out = ".".join(labels)
    return out or None


def _host(raw: str, special: bool) -> str | None:
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    if not special:
        return None if re.search(r"[\x00\t\n\r #/<>?@\[\\\]^|]", raw) else _opaque(raw)
    if not _PLAIN.fullmatch(raw):
        raw = unquote_to_bytes(raw).decode("utf-8", "replace") if "%" in raw else raw
        raw = ascii_host(raw) or ""
        if not raw or _FORBIDDEN.search(raw):
            return None
    number = _ipv4(raw)
    return raw if number is None else number or None


def _dots(path: str, special: bool, start: list[str]) -> str:
    out, parts = list(start), re.split(r"[/\\]", path) if special else path.split("/")
    for k, p in enumerate(parts):
        low = p.lower().replace("%2e", ".") if "." in p or "%2" in p else p
        last = k == len(parts) - 1
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(_path_of(p))
    return "/" + "/".join(out)


def parse(text: str, base: Url | None = None) -> Url | None:
    s = text.strip(_EDGE)
    if "\t" in s or "\n" in s or "\r" in s:
        s = re.sub(r"[\t\n\r]", "", s)
    s, mark, fragment = s.partition("#")
    fragment = _fragment_of(fragment) if mark else None
    found = _SCHEME.match(s)
    scheme = found.group(1).lower() if found else ""
    if found:
        s = s[found.end() :]
        special = scheme in PORTS
        if not special and not s.startswith("/"):
            rest, mark, query = s.partition("?")
            return Url(scheme, "", None, None, _opaque(rest), _query_plain(query) if mark else None, fragment, True)
    else:
        if base is None:
            return None
        if base.opaque:
            return base._replace(fragment=fragment) if not s and mark else None
        scheme, special = base.scheme, base.scheme in PORTS
    rest, mark, query = s.partition("?")
    query = (_query_of if special else _query_plain)(query) if mark else None
    slashes = rest.replace("\\", "/") if special else rest
    relative = base is not None and (not found or (special and base.scheme == scheme and scheme != "file" and not slashes.startswith("/")))
    if special and found and not relative and scheme != "file":
        rest = rest.lstrip("/\\")
    elif slashes.startswith("//"):
        rest = rest[2:]
    elif relative:
        if not rest:
            return base._replace(query=base.query if query is None else query, fragment=fragment)
        start = [] if slashes.startswith("/") else [x for x in base.path.split("/")[1:-1]]
        return base._replace(path=_dots(rest[1:] if slashes.startswith("/") else rest, special, start), query=query, fragment=fragment)
    else:
        return Url(scheme, "", "" if special else None, None, _dots(rest.lstrip("/\\") if special else rest[1:], special, []), query, fragment, False)
    end = re.search(r"[/\\]", rest) if special else re.search("/", rest)
    authority, path = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    user, at, place = authority.rpartition("@")
    if at:
        name, colon, word = user.partition(":")
        user = _user_of(name) + (f":{_user_of(word)}" if colon and word else "")
    port = None
    number = re.search(r":([^:\]]*)$", place)
    if number:
        place = place[: number.start()]
        if number.group(1):
            if not (number.group(1).isascii() and number.group(1).isdigit()) or int(number.group(1)) > 65535:
                return None
            port = int(number.group(1))
    if scheme == "file" and not place:
        host = ""
    else:
        if not place:
            return None if special or number or at else Url(scheme, "", "", None, _dots(path[1:], special, []) if path else "", query, fragment, False)
        host = _host(place, special)
        if host is None:
            return None
    if port == PORTS.get(scheme):
        port = None
    return Url(scheme, user, host, port, _dots(path[1:], special, []) if path or special else "", query, fragment, False)


@lru_cache(1 << 12)
def parsed(text: str) -> Url | None:
    return parse(text)


def resolve(href: str, base: Url) -> str | None:
    """The absolute http(s) address of a link on the page at base."""
    if href.startswith("//"):
        url = parse(f"{base.scheme}:{href}")
    else:
        url = (parse(href) if ":" in href else None) or parse(href, base)
    return str(url) if url is not None and url.scheme in ("http", "https") else None


# ---- canonical forms ------------------------------------------------------------------------------------------

_TRACKERS = frozenset("_ga fbclid gclid igshid mc_cid mc_eid ref_src ref_url".split())
_SHARES = frozenset("_r _t feature igsh is_from_webapp rdt ref s sender_device share_app_id share_id si spm".split())
#: Hosts of social platforms; a trailing dot-star stands for any national suffix.
SOCIAL = ("facebook.com", "instagram.com", "linkedin.com", "pinterest.*", "reddit.com", "tiktok.com", "twitter.com", "x.com", "youtu.be", "youtube.com")
_SOCIAL = re.compile(r"(?:.*\.)?(?:" + "|".join(re.escape(h[:-1]) + r"[a-z]{2,3}(?:\.[a-z]{2})?" if h.endswith(".*") else re.escape(h) for h in SOCIAL) + ")")


def is_social_host(host: str) -> bool:
    return _SOCIAL.fullmatch(host.lower()) is not None


def normalize_domain(host: str) -> str:
    low = "".join(c.lower() if c.isascii() else c for c in host)
    name = ascii_host(low) or low
    return name[4:] if name.startswith("www.") and len(name) > 4 else name


def _pairs(query: str) -> list[tuple[str, str]]:
    """Form-decoded names and values."""
    read = lambda x: unquote_to_bytes(x.replace("+", " ")).decode("utf-8", "replace")
    return [(read(k), read(v)) for k, _, v in (p.partition("=") for p in query.split("&") if p)]


def _set_host(url: Url, host: str) -> Url:
    new = _host(host, url.scheme in PORTS)
    return url if new is None else url._replace(host=new)


def _canonical(text: str) -> tuple[Url | None, str]:
    low = text[:8].lower()
    if not low.startswith(("http://", "https://")) and "." in text:
        url = parse(f"https://{text}")
    else:
        url = parse(text)
    if url is None:
        return None, text
    if url.scheme in PORTS and url.scheme != "file":
        url = url._replace(scheme="https", port=None if url.port == 443 else url.port)
    if url.host:
        url = _set_host(url, normalize_domain(url.host))
    if not url.opaque:
        path = url.path.rstrip("/")
        url = url._replace(path=path or ("/" if url.scheme in PORTS else ""))
    if url.query is not None:
        kept = {k: v for k, v in _pairs(url.query) if not k.startswith("utm_") and k not in _TRACKERS}
        url = url._replace(query=_query_of("&".join(f"{k}={kept[k]}" for k in sorted(kept))) if kept else None)
    url = url._replace(fragment=None)
    return url, str(url).rstrip("/")


def normalize_url(text: str) -> str:
    """One spelling for all addresses of a page; what isn't an address comes back as it is."""
    return _canonical(text)[1]


def normalize_social(text: str) -> str:
    """normalize_url, and on social platforms without mobile host and share tokens: the key for fetching."""
    plain = normalize_url(text)
    url = parse(plain)
    if url is None or not url.host or not is_social_host(url.host):
        return plain
    for mobile in ("m.", "mobile."):
        if url.host.startswith(mobile):
            url = _set_host(url, url.host[len(mobile) :])
            break
    if url.query is not None:
        kept = [(k, v) for k, v in _pairs(url.query) if k not in _SHARES]
        url = url._replace(query=_query_of("&".join(f"{k}={v}" for k, v in kept)) if kept else None)
    return str(url).rstrip("/")


def host_of(text: str) -> str | None:
    url = parsed(text)
    return url.host.lower() if url is not None and url.host else None


def is_social_url(text: str) -> bool:
    host = host_of(text)
    return host is not None and is_social_host(host)
