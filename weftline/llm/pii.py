"""PII: format-preserving pseudonyms by a keyed Feistel permutation.

What is found (and validated): card numbers of 13 to 19 digits whose Luhn sum is right, IBANs whose remainder is 1,
phone numbers of 10 to 15 digits written as such, US social security numbers, IPv4 addresses with octets up to 255,
calendar dates (ISO, or day and month with slashes or dots), e-mail addresses, and values assigned to a name like
token or password. Each value is numbered within the set of all values of its format, that number goes through a
balanced Feistel network (blake2b keyed with `key` as round function, walking along the cycle until the result is in
the set), and the value with the resulting number takes its place. So a card stays a valid card of that length, a date
a real date, a phone number keeps its brackets and its country code, and equal values get equal pseudonyms in every
document, whatever separators or letter case they are written with; whoever has the key can go back (back=True).

All values are found in the text as it is and replaced at once: first values assigned to a name, then addresses, then
IBANs, then numbers, none inside another. Numbers that stand together, apart by single spaces or dashes, are read in
whatever way leaves most digits in valid values (`_best`): every span of whole groups of digits is held against every
format. What replaces a value must be found in the same place of the new text: a hex secret stays one, and a number is
replaced again until the same spans as before are chosen around it. So the way back finds the same values, undoes the last first, and always comes out at the original text;
only where such a neighbour is in the way a value gets another pseudonym than elsewhere.

Not touched: numbers that fail validation, as they are then no card, address or date; cards written in other groups
than the usual ones where a group has a single digit; the domains of addresses.

Edge cases: a null text stays null, an empty one empty; very long texts and values are read whole, in time proportional
to their length (values go through the permutation in pieces of PIECE characters); repeated rows get equal results;
other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import measured, packed_rows, pieces, unpacked

ROUNDS = 8
#: Characters of a value that are permuted together.
PIECE = 1024
_DAYS = (date(2100, 1, 1) - date(1900, 1, 1)).days
_BASE = date(1900, 1, 1).toordinal()


# ---- the permutation ------------------------------------------------------------------------------------------


def _round(key: bytes, tweak: bytes, i: int, half: int, modulus: int) -> int:
    """A number below modulus from a digest that has 16 bytes more than it, however large it is."""
    size = (modulus.bit_length() + 7) // 8
    data = half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
    if size <= 16:
        digest = hashlib.blake2b(data, key=key, salt=tweak[:15] + bytes([i]), digest_size=32).digest()
    else:
        digest = hashlib.shake_256(hashlib.blake2b(data, key=key, salt=tweak[:15] + bytes([i])).digest()).digest(size + 16)
    return int.from_bytes(digest, "big") % modulus


def permute(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size); back: its inverse."""
    if size < 2:
        return x
    tweak = hashlib.blake2b(tweak + str(size).encode(), digest_size=15).digest()
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        if not back:
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + _round(key, tweak, i, left, b)) % b
                else:
                    left = (left + _round(key, tweak, i, right, a)) % a
        else:
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    right = (right - _round(key, tweak, i, left, b)) % b
                else:
                    left = (left - _round(key, tweak, i, right, a)) % a
        x = left * b + right
        if x < size:
            return x


# ---- formats --------------------------------------------------------------------------------------------------


_DOUBLED = str.maketrans("0123456789", "0246813579")  # of a doubled digit, its digits summed


def _luhn_digit(payload: str) -> str:
    back = payload[::-1]
    return str(-(sum(map(int, back[::2].translate(_DOUBLED))) + sum(map(int, back[1::2]))) % 10)


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(filter(str.isdigit, text))


def _card(m: str, p) -> str | None:
    d = _digits(m)
    if _luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    if p is _same:
        return m
    n = len(d) - 1
    x = int(d[:-1])
    while True:
        x = p(x, 10**n, b"card")
        new = str(x).zfill(n)
        new += _luhn_digit(new)
        if len(set(new)) > 1:
            return _fill(m, new)


def _phone(m: str, p) -> str | None:
    d = _digits(m)
    if not 10 <= len(d) <= 15:
        return None
    n = 10 if len(d) > 10 or not m.startswith("+") else 9
    head, tail = d[: len(d) - n], d[len(d) - n :]
    return _fill(m, head + str(p(int(tail), 10**n, b"phone")).zfill(n))


def _ssn(m: str, p) -> str | None:
    a, g, s = (int(x) for x in m.split("-"))
    if not (0 < a < 900 and a != 666 and g and s):
        return None
    rank = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
    rank = p(rank, 898 * 99 * 9999, b"ssn")
    rank, s = divmod(rank, 9999)
    a, g = divmod(rank, 99)
    a = a + 1 + (a + 1 >= 666)
    return f"{a:03d}-{g + 1:02d}-{s + 1:04d}"


def _ip(m: str, p) -> str | None:
    parts = m.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    x = p(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _date(m: str, p) -> str | None:
    a, sep, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", m).groups()
    try:
        if len(a) == 4:
            day = date(int(a), int(b), int(c))
        else:
            day = date(int(c), int(b), int(a)) if sep == "." or int(a) > 12 else date(int(c), int(a), int(b))
    except ValueError:
        return None
    if not 0 <= day.toordinal() - _BASE < _DAYS:
        return None
    # a slash date with a day of 13 or more must not turn into one that reads the other way, nor one digit into two
    monthly = len(a) != 4 and sep == "/" and int(a) <= 12
    x = day.toordinal() - _BASE
    while True:
        x = p(x, _DAYS, b"date-us" if monthly else b"date-eu" if len(a) != 4 and sep == "/" else b"date")
        new = date.fromordinal(_BASE + x)
        if len(a) == 4:
            return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
        first, second = (new.month, new.day) if monthly else (new.day, new.month)
        if (sep == "." or monthly or first > 12) and first < 10 ** len(a) and second < 10 ** len(b):
            return f"{first:0{len(a)}d}{sep}{second:0{len(b)}d}{sep}{new.year:04d}"


def _remainder(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(s: str) -> bool:
    """Whether s, without spaces, is an IBAN."""
    return 15 <= len(s) <= 34 and "02" <= s[2:4] <= "98" and _remainder(s) == 1


def _iban_end(s: str, m: re.Match) -> int | None:
    """Where the longest IBAN ends that begins where m does."""
    ends = [m.end()] + [x.end() for x in _IBAN_PART.finditer(s, m.start(), m.end())][::-1]
    return next((e for e in ends if s[e : e + 1] not in _WORD and _iban(s[m.start() : e].replace(" ", ""))), None)


def _mixed(value: str, p, tweak: bytes) -> str:
    """Permutes digits within digits and letters within letters (a mixed-radix number); the case and the rest stay."""
    if len(value) > PIECE:
        return "".join(_mixed(value[i : i + PIECE], p, tweak + b"%d" % i) for i in range(0, len(value), PIECE))
    x, size = 0, 1
    for c in value:
        if c.isdigit():
            x, size = x * 10 + int(c), size * 10
        elif c.isalpha():
            x, size = x * 26 + ord(c.lower()) - 97, size * 26
    shape = "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in value)
    x = p(x, size, tweak + shape.encode())
    out = []
    for c in reversed(value):
        if c.isdigit():
            x, r = divmod(x, 10)
            c = str(r)
        elif c.isalpha():
            x, r = divmod(x, 26)
            c = chr(97 + r) if c.islower() else chr(65 + r)
        out.append(c)
    return "".join(reversed(out))


def _email(m: str, p) -> str:
    local, at, domain = m.rpartition("@")
    return _mixed(local, p, b"email@" + domain.lower().encode()) + at + domain


def _is_hex(value: str) -> bool:
    return _HEX.fullmatch(value) is not None and not value.isdigit() and not value.isalpha()


def _hex(value: str, p) -> str:
    if len(value) > PIECE:
        return "".join(_hex(value[i : i + PIECE], p) for i in range(0, len(value), PIECE))
    new = f"{p(int(value, 16), 16 ** len(value), b'hex'):x}".zfill(len(value))
    return new.upper() if value.upper() == value else new


def _secret(value: str, p) -> str:
    """Hex stays hex with letters and digits; of others digits stay digits and letters letters."""
    case = value.isupper()
    if _is_hex(value):
        while True:
            value = _hex(value.upper() if case else value.lower(), p)
            if _is_hex(value) and value.isupper() == case:
                return value
    while True:
        value = _mixed(value, p, b"secret")
        if not _is_hex(value):
            return value


_NAME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+", re.A)
_SECRET = re.compile(r"""(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)\s*[=:]\s*["'])([A-Za-z0-9_+/=-]{8,})(?=["'])""", re.A)
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+", re.A)
_DATE = re.compile(r"(?<![\w.+-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([/.])\d{1,2}\1\d{4})(?=T\d|(?![\w-]|\.\d))", re.A)
_IP = re.compile(r"(?<![\w.+-])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", re.A)
_SSN = re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
_PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|(?<![+-])\d{3}[.-]\d{3}[.-]\d{4}", re.A)
_CARD = re.compile(r"\d{2,}(?:[ -]\d{2,})*", re.A)
#: How cards are usually grouped.
_CARD_SHAPE = re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}", re.A)
#: Numbers that stand together; all that is looked for in them begins and ends with a group of digits.
_REGION = re.compile(r"(?<!\d)[+(]{0,2}\d[\d ./()+-]{5,}", re.A)
_GROUP = re.compile(r"[+(]?\d+", re.A)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)
_IBAN_PART = re.compile(r"[A-Z0-9]{4}", re.A)
_MAKERS = {"date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}
#: Digits and characters within which a value of numbers lies, and so many groups at most.
_DIGITS, _CHARS = 19, 48


_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _same(x: int, *_) -> int:
    return x


def _candidates(s: str, i: int, ends: list[int], counts: list[int]) -> Iterator[tuple[int, str, int]]:
    """(end, kind, weight) of the valid values that begin at i; ends: where the groups of digits from there on end;
    counts: the digits up to there."""
    before, before2 = s[i - 1 : i], s[i - 2 : i - 1] if i > 1 else ""
    if s[i].isdigit():
        for kind, pattern, digits in (("date", _DATE, 8), ("ip", _IP, 12), ("ssn", _SSN, 9)):
            if (m := pattern.match(s, i)) and _MAKERS[kind](m.group(), _same):
                yield m.end(), kind, 1000 * digits
    word = before in _WORD
    inner = before == "-" and before2.isdigit()
    phone = not word and before != "." and (s[i] in "+(" or s[i + 3 : i + 4] in (".", "-"))
    for end, digits in zip(ends, counts):
        after = s[end : end + 1]
        if not 10 <= digits <= _DIGITS or after in _WORD or (after == "." and s[end + 1 : end + 2].isdigit()):
            continue
        dash = after == "-" and s[end + 1 : end + 2].isdigit()
        value = s[i:end]
        if phone and not dash and _PHONE.fullmatch(s, i, end) and _phone(value, _same):
            yield end, "phone", 1000 * digits
        if digits < 13 or word or before in (".", "+") and before or before == "-" and not inner or not value[0].isdigit():
            continue
        usual = _CARD_SHAPE.fullmatch(value)
        if not usual and not _CARD.fullmatch(value) or (inner or dash) and (not usual or "-" in value):
            continue
        if _card(value, _same):
            yield end, "card", 1000 * digits if usual else digits


class _Numbers:
    """The groups of digits of a region of a text, what is between them, and which spans of groups are valid values."""

    def __init__(self, s: str, start: int, end: int, taken: list[tuple[int, int]]):
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(s, start, end)]
        if taken:
            groups = [g for g in groups if not any(i < g[1] and g[0] < j for i, j in taken)]
        self.spots, self.groups = groups, [s[i:j] for i, j in groups]
        edges = [start - 2 if start > 1 else 0, *(x for g in groups for x in g), end + 2]
        #: between[n] precedes group n; two characters around the region count as well
        self.between = [s[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)]
        self.valid = [self.at(n) for n in range(len(groups))]

    def at(self, n: int) -> list[tuple[int, str, int, int]]:
        """(groups, kind, weight, characters passed over) of the valid values that begin in group n."""
        groups, between = self.groups, self.between
        if len(groups[n]) == 1 and between[n + 1][:1] not in (".", "/"):
            return []  # a digit by itself begins dates and IPv4 addresses only
        before = "".join(x for k in range(max(0, n - 2), n) for x in (between[k], groups[k])) + between[n]
        text, end, alone = [before, groups[n]], len(before) + len(groups[n]), n + 1
        digits = len(groups[n]) - (groups[n][0] in "+(")
        ends, counts = [end], [digits]
        while alone < len(groups) and digits < _DIGITS and end - len(before) < _CHARS and len(between[alone]) <= 2:
            text += [between[alone], groups[alone]]
            end += len(between[alone]) + len(groups[alone])
            digits += len(groups[alone]) - (groups[alone][0] in "+(")
            ends.append(end)
            counts.append(digits)
            alone += 1
        if digits < 4:
            return []
        text += [between[alone], *groups[alone : alone + 1]]
        s, out = "".join(text), []
        for skip in (0, 1) if groups[n][0] == "(" else (0,):
            for stop, kind, weight in _candidates(s, len(before) + skip, ends, counts):
                if stop in ends:
                    out.append((ends.index(stop) + 1, kind, weight, skip))
        return out

    def solve(self, n: int, valid: list, score: dict) -> tuple[int, int, str, int]:
        """(digits covered from group n on, groups to go on, kind, characters passed over)."""
        best = (score[n + 1], 1, "", 0)
        for width, kind, weight, skip in valid:
            if (total := weight + score[n + width]) > best[0]:
                best = (total, width, kind, skip)
        return best

    def best(self) -> list[tuple[int, int, str, int]]:
        """(first group, groups, kind, characters passed over): of all ways to choose valid values that don't overlap, the
        one that covers most digits, those of unusually grouped cards last."""
        self.score, self.path = {len(self.groups): 0}, {}
        choice = {}
        for n in reversed(range(len(self.groups))):
            self.score[n], *choice[n] = self.solve(n, self.valid[n], self.score)
        out, n = [], 0
        while n < len(self.groups):
            width, kind, skip = self.path[n] = choice[n]
            if kind:
                out.append((n, width, kind, skip))
            n += width
        return out

    def alike(self, n: int, width: int) -> bool:
        """Whether the same values are found, now that groups n to n + width are others."""
        far, after = max(0, n - _DIGITS), {n + width: self.score[n + width]}
        for m in range(n + 1, n + width + _DIGITS + 1):
            after.setdefault(m, self.score.get(m, 0)) if m >= n + width else None
        valid, m, run = {}, n + width - 1, 0
        while m >= 0 and (m >= far or run <= _DIGITS):
            if m >= far:
                valid[m] = self.at(m)
            after[m], *choice = self.solve(m, valid.get(m, self.valid[m]), after)
            if m in self.path and self.path[m] != choice:
                return False
            run = run + 1 if after[m] == self.score[m] else 0
            m -= 1
        for k, v in valid.items():
            self.valid[k] = v
        self.score.update({k: v for k, v in after.items() if m < k < n + width})
        return True

    def text(self) -> str:
        return "".join(x for pair in zip(self.between, [*self.groups, ""]) for x in pair)

    def place(self, n: int, width: int, kind: str, skip: int) -> tuple[int, int]:
        return self.spots[n][0] + skip, self.spots[n + width - 1][1]

    def replace(self, n: int, width: int, kind: str, skip: int, permute, same) -> str:
        """A value's pseudonym: replaced until the same values are found around it, and same() says that it may be."""
        inner = self.between[n + 1 : n + width]
        value = self.groups[n][skip:] + "".join(b + g for b, g in zip(inner, self.groups[n + 1 : n + width]))
        while True:
            value = _MAKERS[kind](value, permute)
            own = _GROUP.findall(value)
            self.groups[n : n + width] = [self.groups[n][:skip] + own[0], *own[1:]]
            if self.alike(n, width) and same():
                return value


class Pseudonyms:
    """Replaces the personal values of texts; back: the inverse, for whoever has the key."""

    def __init__(self, key: bytes, back: bool = False):
        if not 16 <= len(key) <= 64:
            raise ValueError("the key has 16 to 64 bytes")
        self.key, self.back, self.found = key, back, 0
        cached = lru_cache(1 << 16)(lambda x, size, tweak: permute(x, size, key, tweak, back))
        self.permute = lambda x, size, tweak: cached(x, size, tweak) if size < 1 << 256 else permute(x, size, key, tweak, back)

    def _addresses(self, s: str) -> Iterator[tuple[int, int]]:
        done, at = 0, s.find("@")
        while at >= 0:
            end = at
            if m := _DOMAIN.match(s, at + 1):
                run = s[done:at]
                local = run[len(run.rstrip(_NAME)) :].lstrip("._%+-")
                if local:
                    end = m.end()
                    yield at - len(local), end
            done = max(at + 1, end) if end > at else at + 1
            at = s.find("@", done)

    def _numbers(self, s: str, taken: list[tuple[int, int]], shaped: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
        """(start, end, new value) of numbers; shaped: what looks like an IBAN and is none, nor may become one."""
        regions: list[list] = []
        for start, end, odd in sorted([(m.start(), m.end(), False) for m in _REGION.finditer(s)] + [(i, j, True) for i, j in shaped]):
            if regions and start < regions[-1][1]:
                regions[-1][1:] = max(end, regions[-1][1]), odd or regions[-1][2]
            else:
                regions.append([start, end, odd])
        k = 0
        for start, end, odd in regions:
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            apart = []
            for t in taken[k:]:
                if t[0] >= end:
                    break
                apart.append(t)
            numbers = _Numbers(s, start, end, apart)
            spans = numbers.best()
            same = lambda: True
            if odd and spans:
                count = lambda: sum(_iban_end(t, m) is not None for t in [numbers.text()] for m in _IBAN.finditer(t))
                same = lambda was=count(): count() == was
            for span in reversed(spans) if self.back else spans:
                yield *numbers.place(*span), numbers.replace(*span, self.permute, same)

    def _iban(self, s: str, start: int, end: int) -> str:
        """Another IBAN in place of s[start:end], with which no longer one begins."""
        left, right, value = s[max(0, start - 1) : start], s[end : end + 44], s[start:end]
        while True:
            plain = value.replace(" ", "")
            plain = plain[:4] + _mixed(plain[4:], self.permute, b"iban" + plain[:2].encode())
            plain = plain[:2] + f"{98 - _remainder(plain[:2] + '00' + plain[4:]) % 97:02d}" + plain[4:]
            it = iter(plain)
            value = "".join(c if c == " " else next(it) for c in value)
            t = left + value + right
            m = _IBAN.match(t, len(left))
            if m and _iban_end(t, m) == len(left) + len(value):
                return value

    def text(self, s: str) -> str:
        new: list[tuple[int, int, str]] = []
        if "=" in s or ":" in s:
            new += [(m.start(1), m.end(1), _secret(m.group(1), self.permute)) for m in _SECRET.finditer(s)]
        if "@" in s:
            new += [(i, j, _email(s[i:j], self.permute)) for i, j in self._addresses(s)]
        held = sorted((i, j) for i, j, _ in new)
        shaped, k = [], 0
        for m in _IBAN.finditer(s):
            while k < len(held) and held[k][1] <= m.start():
                k += 1
            if k < len(held) and held[k][0] < m.end():
                continue
            if end := _iban_end(s, m):
                new.append((m.start(), end, self._iban(s, m.start(), end)))
            else:
                shaped.append((m.start(), m.end()))
        new += list(self._numbers(s, sorted((i, j) for i, j, _ in new), shaped))
        self.found += len(new)
        out, at = [], 0
        for i, j, value in sorted(new):
            out += [s[at:i], value]
            at = j
        return "".join(out) + s[at:]


#: For the registered queries; a real run passes its own secret.
DEMO_KEY = b"weftline-demonstration-key"


def _run(key: bytes, back: bool, columns: list[str], count: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key, back)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text")
                may = pc.fill_null(pc.or_(pc.match_substring_regex(texts, "[0-9]"), pc.match_substring_regex(texts, "[@=:]")), False).to_numpy(zero_copy_only=False)
                found = np.zeros(part.num_rows, np.int64)
                at = np.flatnonzero(may)
                if len(at):
                    new = []
                    for i, s in zip(at, texts.take(pa.array(at)).to_pylist()):
                        p.found = 0
                        new.append(p.text(s))
                        found[i] = p.found
                    texts = pc.replace_with_mask(texts, pa.array(may), pa.array(new, texts.type))
                out = {c: part.column(c) for c in columns} | {"text": texts}
                if count:
                    out[count] = pa.array(found)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, back: bool = False, length: str | None = None) -> DataFrame:
    """docs with the personal values in `text` replaced. length: a column of whole numbers that holds the text's length
    and follows it; pseudonyms have the length of their values except IPv4 addresses and dates written with single
    digits."""
    rows = packed_rows(docs)
    return measured(unpacked(rows.mapInArrow(_run(key, back, rows.columns, None), rows.schema), docs.columns), length)


def report(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """(doc_id, text, replaced): every document with its new text and how many values were replaced."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("replaced", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(_run(key, False, ["doc_id", "text"], "replaced"), schema)
