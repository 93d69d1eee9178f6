"""Column functions that Spark runs by itself: predicates, filters and normal forms without a Python worker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, use) -> Column:
    """use(x), with x worked out once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def ascii_lower(x: Column | str) -> Column:
    return F.translate(_col(x), _UPPER, _LOWER)


def squeeze(x: Column | str) -> Column:
    """Runs of white space, of any kind that Unicode knows, become a space; none at the ends."""
    return F.trim(F.regexp_replace(_col(x), r"(?U)\s+", " "))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


# ---- responses ------------------------------------------------------------------------------------------------

LEAST_BYTES = 500
#: What pages say that ask whether the visitor is human; the first of these that occurs is reported.
CHALLENGES = ("verify you are a human", "please complete the captcha", "solve this captcha", "captcha challenge", "cf-browser-verification", "cf-captcha-container", "px-captcha", "blocked by cloudflare", "perimeterx")


def response_error(body: Column | str, status: Column | str | None = None) -> Column:
    """Null for a page that is fit for use, else what is wrong with it."""
    body = _col(body)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if status is not None:
        code = _col(status)
        out = F.when(code.isNull() | ~code.between(200, 299), F.concat(F.lit("HTTP status "), F.coalesce(code.cast("string"), F.lit("unknown"))))
    out = out.when(body.isNull() | (F.octet_length(body) < LEAST_BYTES), "invalid content - body is too short")

    def content(low: Column) -> Column:
        bad = F.when(~low.contains("<html") & ~low.contains("<!doctype"), "invalid content - missing HTML markers")
        for words in CHALLENGES:
            bad = bad.when(low.contains(words), f"suspicious content - {words}")
        return bad

    return out.otherwise(let(ascii_lower(body), content))


def validate_response(body: Column | str, status: Column | str | None = None) -> Column:
    error = response_error(body, status)
    return F.struct(error.isNull().alias("ok"), error.alias("error"))


# ---- hosts ----------------------------------------------------------------------------------------------------


def host(url: Column | str) -> Column:
    """The host of an http(s) address with an ASCII host, such as canonical addresses have; null for others."""
    return F.nullif(F.regexp_extract(ascii_lower(url), r"^https?://(?:[^/?#@\\]*@)?([a-z0-9._-]+|\[[0-9a-f:.]+\])(?::\d*)?(?:[/?#\\]|$)", 1), F.lit(""))


def host_matches(name: Column | str, domain: str) -> Column:
    """The domain itself or a host below it."""
    return (_col(name) == domain) | _col(name).endswith(f".{domain}")


def _any(name: Column, domains: Sequence[str]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | host_matches(name, d)
    return out


def is_host_allowed(name: Column | str, allow: Sequence[str] | None = None, block: Sequence[str] | None = None) -> Column:
    """Blocked hosts aren't; of the others those in the allow list are, or all if there is none."""
    name = _col(name)
    return ~_any(name, block or ()) & (F.lit(True) if allow is None else _any(name, allow))


def is_url_allowed(url: Column | str, allow: Sequence[str] | None = None, block: Sequence[str] | None = None) -> Column:
    """As is_host_allowed; an address without a host passes if there is no allow list."""
    return F.coalesce(is_host_allowed(host(url), allow, block), F.lit(allow is None))


def domain_error(url: Column | str, allow: Sequence[str] = (), block: Sequence[str] = ()) -> Column:
    """Null if the address may be fetched, else why not; empty lists are as none."""
    url, name = _col(url), host(url)
    if not allow and not block:
        return F.lit(None).cast("string")
    refused = F.when(~is_host_allowed(name, allow or None, block), F.concat(F.lit("blocked by domain filter: "), name))
    if allow:
        refused = F.when(name.isNull(), F.concat(F.lit("blocked by domain filter: unparseable host in "), url)).otherwise(refused)
    return refused


def is_social_url(url: Column | str) -> Column:
    from .urls import SOCIAL

    name = host(url)
    names = "|".join(h[:-2] + r"\.[a-z]{2,3}(?:\.[a-z]{2})?" if h.endswith(".*") else h.replace(".", r"\.") for h in SOCIAL)
    return F.coalesce(name.rlike(rf"^(?:.*\.)?(?:{names})$"), F.lit(False))


# ---- HTML -----------------------------------------------------------------------------------------------------

_ATTRIBUTES = (
    r"""(?Ui)\s+(?:class|id|style|data-[\w-]+|aria-[\w-]+|role|tabindex|xmlns(?::[\w-]+)?|version|viewBox|fill|fill-rule|stroke(?:-[\w-]+)?|on[\w-]+)"""
    r"""\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
)


def strip_junk(html: Column | str) -> Column:
    """Without scripts (JSON-LD moves to the end), styles, frames, drawings, comments and attributes for display."""
    html = _col(html)
    data = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>.*?</script>"""), F.lit(0))
    out = F.concat(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), F.array_join(data, ""))
    for tag in ("style", "noscript", "iframe", "svg"):
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", ""), _ATTRIBUTES, "")


def normalize_html(html: Column | str) -> Column:
    return squeeze(strip_junk(F.replace(_col(html), F.lit("\\n"), F.lit("\n"))))


# ---- contacts -------------------------------------------------------------------------------------------------

_FILES = "avi css doc docx gif gz ico jpeg jpg js mov mp3 mp4 pdf png prod svg tar webp xls xlsx zip".split()


def normalize_email(x: Column | str) -> Column:
    """The address in lower case, bare; empty if it is none."""
    def bare(s: Column) -> Column:
        left, right = F.instr(s, "<"), F.instr(s, ">")
        return F.when((left > 0) & (right > left), s.substr(left + 1, right - left - 1)).when((left > 0) & (right > 0), F.lit("")).otherwise(s)

    def decoded(s: Column) -> Column:
        # plus signs stay, and only whole escapes are read; what isn't UTF-8 then stays as it was
        read = F.try_url_decode(F.regexp_replace(F.replace(s, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"))
        return F.when(s.contains("%"), let(read, lambda r: F.when(r.isNotNull() & (~r.contains("\ufffd") | s.contains("\ufffd")), r).otherwise(s))).otherwise(s)

    def checked(s: Column) -> Column:
        domain = F.substring_index(s, "@", -1)
        ending = F.substring_index(domain, ".", -1)
        good = s.rlike("(?s)^[^@]*@[^@]*$") & domain.contains(".") & ending.rlike("^[a-z]{2,24}$") & ~ending.isin(*_FILES)
        return F.when(good, s).otherwise("")

    plain = let(F.regexp_replace(_strip(_col(x)), "[,;.]+$", ""), bare)
    return F.when(_col(x).isNotNull(), let(ascii_lower(_strip(let(plain, decoded))), checked))


def normalize_phone(x: Column | str) -> Column:
    """The digits, after a plus sign if there was one; extensions go."""

    def digits(s: Column) -> Column:
        low = F.lower(s)
        at = F.when(F.instr(low, " ext") > 0, F.instr(low, " ext")).otherwise(F.instr(low, " x"))
        return let(F.when(at > 0, s.substr(F.lit(1), at - 1)).otherwise(s), lambda t: F.concat(F.when(t.startswith("+"), "+").otherwise(""), F.regexp_replace(t, "[^0-9]", "")))

    return let(_strip(_col(x)), digits)


def dedupe(items: Column | str, make=None) -> Column:
    """A list's distinct items in first-seen order; with `make`, of what it makes of them that isn't empty."""
    items = _col(items)
    return F.array_distinct(items if make is None else F.filter(F.transform(items, make), lambda x: x != ""))


def normalize_emails(items: Column | str) -> Column:
    return dedupe(items, normalize_email)


def normalize_phones(items: Column | str) -> Column:
    return dedupe(items, normalize_phone)


def merge(*lists: Column | str) -> Column:
    return F.concat(*map(_col, lists))


# ---- what scraping found --------------------------------------------------------------------------------------

_FIELDS = {"title": ("title", "og:title", "twitter:title"), "description": ("description", "og:description", "twitter:description"), "image": ("og:image", "twitter:image", "og:image:secure_url")}


def og_preview(metadata: Column | str) -> Column:
    """struct<title, description, image> from (key, value) pairs: by the order of keys, the first that isn't blank."""
    metadata = _col(metadata)

    def first(key: str) -> Column:
        found = F.filter(metadata, lambda m: (ascii_lower(m["key"]) == key) & (_strip(m["value"]) != ""))
        return _strip(F.get(found, F.lit(0))["value"])

    return F.struct(*(F.coalesce(*map(first, keys)).alias(name) for name, keys in _FIELDS.items()))


def schema_types(entities: Column | str) -> Column:
    """The distinct types of objects given as JSON text, in first-seen order."""

    def of(e: Column) -> Column:
        v = F.try_parse_json(e)
        kind = F.try_variant_get(v, "$['@type']", "variant")
        shape = F.schema_of_variant(kind)
        many = F.filter(F.try_variant_get(v, "$['@type']", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
        return F.when(shape == "STRING", F.array(F.try_variant_get(v, "$['@type']", "string"))).when(shape.startswith("ARRAY"), F.transform(many, lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(_col(entities), lambda e: F.coalesce(of(e), F.array().cast("array<string>")))))


def short_type(name: Column | str) -> Column:
    return F.element_at(F.filter(F.split(_col(name), "[:/#]"), lambda p: p != ""), -1)


def has_schema_type(entities: Column | str, target: str) -> Column:
    """Whether an object has the type, by its short name; never for a blank one."""
    parts = [p for p in target.strip().replace("#", "/").replace(":", "/").split("/") if p]
    return F.exists(schema_types(entities), lambda t: short_type(t) == parts[-1]) if parts else F.lit(False)
