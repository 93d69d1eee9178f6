"""What needs a parser, as Arrow-batched functions of columns. One call of `scrape` parses a page once for all parts."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from . import dom, links, structured, text, urls

_STRINGS = pa.list_(pa.string())
#: Characters of pages whose parts are put into Arrow's form at once.
PIECE = 1 << 22
_PAIRS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))


def _json(items: list) -> list[str]:
    return [structured.dump(x) for x in items]


#: name: (type, whether the page is read as a fragment, function of the tree and the address)
PARTS: dict[str, tuple[pa.DataType, bool, Callable]] = {
    "links": (_STRINGS, False, lambda r, u: links.page_links(r, u or "")),
    "children": (_STRINGS, False, lambda r, u: links.child_links(r, u or "")),
    "body": (pa.string(), False, lambda r, u: text.body(r)),
    "metadata": (_PAIRS, False, lambda r, u: [{"key": k, "value": v} for k, v in text.metadata(r)]),
    "entities": (_STRINGS, False, lambda r, u: _json(structured.entities(r))),
    "microformats": (_STRINGS, False, lambda r, u: _json(structured.microformats(r))),
    "emails": (_STRINGS, True, lambda r, u: text.emails(r)),
    "phones": (_STRINGS, True, lambda r, u: text.phones(r)),
    "markdown": (pa.string(), False, lambda r, u: text.to_markdown(r)),
}


def _parse(html: str, url: str | None, parts: Sequence[str]) -> list:
    trees: dict[bool, dom.Element] = {}
    out = []
    for p in parts:
        piece = PARTS[p][1]
        if piece not in trees:
            trees[piece] = dom.fragment(html) if piece else dom.document(html)
        try:
            out.append(PARTS[p][2](trees[piece], url))
        except (RecursionError, MemoryError):  # of a library in C: the page has no such part, and the job goes on
            out.append(None)
    for tree in trees.values():
        dom.release(tree)
    return out


@contextmanager
def _no_collection() -> Iterator[None]:
    """Without looking for cycles at each step: a page's tree is taken apart as soon as its parts are had."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _scraped(pages: pa.Array, at: pa.Array, parts: Sequence[str], arrow: pa.DataType) -> pa.Array:
    """Page by page, so that beside the batch itself only one page's tree and a piece of the results are Python objects."""
    done, rows, size = [], [], 0
    with _no_collection():
        for page, address in zip(pages, at):
            html = page.as_py()
            rows.append(None if html is None else dict(zip(parts, _parse(html, address.as_py(), parts))))
            size += len(html or "")
            if size > PIECE:
                done.append(pa.array(rows, arrow))
                rows, size = [], 0
                gc.collect()
        done.append(pa.array(rows, arrow))
    return pa.concat_arrays(done) if len(done) > 1 else done[0]


def scrape(html: Column | str, url: Column | str | None, *parts: str) -> Column:
    """struct of the named parts (see PARTS) of each page, from one parse; null where html is null."""
    arrow = pa.struct([(p, PARTS[p][0]) for p in parts])

    @F.arrow_udf(from_arrow_type(arrow))
    def run(pages: pa.Array, at: pa.Array) -> pa.Array:
        return _scraped(pages, at, parts, arrow)

    return run(html, F.lit(None).cast("string") if url is None else url)


def _mapped(function: Callable[[str], object], arrow: pa.DataType):
    @F.arrow_udf(from_arrow_type(arrow))
    def run(values: pa.Array) -> pa.Array:
        coded = values.dictionary_encode()  # each distinct value is worked on once
        made = pa.array([function(v) for v in coded.dictionary.to_pylist()], arrow)
        return made.take(coded.indices)

    return run


normalize_url = _mapped(urls.normalize_url, pa.string())
normalize_social = _mapped(urls.normalize_social, pa.string())
normalize_domain = _mapped(urls.normalize_domain, pa.string())
normalize_text = _mapped(text.normalize_text, pa.string())
decode_entities = _mapped(text.decode_entities, pa.string())
is_social_url = _mapped(urls.is_social_url, pa.bool_())
to_markdown = _mapped(lambda h: text.to_markdown(dom.document(h)), pa.string())
text_emails = _mapped(lambda h: text.emails(dom.fragment(h)), _STRINGS)
text_phones = _mapped(lambda h: text.phones(dom.fragment(h)), _STRINGS)
merge_entities = _mapped(lambda s: _json(structured.fold([], structured.load(s))), _STRINGS)


def once(made: Column) -> Column:
    """What a UDF makes, as a generator of one row. No filter goes below that: Spark would run the UDF again for a filter
    on its result, and for the one that a join infers, each time in another Python worker."""
    return F.explode_outer(F.array(made))


@F.arrow_udf(from_arrow_type(_STRINGS))
def normalize_urls(lists: pa.Array) -> pa.Array:
    """Each list's canonical addresses, first seen first, without empty ones."""
    return pa.array([None if x is None else list(dict.fromkeys(u for u in (urls.normalize_url(v) for v in x if v is not None) if u)) for x in lists.to_pylist()], _STRINGS)


def register(spark: SparkSession) -> None:
    """The functions under their names in SQL, and page_links and child_links as table functions for LATERAL."""
    from pyspark.sql.functions import udtf

    for name in ("normalize_url", "normalize_social", "normalize_domain", "normalize_text", "decode_entities", "is_social_url", "to_markdown"):
        spark.udf.register(name, globals()[name])

    def table(part: str):
        class Rows:
            def eval(self, html: str, url: str):
                for k, link in enumerate(_parse(html, url, (part,))[0] if html is not None else ()):
                    yield k, link

        return udtf(Rows, returnType="pos: int, link: string")

    spark.udtf.register("page_links", table("links"))
    spark.udtf.register("child_links", table("children"))

    class Entities:
        def eval(self, html: str):
            for k, e in enumerate(_parse(html, None, ("entities",))[0] if html is not None else ()):
                yield k, e

    spark.udtf.register("scrape_entities", udtf(Entities, returnType="pos: int, entity: string"))
