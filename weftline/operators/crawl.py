"""Crawls over a snapshot: hops are joins, what was found is deduplicated before it is fetched.

In place of a snapshot each takes a `sources.live.Live`, which fetches a hop's addresses when the hop is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import CrawlOptions
from ..plans.lineage import cut
from . import pages
from .fetch import DEFAULT
from .fetch import fetch as from_snapshot


def fetch(urls: DataFrame, source, options: CrawlOptions) -> DataFrame:
    """From a snapshot (a DataFrame) or live."""
    return from_snapshot(urls, source, options) if hasattr(source, "sparkSession") else source.fetch(urls, options)


def kept(source):
    """A snapshot that several hops read, written once: each hop would else key all its pages anew, by Python workers of
    its own. Live sources keep their pages themselves."""
    return cut(source) if hasattr(source, "sparkSession") else source


def discover_children(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT) -> DataFrame:
    """(url): the distinct child pages of the pages at urls."""
    parents = fetch(pages.distinct_urls(urls), snapshot, options)
    return pages.distinct_urls(pages.child_links(parents.select("url", "html")), "link", social=True)


def fetch_stream(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT) -> DataFrame:
    """(url, html): as often as urls has an address; those that can't be had are dropped. Batch or streaming."""
    return fetch(urls.select("url"), snapshot, options).select("url", "html")


def children(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT) -> DataFrame:
    """(url, html) of the children of the pages at urls."""
    snapshot = kept(snapshot)
    return fetch_stream(discover_children(urls, snapshot, options), snapshot, options)


def emails(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT) -> DataFrame:
    """(email): those on pages linked from the children of the pages at urls."""
    snapshot = kept(snapshot)
    parents = fetch(pages.distinct_urls(urls), snapshot, options)
    first = pages.distinct_urls(pages.child_links(parents.select("url", "html")), "link")
    second = pages.distinct_urls(pages.page_links(fetch(first, snapshot, options).select("url", "html")), "link")
    return pages.emails(fetch(second, snapshot, options).select("url", "html"))


def entities(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT) -> DataFrame:
    """(url, pos, entity): structured data of the pages at urls, of the types that options keep."""
    return pages.entities(fetch_stream(urls, snapshot, options), options.include_schemas, options.exclude_schemas)


def crawl(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT) -> DataFrame:
    """(url, depth): pages reachable by links in at most options.depth hops, each at its least depth."""
    snapshot = kept(snapshot)
    frontier = pages.distinct_urls(urls, social=True).withColumn("depth", F.lit(0))
    seen = cut(frontier)
    frontier = seen
    for depth in range(1, options.depth + 1):
        links = pages.page_links(fetch(frontier.select("url"), snapshot, options).select("url", "html"))
        fresh = cut(pages.distinct_urls(links, "link", social=True).join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen.orderBy("depth", "url").limit(options.limit) if options.limit is not None else seen
