"""Fetching as a join: addresses against a snapshot of pages, keyed by canonical address.

A snapshot has (canonical_url, html, status). Both sides are hashed by the key, so a join of any size is one exchange of
the addresses and one of the pages; Spark broadcasts a side only if its statistics say that it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native, udfs
from ..functions.urls import normalize_social
from ..options import CrawlOptions

DEFAULT = CrawlOptions()
CASCADE = {"auto": ("minimal", "windows", "ios"), "fast": ("minimal",)}


def snapshot_of(pages: DataFrame) -> DataFrame:
    """(canonical_url, html, status) of pages (url, html[, status][, page_id]); of pages with one key that with the
    smallest url, of these the first in the table by its page_id, if it has one, else the smallest html."""
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    order = ["url", "page_id"] if "page_id" in pages.columns else ["url"]
    rows = pages.where("url is not null").select(udfs.once(udfs.normalize_social("url")).alias("canonical_url"), *order, "html", status.cast("int").alias("status"))
    return rows.groupBy("canonical_url").agg(F.min(F.struct(*order, "html", "status")).alias("p")).select("canonical_url", "p.html", "p.status")


def _listed(options: CrawlOptions) -> Column:
    """Whether the address lists, by their canonical forms, let canonical_url be fetched."""
    fit = F.lit(True)
    if options.allow_urls:
        fit = fit & F.col("canonical_url").isin(*map(normalize_social, options.allow_urls))
    if options.block_urls:
        fit = fit & ~F.col("canonical_url").isin(*map(normalize_social, options.block_urls))
    return fit


def only_allowed(wanted: DataFrame, options: CrawlOptions) -> DataFrame:
    """Of addresses with their canonical_url, those that the host and address lists let be fetched."""
    if options.allow_domains or options.block_domains:
        wanted = wanted.where(native.domain_error("canonical_url", options.allow_domains, options.block_domains).isNull())
    return wanted.where(_listed(options)) if options.allow_urls or options.block_urls else wanted


def fetch_results(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT) -> DataFrame:
    """urls (url, ...) with html and error, one of which is null. Repeated addresses give repeated rows."""
    wanted = urls.withColumn("canonical_url", udfs.once(udfs.normalize_social("url")))
    if options.allow_urls or options.block_urls:
        wanted = wanted.where(_listed(options))
    refused = native.domain_error("canonical_url", options.allow_domains, options.block_domains)
    bad = native.response_error("html", "status")
    joined = wanted.withColumn("_refused", refused).join(snapshot.withColumn("_bad", F.coalesce(bad, F.lit(""))), "canonical_url", "left")
    error = F.coalesce("_refused", F.when(F.col("_bad").isNull(), "not in the snapshot"), F.nullif("_bad", F.lit("")))
    return joined.select(*urls.columns, "canonical_url", F.when(error.isNull(), F.col("html")).alias("html"), error.alias("error"))


def fetch(urls: DataFrame, snapshot: DataFrame, options: CrawlOptions = DEFAULT) -> DataFrame:
    """urls with their html; addresses that can't be had are dropped (an inner join: the filter comes first)."""
    wanted = only_allowed(urls.withColumn("canonical_url", udfs.once(udfs.normalize_social("url"))), options)
    good = snapshot.where(native.response_error("html", "status").isNull()).select("canonical_url", "html")
    return wanted.join(good, "canonical_url").select(*urls.columns, "canonical_url", "html")


def _fit(profile: str):
    return lambda a: (a["profile"] == profile) & native.response_error(a["html"], a["status"]).isNull()


def choose_attempt(attempts, strategy: str = "auto"):
    """Of array<struct<profile, status, html, duration_ms>>: struct<html, profile_used, duration_ms, attempts> of the
    first profile in the strategy's order whose page is fit for use; null if none is."""
    attempts = F.col(attempts) if isinstance(attempts, str) else attempts
    tried = []
    for k, profile in enumerate(CASCADE[strategy]):
        found = F.filter(attempts, _fit(profile))
        first = F.get(found, F.lit(0))
        tried.append(F.when(first.isNotNull(), F.struct(first["html"].alias("html"), F.lit(profile).alias("profile_used"), first["duration_ms"].cast("long").alias("duration_ms"), F.lit(k + 1).alias("attempts"))))
    return F.coalesce(*tried)


def filter_hosts(urls: DataFrame, allow: DataFrame | None = None, block: DataFrame | None = None, column: str = "url") -> DataFrame:
    """For lists too long for literals, as tables (domain): semi and anti join on the host's own suffixes."""
    labels = F.split(native.host(column), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    out = urls.withColumn("_wl_suffixes", suffixes)
    for table, kind in ((block, "left_anti"), (allow, "left_semi")):
        if table is not None:
            hosts = out.select(native.host(column).alias("_wl_host"), F.explode("_wl_suffixes").alias("domain")).distinct().join(table.select("domain"), "domain", "left_semi").select("_wl_host").distinct()
            out = out.join(hosts, native.host(column) == F.col("_wl_host"), kind)
    return out.select(*urls.columns)
