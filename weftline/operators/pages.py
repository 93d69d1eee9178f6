"""Stages over pages (url, html, ...): each names what it adds, and html goes as soon as it has been read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native, udfs


def spread(df: DataFrame) -> DataFrame:
    """A table read from few and small files, over all cores: parsing costs far more than moving its rows. Tables whose
    files make as many tasks as there are cores stay as they are, so nothing large is shuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if max(len(df.inputFiles()), size // split) < cores else df


def with_parts(pages: DataFrame, *parts: str, keep_html: bool = False) -> DataFrame:
    """pages with the parts as columns, from one parse of each page (one Arrow node in the plan)."""
    # Spark doesn't merge the projections below, as that would repeat the call; filters on a part belong after a barrier
    read = pages.withColumn("_wl_page", udfs.scrape("html", "url" if "url" in pages.columns else None, *parts))
    columns = [c for c in pages.columns if (keep_html or c != "html") and c not in parts]
    return read.select(*columns, *(F.col("_wl_page")[p].alias(p) for p in parts))


def rows_of(df: DataFrame, items: Column | str, value: str, *columns: str) -> DataFrame:
    """(columns, pos, value): a row for each item. The outer form with a filter on what it gives keeps the optimizer
    from inferring a filter on the list itself, for which it would parse every page a second time."""
    out = df.select(*columns, F.posexplode_outer(items).alias("pos", value))
    return out.where("pos is not null")


def page_links(pages: DataFrame) -> DataFrame:
    """(columns of pages without html, pos, link): every link in document order."""
    wide = with_parts(pages, "links")
    return rows_of(wide, "links", "link", *(c for c in wide.columns if c != "links"))


def child_links(pages: DataFrame) -> DataFrame:
    wide = with_parts(pages, "children")
    return rows_of(wide, "children", "link", *(c for c in wide.columns if c != "children"))


def entities(pages: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """(..., pos, entity): the structured data of pages as JSON text; by short type names, those to keep or not."""
    wide = with_parts(pages, "entities")
    out = rows_of(wide, "entities", "entity", *(c for c in wide.columns if c != "entities"))
    own = F.transform(native.schema_types(F.array("entity")), native.short_type)
    if include:
        out = out.where(F.arrays_overlap(own, F.array(*map(F.lit, include))))
    if exclude:
        out = out.where(~F.coalesce(F.arrays_overlap(own, F.array(*map(F.lit, exclude))), F.lit(False)))
    return out


def metadata(pages: DataFrame) -> DataFrame:
    wide = with_parts(pages, "metadata")
    return rows_of(wide, "metadata", "m", *(c for c in wide.columns if c != "metadata")).select("*", "m.key", "m.value").drop("m")


def previews(pages: DataFrame) -> DataFrame:
    wide = with_parts(pages, "metadata")
    return wide.withColumn("preview", native.og_preview("metadata")).drop("metadata")


def distinct_urls(urls: DataFrame, column: str = "url", social: bool = False) -> DataFrame:
    """(url): canonical, without repeats and empty ones."""
    make = udfs.normalize_social if social else udfs.normalize_url
    return urls.select(udfs.once(make(column)).alias("url")).where("url <> ''").distinct()


def emails(pages: DataFrame) -> DataFrame:
    """(email): the distinct normal forms of all addresses on the pages."""
    found = rows_of(with_parts(pages, "emails"), "emails", "raw")
    return found.select(native.normalize_email("raw").alias("email")).where("email <> ''").distinct()
