"""python -m weftline.cli COMMAND INPUT: one page, or the pages reachable from an address, as JSON.

INPUT is an http(s) address, a file, or - for standard input. --snapshot takes a Parquet folder of pages (url, html) to
answer fetches from, instead of the network: children then prints what the page links to, fetched or not; without it,
those that could be fetched.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import native, udfs
from .operators import crawl, fetch
from .options import CrawlOptions

PARTS = {"page": "links", "body": "body", "jsonld": "entities", "metadata": "metadata", "schemas": "entities", "preview": "metadata", "phones": "phones", "markdown": "markdown"}
COMMANDS = ("fetch", "children", "emails", *PARTS)


def _live_or_snapshot(spark: SparkSession, urls: DataFrame, args) -> DataFrame:
    options = CrawlOptions(strategy="fast" if args.fast else "auto")
    if args.snapshot:
        return fetch.fetch_results(urls, fetch.snapshot_of(spark.read.parquet(args.snapshot)), options).select("url", "html", "error")
    from .sources.web import fetch_live

    return fetch_live(urls, options).select("url", "html", "error")


def _input(spark: SparkSession, args) -> DataFrame:
    if args.input == "-":
        return spark.createDataFrame([("-", sys.stdin.read(), None)], "url string, html string, error string")
    if args.input.startswith(("http://", "https://")):
        return _live_or_snapshot(spark, spark.createDataFrame([(args.input,)], "url string"), args)
    return spark.read.text(args.input, wholetext=True).select(F.lit(args.input).alias("url"), F.col("value").alias("html"), F.lit(None).cast("string").alias("error"))


def result(spark: SparkSession, argv: list[str]):
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("input")
    parser.add_argument("--fast", action="store_true", help="one attempt with the minimal profile")
    parser.add_argument("--snapshot")
    args = parser.parse_args(argv)
    if args.command in ("children", "emails"):
        urls = spark.createDataFrame([(args.input,)], "url string")
        options = CrawlOptions(strategy="fast" if args.fast else "auto")
        if args.snapshot:
            run = crawl.discover_children if args.command == "children" else crawl.emails
            found = run(urls, fetch.snapshot_of(spark.read.parquet(args.snapshot)), options)
            return sorted(r[0] for r in found.toLocalIterator())
        from .sources.live import Live

        with Live(spark) as live:
            found = crawl.children(urls, live, options).select("url") if args.command == "children" else crawl.emails(urls, live, options)
            return sorted(r[0] for r in found.toLocalIterator())
    rows = _input(spark, args)
    if args.command == "fetch":
        if not args.input.startswith("https://"):
            parser.error("fetch needs an https address")
        row = rows.first()
        return {"Err": row["error"]} if row["error"] else {"Ok": len(row["html"])}
    part = PARTS[args.command]
    page = rows.withColumn("p", udfs.scrape("html", "url", part)).select("error", F.col("p")[part].alias("v"))
    if args.command == "schemas":
        page = page.withColumn("v", native.schema_types("v"))
    elif args.command == "preview":
        page = page.withColumn("v", native.og_preview("v"))
    elif args.command == "phones":
        page = page.withColumn("v", native.normalize_phones("v"))
    row = page.first()
    if row["error"]:
        return {"Err": row["error"]}
    if args.command == "jsonld":
        return [json.loads(x) for x in row["v"]]
    if args.command == "metadata":
        return [[m["key"], m["value"]] for m in row["v"]]
    return row["v"].asDict() if args.command == "preview" else row["v"]


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.appName("weftline").config("spark.ui.enabled", "false").getOrCreate()
    got = result(spark, sys.argv[1:] if argv is None else argv)
    print(json.dumps(got, indent=2, ensure_ascii=False))
    return int(isinstance(got, dict) and "Err" in got)


if __name__ == "__main__":
    sys.exit(main())
