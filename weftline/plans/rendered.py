"""Pages rendered from the base tables, whose facts are therefore known: what scraping them gives can be computed in
SQL from the tables. Rendering is column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page(head: str, body: str):
    """A page long enough to be fit for use; @@name@@ in head and body stands for a column."""
    filler = "<p>" + "These words make the page long enough. " * 12 + "</p>"
    return _fill(f"<!DOCTYPE html><html lang=\"en\"><head>{head}</head><body>{body}{filler}</body></html>")


def _fill(pattern: str):
    parts = []
    for k, piece in enumerate(pattern.split("@@")):
        parts.append(F.col(piece).cast("string") if k % 2 else F.lit(piece))
    return F.concat(*parts)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part, with JSON-LD in a graph, preview tags and an offer."""
    data = '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Product","sku":"@@p_partkey@@","name":"@@p_name@@","brand":{"@type":"Brand","name":"@@p_brand@@"}},{"@type":["Offer","Thing"],"price":"@@p_size@@"}]}</script>'
    head = f'<title> @@p_name@@ </title><meta name="description" content="@@p_type@@ item"><meta property="og:title" content="other"><meta property="og:image" content="/img/@@p_partkey@@.png"><meta name="blank" content=" ">{data}'
    return spread(table(spark, sf_dir, "part")).select(_fill("https://shop.example.com/p/@@p_partkey@@").alias("url"), _page(head, "<h1>@@p_name@@</h1><p>A <b>@@p_type@@</b> of <a href=\"/brand/@@p_partkey@@\">@@p_brand@@</a></p>").alias("html"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer: Microdata, a microformat (h-card) and an old one (vcard) of the same person."""
    body = (
        '<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">@@c_name@@</span><div itemprop="address" itemscope itemtype="https://schema.org/PostalAddress"><meta itemprop="addressCountry" content="N@@c_nationkey@@"></div></div>'
        '<div class="h-card"><span class="p-name">@@c_name@@</span><a class="u-email" href="mailto:c@@c_custkey@@@example.com">mail</a></div>'
        '<div class="vcard"><span class="fn">@@c_name@@</span> <span class="tel">555-010-@@line@@</span><span class="org">@@c_mktsegment@@</span></div>'
        '<p>Write to C@@c_custkey@@@Example.com or call <a href="tel:(555) 010-@@line@@ ext 5">us</a>.</p>'
    )
    rows = spread(table(spark, sf_dir, "customer")).withColumn("line", F.lpad(F.pmod(F.col("c_custkey"), F.lit(10000)).cast("string"), 4, "0"))
    return rows.select(_fill("https://people.example.com/c/@@c_custkey@@").alias("url"), _page("<title>@@c_name@@</title>", body).alias("html"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each supplier: RDFa, and an address to write to."""
    body = '<div vocab="https://schema.org/" typeof="Organization" resource="#s@@s_suppkey@@"><span property="name">@@s_name@@</span><span property="identifier" content="@@s_suppkey@@">no</span><div property="location" typeof="Place"><span property="name">@@n_name@@</span></div></div><a href="mailto:S@@s_suppkey@@%40mail.example.com?subject=x">mail</a>'
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(_fill("https://www.suppliers.example.com/s/@@s_suppkey@@/").alias("url"), _page("<title>@@s_name@@</title>", body).alias("html"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation with a plain list of its suppliers, and an item list of them in JSON-LD."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    one = F.struct("s_suppkey", _fill('<li><a href="//suppliers.example.com/s/@@s_suppkey@@?utm_source=list#top">@@s_name@@</a></li>').alias("li"), _fill('{"@type":"ListItem","url":"https://suppliers.example.com/s/@@s_suppkey@@"}').alias("item"))
    found = rows.groupBy("n_nationkey", "n_name").agg(F.sort_array(F.collect_list(one)).alias("all"))
    found = found.withColumn("lis", F.array_join(F.col("all.li"), "")).withColumn("items", F.array_join(F.col("all.item"), ","))
    head = '<title>@@n_name@@</title><script type="application/ld+json">{"@type":"ItemList","itemListElement":[@@items@@]}</script>'
    return found.select(_fill("https://geo.example.com/n/@@n_nationkey@@").alias("url"), _page(head, "<ul>@@lis@@</ul>").alias("html"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each region, with a card for each of its nations."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    card = F.struct("n_nationkey", _fill('<div><h3><a href="/n/@@n_nationkey@@">@@n_name@@</a></h3><p>In @@r_name@@.</p><a href="/share/@@n_nationkey@@">Share</a></div>').alias("card"))
    found = rows.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(card)).alias("all")).withColumn("cards", F.array_join(F.col("all.card"), ""))
    return found.select(_fill("https://geo.example.com/r/@@r_regionkey@@").alias("url"), _page("<title>@@r_name@@</title>", '<nav><a href="/">home</a></nav><main>@@cards@@</main>').alias("html"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer with orders: a card for each order."""
    rows = table(spark, sf_dir, "orders")
    card = F.struct("o_orderkey", _fill('<div><p>@@o_orderpriority@@</p><h2><a href="o/@@o_orderkey@@/">Order @@o_orderkey@@</a></h2><p>@@o_orderstatus@@</p></div>').alias("card"))
    found = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(card)).alias("all")).withColumn("cards", F.array_join(F.col("all.card"), ""))
    return found.select(_fill("https://orders.example.com/c/@@o_custkey@@").alias("url"), _page("<title>Orders</title>", "<section>@@cards@@</section>").alias("html"))
