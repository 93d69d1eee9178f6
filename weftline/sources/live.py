"""A live crawl's pages: what is fetched in one round is a table that later rounds read.

`Live` stands where crawls take a snapshot. Each call of `fetch` is a round: addresses whose canonical form is there
already are answered from the table (an anti-join leaves the others), those others are fetched once each, and pages are
appended. A host is first tried with the profile that worked in an earlier round, in whichever task it is. Failures
aren't kept, so a later round tries them again. Tables lie in the folder that executors share, and a lost task fetches
its addresses again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native, udfs
from ..operators.fetch import only_allowed
from ..options import CrawlOptions
from ..plans.lineage import cut, shared_dir
from .web import fetch_live

_PAGES = "canonical_url string, html string, profile_used string, round int"


class Live:
    """get: what fetches (url, profile), by default over HTTP; crawls ask for canonical, so https, addresses."""

    def __init__(self, spark: SparkSession, get=fetch_live):
        self.spark, self.get, self.rounds = spark, get, 0
        self.path = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"

    def pages(self) -> DataFrame:
        """(canonical_url, html, profile_used, round): all that was fetched so far, a row an address."""
        if not self.rounds:
            return self.spark.createDataFrame([], _PAGES)
        return self.spark.read.schema(_PAGES).parquet(self.path)

    def fetch(self, urls: DataFrame, options: CrawlOptions) -> DataFrame:
        """urls with canonical_url and html, as operators.fetch.fetch. Null addresses are dropped."""
        keyed = cut(only_allowed(urls.withColumn("canonical_url", udfs.normalize_social("url")).where("url is not null"), options))
        had = self.pages()
        fresh = keyed.groupBy("canonical_url").agg(F.min("url").alias("url")).join(had.select("canonical_url"), "canonical_url", "left_anti")
        hosts = had.groupBy(native.host("canonical_url").alias("_wl_host")).agg(F.max_by("profile_used", F.struct("round", "canonical_url")).alias("profile"))
        asked = fresh.withColumn("_wl_host", native.host("canonical_url")).join(hosts, "_wl_host", "left").select("url", "profile")
        got = self.get(asked, options).where("error is null")
        got.select(udfs.normalize_social("url").alias("canonical_url"), "html", "profile_used").write.parquet(f"{self.path}/round={self.rounds}")
        self.rounds += 1
        return keyed.join(self.pages().select("canonical_url", "html"), "canonical_url").select(*urls.columns, "canonical_url", "html")

    def close(self) -> None:
        """Deletes the tables; frames that come from them can't be read afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.rounds = 0

    def __enter__(self) -> Live:
        return self

    def __exit__(self, *_) -> None:
        self.close()
