"""Live HTTP as a source: a cascade of client profiles, at most so many requests a host at a time.

Addresses are repartitioned by host, so a host is in one task, and that task's semaphore bounds the host's requests in
the whole job. A task that is run again fetches its addresses again.
"""

from __future__ import annotations

import gzip
import http.cookiejar
import json
import threading
import time
import urllib.error
import urllib.request
import zlib
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import native, udfs, urls
from ..operators.fetch import CASCADE, _listed
from ..options import CrawlOptions

PROFILES = ("minimal", "windows", "macos", "ios", "android")
_WEBKIT, _LIKE = "AppleWebKit/{}", "(KHTML, like Gecko)"
_SYSTEMS = {
    "minimal": ("X11; Linux x86_64", "537.36", ""),
    "windows": ("Windows NT 10.0; Win64; x64", "537.36", "Chrome/140.0.0.0 Safari/537.36"),
    "macos": ("Macintosh; Intel Mac OS X 10_15_7", "605.1.15", "Version/18.5 Safari/605.1.15"),
    "ios": ("iPhone; CPU iPhone OS 18_5 like Mac OS X", "605.1.15", "Version/18.5 Mobile/15E148 Safari/604.1"),
    "android": ("Linux; Android 15", "537.36", "Chrome/140.0.0.0 Mobile Safari/537.36"),
}


def headers_for(profile: str) -> dict[str, str]:
    """What a client of this kind sends; the minimal one sends its name only."""
    system, webkit, browser = _SYSTEMS[profile]
    out = {"User-Agent": " ".join(x for x in (f"Mozilla/5.0 ({system})", _WEBKIT.format(webkit), browser and f"{_LIKE} {browser}") if x)}
    if profile == "minimal":
        return out
    out |= {"Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9", "Accept-Encoding": "gzip, deflate", "Connection": "keep-alive"}
    if profile in ("windows", "android"):
        mobile = profile == "android"
        out |= {f"Sec-Fetch-{k}": v for k, v in (("Dest", "document"), ("Mode", "navigate"), ("Site", "none"), *((("User", "?1"),) if mobile else ()))}
        out |= {"Upgrade-Insecure-Requests": "1", "Sec-Ch-Ua-Mobile": f"?{int(mobile)}", "Sec-Ch-Ua-Platform": '"Android"' if mobile else '"Windows"', "Sec-Ch-Ua": '"Chromium";v="140", "Not=A?Brand";v="24"'}
    return out


class _Client:
    def __init__(self, profile: str):
        redirects = urllib.request.HTTPRedirectHandler()
        redirects.max_redirections = 5 if profile == "minimal" else 10
        handlers: list = [redirects]
        if profile != "minimal":
            handlers.append(urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()))
        self.open = urllib.request.build_opener(*handlers).open
        self.headers = headers_for(profile)

    def get(self, url: str, timeout: float, referer: str | None = None) -> tuple[int, bytes, str]:
        more = {"Referer": referer} if referer else {}
        try:
            with self.open(urllib.request.Request(url, headers=self.headers | more), timeout=timeout) as r:
                raw, coding, charset = r.read(), r.headers.get("Content-Encoding", ""), r.headers.get_content_charset("utf-8")
                if coding == "gzip":
                    raw = gzip.decompress(raw)
                elif coding == "deflate":
                    raw = zlib.decompress(raw)
                return r.status, raw, charset
        except urllib.error.HTTPError as e:
            return e.code, b"", "utf-8"


def page_error(status: int, body: str) -> str | None:
    """As native.response_error, for a single page."""
    low = "".join(c.lower() if c.isascii() else c for c in body)
    if not 200 <= status <= 299:
        return f"HTTP status {status}"
    if len(body.encode("utf-8", "replace")) < native.LEAST_BYTES:
        return "invalid content - body is too short"
    if "<html" not in low and "<!doctype" not in low:
        return "invalid content - missing HTML markers"
    return next((f"suspicious content - {c}" for c in native.CHALLENGES if c in low), None)


class Fetcher:
    """Fetches addresses with at most `per_host` requests a host at a time; remembers which profile a host took."""

    def __init__(self, options: CrawlOptions):
        self.options = options
        self.clients = {p: _Client(p) for p in PROFILES}
        self.gates: dict[str, threading.Semaphore] = defaultdict(lambda: threading.Semaphore(options.per_host))
        self.good: dict[str, str] = {}
        self.lock = threading.Lock()

    def _gate(self, host: str | None):
        with self.lock:
            return self.gates[host] if host else threading.Semaphore()

    def remember(self, profiles: dict[str, str]) -> None:
        """What is known of these addresses' hosts from earlier; what this fetcher found itself goes before it."""
        for url, profile in profiles.items():
            self.good.setdefault(urls.host_of(url) or "", profile)

    def page(self, url: str) -> dict:
        began, host, error, attempts = time.monotonic(), urls.host_of(url), "no attempt", 0
        profiles = CASCADE[self.options.strategy]
        if self.good.get(host or "") in profiles:
            profiles = profiles[profiles.index(self.good[host]) :]
        with self._gate(host):
            for profile in profiles:
                attempts += 1
                try:
                    status, raw, charset = self.clients[profile].get(url, self.options.timeout_s)
                    body = raw.decode(charset, "replace")
                    error = page_error(status, body)
                except (OSError, ValueError, LookupError, EOFError, zlib.error) as e:
                    error = f"request failed - {e}"
                if error is None:
                    if host:
                        self.good[host] = profile
                    return {"html": body, "profile_used": profile, "duration_ms": int((time.monotonic() - began) * 1000), "attempts": attempts, "error": None}
        return {"html": None, "profile_used": None, "duration_ms": int((time.monotonic() - began) * 1000), "attempts": attempts, "error": error}

    def raw(self, url: str, referer: str | None = None) -> dict:
        with self._gate(urls.host_of(url)):
            try:
                status, raw, _ = self.clients["minimal"].get(url, self.options.timeout_s, referer)
            except (OSError, ValueError, EOFError, zlib.error) as e:
                return {"content": None, "error": f"request failed - {e}"}
        return {"content": raw, "error": None} if 200 <= status <= 299 else {"content": None, "error": f"HTTP status {status}"}

    def all(self, items: list[str], one) -> list[dict]:
        with ThreadPoolExecutor(max(1, min(self.options.concurrency, 64, len(items)))) as pool:
            return list(pool.map(one, items))


def _live(wanted: DataFrame, options: CrawlOptions, method: str, kind: str, fields: list[tuple]) -> DataFrame:
    refused = native.domain_error("canonical_url", options.allow_domains, options.block_domains)
    if options.allow_urls or options.block_urls:
        refused = F.coalesce(refused, F.when(~_listed(options), F.concat(F.lit("blocked by address list: "), "canonical_url")))
    profile = F.col("profile") if "profile" in wanted.columns else F.lit(None).cast("string")
    keyed = wanted.select("url", udfs.normalize_social("url").alias("canonical_url"), profile.alias("profile")).withColumn("refused", refused)
    spread = keyed.repartition(F.coalesce(native.host("canonical_url"), F.lit("")))
    schema = pa.schema([("url", pa.string()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetcher = Fetcher(options)
        for b in batches:
            rows = b.to_pylist()
            fetcher.remember({r["url"]: r["profile"] for r in rows if r["profile"]})
            todo = [r["url"] for r in rows if r["refused"] is None]
            got = iter(fetcher.all(todo, getattr(fetcher, method)))
            found = [dict(next(got)) if r["refused"] is None else {"error": r["refused"]} for r in rows]
            yield pa.RecordBatch.from_pylist([{"url": r["url"]} | f for r, f in zip(rows, found)], schema)

    return spread.mapInArrow(run, kind)


def fetch_live(wanted: DataFrame, options: CrawlOptions | None = None) -> DataFrame:
    """(url, html, profile_used, duration_ms, attempts, error) of addresses (url); one of html and error is null.
    A column profile names the client to begin with at the address's host."""
    fields = [("html", pa.string()), ("profile_used", pa.string()), ("duration_ms", pa.int64()), ("attempts", pa.int32()), ("error", pa.string())]
    return _live(wanted, options or CrawlOptions(), "page", "url string, html string, profile_used string, duration_ms long, attempts int, error string", fields)


def fetch_bytes(wanted: DataFrame, options: CrawlOptions | None = None) -> DataFrame:
    """(url, content, error): anything, such as images, as it comes; only the status is checked."""
    return _live(wanted, options or CrawlOptions(), "raw", "url string, content binary, error string", [("content", pa.binary()), ("error", pa.string())])


class _Part(InputPartition):
    def __init__(self, urls_: list[str]):
        self.urls = urls_


class WebSource(DataSource):
    """spark.read.format("weftline_web").option("urls", json list).option("strategy", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "weftline_web"

    def schema(self) -> str:
        return "url string, html string, profile_used string, duration_ms long, attempts int, error string"

    def reader(self, schema):
        return _Reader(json.loads(self.options["urls"]), CrawlOptions(strategy=self.options.get("strategy", "auto"), timeout_s=float(self.options.get("timeout", 30))))


class _Reader(DataSourceReader):
    def __init__(self, wanted: list[str], settings: CrawlOptions):
        self.wanted, self.settings = wanted, settings

    def partitions(self):
        by: dict[str | None, list[str]] = defaultdict(list)
        for u in self.wanted:
            by[urls.host_of(u)].append(u)
        return [_Part(v) for v in by.values()] or [_Part([])]

    def read(self, partition):
        fetcher = Fetcher(self.settings)
        for u, r in zip(partition.urls, fetcher.all(partition.urls, fetcher.page)):
            yield u, r["html"], r["profile_used"], r["duration_ms"], r["attempts"], r["error"]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebSource)
