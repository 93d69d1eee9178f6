"""Column functions, stages, sources, streams and plans."""

import contextlib
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.functions import native, text, udfs
from weftline.operators import crawl, fetch, pages
from weftline.options import CrawlOptions
from weftline.plans import lineage, rendered
from weftline.sources import files, web
from weftline.sources.live import Live
from weftline.streaming import discover

from ..oracles import SMALL

LONG = "<html>" + "x" * 500 + "{}</html>"


def column(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_emails(spark):
    raw = [" A@b.test ", "a%40b.test", "Name <a@b.test>", "a@b.test,;.", "a+x@b.test", "a%2Bx@b.test", "a@b", "a@@b.test", "x", "", "a@2x.png", "a@b.c", ">a@b.test<", "50%a@b.test", "a@b.photography", None, "a%FF@b.test"]
    want = ["a@b.test"] * 4 + ["a+x@b.test"] * 2 + [""] * 7 + ["50%a@b.test", "a@b.photography", None, "a%ff@b.test"]
    assert column(spark, raw, native.normalize_email) == want


def test_phones(spark):
    raw = ["(555) 123-4567", "+1 555.123.4567", "555-123-4567 ext 9", "555-123-4567 X9", "", "+", "none", None, " 555 "]
    assert column(spark, raw, native.normalize_phone) == ["5551234567", "+15551234567", "5551234567", "5551234567", "", "+", "", None, "555"]
    assert column(spark, [["5 5", "55", "", "-"], []], native.normalize_phones, "array<string>") == [["55"], []]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<div><!-- a\nb --><p>x</p></div>", "<div><p>x</p></div>"), ("<p>a  \n\n b</p>", "<p>a b</p>"), ("a\\nb", "a b"), ("<SCRIPT src=x>y</SCRIPT><style>z</style><noscript>n</noscript><iframe></iframe><svg>s</svg>k", "k"),
        ('<p class="a" id=\'b\' data-x=1 onclick="f()" title="t">x</p>', '<p title="t">x</p>'), ('<script type="application/ld+json">{"a":1}</script><b>x</b>', '<b>x</b><script type="application/ld+json">{"a":1}</script>'), ("<i>set id = 5</i>", "<i>set>"), ("a  b", "a b"),
    ],
)
def test_normalize_html(spark, raw, want):
    assert column(spark, [raw], native.normalize_html) == [want]


def test_responses(spark):
    rows = [(200, LONG), (404, LONG), (None, LONG), (200, "<html>short"), (200, "é" * 250 + "<html>"), (200, "y" * 600), (200, LONG.format("<P>PerimeterX and Px-Captcha")), (200, LONG.format("forbidden access denied")), (200, None), (200, "<!DOCTYPE html>" + "z" * 600)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, b string")
    got = [r["e"] for r in frame.select("i", native.response_error("b", "s").alias("e")).orderBy("i").collect()]
    assert got == [None, "HTTP status 404", "HTTP status unknown", "invalid content - body is too short", None, "invalid content - missing HTML markers", "suspicious content - px-captcha", None, "invalid content - body is too short", None]
    assert [web.page_error(s, b) for s, b in rows if s and b] == [e for (s, b), e in zip(rows, got) if s and b]


def test_hosts(spark):
    names = ["a.test", "x.a.test", "xa.test", "b.a.test"]
    assert column(spark, names, lambda c: native.host_matches(c, "a.test")) == [True, True, False, True]
    assert column(spark, names, lambda c: native.is_host_allowed(c, ["a.test"], ["b.a.test"])) == [True, True, False, False]
    urls = ["https://a.test/x", "http://u:p@A.test:80", "nonsense", "https://b.test"]
    assert column(spark, urls, native.host) == ["a.test", "a.test", None, "b.test"]
    assert column(spark, urls, lambda c: native.is_url_allowed(c, ["a.test"])) == [True, True, False, False]
    assert column(spark, urls, native.is_url_allowed) == [True] * 4
    assert column(spark, urls, lambda c: native.is_url_allowed(c, None, ["b.test"])) == [True, True, True, False]
    assert column(spark, urls, lambda c: native.domain_error(c, ["a.test"])) == [None, None, "blocked by domain filter: unparseable host in nonsense", "blocked by domain filter: b.test"]
    assert column(spark, ["https://m.facebook.com/x", "https://www.pinterest.co.uk", "https://face.test", "x"], native.is_social_url) == [True, True, False, False]


def test_previews_and_types(spark):
    meta = [[("OG:Title", "o"), ("title", " "), ("twitter:title", "t"), ("og:image:secure_url", " s ")], []]
    got = column(spark, meta, native.og_preview, "array<struct<key string, value string>>")
    assert [tuple(x) for x in got] == [("o", None, "s"), (None, None, None)]
    objects = [['{"@type":"A"}', '{"@type":["https://s.test/B","A",3]}', '{"x":1}', "bad", '{"@type":5}'], []]
    assert column(spark, objects, native.schema_types, "array<string>") == [["A", "https://s.test/B"], []]
    for target, want in (("B", True), ("s:B", True), ("b", False), (" ", False), ("C", False)):
        assert column(spark, objects, lambda c, t=target: native.has_schema_type(c, t), "array<string>") == [want, False]


def test_udfs_take_nulls_and_repeats(spark):
    assert column(spark, ["http://WWW.a.test/", None, "http://WWW.a.test/", ""], udfs.normalize_url) == ["https://a.test", None, "https://a.test", ""]
    got = column(spark, ["<a href=/x>", None, ""], lambda c: udfs.scrape(c, F.lit("https://a.test"), "links", "children", "body"))
    assert got[0]["links"] == ["https://a.test/x"] and got[1] is None and got[2]["links"] == [] and got[2]["children"] == ["https://a.test"]
    assert column(spark, [["a.test", "", "http://a.test/", None], None], udfs.normalize_urls, "array<string>") == [["https://a.test"], None]


def test_sql_surface(spark):
    udfs.register(spark)
    spark.createDataFrame([("https://a.test/", "<a href=b>x</a><a href=c>y</a>")], "url string, html string").createOrReplaceTempView("some_pages")
    assert [tuple(r) for r in spark.sql("SELECT pos, normalize_url(link) FROM some_pages, LATERAL page_links(html, url) ORDER BY pos").collect()] == [(0, "https://a.test/b"), (1, "https://a.test/c")]


def test_one_parse_a_page(spark):
    frame = rendered.table(spark, SMALL, "pages")
    plan = pages.with_parts(frame, "links", "metadata", "body").select("page_id", "links", "metadata", "body")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    for stage in (pages.page_links(frame), pages.entities(frame, include=("A",)), pages.metadata(frame), pages.emails(frame)):
        plan = stage._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, plan
    wanted = fetch.fetch(frame.select("url"), fetch.snapshot_of(frame))
    assert "ReadSchema: struct<url:string>" in wanted._jdf.queryExecution().executedPlan().toString()


def test_no_filter_runs_a_function_again(spark):
    """A node in the plan for each call of a function: each is a Python worker a task."""
    frame = rendered.table(spark, SMALL, "pages")
    nodes = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert nodes(pages.distinct_urls(frame)) == 1
    assert nodes(fetch.fetch(frame.select("url"), fetch.snapshot_of(frame))) == 2
    seeds = spark.createDataFrame([("https://geo.example.com/r/1",)], "url string")
    assert nodes(crawl.emails(seeds, fetch.snapshot_of(rendered.nations(spark, SMALL)))) == 9


def test_fetching(spark):
    snapshot = fetch.snapshot_of(spark.createDataFrame([("http://www.a.test/", LONG, 200), ("https://a.test", "later", 200), ("https://b.test", LONG, 500), ("https://c.test/x", LONG, 200), (None, LONG, 200)], "url string, html string, status int"))
    wanted = spark.createDataFrame([("a.test",), ("https://a.test/#x",), ("https://b.test",), ("https://c.test/x",), ("https://d.test",), (None,)], "url string")
    options = CrawlOptions(block_domains=("c.test",))
    got = {r["url"]: r["error"] for r in fetch.fetch_results(wanted, snapshot, options).collect()}
    assert got == {"a.test": None, "https://a.test/#x": None, "https://b.test": "HTTP status 500", "https://c.test/x": "blocked by domain filter: c.test", "https://d.test": "not in the snapshot", None: "not in the snapshot"}
    assert Counter(r["canonical_url"] for r in fetch.fetch(wanted, snapshot, options).collect()) == {"https://a.test": 2}
    assert fetch.fetch(wanted, snapshot, options.with_(allow_urls=("https://b.test",))).isEmpty()
    with pytest.raises(ValueError):
        CrawlOptions(strategy="slow")


def test_attempts(spark):
    tries = [[("windows", 200, LONG, 5), ("minimal", 403, LONG, 3)], [("macos", 200, LONG, 5)], None]
    got = column(spark, tries, fetch.choose_attempt, "array<struct<profile string, status int, html string, duration_ms long>>")
    assert got[0]["profile_used"] == "windows" and got[0]["attempts"] == 2 and got[1] is None and got[2] is None


def test_schema_filters(spark):
    frame = spark.createDataFrame([("u", """<script type='application/ld+json'>[{"@type":"https://s.test/A"},{"@type":"B"},{"x":1}]</script>""")], "url string, html string")
    assert pages.entities(frame, include=("A",)).count() == 1 and pages.entities(frame, exclude=("A",)).count() == 2


class _Site(BaseHTTPRequestHandler):
    most, now, lock, agents = 0, 0, threading.Lock(), []

    def do_GET(self):
        cls = type(self)
        with cls.lock:
            cls.now += 1
            cls.most = max(cls.most, cls.now)
            cls.agents.append((self.path, self.headers["User-Agent"], self.headers.get("Referer")))
        threading.Event().wait(0.02)
        minimal = "Chrome" not in self.headers["User-Agent"] and "Version" not in self.headers["User-Agent"]
        code = 404 if self.path == "/none" else 403 if self.path.startswith("/picky") and minimal else 200
        body = (LONG if self.path != "/short" else "<html>").format(self.path).encode()
        with cls.lock:
            cls.now -= 1
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _Site.most, _Site.agents = 0, []
    with contextlib.closing(server.socket):
        yield f"http://127.0.0.1:{server.server_port}"
        server.shutdown()


def test_live(spark, site):
    wanted = spark.createDataFrame([(f"{site}/{p}",) for p in ("ok", "none", "short", "picky1")], "url string")
    got = {r["url"].rsplit("/", 1)[1]: r for r in web.fetch_live(wanted).collect()}
    assert got["ok"]["attempts"] == 1 and got["ok"]["profile_used"] == "minimal" and got["ok"]["html"].endswith("/ok</html>")
    assert got["none"]["error"] == "HTTP status 404" and got["none"]["attempts"] == 3
    assert got["short"]["error"] == "invalid content - body is too short"
    assert got["picky1"]["profile_used"] == "windows"
    fast = {r["url"].rsplit("/", 1)[1]: r["error"] for r in web.fetch_live(wanted, CrawlOptions(strategy="fast")).collect()}
    assert fast["picky1"] == "HTTP status 403" and fast["ok"] is None
    blocked = web.fetch_live(wanted, CrawlOptions(block_domains=("127.0.0.1",))).collect()
    assert {r["error"] for r in blocked} == {"blocked by domain filter: 127.0.0.1"}
    raw = {r["url"].rsplit("/", 1)[1]: r for r in web.fetch_bytes(wanted).collect()}
    assert bytes(raw["short"]["content"]) == b"<html>" and raw["none"]["error"] == "HTTP status 404"
    web.register(spark)
    assert spark.read.format("weftline_web").option("urls", json.dumps([f"{site}/ok"])).load().first()["error"] is None


class _Cards(_Site):
    """/ has four cards, each of which links to /team, where the addresses are; /picky ones refuse the minimal client."""

    def do_GET(self):
        type(self).agents.append((self.path, self.headers["User-Agent"]))
        if self.path == "/picky3" and "Chrome" not in self.headers["User-Agent"]:
            code, body = 403, b""
        else:
            cards = "".join(f"<div class='card'><h2><a href='/picky{k}'>Card number {k}</a></h2><p>Some words about {k}</p></div>" for k in range(4))
            team = "<a href='/team'>team</a>" if self.path != "/team" else "<p>ann@example.com bob@example.com</p>"
            code, body = 404 if self.path == "/picky2" else 200, f"<html><body>{cards if self.path == '/' else team}<p>{'x' * 500}</p></body></html>".encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)


def _plain(wanted, options):
    """fetch_live without TLS: the local server speaks HTTP only."""
    got = web.fetch_live(wanted.withColumn("url", F.regexp_replace("url", "^https:", "http:")), options)
    return got.withColumn("url", F.regexp_replace("url", "^http:", "https:"))


def test_live_crawl(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Cards)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"https://127.0.0.1:{server.server_port}"
    try:
        _Cards.agents = []
        urls = spark.createDataFrame([(f"{base}/",), (f"{base}/",), (None,)], "url string")
        with Live(spark, _plain) as live:
            got = sorted(r["url"] for r in crawl.children(urls, live).collect())
            assert got == [f"{base}/picky{k}" for k in (0, 1, 3)]
            asked = Counter(path for path, _ in _Cards.agents)
            assert asked["/"] == asked["/picky0"] == 1 and asked["/picky2"] >= 2
            assert [r["email"] for r in crawl.emails(urls, live).orderBy("email").collect()] == ["ann@example.com", "bob@example.com"]
            again = Counter(path for path, _ in _Cards.agents)
            assert again["/"] == again["/picky0"] == again["/team"] == 1 and again["/picky2"] > asked["/picky2"]
            assert live.pages().count() == live.pages().select("canonical_url").distinct().count() == 5
            held = crawl.children(urls, live, CrawlOptions(block_urls=(f"{base}/picky0/",))).collect()
            assert {r["url"] for r in held} == {f"{base}/picky1", f"{base}/picky3"}
        assert cli.result(spark, ["children", "https://127.0.0.1:9/"]) == []
    finally:
        server.shutdown()
        server.server_close()


def test_known_profile_comes_first(spark, site):
    wanted = spark.createDataFrame([(f"{site}/picky1", "windows")], "url string, profile string")
    row = web.fetch_live(wanted).first()
    assert (row["attempts"], row["profile_used"]) == (1, "windows")
    listed = web.fetch_live(wanted, CrawlOptions(block_urls=(f"{site}/picky1",))).first()
    assert listed["html"] is None and listed["error"].startswith("blocked by address list")


def test_per_host_gate(site):
    fetcher = web.Fetcher(CrawlOptions(per_host=3))
    assert all(r["error"] is None for r in fetcher.all([f"{site}/p{k}" for k in range(30)], fetcher.page))
    assert 1 < _Site.most <= 3
    fetcher.raw(f"{site}/i", "https://ref.test/")
    assert _Site.agents[-1][2] == "https://ref.test/"


def test_headers():
    assert set(web.headers_for("minimal")) == {"User-Agent"}
    for profile in web.PROFILES[1:]:
        assert {"Accept", "Accept-Language"} < set(web.headers_for(profile))
    assert "Mobile" in web.headers_for("ios")["User-Agent"] and web.headers_for("android")["Sec-Ch-Ua-Mobile"] == "?1"
    assert "Sec-Fetch-Mode" not in web.headers_for("macos")


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one\n<p>two")
    (tmp_path / "u.txt").write_text("a.test\n\n b.test \n")
    assert files.read_html(spark, str(tmp_path / "a.html")).first()["html"] == "<p>one\n<p>two"
    assert bytes(files.read_binary(spark, str(tmp_path / "a.html")).first()["content"]) == b"<p>one\n<p>two"
    assert sorted(r["url"] for r in files.read_urls(spark, str(tmp_path / "u.txt")).collect()) == ["a.test", "b.test"]
    files.write_json(spark.createDataFrame([("u", "h")], "url string, html string"), str(tmp_path / "j"))
    assert files.read_pages(spark, str(tmp_path / "j"), "json").count() == 1


def test_cli(spark, tmp_path):
    page = tmp_path / "p.html"
    page.write_text("<html lang=en><title>T</title><script type='application/ld+json'>{\"@type\":\"A\"}</script><h1>H</h1><a href='https://a.test/x'>x</a> 555-123-4567")
    run = lambda *a: cli.result(spark, [*a])
    assert run("page", str(page)) == [] and run("markdown", str(page)).startswith("# H")
    assert run("schemas", str(page)) == ["A"] and run("jsonld", str(page)) == [{"@type": "A"}] and run("phones", str(page)) == ["5551234567"]
    assert run("metadata", str(page)) == [["title", "T"], ["lang", "en"]] and run("preview", str(page)) == {"title": "T", "description": None, "image": None}
    rendered.regions(spark, SMALL).unionByName(rendered.nations(spark, SMALL)).unionByName(rendered.suppliers(spark, SMALL)).write.parquet(f"{tmp_path}/web")
    web_ = ("--snapshot", f"{tmp_path}/web")
    assert len(run("children", "https://geo.example.com/r/1", *web_)) >= 3
    assert all(x.endswith("@mail.example.com") for x in run("emails", "https://geo.example.com/r/1", *web_))
    assert run("fetch", "https://geo.example.com/r/1", *web_)["Ok"] > 500 and run("body", "https://nowhere.test/", *web_) == {"Err": "not in the snapshot"}


def test_streams_equal_batches(spark, tmp_path):
    web_ = fetch.snapshot_of(rendered.regions(spark, SMALL).unionByName(rendered.nations(spark, SMALL)))
    seeds = spark.createDataFrame([(f"https://geo.example.com/r/{k % 5}", k) for k in range(20)], "url string, k int")
    for k in range(4):
        seeds.where(f"k % 4 = {k}").select("url").coalesce(1).write.mode("append").parquet(f"{tmp_path}/urls")
    stream = discover.read_urls(spark, f"{tmp_path}/urls", "url string", files_per_trigger=1)
    got = sorted(r["url"] for r in discover.drain(discover.discover_children(stream, web_), "t").collect())
    assert got == sorted(r["url"] for r in crawl.discover_children(seeds.select("url"), web_).collect()) and len(got) == len(set(got)) == 25
    once = discover.drain(discover.fetch_stream(stream, web_), "f")
    assert once.count() == 20
    timed = stream.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert discover.drain(discover.discover_children(timed, web_, ttl="1 hour"), "w").count() == 25


def test_cut_uses_the_shared_folder(spark):
    frame = lineage.cut(spark.range(5))
    assert frame.count() == 5 and "Scan ExistingRDD" in frame._jdf.queryExecution().executedPlan().toString()


def test_kernels_agree_with_columns(spark):
    frame = rendered.table(spark, SMALL, "documents")
    rows = frame.select("text", udfs.normalize_text("text").alias("n")).collect()
    assert all(text.normalize_text(r["text"]) == r["n"] for r in rows)
