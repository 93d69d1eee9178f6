"""The registered queries of the web operators, over whole tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native, udfs
from ..operators import crawl, fetch, pages
from ..options import CrawlOptions
from ..streaming import discover
from . import rendered
from .rendered import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL for canonical page addresses, for the spellings that the pages table has.
_CANONICAL = r"""rtrim(regexp_replace(regexp_replace(split_part({0}, '?', 1), '#.*$', ''), '^https?://(www\.)?', 'https://'), '/')
  || CASE WHEN {0} LIKE '%?page=2&ref=x%' THEN '?page=2&ref=x' ELSE '' END"""
_PAGE = _CANONICAL.format("url")
#: The links of a page as they stand (the pages table has root-relative ones only), and their addresses.
_HREFS = """SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages"""
_ABSOLUTE = r"""regexp_extract(url, '^https?://[^/]+') || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',')"""
_BLANK = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _to_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.spread(_pages(spark, sf_dir))


# ---- links and addresses --------------------------------------------------------------------------------------


@query(f"""SELECT DISTINCT {_PAGE} AS page, regexp_replace(rtrim({_ABSOLUTE}, '/'), '^https?://(www\\.)?', 'https://') AS link FROM ({_HREFS})""")
def canonical_links(spark, sf_dir):
    found = pages.page_links(_to_parse(spark, sf_dir).select("url", "html"))
    return found.select(udfs.normalize_url("url").alias("page"), udfs.normalize_url("link").alias("link")).where("link <> ''").distinct()


@query(f"SELECT page_id, pos::int AS pos, {_ABSOLUTE} AS link FROM ({_HREFS})")
def page_links(spark, sf_dir):
    return pages.page_links(_to_parse(spark, sf_dir)).select("page_id", "pos", "link")


@query(f"SELECT DISTINCT {_PAGE} AS url FROM pages")
def canonical_urls(spark, sf_dir):
    return pages.distinct_urls(_pages(spark, sf_dir))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://facebook.com/u' || c_custkey || '?id=7' WHEN 1 THEN 'https://vm.tiktok.com/v' || c_custkey
  WHEN 2 THEN 'https://m.plain.example/p' || c_custkey || '?s=1' ELSE 'https://pinterest.co.uk/pin/' || c_custkey END AS url, c_custkey % 4 <> 2 AS social FROM customer""")
def social_urls(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("http://M.Facebook.com/u"), k, F.lit("/?si=q&id=7&utm_campaign=z"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("vm.tiktok.com/v"), k, F.lit("/?_r=1&_t=2"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("https://m.plain.example/p"), k, F.lit("?s=1"))).otherwise(F.concat(F.lit("https://www.pinterest.co.uk/pin/"), k, F.lit("/#x")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", udfs.normalize_social(raw).alias("url"))
    return rows.withColumn("social", native.is_social_url("url"))


@query(r"""SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS host, (regexp_extract(lower(url), '^https?://([^/?#]+)', 1) LIKE '%.example.com' OR regexp_extract(lower(url), '^https?://([^/?#]+)', 1) LIKE '%.example.net')
  AND NOT regexp_extract(lower(url), '^https?://([^/?#]+)', 1) SIMILAR TO '(.*\.)?(ththre\.example\.com|ththth\.example\.net)' AS allowed FROM pages""")
def host_filter(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", native.host("url").alias("host"), native.is_url_allowed("url", ("example.com", "example.net"), ("ththre.example.com", "ththth.example.net")).alias("allowed"))


@query("SELECT page_id, url FROM pages WHERE regexp_extract(lower(url), '^https?://([^/?#]+)', 1) LIKE '%.example.com' AND regexp_extract(lower(url), '^https?://([^/?#]+)', 1) NOT LIKE '%.ththre.example.com' AND regexp_extract(lower(url), '^https?://([^/?#]+)', 1) <> 'ththre.example.com'")
def host_lists(spark, sf_dir):
    allow, block = spark.createDataFrame([("example.com",)], "domain string"), spark.createDataFrame([("ththre.example.com",)], "domain string")
    return fetch.filter_hosts(_pages(spark, sf_dir).select("page_id", "url"), allow, block)


# ---- responses and fetching -----------------------------------------------------------------------------------

_ERROR = """CASE WHEN page_id % 5 = 4 THEN 'HTTP status 503' WHEN octet_length(encode(html)) < 500 THEN 'invalid content - body is too short'
  WHEN NOT contains(lower(html), '<html') AND NOT contains(lower(html), '<!doctype') THEN 'invalid content - missing HTML markers' END"""


@query(f"SELECT page_id, {_ERROR} IS NULL AS ok, {_ERROR} AS error FROM pages")
def valid_pages(spark, sf_dir):
    status = F.when(F.col("page_id") % 5 == 4, 503).otherwise(200)
    return _pages(spark, sf_dir).select("page_id", native.validate_response("html", status).alias("r")).select("page_id", "r.ok", "r.error")


@query(f"SELECT p.url, key AS canonical_url, page FROM (SELECT url, {_PAGE} AS key FROM pages) p JOIN (SELECT {_PAGE} AS key, md5(arg_min(html, url)) AS page, octet_length(encode(arg_min(html, url))) AS n FROM pages GROUP BY 1) USING (key) WHERE n >= 500")
def fetch_fast(spark, sf_dir):
    got = fetch.fetch(_pages(spark, sf_dir).select("url"), fetch.snapshot_of(_pages(spark, sf_dir)), CrawlOptions(strategy="fast"))
    return got.select("url", "canonical_url", F.md5("html").alias("page"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'minimal' WHEN page_id % 3 = 1 THEN 'windows' ELSE 'ios' END AS profile_used, (page_id % 3 + 1)::int AS attempts, (10 * (page_id % 3 + 1))::bigint AS duration_ms, length(html)::int AS size
  FROM pages WHERE octet_length(encode(html)) >= 500""")
def fetch_auto(spark, sf_dir):
    tries = F.array(*(F.struct(F.lit(p).alias("profile"), F.when(F.col("page_id") % 3 > k, 403).otherwise(200).alias("status"), F.col("html"), F.lit(10 * (k + 1)).alias("duration_ms")) for k, p in enumerate(("minimal", "windows", "ios"))))
    got = _pages(spark, sf_dir).select("page_id", fetch.choose_attempt(tries).alias("r")).where("r is not null")
    return got.select("page_id", "r.profile_used", "r.attempts", "r.duration_ms", F.length("r.html").alias("size"))


@query(f"""SELECT url, CASE WHEN regexp_extract({_PAGE}, '^https://([^/?]+)', 1) LIKE '%.example.net' THEN 'blocked by domain filter: ' || regexp_extract({_PAGE}, '^https://([^/?]+)', 1)
  WHEN octet_length(encode(first_value(html) OVER (PARTITION BY {_PAGE} ORDER BY url))) < 500 THEN 'invalid content - body is too short' END AS error FROM pages
  UNION ALL SELECT 'https://nowhere.example.com/' || page_id, 'not in the snapshot' FROM pages""")
def fetch_errors(spark, sf_dir):
    rows = _pages(spark, sf_dir)
    urls = rows.select("url").unionByName(rows.select(F.concat(F.lit("https://nowhere.example.com/"), "page_id").alias("url")))
    return fetch.fetch_results(urls, fetch.snapshot_of(rows), CrawlOptions(block_domains=("example.net",))).select("url", "error")


# ---- text and HTML --------------------------------------------------------------------------------------------

_JUNK_SQL = "html"
for _tag in ("script", "style", "noscript", "iframe", "svg"):
    _JUNK_SQL = f"regexp_replace({_JUNK_SQL}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', '', 'g')"
_JUNK_SQL = f"regexp_replace({_JUNK_SQL}, '(?s)<!--.*?-->', '', 'g')"
_JUNK_SQL = f"""regexp_replace({_JUNK_SQL}, '(?i){_BLANK}+(?:class|id|style|data-[\\w\\p{{L}}-]+|aria-[\\w\\p{{L}}-]+|role|tabindex|xmlns(?::[\\w\\p{{L}}-]+)?|version|viewBox|fill|fill-rule|stroke(?:-[\\w\\p{{L}}-]+)?|on[\\w\\p{{L}}-]+){_BLANK}*={_BLANK}*(?:"[^"]*"|''[^'']*''|[^\\s>]+)', '', 'g')"""


@query(f"SELECT page_id, md5(trim(regexp_replace({_JUNK_SQL}, '{_BLANK}+', ' ', 'g'))) AS html_md5 FROM (SELECT page_id, replace(html, '\\n', chr(10)) AS html FROM pages)")
def clean_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.md5(native.normalize_html("html")).alias("html_md5"))


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(13), chr(10)), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g'), '{_BLANK}+', ' ', 'g'))) AS text_md5 FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(udfs.normalize_text("text")).alias("text_md5"))


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')) AS text FROM documents")
def whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", native.squeeze("text").alias("text"))


@query(r"""SELECT page_id, 0 AS pos, 'title' AS key, trim(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), ' ' || chr(10) || chr(9)) AS value FROM pages
  UNION ALL SELECT page_id, 1, 'lang', regexp_extract(html, '<html lang="([^"]*)"', 1) FROM pages""")
def page_metadata(spark, sf_dir):
    return pages.metadata(_to_parse(spark, sf_dir)).select("page_id", "pos", "key", "value")


@query()
def page_body(spark, sf_dir):
    return pages.with_parts(_to_parse(spark, sf_dir), "body").select("page_id", "body")


@query()
def page_markdown(spark, sf_dir):
    return pages.with_parts(_to_parse(spark, sf_dir), "markdown").select("page_id", "markdown")


_FILLER = "repeat('These words make the page long enough. ', 12)"


@query(f"""SELECT 'https://shop.example.com/p/' || p_partkey AS url, '# ' || p_name || chr(10) || chr(10) || 'A **' || p_type || '** of [' || p_brand || '](/brand/' || p_partkey || ')' || chr(10) || chr(10) || trim({_FILLER}) AS markdown,
  '<body><h1>' || p_name || '</h1><p>A <b>' || p_type || '</b> of <a href="/brand/' || p_partkey || '">' || p_brand || '</a></p><p>' || {_FILLER} || '</p></body>' AS body FROM part""")
def product_markdown(spark, sf_dir):
    return pages.with_parts(rendered.products(spark, sf_dir), "markdown", "body")


@query(f"""SELECT 'https://shop.example.com/p/' || p_partkey AS url, 5 AS pairs, 2 AS entities, length('<body><h1></h1><p>A <b></b> of <a href="/brand/"></a></p><p></p></body>' || p_name || p_type || p_partkey || p_brand || {_FILLER})::int AS size FROM part""")
def scrape_all(spark, sf_dir):
    found = pages.with_parts(rendered.products(spark, sf_dir), "body", "metadata", "entities")
    return found.select("url", F.size("metadata").alias("pairs"), F.size("entities").alias("entities"), F.length("body").alias("size"))


# ---- contacts -------------------------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT lower(e) AS email FROM (SELECT unnest(regexp_extract_all(text, '(?i)\b[a-z0-9._%+-]+@[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,24}\b')) AS e FROM documents)
  WHERE NOT regexp_matches(lower(e), '\.(avi|css|doc|docx|gif|gz|ico|jpeg|jpg|js|mov|mp3|mp4|pdf|png|prod|svg|tar|webp|xls|xlsx|zip)$')""")
def doc_emails(spark, sf_dir):
    rows = pages.rows_of(table(spark, sf_dir, "documents").where(F.col("text").rlike("[@&]")), udfs.text_emails("text"), "raw")
    return rows.select(native.normalize_email("raw").alias("email")).where("email <> ''").distinct()


@query(r"""SELECT DISTINCT (CASE WHEN p LIKE '+%' THEN '+' ELSE '' END) || regexp_replace(p, '[^0-9]', '', 'g') AS phone FROM
  (SELECT unnest(regexp_extract_all(text, '(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}')) AS p FROM documents)""")
def doc_phones(spark, sf_dir):
    rows = pages.rows_of(table(spark, sf_dir, "documents").where(F.col("text").rlike(r"(?U)\d{4}|[&\x00]")), udfs.text_phones("text"), "raw")
    return rows.select(native.normalize_phone("raw").alias("phone")).where("phone <> ''").distinct()


@query("SELECT 'https://people.example.com/c/' || c_custkey AS url, 'c' || c_custkey || '@example.com' AS email FROM customer")
def page_emails(spark, sf_dir):
    found = pages.with_parts(rendered.people(spark, sf_dir), "emails")
    return pages.rows_of(found, native.normalize_emails("emails"), "email", "url").drop("pos")


@query("SELECT 'https://people.example.com/c/' || c_custkey AS url, '555010' || lpad((c_custkey % 10000)::varchar, 4, '0') AS phone FROM customer")
def page_phones(spark, sf_dir):
    found = pages.with_parts(rendered.people(spark, sf_dir), "phones")
    return pages.rows_of(found, native.normalize_phones("phones"), "phone", "url").drop("pos")


# ---- structured data ------------------------------------------------------------------------------------------


@query("""SELECT 'https://shop.example.com/p/' || p_partkey AS url, p_partkey::varchar AS sku, p_name AS name, p_brand AS brand FROM part""")
def jsonld_products(spark, sf_dir):
    found = pages.entities(rendered.products(spark, sf_dir), include=("Product",))
    return found.select("url", F.get_json_object("entity", "$.sku").alias("sku"), F.get_json_object("entity", "$.name").alias("name"), F.get_json_object("entity", "$.brand.name").alias("brand"))


@query("""SELECT 'https://people.example.com/c/' || c_custkey AS url, '{"@type":"Person","address":{"@type":"PostalAddress","addressCountry":"N' || c_nationkey || '"},"email":"mailto:c' || c_custkey || '@example.com","name":"' || c_name || '","telephone":"555-010-' || lpad((c_custkey % 10000)::varchar, 4, '0') || '","worksFor":"' || c_mktsegment || '"}' AS entity FROM customer""")
def merged_people(spark, sf_dir):
    return pages.entities(rendered.people(spark, sf_dir)).select("url", "entity")


@query("""SELECT 'https://people.example.com/c/' || c_custkey AS url, pos, CASE pos WHEN 0 THEN '{"properties":{"email":["mailto:c' || c_custkey || '@example.com"],"name":["' || c_name || '"]},"type":["h-card"]}'
  ELSE '{"properties":{"name":["' || c_name || '"],"org":["' || c_mktsegment || '"],"tel":["555-010-' || lpad((c_custkey % 10000)::varchar, 4, '0') || '"]},"type":["h-card"]}' END AS item FROM customer, (VALUES (0), (1)) p(pos)""")
def microformats(spark, sf_dir):
    return pages.rows_of(pages.with_parts(rendered.people(spark, sf_dir), "microformats"), "microformats", "item", "url")


@query("""SELECT 'https://www.suppliers.example.com/s/' || s_suppkey || '/' AS url, '{"@id":"#s' || s_suppkey || '","@type":"Organization","identifier":"' || s_suppkey || '","location":{"@type":"Place","name":"' || n_name || '"},"name":"' || s_name || '"}' AS entity
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def rdfa_suppliers(spark, sf_dir):
    return pages.entities(rendered.suppliers(spark, sf_dir)).select("url", "entity")


@query("""SELECT 'https://shop.example.com/p/' || p_partkey AS url, p_name AS title, p_type || ' item' AS description, '/img/' || p_partkey || '.png' AS image FROM part""")
def og_previews(spark, sf_dir):
    return pages.previews(rendered.products(spark, sf_dir)).select("url", "preview.title", "preview.description", "preview.image")


@query("SELECT 'https://shop.example.com/p/' || p_partkey AS url, pos, CASE pos WHEN 0 THEN 'Product' WHEN 1 THEN 'Offer' ELSE 'Thing' END AS type FROM part, (VALUES (0), (1), (2)) p(pos)")
def schema_types(spark, sf_dir):
    found = pages.with_parts(rendered.products(spark, sf_dir), "entities")
    return pages.rows_of(found, native.schema_types("entities"), "type", "url")


@query("SELECT 'https://shop.example.com/p/' || p_partkey AS url, true AS offer, false AS person FROM part")
def has_type(spark, sf_dir):
    found = pages.with_parts(rendered.products(spark, sf_dir), "entities")
    return found.select("url", native.has_schema_type("entities", "https://schema.org/Offer").alias("offer"), native.has_schema_type("entities", "Person").alias("person"))


# ---- children and crawls --------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey)
  SELECT 'https://orders.example.com/c/' || o_custkey AS url, 'https://orders.example.com/c/o/' || o_orderkey || '/' AS link FROM orders JOIN n USING (o_custkey) WHERE c >= 3
  UNION ALL SELECT 'https://orders.example.com/c/' || o_custkey, 'https://orders.example.com/c/' || o_custkey FROM n WHERE c < 3""")
def child_links(spark, sf_dir):
    return pages.child_links(rendered.listings(spark, sf_dir)).select("url", "link")


@query("""SELECT 'https://geo.example.com/n/' || s_nationkey AS url, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::int AS pos, 'https://suppliers.example.com/s/' || s_suppkey AS link FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)""")
def itemlist_links(spark, sf_dir):
    return pages.child_links(rendered.nations(spark, sf_dir)).select("url", "pos", "link")


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (rendered.regions(spark, sf_dir), rendered.nations(spark, sf_dir), rendered.suppliers(spark, sf_dir))
    return fetch.snapshot_of(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.concat(F.lit("http://www.geo.example.com/r/"), "r_regionkey", F.lit("/?utm_medium=x")).alias("url"))


_NATIONS = "SELECT DISTINCT 'https://geo.example.com/n/' || n_nationkey AS url FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(_NATIONS)
def crawl_discover(spark, sf_dir):
    return crawl.discover_children(_seeds(spark, sf_dir), _web(spark, sf_dir))


@query(f"{_NATIONS} WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def crawl_children(spark, sf_dir):
    return crawl.children(_seeds(spark, sf_dir), _web(spark, sf_dir)).select("url")


@query("SELECT DISTINCT 's' || s_suppkey || '@mail.example.com' AS email FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def crawl_emails(spark, sf_dir):
    return crawl.emails(_seeds(spark, sf_dir), _web(spark, sf_dir))


@query("""SELECT 'https://geo.example.com/r/' || r_regionkey AS url, 0 AS depth FROM region UNION ALL SELECT 'https://geo.example.com', 1
  UNION ALL SELECT 'https://geo.example.com/n/' || n_nationkey, 1 FROM nation UNION ALL SELECT 'https://geo.example.com/share/' || n_nationkey, 1 FROM nation
  UNION ALL SELECT 'https://suppliers.example.com/s/' || s_suppkey, 2 FROM supplier""")
def crawl_depth(spark, sf_dir):
    return crawl.crawl(_seeds(spark, sf_dir), _web(spark, sf_dir), CrawlOptions(depth=2))


@query(f"SELECT DISTINCT {_PAGE} AS url FROM pages")
def stream_children(spark, sf_dir):
    """On these pages every child list is the page itself, so the stream's result is the set of pages."""
    urls = discover.read_urls(spark, f"{sf_dir}/page[s].parquet", "page_id long, url string, html string")
    return discover.drain(discover.discover_children(urls.select("url"), fetch.snapshot_of(_pages(spark, sf_dir))), "stream_children")


@query(f"{_NATIONS} WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def stream_pages(spark, sf_dir):
    """Seeds as a stream: their children, and the pages of these."""
    seeds = discover.read_urls(spark, f"{sf_dir}/regio[n].parquet", "r_regionkey int").select(F.concat(F.lit("https://geo.example.com/r/"), "r_regionkey").alias("url"))
    return discover.drain(discover.children_stream(seeds, _web(spark, sf_dir)).select("url"), "stream_pages")


@query(f"SELECT p.url, size FROM (SELECT url, {_PAGE} AS key FROM pages) p JOIN (SELECT {_PAGE} AS key, length(arg_min(html, url))::int AS size, octet_length(encode(arg_min(html, url))) AS n FROM pages GROUP BY 1) USING (key) WHERE n >= 500")
def stream_fetch(spark, sf_dir):
    urls = discover.read_urls(spark, f"{sf_dir}/page[s].parquet", "page_id long, url string, html string")
    return discover.drain(discover.fetch_stream(urls.select("url"), fetch.snapshot_of(_pages(spark, sf_dir))).select("url", F.length("html").alias("size")), "stream_fetch")


# ---- lists ----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, pos, CASE pos WHEN 0 THEN 'c' || c_custkey || '@example.com' ELSE 'other+x@example.org' END AS email FROM customer, (VALUES (0), (1)) p(pos)")
def email_lists(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    raw = F.array(F.concat(F.lit("C Name <C"), k, F.lit("@Example.COM>")), F.lit("logo@2x.png"), F.lit("other+x%40example.org."), F.concat(F.lit(" c"), k, F.lit("@example.com, ")), F.lit("no address"), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(native.normalize_emails(raw)).alias("pos", "email"))


@query("SELECT s_suppkey, pos, CASE pos WHEN 0 THEN '+1555' || lpad(s_suppkey::varchar, 7, '0') ELSE '555' || lpad(s_suppkey::varchar, 7, '0') END AS phone FROM supplier, (VALUES (0), (1)) p(pos)")
def phone_lists(spark, sf_dir):
    k = F.lpad(F.col("s_suppkey").cast("string"), 7, "0")
    raw = native.merge(F.array(F.concat(F.lit("+1 (555) "), k), F.concat(F.lit("555-"), k, F.lit(" x22"))), F.array(F.concat(F.lit("555."), k, F.lit(" EXT. 9")), F.lit("none"), F.lit("")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(native.normalize_phones(raw)).alias("pos", "phone"))


@query("""SELECT n_nationkey, 'https://n' || n_nationkey || '.example.com' || CASE pos WHEN 0 THEN '' ELSE '/Path?a=1&b=2' END AS url, pos FROM nation, (VALUES (0), (1)) p(pos)""")
def url_lists(spark, sf_dir):
    at = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(".Example.com"))
    raw = F.array(at, F.concat(F.lit("http://www."), at, F.lit("/#top")), F.concat(F.lit("HTTPS://"), at, F.lit("/Path/?b=2&a=1&gclid=x")), F.concat(at, F.lit("/Path?a=1&b=2")), F.lit(""))
    return pages.rows_of(table(spark, sf_dir, "nation"), udfs.normalize_urls(raw), "url", "n_nationkey")


@query("SELECT n_nationkey, pos, CASE pos WHEN 0 THEN 'https://x.com/N' || n_nationkey WHEN 1 THEN '' ELSE 'https://x.com/n' || n_nationkey END AS url FROM nation, (VALUES (0), (1), (2)) p(pos)")
def social_lists(spark, sf_dir):
    """Repeats go, case and empty ones stay."""
    k = F.col("n_nationkey").cast("string")
    raw = F.array(F.concat(F.lit("https://x.com/N"), k), F.lit(""), F.concat(F.lit("https://x.com/N"), k), F.concat(F.lit("https://x.com/n"), k), F.lit(""))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(native.dedupe(raw)).alias("pos", "url"))


@query("SELECT DISTINCT CASE n_nationkey % 2 WHEN 0 THEN 'n' || n_nationkey || '.example.com' ELSE 'xn--mnich-kva.example.com' END AS domain FROM nation")
def domains(spark, sf_dir):
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("WWW.N"), F.col("n_nationkey").cast("string"), F.lit(".Example.com"))).otherwise("www.MÜNICH.example.com")
    return table(spark, sf_dir, "nation").select(udfs.normalize_domain(raw).alias("domain")).distinct()
