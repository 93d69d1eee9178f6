"""URL, tree, link, structured-data and text kernels on plain values."""

import cProfile
import gc
import pstats
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import dom, links, structured, text, udfs, urls

# ---- URLs -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("/für", "https://site.test/f%C3%BCr"), ("../c?q=1", "https://site.test/c?q=1"), ("//o.test/x", "https://o.test/x"), ("https://o.test", "https://o.test/"), ("#s", "https://site.test/a/b?x=1#s"),
        ("?q", "https://site.test/a/b?q"), ("mailto:x@y.z", None), ("javascript:void(0)", None), ("c d", "https://site.test/a/c%20d"), ("http://münich.test/ä", "http://xn--mnich-kva.test/%C3%A4"),
        ("./x/./y/../z", "https://site.test/a/x/z"), ("\\win\\path", "https://site.test/win/path"), ("https://site.test:443/", "https://site.test/"), ("http://0x7f.1/", "http://127.0.0.1/"),
        ("http://[::1]:80/", "http://[::1]/"), ("http://a b/", None), ("http://1.2.3.256/", None), ("", "https://site.test/a/b?x=1"),
    ],
)
def test_resolve(href, want):
    assert urls.resolve(href, urls.parse("https://site.test/a/b?x=1")) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://site.test", "https://site.test"), ("site.test", "https://site.test"), ("www.site.test/", "https://site.test"), ("HTTP://WWW.Site.Test/Path//#top", "https://site.test/Path"), ("https://site.test/?b=2&a=1", "https://site.test/?a=1&b=2"),
        ("https://site.test/p?utm_source=n&gclid=1", "https://site.test/p"), ("https://site.test/p?id=1&fbclid=2&utm_x=3", "https://site.test/p?id=1"), ("no-address", "no-address"), ("", ""), ("http://", "http://"),
        ("https://site.test/?a=1&a=2", "https://site.test/?a=2"), ("https://site.test/?q=a%26b", "https://site.test/?q=a&b"), ("mailto:a@b.test", "https://mailto:a@b.test"), ("http://münich.test/p", "https://xn--mnich-kva.test/p"), ("http://site.test:80/x", "https://site.test/x"),
    ],
)
def test_normalize_url(url, want):
    assert urls.normalize_url(url) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://m.facebook.com/p?si=1&id=2", "https://facebook.com/p?id=2"), ("https://mobile.x.com/a?s=20&t=1", "https://x.com/a?t=1"), ("https://vm.tiktok.com/Z/?_r=1", "https://vm.tiktok.com/Z"), ("https://youtu.be/q?feature=s", "https://youtu.be/q"),
        ("https://m.site.test/p?s=1", "https://m.site.test/p?s=1"), ("https://www.reddit.com/r/x/?rdt=1&share_id=2", "https://reddit.com/r/x"),
    ],
)
def test_normalize_social(url, want):
    assert urls.normalize_social(url) == want
    assert urls.is_social_url(url) == ("site.test" not in url)


def test_domains():
    for name, want in (("WWW.Site.Test", "site.test"), ("www", "www"), ("www.com", "com"), ("www.a.site.test", "a.site.test")):
        assert urls.normalize_domain(name) == want
    assert not urls.is_social_url("https://notreddit.com/") and not urls.is_social_url("reddit") and urls.is_social_url("https://old.reddit.com/r")


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_is_no_trouble(s):
    urls.normalize_social(s)
    url = urls.parse(s)
    if url is not None:
        assert str(urls.parse(str(url))) == str(url)
    text.normalize_text(s)
    for root in (dom.document(s), dom.fragment(s)):
        links.child_links(root, "https://a.test/")
        structured.entities(root)
        text.to_markdown(root)


# ---- trees ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<b>b<p>c</b>d", "<p>a<b>b</b></p><p><b>c</b>d</p>"), ("<table><tr><td>1<td>2<tr><td>3</table>x", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>x"), ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ("<b><p>1</b>2</p>", "<b></b><p><b>1</b>2</p>"), ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"), ("<table>x<tr><td>y</table>", "x<table><tbody><tr><td>y</td></tr></tbody></table>"), ("<p>1<i>2<b>3</i>4</b>5", "<p>1<i>2<b>3</b></i><b>4</b>5</p>"),
        ("a &lt; b &amp; c &copy d", "a &lt; b &amp; c © d"), ("<script>a<b</script>c", "<script>a<b</script>c"), ("<textarea>&amp;<b></textarea>", "<textarea>&amp;&lt;b&gt;</textarea>"), ("<p/>x<br/>y", "<p>x<br>y</p>"), ("</p>x", "<p></p>x"),
        ("<A HREF='x&amp;y' href=z>t</A>", '<a href="x&amp;y">t</a>'), ("<a href='?a=1&copy=2'>", '<a href="?a=1&amp;copy=2"></a>'), ("1<2 <!-- c -->3<!x>4<?y>5", "1&lt;2 <!-- c -->3<!--x-->4<!--?y-->5"), ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"), ("<h1>a<h2>b</h1>", "<h1>a</h1><h2>b</h2>"),
        ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"), ("<svg><path d=1/><g></g></svg>x", '<svg><path d="1/"><g></g></path></svg>x'), ("<div><p>x</div>y", "<div><p>x</p></div>y"), ("<noscript><p>x</noscript>", "<noscript><p>x</noscript>"),
    ],
)
def test_fragment(html, want):
    assert dom.fragment(html).inner() == want


def test_document():
    assert dom.document("<title>t</title>x").outer() == "<html><head><title>t</title></head><body>x</body></html>"
    assert dom.document("<!DOCTYPE html><html lang=en><meta name=a content=b><body class=c>x</body></html>y").outer() == '<html lang="en"><head><meta name="a" content="b"></head><body class="c">xy</body></html>'
    assert dom.document("").outer() == "<html><head></head><body></body></html>"


def test_deep_trees():
    root = dom.document("<div>" * 5000 + "x")
    assert root.text() == "x" and len(root.outer()) > 5000 * 11


# ---- links ----------------------------------------------------------------------------------------------------


def test_page_links():
    root = dom.document("<a href=' \"/a\" '>1</a><a href=/a>2</a><a>3</a><area href=/no><a href='tel:1'>4</a><base href='//z/'><a href=b>5</a>")
    assert links.page_links(root, "http://s.test/x/") == ["http://s.test/a", "http://s.test/a", "http://s.test/x/b"]
    assert links.page_links(root, "nonsense") == []


CARD = "<div><h3><a href='/i{0}'>Item {0}</a></h3><p>text</p><a href='/share'>Share</a></div>"


def test_children_are_the_repeating_siblings():
    cards = "".join(CARD.format(k) for k in range(4))
    want = [f"https://s.test/i{k}" for k in range(4)]
    nav = "<nav>" + "".join(f"<div><b>x</b><i>y</i><a href='/n{k}'>n</a></div>" for k in range(9)) + "</nav>"
    assert links.child_links(dom.document(f"{nav}<main>{cards}</main>"), "https://s.test/") == want
    assert links.child_links(dom.document(f"{nav}"), "https://s.test/")[0] == "https://s.test/n0"
    assert links.child_links(dom.document("<ul><li><a href=/a>a</a><li><a href=/b>b</a><li><a href=/c>c</a></ul>"), "https://s.test/p") == ["https://s.test/p"]
    runs = "".join(f"<h3>T{k}</h3><div><p>a</p><a href='/r{k}'>more</a></div>" for k in range(3))
    assert links.child_links(dom.document(f"<section>{runs}</section>"), "https://s.test/") == [f"https://s.test/r{k}" for k in range(3)]
    assert links.child_links(dom.document(cards), "no address") == ["no address"]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<a href=/share>Share</a><a href=/x>Read</a>", "/x"), ("<h2>The title</h2><a href=/a>more</a><a href=/t>the  TITLE</a>", "/t"), ("<a href=/s>save</a>", "/s"), ("<a href=/1><b>one</b></a><a href=/2><strong>two</strong></a>", "/2"),
        ("<h3>Long heading here</h3><a href=/p>heading</a><a href=/q>Long heading here and on</a>", "/q"), ("<a href='&quot;/q&quot;'>x</a>", "/q"), ("<a href=mailto:x>m</a>", None),
    ],
)
def test_primary_link(html, want):
    got = links.primary_link([dom.fragment(html)], urls.parse("https://s.test/"))
    assert got == (want and "https://s.test" + want)


def test_item_lists():
    data = '{"@graph":[{"@type":"WebPage","mainEntity":{"@type":"itemlist","itemListElement":[{"url":"/a"},{"url":"#x"},{"url":"https://www.s.test/p#x"},{"url":"https://o.test/q#x"},{"url":"#none"},{"item":{"url":"/no"}},{"url":5},{"url":"mailto:z"}]}}]}'
    html = f"<script type='application/ld+json'>{data}</script><script type='application/ld+json'>{{bad</script><div id=x><a href=/anchor>t</a></div>"
    assert links.itemlist_links(dom.document(html), urls.parse("https://s.test/p")) == ["https://s.test/a", "https://s.test/anchor", "https://s.test/anchor", "https://o.test/q#x"]


# ---- structured data ------------------------------------------------------------------------------------------


def entities(html):
    return structured.entities(dom.document(html))


def test_jsonld_shapes():
    wrap = lambda s: f"<script type='application/ld+json'>{s}</script>"
    assert entities(wrap('[{"@type":"A"},[{"@type":"B"}],3]')) == [{"@type": "A"}, {"@type": "B"}]
    assert entities(wrap('{"x":1,"@graph":[{"@type":"A"}]}')) == [{"@type": "A"}]
    assert entities(wrap('{"x":1,"@graph":{"@type":"A"}}')) == [{"x": 1}]
    assert entities(wrap("{bad") + wrap("NaN")) == []


def test_microdata():
    html = """<div itemscope itemtype="https://schema.org/Recipe https://schema.org/Thing/" itemid=" u "><p itemprop="note">outer <b itemprop="inner alt"> in </b></p><img itemprop=image src=/i.png><time itemprop=date datetime=2020>x</time>
      <meta itemprop=m content=c><div itemprop=author itemscope itemtype=Person><i itemprop=name>Ann</i></div><div itemscope><i itemprop=lost>no</i></div><a itemprop=image href=/b>b</a><data itemprop=v value=7>x</data><link itemprop=none></div>"""
    first, second = entities(html)
    assert first == {"@type": ["Recipe", "Thing"], "@id": "u", "note": "outer  in", "inner": "in", "alt": "in", "image": ["/i.png", "/b"], "date": "2020", "m": "c", "author": {"@type": "Person", "name": "Ann"}, "v": "7", "none": ""}
    assert second == {"lost": "no"}


def test_rdfa():
    html = "<div typeof='schema:Person' about='#a' resource='#r'><span property='name' content='C'>t</span><div property='knows' typeof='Person'><i property='name'>B</i></div></div>"
    assert entities(html) == [{"@type": "Person", "@id": "#r", "name": "C", "knows": {"@type": "Person", "name": "B"}}]


def test_microformats():
    mf = lambda s: structured.microformats(dom.document(s))
    assert mf("<div class='h-card p-4'><a class='p-name u-url' href=' /u '>N  M</a><time class=dt-bday datetime=2000>x</time><div class='e-note'> <b>h</b> </div></div>") == [{"type": ["h-card"], "properties": {"name": ["N M"], "url": ["/u"], "bday": ["2000"], "note": [{"html": "<b>h</b>", "value": "h"}]}}]
    assert mf("<div class=h-feed><p class=h-entry><i class=p-name>a</i></p></div>") == [{"type": ["h-feed"], "properties": {}, "children": [{"type": ["h-entry"], "properties": {"name": ["a"]}}]}]
    assert mf("<div class=h-entry><div class='p-author h-card'><i class=p-name>A</i></div></div>")[0]["properties"]["author"] == [{"type": ["h-card"], "properties": {"name": ["A"]}, "value": "A"}]
    assert mf("<div class='vcard h-card'><i class=fn>x</i></div>") == [{"type": ["h-card"], "properties": {}}]
    assert mf("<div class=vcard><i class=fn>x</i><i class=title>boss</i><div class=adr></div></div>") == [{"type": ["h-card"], "properties": {"name": ["x"], "job-title": ["boss"], "adr": [{"type": ["h-adr"], "properties": {}, "value": ""}]}}]
    assert mf("<span class=geo></span><div class=screen>x</div>") == []


def test_microformats_as_schema():
    html = "<div class=h-recipe><b class=p-name>Soup</b><div class=e-instructions><p>one</p><p>two</p></div><img class=u-photo src=/p><img class=u-featured src=/f></div>"
    assert entities(html) == [{"@type": "Recipe", "name": "Soup", "recipeInstructions": ["one", "two"], "image": "/f"}]
    assert entities("<div class=h-entry><div class=e-content><p>one</p><p>two</p></div></div>") == [{"@type": "Article", "articleBody": "onetwo"}]
    assert entities("<div class=h-feed><b class=p-name>x</b></div><div class=h-card></div>") == []


def test_fold():
    a = {"@type": "https://schema.org/Person", "name": " Ann ", "email": "", "tags": []}
    b = {"@type": ["Person"], "name": ["ANN"], "email": "e", "tags": ["t"], "tel": "1"}
    assert structured.fold([a], [b]) == [a | {"email": "e", "tags": ["t"], "tel": "1"}]
    assert len(structured.fold([a], [{"@type": "Org", "name": "Ann"}, {"@type": "Person"}, {"@type": "Person"}])) == 4
    assert len(structured.fold([a], [{"name": "z"}, {"name": "Z", "k": 1}])) == 2


def test_short_types():
    assert [structured.short_type(x) for x in ("https://schema.org/A/", "s:B", "C", "//")] == ["A", "B", "C", None]


# ---- text -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Tom &amp; &#39;J&#x27; &apos;&nbsp;", "Tom & 'J' '"), ("&copy 1 &nope; &amp", "&copy 1 &nope; &amp"), ("é", "é"), ("a​b﻿c", "abc"), ("a\r\nb\tc\x01d\x85", "a b cd"), ("  x   y  ", "x y"), ("&lt;b&gt;", "<b>"), ("", ""), ("日本 \U0001f44b", "日本 \U0001f44b"),
    ],
)
def test_normalize_text(raw, want):
    assert text.normalize_text(raw) == want


def test_contacts():
    root = dom.fragment("<a href='mailto: A@b.test?subject=x'>A@b.test</a><div>12</div><a href=mailto:>x</a> z@mail.co.uk, <a href='tel:+1 555'>c</a> (555) 123-4567 and +1-555-123-4567")
    assert text.emails(root) == ["A@b.test", "A@b.test", "z@mail.co.uk"]
    assert text.phones(root) == ["+1 555", "(555) 123-4567", "+1-555-123-4567"]


@given(st.text(alphabet=st.sampled_from("aB1.-_%+@ é,"), max_size=40))
@settings(max_examples=500, deadline=None)
def test_emails_are_those_of_the_plain_expression(s):
    plain = re.compile(r"\b[a-z0-9._%+-]+@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,24}\b", re.I)
    s = s.replace(" ", " x@y.zz ", 1)
    assert text.find_emails(s) == plain.findall(s)


def test_long_runs_of_name_characters():
    assert text.find_emails("a-" * 200_000 + " x@y.test " + "@" * 1000) == ["x@y.test"]


def test_metadata():
    root = dom.document("<html lang=de><title> T </title><meta name=a property=b content=' v '><meta property=og:x content=y><meta name=n content=' '><meta charset=u>")
    assert text.metadata(root) == [("title", "T"), ("a", " v "), ("og:x", "y"), ("lang", "de")]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h1>Title</h1><p>Hello <b>world</b> and <em>all</em></p>", "# Title\n\nHello **world** and *all*"), ("<a href=https://s.test>link</a>", "[link](https://s.test)"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "* a\n* b\n  * c"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
        ("<style>x</style><script>y</script>", ""), ("", ""), ("<blockquote><p>q</p></blockquote><hr>", "> q\n\n---"), ("<pre>a\n b</pre>", "```\na\n b\n```"), ("a_b*c", "a\\_b\\*c"), ("<p>x<br>y", "x  \ny"), ("<img src=/i alt=t><code>a_b</code>", "![t](/i)`a_b`"),
        ("<table><tr><th>h<th>i<tr><td>1</table>", "| h | i |\n| --- | --- |\n| 1 |  |"),
    ],
)
def test_markdown(html, want):
    assert text.to_markdown(dom.document(html)) == want


# ---- deep and long pages --------------------------------------------------------------------------------------

DEEP = {
    "div": "<div>{}</div>", "span": "<span>{}</span>", "bold": "<b>{}</b>", "straddling": "<b><div>{}", "list": "<ul><li>{}", "quote": "<blockquote>{}",
    "card": '<div class="h-card"><p class="p-author h-card">{}', "item": '<div itemscope itemprop="a">{}', "table": "<table><tr><td>{}", "stray ends": "<div>{}</x></p>",
}


@pytest.mark.parametrize("kind", DEEP)
def test_deep_pages_return_all_parts(kind):
    before, after = DEEP[kind].split("{}")
    html = before * 5000 + "a word" + after * 5000
    began = time.process_time()
    parts = udfs._parse(html, "http://a.com/", ("markdown", "entities", "microformats", "body", "emails", "children"))
    assert None not in parts and "a word" in parts[0] and time.process_time() - began < 20


def test_deep_json():
    value = {"@type": "A", "n": 1}
    nested = value
    for k in range(100_000):
        nested = [nested] if k % 2 else {"b": nested, "a": "ä"}
    text = structured.dump(nested)
    assert text.count('{"a":"ä","b":') == 50_000 and structured.dump({"b": [1, {"c": None}], "a": []}) == '{"a":[],"b":[1,{"c":null}]}' == structured._dump_deep({"b": [1, {"c": None}], "a": []})
    assert structured.flatten([[[value]], {"@graph": [value, {"@graph": [value]}]}] + [[]]) == [value] * 3
    for _ in range(50_000):
        value = [value]
    assert structured.flatten(value) == [{"@type": "A", "n": 1}]


def test_many_alike_cards_in_little_time():
    html = "<div>" + "".join(f'<div><h3>t</h3><p><a href="/p/{k}">x</a></p></div>' for k in range(20_000)) + "</div>"
    root, began = dom.document(html), time.process_time()
    assert len(links.child_links(root, "http://a.com/")) == 20_000 and time.process_time() - began < 10


def test_emphasis_and_tables_within_themselves():
    assert text.to_markdown(dom.document("<p><b>a <strong>b</strong> <i>c <b>d</b></i></b> <b>e</b></p>")) == "**a b *c d*** **e**"
    assert text.to_markdown(dom.document("<table><tr><td>a<table><tr><td>b</table></table>")).count("b") == 1


def test_child_links_take_few_steps_a_card():
    """Calls of functions, which unlike seconds are the same on any machine: 718 a card when every tag took the long way."""
    cards = "".join(f'<div><p>1-URGENT</p><h2><a href="o/{k}/">Order {k}</a></h2><p>O</p></div>' for k in range(1000))
    profile = cProfile.Profile()
    found = profile.runcall(udfs._parse, f"<!DOCTYPE html><html><body><section>{cards}</section></body></html>", "https://s.test/c/1", ("children",))
    assert found == [[f"https://s.test/c/o/{k}/" for k in range(1000)]]
    assert pstats.Stats(profile).total_calls < 450 * 1000


def test_no_tree_outlives_its_page():
    gc.collect()
    gc.disable()
    try:
        udfs._parse("<html><body>" + "<div><p>x</p></div>" * 100, "https://s.test/", ("children", "emails"))
        assert not any(type(x) is dom.Element for x in gc.get_objects())
    finally:
        gc.enable()
