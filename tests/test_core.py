"""The extraction engine: SQL agreement, and our own small pages."""

import os

import compare
import pytest
from pyspark.sql import functions as F

from pagewright import queries
from pagewright import __main__ as cli
from pagewright.functions import dom, texts, urls
from pagewright.functions.register import register
from pagewright.operators import articles, fetching, pages
from pagewright.plans import crawl
from pagewright.plans.cut import release, stored
from pagewright.sources import feeds, sinks
from pagewright.sources import fetching as transport
from pagewright.streaming.articles import ingest, page_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert compare.differences(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], compare.duck(SF)) == ""


def values(spark, column, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, url string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("url"))).collect()]


def test_normalize_url(spark):
    cases = {
        "HTTP://Example.COM:80/A?b=2&utm_source=x&a=1#top": "http://example.com/A?a=1&b=2", "https://e.com:8443/p": "https://e.com:8443/p", "https://e.com/?q=&FBCLID=1": "https://e.com/?q=",
        "https://e.com/p?b=2&a=x y&b=1": "https://e.com/p?a=x+y&b=2&b=1", "not-a-url": "https:not-a-url", "": "https:", None: None,
    }
    assert values(spark, urls.normalize_url, cases) == [*cases.values()]


def test_slug_file_score(spark):
    assert values(spark, urls.slug, ["https://e.com/a/b-c/", "https://e.com/", "https://e.com/é?x=1", "https://e.com/" + "x" * 150]) == ["a-b-c", "e-com", "é", "x" * 100]
    assert values(spark, urls.is_file, ["https://e.com/a.PNG", "https://e.com/a", "https://e.com/a.html"]) == [True, False, False]
    assert values(spark, urls.url_score, ["https://e.com/blog/2024/01/x", "https://e.com/tag/x", "https://e.com/", "https://e.com/post/x?page=2"]) == [30, -30, -20, 3]
    assert values(spark, lambda u: urls.crawlable(u, ["e.com"], True), ["https://a.e.com/x", "https://e.org/x", "ftp://e.com/x", "https://e.com/x.css"]) == [True, False, False, False]


def test_texts(spark):
    assert [values(spark, lambda u, n=n: texts.reading_time(F.lit(n)), ["x"])[0] for n in (0, 200, 201, 1000)] == [1, 1, 2, 5]
    assert values(spark, texts.raw_word_count, ["<p>a b</p>c", "", None]) == [3, 0, 0]


ARTICLE = """<html lang="en"><head><title>Site title</title><meta property="og:title" content="Own title"><meta name="author" content="A. Writer">
<script type="application/ld+json">{"@type": "BlogPosting", "headline": "LD title", "datePublished": "2024-01-15"}</script><link rel="canonical" href="/c"></head><body>
<nav><a href="/n">nav</a></nav><div class="cookie-banner">Accept all cookies</div><article><h1>Head</h1><p>""" + "word, " * 60 + """</p><h2>Two</h2><pre><code class="language-python">x = 1</code></pre>
<ul><li>one<li>two</ul><blockquote>said</blockquote><figure><img src="a.png" alt="A"><figcaption>cap</figcaption></figure><table><tr><th>h</th></tr><tr><td>d</td></tr></table><a href="/x" rel="next">x</a></article><footer>end</footer></body></html>"""


def test_article():
    x = dom.article(ARTICLE, "https://e.com/blog/p")
    assert (x["title"], x["author"], x["published_at"], x["language"], x["canonical_url"]) == ("LD title", "A. Writer", "2024-01-15T00:00:00+00:00", "en", "https://e.com/c")
    assert [b["type"] for b in x["content_blocks"]] == ["heading", "paragraph", "heading", "code", "list", "quote", "image", "table"]
    assert x["content_blocks"][3]["language"] == "python" and x["content_blocks"][4]["items"] == ["one", "two"] and x["content_blocks"][6]["caption"] == "cap"
    assert "# Head" in x["content_markdown"] and "```python\nx = 1\n```" in x["content_markdown"] and "cookies" not in x["content_text"] and "nav" not in x["content_text"]
    assert [k["href"] for k in x["links"]] == ["https://e.com/n", "https://e.com/x"]


def test_classify(spark):
    shells = [
        ("spa", '<html><body><div id="root"></div><script src="/static/js/main.abc1.js"></script></body></html>'), ("wall", "<body>cookie consent: accept all cookies now</body>"),
        ("paid", "<body><p>subscribe to read more</p></body>"), ("full", ARTICLE.replace("word, ", "word word word, ")), ("short", "<title>t</title><body>few words</body>"), ("empty", ""), ("null", None),
    ]
    rows = pages.extract(spark.createDataFrame([(a, f"https://e.com/{a}", h) for a, h in shells], "title string, url string, html string")).select("url", "page_type", "strategy").collect()
    assert [(r["page_type"], r["strategy"]) for r in rows] == [("js_spa", "playwright"), ("cookie_walled", "playwright"), ("paywalled", "playwright"), ("static_html", "static"), ("unknown", "mobile_ua"), ("static_html", "static"), ("static_html", "static")]


@pytest.mark.parametrize("html", [
    "<span>" * 3000 + "x", "<div>" * 3000 + "<p>x y</p>", "<ul><li>a" * 1500, "<blockquote>" * 1500 + "x", '<img src="http://[x">', '<a href="http://[x">l</a>', '<link rel="canonical" href="http://[x">', "<![foo bar]> hi", "<![", "<!DOCTYPE", "<", "", None,
    '<script type="application/ld+json">{"@type": "Article", "headline": "\\ud800 x", "image": 5, "author": [[]], "keywords": [1]}</script>', '<script type="application/ld+json">' + "[" * 100_000 + "</script>",
])
@pytest.mark.parametrize("url", ["https://e.com/p", "http://[bad", None])
def test_no_page_raises(html, url):
    found = dom.article(html, url)
    assert set(found) >= {"title", "content_markdown", "links"} and repr(found).encode()


def test_markdown_keeps_marks():
    tree = dom.parse('<body><a href="/u">L <b>x</b></a><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol><li>1</li></ol></body>')
    assert dom.markdown(tree) == "[L **x**](/u)\n\n- a\n  - b\n- c\n\n1. 1"


def test_head_images_come_first():
    page = '<meta property="og:image" content="/og.png"><meta property="og:image:alt" content="O"><script type="application/ld+json">{"@type": "Article", "image": {"url": "ld.png"}}</script><article><p>' + "w " * 60 + '<img src="in.png"></article>'
    assert [(x["url"], x["alt"]) for x in dom.article(page, "https://e.com/a/")["images"]] == [("https://e.com/a/ld.png", None), ("https://e.com/og.png", "O"), ("https://e.com/a/in.png", None)]


def test_needs_js():
    pages_ = {"": False, "<p>Please enable JavaScript to go on</p>": True, "<noscript>" + "w " * 16 + "</noscript>": True, '<div id="root"></div>': True, '<div id="root">' + "w " * 100 + "</div>": False, '<script src="x"></script>' * 9: True, "<p>short</p>": False}
    assert [dom.needs_js(dom.parse(h)) for h in pages_] == [*pages_.values()]


def test_clashing_columns(spark):
    rows = spark.createDataFrame([("p", 1, "s", "u", "h", "c", "https://e.com/x", ARTICLE)], "page_type string, slug int, strategy string, _url string, _html string, _class string, url string, html string")
    got = pages.extract(rows)
    assert len(set(got.columns)) == len(got.columns) and got.select("page_type", "slug", "_url", "_html", "_class").first() == ("cookie_walled", "x", "u", "h", "c")


def test_parse_date():
    wanted = {"Jan 5 2024": "2024-01-05T00:00:00+00:00", "January 5, 2024 3:04 pm EST": "2024-01-05T15:04:00-05:00", "5 janvier 2024": "2024-01-05T00:00:00+00:00", "3rd of May 2023": "2023-05-03T00:00:00+00:00", "5. März 2024": "2024-03-05T00:00:00+00:00", "1 2 3": None}
    assert {x: dom.parse_date(x) for x in wanted} == wanted
    assert dom.parse_date("Mon, 01 Jan 2024 10:00:00 GMT") == "2024-01-01T10:00:00+00:00"
    assert [dom.parse_date(x) for x in ("1970-01-01", "2150-01-01", "soon", None)] == [None] * 4


def test_dedup_and_slugs(spark):
    long = "x" * 120
    rows = spark.createDataFrame([(1, long), (2, f" {long}\n"), (3, "short"), (4, "short"), (5, None)], "seq int, content_text string")
    assert sorted(r["seq"] for r in articles.dedup(rows).collect()) == [1, 3, 4, 5]
    named = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x-2"), (4, "x")], "seq int, slug string")
    got = [r["slug"] for r in articles.unique_slugs(named).orderBy("seq").collect()]
    assert got == ["x", "x-2", "x-2-2", "x-3"]
    named = spark.createDataFrame([*enumerate(["x", "x", "x-2", "x-2-2", "x-2", "x", "y", "y-7"])], "seq int, slug string")
    assert [r["slug"] for r in articles.unique_slugs(named).orderBy("seq").collect()] == ["x", "x-2", "x-2-2", "x-2-2-2", "x-2-3", "x-3", "y", "y-7"]


def test_slugs_of_repeated_and_missing_orders(spark, tmp_path):
    """Rows of one slug and order used to be joined each with each, and rows without an order kept their slug."""
    rows = [(i, s, "en") for i, s in [(1, "x"), (1, "x"), (2, "x"), (2, "x"), (2, "x"), (None, "x"), (None, "x"), (3, "y"), (None, "z"), (4, "z"), (5, None)]]
    spark.createDataFrame(rows, "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert compare.differences(queries.QUERIES["unique_slugs"](spark, str(tmp_path)), queries.ORACLE_SQL["unique_slugs"], compare.duck(str(tmp_path))) == ""


def test_feeds_and_sitemaps(spark):
    rss = "<rss><channel><item><title>T</title><guid>https://e.com/1</guid></item><item><guid isPermaLink='false'>7</guid></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><link href='/2'/><published>2024</published><author><name>N</name></author></entry></feed>"
    got = feeds.read_feeds(spark.createDataFrame([("https://e.com/f", rss), ("https://e.com/a", atom), ("bad", "<x"), ("none", None)], "feed_url string, xml string")).collect()
    assert sorted((r["url"], r["author"]) for r in got) == [("https://e.com/1", None), ("https://e.com/2", "N")] or len(got) == 2
    site = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>https://e.com/x</loc></url></urlset>"
    assert [(r["url"], r["kind"]) for r in feeds.read_sitemaps(spark.createDataFrame([("s", site)], "sitemap_url string, xml string")).collect()] == [("https://e.com/x", "page")]


def test_depths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y"), ("a", None)], "src string, dst string")
    assert {r["node"]: r["depth"] for r in crawl.depths(edges, ["a"], 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_page_depths(spark, tmp_path):
    link = lambda *to: "".join(f'<a href="{x}">x</a>' for x in to)
    chain = [(f"https://e.com/{i}", link(f"/{i + 1}?utm_source=x#top", "/0" if i else "/1")) for i in range(12)]
    rows = [("https://e.com/root", link("/0")), *chain, ("https://e.org/alone", "<p>no links</p>")]
    spark.createDataFrame([(i, u, f"<html><body>{h}</body></html>") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["node"]: r["depth"] for r in queries.QUERIES["page_depths"](spark, str(tmp_path)).collect()}
    assert got == {"https://e.com/root": 0, "https://e.org/alone": 0} | {f"https://e.com/{i}": i + 1 for i in range(10)}


def test_stream(spark, tmp_path):
    inside, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(2):
        spark.createDataFrame([(i, f"https://e.com/{i}", ARTICLE)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(inside)
        ingest(page_stream(spark, inside), out, str(tmp_path / "check")).awaitTermination()
    assert [r["page_id"] for r in spark.read.parquet(out).collect()] == [0]


def test_fetch_batch_and_feed(spark):
    page = lambda t: f"<title>{t}</title><article><p>" + "word " * 60 + "</article>"
    got = spark.createDataFrame([("https://e.com/1", 200, "text/html", page("one")), ("https://e.com/2", 404, "text/html", ""), ("https://e.com/3", 200, "image/png", ""), ("https://e.com/1", 500, None, "x"), (None, 200, None, page("none"))], "url string, status int, content_type string, html string")
    asked = spark.createDataFrame([(0, "https://e.com/2"), (1, "https://e.com/1"), (2, "ftp://e.com/1"), (3, None), (4, "https://e.com/9"), (5, "https://e.com/1"), (6, "https://e.com/3")], "idx int, url string")
    assert [(r.idx, r.title) for r in fetching.fetch_batch(asked, got).collect()] == [(1, "one"), (5, "one")]
    kept = fetching.fetch_batch(asked, got, "include").collect()
    assert [r.error for r in kept] == ["http_status_404", None, "only http and https can be fetched", "only http and https can be fetched", "no response", None, "not_html"] and kept[0].title is None
    with pytest.raises(Exception, match="http_status_404"):
        fetching.fetch_batch(asked, got, "raise").collect()
    with pytest.raises(ValueError, match="on_error"):
        fetching.fetch_batch(asked, got, "ignore")
    rss = "<rss><channel>" + "".join(f"<item><link>https://e.com/{i}</link></item>" for i in (2, 1, 1)) + "</channel></rss>"
    feed = spark.createDataFrame([("https://e.com/f", rss)], "feed_url string, xml string")
    assert [(r.pos, r.title) for r in fetching.fetch_feed(feed, got).collect()] == [(1, "one"), (2, "one")] and fetching.fetch_feed(feed, got, 1).count() == 0


def odd_pages(spark, tmp_path, name):
    """What the query and its SQL make of repeated addresses and of references that a cut has left without their end."""
    page = lambda i, t: f'<!DOCTYPE html><html lang="en"><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{t} {i}</article></body></html>'
    rows = [(i, f"https://e.com/{i // 3}", page(i, t)) for i, t in enumerate(["one &amp;&amp", "two", "three &copy", "R&amp;D &am", "&quot;x&quot; &quot", "&amp &amp;", "last", "&ampx;", "more", "&copy;", "end"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return compare.differences(queries.QUERIES[name](spark, str(tmp_path)), queries.ORACLE_SQL[name], compare.duck(str(tmp_path)))


def test_every_request_has_its_own_response(spark, tmp_path):
    assert odd_pages(spark, tmp_path, "fetch_batch") == ""


def test_cut_off_references_in_blocks(spark, tmp_path):
    assert odd_pages(spark, tmp_path, "page_blocks") == ""


def test_cut_off_references_in_metadata(spark, tmp_path):
    assert odd_pages(spark, tmp_path, "page_metadata") == ""
    tree = dom.parse('<a href="?a=1&copy=2&amp;b=3">&#65;&nbspx</a><script>a &lt b && c</script>')
    assert [(x.get("href"), x.kids) for x in tree.kids] == [("?a=1&copy=2&b=3", ["A&nbspx"]), ("", ["a &lt b && c"])]


def test_adaptive_chain(spark):
    many = lambda n: f"<title>t</title><body><p>{'word ' * n}</p></body>"
    spa = '<html><body><div id="root"></div><script src="/static/js/main.abc1.js"></script></body></html>'
    amp = '<html amp><head><title>t</title><link rel="amphtml" href="/amp"></head><body>' + "word " * 20 + "</body></html>"
    rows = [("full", many(200), None, None), ("spa", spa, "rendered", many(50)), ("spa2", spa, "rendered", None), ("amp", amp, "amp", many(90)), ("mobile", many(20), "mobile", many(40)), ("thin", many(20), "rendered", many(40)), ("poor", many(20), "mobile", many(21)), (None, None, None, None)]
    own = spark.createDataFrame([(u, h) for u, h, _, _ in rows], "url string, html string")
    other = spark.createDataFrame([(u, k, h) for u, _, k, h in rows if k], "url string, kind string, html string")
    assert {r.url: r.strategy_used for r in fetching.adaptive(own, other).collect()} == {"full": "static", "spa": "playwright", "spa2": "static_best_effort", "amp": "amp", "mobile": "mobile_ua", "thin": "playwright_fallback", "poor": "static_best_effort", None: "static_best_effort"}


def test_transport():
    import gzip
    import io
    import zlib
    from email.message import Message
    from urllib.error import HTTPError

    assert [transport.retry_delay(2), transport.retry_delay(0, "7"), transport.retry_delay(3, "soon", 0.5)] == [4, 7, 8.5]
    assert transport.decoded(gzip.compress("é".encode()), "gzip", "text/html") == transport.decoded(zlib.compress("é".encode()), "deflate") == transport.decoded("é".encode("latin-1"), None, "text/html; charset=ISO-8859-1") == "é"
    assert transport.decoded(b"\xff", None, "text/html; charset=none-such") == "�"
    asked, waits = [], []

    class Answer(io.BytesIO):
        headers = Message()

    def opened(request, timeout):
        asked.append(request.full_url)
        if len(asked) < 3:
            raise HTTPError(request.full_url, 503, "busy", Message(), None)
        return Answer(b"<p>hi")

    def missing(request, timeout):
        raise HTTPError(request.full_url, 404, "none", Message(), None)

    assert transport.http("https://e.com/", opened=opened, sleep=waits.append) == "<p>hi" and len(asked) == 3 and 1 <= waits[0] < 2 <= waits[1] < 3
    for url, status in (("ftp://e.com/", 0), ("https://e.com/", 404)):
        with pytest.raises(transport.FetchError) as e:
            transport.http(url, opened=missing)
        assert e.value.status == status


def test_fetch_pages(spark):
    def answer(url):
        if "bad" in url:
            raise ValueError("no")
        return "<p>" + url

    rows = transport.fetch_pages(spark.createDataFrame([(1, "https://a.com/x"), (2, "https://bad.com/"), (3, None)], "n int, url string"), answer).collect()
    assert sorted((r.n, r.html, r.status, r.error) for r in rows) == [(1, "<p>https://a.com/x", 200, None), (2, None, 0, "ValueError: no"), (3, None, 0, "no address")]


def site(spark):
    def body(i, links):
        text = "".join(f"<p>{'some words of text number ' * 12}{i}</p>" for _ in range(4))
        return f"<html><head><title>Page {i}</title></head><body><article><h1>T</h1>{text}" + "".join(f'<a href="{x}">l</a>' for x in links) + "</article></body></html>"

    pages_ = {
        "https://e.com/": (200, ["/blog/a", "/blog/b?utm_source=x", "https://other.org/", "/x.png", "/wp-admin/z", "mailto:a@b"]), "https://e.com/blog/a": (200, ["/", "/blog/b", "/blog/c"]), "https://e.com/blog/b": (200, ["/blog/a", "/blog/d"]),
        "https://e.com/blog/c": (404, []), "https://e.com/blog/d": (200, ["/blog/e"]), "https://e.com/blog/e": (200, []),
    }
    return spark.createDataFrame([(u, s, "text/html", body(i, ls)) for i, (u, (s, ls)) in enumerate(pages_.items())], "url string, status int, content_type string, html string")


def test_crawl(spark):
    done = crawl.crawl(site(spark), ["https://e.com/"], max_depth=2, least=-100)
    assert {(r.url, r.depth) for r in done.articles.collect()} == {("https://e.com/", 0), ("https://e.com/blog/a", 1), ("https://e.com/blog/b?utm_source=x", 1), ("https://e.com/blog/d", 2)}
    assert {(r.url, r.reason) for r in done.skipped.collect()} == {("https://e.com/blog/c", "http_status_404")} and done.seen.count() == 5
    few = crawl.crawl(site(spark), ["https://e.com/"], max_pages=1, least=-100)
    assert {r.norm_url for r in few.seen.collect()} == {"https://e.com/", "https://e.com/blog/a"}
    again = crawl.crawl(site(spark), ["https://e.com/"], seen=done.seen, least=-100)
    assert {r.url for r in again.articles.collect()} == {"https://e.com/"}


def test_command_line_and_sinks(spark, tmp_path):
    site(spark).write.parquet(str(tmp_path / "r"))
    out = str(tmp_path / "out")
    argv = ["--url", "https://e.com/", "--responses", str(tmp_path / "r"), "--out", out, "--min-score", "-100", "--files"]
    assert cli.main(argv) == 0 and cli.main([*argv, "--include-regex", "["]) == 1
    index, skipped = sinks.read_index(spark, f"{out}/index.json"), sinks.read_skipped(spark, f"{out}/skipped")
    assert index.count() == 5 and [r.reason for r in skipped.collect()] == ["http_status_404"]
    assert len([*(tmp_path / "out" / "files").glob("*.json")]) == 5 == len([*(tmp_path / "out" / "files").glob("*.md")])
    assert spark.read.csv(f"{out}/index.csv", header=True).count() == 5
    assert sinks.read_seen(spark, f"{out}/seen_urls", f"{out}/index.json").count() == 6 and sinks.read_index(spark, f"{out}/none").count() == 0
    assert cli.domain_set(["https://E.com/x"], " a.org , ") == ["a.org", "e.com"] and "By method" in cli.summary(index, skipped)


def test_sql_functions(spark):
    register(spark)
    page = "<body><h1>A</h1><p>b c</p><a href=\"/x\">y</a></body>"
    spark.createDataFrame([(page,)], "h string").createOrReplaceTempView("own_pages")
    got = spark.sql("select html_text(h, 'https://e.com/') as t, size(html_links(h, 'https://e.com/')) as n, html_markdown(h, '') as m, size(html_blocks(h, '')) as b, reading_minutes(201) as r, content_digest(' x ') as d, raw_words(h) as w from own_pages").first()
    assert (got.t, got.n, got.m, got.b, got.r, got.w, len(got.d)) == ("A b c y", 1, "# A\n\nb c\n\n[y](/x)", 2, 2, 4, 16)
    assert [r.url for r in spark.sql("select url from parse_feed('<rss><channel><item><link>u</link></item></channel></rss>', '')").collect()] == ["u"]


def test_cache(spark):
    rows = spark.createDataFrame([("a", "2024-01-02 00:00:00", 200, "new"), ("a", "2024-01-01 12:00:00", 200, "old"), ("b", "2024-01-02 00:00:00", 500, "x"), ("c", "2023-12-01 00:00:00", 200, "x")], "url string, fetched_at string, status int, html string")
    assert [(r.url, r.html) for r in sinks.read_cache(rows.withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), now="2024-01-02 06:00:00").collect()] == [("a", "new")]


def test_stored_tables_go(spark):
    kept = stored(spark.range(5))
    path = kept._pagewright_path.removeprefix("file:")
    assert kept.count() == 5 and os.path.isdir(path)
    release(kept)
    release(spark.range(1))
    assert not os.path.exists(path)
