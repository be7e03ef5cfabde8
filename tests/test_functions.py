"""Literal cases of URL, text, mail, robots and listing functions.

Fixed values: listing lines, robots bodies, addresses and links of the cases are
given formats, and must be read as they stand.
"""

import pytest
from pyspark.sql import functions as F

from weft.functions import scalars, urls
from weft.operators import extract, joins, report, robots, rules
from weft.sources import scans


def one(spark, expression, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return frame.select(expression.alias("x")).first().x


@pytest.mark.parametrize("base, url, want", [
    ("http://localhost:8001/tests/checker/data/http.html", "http://foo", "http://foo"),
    ("http://localhost:8001/test", ";param=value", "http://localhost:8001/;param=value"),
    ("file:///a/b.html", "?c=d", "file:///a/b.html?c=d"),
    ("http://example.org/test?a=b&c=d", "#usemap", "http://example.org/test?a=b&c=d#usemap"),
    ("http://h/a/b/c.html", "../x", "http://h/a/x"),
    ("http://h/a", "//other/x", "http://other/x"),
    ("http://h", "x", "http://h/x"),
])
def test_join(spark, base, url, want):
    assert one(spark, urls.join(F.col("b"), F.col("u")), b=base, u=url) == want


@pytest.mark.parametrize("path, want", [("/a/./b", "/a/b"), ("/a/../b", "/b"), ("/../b", "/b"), ("//a//b/", "/a/b/"), ("/a/b/..", "/a/"), ("\\a\\b", "/a/b"), ("", ""), ("/", "/"), ("./a", "a")])
def test_collapse(spark, path, want):
    assert one(spark, urls.collapse_path(F.col("p")), p=path) == want


@pytest.mark.parametrize("url, want", [
    ("HTTP://EXAMPLE.org:80/a/../b", "http://example.org/b"), ("http://h.?q=1", "http://h/?q=1"), ("http://h/a b", "http://h/a%20b"), ("http://h/?a=&b", "http://h/?a=&b"),
    ("http://h/für", "http://h/f%C3%BCr"), ("http://h:99/x#", "http://h:99/x#"),
])
def test_normalise(spark, url, want):
    assert one(spark, urls.normalise(F.col("u")), u=url) == want
    assert one(spark, urls.normalise(urls.normalise(F.col("u"))), u=url) == want


def test_small_url_functions(spark):
    assert one(spark, urls.guess(F.lit("www.x.org"))) == "http://www.x.org"
    assert one(spark, urls.fix_typos(F.lit("http//x"))) == "http://x"
    assert one(spark, urls.scheme_class(F.lit("skype:x"))) == "ignored"
    assert one(spark, urls.scheme_class(F.lit("nosuch:x"))) == "unknown"
    assert one(spark, urls.intern_pattern(F.lit("http://example.org/foo/"))).endswith("/")
    assert one(spark, urls.mail_key(F.array(F.lit("b@x"), F.lit("a@x")))) == "mailto:a@x,b@x"
    assert one(spark, urls.base_of(F.lit("http://h/p/q.html"), F.lit("base/"))) == "http://h/p/base/"
    assert one(spark, urls.file_url(F.lit("a"), "/w", F.lit(True))) == "file:///w/a/"
    assert one(spark, urls.unsplit(F.lit("http"), F.lit("h"), F.lit(80), F.lit("/x"))) == "http://h/x"
    assert one(spark, urls.port(F.lit("http://h:70000/"))) == 80


@pytest.mark.parametrize("html, want", [
    ('<a href=" alink ">', [" alink "]), ('<img srcset="imagesmall.jpg 1x">', ["imagesmall.jpg"]), ('<div itemtype="http://example.org/Movie">', ["http://example.org/Movie"]),
    ('<form action="alink">', ["alink"]), ('<form action="alink" method="POST">', []), ('<a style="x: url( \'alink\' )">', ["alink"]), ('<a href="bla/a=b&quot;">', ['bla/a=b"']),
    ('<a href\n=\n"file.html">', ["file.html"]), ('<object archive="file.html,http://www.example.com">', ["file.html", "http://www.example.com"]),
    ('<link rel="dns-prefetch" href="//www.example.org">', ["dns://www.example.org"]), ("<!-- <a href=http://nocheckin> -->", []), ('<meta http-equiv="refresh" content="5; url=http://www.example.com/">', ["http://www.example.com/"]),
    ("<script>var t=\"<a href='x'>\"</script>", []),
])
def test_links(spark, html, want):
    pages = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert [r.raw_url for r in extract.links(pages).orderBy("seq", "pos").collect()] == want


def test_scans(spark):
    files = spark.createDataFrame([("f", "# no\n\n http://a \n  # b\njavascript:x")], "url string, body string")
    assert [(r.line, r.raw_url) for r in scans.url_list(files).collect()] == [(3, "http://a"), (5, "javascript:x")]
    css = spark.createDataFrame([("f", "a{x:url('p')}\n/* url(q) */ b{y:url(r)}")], "url string, body string")
    assert [(r.line, r.raw_url) for r in scans.css(css).collect()] == [(1, "p"), (2, "r")]
    xml = spark.createDataFrame([("f", '<urlset xmlns="http://s"><url><loc> http://www.example.com/ </loc></url></urlset>')], "url string, body string")
    assert [r.raw_url for r in scans.sitemap(xml).collect()] == ["http://www.example.com/"]
    marks = spark.createDataFrame([('{"roots":{"bar":{"type":"folder","children":[{"type":"url","url":"u1","name":"n1"},{"type":"folder","children":[{"type":"url","url":"u2","name":"n2"}]}]}}}',)], "body string")
    assert sorted((r.url, r.name) for r in scans.bookmark_json(marks).collect()) == [("u1", "n1"), ("u2", "n2")]
    opera = spark.createDataFrame([("f", "NAME=a\nURL=u\nX\nURL=v")], "path string, body string")
    assert [(r.url, r.name) for r in scans.bookmark_text(opera).collect()] == [("u", "a")]
    md = spark.createDataFrame([("f", 'see <http://a.b> and [t](/u "title")\n[id]: http://c.d\n')], "url string, body string")
    assert [r.raw_url for r in scans.markdown(md).orderBy("n").collect()] == ["http://a.b", "/u", "http://c.d"]


@pytest.mark.parametrize("line, want", [
    ("+i8388621.29609,m824255902,/,\tdev", ("dev", True, False)), ("+i8388621.44468,m839956783,r,s10376,\tRFCEPLF", ("RFCEPLF", False, True)),
    ("-rw-r--r--   1 root     other        531 Jan 29 03:26 README", ("README", False, True)), ("dr-xr-xr-x   2 root     other        512 Apr  8  1994 etc", ("etc", True, False)),
    ("lrwxrwxrwx   1 root     other          7 Jan 25 00:17 bin -> usr/bin", ("usr/bin", True, True)), ("04-27-00  09:09PM       <DIR>          licensed", ("licensed", True, False)), ("total 12", None),
])
def test_listing(spark, line, want):
    got = scans.ftp_listing(spark.createDataFrame([(line,)], "line string")).collect()
    assert [(r.name, r.trycwd, r.tryretr) for r in got] == ([want] if want else [])


@pytest.mark.parametrize("mail", ["@", "@example.org", "a@", "a" * 65 + "@example.com", "a@" + "b" * 64 + ".com", '"a""@example.com', ".a@example.com", "a.@example.com", "a..b@example.com", "a@a_b.com", "a@example.com.", "a@example.com.111", "a@example..com"])
def test_bad_mail(spark, mail):
    assert one(spark, rules.mail_error(F.col("m")), m=mail) is not None


def test_good_mail_and_addresses(spark):
    assert one(spark, rules.mail_error(F.lit("a.b@example.com"))) is None
    assert one(spark, scalars.mail_addresses(F.lit("mailto:x%40y.org?cc=A%20%3Cb@c.de%3E&subject=s"))) == ["b@c.de", "x@y.org"]


@pytest.mark.parametrize("body, agent, path, want", [
    ("User-agent: *\nDisallow: /cyberworld/map/ # x\nDisallow: /tmp/\nDisallow: /foo.html\n", "a", "/test.html", True), ("User-agent: *\nDisallow: /tmp/\n", "a", "/tmp/x", False), ("User-agent: *\nDisallow: /tmp/\n", "a", "/tmp", True),
    ("User-agent: *\nDisallow: /c/\n\nUser-agent: cybermapper\nDisallow:\n", "cybermapper", "/c/i.html", True), ("User-agent: figtree\nDisallow: /%7ejoe/index.html\n", "FigTree/1.0 Robot", "/~joe/index.html", False),
])
def test_robots(spark, body, agent, path, want):
    table = spark.createDataFrame([("o", 200, body)], "origin string, status int, body string")
    wanted = spark.createDataFrame([("o", path, "u")], "origin string, path string, url string")
    assert robots.allowed(wanted, robots.rules(table), table, agent).first().allowed is want


def test_addresses(spark):
    assert one(spark, scalars.is_ipv6(F.lit("::1"))) and one(spark, scalars.is_ipv6(F.lit("1:2:3:4:5:6:7:8"))) and not one(spark, scalars.is_ipv6(F.lit("1:2")))
    assert one(spark, scalars.expand_ipv6(F.lit("1::2"))) == "1:0:0:0:0:0:0:2"
    assert one(spark, scalars.ip_text(scalars.ip_number(F.lit("1.2.3.4")))) == "1.2.3.4"
    assert one(spark, scalars.obfuscated_ip(F.lit("127.0.0.1"))) == "0x7f001"
    assert one(spark, scalars.cidr_mask(F.lit(24))) == 0xFFFFFF00
    assert one(spark, scalars.human_size(F.lit(1536))) == "1KB" and one(spark, scalars.human_duration(F.lit(61.5))) == "01:02"


def test_streak_merge_and_redirect_loop(spark):
    before = spark.createDataFrame([(1, 2), (2, 5)], "k long, failures int")
    checks = spark.createDataFrame([(1, 1, False), (2, 1, False), (2, 2, True), (2, 3, False), (3, 1, True)], "k long, t long, valid boolean")
    assert {r.k: r.failures for r in report.merged_streaks(before, checks, ["k"], ["t"]).collect()} == {1: 3, 2: 1}
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "from_url string, to_url string")
    got = {r.from_url: (r.final_url, r.hops, r.loop) for r in joins.redirect_ends(hops).collect()}
    assert got["a"] == ("c", 2, False) and got["b"] == ("c", 1, False) and got["x"][2] and got["y"][2]


def test_tls_and_headers(spark):
    frame = spark.createDataFrame([("Jun  9 10:00:00 2026 GMT",)], "t string")
    at = F.lit("2026-06-01 00:00:00").cast("timestamp")
    assert frame.select(rules.tls_rule(F.col("t"), at).tag.alias("x")).first().x == "ssl-certificate-expires"
    fetched = spark.createDataFrame([("u", {"refresh": "5;url=X", "content-location": "Y", "link": '</a>; rel="prev", </b>; rel=next'})], "url string, headers map<string,string>")
    assert sorted((r.raw_url, r.name) for r in scans.header_links(fetched).collect()) == [("/a", "Link: header prev"), ("/b", "Link: header next"), ("X", "Refresh: header"), ("Y", "Content-Location: header")]
    assert fetched.select(rules.header_info(F.col("headers"), ("Ref",)).alias("x")).first().x == ["refresh=5;url=X"]
