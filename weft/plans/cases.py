"""Queries that plant known cases into the pages' rows: page p gets case p modulo their number.

Fixed values: inputs such as listing lines, robots bodies and addresses are given
formats.  Expected values are written by hand from the stated rules, and are what the SQL
returns; the Spark side computes them with the library's functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, urls
from ..operators import extract, robots, rules
from ..sources import scans

AS_OF = "2026-06-01 00:00:00"


def _tag(rule: Column) -> Column:
    return rule.getField("tag")


def _tags(found: list[Column]) -> Column:
    return F.array_join(F.transform(rules.warnings(*found), lambda x: x.tag), ",")


def _flag(value: Column) -> Column:
    return F.when(value, "yes").otherwise("no")


_SECONDS = lambda x: x.try_cast("double")
_LONG = lambda x: x.try_cast("long")

#: By query: a function of text columns, and (inputs..., expected) for each case; None is null.
SCALARS: dict[str, tuple[Callable[..., Column], list[tuple]]] = {
    "u2_normal_forms": (urls.normalise, [
        ("HTTP://EXAMPLE.org:80/a/../b", "http://example.org/b"), ("http://h.?q=1", "http://h/?q=1"), ("http://h/a b", "http://h/a%20b"), ("http://h/?a=&b", "http://h/?a=&b"),
        ("http://h/für", "http://h/f%C3%BCr"), ("http://h:99/x#", "http://h:99/x#"), ("https://h:443/", "https://h/"), ("http://h/%7ejoe/%2e", "http://h/~joe/"), ("http://h/a//b/./c", "http://h/a/b/c"),
        ("http://h/?q=%zz+x", "http://h/?q=%25zz%20x"), ("http://h/x?a=1?b=2", "http://h/x?a=1?b=2"), ("http://%65xample.org/", "http://example.org/"), ("http://h\\a/b", "http://h/a/b"),
        ("ftp://u:p@H.x:21/f", "ftp://u:p@h.x/f"), ("mailto:a@b.c", "mailto:a@b.c"), ("http://h#f", "http://h/#f"), ("http://h", "http://h"),
    ]),
    "u7_rejoined_queries": (urls.rejoin_query, [
        ("a=1&b=2", "a=1&b=2"), ("a;b=&c", "a;b=&c"), ("q=a b", "q=a%20b"), ("q=a+b", "q=a%20b"), ("x=/y:z,w", "x=/y:z,w"), ("x=%26", "x=%26"), ("a=b=c", "a=b%3Dc"), ("a=1?b=2?c d=3", "a=1?b=2?c%20d=3"), ("?a", "?a"), ("", ""),
    ]),
    "u9_unquoted": (urls.unquote, [("%41%42", "AB"), ("a+b", "a+b"), ("%C3%BC", "ü"), ("%zz", "%zz"), ("100%", "100%"), ("%zz%41", "%zzA"), ("", ""), ("%2541", "%41")]),
    "u11_joined": (urls.join, [
        ("http://localhost:8001/tests/checker/data/http.html", "http://foo", "http://foo"), ("http://localhost:8001/test", ";param=value", "http://localhost:8001/;param=value"), ("http://example.org/test?a=b&c=d", "#usemap", "http://example.org/test?a=b&c=d#usemap"),
        ("http://h/a/b/c.html", "../x", "http://h/a/x"), ("http://h/a", "//other/x", "http://other/x"), ("http://h", "x", "http://h/x"), ("http://h/a?b", "?c", "http://h/a?c"), ("http://h/a/b", "", "http://h/a/b"), ("http://h/a", "mailto:x@y", "mailto:x@y"),
    ]),
    "u12_bases": (urls.base_of, [("http://h/p/q.html", "base/", "http://h/p/base/"), ("http://h/p#f", None, "http://h/p"), ("http://h/p", "", "http://h/p"), ("http://h/p", "http://o/", "http://o/"), ("http://h/p/q", "/r/", "http://h/r/")]),
    "u16_guessed": (lambda x: urls.fix_typos(urls.guess(x)), [("www.x.org", "http://www.x.org"), ("WWW.x", "http://WWW.x"), ("ftp.x.org", "ftp://ftp.x.org"), ("http//x", "http://x"), ("https//x", "https://x"), ("x.org", "x.org"), ("http://x", "http://x")]),
    "u18_scheme_classes": (urls.scheme_class, [
        ("http://x", "http"), ("HTTPS://x", "http"), ("ftp://x", "ftp"), ("file:///x", "file"), ("telnet://x", "telnet"), ("mailto:x", "mailto"), ("nntp://x", "nntp"), ("news:x", "nntp"), ("dns:x", "dns"), ("itms-services://x", "itms-services"),
        ("skype:x", "ignored"), ("irc://x", "ignored"), ("steam://x", "ignored"), ("feed:x", "ignored"), ("javascript:x", "ignored"), ("nosuch:x", "unknown"), ("LDAPS://h", "ignored"), ("jar:x", "ignored"), ("isbn:1", "ignored"), ("fax:1", "ignored"), ("ms-help://x", "ignored"), ("smtp://h", "ignored"), ("z39.50://h", "ignored"), ("snews:x", "nntp"), ("x", "unknown"),
    ]),
    "u20_quoting": (lambda x: _flag(urls.needs_quoting(x)), [("http://h/a", "no"), ("http://h/a ", "yes"), ("http://h/a b", "yes"), ("http://h/ü", "yes"), ("a?b=c&d#e", "no"), ("a\\b", "yes"), ("a|b", "yes")]),
    "u21_safe_parts": (lambda kind, x: _flag(F.reduce(F.array(*[(kind == k) & urls.is_safe(x, k) for k in urls.SAFE]), F.lit(False), lambda a, b: a | b)), [
        ("domain", "example.org", "yes"), ("domain", "a_b.org", "no"), ("domain", "b" * 63 + ".org", "no"), ("domain", "b" * 62 + ".org", "yes"), ("domain", "a..b", "no"), ("host", "h:8080", "yes"), ("host", "h:81", "no"),
        ("path", "/a/b%20c", "yes"), ("path", "/a b", "no"), ("fragment", "x(1)", "yes"), ("fragment", "<", "no"), ("query", "a=1&b=2", "yes"), ("query", "a=<", "no"), ("parameter", "a=1;b", "yes"), ("url", "http://h/a#b", "yes"), ("url", "gopher://h/", "no"), ("char", "~", "yes"),
    ]),
    "u22_listed_hosts": (lambda x: _flag(urls.in_domains(x, [".example.org", "example.com"])), [("www.example.org", "yes"), ("example.org", "no"), ("example.com", "yes"), ("www.example.com", "no"), ("badexample.org", "no"), ("", "no")]),
    "u24_intern_patterns": (urls.intern_pattern, [
        ("http://example.org/foo/", "^https?://(www\\.)?example\\.org/foo/"), ("https://www.Example.org", "^https?://(www\\.)?example\\.org/"), ("http://h/a/b.html", "^https?://(www\\.)?h/a/"), ("http://h/a-b/;p=1", "^https?://(www\\.)?h/a\\-b/"), ("http://h:80/?q", "^https?://(www\\.)?h\\:80/"),
    ]),
    "u26_unsplit": (lambda s, h, p, d: urls.unsplit(s, h, p.try_cast("int"), d), [("http", "h", "80", "/x", "http://h/x"), ("http", "h", "81", "/x", "http://h:81/x"), ("https", "h", "443", "/", "https://h/"), ("ftp", "h", None, "/", "ftp://h/"), ("https", "h", "80", "/", "https://h:80/")]),
    "u27_for_export": (urls.for_export, [("http://h/a b?x=1&y=#f g", "http://h/a%20b?x=1&y#f%20g"), ("a b?c=d", "a%20b?c=d"), ("http://h/ü", "http://h/%C3%BC"), ("mailto:a@b", "mailto:a%40b"), ("x/y=z,w", "x/y=z,w")]),
    "u28_below_webroot": (lambda x: urls.below_webroot(x, "/var/www/"), [("/a", "/var/www/a"), ("a", "a"), ("//h/a", "//h/a"), ("http://h/", "http://h/"), ("/", "/var/www/")]),
    "u29_file_urls": (lambda x, d: urls.file_url(x, "/w", d == "d"), [("a", "d", "file:///w/a/"), ("/a/b", "f", "file:///a/b"), ("../x", "f", "file:///x"), ("/a/", "d", "file:///a/"), ("a/./b", "f", "file:///w/a/b")]),
    "x2_ipv6": (lambda x: _flag(scalars.is_ipv6(x)), [("::1", "yes"), ("1:2:3:4:5:6:7:8", "yes"), ("1:2", "no"), ("::ffff:1.2.3.4", "yes"), ("1::2", "yes"), ("::", "yes"), ("1:2:3:4:5:6:7:8:9", "no"), ("g::", "no"), ("FE80::1", "yes")]),
    "x3_expanded_ipv6": (scalars.expand_ipv6, [("1::2", "1:0:0:0:0:0:0:2"), ("::1", "0:0:0:0:0:0:0:1"), ("1::", "1:0:0:0:0:0:0:0"), ("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8"), ("1:2::7:8", "1:2:0:0:0:0:7:8")]),
    "x4_obfuscated_ips": (lambda x: F.when(scalars.is_ipv4(x), scalars.obfuscated_ip(x)).otherwise(_flag(scalars.is_obfuscated_ip(x))), [("127.0.0.1", "0x7f001"), ("192.168.10.255", "0xc0a8aff"), ("0x7f000001", "yes"), ("2130706433", "yes"), ("example", "no"), ("0xzz", "no")]),
    "x5_masks": (lambda bits, ip: F.concat_ws(" ", scalars.ip_text(scalars.cidr_mask(_LONG(bits))), scalars.ip_text(scalars.ip_number(ip))), [("24", "1.2.3.4", "255.255.255.0 1.2.3.4"), ("0", "0.0.0.0", "0.0.0.0 0.0.0.0"), ("32", "255.255.255.255", "255.255.255.255 255.255.255.255"), ("9", "10.0.0.1", "255.128.0.0 10.0.0.1")]),
    "x6_unquoted": (lambda x: F.concat_ws(" ", scalars.unquoted(x), scalars.unquoted(x, True)), [("'a'", "a a"), ('"a"', "a a"), ("'a", "a 'a"), ("a\"", 'a a"'), ("'a\"", "a 'a\""), ("a", "a a"), ("''", " ")]),
    "x7_without_markup": (scalars.without_markup, [("a<b>c</b>d", "acd"), ("<a\nb>x", "x"), ("a < b", "a < b"), ("", "")]),
    "x8_entities": (scalars.resolved, [
        ("a&amp;b", "a&b"), ("&lt;&gt;&quot;", "<>\""), ("&#38;&#x26;&#X26;", "&&&"), ("&eacute;&Eacute;", "éÉ"), ("&nosuch;x", "x"), ("&#99999999999;x", "x"), ("&#xD800;x", "x"), ("a & b; c", "a & b; c"), ("&amp;lt;", "&lt;"), ("&euro;5 &ndash; &#8364;", "€5 – €"), ("&#128512;", "😀"), ("&", "&"), ("plain", "plain"), ("&#xyz;", ""),
    ]),
    "x9_without_comments": (lambda x: scalars.without_controls(scalars.without_comments(x)), [("a/* */b/* */c", "abc"), ("a/*\n*/b", "ab"), ("'/* x */'", "''"), ("a/*b", "a/*b"), ("a\x01\x1fb\x7f", "ab"), ("a\tb", "ab")]),
    "x12_sizes": (lambda x: scalars.human_size(_LONG(x)), [("0", "0B"), ("1023", "1023B"), ("1024", "1KB"), ("1536", "1KB"), ("10239", "9KB"), ("10240", "10.00KB"), ("15360", "15.00KB"), ("1048575", "1024.00KB"), ("1048576", "1.00MB"), ("10485760", "10.0MB"), ("1073741824", "1.00GB"), ("10737418240", "10.0GB"), ("1610612736", "1.50GB")]),
    "x13_durations": (lambda x: F.concat_ws(" | ", scalars.human_duration(_SECONDS(x)), scalars.long_duration(_SECONDS(x))), [
        ("0", "00:00 | 0.00 seconds"), ("0.5", "00:01 | 0.50 seconds"), ("1", "00:01 | 1 second"), ("61.5", "01:02 | 1 minute, 1 second"), ("3600", "01:00:00 | 1 hour"), ("3661", "01:01:01 | 1 hour, 1 minute"), ("-5", "-00:05 | -5 seconds"),
        ("86400", "24:00:00 | 1 day"), ("90061", "25:01:01 | 1 day, 1 hour, 1 minute"), ("31536001", "8760:00:01 | 1 year, 1 second"), ("120", "02:00 | 2 minutes"),
    ]),
    "x20_modified": (lambda x: F.concat_ws(" | ", scalars.modified(F.to_timestamp(x)), scalars.modified(F.to_timestamp(x), "T")), [("2014-02-03 04:05:06.789", "2014-02-03 04:05:06.789000Z | 2014-02-03T04:05:06.789000Z"), ("1970-01-01 00:00:00", "1970-01-01 00:00:00.000000Z | 1970-01-01T00:00:00.000000Z"), (None, "")]),
    "x21_tls_times": (lambda x: F.date_format(scalars.tls_time(x), "yyyy-MM-dd HH:mm:ss"), [
        ("20260609100000Z", "2026-06-09 10:00:00"), ("20260609100000+0230", "2026-06-09 07:30:00"), ("20260609100000-0100", "2026-06-09 11:00:00"), ("Jun  9 10:00:00 2026 GMT", "2026-06-09 10:00:00"), ("Dec 31 23:59:59 1999 GMT", "1999-12-31 23:59:59"), ("soon", None), (None, None),
    ]),
    "x22_mail_lists": (lambda x: F.array_join(scalars.mail_addresses(x), " "), [
        ("mailto:a@b.c", "a@b.c"), ("mailto:a@b.c,d@e.f", "a@b.c d@e.f"), ("mailto:?to=a@b&cc=c@d&bcc=e@f&subject=x", "a@b c@d e@f"), ("mailto:x%40y.org?cc=A%20%3Cb@c.de%3E", "b@c.de x@y.org"), ("mailto:a@b,a@b", "a@b"), ('mailto:"a,b"@c.d,e@f', '"a,b"@c.d e@f'), ("mailto:", ""),
    ]),
    "f1_url_errors": (rules.url_error, [
        ("", "URL is empty"), ("  ", "URL is empty"), ("http://h/", None), ("nosuch:x", "URL is unrecognized"), ("skype:x", None), ("http:///x", "URL has empty hostname"), ("ftp://", "URL has empty hostname"), ("http://h:99999/", "URL has invalid port"), ("http://h:x/", "URL has invalid port"), ("https://h:80/", None), ("mailto:a@b", None),
    ]),
    "f3_url_warnings": (lambda x: _tags(rules.url_rules(x, F.regexp_replace(x, r"^\s+|\s+$", ""))), [
        ("http://h/", ""), (" http://h/", "url-whitespace"), ("http://h/\n", "url-whitespace"), ("http://H/", "url-effective-url"), ("http://h/a b ", "url-whitespace,url-effective-url"), ("http://www.example.org/" + "a" * 2047, "url-too-long"), ("data:" + "a" * 3000, ""),
        ("http://0x7f000001/", "url-obfuscated-ip"), ("https://0x7f000001/", ""), ("http://3232235777/", "url-obfuscated-ip"),
    ]),
    "f7_sizes": (lambda x: _tags(rules.size_rules(_LONG(x))), [("0", "url-content-size-zero"), ("1", ""), ("5242880", ""), ("5242881", "url-content-too-large"), (None, "")]),
    "f8_verdicts": (lambda s, r: F.concat_ws(" | ", _flag(rules.status_valid(_LONG(s))), rules.status_result(_LONG(s), r), _tag(rules.status_rule(_LONG(s)))), [
        ("200", "OK", "yes | 200 OK"), ("404", "Not Found", "no | 404 Not Found"), ("204", "", "yes | 204 | http-empty-content"), ("399", "x", "yes | 399 x"), ("400", "x", "no | 400 x"), ("100", "x", "yes | OK"), ("500", "", "no | 500"),
    ]),
    "f9_recursion": (lambda level, extern, size, kind, follow: _flag(rules.recurses(F.lit(True), _LONG(level), extern == "x", _LONG(size), kind, follow == "f", max_level=2)), [
        ("0", "", "10", "text/html", "f", "yes"), ("2", "", "10", "text/html", "f", "no"), ("0", "x", "10", "text/html", "f", "no"), ("0", "", "1048577", "text/html", "f", "no"), ("0", "", None, "text/css", "f", "yes"), ("0", "", "1", "image/png", "f", "no"), ("0", "", "1", "text/html", "n", "no"),
    ]),
    "f13_mail_errors": (rules.mail_error, [
        ("a@b.com", None), ("@", "no-local"), ("a", "no-at"), ("@example.org", "no-local"), ("a@", "no-domain"), ("a" * 65 + "@example.com", "local-too-long"), ("a@" + "b" * 64 + ".com", "domain"), ('"a""@example.com', "quote"), (".a@example.com", "leading-dot"), ("a.@example.com", "trailing-dot"),
        ("a..b@example.com", "double-dot"), ("a@a_b.com", "domain"), ("a@example.com.", "tld"), ("a@example.com.111", "tld"), ("a@example..com", "domain"), ("a b@c.d", "special"), ("a@[1.2.3.4]", None), ("a@[1.2.3.400]", "ip"), ("a" * 250 + "@example.com", "too-long"), ('"a b"@c.de', None),
    ]),
    "f14_mailtos": (lambda x: _tag(rules.empty_mailto(x)), [("mailto:", "mail-no-mail-host"), ("mailto:a@b", None), ("mailto:?subject=x", None), ("mailto:?subject=", "mail-no-mail-host"), ("mailto:?cc=a@b", None)]),
    "f15_itms": (lambda x: F.coalesce(rules.itms_error(x), scans.itms_child(x)), [("itms-services:?action=x&url=http%3A//h/a", "http://h/a"), ("itms-services:?action=x", "Missing required url parameter"), ("itms-services:?url=http://h/b;x", "http://h/b")]),
    "f18_local_files": (lambda u, p: _flag(rules.file_under_web(u, p).isNotNull()), [("file:///a", "http://h/", "yes"), ("file:///a", None, "no"), ("file:///a", "file:///b", "no"), ("http://h/", "http://h/", "no")]),
    "f19_certificates": (lambda x: _tag(rules.tls_rule(x, F.to_timestamp(F.lit(AS_OF)))), [("Jun  9 10:00:00 2026 GMT", "ssl-certificate-expires"), ("May  9 10:00:00 2026 GMT", "ssl-certificate-expired"), ("Jun  9 10:00:00 2027 GMT", None), (None, "ssl-certificate-missing-info"), ("20260602000000Z", "ssl-certificate-expires")]),
    "f20_header_infos": (lambda k, v: F.array_join(rules.header_info(F.create_map(k, v, F.lit("server"), F.lit("s")), ("X-", "ser")), " "), [("x-cache", "HIT", "server=s x-cache=HIT"), ("date", "d", "server=s"), ("X-A", "1", "X-A=1 server=s")]),
    "f21_news_and_telnet": (lambda x: F.concat_ws(" ", _tags(rules.news_rules(x)), rules.telnet_error(x)), [("nntp:///g", "nntp-no-server"), ("nntp://h/", "nntp-no-newsgroup"), ("nntp://h/g", ""), ("news:", "nntp-no-newsgroup"), ("news:g", ""), ("telnet://", " Host is empty"), ("telnet://h", ""), ("http://h", "")]),
    "e10_robots_words": (lambda x: F.concat(_flag(extract.meta_robots(x, "nofollow")), _flag(extract.meta_robots(x, "nofollow", False))), [
        ('<meta name="robots" content="nofollow">', "yesyes"), ('<meta name="robots" content="noindex, nofollow">', "noyes"), ('<meta name=robots content="noindex,NOFOLLOW"><body>', "yesyes"), ('<body><meta name="robots" content="nofollow">', "nono"), ('<meta name="x" content="nofollow">', "nono"), ('<meta name="robots" content="all"><meta name="robots" content="nofollow">', "nono"),
    ]),
    "e14_charsets": (lambda h, x: F.coalesce(scalars.charset(h), extract.meta_charset(x)), [
        ("text/html; charset=UTF-8", "", "utf-8"), ("text/html", '<meta charset="utf-8">', "utf-8"), ("text/html", '<meta http-equiv="Content-Type" content="text/html; charset=ISO-8859-1">', "iso-8859-1"), ("text/html", '<meta charset="koi8-r">', None), ("text/html", '<body><meta charset="utf-8">', None), ("", "", None),
    ]),
    "s17_parsers": (scans.parser_of, [("text/html; charset=x", "http://h/", "html"), ("TEXT/CSS", "http://h/", "css"), ("application/xml+sitemap", "http://h/", "sitemap"), ("image/png", "http://h/", None), (None, "ftp://h/a/", "html"), (None, "ftp://h/a", None), ("text/vnd.wap.wml", "http://h/", "wml")]),
    "s18_types": (lambda t, b, n: scans.sniffed(t, b, n), [
        ("text/plain", "<!DOCTYPE html><html>", "", "text/html"), ("text/plain", "Opera Hotlist version 2.0", "", "text/plain+opera"), ("text/plain", "# url list\nhttp://h", "", "text/plain+urls"), ("application/xml", '<?xml version="1.0"?>\n<urlset xmlns="x">', "", "application/xml+sitemap"),
        ("text/xml", '<?xml version="1.0"?><sitemapindex xmlns="x">', "", "application/xml+sitemapindex"), ("text/plain", "hello", "", "text/plain"), ("image/png", "<html>", "", "image/png"), (None, "x", "/a.wml", "text/vnd.wap.wml"), (None, "x", "/a", "application/octet-stream"), (None, '{ "checksum": "1"', "/a.txt", "text/plain+chromium"),
    ]),
}


def _pages_of(column: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("page_id", F.lit("http://h/p/q.html").alias("url"), F.col("a").alias(column))


def _links_of(df: DataFrame) -> DataFrame:
    return extract.links(_pages_of("html")(df)).select("page_id", F.struct("seq", "pos").alias("o"), F.concat_ws(" ", "tag", "attr", "raw_url").alias("value"))


def _joined_links(df: DataFrame) -> DataFrame:
    return extract.links(_pages_of("html")(df)).where("tag <> 'base'").select("page_id", F.struct("seq", "pos").alias("o"), urls.join(urls.base_of(F.col("url"), F.col("base_ref")), F.col("raw_url")).alias("value"))


def _bodies(df: DataFrame) -> DataFrame:
    return df.select("page_id", F.col("a").alias("body"))


def _listing(df: DataFrame) -> DataFrame:
    return scans.ftp_listing(df, "a", keep=("page_id",)).select("page_id", F.lit(0).alias("o"), F.concat_ws(" ", "name", "trycwd", "tryretr").alias("value"))


#: By query: a function from (page_id, a) to (page_id, o, value), and (a, expected values in order) for each case.
TABLES: dict[str, tuple[Callable[[DataFrame], DataFrame], list[tuple[str, list[str]]]]] = {
    "e1_link_cases": (_links_of, [
        ('<a href=" alink ">', ["a href  alink "]), ('<img srcset="a.jpg 1x, b.jpg 2x" alt="x">', ["img srcset a.jpg", "img srcset b.jpg"]), ('<div itemtype="http://example.org/Movie">', ["div itemtype http://example.org/Movie"]),
        ('<form action="alink"><form action="blink" method="POST">', ["form action alink"]), ("<a style=\"x: url( 'alink' ); y:url(b)\">", ["a style alink", "a style b"]), ('<a href="bla/a=b&quot;">', ['a href bla/a=b"']), ('<a href="/x&#38;y&eacute;">', ["a href /x&yé"]),
        ('<a href\n=\n"file.html">', ["a href file.html"]), ('<object archive="file.html,http://www.example.com">', ["object archive file.html", "object archive http://www.example.com"]), ('<link rel="dns-prefetch" href="//www.example.org">', ["link href dns://www.example.org"]),
        ("<!-- <a href=http://nocheckin> --><a href=x>", ["a href x"]), ('<meta http-equiv="refresh" content="5; url=http://www.example.com/">', ["meta content http://www.example.com/"]), ('<meta name="x" content="y">', []), ('<meta rel="SHORTCUT ICON" href="favicon.ico">', ["meta href favicon.ico"]),
        ("<script>var t=\"<a href='x'>\"</script><script src=\"s.js\"></script>", ["script src s.js"]), ("<frame src=a><iframe src=b>", ["frame src a", "iframe src b"]), ("<audio src=a><video src=b><source src=c><track src=d><html manifest=e><button formaction=f>", ["audio src a", "video src b", "source src c", "track src d", "html manifest e", "button formaction f"]),
        ("<tr background><a href>", []), ("<A HREF='X'>", ["a href X"]), ("<a title='a>b' href=c>", ["a href c"]), ("<a href=x", []), ("text only", []),
    ]),
    "e6_bases": (_joined_links, [
        ('<a href="x"><base target="t"><base href="/d/e/"><a href="x"><base href="http://no/"><a href="/y">', ["http://h/p/x", "http://h/d/e/x", "http://h/y"]), ('<base href="base/"><a href="t.txt">', ["http://h/p/base/t.txt"]), ('<a href="v">', ["http://h/p/v"]),
        ('<base href="http://z/w/"><applet codebase="http://c/k/" archive="z.jar"></applet><a href="v">', ["http://c/k/z.jar", "http://z/w/v"]),
    ]),
    "e7_names": (lambda df: extract.link_names(df.select("page_id", F.col("a").alias("html"))).select("page_id", F.col("seq").alias("o"), F.concat_ws(":", "tag", "name").alias("value")), [
        ("<a href=x><b>guru guru</a>", ["a:guru guru"]), ("<a href=x>test &lt;</a>", ["a:test <"]), ("<a href=x>never closed", ["a:"]), ("<a href=x><img src=i alt=abc></a>", ["a:abc"]), ("<a href=x title=t></a>", ["a:t"]), ('<img src=x alt="a b"><img src=y title=t>', ["img:a b", "img:t"]),
        ("<!-- <a href=x>no</a> --><a href=y>yes</a>", ["a:yes"]), ("<script>'<a href=x>no</a>'</script>", []), ("<a name=n>none</a>", []), ("<a href=x>" + "y" * 300 + "</a>", ["a:"]), ("<a href=x>a\n  b</a>", ["a:a b"]),
    ]),
    "e9_anchor_cases": (lambda df: extract.anchors(_pages_of("html")(df)).select("page_id", F.col("anchor").alias("o"), F.col("anchor").alias("value")), [('<a name="n"><p id="a:b"><h1 ID=c>', ["a:b", "c", "n"]), ('<div name="x">', []), ('<p id="x"><p id="x">', ["x"])]),
    "e11_form_cases": (lambda df: extract.forms(df.select("page_id", F.col("a").alias("html"))).select("page_id", F.col("form").alias("o"), F.concat_ws(" ", F.col("action"), F.array_join(F.transform("fields", lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x.value, F.lit("")))), "&")).alias("value")), [
        ('<form action="/login"><input name="User" value="u"><input name="pw"><input type="submit"></form><form action=/s></form>', ["/login User=u&pw=", "/s "]), ("<form><input name=x></form>", []), ('<form action="/open"><input name=a value=1>', ["/open a=1"]),
    ]),
    "e12_places": (lambda df: extract.with_places(df.select("page_id", F.col("a").alias("html"))).select("page_id", F.col("seq").alias("o"), F.concat_ws(" ", "tag", "line", "col").alias("value")), [
        ("<a>\n<b>x\ny<i></a>", ["a 1 1", "b 2 1", "i 3 2"]), ("<!-- \n\n --><p\nclass=x><b>", ["p 3 5", "b 4 9"]), ("x<a>", ["a 1 2"]), ("\n\n  <a><a>", ["a 3 3", "a 3 6"]), ("none", []),
    ]),
    "s2_lists": (lambda df: scans.url_list(_bodies(df), "page_id").select("page_id", F.col("line").alias("o"), F.concat_ws(" ", "line", "raw_url").alias("value")), [("# no\n\n http://a \n  # b\njavascript:x", ["3 http://a", "5 javascript:x"]), ("a\r\nb\rc", ["1 a", "2 b", "3 c"]), ("", [])]),
    "s4_css": (lambda df: scans.css(_bodies(df), "page_id").select("page_id", F.struct("line", "n").alias("o"), F.concat_ws(" ", "line", "raw_url").alias("value")), [("a{x:url('p')}\n/* url(q) */ b{y:url(r)}url( \"s\" )", ["1 p", "2 r", "2 s"]), ("@import url(a.css);", ["1 a.css"]), ("none", [])]),
    "s5_locs": (lambda df: scans.sitemap(_bodies(df), "page_id").select("page_id", F.col("n").alias("o"), F.col("raw_url").alias("value")), [
        ('<urlset xmlns="http://s"><url><loc> http://www.example.com/ </loc></url><url><loc>http://b/?x=1&amp;y</loc></url></urlset>', ["http://www.example.com/", "http://b/?x=1&y"]), ("<sitemapindex><sitemap><loc>http://a/s.xml</loc></sitemap></sitemapindex>", ["http://a/s.xml"]), ("<urlset/>", []),
    ]),
    "s7_wml": (lambda df: scans.wml(_pages_of("html")(df)).select("page_id", F.struct("seq", "pos").alias("o"), F.concat_ws(" ", "tag", "raw_url").alias("value")), [('<wml><a href="a">x</a><go href="b"/><img src="c"/><link href="no"/></wml>', ["a a", "go b", "img c"]), ("<card/>", [])]),
    "s8_binary": (lambda df: scans.binary_urls(df.select("page_id", F.encode("a", "ISO-8859-1").alias("content")), "page_id").select("page_id", F.col("n").alias("o"), F.col("raw_url").alias("value")), [("\x01ÿhttp://a.b/c\x00ftp://d.e\x02", ["http://a.b/c", "ftp://d.e"]), ("gopher://x", []), ("xhttps://h:8080/p#f<", ["https://h:8080/p#f"])]),
    "s9_markdown": (lambda df: scans.markdown(_bodies(df), "page_id").select("page_id", F.col("n").alias("o"), F.concat_ws(" ", "raw_url", "line", "col").alias("value")), [
        ('see <http://a.b> and [t](/u "title")\n[id]: http://c.d\n', ["http://a.b 1 6", "/u 1 25", "http://c.d 2 7"]), ("[a [b] c](/n)", ["/n 1 10"]), ("x\n ![i](/i.png)", ["/i.png 2 6"]), ("[a](</b>)", ["/b 1 4"]), ("[x](/a(b))", ["/a(b) 1 4"]), ("[![i](/i)](/o)", ["/o 1 11", "/i 1 6"]), ("[no] (x)", []),
        ("[a [b [c [d] e] f] g](/n)", ["/n 1 22"]), ("x [u](/u (v (w))) [u](/u (v (w)))", ["/u(v(w)) 1 6", "/u(v(w)) 1 22"]), ("[" * 1500 + "deep" + "]" * 1500 + "(/d)", ["/d 1 3005"]), ("[a](/b 'c')\n\n[e](/f\n/g) [h] [i](", ["/b 1 4", "/f/g 3 4"]), ("[a](b](c)", ["b](c 1 4"]),
    ]),
    "x22_address_groups": (lambda df: scalars.with_mail_addresses(df, "a").select("page_id", F.posexplode("addresses").alias("o", "value")), [
        ("mailto:Group:a@b.c,d@e.f;", ["a@b.c", "d@e.f"]), ("mailto:a@b.c%20(x,%20y)?cc=Team:%20Ann%20%3Cann@t.u%3E,%20bob@t.u;", ["a@b.c", "ann@t.u", "bob@t.u"]), ("mailto:none:;", []), ("mailto:z@y,a@b", ["a@b", "z@y"]), ("mailto:", []),
        ("mailto:(note)%20a@b.c,%20A%20B%20%3Cd@e.f%3E", ["a@b.c", "d@e.f"]),
    ]),
    "u3_idn_urls": (lambda df: urls.normalised(df.select("page_id", F.col("a").alias("url")), "url").select("page_id", F.lit(0).alias("o"), F.concat_ws(" ", "url", F.when(F.col("idn"), "idn")).alias("value")), [
        ("http://B\u00fccher.example/\u00fc", ["http://xn--bcher-kva.example/%C3%BC idn"]), ("http://a.b/x", ["http://a.b/x"]), ("HTTP://u:p@\u043f\u0440\u0438\u043c\u0435\u0440.org:8080/?q=\u00e9#f", ["http://u:p@xn--e1afmkfd.org:8080/?q=%C3%A9#f idn"]),
        ("http://b%C3%BCcher.example:80", ["http://xn--bcher-kva.example idn"]), ("/rel/\u00fc", ["/rel/%C3%BC"]), ("mailto:x@\u00fc.de", ["mailto:x@%C3%BC.de"]),
    ]),
    "s12_opera": (lambda df: scans.bookmark_text(_bodies(df), "page_id").select("page_id", F.col("url").alias("o"), F.concat_ws(" ", "url", "name").alias("value")), [("NAME=a\nURL=u\nX\nURL=v\nNAME=b\n\nURL=w", ["u a"]), ("URL=x", []), ("NAME=n\nURL=a\nNAME=m\nURL=b", ["a n", "b m"])]),
    "s14_listings": (_listing, [
        ("+i8388621.29609,m824255902,/,\tdev", ["dev true false"]), ("+i8388621.44468,m839956783,r,s10376,\tRFCEPLF", ["RFCEPLF false true"]), ("-rw-r--r--   1 root     other        531 Jan 29 03:26 README", ["README false true"]), ("dr-xr-xr-x   2 root     other        512 Apr  8  1994 etc", ["etc true false"]),
        ("lrwxrwxrwx   1 root     other          7 Jan 25 00:17 bin -> usr/bin", ["usr/bin true true"]), ("04-27-00  09:09PM       <DIR>          licensed", ["licensed true false"]), ("04-14-99  03:47PM                  589 readme.htm", ["readme.htm false true"]), ("CII-MANUAL.TEX;1  213/216  29-JAN-1996 03:33:12  [ANONYMOU,ANONYMOUS]", ["CII-MANUAL.TEX false true"]),
        ("CORE.DIR;1          1  8-SEP-1996 16:09 [SYSTEM] (RWE,RWE,RE,RE)", ["CORE true false"]), ("total 12", []), ("", []),
    ]),
}


@dataclass(frozen=True)
class _Robots:
    body: str
    agent: str
    path: str
    allowed: bool


ROBOTS = [
    _Robots("User-agent: *\nDisallow: /cyberworld/map/ # x\nDisallow: /tmp/\nDisallow: /foo.html\n", "a", "/test.html", True), _Robots("User-agent: *\nDisallow: /tmp/\n", "a", "/tmp/x", False), _Robots("User-agent: *\nDisallow: /tmp/\n", "a", "/tmp", True),
    _Robots("User-agent: *\nDisallow: /c/\n\nUser-agent: cybermapper\nDisallow:\n", "cybermapper", "/c/i.html", True), _Robots("User-agent: figtree\nDisallow: /%7ejoe/index.html\n", "FigTree/1.0 Robot", "/~joe/index.html", False), _Robots("", "a", "/x", True),
    _Robots("User-agent: a\nUser-agent: b\nDisallow: /x\n\nUser-agent: *\nDisallow: /\n\n", "b", "/y", True), _Robots("User-agent: a\nAllow: /x/y\nDisallow: /x\n", "a", "/x/y/z", True), _Robots("User-agent: a\nDisallow: /x\nAllow: /x/y\n", "a", "/x/y/z", False),
]


def _cases(pages: DataFrame, rows: list[tuple], kind: str) -> DataFrame:
    """page_id and case number i, with the inputs a, b, ... of page_id modulo the number of cases."""
    names = "abcdefgh"[: len(rows[0])]
    table = pages.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"i int, {', '.join(f'{n} {kind}' for n in names)}")
    return pages.select("page_id", F.pmod("page_id", F.lit(len(rows))).cast("int").alias("i")).join(F.broadcast(table), "i")


def _scalar(name: str) -> Callable[[SparkSession, str], DataFrame]:
    use, rows = SCALARS[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        planted = _cases(spark.read.parquet(f"{d}/pages.parquet"), [r[:-1] for r in rows], "string")
        return planted.select("page_id", use(*[F.col(c) for c in "abcdefgh"[: len(rows[0]) - 1]]).alias("value"))

    return query


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    use, rows = TABLES[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        planted = _cases(spark.read.parquet(f"{d}/pages.parquet"), [(r[0],) for r in rows], "string").select("page_id", "a")
        found = use(planted).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda x: x.value).alias("values"))
        return planted.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce(F.array_join("values", "\n"), F.lit("")).alias("value"))

    return query


def j4_robots_cases(spark: SparkSession, d: str) -> DataFrame:
    planted = _cases(spark.read.parquet(f"{d}/pages.parquet"), [(r.body, r.agent, r.path) for r in ROBOTS], "string").withColumn("origin", F.col("page_id").cast("string"))
    bodies = planted.select("origin", F.lit(200).alias("status"), F.col("a").alias("body"))
    table, out = robots.rules(bodies), None
    for agent in sorted({r.agent for r in ROBOTS}):
        wanted = planted.where(F.col("b") == agent).select("page_id", "origin", F.col("c").alias("path"), F.col("c").alias("url"))
        got = robots.allowed(wanted, table, bodies, agent).select("page_id", "allowed")
        out = got if out is None else out.unionByName(got)
    return out


def _literal(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    parts, plain = [], ""
    for c in value:
        if c in "\n\r\t" or ord(c) < 32 or ord(c) == 127:
            parts += [f"'{plain}'", f"chr({ord(c)})"]
            plain = ""
        else:
            plain += "''" if c == "'" else c
    return " || ".join([*parts, f"'{plain}'"])


def _sql(values: list[str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN {_literal(v)}" for i, v in enumerate(values))
    return f"SELECT page_id, CASE page_id % {len(values)} {cases} END AS value FROM pages"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**{n: _scalar(n) for n in SCALARS}, **{n: _table(n) for n in TABLES}, "j4_robots_cases": j4_robots_cases}
SQL: dict[str, str] = {
    **{n: _sql([r[-1] for r in rows]) for n, (_, rows) in SCALARS.items()}, **{n: _sql(["\n".join(v) for _, v in rows]) for n, (_, rows) in TABLES.items()},
    "j4_robots_cases": f"SELECT page_id, CASE page_id % {len(ROBOTS)} {' '.join(f'WHEN {i} THEN {r.allowed}' for i, r in enumerate(ROBOTS))} END AS allowed FROM pages",
}
