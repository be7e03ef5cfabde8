"""Scans of bodies that are broken, deep or of many kinds."""

import json
import sys

from pyspark.sql import functions as F

from weft.plans.queries import QUERIES
from weft.sources import scans


def bodies(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "url int, body string")


def test_faulty_sitemaps(spark):
    """(body, locs, whether it is faulty); what stands before the fault is kept, and no body stops the others."""
    url = "<url><loc>http://a/{}</loc></url>"
    cases = [
        ("<urlset>" + url.format(1) + "</urlset>", ["http://a/1"], False), ("<urlset>" + url.format(1) + url.format(2)[:-9], ["http://a/1"], True), ("", [], True), (None, [], False), ("no xml", [], True),
        ('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE urlset [<!ENTITY x "y">]><urlset>' + url.format("1?a&amp;b&#38;c") + "</urlset>\n<!-- end -->", ["http://a/1?a&b&c"], False),
        (' <?xml version="1.0"?><urlset/>', [], True), ("<urlset/><urlset/>", [], True), ("<urlset>" + url.format(1) + "</urlset>tail", ["http://a/1"], True), ("<urlset><url a=b>" + url.format(1) + "</url></urlset>", [], True),
        ('<urlset><url a="b" c=\'>\'>' + url.format(1) + "</url></urlset>", ["http://a/1"], False), ("<a><b></a></b>" + url.format(1), [], True), ("<urlset>" + url.format(1) + "&nbsp;" + url.format(2) + "</urlset>", ["http://a/1"], True),
        ("<urlset><![CDATA[<loc>no</loc>]]>" + url.format("<![CDATA[x&y]]>") + "<x/></urlset>", ["http://a/x&y"], False), ("<urlset>" + url.format(1) + "< " + url.format(2) + "</urlset>", ["http://a/1"], True),
        ("<urlset>" + "".join(url.format(i) for i in range(5000)) + "</urlset>", [f"http://a/{i}" for i in range(5000)], False), ("<d>" * 3000 + url.format(1) + "</d>" * 3000, ["http://a/1"], False), ("<" * 20_000, [], True),
    ]
    files = bodies(spark, [b for b, _, _ in cases])
    got = {i: [] for i in range(len(cases))}
    for r in scans.sitemap(files).orderBy("url", "n").collect():
        got[r.url].append(r.raw_url)
    assert got == {i: locs for i, (_, locs, _) in enumerate(cases)}
    warned = scans.sitemap_warnings(files).collect()
    assert {r.url for r in warned} == {i for i, c in enumerate(cases) if c[2]} and {r.tag for r in warned} == {"xml-parse-error"}
    assert scans.sitemap(files.limit(0)).count() == 0


def test_hostile_sitemaps(spark):
    """Megabytes of one tag, quote, comment, reference or attribute list take no stack; what stands before them is kept."""
    big, url = 300_000, "<urlset><url><loc>http://a/1</loc></url>"
    tails = ["<x a='" + "y" * big, "<x" + "y" * big, "<x" + "".join(f" a{i}='b'" for i in range(big // 10)) + "/></urlset>", "<y>" + "&amp;" * (big // 5) + "</y></urlset>", "<!--" + "z" * big, "<x " + '"a"' * (big // 3), "&" * big, "<a/>" * (big // 4) + "</urlset>", "<" * big]
    got = {r.url: (r.locs, r.warning is not None) for r in scans.sitemap_contents(bodies(spark, [url + t for t in tails])).collect()}
    assert got == {i: (["http://a/1"], not t.endswith("</urlset>")) for i, t in enumerate(tails)}


def test_bookmarks_of_any_depth(spark):
    def nested(n, name):
        node = {"type": "url", "url": f"u{name}", "name": name}
        for _ in range(n):
            node = {"type": "folder", "name": "f", "children": [node, {"type": "url", "url": f"s{name}", "name": None}]}
        return json.dumps({"roots": {"bar": node, "date": "1", "other": {"type": "folder", "children": []}}})

    sys.setrecursionlimit(5000)
    files = bodies(spark, [nested(0, "a"), nested(33, "b"), nested(200, "c"), "{", None, "[]", '{"roots": 1}', nested(2000, "d")])
    got = sorted((r.url, r.name or "") for r in scans.bookmark_json(files).collect())
    assert got == sorted([("ua", "a"), ("ub", "b"), ("uc", "c")] + [("sb", "")] * 33 + [("sc", "")] * 200)
    assert {(r.url, r.msg) for r in scans.bookmark_faults(files).collect()} == {(3, "no JSON"), (5, "no roots"), (6, "no roots"), (7, "no JSON")}
    assert {r["key"] for r in scans.bookmark_json(files, key="url").collect()} == {0, 1, 2}


def test_markdown_at_any_depth(spark):
    texts = ["[" * 3000 + "x" + "]" * 3000 + "(/deep)", "[" * 100_000 + "(" * 100_000, "[a](/u (v (w)))\n[a](/u (v (w)))", "[a](", "[a]()", None, "", "<http://h/x> <no> [r]: http://d\n[r]: <http://d> 'T'", "[a](<b c> \"t\") [![i](/i 't')](/o)", "[a](x" + " " * 200_000 + "y)"]
    got = [(r.url, r.raw_url, r.line, r.col) for r in scans.markdown(bodies(spark, texts)).orderBy("url", "n").collect()]
    assert got == [
        (0, "/deep", 1, 6002), (2, "/u(v(w))", 1, 4), (2, "/u(v(w))", 2, 4), (7, "http://h/x", 1, 2), (7, "http://d", 2, 7), (8, "bc", 1, 4), (8, "/o", 1, 30), (8, "/i", 1, 21), (9, "xy", 1, 4),
    ]


def test_listing_reads_no_content(spark, tmp_path):
    for name in ("a/x.txt", "a/b/y.bin", "c/z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\x00http://h/p\x00")
    listing = scans.files_below(spark, str(tmp_path))
    assert "content:" not in listing._jdf.queryExecution().executedPlan().toString()
    folders = scans.folders_of(listing, str(tmp_path))
    assert {r.path.removeprefix(str(tmp_path)) for r in folders.collect()} == {"/a/", "/a/b/", "/c/"}
    links = scans.directory(folders.unionByName(listing.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))))
    assert {(r.parent_url.removeprefix(str(tmp_path)), r.raw_url) for r in links.collect()} == {("/", "a/"), ("/", "c/"), ("/a/", "b/"), ("/a/", "x.txt"), ("/a/b/", "y.bin"), ("/c/", "z")}
    assert [r.raw_url for r in scans.binary_urls(scans.files_below(spark, str(tmp_path), content=True)).collect()] == ["http://h/p"] * 3


def test_links_plan_is_small(spark):
    """Each URL, tag and entity is planned once."""
    plan = QUERIES["u2_normalised_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 150 and len(plan) < 100_000
