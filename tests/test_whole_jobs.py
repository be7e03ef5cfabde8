"""Jobs done to their end, whatever their depth, order or parts."""

import os

import duckdb
from pyspark.sql import functions as F

from weft.functions import scalars
from weft.operators import extract, joins, report
from weft.plans.queries import QUERIES, page_links
from weft.plans.sql import SQL
from weft.streaming import jobs


def test_crawl_has_no_limit(spark):
    n = 104
    links = spark.range(n).select(F.concat(F.lit("u"), "id").alias("parent_url"), F.concat(F.lit("u"), F.col("id") + 1).alias("url")).coalesce(1)
    seeds, results = spark.createDataFrame([("u0",)], "url string"), links.select(F.col("parent_url").alias("url"), F.lit(True).alias("recurse"))
    got = {r.url: r.level for r in joins.crawl(seeds, links, results).collect()}
    assert got == {f"u{i}": i for i in range(n + 1)}
    assert joins.crawl(seeds, links, results, max_level=2).count() == 3
    assert {r.url for r in joins.crawl(seeds, links, results, budget=7).collect()} == {f"u{i}" for i in range(7)}


def test_unclosed_tags(spark):
    """Megabytes of open tags, quotes and comments take no stack and little time."""
    big = 1_000_000
    html = ["<b " + "x" * big, "<a href='" + "y" * big, "<!-- " + "z" * big, '<a href="u">' + "<script>" + "q" * big, "<style " * (big // 700), "<b a=b " + "x" * big + ">", "<b " + "x='y' " * (big // 20) + ">", "<b a=b" + " " * big + "c>"]
    pages = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    assert [(r.page_id, r.raw_url) for r in extract.links(pages).collect()] == [(3, "u")]
    assert extract.with_places(pages).where("page_id = 3 and tag = 'a'").count() == 1
    assert extract.link_names(pages).count() <= 2 and extract.forms(pages).count() == 0


def test_streak_over_files_in_any_order(spark, tmp_path):
    """Users 1 and 2: a later file holds earlier checks; 3: the last valid check comes last; 4: in order."""
    files = [
        [(1, 10, "view"), (1, 20, "error"), (1, 30, "error"), (2, 40, "error"), (3, 10, "error"), (3, 30, "error"), (4, 1, "view"), (4, 2, "error")],
        [(1, 5, "view"), (1, 6, "error"), (2, 30, "view"), (2, 10, "error"), (3, 20, "view"), (4, 3, "error")],
        [(1, 25, "view"), (2, 50, "error"), (3, 40, "view"), (4, 4, "error")],
    ]
    at = tmp_path / "events.parquet"
    for i, rows in enumerate(files):
        frame = spark.createDataFrame([(100 * i + j, *r) for j, r in enumerate(rows)], "event_id long, user_id long, t long, event_type string")
        frame.select("event_id", "user_id", F.timestamp_seconds("t").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(str(at))
        for f in at.glob("part-*.parquet"):  # in the order of the files
            os.utime(f, (1000 * (i + 1), 1000 * (i + 1))) if f.stat().st_mtime > 1e6 else None
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{at}/*.parquet'")
    want = {tuple(r) for r in db.execute(SQL["t2_stream_streak"]).fetchall()}
    assert want == {(1, 1), (2, 2), (4, 3)}
    assert {tuple(r) for r in QUERIES["t2_stream_streak"](spark, str(tmp_path)).collect()} == want


def test_repeated_urls(spark, tmp_path):
    urls = ["http://a/x", "http://a/x", "http://a/x/", "http://a/x/", "http://a/x/", "http://b/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("u23_duplicate_urls", "s2_url_list"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(db.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall())
    plan = QUERIES["s2_url_list"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_links_join_their_base(spark):
    html = """<a href="x">1</a><basefont color="b"><base target="t"><base href="/d/e/"><a href="x">2</a><base href="http://no/"><a href="/x">3</a>
<applet codebase="http://c/k/" code="y.class" archive="z.jar"></applet><a href="http://o/">4</a><a href="x">5</a>"""
    pages = spark.createDataFrame([(1, "http://h/p/q.html#f", html), (2, "http://h/p/q.html", '<base href="http://z/w/"><a href="v">'), (3, "http://h/p/q.html", '<a href="v">')], "page_id long, url string, html string")
    got = [(r.page_id, r.tag, r.url) for r in page_links(pages).where("tag <> 'base'").orderBy("page_id", "seq", "pos").collect()]
    assert [g[2] for g in got if g[:2] == (1, "a")] == ["http://h/p/x", "http://h/d/e/x", "http://h/x", "http://o/", "http://h/d/e/x"]
    assert (1, "applet", "http://c/k/z.jar") in got and [g[2] for g in got if g[0] > 1] == ["http://z/w/v", "http://h/p/v"]
    assert {r.base_ref for r in extract.base_refs(pages).where("page_id = 1").collect()} == {"/d/e/", "http://c/k/"}


def test_streak_state_is_bounded_by_its_delay(spark, tmp_path):
    """Failures below the watermark are a number; a later valid check still ends them."""
    files = [
        [(1, 0, "error"), (1, 60, "error"), (2, 0, "error"), (3, 0, "error"), (2, 10_000, "error")],
        [(1, 10_000, "error"), (2, 9_990, "error"), (3, 10_000, "error"), (1, 10_010, "error")],
        [(1, 20_000, "error"), (3, 20_000, "view"), (2, 20_000, "error")],
        [(3, 20_001, "error"), (1, 20_002, "error")],
    ]
    schema = "event_id long, user_id long, ts timestamp, valid boolean"
    source = tmp_path / "checks"
    for i, rows in enumerate(files):
        frame = spark.createDataFrame([(100 * i + j, u, t, e != "error") for j, (u, t, e) in enumerate(rows)], "event_id long, user_id long, t long, valid boolean")
        frame.select("event_id", "user_id", F.timestamp_seconds(F.col("t") + 1_000_000).alias("ts"), "valid").coalesce(1).write.mode("append").parquet(str(source))
        for f in source.glob("part-*.parquet"):
            os.utime(f, (1000 * (i + 1), 1000 * (i + 1))) if f.stat().st_mtime > 1e6 else None
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        got = jobs.run_once(jobs.streaks(stream, "1 minute"), "update", str(tmp_path / "state"), ["user_id"])
        assert {tuple(r) for r in got.collect()} == {(1, 6), (2, 4), (3, 1)}
    finally:
        spark.conf.unset(provider)


def test_versions_of_a_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    one = report.write_table(spark.range(3), folder)
    os.makedirs(f"{folder}/version-0000000003")  # another writer has that number, whole or not
    two = report.write_table(spark.range(5), folder)
    assert one.endswith("1") and two.endswith("4") and report.latest(spark, folder).count() == 5 and report.latest(spark, folder).columns == ["id"]
    assert not [p for p in os.listdir(folder) if p.startswith("_writing")]


def test_written_reports(spark, tmp_path):
    warning = "array<struct<tag:string,msg:string>>"
    rows = spark.createDataFrame([("http://a/", "p", None, "200 OK", [], ["i"], True, "http://a/?x=1&y", 1, 2, "n;\"q\"", None, 5, None, 0, None), ("b", None, None, "404", [("t", "m<"), ("u", "o")], [], False, "http://b/", None, None, None, 0.5, None, 1.5, 1, None)],
        f"raw_url string, parent_url string, base_ref string, result string, warnings {warning}, info array<string>, valid boolean, url string, line int, col int, name string, dltime double, size long, checktime double, level int, modified timestamp")
    csv = report.csv_rows(rows, ["urlname", "name", "warningstring", "valid"])
    report.write_csv(csv, str(tmp_path / "csv"))
    back = spark.read.option("sep", ";").option("header", True).option("multiLine", True).option("escape", "\\").csv(str(tmp_path / "csv"))
    assert sorted((r.urlname, r.name, r.warningstring, r.valid) for r in back.collect()) == [("b", None, "m<\no", "false"), ("http://a/", 'n;"q"', None, "true")]
    report.write_xml(report.xml_rows(rows), str(tmp_path / "xml"))
    xml = spark.read.format("xml").option("rowTag", "urldata").load(str(tmp_path / "xml"))
    assert sorted(r.url for r in xml.collect()) == ["http://a/?x=1&y", "http://b/"] and [r.warnings.warning[0]._tag for r in xml.where("warnings is not null").collect()] == ["t"]
    assert report.chosen(csv, ["valid", "nothing", "name"]).columns == ["valid", "name"]


def test_schedule(spark):
    rows = spark.createDataFrame([("h", i, 2 if i % 2 else None) for i in range(9)] + [("g", 4, None), (None, 1, None)], "host string, seq int, wait int").repartition(5)
    assert {(r.host, r.seq): r.due_ms for r in joins.schedule(rows).collect()} == {**{("h", i): 100 * i for i in range(9)}, ("g", 4): 0, (None, 1): 0}
    assert {(r.host, r.seq): r.due_ms for r in joins.schedule(rows, delay="wait").collect()} == {**{("h", i): i * (2000 if i % 2 else 100) for i in range(9)}, ("g", 4): 0, (None, 1): 0}
    assert joins.schedule(rows.limit(0)).count() == 0


def test_sketches_of_a_stream(spark, tmp_path):
    """The keys of a stream's kinds, merged, are those of all its rows."""
    rows = spark.range(3000).select(F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 3 == 0, "error").otherwise("view").alias("event_type"), (F.col("id") % 500).alias("user_id"))
    rows.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    got = jobs.run_once(jobs.running_statistics(stream, "user_id"), "complete", str(tmp_path / "state"))
    assert {r.event_type: r.number for r in got.collect()} == {"error": 1000, "view": 2000}
    merged = report.volume_of(report.merged_volume(got.select(F.col("number").alias("bytes"), "keys"))).first()
    assert merged.bytes == 3000 and abs(merged.results - 500) <= 10


def test_anchors_of_pages_with_one_url(spark, tmp_path):
    """Pages under one URL have their own anchors each: an even one's fragment is not there for an odd one."""
    u = "http://h/a#top"
    rows = [(1, u, "<p>x"), (2, u, "<p>y"), (3, u, None), (4, u, None), (5, "http://h/a", "<p>z"), (7, "http://h/b#top", ""), (9, "http://h/a?q#end", "<p>"), (11, "http://h/a?q", "<p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in QUERIES["j6_broken_anchors"](spark, str(tmp_path)).select("page_id", "fragment", "available").collect())
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.execute(SQL["j6_broken_anchors"]).fetchall()) == [(1, "top", "n1"), (3, "top", "n3"), (7, "top", "n7"), (9, "end", "n9")]


def test_aliases_of_pages_with_one_url(spark, tmp_path):
    """Pages under one URL have a status each: what redirects there has all of them, once; what has its own keeps that."""
    urls = {3: "http://h/a", 4: "http://h/b", 5: "http://h/c#x", 6: "http://h/d", 8: "http://h/d#y", 27: "http://h/d", 33: "http://h/d", 11: "http://h/e", 12: "http://h/d", 1: "http://h/b", 7: "http://h/b"}
    urls |= {19: "http://h/l", 20: "http://h/m", 21: "http://h/l", 22: "http://h/m"}  # 19 and 21 lead to m, 20 to l
    spark.createDataFrame([(i, u, "") for i, u in urls.items()], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in QUERIES["j8_alias_results"](spark, str(tmp_path)).select("cache_url", "status").collect())
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.execute(SQL["j8_alias_results"]).fetchall())
    assert got[:6] == [("http://h/a", 200), ("http://h/a", 204), ("http://h/a", 404), ("http://h/b", 200), ("http://h/c", 200), ("http://h/c", 204)]


def test_text_functions_of_odd_documents(spark, tmp_path):
    """Null and empty texts, null counts, blanks of any width, halves of a unit's last digit, and sizes above a GB."""
    blanks = [c + "x" + c + "y" + c for c in " \u00a0\u1680\u2000\u2009\u200a\u202f\u205f\u3000\t\r\x1f\x85\u180e\u200b\u2028\ufeff"]
    texts = [None, "", " \n", "'", "a'b\nc", "\u3000 \u00a0\nx", "\U0001f600" * 41, "\r\n" * 150, *blanks]
    rows = [(t, n) for t in texts for n in (None, 0, 3)] + [("t", n) for n in (10, 59, 60, 102, 103, 160, 3599, 3600, 10485, 10486, 32768, 98304, 104857, 104858, 196608, 10737418, 10737419, 107374183, 10**12)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["x11_text_functions"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == db.execute(f"select {', '.join(got.columns)} from ({SQL['x11_text_functions']}) order by doc_id").fetchall()
    sizes = spark.createDataFrame([(None,), (1 << 30,), (10 << 30,)], "n long").select(scalars.human_size(F.col("n")).alias("x"), scalars.human_duration(F.col("n")).alias("y"))
    assert [(r.x, r.y) for r in sizes.collect()] == [(None, None), ("1.00GB", "298261:37:04"), ("10.0GB", "2982616:10:40")]
