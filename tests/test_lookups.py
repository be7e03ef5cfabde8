"""Lookups in tables, hot keys, numbers without gaps, budgets and merged states, against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.operators import joins, lookups, report


@pytest.mark.parametrize("pattern, text", [
    (r"^https?://(www\.)?example\.com/a/", "example.com/a/"), (r"\.html$", ".html"), ("(?i)ABCDEFGH", ""), ("abc|def", ""), ("abcd?e", "abc"), ("abcd+e", "abcd"), (r"a(b(c|d))?/long", "/long"), (r"[abc]long-er\d+x", "long-er"), ("x{3}abc", "abc"),
    (r"a\\b", r"a\b"), (r"\[1\]\+", "[1]+"), (r"\Qabc\E", ""), ("", ""), (r"a.*?bcd", "bcd"), ("(unclosed", ""),
])
def test_literal_of_a_pattern(spark, pattern, text):
    assert spark.createDataFrame([(pattern,)], "p string").select(lookups.literal(F.col("p"))).first()[0] == text


def test_ten_thousand_rules(spark):
    rng = random.Random(3)
    hosts = [f"host{i:05d}.example{i % 7}.org" for i in range(12_000)]
    rules = []
    for i in range(10_000):
        host = rng.choice(hosts[:9000]).replace(".", r"\.")
        pattern = rng.choice([rf"^https?://(www\.)?{host}/", rf"^https?://(www\.)?{host}/d{rng.randrange(3)}/", rf"{host[4:9]}\.example[0-6]\.org/d1"])
        rules.append((i, rng.choice(["extern", "intern"]), pattern, False, rng.random() < 0.5))
    rules += [(20_000 + i, "intern", rf"/d{i}\.html$", i == 9, True) for i in range(10)] + [(30_000, "intern", "a|b", None, None)]
    urls = [(f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/d{rng.randrange(4)}/{rng.randrange(20)}{rng.choice(['', '.html'])}",) for _ in range(1000)] + [("",), (None,)]
    ordered = [(re.compile(p), bool(n), kind == "extern", bool(s)) for kind in ("extern", "intern") for _, k, p, n, s in rules if k == kind]
    want = {u: next(((e, s) for p, n, e, s in ordered if bool(p.search(u)) != n), (True, True)) if u else (True, True) for (u,) in urls}
    got = lookups.scope_by_rules(spark.createDataFrame(urls, "url string"), spark.createDataFrame(rules, "seq int, kind string, pattern string, negate boolean, strict boolean"))
    assert {r.url: (r.is_extern, r.is_strict) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rule_table_equals_chain(spark):
    rules = [("extern", "^https?://blog[.]", False, True), ("extern", "[.]net(/|$)", False, False), ("intern", "^https://", False, False), ("intern", "[.]html", True, True)]
    urls = spark.createDataFrame([(u,) for u in ["http://blog.x/", "http://a.net/", "https://a/", "http://a/b.html", "http://a/b", ""]], "url string")
    chain = urls.select("url", joins.scope(F.col("url"), [{"kind": k, "pattern": p, "negate": n, "strict": s} for k, p, n, s in rules], check_extern=True).alias("s")).select("url", "s.*")
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "seq int, kind string, pattern string, negate boolean, strict boolean")
    assert sorted(lookups.scope_by_rules(urls, table, check_extern=True).collect()) == sorted(chain.collect())
    assert lookups.scope_by_rules(urls, table.limit(0)).where("is_extern and is_strict").count() == 6


def test_many_networks_and_domains(spark):
    rng = random.Random(5)
    number = lambda ip: sum(int(x) << s for x, s in zip(ip.split("."), (24, 16, 8, 0)))
    ip = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    networks = {f"{ip()}/{rng.randrange(9, 33)}" for _ in range(50_000)} | {ip() for _ in range(50_000)} | {"10.0.0.0/255.0.0.0", "bad", "1.2.3.4/99", "300.1.1.1/8"}
    hosts = [ip() for _ in range(2000)] + [n.split("/")[0] for n in list(networks)[:500]] + [None, "x", "10.3.4.5"]
    by = {}
    for n in sorted(networks):
        a, _, m = n.partition("/")
        if re.fullmatch(r"\d+(\.\d+){3}", a) and all(int(x) < 256 for x in a.split(".")) and m != "99":
            mask = 0xFFFFFFFF if not m else number(m) if "." in m else 0xFFFFFFFF << (32 - int(m)) & 0xFFFFFFFF
            by.setdefault((number(a) & mask, mask), n)
    masks = sorted({m for _, m in by}, reverse=True)
    fits = lambda h: h and re.fullmatch(r"\d+(\.\d+){3}", h) and all(int(x) < 256 for x in h.split("."))
    want = {h: next((by[number(h) & m, m] for m in masks if (number(h) & m, m) in by), None) if fits(h) else None for h in hosts}
    got = lookups.with_networks(spark.createDataFrame([(h,) for h in hosts], "ip string"), spark.createDataFrame([(n,) for n in networks], "network string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.ip: r.network for r in got.collect()} == want
    assert lookups.with_networks(spark.createDataFrame([("1.1.1.1",)], "ip string"), spark.createDataFrame([], "network string")).first().network is None
    domains = {f".d{i}.org" for i in range(50_000)} | {f"h{i}.d{i}.org" for i in range(0, 50_000, 2)} | {".org.uk", "plain"}
    names = [f"h{i}.d{i}.org" for i in range(100)] + [f"x.y.d{i}.org" for i in range(60_000, 60_010)] + ["d7.org", "a.d7.org", "plain", "org.uk", "a.org.uk", "", None]
    longest = lambda h: max((d for d in ([h] if h in domains else []) + [d for d in (h[k:] for k, c in enumerate(h) if c == "" or c == ".") if d in domains]), key=len, default=None) if h else None
    found = lookups.with_domains(spark.createDataFrame([(h,) for h in names], "host string"), spark.createDataFrame([(d,) for d in domains], "domain string"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.host: r.domain for r in found.collect()} == {h: longest(h) for h in names}


def test_hot_key_is_in_many_tasks(spark):
    n = 40_000
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        occurrences = spark.range(n).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("cache_url"))
        results = occurrences.where("cache_url is not null").select("cache_url").distinct().withColumn("valid", F.length("cache_url") % 2 == 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = lookups.with_results_salted(occurrences, results.unionByName(results))
        plain = joins.with_results(occurrences, results)
        assert sorted(map(repr, got.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
        most = lambda df: max(Counter(r.p for r in df.select("valid", F.spark_partition_id().alias("p")).collect()).values())
        assert most(plain) > n // 3 and most(got) < n // 5
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_without_gaps(spark):
    rows = spark.range(0, 5000, 3, 7).select((F.col("id") * 7919 % 5003).alias("seq"), F.lit("x").alias("u"))
    want = {s: i for i, s in enumerate(sorted(r.seq for r in rows.collect()))}
    assert {r.seq: r.id for r in joins.numbered(rows, ["seq"]).collect()} == want
    assert joins.numbered(rows.limit(0), ["seq"]).count() == 0
    records = spark.createDataFrame([(1, "a", None, "A", True), (5, "b", "a", "B", True), (9, "c", "b", "C", True), (10, "b", "c", "again", True), (3, "no", "a", "N", False)], "seq int, url string, parent_url string, label string, valid boolean")
    nodes = joins.graph_nodes(records)
    assert {(r.url, r.id) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.source_id, r.target_id) for r in joins.graph_edges(nodes).collect()} == {(0, 1), (1, 2)}


@pytest.mark.parametrize("budget", [0, 1, 3, 4, 99])
def test_budget_by_occurrences(spark, budget):
    urls = "a b a c b d a a".split()
    occurrences = spark.createDataFrame([(0 if i < 3 else 1, i, u) for i, u in enumerate(urls)], "level int, seq int, url string").repartition(5)
    seen, want = set(), []
    for i, u in enumerate(urls):
        if len(seen) == budget:
            break
        seen.add(u)
        want.append(i)
    assert sorted(r.seq for r in joins.within_budget(occurrences, budget).collect()) == want


def test_crawl_takes_urls_in_order(spark):
    seeds = spark.createDataFrame([("s", 0)], "url string, seq int")
    links = spark.createDataFrame([("s", "z", 1), ("s", "m", 2), ("s", "a", 3), ("z", "b", 4)], "parent_url string, url string, seq int")
    results = spark.createDataFrame([("s", True), ("z", True)], "url string, recurse boolean")
    assert {r.url for r in joins.crawl(seeds, links, results, budget=3).collect()} == {"s", "z", "m"}
    assert {r.url for r in joins.crawl(seeds, links.drop("seq"), results, budget=3).collect()} == {"s", "a", "m"}


def test_merged_volume(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("size"), F.concat(F.lit("u"), F.col("id") % 20_000).alias("cache_url"))
    parts = None
    for k in range(3):
        state = report.volume(rows.where(F.col("size") % 3 == k))
        parts = state if parts is None else parts.unionByName(state)
    merged, whole = report.volume_of(report.merged_volume(parts)).first(), report.volume_of(report.volume(rows)).first()
    assert merged == whole and abs(merged.results - 20_000) < 400
    assert report.volume_of(report.volume(rows.limit(0))).first() == (0, 0)


@pytest.mark.parametrize("n", [5, 1200, 1600, 2500])
def test_volume_is_that_of_the_keys(spark, n):
    """The same keys have the same volume from one task, from many, and from runs, exactly and by sketch."""
    rows = spark.range(n + n // 2).select("id", F.col("id").alias("size"), F.concat(F.lit("u"), F.col("id") % n).alias("cache_url"))
    runs = [rows.where(F.col("id") % 3 == k) for k in range(3)]
    sketches, states = [report.volume(x) for x in runs], [report.volume_by_key(x) for x in runs]
    ways = [report.volume(rows.coalesce(1)), report.volume(rows.repartition(7)), report.merged_volume(sketches[0].unionByName(sketches[1]).unionByName(sketches[2]))]
    assert len({report.volume_of(x).first() for x in ways}) == 1
    exact = report.exact_volume_of(report.merged_by_key(states[0].unionByName(states[1]).unionByName(states[2]))).first()
    assert exact == report.exact_volume_of(report.volume_by_key(rows)).first() == (sum(range(n + n // 2)), n)


def test_previous_within_a_value(spark):
    rows = [("h", i, f"v{i}") for i in range(0, 40, 3)] + [("g", 5, "x"), (None, 1, "n1"), (None, 2, "n2")]
    want = {}
    for by in {r[0] for r in rows}:
        own = sorted((o, v) for b, o, v in rows if b == by)
        want |= {(by, o): own[i - 1][1] if i else None for i, (o, _) in enumerate(own)}
    frame = spark.createDataFrame(rows, "host string, o int, v string").repartition(6)
    assert {(r.host, r.o): r.before for r in joins.with_previous(frame, "host", ["o"], "v", "before").collect()} == want
    assert {(r.host, r.o): r.n for r in joins.numbered_within(frame, "host", ["o"]).collect()} == {(b, o): sum(x[0] == b and x[1] < o for x in rows) for b, o, _ in rows}
