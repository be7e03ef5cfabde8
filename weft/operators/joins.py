"""Joins of an audit: results, scope, anchors, redirects, graph, hosts, and the crawl over a snapshot."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import scalars, urls

MAX_REDIRECTS = 10


def kept(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder and read back: cuts the lineage of a loop."""
    return kept_and_counted(df)[0]


def kept_and_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As kept, and the number of rows, which the write itself counts."""
    spark, seen = df.sparkSession, Observation()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/loop-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def with_results(occurrences: DataFrame, results: DataFrame, key: str = "cache_url") -> DataFrame:
    """Every occurrence with its key's result, or nulls; one row per occurrence."""
    return occurrences.join(results.dropDuplicates([key]), key, "left")


def broken(occurrences: DataFrame, results: DataFrame, key: str = "cache_url") -> DataFrame:
    """The occurrences whose key has no valid result."""
    return occurrences.join(results.where("valid").select(key).distinct(), key, "left_anti")


def scope(url: Column, rule_list: Sequence[dict], check_extern: bool = False) -> Column:
    """(is_extern, is_strict) by the first rule that fits: extern rules first, then intern ones.

    A rule has kind (extern, intern), pattern, and may have negate and strict.
    Rules are constants, so they are a chain of conditions, not a join.
    """
    out = F.struct(F.lit(True).alias("is_extern"), F.lit(not check_extern).alias("is_strict"))
    ordered = [r for r in rule_list if r["kind"] == "extern"] + [r for r in rule_list if r["kind"] == "intern"]
    for r in reversed(ordered):
        hit = url.rlike(r["pattern"])
        verdict = F.struct(F.lit(r["kind"] == "extern").alias("is_extern"), F.lit(bool(r.get("strict"))).alias("is_strict"))
        out = F.when(~hit if r.get("negate") else hit, verdict).otherwise(out)
    return F.when(F.coalesce(url, F.lit("")) == "", F.struct(F.lit(True).alias("is_extern"), F.lit(True).alias("is_strict"))).otherwise(out)


def scope_of_seeds(url: Column, seeds: Sequence[str], rule_list: Sequence[dict] = (), check_extern: bool = False) -> Column:
    """As scope, with a rule for what lies below each seed behind the given intern ones."""
    return scope(url, [*rule_list, *({"kind": "intern", "pattern": urls.intern_rule(s)} for s in seeds)], check_extern)


def broken_anchors(links: DataFrame, anchors: DataFrame, key: str = "cache_url", target: str = "url") -> DataFrame:
    """Links (cache_url, fragment, ...) whose fragment the target (url, anchor) lacks, with what it has, both quoted.

    Targets may have another key than the URL: where a URL stands for several pages,
    the anchors of all are taken for it. The anchors of a target are listed once, and
    only of targets that lack one.
    """
    held = anchors.select(F.col(target).alias(key), urls.quote(F.col("anchor"), "/").alias("fragment")).distinct()
    missing = kept(links.where("fragment <> ''").join(held, [key, "fragment"], "left_anti"))
    lacking = missing.select(key).distinct()
    available = held.join(lacking, key, "left_semi").groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("fragment")), ",").alias("available"))
    return missing.join(available, key, "left").withColumn("available", F.coalesce("available", F.lit("-")))


def redirect_ends(redirects: DataFrame, limit: int = MAX_REDIRECTS) -> DataFrame:
    """from_url, final_url, hops and whether the chain is a loop or too long."""
    redirects = redirects.groupBy("from_url").agg(F.min("to_url").alias("to_url"))  # one hop from each URL
    step = redirects.select(F.col("from_url").alias("at"), F.col("to_url").alias("next"))
    live = kept(redirects.select("from_url", F.col("to_url").alias("final_url"), F.lit(1).alias("hops"), F.array("from_url", "to_url").alias("seen"), (F.col("from_url") == F.col("to_url")).alias("loop")))
    done = None
    for _ in range(limit):
        moved = kept(live.join(step, live.final_url == step.at, "left"))
        ended = moved.where("next is null or loop").select("from_url", "final_url", "hops", "loop")
        done = ended if done is None else done.unionByName(ended)
        live = moved.where("next is not null and not loop").select(
            "from_url", F.col("next").alias("final_url"), (F.col("hops") + 1).alias("hops"), F.concat("seen", F.array("next")).alias("seen"), F.array_contains("seen", F.col("next")).alias("loop"))
        if not live.limit(1).count():
            break
    else:
        done = done.unionByName(live.select("from_url", "final_url", "hops", F.lit(True).alias("loop")))
    return done


def for_aliases(results: DataFrame, ends: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Results (one for each key), and a copy under every URL that redirects to one and has none.

    Where a key has several answers, these may be given, each once: a URL that redirects to it gets all of them.
    """
    answers = results if answers is None else answers
    copies = ends.where("not loop").join(answers, ends.final_url == answers.cache_url).drop("cache_url", "final_url", "hops", "loop").withColumnRenamed("from_url", "cache_url")
    return results.unionByName(copies.select(*results.columns).join(results.select("cache_url"), "cache_url", "left_anti"))


def numbered(rows: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """rows with numbers from 0 without gaps, in the given order.

    Rows are dealt out by ranges of the order and sorted where they are; a row's
    number is its place there behind the count of all ranges before, of which
    there are as many as partitions.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = kept(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def numbered_within(rows: DataFrame, by: str, order: Sequence[str], name: str = "n") -> DataFrame:
    """rows with their numbers from 0 within each value of a column, null among them.

    They are numbered across partitions by that column and the order, and a row's
    place is its number behind the first of its value; so a value with very many
    rows is in no one task, as it would be under a window.
    """
    placed = numbered(rows, [by, *order], "_n")
    first = placed.groupBy(F.col(by).alias("_by")).agg(F.min("_n").alias("_first"))
    return placed.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, F.col("_n") - F.col("_first")).drop("_n", "_first", "_by")


def with_previous(rows: DataFrame, by: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the value of the row before, in the given order, within each value of a column; null for the first.

    Neighbours meet by their numbers across partitions, whatever the size of a value.
    """
    placed = numbered(rows, [by, *order], "_n")
    before = placed.select((F.col("_n") + 1).alias("_n"), F.col(by).alias("_by"), F.col(value).alias(name))
    met = placed.join(before, "_n", "left")
    return met.withColumn(name, F.when(F.col(by).eqNullSafe(F.col("_by")), F.col(name))).drop("_n", "_by")


def graph_nodes(records: DataFrame) -> DataFrame:
    """The first valid record of each URL, numbered from 0 without gaps in order of seq.

    records has url, parent_url, label, valid and a unique seq.
    """
    first = records.where("valid and url <> ''").groupBy("url").agg(F.min_by(F.struct("seq", "parent_url", "label"), "seq").alias("x")).select("url", "x.*")
    return numbered(first, ["seq"])


def graph_edges(nodes: DataFrame) -> DataFrame:
    """From each node's parent, if that is a node too."""
    parent = nodes.select(F.col("url").alias("parent_url"), F.col("id").alias("source_id"))
    return nodes.join(parent, "parent_url").select("source_id", F.col("id").alias("target_id"), "label")


def locate(hosts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Hosts (ip) in ranges (lo, hi, country, city), met by blocks of 2 ** 16 addresses."""
    wide = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / 65536), F.floor(F.col("hi") / 65536))))
    n = scalars.ip_number(F.col("ip"))
    return hosts.withColumn("number", n).withColumn("block", F.floor(n / 65536)).join(wide, "block").where("number between lo and hi").drop("block", "number", "lo", "hi")


def in_networks(ip: Column, networks: Sequence[str]) -> Column:
    """Whether an address is one of, or lies in one of, networks like 10.0.0.0/8 or 10.0.0.0/255.0.0.0."""
    out, number = F.lit(False), scalars.ip_number(ip)
    for network in networks:
        address, _, mask = network.partition("/")
        a = sum(int(x) << s for x, s in zip(address.split("."), (24, 16, 8, 0)))
        m = 0xFFFFFFFF if not mask else sum(int(x) << s for x, s in zip(mask.split("."), (24, 16, 8, 0))) if "." in mask else 0xFFFFFFFF << (32 - int(mask)) & 0xFFFFFFFF
        out = out | (number.bitwiseAND(F.lit(m)) == (a & m))
    return F.coalesce(out, F.lit(False))


def mail_hosts(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """Domain, its mail hosts by preference, and a warning or an error if there are none."""
    mx = dns.where("type = 'MX'").groupBy("domain").agg(F.transform(F.sort_array(F.collect_set(F.struct("preference", "host"))), lambda x: x.host).alias("hosts"))
    a = dns.where("type = 'A'").groupBy("domain").agg(F.count("*").alias("n"))
    joined = domains.select("domain").distinct().join(mx, "domain", "left").join(a, "domain", "left")
    return joined.select("domain", F.coalesce(F.array_join("hosts", ","), F.when(F.col("n") > 0, F.col("domain")), F.lit("")).alias("hosts"), F.when(F.col("hosts").isNotNull(), "ok").when(F.col("n") > 0, "mail-no-mx-host").otherwise("error").alias("verdict"))


def resolves(hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """Host and whether it has an address."""
    return hosts.select("host").distinct().join(dns.where("type = 'A'").select(F.col("domain").alias("host"), F.lit(True).alias("valid")).distinct(), "host", "left").fillna(False, ["valid"])


def within_budget(occurrences: DataFrame, budget: int, order: Sequence[str] = ("level", "seq"), key: str = "url") -> DataFrame:
    """L1: the occurrences up to the one that brings the budget's last new key; all later ones go, known or not.

    order names columns that no two occurrences share.  First occurrences are
    numbered across partitions, and the place of the last one is one row.
    """
    place = F.struct(*order)
    first = occurrences.groupBy(key).agg(F.min(place).alias("_first")).select("_first.*")
    cut = numbered(first, order, "_n").where(F.col("_n") == budget - 1).select(place.alias("_cut"))
    if budget <= 0:
        return occurrences.limit(0)
    return occurrences.join(F.broadcast(cut.agg(F.min("_cut").alias("_cut")))).where(F.col("_cut").isNull() | (place <= F.col("_cut"))).drop("_cut")


def crawl(seeds: DataFrame, links: DataFrame, results: DataFrame, max_level: int | None = None, budget: int | None = None) -> DataFrame:
    """Url and level of all that is reached from the seeds.

    seeds has url; links has parent_url and url; both may have seq, the order of
    their occurrences (else that of their names).  results has url and recurse,
    whether a page's links are followed.  A round expands one level; what was
    seen is left out, and the rounds end when nothing new is found, or at
    max_level, if it is given (L2), or when budget new URLs were taken, in the
    order of their first occurrences (L1).
    """
    follow = results.where("recurse").select(F.col("url").alias("parent_url")).distinct()
    ordered = lambda df: df if budget is not None and "seq" in df.columns else df.withColumn("seq", F.lit(0))
    edges = kept(ordered(links).groupBy("parent_url", "url").agg(F.min("seq").alias("seq")).join(follow, "parent_url", "left_semi"))
    taken = 0

    def within(found: DataFrame) -> DataFrame:
        """The URLs of a level's new occurrences, as far as the budget goes."""
        first = found.groupBy("url").agg(F.min("seq").alias("seq"))
        return (first if budget is None else numbered(first, ["seq", "url"], "n").where(F.col("n") < budget - taken)).select("url")

    frontier, n = kept_and_counted(within(ordered(seeds).select("url", "seq")).withColumn("level", F.lit(0)))
    seen = frontier
    for level in itertools.count(1) if max_level is None else range(1, max_level + 1):
        taken += n
        if not n or taken == budget:
            break
        found = edges.join(frontier.select(F.col("url").alias("parent_url")), "parent_url").select("url", "seq")
        frontier, n = kept_and_counted(within(found.join(seen, "url", "left_anti")).withColumn("level", F.lit(level)))
        seen = seen.unionByName(frontier)
        if level % 16 == 0:
            seen = kept(seen)  # the plan stays small, however many rounds there are
    return seen


def crawl_site(seeds: DataFrame, links: DataFrame, results: DataFrame, in_scope: Column, denied: DataFrame, redirects: DataFrame, max_level: int | None = None, budget: int | None = None) -> DataFrame:
    """J16 with scope, robots and redirects: url, level and state of all that is reached.

    in_scope is J3's verdict on the column url; denied has the URLs that robots
    forbid; redirects has from_url and to_url.  A strictly extern URL is
    filtered, one that is denied or extern is checked but not expanded, and one
    that redirects has the links of where it ends.  All of it is decided before
    the rounds, for each URL once.
    """
    ends = redirect_ends(redirects).where("not loop").select("from_url", "final_url")
    final = results.select("url").unionByName(ends.select(F.col("from_url").alias("url"))).distinct().join(ends.withColumnRenamed("from_url", "url"), "url", "left")
    # where a page's links lead through: its own, or those of its last hop
    through = final.select("url", F.coalesce("final_url", "url").alias("parent_url"))
    moved = through.join(links.select("parent_url", F.col("url").alias("child")), "parent_url").select(F.col("url").alias("parent_url"), F.col("child").alias("url"))
    expands = through.join(results.where("recurse").select(F.col("url").alias("parent_url")), "parent_url", "left_semi").select("url", F.lit(True).alias("recurse"))
    every = kept(seeds.select("url").unionByName(moved.select("url")).unionByName(final.select("url")).distinct())
    forbidden = denied.select("url", F.lit(True).alias("denied")).distinct()
    state = F.when(F.col("s.is_extern") & F.col("s.is_strict"), "filtered").when(F.col("denied"), "denied").when(F.col("s.is_extern"), "extern").otherwise("checked")
    states = kept(every.withColumn("s", in_scope).join(forbidden, "url", "left").select("url", state.alias("state")))
    free = states.where("state = 'checked'").select("url")
    return crawl(seeds, moved, expands.join(free, "url", "left_semi"), max_level, budget).join(states, "url")


def schedule(requests: DataFrame, rate: int = 10, delay: str | None = None) -> DataFrame:
    """The least due time in ms of each request of a host (host, seq), by the rate or a delay column in s."""
    gap = F.coalesce(F.col(delay) * 1000, F.lit(1000 // rate)) if delay else F.lit(1000 // rate)
    return numbered_within(requests, "host", ["seq"], "_place").withColumn("due_ms", (F.col("_place") * gap).cast("long")).drop("_place")


def one_per_host(fetches: DataFrame) -> DataFrame:
    """One fetch of each host, that of the smallest URL."""
    return fetches.groupBy("host").agg(F.min_by(F.struct(*[c for c in fetches.columns if c != "host"]), "url").alias("x")).select("host", "x.*")


def redirect_rule(from_url: Column, final_url: Column) -> Column:
    """A hop out of http is an error."""
    inside = urls.part(from_url, "scheme").isin("http", "https")
    return F.when(inside & ~urls.part(final_url, "scheme").isin("http", "https"), F.concat(F.lit("Redirection to "), final_url, F.lit(" has another scheme")))


def redirect_infos(ends: DataFrame, in_scope: Column | None = None) -> DataFrame:
    """Of each redirected URL (from_url, final_url, hops, loop) its info, its error, and the scope of where it ends."""
    error = F.when(F.col("loop"), f"more than {MAX_REDIRECTS} redirects, or a loop").otherwise(redirect_rule(F.col("from_url"), F.col("final_url")))
    out = ends.withColumns({"info": F.concat(F.lit("Redirected to "), "final_url"), "error": error})
    return out if in_scope is None else out.withColumnRenamed("final_url", "url").withColumn("scope", in_scope).withColumnRenamed("url", "final_url")
