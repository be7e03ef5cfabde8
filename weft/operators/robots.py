"""robots.txt: bodies to rules, and rules to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import unquote


def lines(robots: DataFrame) -> DataFrame:
    """origin, line (from 1), key and value of each line that is not blank; blank lines have a null key."""
    each = robots.select("origin", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r\n|\r|\n")).alias("pos", "raw"))
    plain = F.trim(F.regexp_replace("raw", "#.*$", ""))
    blank = F.trim("raw") == ""
    return each.where(blank | (plain.contains(":"))).select(
        "origin", (F.col("pos") + 1).alias("line"), F.when(~blank, F.lower(F.trim(F.split_part(plain, F.lit(":"), F.lit(1))))).alias("key"),
        F.when(~blank, unquote(F.trim(F.regexp_replace(plain, "^[^:]*:", "")))).alias("value"),
    )


def rules(robots: DataFrame) -> DataFrame:
    """Origin, entry_no, is_default, agent, rule_no, path, allow, crawl_delay.

    An entry starts at a user-agent line behind a rule or a blank line.  An entry
    for * is the default, the last one wins; but one that the end of the file
    closes stands among the others.  A body's lines are few, so windows run
    within an origin.
    """
    known = lines(robots).where("key is null or key in ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    w = Window.partitionBy("origin").orderBy("line")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("-")) != "user-agent")
    numbered = known.withColumn("entry_no", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("key is not null and entry_no > 0")
    closed = known.withColumn("entry_no", F.sum(F.when(starts, 1).otherwise(0)).over(w)).groupBy("origin").agg(F.max("entry_no").alias("last_entry"), F.max_by("key", "line").alias("last_key"))
    agents = numbered.where("key = 'user-agent'").select("origin", "entry_no", F.lower("value").alias("agent"))
    delays = numbered.where("key = 'crawl-delay'").groupBy("origin", "entry_no").agg(F.max(F.when(F.col("value").rlike("^[0-9]+$"), F.col("value").cast("int"))).alias("crawl_delay"))
    paths = numbered.where("key in ('allow', 'disallow')").select(
        "origin", "entry_no", F.col("line").alias("rule_no"), F.when((F.col("key") == "disallow") & (F.col("value") == ""), "/").otherwise(F.col("value")).alias("path"), ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"))
    joined = agents.join(paths, ["origin", "entry_no"], "left").join(delays, ["origin", "entry_no"], "left").join(closed, "origin")
    at_end = (F.col("entry_no") == F.col("last_entry")) & F.col("last_key").isNotNull()
    return joined.select("origin", "entry_no", ((F.col("agent") == "*") & ~at_end).alias("is_default"), "agent", "rule_no", "path", "allow", "crawl_delay")


def allowed(urls: DataFrame, rule_table: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Urls (origin, path, url) with ``allowed``.

    The first entry that fits the agent decides, the default one last; in it the
    first rule whose path is a prefix.  401 and 403 deny all; other errors allow
    all.  Rules and robots are per origin, so only keys of urls are shuffled.
    """
    name = agent.lower()
    fits = rule_table.where((F.col("agent") == "*") | F.lit(name).contains(F.col("agent")))
    chosen = fits.groupBy("origin").agg(F.min(F.struct("is_default", F.when(F.col("is_default"), -F.col("entry_no")).otherwise(F.col("entry_no")).alias("order"))).alias("best"))
    live = fits.join(chosen, "origin").where((F.col("is_default") == F.col("best.is_default")) & (F.abs("best.order") == F.col("entry_no"))).where("path is not null")
    per_origin = live.groupBy("origin").agg(F.array_sort(F.collect_set(F.struct("rule_no", "path", "allow"))).alias("rules"))
    state = robots.select("origin", F.when(F.col("status").isin(401, 403), "deny").when(F.col("status") >= 400, "allow").otherwise("rules").alias("state"))
    joined = urls.join(state, "origin", "left").join(per_origin, "origin", "left")
    hit = F.get(F.filter("rules", lambda r: F.col("path").startswith(r.path)), 0).allow
    return joined.select(*urls.columns, F.when(F.col("state") == "deny", False).when(F.col("state") == "rules", F.coalesce(hit, F.lit(True))).otherwise(True).alias("allowed"))


def crawl_delay(rule_table: DataFrame, agent: str) -> DataFrame:
    """R2: of the first ordinary entry that fits."""
    fits = rule_table.where(~F.col("is_default") & ((F.col("agent") == "*") | F.lit(agent.lower()).contains(F.col("agent"))))
    return fits.groupBy("origin").agg(F.min_by("crawl_delay", "entry_no").alias("crawl_delay"))


def sitemaps(robots: DataFrame) -> DataFrame:
    """R3."""
    return lines(robots).where("key = 'sitemap'").select("origin", F.col("value").alias("sitemap"), "line")


def canonical(rule_table: DataFrame) -> DataFrame:
    """Entries as text, default last: agents, then the delay, then the rules."""
    line = F.when(F.col("path").isNotNull(), F.struct(F.col("rule_no").alias("n"), F.concat(F.when(F.col("allow"), "Allow: ").otherwise("Disallow: "), F.col("path")).alias("text")))
    entry = rule_table.groupBy("origin", "entry_no").agg(
        F.max("is_default").alias("is_default"), F.array_sort(F.collect_set(F.concat(F.lit("User-agent: "), F.col("agent")))).alias("agents"), F.max("crawl_delay").alias("delay"),
        F.transform(F.array_sort(F.collect_set(line)), lambda x: x.text).alias("lines"),
    )
    text = F.array_join(F.concat("agents", F.when(F.col("delay").isNotNull(), F.array(F.concat(F.lit("Crawl-delay: "), F.col("delay")))).otherwise(F.array().cast("array<string>")), "lines"), "\n")
    return entry.groupBy("origin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("is_default", "entry_no", text.alias("text")))), lambda x: x.text), "\n\n").alias("text"))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1)
