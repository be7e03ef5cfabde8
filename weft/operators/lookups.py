"""Rules, networks and domains as tables (J3, J12, U22), and results under hot keys.

Each is an equi-join on something that a match must have in common: a piece of
text for patterns, masked addresses for networks, suffixes for domains.  Distinct
URLs, addresses and hosts are looked up once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.binding import bound, record
from .joins import kept

#: Characters of the piece of text by which a pattern is found.
GRAM = 8
#: Patterns without such a piece that stand in one expression.
CHAIN = 100
#: Tables of rules or networks up to this many rows are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST = 100_000
#: A key with more than this part of all occurrences is dealt out to several tasks.
HOT_SHARE = 1 / 200
#: How many keys are taken for hot at most; there cannot be more of that share.
MAX_HOT = 200

_BREAK = "\x01"
_ESCAPABLE = r"\.^$*+?()[]{}|/-:=&#~,;'\"!@%<>_ "


def literal(pattern: Column) -> Column:
    """The longest text that every match of a pattern holds; empty if none is known, as in alternatives or under flags."""
    out = pattern
    for c in _ESCAPABLE:  # escaped marks stand for themselves, out of the way of what follows
        out = F.replace(out, F.lit("\\" + c), F.lit(chr(0xE000 + ord(c))))
    out = F.regexp_replace(F.regexp_replace(out, r"\\[\s\S]", _BREAK), r"\[[^\]]*\]", _BREAK)
    for _ in range(8):  # groups from the inside out
        out = F.regexp_replace(out, r"\([^()]*\)", _BREAK)
    sure = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, rf"[^{_BREAK}](?:[*?]|\{{[^}}]*\}})[+?]?", _BREAK), r"\+[+?]?", _BREAK), r"[*?.^$]|\{[^}]*\}", _BREAK)
    longest = lambda x: F.aggregate(F.split(sure(x), _BREAK), F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    plain = lambda x: F.translate(x, "".join(chr(0xE000 + ord(c)) for c in _ESCAPABLE), _ESCAPABLE)
    unsure = lambda x: pattern.rlike(r"\(\?[a-zA-Z-]|\\[QEpPkcxu0-9]") | x.rlike(r"[\[\]()|]")
    return bound(out, lambda x: F.when(unsure(x), "").otherwise(plain(longest(x))))


def _grams(text: Column) -> Column:
    """All pieces of GRAM characters of a text, each once."""
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if their count allows it."""
    return F.broadcast(rows) if rows.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else rows


def scope_by_rules(links: DataFrame, rules: DataFrame, check_extern: bool = False, key: str = "url") -> DataFrame:
    """J3 from a table: key, is_extern and is_strict of each distinct URL, as by joins.scope over the same rules.

    rules has seq, kind (extern, intern), pattern, negate and strict.  A rule whose
    pattern must hold some literal text is found by GRAM characters of it, those
    that fewest rules share; only URLs with these are matched against it.
    Negated rules, and patterns without such a text, are checked for every URL,
    CHAIN of them in an expression.
    """
    ordered = rules.select(
        F.struct((F.col("kind") != "extern").alias("intern"), F.col("seq").cast("long").alias("seq")).alias("place"), F.col("pattern"), F.coalesce("negate", F.lit(False)).alias("negate"),
        F.struct((F.col("kind") == "extern").alias("is_extern"), F.coalesce("strict", F.lit(False)).alias("is_strict")).alias("verdict"), literal(F.col("pattern")).alias("text"))
    ordered = kept(ordered)
    urls = kept(links.select(F.col(key).alias("url")).distinct())
    indexed = ~F.col("negate") & (F.length("text") >= GRAM)
    grams = ordered.where(indexed).select("place", "pattern", "verdict", F.explode(_grams(F.col("text"))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"))
    chosen = kept(grams.join(shared, "gram").groupBy("place", "pattern", "verdict").agg(F.min(F.struct("n", "gram")).alias("x")).select("place", "pattern", "verdict", F.col("x.gram").alias("gram")))
    met = urls.select("url", F.explode(_grams(F.col("url"))).alias("gram")).join(_small(chosen), "gram").where(F.rlike("url", F.col("pattern")))
    best = met.groupBy("url").agg(F.min(F.struct("place", "verdict")).alias("best"))
    found = urls.join(best, "url", "left")
    others = [r for r in ordered.where(~indexed).orderBy("place").toLocalIterator()]  # configuration: as long as what somebody wrote
    for a in range(0, len(others), CHAIN):
        first = F.lit(None).cast("struct<place:struct<intern:boolean,seq:bigint>,verdict:struct<is_extern:boolean,is_strict:boolean>>")
        for r in reversed(others[a : a + CHAIN]):
            hit = F.col("url").rlike(r.pattern)
            value = F.struct(
                F.struct(F.lit(r.place.intern).alias("intern"), F.lit(r.place.seq).cast("long").alias("seq")).alias("place"),
                F.struct(F.lit(r.verdict.is_extern).alias("is_extern"), F.lit(r.verdict.is_strict).alias("is_strict")).alias("verdict"))
            first = F.when(~hit if r.negate else hit, value).otherwise(first)
        found = found.withColumn("best", F.least("best", first))
    blank, none = record(is_extern=F.lit(True), is_strict=F.lit(True)), record(is_extern=F.lit(True), is_strict=F.lit(not check_extern))
    verdict = F.when(F.coalesce("url", F.lit("")) == "", blank).otherwise(F.coalesce("best.verdict", none))
    return found.select(F.col("url").alias(key), verdict.alias("v")).select(key, "v.*")


def with_networks(hosts: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """J12 from a table: hosts with ``network``, the narrowest of networks (column network) that holds the address; null if none does.

    Networks are addresses alone, with a length, or with a mask.  An address is
    looked up once for each mask in use, of which there are 33 if they are prefixes.
    """
    address, mask = F.split_part("network", F.lit("/"), F.lit(1)), F.split_part("network", F.lit("/"), F.lit(2))
    number = F.when(mask == "", F.lit(0xFFFFFFFF)).when(mask.contains("."), scalars.ip_number(mask)).when(mask.try_cast("int").between(0, 32), scalars.cidr_mask(mask.try_cast("int")))
    table = kept(networks.select("network", scalars.ip_number(address).bitwiseAND(number).alias("base"), number.alias("mask")).where("base is not null"))
    one_each = table.groupBy("base", "mask").agg(F.min("network").alias("network"))
    masks = [r.mask for r in table.select("mask").distinct().collect()]
    if not masks:
        return hosts.withColumn("network", F.lit(None).cast("string"))
    known = hosts.select(ip).distinct().withColumn("number", scalars.ip_number(F.col(ip)))
    tried = known.select(ip, "number", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select(ip, "mask", F.col("number").bitwiseAND(F.col("mask")).alias("base"))
    best = tried.join(_small(one_each), ["base", "mask"]).groupBy(ip).agg(F.max_by("network", "mask").alias("network"))
    return hosts.join(best, ip, "left")


def with_domains(hosts: DataFrame, domains: DataFrame, host: str = "host") -> DataFrame:
    """U22 from a table: hosts with ``domain``, the longest of domains (column domain) that is the host or, if it begins with a dot, ends it."""
    labels = F.split(host, r"\.")
    suffixes = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))).otherwise(F.array().cast("array<string>"))
    tried = hosts.select(host).distinct().select(host, F.explode(F.concat(F.array(F.col(host)), suffixes)).alias("domain"))
    best = tried.join(_small(kept(domains.select("domain").distinct())), "domain").groupBy(host).agg(F.max_by("domain", F.length("domain")).alias("domain"))
    return hosts.join(best, host, "left")


def hot_keys(rows: DataFrame, key: str) -> dict[str, float]:
    """The keys with more than HOT_SHARE of all rows, and about what share they have, by one aggregate of bounded size."""
    top = rows.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.expr(f"approx_top_k({key}, {MAX_HOT}, {100 * MAX_HOT})").alias("top")).first()
    return {x.item: x["count"] / top.n for x in (top.top or []) if x["count"] > HOT_SHARE * top.n}


def with_results_salted(occurrences: DataFrame, results: DataFrame, key: str = "cache_url") -> DataFrame:
    """J1 under hot keys: as joins.with_results, but the occurrences of a hot key go to several tasks, each of which has a copy of its result."""
    n = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = {k: min(n, 1 + math.ceil(share * n)) for k, share in hot_keys(occurrences, key).items()}
    if not parts:
        return occurrences.join(results.dropDuplicates([key]), key, "left")
    count = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col(key)), F.lit(1))
    row = F.xxhash64(*[c for c, t in occurrences.dtypes if "map<" not in t])
    dealt = occurrences.withColumn("_salt", F.pmod(row, count).cast("int"))
    copies = results.dropDuplicates([key]).withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1)))
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")
