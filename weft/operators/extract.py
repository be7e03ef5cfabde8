"""Links and other things out of pages (E1 to E14); no shuffle, every page in its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.binding import bound, record
from ..functions.scalars import resolved, unquoted, without_markup

#: What is in a tag up to its >; possessive, so that an unclosed tag takes no stack.
_INNER = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
#: Cuts a page into tokens that make it up again, whatever it holds.
TOKEN = rf"(?is)<!--.*?-->|<script\b[^>]*+>.*?</script\s*+>|<style\b[^>]*+>.*?</style\s*+>|<[a-z/!?]{_INNER}>|[^<]++|<"
#: The start tag at the head of a token.
_START = rf"(?s)^(<[a-zA-Z]{_INNER}>)"
#: A name and its value; a run of letters is tried once.
ATTRIBUTE = r"""(?<![a-zA-Z:-])([a-zA-Z:-]++)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
# Urls in style sheets, and the content of a refresh.
REFRESH = r"(?i)^\d+;\s*url=(.+)$"
CSS_URL = r"""url\(\s*('[^']+'|"[^"]+"|[^\)\s]+)\s*\)"""
#: How far a link's name or a title may reach.
NEAR = 256


def start_tags(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The start tags of each page: key, url, seq (token number), tag, body, and the base_ref that holds at each."""
    t = pages.select(key, "url", "html", F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)).alias("t"))
    base = lambda x, i: F.when(x.rlike("(?i)^<base(?![a-zA-Z0-9])"), record(seq=i, href=attribute(x, "href")))
    own = F.filter(F.transform("t", base), lambda b: F.coalesce(b.href, F.lit("")) != "")
    first = F.when(F.col("html").rlike("(?i)<base"), F.get(own, F.lit(0)))  # the first one that has a reference
    cut = t.select(key, "url", first.alias("base"), F.posexplode("t").alias("seq", "body"))
    tags = cut.where(F.col("body").rlike("^<[a-zA-Z]")).select(
        key, "url", "seq", "base", F.lower(F.regexp_extract("body", "^<([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("tag"), F.regexp_extract("body", _START, 1).alias("body"),
    )
    codebase = F.when(F.col("tag") == "applet", F.nullif(attribute(F.col("body"), "codebase"), F.lit("")))
    return tags.select(key, "url", "seq", "tag", "body", F.coalesce(codebase, F.when(F.col("base.seq") <= F.col("seq"), F.col("base.href"))).alias("base_ref"))


def attribute(body: Column, name: str) -> Column:
    """The value of a tag's attribute, entities resolved; null if it has none."""
    raw = F.regexp_extract(body, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return bound(raw, lambda x: F.when(x != "", resolved(unquoted(x))))


def attributes(body: Column) -> Column:
    """All attributes of a tag with a value, in order, as (name, value), entities resolved."""
    pairs = F.transform(F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(0)), lambda x: record(name=F.lower(F.regexp_extract(x, ATTRIBUTE, 1)), value=unquoted(F.regexp_extract(x, ATTRIBUTE, 2))))
    return F.transform(pairs, lambda p: record(name=p["name"], value=resolved(p.value)))


def values(tag: Column, attr: Column, value: Column, attrs: Column) -> Column:
    """The links that one attribute's value holds; attrs are all attributes of its tag."""
    other = lambda name: F.lower(F.get(F.filter(attrs, lambda p: p["name"] == name), 0).value)
    http_equiv, rel = other("http-equiv"), other("rel")
    refresh = F.regexp_extract(value, REFRESH, 1)
    content = F.when((http_equiv == "refresh") & (refresh != ""), F.array(refresh)).when(other("scheme") == "dcterms.uri", F.array(value))
    return (
        F.when((tag == "meta") & (attr == "content"), content)
        .when((tag == "meta") & (attr == "href"), F.when(rel.isin("shortcut icon", "icon"), F.array(value)))
        .when((tag == "form") & (attr == "action"), F.when(F.coalesce(other("method"), F.lit("get")) != "post", F.array(value)))
        .when((tag == "link") & (rel == "dns-prefetch"), F.array(F.concat(F.lit("dns:"), F.regexp_replace(F.regexp_replace(value, "^[a-z]+:", ""), "/$", ""))))
        .when(attr == "archive", F.split(value, r"\s*,\s*"))
        .when(attr == "srcset", F.transform(F.split(value, ","), lambda x: F.split_part(F.trim(x), F.lit(" "), F.lit(1))))
        .when(attr == "style", F.transform(F.regexp_extract_all(value, F.lit(CSS_URL), F.lit(1)), lambda x: unquoted(x, True)))
        .otherwise(F.array(value))
    )


def links(pages: DataFrame, tags: dict[str, str] = tables.LINK_TAGS, key: str = "page_id") -> DataFrame:
    """Key, url, seq, pos, tag, attr and raw_url of every link, and its base_ref.

    The tags' attributes are few and fixed, so they are looked up as constants,
    not joined.
    """
    wanted = F.create_map(*[F.lit(x) for tag, names in tags.items() for x in (tag, names)])
    names = F.split(F.concat_ws(" ", F.get(F.array(wanted[F.col("tag")]), 0), F.lit(tags.get("*", ""))), " ")
    found = start_tags(pages, key).where(F.col("body").contains("=")).select(key, "url", "seq", "tag", "base_ref", names.alias("names"), attributes(F.col("body")).alias("attrs"))
    pair = found.select(key, "url", "seq", "tag", "base_ref", "names", "attrs", F.posexplode("attrs").alias("pos", "pair")).where(F.array_contains("names", F.col("pair.name")))
    each = pair.select(key, "url", "seq", "pos", "tag", F.col("pair.name").alias("attr"), F.explode(values(F.col("tag"), F.col("pair.name"), F.col("pair.value"), F.col("attrs"))).alias("raw_url"), "base_ref")
    return each.where("raw_url <> ''")


def with_places(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Line (from 1) and column (from 1) of every start tag.

    Of a token only its length, its line ends and what is behind the last of
    them are kept; they are added up over the tokens of a page in order.
    """
    numbered = pages.select(key, "html", F.monotonically_increasing_id().alias("_page"))
    each = numbered.select(key, "_page", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("seq", "body"))
    n, lines = F.length("body"), F.length("body") - F.length(F.replace(F.col("body"), F.lit("\n"), F.lit("")))
    tail = F.length(F.substring_index("body", "\n", -1))
    tag = F.when(F.col("body").rlike("^<[a-zA-Z]"), F.lower(F.regexp_extract("body", "^<([a-zA-Z][a-zA-Z0-9]*)", 1)))
    small = each.select(key, "_page", "seq", tag.alias("tag"), n.cast("long").alias("n"), lines.cast("long").alias("lines"), tail.cast("long").alias("tail"))
    order = Window.partitionBy("_page").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # characters up to the end of each token, and those behind whose last line end the next token stands
    summed = small.withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line_starts = summed.withColumn("line_start", F.when(F.col("lines") > 0, F.col("end") - F.col("tail")))
    placed = line_starts.select(
        key, "seq", "tag", (F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1).alias("line"),
        (F.col("end") - F.col("n") - F.coalesce(F.max("line_start").over(before), F.lit(0)) + 1).alias("col"),
    )
    return placed.where("tag is not null")


def base_refs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Key, seq, tag and base reference of each start tag for which one holds: its own codebase, or the page's first base before it."""
    return start_tags(pages, key).where("base_ref is not null").select(key, "seq", "tag", "base_ref")


def link_names(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Seq (number from 0), tag and name of every link of an anchor or image.

    An anchor's name is its text, an image's alt in it, or its title; an image's
    its alt or title.  Comments, scripts and style sheets hold none.
    """
    plain = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b[^>]*+>.*?</script\s*+>|<style\b[^>]*+>.*?</style\s*+>", "")
    every = pages.select(key, F.posexplode(F.regexp_extract_all(plain, F.lit(rf"(?is)<a\s{_INNER}>(?:.{{0,{NEAR}}}?</a\s*>)?|<img\s{_INNER}>"), F.lit(0))).alias("at", "piece"))
    head = F.regexp_extract("piece", _START, 1)
    image = F.col("piece").rlike("(?i)^<img")
    text = F.regexp_extract(F.substring(F.col("piece"), F.length(head) + 1, F.lit(1 << 30)), r"(?is)^(.*)</a\s*>$", 1)
    alt = attribute(F.regexp_extract(text, rf"(?is)(<img\s{_INNER}>)", 1), "alt")
    name = F.nullif(F.trim(F.regexp_replace(resolved(without_markup(text)), r"\s+", " ")), F.lit(""))
    title = F.nullif(attribute(head, "title"), F.lit(""))
    found = every.where(head.rlike(r"(?is)^<a\s.*\bhref\s*=|^<img\s.*\bsrc\s*="))
    named = F.when(image, F.coalesce(F.nullif(attribute(head, "alt"), F.lit("")), title)).otherwise(F.coalesce(name, F.nullif(alt, F.lit("")), title))
    return found.select(key, F.col("at").cast("long").alias("seq"), F.when(image, "img").otherwise("a").alias("tag"), F.coalesce(named, F.lit("")).alias("name"))


def meta_charset(html: Column) -> Column:
    """The charset that a page's meta tags name, if it is one of the known ones."""
    tags = F.regexp_extract_all(F.split_part(F.lower(html), F.lit("<body"), F.lit(1)), F.lit(rf"(?is)<meta\s{_INNER}>"), F.lit(0))
    by_type = lambda t: F.when(attribute(t, "http-equiv") == "content-type", F.trim(F.regexp_extract(attribute(t, "content"), r";\s*charset=\s*([-0-9a-z]+)", 1)))
    said = F.transform(tags, lambda t: F.coalesce(attribute(t, "charset"), by_type(t)))
    return F.get(F.filter(said, lambda x: x.isin(*tables.CHARSETS)), 0)


def titles(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The title, else the last part of the path, else the URL."""
    found = F.trim(F.regexp_replace(resolved(F.regexp_extract("html", r"(?is)<title[^>]*>(.{0,256}?)</title\s*>", 1)), r"\s+", " "))
    last = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)$", 1)
    return pages.select(key, F.coalesce(F.nullif(found, F.lit("")), F.nullif(last, F.lit("")), F.col("url")).alias("title"))


def anchors(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """E9."""
    return links(pages, tables.ANCHOR_TAGS, key).select(key, "url", F.col("raw_url").alias("anchor")).distinct()


def meta_robots(html: Column, word: str, strict: bool = True) -> Column:
    """Whether the first robots entry before the body holds the word; strict does not trim."""
    head = F.split_part(F.lower(html), F.lit("<body"), F.lit(1))
    tag = F.regexp_extract(head, r"""(?is)(<meta\s[^>]*name\s*=\s*["']?robots["']?[^>]*>)""", 1)
    content = F.coalesce(attribute(tag, "content"), F.lit(""))
    return F.array_contains(F.split(content, "," if strict else r"\s*,\s*"), F.lit(word))


def forms(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Key, form (number from 1), action, and the named fields as (name, value)."""
    form = F.regexp_extract_all("html", F.lit(r"(?is)<form\b.*?(?:</form\s*>|\z)"), F.lit(0))
    each = pages.select(key, F.posexplode(form).alias("form", "body"))
    fields = F.filter(F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<input\b[^>]*>"), F.lit(0)), lambda x: record(name=attribute(x, "name"), value=attribute(x, "value"))), lambda x: x["name"].isNotNull())
    return each.select(key, (F.col("form") + 1).alias("form"), attribute(F.regexp_extract("body", r"(?is)^(<form\b[^>]*>)", 1), "action").alias("action"), fields.alias("fields")).where("action is not null")


def form_with(found: DataFrame, field: str) -> DataFrame:
    """The forms that hold a field, whatever its case."""
    return found.where(F.exists("fields", lambda x: F.lower(x["name"]) == field.lower()))


def content_matches(texts: DataFrame, pattern: str, key: str, column: str, first_line: int = 0) -> DataFrame:
    """The first match of a pattern and its line, counted from first_line."""
    hit = texts.where(F.col(column).rlike(pattern))
    before = F.left(F.col(column), F.regexp_instr(F.col(column), F.lit(pattern)) - 1)
    return hit.select(key, F.regexp_extract(column, pattern, 0).alias("match"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + first_line).cast("long").alias("line"))
