"""Links out of other things than HTML pages."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import tables
from ..functions.binding import record
from ..functions.scalars import mime, resolved, unquoted, without_comments, without_markup, xml_escaped
from ..functions.urls import SAFE, part, quote, unquote
from ..operators.extract import CSS_URL, links
from ..operators.joins import kept

_LINE = "\r\n|\r|\n"


def url_list(files: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """One URL a line; blank lines and those that begin with # are skipped."""
    each = files.select(key, F.posexplode(F.split(body, _LINE)).alias("pos", "raw"))
    text = F.trim("raw")
    return each.where((text != "") & ~text.startswith("#")).select(key, (F.col("pos") + 1).alias("line"), text.alias("raw_url"))


def words(files: DataFrame, column: str = "value") -> DataFrame:
    """S3."""
    return files.select(F.explode(F.split(column, r"\s+")).alias("raw_url")).where("raw_url <> ''")


def css(files: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """url(...) outside comments, with line and place in it."""
    each = files.select(key, F.posexplode(F.split(without_comments(F.col(body)), _LINE)).alias("pos", "text"))
    found = each.select(key, (F.col("pos") + 1).alias("line"), "text", F.posexplode(F.regexp_extract_all("text", F.lit(CSS_URL), F.lit(1))).alias("n", "raw"))
    return found.select(key, "line", "n", unquoted(F.col("raw")).alias("raw_url"))


_NAME = r"[A-Za-z_:][\w:.-]*"
_REFERENCE = r"&(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);"
_QUOTED = rf"""(?:"(?:[^"<&]++|{_REFERENCE})*+"|'(?:[^'<&]++|{_REFERENCE})*+')"""
_XML_TOKEN = r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE(?:[^\[>]++|\[[^\]]*+\])*+>|<(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^<]++|<"""
_XML_TAG = rf"(?s)^<({_NAME})(?:\s+{_NAME}\s*=\s*{_QUOTED})*+\s*+/?>$"
_LOC = r"(?s)<(?:[\w.-]+:)?loc(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?loc\s*>"


def _xml_fault(tokens: Column) -> Column:
    """The number of the first token at which a document is not well-formed (from 0; their count if it ends too early); null if it is.

    The names of open elements are a path in the state, so a document may be as deep as it likes.
    """
    state = lambda path, done, fault: record(path=path, done=done, fault=fault)

    def step(s: Column, x: Column) -> Column:
        bad = state(s.path, s.done, x.at)
        outside, pushed, popped = s.path == "", F.concat(s.path, F.lit("/"), x["name"]), F.left(s.path, F.length(s.path) - F.length(x["name"]) - 1)
        return (
            F.when(s.fault.isNotNull() | (x.kind == "other"), s)
            .when(x.kind == "open", F.when(outside & s.done, bad).otherwise(state(pushed, s.done, s.fault)))
            .when(x.kind == "empty", F.when(outside & s.done, bad).otherwise(state(s.path, s.done | outside, s.fault)))
            .when(x.kind == "close", F.when(s.path.endswith(F.concat(F.lit("/"), x["name"])), state(popped, s.done | (popped == ""), s.fault)).otherwise(bad))
            .when(x.kind == "text", F.when(outside, bad).otherwise(s))
            .otherwise(bad)
        )

    def kind(x: Column, i: Column) -> Column:
        tag = x.rlike(_XML_TAG)
        return (
            F.when(x.startswith("<!--") | x.startswith("<!DOCTYPE") | (x.startswith("<?") & (~x.rlike(r"^<\?xml\s") | (i == 0))) | x.rlike(r"^\s+$"), "other")
            .when(x.startswith("<![CDATA["), "text").when(x.rlike(rf"^</{_NAME}\s*>$"), "close").when(tag & x.endswith("/>"), "empty").when(tag, "open")
            .when(~x.startswith("<") & x.rlike(rf"^(?:[^&]++|{_REFERENCE})*+$"), "text").otherwise("fault")
        )

    each = F.transform(tokens, lambda x, i: record(at=i, kind=kind(x, i), name=F.regexp_extract(x, rf"^</?({_NAME})", 1)))
    start = state(F.lit(""), F.lit(False), F.lit(None).cast("int"))
    return F.aggregate(each, start, step, lambda s: F.coalesce(s.fault, F.when((s.path != "") | ~s.done, F.size(tokens))))


def sitemap_contents(files: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """Key, locs (array) and warning (tag, msg; null if the body is well-formed XML).

    A body that is not is read up to its first fault, never given up as a whole.
    """
    tokens = files.where(F.col(body).isNotNull()).select(key, F.regexp_extract_all(body, F.lit(_XML_TOKEN), F.lit(0)).alias("t"))
    judged = tokens.select(key, "t", _xml_fault(F.col("t")).alias("fault"))
    sound = F.when(F.col("fault").isNull(), F.col("t")).otherwise(F.slice("t", 1, F.greatest(F.col("fault"), F.lit(0))))
    # raw text is quoted, so that no tag is seen in it
    quoted = F.transform(F.filter(sound, lambda x: ~x.startswith("<!--")), lambda x: F.when(x.startswith("<![CDATA["), xml_escaped(F.substring(x, 10, F.length(x) - 12))).otherwise(x))
    text = F.array_join(quoted, "")
    read = judged.select(key, "fault", text.alias("text"))
    line = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    warning = F.when(F.col("fault").isNotNull(), F.struct(F.lit("xml-parse-error").alias("tag"), F.concat(F.lit("not well-formed at line "), line).alias("msg")))
    bare = lambda x: F.regexp_replace(resolved(without_markup(x)), r"^\s+|\s+$", "")
    locs = F.filter(F.transform(F.regexp_extract_all("text", F.lit(_LOC), F.lit(1)), bare), lambda x: x != "")
    return read.select(key, locs.alias("locs"), warning.alias("warning"))


def sitemap(files: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """Every loc, of pages or of further sitemaps; of a faulty body those that stand before the fault."""
    return sitemap_contents(files, key, body).select(key, F.posexplode("locs").alias("n", "raw_url"))


def sitemap_warnings(files: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """Key, tag and msg of every body that is not well-formed."""
    return sitemap_contents(files, key, body).where("warning is not null").select(key, "warning.*")


def sitemap_children(indexes: DataFrame, fetches: DataFrame) -> DataFrame:
    """The pages that the children of sitemap indexes name: url of the child, and raw_url; fetches has url and body."""
    children = sitemap(indexes).select(F.col("raw_url").alias("url")).distinct()
    return sitemap(fetches.join(children, "url", "left_semi"))


def wml(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """S7."""
    return links(pages, tables.WML_TAGS, key)


def binary_urls(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Safe URLs anywhere in bytes."""
    text = F.decode(F.col(content), "ISO-8859-1")
    return files.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"(?i){SAFE['url']}"), F.lit(0))).alias("n", "raw_url"))


_ANGLE = re.compile(r"<((?:https?|ftp):[^'\">\s]+)>", re.I)
_DEFINITION = re.compile(r"^ {0,3}\[[^\[\]]+\]:\s*<?(\S+?)>?(?:\s|$)", re.M)
_TITLE = re.compile(r"(?<![ \t])[ \t]+['\"].*$", re.S)  # a run of blanks is tried once


def _closing(text: str, pair: str) -> dict[int, int]:
    """Where each opening bracket is closed."""
    out, stack = {}, []
    for m in re.finditer(rf"[{re.escape(pair)}]", text):
        if m[0] == pair[0]:
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def _markdown_links(text: str) -> list[tuple[int, str, int]]:
    """Where each link begins, its target, and where that stands: at its first character, or at the parenthesis of an inline link."""
    found = [(m.start(), m[1], m.start(1)) for p in (_ANGLE, _DEFINITION) for m in p.finditer(text)]
    if "](" in text:
        brackets, parentheses = _closing(text, "[]"), _closing(text, "()")
        whole = text.removesuffix("\n")
        last = len(whole) - 1 if whole.endswith(")") else -1  # closes what nothing else does
        targets: list[tuple[int, int]] = []  # of links whose text we are in, innermost last
        for i in sorted(brackets):
            while targets and i > targets[-1][1]:
                targets.pop()
            at = brackets[i] + 1
            if targets and i > targets[-1][0] or text[at : at + 1] != "(":
                continue
            end = parentheses.get(at, last)
            if end <= at:
                continue
            url = _TITLE.sub("", text[at + 1 : end].lstrip())
            url = re.sub(r"(?s)^<(.*)>.*", r"\1", url).rstrip() if url.startswith("<") else url
            if url:
                found.append((i, url, at))
                targets.append((at, end))
    once = {at: (k, url) for k, url, at in found}  # a definition's target may stand in angles
    return sorted((k, re.sub(r"[\r\n ]", "", url), at) for at, (k, url) in once.items())


@F.arrow_udf(ArrayType(StructType().add("raw_url", "string").add("at", "integer")))
def _markdown(bodies: pa.Array) -> pa.Array:
    return pa.array([[{"raw_url": url, "at": at} for _, url, at in _markdown_links(b)] if b else [] for b in bodies.to_pylist()], pa.list_(pa.struct([("raw_url", pa.string()), ("at", pa.int32())])))


def markdown(files: DataFrame, key: str = "url", body: str = "body") -> DataFrame:
    """Angle, inline and reference links in order, with lines and columns from 1; a link in a link's text is one too.

    Brackets and parentheses are matched by a stack, in batches of bodies, at any
    depth and in linear time; bodies without brackets do not get there.
    """
    some = files.where(F.col(body).rlike(r"[\[<]")).select(key, F.col(body).alias("_body"))
    each = some.withColumn("_found", _markdown("_body")).select(key, "_body", F.posexplode("_found").alias("n", "x"))
    before = F.left(F.col("_body"), F.col("x.at"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return each.select(key, "n", "x.raw_url", line.alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("col"))


#: Levels of folders that one job goes through.
_LEVELS = 16


def bookmark_json(files: DataFrame, column: str = "body", key: str | None = None) -> DataFrame:
    """(url, name) of all bookmarks below the roots, at any depth; with the file's key, if it is named, as column key.

    A body is parsed once, to a variant.  A job opens the folders of several
    levels, in one pass each; what are folders still is written and opened by the
    next job.  Bodies that are not such JSON have none; see bookmark_faults.
    """
    roots = F.try_variant_get(F.try_parse_json(column), "$.roots", "map<string,variant>")
    name_of = [F.col(key).alias("key")] if key else []
    also = ["key"] if key else []
    node, found = files.select(*name_of, F.explode(F.map_values(roots)).alias("node")), None
    of = lambda name: F.try_variant_get("node", f"$.{name}", "string")
    while True:
        for _ in range(_LEVELS):
            children = F.coalesce(F.try_variant_get("node", "$.children", "array<variant>"), F.array().cast("array<variant>"))
            node = node.select(*also, F.explode(F.when(of("type") == "folder", children).otherwise(F.array("node"))).alias("node"))
        level = kept(node.where(of("type").isin("url", "folder")))
        here = level.where((of("type") == "url") & of("url").isNotNull()).select(*also, of("url").alias("url"), of("name").alias("name"))
        found = here if found is None else found.unionByName(here)
        node = level.where(of("type") == "folder")
        if not node.limit(1).count():
            return found


def bookmark_faults(files: DataFrame, key: str = "url", column: str = "body") -> DataFrame:
    """The bodies that are not bookmark files: no JSON (or nested deeper than the parser's 1000 levels), or without roots."""
    value = F.try_parse_json(column)
    msg = F.when(value.isNull(), "no JSON").when(F.try_variant_get(value, "$.roots", "map<string,variant>").isNull(), "no roots")
    return files.where(F.col(column).isNotNull()).select(key, F.lit("json-parse-error").alias("tag"), msg.alias("msg")).where("msg is not null")


def bookmark_tables(places: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Places (id, url, hidden) joined with bookmarks (fk, title)."""
    joined = places.where((F.col("hidden") == 0) & ~F.col("url").startswith("place:")).join(bookmarks, places.id == bookmarks.fk)
    return joined.select("url", F.coalesce(F.nullif("title", F.lit("")), F.col("url")).alias("name"))


def bookmark_text(files: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """NAME= and then URL=; any other line forgets the name."""
    each = files.select(key, F.posexplode(F.split(body, _LINE)).alias("pos", "raw")).withColumn("raw", F.trim("raw"))
    before = F.lag("raw").over(Window.partitionBy(key).orderBy("pos"))
    got = each.withColumn("before", before).where(F.col("raw").startswith("URL=") & F.col("before").startswith("NAME="))
    return got.select(key, F.substring("raw", 5, 1 << 30).alias("url"), F.substring("before", 6, 1 << 30).alias("name"))


def directory(listing: DataFrame) -> DataFrame:
    """Paths of files as links of their folders."""
    return listing.select(F.regexp_extract("path", "^(.*/)[^/]+/?$", 1).alias("parent_url"), quote(F.regexp_extract("path", "([^/]+/?)$", 1), "/").alias("raw_url"), xml_escaped(F.regexp_extract("path", "([^/]+/?)$", 1)).alias("name")).where("parent_url <> ''")


def files_below(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Path, length and modified of every file below a folder; with content, its bytes too, which are not read else."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))


def folders_of(listing: DataFrame, root: str) -> DataFrame:
    """The paths of the folders between root and the listed files, each once and with a slash at its end."""
    bare = lambda path: F.regexp_replace(path, "^[a-z0-9]+:/+", "/")  # noqa: E731  file:/x and file:///x are the same
    head = F.concat(bare(F.lit(root.rstrip("/"))), F.lit("/"))
    names = F.split(F.substring(bare(F.col("path")), F.length(head) + 1, F.lit(1 << 30)), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda n: F.concat(head, F.array_join(F.slice(names, 1, n), "/"), F.lit("/")))
    return listing.where(bare(F.col("path")).startswith(head) & (F.size(names) > 1)).select(F.explode(up).alias("path")).distinct()


def ftp_listing(lines: DataFrame, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Name, trycwd and tryretr of EPLF, UNIX, MSDOS and VMS lines; others give no row."""
    x = F.col(column)
    facts = F.regexp_extract(x, r"^\+([^\t]*)\t", 1)
    unix = r"^([-bcdlps])\S*\s+.*?\s[A-Z][a-z]{2}\s+\d{1,2}\s+(?:\d{4}|\d{1,2}:\d{2})\s(.+)$"
    dos = r"^\d{2}-\d{2}-\d{2,4}\s+\d{2}:\d{2}[AP]M\s+(<DIR>|\d+)\s+(.+)$"
    vms = r"^([^\s;]+)\.([^\s;.]+);\d+\s+\S"
    kind = F.when(x.startswith("+") & (F.regexp_extract(x, r"^\+[^\t]*\t(.+)$", 1) != ""), "eplf").when(x.rlike(unix), "unix").when(x.rlike(dos), "dos").when(x.rlike(vms), "vms")
    name = (
        F.when(kind == "eplf", F.regexp_extract(x, r"^\+[^\t]*\t(.+)$", 1)).when(kind == "unix", F.when(x.startswith("l"), F.regexp_replace(F.trim(F.regexp_extract(x, unix, 2)), r"^.*? -> ", "")).otherwise(F.trim(F.regexp_extract(x, unix, 2))))
        .when(kind == "dos", F.regexp_extract(x, dos, 2)).when(kind == "vms", F.when(F.regexp_extract(x, vms, 2) == "DIR", F.regexp_extract(x, vms, 1)).otherwise(F.regexp_extract(x, r"^([^\s;]+);", 1)))
    )
    fact = lambda f: F.concat(F.lit(","), facts, F.lit(",")).contains(f",{f},")
    cwd = F.when(kind == "eplf", fact("/")).when(kind == "unix", F.regexp_extract(x, unix, 1).isin("d", "l")).when(kind == "dos", F.regexp_extract(x, dos, 1) == "<DIR>").otherwise(F.regexp_extract(x, vms, 2) == "DIR")
    retr = F.when(kind == "eplf", fact("r")).when(kind == "unix", F.regexp_extract(x, unix, 1).isin("-", "l")).when(kind == "dos", F.regexp_extract(x, dos, 1) != "<DIR>").otherwise(F.regexp_extract(x, vms, 2) != "DIR")
    return lines.where(kind.isNotNull()).select(*keep, x.alias("line"), name.alias("name"), cwd.alias("trycwd"), retr.alias("tryretr"))


def itms_child(url: Column) -> Column:
    """S15."""
    return F.nullif(unquote(F.regexp_extract(part(url, "query"), "(?:^|[&;])url=([^&;]*)", 1)), F.lit(""))


def header_links(fetches: DataFrame) -> DataFrame:
    """Of Link, Refresh and Content-Location headers (lower-case keys)."""
    h = lambda k: F.col("headers")[k]
    link = fetches.where(h("link").isNotNull()).select("url", F.explode(F.regexp_extract_all(h("link"), F.lit(r"<[^>]*>[^,<]*"), F.lit(0))).alias("x")).select(
        "url", F.regexp_extract("x", "<([^>]*)>", 1).alias("raw_url"), F.concat(F.lit("Link: header "), F.regexp_extract("x", r"""rel\s*=\s*["']?([^"';,]*)""", 1)).alias("name"))
    refresh = fetches.select("url", F.regexp_extract(h("refresh"), r"(?i)^\d+;\s*url=(.+)$", 1).alias("raw_url"), F.lit("Refresh: header").alias("name"))
    location = fetches.select("url", h("content-location").alias("raw_url"), F.lit("Content-Location: header").alias("name"))
    return link.unionByName(refresh).unionByName(location).where("raw_url is not null and raw_url <> ''")


def parser_of(content_type: Column, url: Column) -> Column:
    """The parser of a content type; ftp folders are read as html; null if there is none."""
    out = F.lit(None).cast("string")
    for kind, parser in tables.PARSERS.items():
        out = F.when(mime(content_type) == kind, parser).otherwise(out)
    return F.when((part(url, "scheme") == "ftp") & part(url, "path").rlike("(^|/)$"), "html").otherwise(out)


def dispatched(fetches: DataFrame) -> DataFrame:
    """The links of every fetched body by its type, and those of its headers: url, source, line and raw_url.

    fetches has url, content_type, body and headers.  Each scan takes the bodies
    of its parser; types without one have no links.  Markdown is known by its
    name, lines of an FTP listing by the type text/x-ftp-listing, and a link to
    itms-services has its child in its query.
    """
    is_markdown = part(F.col("url"), "path").rlike(r"(?i)\.(markdown|md(own)?|mkdn?)$") & F.coalesce(mime(F.col("content_type")).startswith("text/"), F.lit(True))
    kind = F.when(is_markdown, "markdown").when(F.col("content_type") == "text/x-ftp-listing", "listing").when(part(F.col("url"), "scheme") == "itms-services", "itms").otherwise(parser_of(F.col("content_type"), F.col("url")))
    known = fetches.withColumn("parser", kind)
    of = lambda *names: known.where(F.col("parser").isin(*names))
    none = F.lit(None).cast("int")
    as_pages = lambda df: df.select(F.col("url").alias("page_id"), "url", F.col("body").alias("html"))
    listed = of("listing").select("url", F.explode(F.split("body", _LINE)).alias("line"))
    found = [
        links(as_pages(of("html"))).select("url", F.lit("html").alias("source"), none.alias("line"), "raw_url"),
        wml(as_pages(of("wml"))).select("url", F.lit("wml").alias("source"), none.alias("line"), "raw_url"),
        url_list(of("text")).select("url", F.lit("text").alias("source"), "line", "raw_url"),
        css(of("css")).select("url", F.lit("css").alias("source"), "line", "raw_url"),
        sitemap(of("sitemap", "sitemapindex")).select("url", F.lit("sitemap").alias("source"), none.alias("line"), "raw_url"),
        binary_urls(of("swf").select("url", F.encode("body", "ISO-8859-1").alias("content")), "url").select("url", F.lit("swf").alias("source"), none.alias("line"), "raw_url"),
        bookmark_text(of("opera").withColumnRenamed("url", "path")).select(F.col("path").alias("url"), F.lit("opera").alias("source"), none.alias("line"), F.col("url").alias("raw_url")),
        bookmark_json(of("chromium"), key="url").select(F.col("key").alias("url"), F.lit("chromium").alias("source"), none.alias("line"), F.col("url").alias("raw_url")),
        markdown(of("markdown")).select("url", F.lit("markdown").alias("source"), "line", "raw_url"),
        ftp_listing(listed, keep=("url",)).select("url", F.lit("listing").alias("source"), none.alias("line"), F.concat(quote(F.col("name"), "/"), F.when(F.col("trycwd") & ~F.col("tryretr"), "/").otherwise("")).alias("raw_url")),
        of("itms").select("url", F.lit("itms").alias("source"), none.alias("line"), itms_child(F.col("url")).alias("raw_url")).where("raw_url is not null"),
        header_links(fetches).select("url", F.lit("header").alias("source"), none.alias("line"), "raw_url"),
    ]
    out = None
    for frame in found:
        out = frame if out is None else out.unionByName(frame)
    return out


def all_links(fetches: DataFrame, robots: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Links of bodies and headers, of the sitemap lines of robots.txt (origin, sitemap, line), and of bookmarks (url, name)."""
    maps = robots.select(F.col("origin").alias("url"), F.lit("robots").alias("source"), F.col("line").cast("int").alias("line"), F.col("sitemap").alias("raw_url"))
    marks = bookmarks.select(F.lit(None).cast("string").alias("url"), F.lit("bookmark").alias("source"), F.lit(None).cast("int").alias("line"), F.col("url").alias("raw_url"))
    return dispatched(fetches).unionByName(maps).unionByName(marks)


def sniffed(content_type: Column, body: Column, name: Column) -> Column:
    """By the first 70 characters of plain text and XML, else by extension."""
    head, out = F.left(body, F.lit(70)), F.lit(None).cast("string")
    for kind, pattern in reversed(tables.HEADS):
        out = F.when(head.rlike(pattern), kind).otherwise(out)
    extension, by_name = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), F.lit("application/octet-stream")
    for e, kind in tables.EXTENSIONS.items():
        by_name = F.when(extension == e, kind).otherwise(by_name)
    known = F.coalesce(content_type, by_name)
    return F.when(known.isin("text/plain", "application/xml", "text/xml"), F.coalesce(out, known)).otherwise(known)
