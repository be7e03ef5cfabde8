"""Statistics, histograms, streaks, and reports."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

COLUMNS = ["urlname", "parentname", "baseref", "result", "warningstring", "infostring", "valid", "url", "line", "column", "name", "dltime", "size", "checktime", "cached", "level", "modified"]
KINDS = ("image", "text", "video", "audio", "application", "mail", "other")


def statistics(records: DataFrame) -> DataFrame:
    """One row; records has valid, warnings (array), url, size, cache_url and printed."""
    n = F.length(F.nullif(F.col("url"), F.lit("")))
    return records.agg(
        F.count("*").alias("number"), F.sum((~F.col("valid")).cast("long")).alias("errors"), F.sum((~F.col("valid") & F.col("printed")).cast("long")).alias("errors_printed"),
        F.sum(F.size("warnings")).alias("warnings"), F.sum(F.when(F.col("printed"), F.size("warnings")).otherwise(0)).alias("warnings_printed"),
        F.min(n).cast("long").alias("min_url"), F.max(n).cast("long").alias("max_url"), F.avg(n).alias("avg_url"), F.sum("size").alias("bytes"), F.countDistinct("cache_url").alias("results"),
    )


#: Precision of sketches of distinct keys: 2 ** SKETCH_BITS registers, a standard error of 0.8 %.
SKETCH_BITS = 14


def volume(records: DataFrame) -> DataFrame:
    """G4 as a state that can be kept and merged: bytes, and a sketch of the result keys; one row."""
    return records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.hll_sketch_agg("cache_url", SKETCH_BITS).alias("keys"))


def merged_volume(states: DataFrame) -> DataFrame:
    """The state of several runs together, each key counted once."""
    return states.agg(F.sum("bytes").alias("bytes"), F.hll_union_agg("keys").alias("keys"))


def volume_of(states: DataFrame) -> DataFrame:
    """Bytes and about how many results a state stands for.

    A sketch that was never merged is estimated by the order of its updates, one that
    was by its registers alone; so each is merged with itself before, and the same
    keys have the same estimate on every way.
    """
    return states.select("bytes", F.hll_sketch_estimate(F.hll_union("keys", "keys")).alias("results"))


def volume_by_key(records: DataFrame) -> DataFrame:
    """G4 as an exact state that can be kept and merged: bytes by result key, one row a key."""
    return records.groupBy("cache_url").agg(F.sum("size").alias("bytes"))


def merged_by_key(states: DataFrame) -> DataFrame:
    """The exact state of several runs together, each key once."""
    return states.groupBy("cache_url").agg(F.sum("bytes").alias("bytes"))


def exact_volume_of(states: DataFrame) -> DataFrame:
    """Bytes and the number of results that an exact state stands for; bytes are null without any."""
    return states.agg(F.sum("bytes").alias("bytes"), F.count("cache_url").alias("results"))


def content_kinds(records: DataFrame) -> DataFrame:
    """Kind and number, with rows for kinds that do not occur."""
    family = F.split_part(scalars.mime(F.col("content_type")), F.lit("/"), F.lit(1))
    kind = F.when(F.col("url").startswith("mailto:"), "mail").when(F.col("content_type").isNotNull() & family.isin(*KINDS), family).otherwise("other")
    all_kinds = records.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return all_kinds.join(records.groupBy(kind.alias("kind")).count(), "kind", "left").select("kind", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def failure_streaks(checks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The failures since each key's last valid check, where there are any.

    By aggregates alone: the last valid place of a key, then the failures behind
    it; a hot key is summed in parts before it is shuffled.
    """
    place = F.struct(*order)
    last = checks.where("valid").groupBy(*key).agg(F.max(place).alias("last_valid"))
    return checks.where("not valid").withColumn("place", place).join(last, key, "left").where("last_valid is null or place > last_valid").groupBy(*key).agg(F.count("*").alias("failures"))


def merged_streaks(previous: DataFrame, checks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The former table brought up to date; a valid check ends a streak."""
    now = failure_streaks(checks, key, order).withColumnRenamed("failures", "new")
    seen = checks.groupBy(*key).agg(F.max(F.col("valid")).alias("was_valid"))
    joined = previous.join(now, key, "full").join(seen, key, "left")
    total = F.when(F.coalesce("was_valid", F.lit(False)), F.coalesce("new", F.lit(0))).otherwise(F.coalesce("failures", F.lit(0)) + F.coalesce("new", F.lit(0)))
    return joined.select(*key, total.cast("int").alias("failures")).where("failures > 0")


def csv_rows(records: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """K1, K9: the 17 columns of a report, messages joined by line ends."""
    out = records.select(
        F.col("raw_url").alias("urlname"), F.col("parent_url").alias("parentname"), F.col("base_ref").alias("baseref"), "result",
        F.array_join(F.transform("warnings", lambda x: x.msg), "\n").alias("warningstring"), F.array_join("info", "\n").alias("infostring"), "valid", "url", "line",
        F.col("col").alias("column"), "name", "dltime", "size", "checktime", F.lit(0).alias("cached"), "level", scalars.modified(F.col("modified")).alias("modified"),
    )
    return out.select(*parts) if parts else out


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", ";").option("quote", '"').option("header", True).csv(path)


def sql_rows(rows: DataFrame) -> DataFrame:
    """K2: empty strings as null, valid as 0 or 1; for ``write.jdbc`` or ``saveAsTable``."""
    return rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in rows.dtypes])


def sql_inserts(rows: DataFrame, table: str = "links") -> DataFrame:
    """K2 as text: one insert statement a row."""
    literal = [scalars.sql_literal(F.col(c)) if t == "string" else F.coalesce(F.col(c).cast("int" if t == "boolean" else "string").cast("string"), F.lit("NULL")) for c, t in rows.dtypes]
    return rows.select(F.concat(F.lit(f"insert into {table}({','.join(rows.columns)}) values ("), F.concat_ws(",", *literal), F.lit(");")).alias("value"))


#: Parts of a record's element that are left out if they have no value, in order.
XML_PARTS = ("name", "parent", "baseref", "dltime", "size", "checktime", "level", "infos", "warnings")


def xml_rows(records: DataFrame) -> DataFrame:
    """K3: the shape of a record's element: url, its place as attributes of parent, infos, warnings with tags, and valid with the result."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    parent = F.when(some("parent_url").isNotNull(), F.struct(F.col("line").alias("_line"), F.col("col").alias("_column"), F.col("parent_url").alias("_VALUE")))
    warned = F.when(F.size("warnings") > 0, F.struct(F.transform("warnings", lambda w: F.struct(w.tag.alias("_tag"), w.msg.alias("_VALUE"))).alias("warning")))
    told = F.when(F.size("info") > 0, F.struct(F.col("info").alias("info")))
    return records.select(
        "url", some("name").alias("name"), parent.alias("parent"), some("base_ref").alias("baseref"), "dltime", "size", "checktime", "level", told.alias("infos"), warned.alias("warnings"),
        F.struct(F.col("result").alias("_result"), F.col("valid").cast("int").alias("_VALUE")).alias("valid"),
    )


def xml_text(records: DataFrame) -> DataFrame:
    """K3: each record's element as text; nulls are left out."""
    return xml_rows(records).select("url", F.to_xml(F.struct("*"), {"rowTag": "urldata"}).alias("value"))


def write_xml(rows: DataFrame, path: str, root: str = "links", row: str = "urldata") -> None:
    """K3, K7: nulls are left out by the writer."""
    rows.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions that stand below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))


def write_table(rows: DataFrame, folder: str) -> str:
    """K8: a new version of a table below the folder, which is what latest reads; readers of older ones are not disturbed.

    Rows are written aside and take the next free number by a rename, which fails
    where another writer has it, so a version is whole or not there.
    """
    spark, folder = rows.sparkSession, folder.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside = hadoop.Path(f"{folder}/_writing-{uuid.uuid4().hex}")
    rows.write.parquet(aside.toString())
    context = hadoop.FileContext.getFileContext(aside.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    number = 1 + max(_versions(spark, folder), default=0)
    while True:
        path = f"{folder}/version-{number:010d}"
        try:
            context.rename(aside, hadoop.Path(path), options)
            return path
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            number += 1


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """K8: the newest version of a table; no other is read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/version-{_versions(spark, folder)[-1]:010d}")


def text_blocks(rows: DataFrame) -> DataFrame:
    """K4: one block of labelled lines a row, without empty parts."""
    lines = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c:<14}"), F.col(c).cast("string"))) for c in rows.columns]
    return rows.select(F.concat_ws("\n", *lines).alias("value"))


def html_blocks(rows: DataFrame) -> DataFrame:
    """K5: one table a row."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<tr><td>{c}</td><td>"), scalars.xml_escaped(F.col(c).cast("string")), F.lit("</td></tr>"))) for c in rows.columns]
    return rows.select(F.concat(F.lit("<table>"), F.concat_ws("", *lines), F.lit("</table>")).alias("value"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K6: a DOT graph as numbered lines; gml_lines and graphxml_lines alike."""
    label = lambda c: scalars.graph_label(F.col(c))
    return _graph(nodes.select(F.col("id"), F.concat(F.lit("  n"), "id", F.lit(' [label="'), label("label"), F.lit('"];')).alias("value")),
                  edges.select(F.col("target_id").alias("id"), F.concat(F.lit("  n"), "source_id", F.lit(" -> n"), "target_id", F.lit(' [label="'), label("label"), F.lit('"];')).alias("value")), "digraph G {", "}")


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _graph(nodes.select("id", F.concat(F.lit("  node [ id "), "id", F.lit(' label "'), scalars.graph_label(F.col("label")), F.lit('" ]')).alias("value")),
                  edges.select(F.col("target_id").alias("id"), F.concat(F.lit("  edge [ source "), "source_id", F.lit(" target "), "target_id", F.lit(' label "'), scalars.graph_label(F.col("label")), F.lit('" ]')).alias("value")), "graph [ directed 1", "]")


def graphxml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _graph(nodes.select("id", F.concat(F.lit('  <node name="'), "id", F.lit('"><label>'), scalars.xml_escaped(F.col("label")), F.lit("</label></node>")).alias("value")),
                  edges.select(F.col("target_id").alias("id"), F.concat(F.lit('  <edge source="'), "source_id", F.lit('" target="'), "target_id", F.lit('"/>')).alias("value")), "<GraphXML><graph isDirected=\"true\">", "</graph></GraphXML>")


def _graph(nodes: DataFrame, edges: DataFrame, head: str, foot: str) -> DataFrame:
    ends = nodes.sparkSession.createDataFrame([(0, None, head), (3, None, foot)], "part int, id long, value string")
    return ends.unionByName(nodes.select(F.lit(1).alias("part"), "id", "value")).unionByName(edges.select(F.lit(2).alias("part"), "id", "value"))


def sitemap(records: DataFrame) -> DataFrame:
    """Valid HTML pages below the first URL (by seq); that has priority 1.0, others 0.5; lastmod where modified is known.

    The first URL is one row by an aggregate, so the join has one row on a side.
    """
    first = records.agg(F.min_by("url", "seq").alias("first_url"))
    fits = records.join(F.broadcast(first)).where(
        F.col("first_url").rlike("^https?://") & F.col("valid") & F.col("url").startswith(F.col("first_url")) & scalars.mime(F.col("content_type")).isin("text/html", "application/xhtml+xml"))
    when = scalars.modified(F.col("modified"), "T") if "modified" in records.columns else F.lit(None).cast("string")
    return fits.groupBy("url").agg(F.min("seq").alias("seq"), F.first("first_url").alias("first_url"), F.max(when).alias("lastmod")).select(
        F.col("url").alias("loc"), "lastmod", F.lit("daily").alias("changefreq"), F.when(F.col("url") == F.col("first_url"), "1.00").otherwise("0.50").alias("priority"))


def chosen(rows: DataFrame, parts: list[str]) -> DataFrame:
    """K9."""
    return rows.select(*[c for c in parts if c in rows.columns])
