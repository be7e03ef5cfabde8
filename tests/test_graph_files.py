"""Graphs written by the named format, from one partition and from many."""

import re
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from weft.operators import graph_files


def read(folder):
    return "".join(p.read_text() for p in sorted(folder.iterdir()) if p.name.startswith("part-"))


def graph(spark, n=500):
    nodes = spark.range(n).select("id", F.when(F.col("id") == 3, 'a "b" <c> & \\\n\x02').when(F.col("id") == 4, None).otherwise(F.concat(F.lit("page "), "id")).alias("label"))
    edges = spark.range(1, n).select(F.floor(F.col("id") / 2).alias("source_id"), F.col("id").alias("target_id"), F.lit("e").alias("label"))
    return nodes, edges


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("kind", sorted(graph_files.KINDS))
def test_graph_parses(spark, tmp_path, kind, parts):
    graph_files.register(spark)
    nodes, edges = graph(spark)
    rows = graph_files.ordered(nodes, edges, parts)
    folder = tmp_path / "g"
    rows.write.format(graph_files.FORMAT).option("kind", kind).mode("append").save(str(folder))
    text = read(folder)
    want_edges = [(i // 2, i) for i in range(1, 500)]
    if kind == "graphxml":
        root = ElementTree.fromstring(text)
        assert [int(x.get("name")) for x in root.iter("node")] == list(range(500)) and [x.find("label").text for x in root.iter("node")][3:5] == ['a "b" <c> & \\\n', None]
        found = [(int(x.get("source")), int(x.get("target"))) for x in root.iter("edge")]
    else:
        lines = text.splitlines()
        head, foot, _, _ = graph_files.KINDS[kind]
        assert lines[0] == head and lines[-1] == foot and len(lines) == 2 + 500 + 499
        node, edge = ((r'  n(\d+) \[label="[^"]*"\];', r'  n(\d+) -> n(\d+) \[label="[^"]*"\];'), (r'  node \[ id (\d+) label "[^"]*" \]', r'  edge \[ source (\d+) target (\d+) label "[^"]*" \]'))[kind == "gml"]
        assert [int(re.fullmatch(node, x)[1]) for x in lines[1:501]] == list(range(500))
        found = [tuple(map(int, re.fullmatch(edge, x).groups())) for x in lines[501:-1]]
    assert found == want_edges
    assert not [p for p in folder.iterdir() if p.name.startswith("_") and p.name != "_SUCCESS"]


def test_modes(spark, tmp_path):
    graph_files.register(spark)
    nodes, edges = graph(spark, 3)
    rows, folder = graph_files.ordered(nodes, edges, 2), tmp_path / "g"
    rows.write.format(graph_files.FORMAT).mode("append").save(str(folder))
    once = read(folder)
    with pytest.raises(Exception, match="not empty"):
        rows.write.format(graph_files.FORMAT).mode("append").save(str(folder))
    rows.write.format(graph_files.FORMAT).mode("overwrite").save(str(folder))
    assert read(folder) == once
    with pytest.raises(Exception, match="no graph is called"):
        rows.write.format(graph_files.FORMAT).option("kind", "svg").mode("append").save(str(tmp_path / "h"))
    graph_files.ordered(nodes.limit(0), edges.limit(0), 1).write.format(graph_files.FORMAT).mode("append").save(str(tmp_path / "none"))
    assert read(tmp_path / "none") == "digraph G {\n}\n"
