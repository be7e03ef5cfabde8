"""Graphs as files by a named format (P4, K6): ``lines.write.format("weft-graph")``.

A graph is a table of nodes (id, label; source null) and edges (source, id,
label).  Every partition is a file, named by its place, and the committed write
adds the head before and the foot behind all of them, so that the files in the
order of their names are one graph.  ``ordered`` deals nodes out before edges.

A task writes to a name of its own, which only the commit makes a part, so tasks
that are run again leave nothing behind.  Paths may be of any file system that
pyarrow knows and all executors see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "weft-graph"
SCHEMA = "source long, id long, label string"


def _words(text: str | None) -> str:
    """A label without marks that end it."""
    return (text or "").replace("\\", " ").replace('"', "'").replace("\n", " ").replace("\r", " ").strip()


def _escaped(text: str | None) -> str:
    kept = "".join(c for c in text or "" if c >= " " or c in "\t\n\r")
    return kept.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


#: By kind: head, foot, and a node's and an edge's line.
KINDS = {
    "dot": ("digraph G {", "}", lambda r: f'  n{r.id} [label="{_words(r.label)}"];', lambda r: f'  n{r.source} -> n{r.id} [label="{_words(r.label)}"];'),
    "gml": ("graph [ directed 1", "]", lambda r: f'  node [ id {r.id} label "{_words(r.label)}" ]', lambda r: f'  edge [ source {r.source} target {r.id} label "{_words(r.label)}" ]'),
    "graphxml": (
        '<GraphXML><graph isDirected="true">', "</graph></GraphXML>",
        lambda r: f'  <node name="{r.id}"><label>{_escaped(r.label)}</label></node>', lambda r: f'  <edge source="{r.source}" target="{r.id}"/>',
    ),
}


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite, self.run = path.rstrip("/"), kind, overwrite, uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator[Row]) -> _Part:
        place, folder = self._place()
        _, _, node, edge = KINDS[self.kind]
        task = TaskContext.get()
        part = _Part(task.partitionId(), f"{folder}/_{self.run}-{task.partitionId()}-{task.taskAttemptId()}")
        place.create_dir(folder)
        with place.open_output_stream(part.name) as out:
            for row in iterator:
                out.write(f"{(node if row.source is None else edge)(row)}\n".encode())
        return part

    def commit(self, messages: list[_Part | None]) -> None:
        place, folder = self._place()
        place.create_dir(folder)
        old = [f.path for f in place.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith("_")]
        if old and not self.overwrite:
            raise FileExistsError(f"{self.path} is not empty")
        for path in old:
            place.delete_file(path)
        head, foot, _, _ = KINDS[self.kind]
        parts = sorted((m for m in messages if m), key=lambda m: m.number)
        for m in parts:
            place.move(m.name, f"{folder}/part-{m.number + 1:08d}")
        for name, line in ((f"part-{0:08d}", head), (f"part-{10**8 - 1:08d}", foot)):
            with place.open_output_stream(f"{folder}/{name}") as out:
                out.write(f"{line}\n".encode())
        with place.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(json.dumps({"parts": len(parts)}).encode())

    def abort(self, messages: list[_Part | None]) -> None:
        place, _ = self._place()
        for m in messages:
            if m:
                place.delete_file(m.name)


class GraphFiles(DataSource):
    """Options: path, and kind (dot, gml, graphxml)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        kind = self.options.get("kind", "dot")
        if kind not in KINDS:
            raise ValueError(f"no graph is called {kind}; there are {', '.join(KINDS)}")
        return _Writer(self.options["path"], kind, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GraphFiles)


def ordered(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Nodes (id, label) by their ids and then edges (source_id, target_id, label) by where they lead, as ranges of rows to be written."""
    rows = nodes.select(F.lit(None).cast("long").alias("source"), "id", "label").unionByName(edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("id"), "label"))
    key = [F.col("source").isNotNull(), F.col("id")]
    dealt = rows.repartitionByRange(parts, *key) if parts else rows.repartitionByRange(*key)
    return dealt.sortWithinPartitions(*key).select("source", "id", "label")
