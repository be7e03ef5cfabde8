"""Divergence of sources within a language (operator 12).

A term is a run of ASCII letters and other than ASCII characters, A-Z in lower
case.  A language keeps the terms that at least ``LEAST_DOCS`` of its documents
hold.  With n occurrences of a kept term in a group (language and source), N of
all V kept terms, a group gives the term the weight

    p = 1 + floor(SCALE * (n + 1) / (N + V)),

also where n is 0, and so does the language with its own counts.  p departs from
another weight q by f = floor((p - q) * (p - q) / q).  Reported are, for each
group, the sum of f against each other source of its language (part ``pair``)
and the terms that it favours most against its language (part ``term``).

1. Inside ``mapInArrow`` texts are lowered, split and dictionary-encoded by
   Arrow's compute functions, and two hash aggregates count each term's
   occurrences and documents by group.  A task hands on partial counts.
2. Partial counts are summed by group and term, dealt out by language and term,
   where a window adds up a term over its language.
3. What is kept is cut into columnar shards by language and a hash of the term.
   A shard meets its language's list of sources, lays its counts out as a matrix
   of terms by sources, and computes its part of all pairs and its own best
   terms; a sum and a rank over the shards end it.

Shards have a bounded number of rows, whatever the size of a language or source.
All sums are of whole numbers and exact, for up to 9e12 occurrences of a language.

Defined results: null texts, languages and sources are taken as ''; every group
of the table is reported, also without terms; a language without kept terms has
the value 0 for its pairs; repeated rows are documents of their own; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .words import chunks

#: What stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 3
SCALE = 1_000_000_000
#: Ranks of part term.
TOP = 200
#: Rows of a shard, about, and cells of its matrix that are computed at once.
SHARD_ROWS = 250_000
CELLS = 1 << 20
#: Rows of partial counts that a task gathers before it merges them, and that it holds merged before it hands them on.
GATHERED, HELD = 1 << 18, 1 << 20

_COUNTS = "lang string, source string, term string, n long, docs long"
_NAMES = ["lang", "source", "term", "n", "docs"]


def _counted(part: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each term by group; a group's empty term has none and stands for the group."""
    lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    pieces = pc.split_pattern_regex(pc.ascii_lower(part.column("text").fill_null("")), BETWEEN)
    term = pc.list_flatten(pieces).dictionary_encode()
    table = pa.table({"doc": pc.list_parent_indices(pieces), "term": term.indices})
    by_doc = table.group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    doc = by_doc.column("doc").combine_chunks()
    held = pa.table({"lang": lang.indices.take(doc), "source": source.indices.take(doc), "term": by_doc.column("term"), "n": by_doc.column("count_all")})
    by_group = held.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")]).combine_chunks()
    named = [x.dictionary.take(by_group.column(c).combine_chunks()) for c, x in (("lang", lang), ("source", source), ("term", term))]
    found = pa.table([*named, by_group.column("n_sum"), by_group.column("n_count")], _NAMES).filter(pc.not_equal(named[2], ""))
    groups = pa.table([part.column("lang"), part.column("source")], ["lang", "source"]).group_by(["lang", "source"], use_threads=False).aggregate([])
    none = pa.array([0] * groups.num_rows, pa.int64())
    marks = pa.table([groups.column("lang"), groups.column("source"), pa.array([""] * groups.num_rows), none, none], _NAMES)
    return pa.concat_tables([found, marks])


def _merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns(_NAMES)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    merged = 0
    for batch in batches:
        for part in chunks(batch):
            held.append(_counted(part))
            if sum(t.num_rows for t in held) - merged > GATHERED:
                held = [_merged(held)]
                merged = held[0].num_rows
                if merged > HELD:
                    yield from held[0].to_batches(65536)
                    held, merged = [], 0
    if held:
        yield from _merged(held).to_batches(65536)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs of every term of every group, and of each group an empty term without any."""
    texts = docs.select("text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    partial = texts.mapInArrow(_partial, _COUNTS)
    return partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def weights(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """p of counts, whose groups have so many occurrences and terms in all; in steps that stay within 64 bits."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + whole
    return 1 + out


def departures(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_PARTS = "lang string, source string, part string, item string, value long"


def _shard(key: tuple, kept: pa.Table, groups: pa.Table) -> pa.Table:
    """A shard's part of all pairs of its language's sources, and the best of its terms by source."""
    groups = groups.sort_by("source")
    names, total = groups.column("source").to_pylist(), groups.column("n").to_numpy() + groups.column("v").to_numpy()
    k, lang = len(names), key[0]
    sums, best = np.zeros((k, k), np.int64), []
    if kept.num_rows:
        all_total = groups.column("lang_n")[0].as_py() + groups.column("v")[0].as_py()
        terms = kept.column("term").combine_chunks().dictionary_encode()
        code = terms.indices.to_numpy()
        row_of = pc.index_in(kept.column("source"), groups.column("source").combine_chunks()).to_numpy()
        n, lang_n = kept.column("n").to_numpy(), np.zeros(len(terms.dictionary), np.int64)
        lang_n[code] = kept.column("lang_n").to_numpy()
        texts = np.array(terms.dictionary.to_pylist(), object)
        order = np.argsort(code, kind="stable")
        step = max(1, CELLS // k)
        for a in range(0, len(texts), step):
            b = min(a + step, len(texts))
            here = order[np.searchsorted(code[order], a) : np.searchsorted(code[order], b)]
            counts = np.zeros((b - a, k), np.int64)
            counts[code[here] - a, row_of[here]] = n[here]
            p = weights(counts, total)
            for s in range(k):
                sums[s] += departures(p[:, s : s + 1], p).sum(axis=0)
            q = weights(lang_n[a:b], all_total)[:, None]
            term, source = np.nonzero((counts > 0) & (p > q))
            best.append((source, texts[a:b][term], departures(p[term, source], q[term, 0])))
    pairs = ~np.eye(k, dtype=bool)
    s, t = np.nonzero(pairs)
    rows = [pa.table([[lang] * len(s), [names[i] for i in s], ["pair"] * len(s), [names[i] for i in t], sums[pairs]], schema=_SCHEMA)]
    if best:
        source, item, value = (np.concatenate([x[i] for x in best]) for i in range(3))
        utf8 = np.array([x.encode() for x in item], object)
        order = np.lexsort((utf8, -value, source)) if len(source) else np.zeros(0, np.int64)
        rank = np.arange(len(order)) - np.searchsorted(source[order], source[order])
        order = order[rank < TOP]
        rows.append(pa.table([[lang] * len(order), [names[i] for i in source[order]], ["term"] * len(order), item[order].tolist(), value[order]], schema=_SCHEMA))
    return pa.concat_tables(rows)


_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part (pair, term), item, value and rank; see the module."""
    whole = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"lang_n": F.sum("n").over(whole), "lang_docs": F.sum("docs").over(whole), "first": (F.col("source") == F.min("source").over(whole)).cast("long")})
    kept = written(counts.where((F.col("term") == "") | (F.col("lang_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n", "first"), "counts")
    real = F.col("term") != ""
    langs = kept.groupBy("lang").agg(F.sum(F.when(real, F.col("first")).otherwise(0)).alias("v"), F.sum("n").alias("lang_n"))
    groups = written(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")).join(langs, "lang"), "groups")
    shards = 1 + kept.count() // SHARD_ROWS
    each = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")
    cut = kept.where(real).select("lang", "source", "term", "n", "lang_n", shard.alias("shard"))
    parts = written(cut.groupBy("lang", "shard").cogroup(each.groupBy("lang", "shard")).applyInArrow(_shard, _PARTS), "divergences")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(parts.where("part = 'term'")).where(F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")
