"""Train and test splits, and bounded samples for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def sample(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most n rows, those with the least hash of their key; ties by key."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def sample_texts(docs: DataFrame, n: int, *also: str, ids: DataFrame | None = None) -> DataFrame:
    """doc_id, text and the columns ``also`` of at most n rows of docs, all different, of the given doc_ids if there are any.

    Only ids and hashes are shuffled, sorted and broadcast, n of them at most; an
    id may be null, or be repeated with the same or other texts.
    """
    key = ["doc_id", "_hash", *also]
    hashed = docs.select("doc_id", "text", *also, F.xxhash64("text").alias("_hash"))
    keys = hashed.select(*key).distinct()
    if ids is not None:
        keys = keys.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = keys.orderBy(F.xxhash64(*key), *key).limit(n).withColumnsRenamed({c: f"_{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return hashed.join(F.broadcast(chosen), same, "left_semi").dropDuplicates(key).drop("_hash")
