"""Bloom filters of 64-bit keys: what cannot match is left out before it is shuffled.

A filter has a bounded number of bits.  More keys than it is made for only let
more rows through, so whatever follows a filter must be exact by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A filter has at most 2 ** MAX_BITS bits (32 MB), 16 for each key up to some 17 million keys.
MAX_BITS = 28
_HALF = 36


def key_filter(keys: DataFrame, most_bits: int = MAX_BITS) -> Broadcast:
    """A filter of the column ``key`` (long), as 64-bit words; keys should be a written table, since it is read twice."""
    bits = 1 << min(most_bits, max(12, int(16 * keys.count()).bit_length()))
    place = lambda c: c.bitwiseAND(F.lit(bits - 1))
    each = keys.select(F.explode(F.array(place(F.col("key")), place(F.shiftrightunsigned("key", _HALF)))).alias("p"))
    words = each.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def might_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; false is certain."""
    keys, mask = keys.view(np.uint64), np.uint64(64 * len(held) - 1)
    out = np.ones(len(keys), bool)
    for p in (keys & mask, (keys >> np.uint64(_HALF)) & mask):
        out &= (held[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def picked(rows: DataFrame, held: Broadcast, key: str, inside: bool = True) -> DataFrame:
    """The rows whose key (a column that is not null) may be in the filter, or those whose key is not."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(might_hold(held.value, batch.column(key).to_numpy()) == inside))

    return rows.mapInArrow(pick, rows.schema)
