"""Best-fit packing of tokenised documents (operator 10).

Hierarchical residual packing: every partition packs its pieces by best fit,
emits the bins that are nearly full, and hands the underfull others on, whole,
as items of the next round; each round has an eighth of the partitions of the
one before, so that what is left meets in a tree.

What is handed on is bounded without a loss.  Best fit leaves one bin at most
that is half full or less, since a second one would have gone into it; so n
tasks leave n such bins at most.  Two bins over half full never share a
sequence, so all that later rounds can do is to put these n bins somewhere, and
they need n other bins at most; the n emptiest ones serve as well as any.  A
task of a round of n tasks therefore hands on its n emptiest bins, and emits the
others: no later round could have made fewer sequences with them.

Tokens are those of the tokenizers library.  Its pre-tokenizer never joins what
stands on both sides of the start of a run of ASCII white space, so each
distinct chunk ``white space + word`` is encoded once per worker and looked up
from then on; texts with a special token or other white space are encoded
whole.  The table of chunks is emptied when it is full, which changes no ids.

Defined results: null text is empty, and an empty document is the one token 0;
repeated rows and repeated or null ids are packed as documents of their own;
other columns are ignored; an empty table packs to no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .words import chunks

CAPACITY = 2048
#: A bin is handed out once its free room is at most this share of its capacity.
NEARLY = 1 / 128
FAN_IN = 8
#: Pieces of a task of the first round.
TASK_PIECES = 50_000
#: Bytes of text that are encoded at once: words that repeat within them are looked up once.
TOGETHER = 4 << 20
#: Chunks a worker remembers at most, and how many from one task to the next.
REMEMBERED, KEPT = 800_000, 300_000
#: White space that is not ASCII, and control characters that some libraries take for it.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Next to each other, these blanks belong to one run, which must not be cut.
_BLANK_RUN = re.compile(rb"[ \n][ \n]")
#: A word of ASCII letters, and a full stop or comma, which is a token of its own behind a letter.
_WORD = re.compile(rb"(\n?)([A-Za-z]+)([.,]?)")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _bytes(ids: list[int]) -> bytes:
    """As little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of a text as little-endian 32-bit integers, as the tokenizers library makes them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.ends = dict(zip((b"", b".", b","), (b"", *self._ids([".", ","]))))
        self.line_end, self.blank = self._ids(["\n"])[0], self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, chunk: bytes) -> bytes | None:
        """The ids of a plain word, by the tokenizer's model alone."""
        m = _WORD.fullmatch(chunk)
        if not m:
            return None
        newline, word, end = m.groups()
        if end and (stem := self.known.get(newline + word)):
            return stem + self.ends[end]
        ids = [t.id for t in self.tokenize(word.decode() if newline else self.blank + word.decode())]
        return (self.line_end if newline else b"") + _bytes(ids) + self.ends[end]

    def _cut(self, text: str) -> list[bytes] | None:
        """The chunks of a text without their leading blank (but with a leading line end), or None."""
        if _OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return None
        raw = text.encode()
        if raw[:1] in (b" ", b"\n") or raw[-1:] in (b" ", b"\n") or _BLANK_RUN.search(raw):
            return None
        return raw.replace(b"\n", b" \n").split(b" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(x) for x in texts]
        alone = iter(self._ids([x if c is None else c.pop(0).decode() for x, c in zip(texts, cut)]))
        known = self.known
        held = set().union(*filter(None, cut))
        new = [c for c in held if c not in known]
        if len(known) + len(new) > REMEMBERED:
            self.forget()
            known = self.known
            new = [c for c in held if c not in known]
        other = []
        for c in new:
            if (ids := self._word(c)) is None:
                other.append(c)
            else:
                known[c] = ids
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            known.update(zip(part, self._ids([c.decode() if c[:1] == b"\n" else f" {c.decode()}" for c in part])))
        look_up = known.__getitem__
        return [next(alone) if c is None else next(alone) + b"".join(map(look_up, c)) for c in cut]


    def forget(self) -> None:
        """All but the words that were met first, among which are the frequent ones."""
        self.known = dict(islice(self.known.items(), KEPT))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens; the first piece takes the remainder.  With ids, their tokens too."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in chunks(batch, size=TOGETHER):
                out: list[list] = [[], [], [], [], []]
                tokens_of = []
                for doc, tokens in zip(part.column("doc_id").to_pylist(), enc.encode([x or "" for x in part.column("text").to_pylist()])):
                    tokens += end
                    n, at, k = len(tokens) // 4, 0, 0
                    size = (n - 1) % capacity + 1
                    while at < n:
                        for column, value in zip(out, (doc, k, at, size, zlib.crc32(memoryview(tokens)[4 * at : 4 * (at + size)]))):
                            column.append(value)
                        if ids:
                            tokens_of.append(np.frombuffer(tokens, "<i4")[at : at + size])
                        at, k, size = at + size, k + 1, capacity
                columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    columns, names = [*columns, pa.array(tokens_of, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
        enc.forget()  # the worker goes on to other tasks

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + (", ids array<int>" if ids else ""))


_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BIN = pa.schema([("done", pa.bool_()), ("sequence_id", pa.int64()), ("fill", pa.int64()), ("items", pa.list_(_ITEM))])
_BIN_SQL = "done boolean, sequence_id long, fill long, items array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices by bin: each item, largest first, goes where it leaves least room."""
    room: list[int] = []  # sorted distinct rooms of open bins
    open_bins: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect_left(room, sizes[i])
        if k == len(room):
            b, left = len(bins), capacity - sizes[i]
            bins.append([i])
        else:
            r = room[k]
            b = open_bins[r].pop()
            if not open_bins[r]:
                del open_bins[r], room[k]
            bins[b].append(i)
            left = r - sizes[i]
        if left:
            if left not in open_bins:
                open_bins[left] = []
                insort(room, left)
            open_bins[left].append(b)
    return bins


def pack_partition(round_no: int, capacity: int, tasks: int):
    """Packs one partition's bins, given as (fill, items), into fuller ones; the round has so many tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        fills = rows.column("fill").to_numpy()
        items = rows.column("items").combine_chunks()
        if isinstance(items, pa.ChunkedArray):
            items = pa.concat_arrays(items.chunks)
        bins = best_fit(fills.tolist(), capacity)
        order = pa.array(np.concatenate([np.asarray(b) for b in bins]))
        moved = items.take(order)
        each = np.diff(np.concatenate([[0], np.cumsum([len(b) for b in bins])]))
        counts = np.diff(offsets_of(moved))
        at = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, np.concatenate([[0], np.cumsum(each)[:-1]])))])
        fill = np.array([fills[b].sum() for b in bins])
        done = (fill >= capacity - int(capacity * NEARLY)) | (tasks == 1)
        waiting = np.flatnonzero(~done)
        done[waiting[np.argsort(fill[waiting], kind="stable")[tasks + 1 :]]] = True  # its own small bin is the first
        first = (round_no << 56) + (TaskContext.get().partitionId() << 30)
        for a in range(0, len(bins), 20_000):
            b = min(len(bins), a + 20_000)
            flat = moved.flatten().slice(at[a], at[b] - at[a])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(done[a:b]),
                    pa.array(first + np.arange(a, b)),
                    pa.array(fill[a:b]),
                    pa.ListArray.from_arrays(pa.array((at[a : b + 1] - at[a]).astype(np.int32)), flat),
                ],
                schema=_BIN,
            )

    return pack


def offsets_of(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def pack(parts: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` tokens.

    The first round runs on as many tasks as the number of pieces asks for, if
    ``partitions`` does not say; they are dealt out in turn, so that equal
    pieces do not meet in one task.  The rounds end when one task holds what is
    left.  parts should be a written table, since it is counted first.
    """
    n = partitions or max(1, -(-parts.count() // TASK_PIECES))
    left = parts.select(F.col("length").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("items"))
    out, k = None, 0
    while True:
        packed = written(left.repartition(n).sortWithinPartitions(F.desc("fill"), "items").mapInArrow(pack_partition(k, capacity, n), _BIN_SQL), f"packed{k}")
        done = packed.where("done").select("sequence_id", "items")
        out = done if out is None else out.unionByName(done)
        if n == 1:
            break
        left = packed.where("not done").select("fill", "items")
        n, k = -(-n // FAN_IN), k + 1
    placed = F.aggregate("items", F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("offsets")), lambda a, x: F.struct((a.at + x.length).alias("at"), F.concat(a.offsets, F.array(a.at)).alias("offsets"))).offsets
    return out.select("sequence_id", F.explode(F.arrays_zip(F.col("items").alias("item"), placed.alias("offset"))).alias("x")).select("x.item.*", "sequence_id", F.col("x.offset").alias("offset"))


def sequences(parts: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id and the token ids of each sequence, for training.

    parts are pieces with their ids, packed is what pack makes of them.  Equal
    pieces of one id (repeated rows) are told apart by a running number.
    """
    key = ["doc_id", "piece", "start", "ids_crc32"]
    number = lambda df, *by: df.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    a, b = number(parts, "length").alias("a"), number(packed, "sequence_id", "offset").alias("b")
    same = F.col("a.copy") == F.col("b.copy")
    for c in key:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    placed = a.join(b, same).select("b.sequence_id", F.struct("b.offset", "a.ids").alias("x"))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.ids)).alias("ids"))
