"""Token counts through a table of distinct pre-tokens (operator 11).

A pre-token is what the tokenizer looks up by itself: a run of letters, one
digit, a run of other marks, or an English contraction's end.  Its number of
pieces depends on nothing around it, so:

1. Documents are read in blocks of about ``BLOCK`` bytes.  A block's distinct
   pre-tokens are dealt out in ``PARTS`` parts by their hash: together they are
   the table of distinct pre-tokens.  A task goes through its parts one by one
   and counts the pieces of every distinct pre-token of a part once.
2. A block's other half is the frequency of each pre-token in each document.
   It joins the block's counts, and frequency times count is summed by document.

No ids are made, only counts.  Both halves travel as packed columns, by block
and part: a row for each document and pre-token would be many times the size of
the texts.  Texts are cut by a few passes over their bytes; words with bytes
beyond printable ASCII, or with what may begin a special token, stay whole and
are cut by the tokenizer itself when they are counted.  Within a block, 64-bit
hashes stand for pre-tokens.

The documents are read once for each half, so they must come out in the same
order both times: a table that is scanned from files does, also when a stage is
run again; anything else is written first.

Defined results: null and empty texts have no bytes and no tokens; repeated rows
get equal results, null ids a row of their own; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _loosened, _packed, _squeezed, _unpacked
from .scratch import written
from .words import CHUNK, Words, chunks, offsets

#: Bytes of text in a block.
BLOCK = 32 << 20
#: Parts of the table of distinct pre-tokens; a task holds the pre-tokens of one.
PARTS = 2048
#: Tokens of a document up to the limit of a sequence.
LIMIT = 2048

_GAP, _LETTER, _DIGIT, _MARK, _HARD = range(5)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[9, 10, 11, 12, 13, 32]] = _GAP
_PLAIN = re.compile(rb"[!-~]+")
_WHITE = re.compile(rb"[\x09-\x0D\x20]")
# What stands behind an apostrophe in a contraction, by its length.
_ENDS = {1: (b"s", b"t", b"m", b"d"), 2: (b"re", b"ve", b"ll")}


class PreTokens(Words):
    """The pre-tokens of a batch of texts, as spans of their bytes in lower case (A-Z)."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, lower=True)
        if not len(self.start):
            return
        data, at = texts.fill_null("").buffers()[2], offsets(texts.fill_null(""))
        given = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        kind = _KIND[self.raw]
        opens = np.zeros(len(kind), bool)
        opens[:-1] = (given[:-1] == ord("<")) & (given[1:] == ord("|"))
        first, last = self.start, self.end
        total = np.zeros(len(kind) + 1, np.int32)
        np.cumsum((kind == _HARD) | opens, out=total[1:])
        hard = total[last] > total[first]
        np.cumsum(opens, out=total[1:])
        for w in np.flatnonzero(total[last] > total[first]):  # special tokens are known by their case
            self.raw[first[w] : last[w]] = given[first[w] : last[w]]
        begins = np.zeros(len(kind), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[first] = True
        begins &= kind != _GAP
        self._contractions(kind, begins)
        start = np.flatnonzero(begins)
        word = np.searchsorted(first, start, "right") - 1
        own = ~hard[word] | (start == first[word])
        self.start, word = start[own], word[own]
        self.end = np.minimum(np.append(self.start[1:], len(kind)), last[word])
        self.doc = self.doc[word]

    def _contractions(self, kind: np.ndarray, begins: np.ndarray) -> None:
        """An apostrophe by itself takes a contraction's end with it; what letters are left begin anew."""
        raw = np.append(self.raw, np.zeros(3, np.uint8))
        letters, starts = np.append(kind, np.zeros(3, np.uint8)) == _LETTER, np.append(begins, np.zeros(3, bool))
        at = np.flatnonzero(self.raw == ord("'"))
        at = at[begins[at] & letters[at + 1] & starts[at + 1]]
        heads = np.isin(at + 1, self.start)  # the letter begins a word of the next text
        at = at[~heads]
        for n, ends in _ENDS.items():
            for end in ends:
                fits = at
                for i, c in enumerate(end):
                    fits = fits[(raw[fits + 1 + i] == c) & letters[fits + 1 + i] & (i == 0 or ~starts[fits + 1 + i])]
                begins[fits + 1] = False
                rest = fits[letters[fits + 1 + n] & ~starts[fits + 1 + n]]
                begins[rest + 1 + n] = True


def _pieces_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Texts of a batch by about CHUNK bytes, with their rows; longer ones are cut at white space."""
    row = 0
    for part in chunks(batch):
        texts = part.column("text")
        if part.num_rows > 1 or not texts[0].is_valid or texts[0].as_buffer().size <= 2 * CHUNK:
            yield np.arange(row, row + part.num_rows), texts
        else:
            data, a = texts[0].as_buffer().to_pybytes(), 0
            while a < len(data):
                cut = _WHITE.search(data, a + CHUNK)
                b = cut.start() if cut else len(data)
                yield np.array([row]), pa.array([data[a:b]], pa.large_binary()).view(pa.large_string())
                a = b
        row += part.num_rows


class _Block:
    """Distinct pre-tokens of some documents by hash; with frequencies, those of each document too."""

    def __init__(self, frequencies: bool):
        self.frequencies = frequencies
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.hashes = np.zeros(0, np.uint64)
        self.texts: list[bytes] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, rows: np.ndarray, texts: pa.Array) -> None:
        """rows: the places of the texts among the block's documents."""
        cut = PreTokens(texts)
        hashes, first, number = np.unique(cut.hashes(), return_index=True, return_inverse=True)
        new = ~np.isin(hashes, self.hashes, assume_unique=True)
        if self.frequencies:
            pair, times = np.unique(rows[cut.doc].astype(np.int64) * max(1, len(hashes)) + number, return_counts=True)
            self.found.append((pair // max(1, len(hashes)), hashes[pair % max(1, len(hashes))], times))
        else:
            raw = cut.raw.tobytes()
            self.texts += [raw[a:b] for a, b in zip(cut.start[first[new]].tolist(), cut.end[first[new]].tolist())]
        self.hashes = np.concatenate([self.hashes, hashes[new]])

    def order(self) -> np.ndarray:
        """The pre-tokens by part and hash."""
        return np.lexsort((self.hashes, self.hashes % np.uint64(PARTS)))

    def name(self) -> bytes:
        out = hashlib.blake2b(np.sort(self.hashes).tobytes(), digest_size=16)
        out.update(repr((self.ids, self.sizes)).encode())
        return out.digest()


def _blocks(batches: Iterator[pa.RecordBatch], frequencies: bool) -> Iterator[_Block]:
    block = _Block(frequencies)
    for batch in batches:
        ids, sizes = batch.column("doc_id").to_pylist(), np.diff(offsets(batch.column("text").fill_null(""))).tolist()
        done = -1
        base = len(block.ids)
        for rows, texts in _pieces_of(batch):
            if rows[0] > done and block.bytes >= BLOCK:
                yield block
                block = _Block(frequencies)
                base = -int(rows[0])
            for r in rows[rows > done].tolist():
                block.ids.append(ids[r])
                block.sizes.append(sizes[r])
                block.bytes += sizes[r]
            done = int(rows[-1])
            block.add(rows + base, texts)
    if block.ids:
        yield block


_TABLE = "block binary, part int, texts binary"
_FREQUENCIES = "block binary, docs array<bigint>, sizes array<bigint>, doc binary, pretoken binary, times binary"


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pre-tokens of each block, by part."""
    for block in _blocks(batches, False):
        order = block.order()
        parts = (block.hashes[order] % np.uint64(PARTS)).astype(np.int64)
        edges = np.searchsorted(parts, np.arange(PARTS + 1))
        rows = [(p, _squeezed(b"\n".join([block.texts[i] for i in order[a:b]]))) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([block.name()] * len(rows), pa.binary()), pa.array([p for p, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.binary())], ["block", "part", "texts"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pre-token, by its number in the block's order, is in each document."""
    for block in _blocks(batches, True):
        order = block.order()
        by_hash = np.argsort(block.hashes)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        doc, hashes, times = (np.concatenate([x[i] for x in block.found]) if block.found else np.zeros(0, np.int64) for i in range(3))
        place = number[by_hash[np.searchsorted(block.hashes, hashes, sorter=by_hash)]] if len(hashes) else hashes.astype(np.int64)
        place_order = np.lexsort((place, doc))
        doc, place, times = doc[place_order], place[place_order], times[place_order]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block.name()], pa.binary()), pa.array([block.ids], pa.list_(pa.int64())), pa.array([block.sizes], pa.list_(pa.int64())), *(pa.array([_packed(v)], pa.binary()) for v in (doc, _steps(place), times))],
            ["block", "docs", "sizes", "doc", "pretoken", "times"],
        )


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences modulo 2 ** 32, which pack better than the numbers."""
    return np.diff(values, prepend=0) % (1 << 32)


class PieceCounter:
    """Numbers of pieces, as the tokenizers library makes them without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def count(self, texts: list[bytes]) -> list[int]:
        known, tokenize, hard = self.known, self.tokenizer.model.tokenize, []
        for t in texts:
            if t not in known:
                if _PLAIN.fullmatch(t) and b"<|" not in t:  # printable ASCII stands for itself in the tokenizer's alphabet
                    known[t] = len(tokenize(t.decode()))
                else:
                    hard.append(t)
        for a in range(0, len(hard), 4096):
            part = hard[a : a + 4096]
            for t, e in zip(part, self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in part], add_special_tokens=False)):
                known[t] = len(e.ids)
        return [known[t] for t in texts]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, scanned: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; scanned says that docs is a scan of files."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if not scanned:
        docs = written(docs, "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, now = PieceCounter(tokenizer), None
        for batch in batches:
            out = []
            for part, texts in zip(batch.column("part").to_pylist(), batch.column("texts")):
                if part != now:  # rows come by part, so no pre-token is met again after its part
                    counter.known.clear()
                    now = part
                out.append(_packed(np.array(counter.count(_loosened(texts.as_buffer()).split(b"\n")))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(out, pa.binary())], ["block", "part", "counts"])

    def summed(blocks: pa.Table, counted: pa.Table) -> pa.Table:
        by_part = dict(zip(counted.column("part").to_pylist(), counted.column("counts").to_pylist()))
        counts = np.concatenate([np.zeros(0, "<u4"), *(_unpacked(by_part[p]) for p in sorted(by_part))]).astype(np.int64)
        out = []
        for row in blocks.to_pylist():
            doc, place, times = (_unpacked(row[c]).astype(np.int64) for c in ("doc", "pretoken", "times"))
            n = np.zeros(len(row["docs"]), np.int64)
            np.add.at(n, doc, counts[np.cumsum(place) % (1 << 32)] * times)
            out.append(pa.table({"doc_id": pa.array(row["docs"], pa.int64()), "n_bytes": pa.array(row["sizes"], pa.int64()), "n_tokens": n, "over_limit": n > limit}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "over_limit": pa.array([], pa.bool_())})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = docs.mapInArrow(_table, _TABLE).repartition(n, "part").sortWithinPartitions("part")
    counted = table.mapInArrow(count, "block binary, part int, counts binary")
    return docs.mapInArrow(_frequencies, _FREQUENCIES).groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(summed, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
