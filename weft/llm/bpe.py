"""BPE encoding and decoding through a distinct-word table (operator 8).

A word is a run of other characters than ASCII white space, in lower case as
the tokenizer has it anyway.  Its ids do not depend on its neighbours, so:

1. Documents are read in blocks of about ``BLOCK`` bytes.  A block is the list
   of its distinct words, the most frequent first, and, for every place in its
   documents, a word's number.
2. The blocks' lists are dealt out by word, in ``PARTS`` parts: together they are
   the table of distinct words.  A task goes through its parts one by one and
   encodes every distinct word of a part once.
3. The ids come back to their blocks and are put in by position; ids meet the
   pieces of the vocabulary, whose number is bounded by the vocabulary.

Words travel as packed lists, not as rows of their own: a row for every word
and document would be many times the size of the texts.  The documents are read
once for the lists and once for the places, which takes less disk than to write
both; so they must come out in the same order both times.  A table that is
scanned from files does, also when a stage is run again; anything else is
written first.

Defined results: null and empty texts have no ids; repeated rows get equal
results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .words import chunks

#: Bytes of text in a block.
BLOCK = 32 << 20
#: Parts of the table of distinct words; a task holds the words of one.
PARTS = 2048
_PLAIN = re.compile(rb"([a-z]+)([.,]?)")


class WordEncoder:
    """Ids of words, as the tokenizers library makes them without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, np.ndarray] = {}
        self.ends = {b: np.asarray(self.tokenizer.encode(b.decode(), add_special_tokens=False).ids, "<u4") for b in (b"", b".", b",")}

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        known = self.known
        other = []
        for w in words:
            if w in known:
                continue
            if m := _PLAIN.fullmatch(w):  # one letter run is one piece of the pre-tokenizer, a mark behind it another
                known[w] = np.concatenate([np.asarray([t.id for t in self.tokenizer.model.tokenize(m[1].decode())], "<u4"), self.ends[m[2]]])
            else:
                other.append(w)
        for a in range(0, len(other), 4096):
            part = other[a : a + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                known[w] = np.asarray(e.ids, "<u4")
        return [known[w] for w in words]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte: the high bytes are mostly equal."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return _squeezed(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_loosened(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _loosened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _words(text: bytes) -> list[bytes]:
    # special tokens are known by their exact case, in the text as it stands
    return (text if b"<|" in text else text.lower()).split()


class _Block:
    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.places: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words, numbers = _words(text), self.numbers
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.places.append(np.array([numbers[w] for w in words], "<u4"))
        self.bytes += len(text)

    def close(self) -> tuple[bytes, list[bytes], np.ndarray, np.ndarray]:
        """Its name, words, their parts, and the number of the word at each place."""
        words = list(self.numbers)
        places = np.concatenate([np.zeros(0, "<u4"), *self.places])
        often = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty(len(words), "<u4")
        rank[often] = np.arange(len(words))
        words, places = [words[i] for i in often], rank[places] if len(words) else places
        name = hashlib.blake2b(b"\n".join(words), digest_size=16)
        name.update(places.tobytes())
        name.update(repr((self.ids, self.sizes)).encode())
        return name.digest(), words, np.array([zlib.crc32(w) % PARTS for w in words], np.int64), places


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    block = _Block()
    for batch in batches:
        for part in chunks(batch):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                block.add(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"")
                if block.bytes >= BLOCK:
                    yield block
                    block = _Block()
    if block.ids:
        yield block


_PAGES = "block binary, part int, words binary"
_PLACES = "block binary, docs array<bigint>, sizes binary, parts binary, places binary"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block, by part."""
    for block in _blocks(batches):
        name, words, parts, _ = block.close()
        order = np.argsort(parts, kind="stable")
        edges = np.searchsorted(parts[order], np.arange(PARTS + 1))
        rows = [(p, _squeezed(b"\n".join([words[i] for i in order[a:b]]))) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.binary()), pa.array([p for p, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.binary())], ["block", "part", "words"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block as word numbers."""
    for block in _blocks(batches):
        name, _, parts, places = block.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([name], pa.binary()), pa.array([block.ids], pa.list_(pa.int64())), *(pa.array([_packed(np.asarray(v))], pa.binary()) for v in (block.sizes, parts, places))],
            ["block", "docs", "sizes", "parts", "places"],
        )


def _pieces(tokenizer: str) -> list[bytes]:
    """The vocabulary's pieces, at the places of their ids."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = piece.encode()
    return out


def encode_decode(docs: DataFrame, tokenizer: str, digests: bool = False, scanned: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by blanks) and decoded text of each row.

    With digests, the SHA-256 of both in hexadecimal stands for them
    (ids_sha256, decoded_sha256).  scanned says that docs is a scan of files.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if not scanned:
        docs = written(docs, "texts")
    pieces = spark.sparkContext.broadcast(_pieces(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, now = WordEncoder(tokenizer), None
        for batch in batches:
            out = []
            for part, words in zip(batch.column("part").to_pylist(), batch.column("words")):
                if part != now:  # rows come by part, so no word is met again after its part
                    enc.known.clear()
                    now = part
                ids = enc.encode(_loosened(words.as_buffer()).split(b"\n"))
                out.append(_packed(np.concatenate([[len(ids)], [len(x) for x in ids], *ids])))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(out, pa.binary())], ["block", "part", "ids"])

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    hashed = (lambda b: hashlib.sha256(b).hexdigest()) if digests else bytes.decode

    def put_in(blocks: pa.Table, pages: pa.Table) -> pa.Table:
        found = {p: ids for p, ids in zip(pages.column("part").to_pylist(), pages.column("ids").to_pylist())}
        piece_of = pieces.value
        out: list[list] = [[], [], [], []]
        for row in blocks.to_pylist():
            parts = _unpacked(row["parts"])
            numbers, decoded = [b""] * len(parts), [b""] * len(parts)
            counts = np.zeros(len(parts), np.int64)
            order = np.argsort(parts, kind="stable")
            at = 0
            for p in np.unique(parts).tolist():
                data = _unpacked(found[p])
                n = int(data[0])
                sizes, ids, k = data[1 : n + 1].tolist(), data[n + 1 :].tolist(), 0
                for word, size in zip(order[at : at + n].tolist(), sizes):
                    own = ids[k : k + size]
                    numbers[word] = b" ".join([b"%d" % i for i in own])
                    decoded[word] = b" ".join([piece_of[i] for i in own])
                    counts[word] = size
                    k += size
                at += n
            places, k = _unpacked(row["places"]), 0
            empty = bool((counts == 0).any())
            for doc, size in zip(row["docs"], _unpacked(row["sizes"]).tolist()):
                here = places[k : k + size]
                k += size
                tokens = int(counts[here].sum())
                if empty:
                    here = here[counts[here] > 0]
                here = here.tolist()
                for column, value in zip(out, (doc, tokens, hashed(b" ".join(map(numbers.__getitem__, here))), hashed(b" ".join(map(decoded.__getitem__, here))))):
                    column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_tokens", *names])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = docs.mapInArrow(_pages, _PAGES).repartition(n, "part").sortWithinPartitions("part")
    encoded = table.mapInArrow(encode, "block binary, part int, ids binary")
    return docs.mapInArrow(_places, _PLACES).groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(put_in, f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")
