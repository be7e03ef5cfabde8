"""Removal of repeated passages by suffix automata (operator 9).

A window of words that also starts anywhere else is covered for removal.  Every
window is owned by its anchor, the leftmost of the smallest hashes of the short
word runs in it; equal windows have equal anchors at equal places.  The windows
that one anchor owns in one place are consecutive; they and the words they
cover are a context.  So only contexts whose anchor hash stands twice or more
can hold a repeated window.

These contexts are the reference shards: they are dealt out by anchor, a task
builds a suffix automaton over the distinct contexts of an anchor, with the
number of places of each, streams each context through it, and takes the
matching statistics of what occurs twice or more.  (An anchor with one distinct
context needs none: that context stands twice or more, as a whole.)  Automata over a whole corpus could not be broadcast in bounded memory,
and every document would have to pass each of them, so each is built where its
shard's contexts are, and only these meet it.  An anchor with more contexts than
SHARD is cut into several shards; the windows that were single in theirs are
then counted across shards by a 128-bit hash, with partial sums.

Texts are read three times and not shuffled: for the anchors, for the contexts
of those that stand twice or more, and for the words of one place of each
context.  Bloom filters of bounded size keep the others back before any shuffle.

Defined results: null and empty texts have no words; repeated rows are equal
documents, and their windows repeat; ids may be null or repeated; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import key_filter, might_hold, picked
from .scratch import written
from .words import _BASE, _BASE_INVERSE, Words, chunks, mix, powers, runs

#: Words of a window, and of the short runs from which anchors are chosen.
WINDOW = 50
ANCHOR = 8
#: Distinct contexts of one automaton.
SHARD = 500
#: Bytes of text of which a task finds the contexts at once.
SLICE = 1 << 18
#: Windows that are looked at together.
STARTS = 1 << 17

_CONTEXT = "doc_id long, text_hash int, start int, n int, anchor long, context long, place long"


def _crc(column: pa.Array) -> list[int]:
    return [zlib.crc32(x.as_buffer() or b"") - (1 << 31) if x.is_valid else 0 for x in column.cast(pa.large_binary())]


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost smallest of each width consecutive values stands."""
    place, have = np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        a, b = place[:-step], place[step:]
        place = np.where(values[a] <= values[b], a, b)
        have += step
    return place


@dataclass
class _Found:
    """The contexts of a batch of texts."""

    hashes: np.ndarray  # of all words
    first: np.ndarray  # first word
    n: np.ndarray  # windows
    columns: dict[str, np.ndarray]


def _find(part: pa.RecordBatch, window: int, anchor: int) -> Iterator[_Found]:
    """In pieces of at most STARTS windows: a long text is not held in many arrays at once.

    A context that is cut between two pieces is two contexts of one anchor,
    which are judged like any others.
    """
    words = Words(part.column("text"))
    if len(words) < window:
        return
    hashes = words.hashes()
    ids = part.column("doc_id").fill_null(-1).to_numpy().astype(np.int64)
    crcs = np.array(_crc(part.column("text")), np.int64)
    for a in range(0, len(words) - window + 1, STARTS):
        b = min(a + STARTS, len(words) - window + 1)
        here = hashes[a : b + window - 1]
        grams = runs(here, anchor)
        owner = _leftmost_least(grams, window - anchor + 1)
        doc = words.doc[a : b + window - 1]
        whole = np.flatnonzero(doc[: b - a] == doc[window - 1 :])
        if not len(whole):
            continue
        owner = owner[whole]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[whole[1:]] != doc[whole[:-1]])])
        at = np.flatnonzero(new)
        start, n = whole[at], np.diff(np.append(at, len(whole)))
        row = doc[start]
        own = start + a - words.first[row]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(here * powers(_BASE, len(here)))])
            context = mix((sums[start + n + window - 1] - sums[start]) * powers(_BASE_INVERSE, len(here))[start] + n.astype(np.uint64))
            place = mix(mix(ids[row].view(np.uint64)) ^ mix(((crcs[row] << 32) ^ own).view(np.uint64)) + context)
        yield _Found(here, start, n, {"row": row, "text_hash": crcs[row], "start": own, "n": n, "anchor": grams[owner[at]].view(np.int64), "context": context.view(np.int64), "place": place.view(np.int64)})


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """The anchor hash of every context."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=SLICE):
                for found in _find(part, window, anchor):
                    yield pa.RecordBatch.from_arrays([pa.array(found.columns["anchor"])], ["anchor"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "anchor long")


def contexts(docs: DataFrame, window: int, anchor: int, shared: Broadcast) -> DataFrame:
    """The contexts whose anchors pass the filter: start of the first window and their number, anchor hash, hash of all words covered, and a hash of the place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=SLICE):
                for found in _find(part, window, anchor):
                    keep = np.flatnonzero(might_hold(shared.value, found.columns["anchor"]))
                    c = {k: v[keep] for k, v in found.columns.items()}
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array(c["row"])), *(pa.array(c[k].astype(np.int32)) for k in ("text_hash", "start", "n")),
                            *(pa.array(c[k]) for k in ("anchor", "context", "place")),
                        ],
                        ["doc_id", "text_hash", "start", "n", "anchor", "context", "place"],
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, _CONTEXT)


def context_words(docs: DataFrame, window: int, anchor: int, places: Broadcast) -> DataFrame:
    """anchor, context and its word hashes, at the places that pass the filter; from equal rows of a task once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for part in chunks(batch, size=SLICE):
                for found in _find(part, window, anchor):
                    keep = np.flatnonzero(might_hold(places.value, found.columns["place"]))
                    place = found.columns["place"][keep].tolist()
                    first = {p: k for k, p in zip(reversed(range(len(place))), reversed(place)) if p not in given}
                    given.update(first)
                    keep = keep[sorted(first.values())]
                    raw = found.hashes.astype("<u8").tobytes()
                    words = [raw[8 * a : 8 * (a + n + window - 1)] for a, n in zip(found.first[keep].tolist(), found.n[keep].tolist())]
                    yield pa.RecordBatch.from_arrays([*(pa.array(found.columns[k][keep]) for k in ("anchor", "context")), pa.array(words, pa.binary())], ["anchor", "context", "words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "anchor long, context long, words binary")


class SuffixAutomaton:
    """Of several sequences, with the number of places where each state's sequences end."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list, times: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for x in sequence:
            p, cur = last, None
            known = nxt[p].get(x)
            if known is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[p] + 1)
                count.append(0)
                while p != -1 and x not in nxt[p]:
                    nxt[p][x] = cur
                    p = link[p]
                if p == -1:
                    last = cur
                    count[cur] += times
                    continue
                known = nxt[p][x]
            if length[known] == length[p] + 1:
                target = known
            else:
                target = len(nxt)
                nxt.append(dict(nxt[known]))
                link.append(link[known])
                length.append(length[p] + 1)
                count.append(0)
                link[known] = target
                while p != -1 and nxt[p].get(x) == known:
                    nxt[p][x] = target
                    p = link[p]
            if cur is not None:
                link[cur] = target
                last = cur
            else:
                last = target
            count[last] += times

    def repeated(self) -> list[int]:
        """For each state, the length of its longest suffix that occurs twice or more."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]
        best = [0] * len(self.length)
        for s in order:
            best[s] = self.length[s] if self.count[s] > 1 else best[self.link[s]]
        return best

    def statistics(self, sequence: list, best: list[int]) -> list[int]:
        """At each place, the length of the longest sequence ending there that occurs twice or more."""
        state, out = 0, []
        for k, x in enumerate(sequence):
            state = self.next[state][x]
            out.append(min(best[state], k + 1))
        return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _search(rows: DataFrame, window: int) -> DataFrame:
    """Of contexts with their words, dealt out and sorted by shard: the windows that repeat.

    Rows with fingerprint null: windows first .. last - 1 of the context repeat.
    Others, of anchors with several shards: a window that occurs ``times`` times
    in its shard (first is null if it was found repeated there).
    """

    def shard(of: list[tuple]) -> Iterator[tuple]:
        automaton = SuffixAutomaton()
        sequences = [np.frombuffer(words, "<u8").tolist() for *_, words in of]
        for (_, _, times, _, _), sequence in zip(of, sequences):
            automaton.add(sequence, times)
        best = automaton.repeated()
        seen: dict[bytes, int] = {}
        for (anchor, context, times, split, _), sequence in zip(of, sequences):
            flags = np.array(automaton.statistics(sequence, best)[window - 1 :]) >= window
            for a, b in _spans(flags):
                yield anchor, context, a, b, None, 0
            if split:
                raw = np.array(sequence, "<u8").tobytes()
                for k, found in enumerate(flags.tolist()):
                    fingerprint = hashlib.blake2b(raw[8 * k : 8 * (k + window)], digest_size=16).digest()
                    if found or times > 1:
                        seen[fingerprint] = 2
                    else:
                        yield anchor, context, k, k + 1, fingerprint, 1
        for fingerprint, n in seen.items():
            yield of[0][0], 0, None, None, fingerprint, n

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        columns = list(zip(*found)) if found else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "context", "first", "last", "fingerprint", "times"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, found = None, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "shard", "context", "times", "split", "words"))):
                if r[:2] != key:
                    if held:
                        found += shard(held)
                    key, held = r[:2], []
                if not held or held[-1][1] != r[2]:
                    held.append((r[0], *r[2:]))
                if len(found) > 20_000:
                    yield batch_of(found)
                    found = []
        if held:
            found += shard(held)
        yield batch_of(found)

    return rows.select("anchor", "shard", "context", "times", "split", "words").mapInArrow(search, "anchor long, context long, first int, last int, fingerprint binary, times long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """doc_id, text_hash and spans (array of first word, word behind the last) to remove."""
    anchor = min(anchor, window)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = written(anchors(docs, window, anchor).groupBy("anchor").count().where("count > 1").select(F.col("anchor").alias("key")), "anchors")
    # the filter lets some other anchors through; they have one context of one place and are dropped below
    places = written(contexts(docs, window, anchor, key_filter(shared)), "places")
    distinct = places.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.min("place").alias("place"), F.min("n").alias("n"))
    of_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("several"), F.sum("times").alias("all")).where(F.col("all") > 1).select("anchor", "several")
    known = written(distinct.join(of_anchor, "anchor"), "contexts")
    # one context alone at its anchor stands twice or more, so all of its windows do; the others need their words
    wanted = written(known.where("several > 1"), "wanted")
    # one reading more, for the words of one place of each context; equal rows may give them more than once
    words = context_words(docs, window, anchor, key_filter(wanted.select(F.col("place").alias("key"))))
    split = F.col("several") > shard
    shards = words.join(wanted, ["anchor", "context"]).select("anchor", "context", "times", "words", split.alias("split"), F.when(split, F.pmod(F.xxhash64("context"), F.ceil(F.col("several") / shard))).otherwise(0).cast("long").alias("shard"))
    found = written(_search(shards.repartition(n, "anchor", "shard").sortWithinPartitions("anchor", "shard", "context"), window), "found")
    across = found.where("fingerprint is not null")
    twice = written(across.groupBy("fingerprint").agg(F.sum("times").alias("n")).where("n > 1").select("fingerprint"), "twice")
    hits = written(
        known.where("several = 1").select("anchor", "context", F.lit(0).alias("first"), F.col("n").alias("last"))
        .unionByName(found.where("fingerprint is null").select("anchor", "context", "first", "last")).unionByName(across.where("first is not null").join(twice, "fingerprint").select("anchor", "context", "first", "last")),
        "hits",
    )
    removed = places.drop("place", "n").join(hits, ["anchor", "context"]).select("doc_id", "text_hash", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last") + window - 1).alias("last")).alias("span"))
    return written(removed.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("spans")), "spans")


def _apart(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame, Broadcast]:
    """docs with ``_id``, ``_hash`` and ``_key``, spans under the same names, and a filter of the keys that have spans."""
    key = F.xxhash64("_id", F.col("_id").isNull(), "_hash")
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    crc = F.when(F.col("text").isNull(), 0).otherwise((F.crc32(F.col("text").cast("binary")) - (1 << 31)).cast("int"))
    keyed = docs.drop("spans", "_id", "_hash", "_key").withColumn("_id", F.col("doc_id").cast("long")).withColumn("_hash", crc).withColumn("_key", key)
    return keyed, spans, key_filter(spans.select(key.alias("key")))


def _joined(some: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    same = F.col("d._id").eqNullSafe(F.col("s._id")) & (F.col("d._hash") == F.col("s._hash"))
    # merged, not broadcast: the exchange keeps the Python steps on both sides of it in stages of their own
    return some.alias("d").join(spans.hint("merge").alias("s"), same, "left").select(*[F.col(f"d.`{c}`") for c in columns], "spans")


def _parted(docs: DataFrame, window: int, anchor: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """All columns of docs, plus ``spans``: of the texts that have none for certain, and of the others, which alone are shuffled."""
    keyed, spans, held = _apart(docs, repeated_spans(docs, window, anchor, shard))
    columns = [c for c in docs.columns if c not in ("spans", "_id", "_hash", "_key")]
    rest = picked(keyed, held, "_key", inside=False).select(*columns, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return rest, _joined(picked(keyed, held, "_key"), spans, columns)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """All columns of docs, plus ``spans``: what to remove of each text, or null."""
    rest, some = _parted(docs, window, anchor, shard)
    return rest.unionByName(some)


def _digest_rows(batch: pa.RecordBatch, all_spans: list) -> pa.RecordBatch:
    out = []
    for text, spans in zip(batch.column("text"), all_spans):
        words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
        n = len(words)
        if spans:
            keep = _kept(n, spans)
            words = [words[i] for i in np.flatnonzero(keep)]
        out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
    a, b, c = zip(*out) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def digests(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, of the words kept joined by one blank."""
    keyed, spans, held = _apart(docs.select(F.col("doc_id").cast("long"), "text"), repeated_spans(docs, window, anchor, shard))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.filter(pa.array(~might_hold(held.value, batch.column("_key").to_numpy())))):
                yield _digest_rows(part, [None] * part.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=SLICE):
                yield _digest_rows(part, part.column("spans").to_pylist())

    some = _joined(picked(keyed, held, "_key"), spans, ["doc_id", "text"])
    return keyed.select("doc_id", "text", "_key").mapInArrow(untouched, out).unionByName(some.mapInArrow(touched, out))


def _kept(n: int, spans: list[dict]) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, [s["first"] for s in spans], 1)
    np.add.at(change, [s["last"] for s in spans], -1)
    return np.cumsum(change)[:n] == 0


def _cut(with_spans: DataFrame) -> DataFrame:
    schema = with_spans.drop("spans").schema
    place = with_spans.drop("spans").columns.index("text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    words = Words(pa.array([texts[i]]))
                    raw, out, at = words.raw, [], 0
                    for a, b in _spans(~_kept(len(words), spans)):
                        out.append(raw[at : words.start[a]].tobytes())
                        at = words.start[b] if b < len(words) else len(raw)
                    texts[i] = b"".join([*out, raw[at:].tobytes()]).decode()
            rest = batch.drop_columns(["spans"])
            yield rest.set_column(place, rest.schema.field(place), pa.array(texts, rest.schema.field(place).type))

    return with_spans.mapInArrow(make, schema)


def cut_texts(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard: int = SHARD) -> DataFrame:
    """docs with their repeated passages cut out; white space between words that stay is kept as it is."""
    rest, some = _parted(docs, window, anchor, shard)
    return rest.drop("spans").unionByName(_cut(some))
