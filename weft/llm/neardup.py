"""Near duplicates by circulant MinHash (operator 2).

Signatures: one permutation of the shingle hashes (a bijection that mixes the
bits) and a second one that is shifted circularly, by k places for coordinate
k, make all signature coordinates.  Bands of coordinates bring classes of equal
shingle sets together; links are confirmed on the full sets.

Large groups: documents with equal sets are one class before anything else.  In
each bucket every member is first compared with one pivot, if that is of another
component; the pivot then leaves the bucket, and there are several such rounds.
Where a bucket still holds several components after them, the members outside
its largest one are compared with all others in blocks of bounded size; a block
counts the shingles that sets share and puts out nothing but links.  So links
that only join what is joined already are never made, and no link between
components is lost.

What moves: texts are not shuffled.  The sets of classes that share a bucket
with others are made in a second reading of the documents, which a Bloom filter
of bounded size cuts down to about these; only such sets are shuffled.

Defined results: null or blank texts have an empty set and are linked with
nothing; texts with fewer words than a shingle are one shingle; repeated rows
are equal documents; a null doc_id takes part, and is a component's id only if
no other is there; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import MAX_BITS, key_filter, might_hold, picked
from .scratch import written
from .words import Words, chunks, mix, runs

#: Words of a shingle, and the least similarity of a link as a fraction.
SHINGLE = 5
SIMILAR = (4, 5)
#: At a similarity of 0.8 two sets share no band with a probability of 2e-6.
BANDS, ROWS = 25, 4
#: Rounds of comparisons with pivots before what is left is compared in blocks.
PIVOT_ROUNDS = 4
#: Members of a block's side.
BLOCK = 256
#: The filter of wanted texts has at most 2 ** FILTER_BITS bits.
FILTER_BITS = MAX_BITS
#: Parts of a component whose members look up their root.
SALTS = 8

# The second permutation of 32-bit values: x -> A x x + B x modulo 2 ** 32, a bijection for even A and odd B.
_A, _B, _SHIFT = 0x2C1B3C6E, 0x85EBCA6B, 0x9E3779B1


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, out = words.hashes(), []
    grams = runs(hashes, n)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(runs(hashes[a:b], int(b - a), seed=int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """size coordinates: the least place of a shingle under the second permutation, shifted by k."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)  # the mixed hash is the first permutation
    shift = np.arange(size, dtype=np.uint64) * np.uint64(_SHIFT) % np.uint64(1 << 32)
    linear = ((2 * _A * shift + _B) % np.uint64(1 << 32)).astype(np.uint32)  # A (x + s)(x + s) + B (x + s), by powers of x
    constant = ((_A * (shift * shift % np.uint64(1 << 32)) + _B * shift) % np.uint64(1 << 32)).astype(np.uint32)
    square = x * x * np.uint32(_A)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        places = linear[:, None] * x[a : a + 1024]
        places += square[a : a + 1024]
        places += constant[:, None]
        np.minimum(out, places.min(1), out=out)
    return out


def _fingerprint(shingles: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        a, b = mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return np.array([a, b], "<u8").tobytes()


def _key() -> Column:
    """What a row is known by: its id, which may be null or repeated, and its text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text")).alias("key")


def sketches(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key, n_shingles, class (a fingerprint of the set; null if empty) and its bands."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sizes, classes, all_bands = [], [], []
                for s in shingle_sets(Words(part.column("text"), lower=True), shingle):
                    sizes.append(len(s))
                    if len(s):
                        coordinates = signature(s, bands * rows).reshape(bands, rows).astype(np.uint64)
                        classes.append(_fingerprint(s))
                        all_bands.append(np.concatenate([runs(c, rows) for c in coordinates]).view(np.int64))
                    else:
                        classes.append(None)
                        all_bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(all_bands, pa.list_(pa.int64()))],
                    ["doc_id", "key", "n_shingles", "class", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), _key(), "text").mapInArrow(sketch, "doc_id long, key long, n_shingles long, class binary, bands array<long>")


def _some(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of the given classes, and few others."""
    key = F.xxhash64("class").alias("key")
    return picked(sets.select("class", "shingles", key), key_filter(classes.select(key), FILTER_BITS), "key").drop("key")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """class and its shingles, of one document of each wanted class (class, key).

    Only texts that pass a filter of the keys are turned into sets, and no text
    itself is shuffled.
    """
    held = key_filter(wanted, FILTER_BITS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.filter(pa.array(might_hold(held.value, batch.column("key").to_numpy())))):
                sets = [s.astype("<u8") for s in shingle_sets(Words(part.column("text"), lower=True), shingle)]
                yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "shingles"])

    found = docs.select(_key(), "text").mapInArrow(build, "class binary, shingles binary")
    return found.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    num, den = similar

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                s, t = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                small, large = min(len(s), len(t)), max(len(s), len(t))
                if den * small < num * large:
                    keep.append(False)
                    continue
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * shared >= num * (len(s) + len(t) - shared))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    # written, so that no stage has two Python workers a task
    few = written(_some(sets, pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()), "few")
    side = lambda name, own: few.select(F.col("class").alias(name), F.col("shingles").alias(own))
    with_sets = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return with_sets.select("a", "b", "x", "y").mapInArrow(confirm, "a binary, b binary")


def _links_in_blocks(open_members: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links between the components of each bucket.

    open_members has bucket, class and component.  The members outside a
    bucket's largest component meet all others, dealt out to blocks of about
    BLOCK by BLOCK members.
    """
    num, den = similar
    each = open_members.groupBy("bucket", "component").count()
    sizes = written(
        each.groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("major"), F.sum("count").alias("n")).where(F.col("n") > F.col("major.count"))
        .select("bucket", F.col("major.component").alias("major"), F.ceil(F.col("n") / BLOCK).alias("columns"), F.ceil((F.col("n") - F.col("major.count")) / BLOCK).alias("rows")),
        "sizes",
    )
    left = written(open_members.join(sizes, "bucket"), "left")
    at = left.join(_some(sets, left.select("class").distinct()), "class")
    place = lambda n: F.pmod(F.xxhash64("class"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    minor = at.where("component <> major").select("bucket", place("rows").alias("row"), every("columns").alias("column"), F.lit(0).alias("side"), "class", "component", "shingles")
    member = at.select("bucket", every("rows").alias("row"), place("columns").alias("column"), F.lit(1).alias("side"), "class", "component", "shingles")

    def links(left: list[tuple], right: list[tuple]) -> Iterator[tuple]:
        sets = [np.frombuffer(x, "<u8") for *_, x in right]
        sizes = np.array([len(x) for x in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        tokens, owners = tokens[order], np.repeat(np.arange(len(sets)), sizes)[order]
        for name, component, x in left:
            own = np.frombuffer(x, "<u8")
            a, b = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            n = b - a
            hits = owners[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
            shared = np.bincount(hits, minlength=len(sets))
            for k in np.flatnonzero(den * shared >= num * (len(own) + sizes - shared)).tolist():
                if right[k][1] != component:
                    yield min(name, right[k][0]), max(name, right[k][0])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, found = None, ([], []), set()
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "row", "column", "side", "class", "component", "shingles"))):
                if r[:3] != key:
                    if sides[0] and sides[1]:
                        found.update(links(*sides))
                    key, sides = r[:3], ([], [])
                sides[r[3]].append(r[4:])
        if sides[0] and sides[1]:
            found.update(links(*sides))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["a", "b"])

    n = int(open_members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = ["bucket", "row", "column"]
    return minor.unionByName(member).repartition(n, *block).sortWithinPartitions(*block).mapInArrow(search, "a binary, b binary")


def _with(rows: DataFrame, named: DataFrame, own: str) -> DataFrame:
    """rows, left joined to what is named of each component; a component of very many rows is dealt out by their own key."""
    salt = F.lit(SALTS).cast("long")
    each = named.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salt - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64(own), salt)).join(each, ["component", "salt"], "left").drop("salt")


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node) of the nodes that links (a, b) join.

    Every node takes its smallest neighbour for a parent, parents' parents are
    followed to the roots, and the links are drawn anew between roots, until
    none is left between different roots.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = None
    while True:
        parent = written(both(links).groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "parents")
        while True:
            # only nodes that are parents, which are few, and not yet roots
            up = parent.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("above")).join(parent.select("component").distinct(), "component", "left_semi")
            jumped = written(_with(parent, up, "node").select("node", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved")), "jumped")
            moved = jumped.where("moved").limit(1).count()
            parent = jumped.drop("moved")
            if not moved:
                break
        roots = parent.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("root"))
        label = parent if label is None else written(_with(label, roots, "node").select("node", F.coalesce("root", "component").alias("component")), "labels")
        root = lambda c: parent.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root"))
        links = written(links.join(root("a"), "a").join(root("b"), "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links")
        if not links.limit(1).count():
            return label


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for every row of docs."""
    return verdicts(docs, shingle, similar, bands, rows).drop("key")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs without near duplicates: of each group the document of smallest id stays, once.

    Documents without an id stay if their group has none with an id; only rows
    that may go are shuffled.
    """
    rows = written(verdicts(docs, shingle, similar).groupBy("key").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "going")
    held = key_filter(rows.select("key"))
    keyed = docs.withColumn("_key", _key())
    some = picked(keyed, held, "_key").join(rows.select(F.col("key").alias("_key"), "kept", "n").withColumnsRenamed({"kept": "_kept", "n": "_n"}), "_key", "left").where("_kept is null or _kept")
    once = some.where("_n > 1").dropDuplicates(["_key"]).unionByName(some.where("_n is null or _n = 1"))
    return picked(keyed, held, "_key", inside=False).select(*docs.columns).unionByName(once.select(*docs.columns))


def verdicts(docs: DataFrame, shingle: int, similar: tuple[int, int], bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The same as near_duplicates, and each row's key."""
    sketched = written(sketches(docs, shingle, bands, rows), "sketches")
    # a class has one set, so all its rows have the same bands
    classes = written(
        sketched.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("key", "n_shingles", "bands")).alias("x")).select("class", "doc_id", "x.*"),
        "classes",
    )
    # dealt out by bucket once, for the count and for the join with it
    at = classes.select("class", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "value")).select("class", "n", F.xxhash64("band", "value").alias("bucket")).repartition("bucket")
    members = written(at.join(at.groupBy("bucket").count().where("count > 1").select("bucket").hint("merge"), "bucket"), "members")
    wanted = written(classes.select("class", "doc_id", "key").join(members.select("class").distinct(), "class", "left_semi"), "wanted")
    sets = written(_sets(docs, wanted, shingle), "sets")

    label = written(wanted.select("class", F.col("class").alias("component")), "component")
    tested = None
    for k in range(PIVOT_ROUNDS + 1):
        now = written(members.join(label, "class"), "now")
        pivots = written(
            now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(F.xxhash64("class"), "class", "component", "n")).alias("pivot"))
            .where("lo <> hi").select("bucket", F.col("pivot.class").alias("pivot"), F.col("pivot.component").alias("pivot_component"), F.col("pivot.n").alias("pivot_n")),
            "pivots",
        )
        open_members = now.join(pivots, "bucket")
        if k < PIVOT_ROUNDS:
            # a pivot is compared with all members of other components, and then leaves the bucket
            members = written(open_members.where("class <> pivot"), "members")
            near = similar[1] * F.least("n", "pivot_n") >= similar[0] * F.greatest("n", "pivot_n")
            pairs = members.where(near & (F.col("component") != F.col("pivot_component"))).select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct()
            pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = pairs if tested is None else tested.unionByName(pairs)
            members = members.select("bucket", "class", "n")
            links = written(_confirmed(pairs, sets, similar), "confirmed")
        else:
            links = written(_links_in_blocks(open_members.select("bucket", "class", "component"), sets, similar), "confirmed")
        if links.limit(1).count():
            named = lambda c: label.select(F.col("class").alias(c), F.col("component").alias(f"{c}_component"))
            between = written(links.join(named("a"), "a").join(named("b"), "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b")).where("a <> b").distinct(), "between")
            joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("root"))
            label = written(_with(label, joined, "class").select("class", F.coalesce("root", "component").alias("component")), "component")

    smallest = label.join(wanted, "class").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    linked = written(_with(label, smallest, "class").select("class", "smallest"), "linked")
    alone = classes.select("class", F.col("doc_id").alias("own"))
    first = written(alone.join(linked, "class", "left").select("class", F.coalesce("smallest", "own").alias("first")), "first")
    smallest_id = F.coalesce("first", "doc_id")
    return sketched.select("doc_id", "key", "n_shingles", "class").join(first, "class", "left").select("doc_id", "n_shingles", smallest_id.alias("component_id"), F.col("doc_id").eqNullSafe(smallest_id).alias("kept"), "key")
