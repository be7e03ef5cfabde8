"""Operators 11 to 13: registered queries on small tables of odd rows, against brute force and their SQL."""

import collections
import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import clustering, divergence, queries, token_counts
from weft.llm.sql import SQL

DATA = os.environ.get("WEFT_TEST_DATA", "/root/testdata/sf0.001")
PATH = public_tokenizers.path("word_bpe_49k.json")
CONTRACT = {
    "op11_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op12_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
    "op13_centroid_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
}
PIECES = (
    "don't it's 'sup ''s x's 'rest 'relax we'LLama I'm I'd a1b22 -- _x_ <|endoftext|> a<|endoftext|>b <|ENDOFTEXT|> <| naïve's Straße Σας \x1c \x01a a\xa0b 日本語 ' 's s l'été é é ́ 't've've'x K İ \x85y hello, World. WORLD $%# 1999"
).split(" ")


def texts():
    rng = random.Random(1)
    mixed = [rng.choice([" ", "  ", "\n", "\t", "\x0b"]).join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(250)]
    return [None, "", "  \n ", "s", "'", "'s", "l'", "l", *mixed, "word's " * 300_000, "y" * 3_000_000, "ab " * 1023, "ab " * 2048, "ab " * 2049]


ROWS = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts())] + [(None, "a b", "en", "s1"), (3, "s", "en", "s1"), (4000, "12 !", "one", "alone"), (4001, None, "two", "x"), (4002, "", "two", "y")]


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 64))
    out = [(i, (base[i % 12] + 0.3 * rng.standard_normal(64)).tolist()) for i in range(400)]
    out += [(i, out[i - 400][1]) for i in range(400, 430)]  # ties
    bad = [None, [0.0] * 63, [0.0] * 65, [float("nan")] * 64, [float("inf")] * 64, [None] * 64, []]
    return [*out, (17, [1.5] * 64), (17, [1.5] * 64), (None, [0.25] * 64), (900, [0.0] * 64), (901, [1e30] * 64), *((1000 + i, b) for i, b in enumerate(bad))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("counts"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "rank", "item", "value", "block", "part", "key")}).repartition(3)
    embedded = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cluster", "distance", "v", "n")}).repartition(3)
    for name, df in (("documents", docs), ("embeddings", embedded)):
        df.write.parquet(f"{base}/some/{name}.parquet")
        df.limit(0).write.parquet(f"{base}/none/{name}.parquet")
    return f"{base}/some", f"{base}/none"


@pytest.mark.parametrize("name", CONTRACT)
def test_contract_and_empty_tables(spark, tables, name):
    for folder in tables:
        df = queries.QUERIES[name](spark, folder)
        assert {tuple(c.split(" ")) for c in CONTRACT[name].split(", ")} <= set(df.dtypes)
        assert (df.count() > 0) == (folder == tables[0])


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_centroid_clustering"])
@pytest.mark.parametrize("given", [True, False])
def test_equals_sql(spark, tables, name, given):
    db, folder = duckdb.connect(), DATA if given else tables[0]
    for t in ("documents", "embeddings"):
        at = f"{folder}/{t}.parquet"
        rows = db.execute(f"select * from '{at + '/*.parquet' if os.path.isdir(at) else at}'").to_arrow_table()
        if t == "embeddings":  # what cannot be a whole number in SQL is told apart below
            rows = rows.filter(pa.array([v.as_py() != 901 for v in rows.column("vec_id")]))
        db.register(t, rows)
    got = queries.QUERIES[name](spark, folder)
    want = db.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    if name.startswith("op13") and not given:
        got = clustering.cluster(spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id is null or vec_id <> 901"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


# ---- 11 ----


def brute_tokens(rows):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    n = {t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in {r[1] for r in rows}}
    return sorted(repr((r[0], len((r[1] or "").encode()), n[r[1]], n[r[1]] > 2048)) for r in rows)


@pytest.mark.parametrize("block", [1 << 10, 1 << 20])
def test_token_counts(spark, tables, monkeypatch, block):
    """With many blocks and with few; the limit is not over at 2048 tokens."""
    monkeypatch.setattr(token_counts, "BLOCK", block)
    got = token_counts.count_tokens(spark.read.parquet(f"{tables[0]}/documents.parquet"), PATH, scanned=True)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_tokens(ROWS)


def test_token_counts_of_what_is_no_scan(spark):
    rows = [(i, t) for i, t in enumerate(["it's", "a b", None] * 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").orderBy(F.rand())
    assert sorted(repr(tuple(r)) for r in token_counts.count_tokens(docs, PATH).collect()) == brute_tokens(rows)


def test_each_pretoken_is_counted_once(monkeypatch):
    """Over all blocks of a part, and no piece of text twice."""
    counter, seen = token_counts.PieceCounter(PATH), collections.Counter()
    plain = counter.tokenizer.model.tokenize

    class Spy:
        model = type("M", (), {"tokenize": staticmethod(lambda t: seen.update([t]) or plain(t))})
        encode_batch_fast = counter.tokenizer.encode_batch_fast

    counter.tokenizer = Spy
    assert counter.count([b"the", b"ing"]) + counter.count([b"the", "é".encode(), b"x"]) == [1, 1, 1, 1, 1]
    assert seen == {"the": 1, "ing": 1, "x": 1}


def test_pretokens_are_the_tokenizer_s(spark):
    """Cut by bytes as the library's own rule cuts, where a word is printable ASCII."""
    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(8)
    words = ["".join(rng.choice("ab'sdtmrevl'1-.,") for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    cut = token_counts.PreTokens(pa.array(words))
    mine = collections.defaultdict(list)
    for a, b, d in zip(cut.start, cut.end, cut.doc):
        mine[d].append(cut.raw[a:b].tobytes().decode())
    assert [mine[i] for i in range(len(words))] == [[t for t, _ in tokenizer.pre_tokenizer.pre_tokenize_str(w)] for w in words]


# ---- 12 ----


def brute_divergence(rows, least=3):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", word.findall((t or "").translate(low))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, of = collections.Counter(), collections.defaultdict(collections.Counter)
        for x, source, terms in docs:
            if x == lang:
                held.update(set(terms))
                of[source].update(terms)
        kept = sorted(t for t, n in held.items() if n >= least)
        total = lambda c: sum(c[t] for t in kept)
        weight = lambda c, t, n: 1 + 10**9 * (c[t] + 1) // (n + len(kept))
        whole = sum(of.values(), collections.Counter())
        p = {s: {t: weight(c, t, total(c)) for t in kept} for s, c in of.items()}
        q = {t: weight(whole, t, total(whole)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in of:
            pairs = [(other, sum(f(p[s][t], p[other][t]) for t in kept)) for other in of if other != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < 200]
    return sorted(out)


@pytest.mark.parametrize("rows, cells", [(250_000, 1 << 20), (40, 64)])
def test_divergence(spark, tables, monkeypatch, rows, cells):
    """In one shard and in many small ones."""
    monkeypatch.setattr(divergence, "SHARD_ROWS", rows)
    monkeypatch.setattr(divergence, "CELLS", cells)
    got = divergence.audit(spark.read.parquet(f"{tables[0]}/documents.parquet"))
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(ROWS)


def test_partial_counts_are_bounded(monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 20)
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = [(f"{i} " + " ".join(f"w{'abcdefghij'[i % 10]}{'abcdefghij'[j]}" for j in range(10)), "en", f"s{i % 2}") for i in range(100)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), r)) for r in rows])
    got = collections.Counter()
    for part in divergence._partial(iter([batch.slice(i, 5) for i in range(0, 100, 5)])):
        for r in part.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["n"]
    want = collections.Counter((lang, s, t) for text, lang, s in rows for t in re.findall("[a-z]+", text))
    assert +got == want and {k for k in got if k[2] == ""} == {("en", "s0", ""), ("en", "s1", "")}


def test_weights_are_exact():
    rng = random.Random(2)
    n = [rng.randrange(10**12) for _ in range(300)] + [0, 10**12]
    total = [max(1, x + rng.randrange(10**rng.randrange(1, 15))) for x in n]
    total = [max(t, x + 1) for t, x in zip(total, n)]
    assert divergence.weights(np.array(n), np.array(total)).tolist() == [1 + 10**9 * (x + 1) // t for x, t in zip(n, total)]


# ---- 13 ----


def brute_clusters(rows):
    bound = 1 << 26
    kept = [(i, [max(-bound, min(bound, math.floor(64 * float(np.float32(x))))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(float(np.float32(x))) for x in v)]
    key = lambda r: hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (key(r), r[1]))[:16]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(3):
        groups = collections.defaultdict(list)
        for (_, v), (_, k) in zip(kept, assign()):
            groups[k].append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)]
    found = assign()
    own = collections.Counter()
    for d, k in found:
        own[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, k, d, own[k], sum(own.values()), sha[k])) for (i, _), (d, k) in zip(kept, found))


def test_clusters(spark, tables):
    got = queries.op13_centroid_clustering(spark, tables[0])
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_clusters(vectors())


def test_fewer_vectors_than_centroids(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(5)]
    got = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_clusters(rows)


@pytest.mark.parametrize("k, spread", [(1, 3), (2, 2), (16, 2), (16, 50), (40, 1)])
def test_orchard_search_is_exact(k, spread):
    """Small whole numbers, so that ties are frequent, and equal centroids."""
    rng = np.random.default_rng(k)
    x, c = rng.integers(-spread, spread + 1, (3000, 4)), rng.integers(-spread, spread + 1, (k, 4))
    every = ((x[:, None] - c) ** 2).sum(axis=2)
    best, distance = clustering.nearest(x, c)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_orchard_search_stops_early():
    """In separate clusters few of all centroids are visited."""
    rng = np.random.default_rng(0)
    c = rng.integers(-1000, 1000, (64, 8))
    x = np.repeat(c, 20, axis=0) + rng.integers(-5, 6, (1280, 8))
    seen = []

    class Counted(np.ndarray):
        def __sub__(self, other):
            seen.append(len(self))
            return np.asarray(self) - np.asarray(other)

    clustering.nearest(x.view(Counted), c)
    assert sum(seen) < 0.6 * len(x) * len(c)
