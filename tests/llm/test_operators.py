"""Operators on small frames: odd rows, brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import random
import re
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import bpe, features, html_text, language, licenses, neardup, neighbours, packing, quality, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, None), (2, "", "s"), (3, " \n\t ", "s"), (4, "one", None), (4, "one", None), (5, "x" * 300_000, "s"), (None, "a b c d e f", "s"), (6, "Ünïcode — «text»   x\x1cy", "s")]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit(None).cast("string"))


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 160))) for _ in range(12)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        if i % 5 == 0:
            w = w[: len(w) // 2] + [rng.choice(words) for _ in range(40)]
        out.append((i, " ".join(w), f"s{i % 3}"))
    return out


def shingles(text, n):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n):
    sets = {i: shingles(t, n) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(spark):
    rows = texts()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), shingle=4).collect()}
    assert got == brute_components(rows, 4)


@pytest.mark.parametrize("rounds", [0, 1])
def test_near_duplicates_blocks(spark, monkeypatch, rounds):
    """The comparison in blocks, alone and behind one pivot, finds the same links; so does it through a filter that is full."""
    monkeypatch.setattr(neardup, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "FILTER_BITS", 6)
    rows = [r for r in texts(seed=4, n=40)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), shingle=4).collect()}
    assert got == brute_components(rows, 4)


def test_near_duplicates_odd_rows(spark):
    got = neardup.near_duplicates(frame(spark)).collect()
    assert len(got) == len(ODD) and all(r.n_shingles == 0 for r in got if r.doc_id in (1, 2, 3))
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def brute_removed(rows, n):
    counts = collections.Counter()
    split = [(i, WORD.findall(t or "")) for i, t, _ in rows]
    for _, w in split:
        counts.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for k in range(len(w) - n + 1):
            if counts[tuple(w[k : k + n])] > 1:
                keep[k : k + n] = [False] * n
        left = " ".join(x for x, ok in zip(w, keep) if ok)
        out.append((i, len(w), keep.count(False), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [2000, 2])
def test_substrings(spark, shard):
    rows = texts(seed=2) + ODD + [(900, " ".join(["a b"] * 40), "s"), (901, "q " * 11, "s")]
    got = substrings.digests(frame(spark, rows), window=12, anchor=4, shard=shard).collect()
    assert sorted(map(tuple, got), key=str) == brute_removed(rows, 12)
    assert substrings.without_repeats(frame(spark, []), window=12).collect() == []


def test_cut_texts(spark):
    rows = [(1, "one  two\nthree four five six", "s"), (2, "three four five", "s")]
    got = {r.doc_id: r.text for r in substrings.cut_texts(frame(spark, rows), window=3, anchor=2).collect()}
    assert got == {1: "one  two\nsix", 2: ""}


def test_packing(spark):
    rows = ODD + [(100 + i, "word " * (i * 37 % 5000), "s") for i in range(60)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(packing.pieces(frame(spark, rows), path)).collect()
    assert sum(r.length for r in got) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        if i not in (4,):
            assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
            assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by) <= -(-sum(r.length for r in got) // packing.CAPACITY) + 2
    assert packing.pack(packing.pieces(frame(spark, []), path)).collect() == []


def volume(sizes, capacity):
    """The least number of bins, by trying all."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[k]}:
            i = rooms.index(room)
            put(k + 1, [*rooms[:i], room - sizes[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best[0]


def test_packing_against_the_optimum(spark):
    """Dealt over tasks and merged in a tree: at most one sequence more than the least number (best fit's own loss)."""
    rng = random.Random(8)
    for sizes in ([rng.randint(1, 20) for _ in range(11)], [11] * 9, [11] * 6 + [9, 9, 5, 3], [1] * 30, [20, 20, 10, 10, 1]):
        parts = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], packing.PIECES)
        got = packing.pack(parts, capacity=20, partitions=4).collect()
        by = collections.Counter()
        for r in got:
            by[r.sequence_id] += r.length
        assert len(got) == len(sizes) and max(by.values()) <= 20 and len(by) <= volume(sizes, 20) + 1


def test_packing_hands_on_enough():
    """With any number of tasks, what is handed on makes as few sequences as if all were."""
    rng = random.Random(9)
    for _ in range(200):
        tasks = rng.randint(1, 6)
        bins = [b for _ in range(tasks) for b in [sum(s) for s in [[c[i] for i in x] for c in [[rng.randint(1, 20) for _ in range(rng.randint(1, 15))]] for x in packing.best_fit(c, 20)]]]
        assert sum(b <= 10 for b in bins) <= tasks
        some = sorted(bins)[: 2 * tasks]
        assert len(packing.best_fit(some, 20)) + len(bins) - len(some) == len(packing.best_fit(bins, 20))


def test_sequences(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*ODD, (50, "a longer text " * 900, "s"), (4, "one", None)]
    parts = packing.pieces(frame(spark, rows), path, ids=True)
    got = packing.sequences(parts, packing.pack(parts.drop("ids"), partitions=3)).collect()
    tokens = sorted(x for r in got for x in r.ids)
    assert tokens == sorted(x for _, t, _ in rows for x in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    assert all(0 < len(r.ids) <= packing.CAPACITY for r in got)


def test_bpe(spark):
    rows = ODD + [(7, "A<|endoftext|>b <|ENDOFTEXT|> it's,  x　y É́ ΑΣ", "s")] + texts(n=10)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, bpe.encode_decode(frame(spark, rows), path).collect()), key=str) == sorted(want, key=str)
    assert bpe.encode_decode(frame(spark, []), path).collect() == []


def test_quality(spark):
    line = "this line stands in every document of its host"
    rng = random.Random(6)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9))
    rows = [(1000 + i, "\n".join([line, *(own() for _ in range(8))]), "h") for i in range(30)] + [(99, f"{line}\n" * 12, "h")] + ODD
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert got[3].n_words == 0 and not got[3].kept and got[1].base_failed and len(got) == len({r[0] for r in rows})
    assert got[1007].removed_chars == len(line) and got[1007].kept
    assert got[99].n_dup_lines == 11 and got[99].base_failed
    assert quality.judge(frame(spark, [])).collect() == []


def test_quality_counts_distinct_documents(spark, monkeypatch):
    rng = random.Random(7)
    own = lambda n: "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) for _ in range(n))
    line = "Page 3 of  the   site"
    again = (7, own(8), "h")
    rows = [again] * 25 + [(100 + i, f"{line.replace('3', str(i))}\n{own(8)}", "h") for i in range(21)] + [(200 + i, f"{line}\n{own(8)}", "other") for i in range(20)] + [(300, f"{line}\n{own(8)}", None)]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    n = len("page 0 of the site")
    assert (got[7].removed_chars, got[7].kept) == (0, True)  # 25 rows, one document
    assert {got[100 + i].removed_chars for i in range(21)} == {n} and {got[200 + i].removed_chars for i in range(20)} == {0} and got[300].removed_chars == 0
    cut = {r.doc_id: r.text for r in quality.without_frequent_lines(frame(spark, rows + ODD)).collect()}
    assert all(cut[100 + i] == rows[25 + i][1].split("\n", 1)[1] for i in range(21)) and cut[7] == again[1] and cut[200] == rows[46][1] and cut[1] is None
    monkeypatch.setattr(quality, "BROADCAST", 0)
    assert {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()} == got


def test_licenses(spark):
    rows = ODD + [(10, "x. Released UNDER the\nMIT-license. under the mit licenses", "s"), (11, "a\nLicensed under the Apache License, Version 2.0.\nb", "s"), (12, "the rights are reserved by none", "s"), (13, "This work is licensed under the GNU General Public License, version 3.", "s")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert (got[10].n_base, got[10].first_word, got[10].last_word, got[10].base_labels) == (1, 2, 2, ["mit"])
    assert got[11].labels == ["apache-2"] and got[11].first_word == 4 and got[13].labels == ["gpl-3"] and got[13].n_base == 0 and got[12].labels == [] and got[1].n_words == 0
    assert licenses.scan(frame(spark, [])).collect() == []


def test_near_duplicates_of_null_and_repeated_ids(spark):
    w = [[f"{c}{i}" for i in range(100)] for c in "abcd"]
    near = lambda k: " ".join([*w[k][:-1], "other"])
    rows = [(None, " ".join(w[0]), "s"), (5, near(0), "s"), (7, " ".join(w[1]), "s"), (7, " ".join(w[2]), "s"), (7, " ".join(w[3]), "s"), (8, near(1), "s"), (9, near(2), "s"), (10, near(3), "s")]
    got = neardup.near_duplicates(frame(spark, rows), shingle=4).select("doc_id", "component_id").collect()
    # the null id belongs to 5, and each text of 7 to its own near copy
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 5), (5, 5), (7, 7), (7, 7), (7, 7), (8, 7), (9, 7), (10, 7)]


def test_licenses_across_lines(spark):
    wrapped = lambda t, n: "\n".join(f"# {line}" for line in textwrap.wrap(t, n))
    near = "In no way. " + licenses.NOTICES[0][1].replace("hereby", "herewith").replace("sublicense", "license") + " The end."
    known = [(label, t) for label, t in [*licenses.TEMPLATES, *licenses.NOTICES] for t in (f"a b. {t} C d", f"a b. {wrapped(t, 25)}\nC d")]
    known += [("mit", near), ("mit", "word " * 5000 + wrapped(near, 40) + " word" * 5000)]
    rows = [(i, t, "s") for i, (_, t) in enumerate(known)]
    rows += [(900, "all is well. the rights of others are now held and reserved", "s"), (901, " ".join(w for w in licenses._plain(licenses.NOTICES[0][1])[::2]), "s")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert [label for i, (label, _) in enumerate(known) if label not in got[i].labels] == []
    assert 0.9 <= got[len(known) - 1].score < 1 and got[900].labels == got[901].labels == []


def test_language(spark):
    rng = random.Random(3)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(60))
    rows = [(i, make(["the", "ing", "on"] if i % 2 else ["ção", "ñar", "que"]), "s", "xx" if i % 2 else "yy") for i in range(120)] + [(500, None, "s", None), (501, "12 34 !", "s", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs.where("doc_id < 80"))).collect()}
    assert all(got[i].lang_pred == rows[i][3] for i in range(80, 120))
    assert (got[500].lang_pred, got[501].lang_pred) == ("und", "und") and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(5)
    words = [f"plain{i}" for i in range(300)]
    rows = [(i, " ".join([*(rng.choice(words) for _ in range(40)), *(["awfulword", "nastything"] if i % 6 == 0 else [])]), "s") for i in range(600)] + ODD[:3]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 400)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train_on_labels(docs.where("doc_id < 400 and doc_id >= 0"), labels)).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 6 == 0) for i in range(400, 600))
    none = toxicity.train_on_labels(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score < 0.01 for r in toxicity.score(docs, none).collect()} == {True}


def test_toxicity_risk():
    """The risks against a plain loop, their gradients against finite differences."""
    rng = np.random.default_rng(1)
    p, u = (rng.random((n, 5)) < 0.4 for n in (7, 11))
    p, u, w, b, prior = p.astype(np.float32), u.astype(np.float32), rng.standard_normal(5).astype(np.float32).astype(float), 0.25, 0.2
    loss = lambda z, y: float(np.log1p(np.exp(-z if y else z)))

    def loop(w, b):
        mean = lambda rows, y: sum(loss(float(r @ w) + b, y) for r in rows) / len(rows)
        return prior * mean(p, 1), mean(u, 0) - prior * mean(p, 0)

    positive, negative, g_positive, g_negative = toxicity.risks(w, b, p, u, prior)
    assert np.allclose((positive, negative), loop(w, b), atol=1e-5)
    for k in range(6):
        step = np.eye(6)[k] * 1e-4
        up, down = loop(w + step[:5], b + step[5]), loop(w - step[:5], b - step[5])
        assert np.allclose((g_positive[k], g_negative[k]), (np.array(up) - down) / 2e-4, atol=1e-3)


def test_samples_of_repeated_ids(spark):
    """Bounded in rows, whatever repeats, and whole in their texts."""
    rows = [(None, "same", "s")] * 50 + [(1, f"text {i}", "s") for i in range(50)] + [(i, "z " * 3000, "s") for i in range(2, 12)]
    got = features.sample_texts(frame(spark, rows), 40).collect()
    assert len(got) == 40 == len({(r.doc_id, r.text) for r in got}) <= 40
    assert len(features.sample_texts(frame(spark, rows), 1000).collect()) == 61
    assert {r.doc_id for r in features.sample_texts(frame(spark, rows), 1000, ids=spark.createDataFrame([(3,), (3,)], "doc_id long")).collect()} == {3}


def test_language_gradients():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = language.fit(x, ["a", "b", "c"], y)
    net.embedding, net.filters, net.biases, net.out, net.out_bias = (
        net.embedding.astype(float), [f.astype(float) for f in net.filters], [b.astype(float) for b in net.biases], net.out.astype(float), net.out_bias.astype(float))
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    for value, g in zip(net.parameters(), net.gradients(x, y)):
        for at in zip(*(rng.integers(0, n, 8) for n in value.shape)):
            was, both = value[at], []
            for d in (1e-6, -1e-6):
                value[at] = was + d
                both.append(loss())
            value[at] = was
            assert abs((both[0] - both[1]) / 2e-6 - g[at]) < 1e-4


def test_language_pooling(spark):
    """Answers of a text are those of its windows, weighted by their bytes."""
    rng = np.random.default_rng(3)
    net = language.fit(rng.integers(97, 123, (40, language.WINDOW)).astype(np.uint8), ["a", "b"], np.arange(40) % 2)
    text = "".join(chr(c) for c in rng.integers(97, 123, 1000))
    raw, want = text.encode(), np.zeros(2)
    for a in range(0, len(raw), language.WINDOW):
        w = raw[a : a + language.WINDOW]
        want += net.probabilities(np.frombuffer(w.ljust(language.WINDOW, b"\0"), np.uint8)[None])[0] * len(w) / len(raw)
    got = language.predict(frame(spark, [(1, text, "s")]), net).first()
    assert got.lang_pred == "ab"[want.argmax()] and abs(got.score - want.max()) < 1e-5


def test_neighbours(spark):
    """How much is searched is measured; a copied vector is in many parts."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 16)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.search(vectors, vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(6000), d)) if i != q][:10]
        hits += len(set(best) & set(got[q]))
    assert hits >= 0.9 * 600 and set(got) == set(range(0, 6000, 100))
    assert neighbours.search(vectors.where("vec_id < 0"), vectors.where("vec_id < 0").withColumnRenamed("vec_id", "query_id")).collect() == []


def read_back(model, pages):
    """Shares of pages that come out exactly, of the kept blocks that are content, and of the content that is kept."""
    exact = kept = right = wanted = n = 0
    for page, content in pages:
        got = set(model.text(page).split("\n")) - {""}
        n, exact, kept, right, wanted = n + 1, exact + (got == content), kept + len(got), right + len(got & content), wanted + len(content)
    return exact / n, right / kept, right / wanted


def test_html_layouts():
    exact, precision, recall = read_back(html_text.trained(), html_text.labelled_pages(200, seed=77))
    assert exact >= 0.8 and precision >= 0.96 and recall >= 0.98


def test_html_marks_never_seen():
    """Kinds of containers, and of what stands around them, that no training page had."""
    known = html_text.train(n=1200, pages=html_text.labelled_pages(1200, 5, html_text._CONTENT[:-4], {k: v[:-3] for k, v in html_text._AROUND.items()}))
    _, precision, recall = read_back(known, html_text.labelled_pages(200, 78, html_text._CONTENT[-4:], {k: v[-3:] for k, v in html_text._AROUND.items()}))
    assert precision >= 0.93 and recall >= 0.97


def test_html_marginals():
    """Messages up and down give what the sum over all states gives."""
    model = html_text.trained()
    for page in ("<div><p>one two</p><p class=ad>three</p></div><ul><li>a<li>b</ul>", "<body><nav><a>x</a></nav><article>t<div>u<p>v</article>", "text"):
        parsed = html_text.parse(page)
        nodes, bands = parsed.nodes, html_text._bands(parsed)
        own = [model.potential(x, nodes[x.parent].tag if x.parent >= 0 else "", b) for x, b in zip(nodes, bands)]
        total, content = 0.0, [0.0] * len(nodes)
        for states in itertools.product((0, 1), repeat=len(nodes)):
            weight = 1.0
            for k, (x, s) in enumerate(zip(nodes, states)):
                weight *= own[k] if s else 1 - own[k]
                if x.parent >= 0:
                    weight *= (model.moves.get(html_text.kind_of(x)) or ((0.5, 0.5), (0.5, 0.5)))[states[x.parent]][s]
            total += weight
            content = [c + weight * s for c, s in zip(content, states)]
        assert np.allclose(model.marginals(parsed), [c / total for c in content])


SENTENCES = ["The river rises in the north and runs for many miles through woods.", "It was long thought to have no source; then one was found.", "Boats still go up as far as the old mill."]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><body><p>{0}</p><p>{1}</p></body></html>", "{0}\n{1}"),
        ("{0} {1}", "{0} {1}"),
        ("<p class='x>{0}</p><p>{1}</p>", "{0}\n{1}"),
        ('<div class="zq1"><a href=1>Home</a> <a href=2>About us</a></div><div class="zq2"><p>{0}</p><p>{1}</p><p>{2}</p></div><div class="zq3">Copyright 2024. All rights reserved.</div>', "{0}\n{1}\n{2}"),
        ("<nav><ul><li><a>Home</a></ul></nav><article><p>{0}<script>if (a < b) x('</p>')</script><p>{1} &lt;b&gt; &eacute;</article><footer>f", "{0}\n{1} <b> é"),
    ],
)
def test_html_pages(page, text):
    assert html_text.trained().text(page.format(*SENTENCES)) == text.format(*SENTENCES)


def test_html_deep_pages():
    """Time grows with the page, whatever stays open."""
    start = time.process_time()
    for page in ("<div>" * 50_000 + "x", "<p><b><i>x" * 20_000, "</i></p></section>" * 20_000, "<td><li>x" * 20_000, "<b " * 20_000, "<p a='" * 2_000 + "x"):
        html_text.trained().text(page)
    assert time.process_time() - start < 20


def test_neighbours_in_doubles(spark, monkeypatch):
    """Double components are not rounded, and parts that come in many batches are searched as a whole."""
    monkeypatch.setattr(neighbours, "enough", lambda *a: 1.0)
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((300, 4)), 2) + rng.standard_normal((300, 4)) * 1e-9
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id < 50").withColumnRenamed("vec_id", "query_id").unionByName(spark.createDataFrame([(60, [1.0] * 3)] * 400, "query_id long, embedding array<double>"))
    whole = sorted(map(tuple, neighbours.search(vectors, queries).collect()))
    for q in range(50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        assert [(r[2], r[3]) for r in whole if r[0] == q] == [(i, d[i]) for i in best]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, neighbours.search(vectors, queries).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_share_is_measured(spark):
    """Clustered vectors are searched in a small part, those without structure in a large one; exact neighbours are brute force's."""
    rng = np.random.default_rng(1)
    plain = rng.standard_normal((4000, 32))
    clustered = np.repeat(rng.standard_normal((40, 32)) * 3, 100, 0) + rng.standard_normal((4000, 32)) * 0.5
    shares = []
    for x in (plain, clustered):
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
        shares.append(neighbours.build(vectors).share)
    assert shares[1] < 0.1 < 0.3 < shares[0] <= 1
    got = collections.defaultdict(list)
    for r in neighbours.nearest(vectors, np.arange(0, 4000, 400), x[::400], 10).collect():
        got[r.row].append(r.embedding)
    for row, q in enumerate(range(0, 4000, 400)):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert sorted(got[row]) == sorted(x[i].tolist() for i in np.argsort(d)[:10])


def test_html(spark):
    page = "<html><body><nav><a href=x>m</a></nav><article><h1>A &amp; B</h1><p>One  two<br>three.<p>Four &am</article><footer>f</footer><script>x</script>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(rows).collect()} == {1: "A & B\nOne two three.\nFour &am", 2: "", 3: "", 4: ""}


LONG = "This is a longer paragraph number {} of the article, with some words more in it."


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><body><article><h1>A title 1</h1>{0}<ul class='comments'><li>Great post, thanks a lot!</li><li>I do not agree with this at all.</li></ul></article></body></html>", "A title 1\n{1}"),
        ("<article><h1>A title 1</h1>{0}<ul class='comments'><li><b>Bob</b> Great post, thanks!</li><li><p>I do not agree.</p></li></ul></article>", "A title 1\n{1}"),
        ("<html><body><article><p>One short paragraph here.</p><section class='comments'><h3>Comments</h3><p>Great post of yours.</p></section></article></body></html>", "One short paragraph here."),
        ("<html><body><table><tr><td><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></td><td><article>{0}</article></td></tr></table></body></html>", "{1}"),
        ("<table><tr><td><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></td><td><h1>A title 1</h1>{0}</td></tr></table>", "A title 1\n{1}"),
        ("just text", "just text"), ("<body>two words</body>", "two words"), ("<p>word</p>", "word"),
        ("<article><p>Before the table stands this.</p><table><tr><td>1</td><td>two</td></tr></table><ul><li>One item.</li></ul></article>", "Before the table stands this.\n1\ntwo\nOne item."),
    ],
)
def test_html_comments_menus_and_short_pages(page, text):
    lines = [LONG.format(i) for i in range(6)]
    assert html_text.trained().text(page.replace("{0}", "".join(f"<p>{x}</p>" for x in lines))) == text.replace("{1}", "\n".join(lines))
