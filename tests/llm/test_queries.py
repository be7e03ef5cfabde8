"""The registered opN_ queries and the pipeline's stages, on small tables of odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weft.llm import packing, queries

from .test_operators import brute_components, brute_removed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _score int, component_id int, spans string, kept string, _rest int, key int, id int"
LATIN, OTHER = ["the", "ing", "ton", "of", "and"], ["ção", "ñar", "que", "los", "é"]

#: Contract columns and types.
CONTRACT = {
    "op1_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op2_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


def make_rows():
    rng = random.Random(12)
    words = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(n))
    passage = words(LATIN, 60)
    out = []
    for i in range(160):
        parts, lang = (LATIN, "xx") if i % 3 else (OTHER, "yy")
        text = words(parts, rng.randint(60, 140))
        if i % 8 == 0:
            text = text + " awfulword nastything awfulword"
        if i % 20 == 5:
            text = f"{text[:200]} {passage} {text[200:]}"
        out.append((i, text, lang, f"s{i % 2}"))
    a, b = out[30][1].split(), out[31][1].split()
    out += [(200, " ".join([*a[:-1], "changed"]), "yy", "s0"), (201, out[31][1], "xx", "s1"), (202, " ".join(["Other", *b[1:]]), "xx", "s0"), (203, out[31][1].upper(), "xx", "s0")]
    out += [(300, None, None, None), (301, "", "xx", "s0"), (302, " \n\t ", None, "s0"), (303, "one", "xx", None), (304, "12 34 !", "xx", "s0"), (305, "x" * 1_000_000, None, "s1"), (306, words(LATIN, 30_000), "xx", "s1")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


ROWS = make_rows()


def frame(spark, rows):
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.withColumns({"score": F.lit("own"), "_score": F.lit(1), "component_id": F.lit(2), "spans": F.lit("s"), "kept": F.lit("k"), "_rest": F.lit(3), "key": F.lit(4), "id": F.lit(5)})


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two folders: the odd tables, and the same ones without rows."""
    rng = np.random.default_rng(5)
    base = str(tmp_path_factory.mktemp("tables"))
    labels = [(i, int(i % 8 == 0), 1) for i in range(0, 120)] + [(130, None, 0), (None, 1, 1), (9999, 1, 1), (8, 1, 1), (8, 0, 1)]
    pages = [(i, f"http://h/{i}", f"<nav><a>m{i}</a></nav><article><p>Text {i} of a page, long enough.</p></article>") for i in range(20)] + [(30, None, None), (31, "u", ""), (32, "u", "<p>" * 3000), (None, "u", "x")]
    vectors = [(i, rng.standard_normal(8).tolist()) for i in range(220)] + [(400, None), (500, [0.0] * 8), (600, [float("nan")] * 8), (700, [1.0]), (800, [None] * 8)]
    whole = {
        "documents": frame(spark, ROWS), "labels": spark.createDataFrame(labels, "doc_id long, toxic int, quality int").withColumn("text", F.lit("clash")),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)),
    }
    for name, df in whole.items():
        df.write.parquet(f"{base}/some/{name}.parquet")
        df.limit(0).write.parquet(f"{base}/none/{name}.parquet")
    return f"{base}/some", f"{base}/none"


@pytest.fixture(scope="module")
def results(spark, tables):
    """Each query's rows, made once."""
    made = {}

    def get(name):
        if name not in made:
            df = queries.QUERIES[name](spark, tables[0])
            made[name] = (dict(df.dtypes), df.collect())
        return made[name]

    return get


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(results, name):
    types, rows = results(name)
    for column in CONTRACT[name].split(", "):
        column, kind = column.split(" ")
        assert types[column] == kind
    assert rows


@pytest.mark.parametrize("name", CONTRACT)
def test_empty_tables(spark, tables, name):
    df = queries.QUERIES[name](spark, tables[1])
    assert df.collect() == [] and {c.split(" ")[0] for c in CONTRACT[name].split(", ")} <= set(df.columns)


@pytest.mark.parametrize("name", [n for n in CONTRACT if n.split("_")[0] not in ("op1", "op6", "op10")])
def test_one_row_per_document(results, name):
    assert sorted(r.doc_id for r in results(name)[1]) == [r[0] for r in ROWS]


def test_op1(results):
    got = {r.page_id: (r.text, r.n_chars) for r in results("op1_html_extraction")[1]}
    assert all(got[i] == (t := f"Text {i} of a page, long enough.", len(t)) or got[i][0] == t for i in range(20)) and got[30] == got[31] == got[32] == ("", 0) and len(got) == 24


def test_op2(results):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in results("op2_minhash_near_dedup")[1]}
    assert got == brute_components([(i, t or "", s) for i, t, _, s, _ in ROWS], 4)


def test_folds(results):
    for name, n, of in (("op4_language_id", 3, 1), ("op5_toxicity", 4, 2)):
        rows = results(name)[1]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == of) and 0 <= r.score <= 1 for r in rows)


def test_op4(results):
    got = {r.doc_id: r for r in results("op4_language_id")[1]}
    held = [(got[i].lang_pred, lang) for i, _, lang, _, _ in ROWS if i < 160 and got[i].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.9 * len(held)
    assert {got[i].lang_pred for i in (300, 301, 302, 304)} == {"und"} and got[306].lang_pred == "xx"


def test_op5(results):
    got = {r.doc_id: r for r in results("op5_toxicity")[1]}
    held = [(got[i].predicted, int(i % 8 == 0)) for i in range(160) if got[i].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.9 * len(held) and all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_op6(results):
    by = collections.defaultdict(list)
    for r in sorted(results("op6_nearest_neighbours")[1], key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append(r)
    assert set(by) == {0, 100, 200} and all([r.rank for r in x] == list(range(1, 11)) and [r.score for r in x] == sorted(r.score for r in x) and q not in {r.vec_id for r in x} for q, x in by.items())


def test_op8(results):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t, *_ in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in results("op8_bpe")[1]} == want


def test_op9(results):
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in results("op9_substring_dedup")[1]), key=str)
    assert got == brute_removed([(i, t, s) for i, t, _, s, _ in ROWS], 35)


def test_op10(results):
    rows = results("op10_best_fit_packing")[1]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    of, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t, *_ in ROWS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(of[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist() and sum(r.length for r in mine) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine) and all(r.length == 2048 for r in mine[1:])
    for x in seq.values():
        x.sort(key=lambda r: r.offset)
        assert [r.offset for r in x] == np.cumsum([0, *(r.length for r in x)])[:-1].tolist() and sum(r.length for r in x) <= 2048
    assert len(seq) <= -(-sum(r.length for r in rows) // 2048) + 1


# ---- the pipeline ----

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns(spark, tables, name):
    """Also those with the names of columns that operators add; and empty tables stay empty."""
    for folder in tables:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        got = STAGES[name](spark, docs, folder)
        assert got.dtypes == docs.dtypes
        if folder == tables[1]:
            assert got.collect() == []
        else:
            row = got.first()
            assert (row.score, row._score, row.component_id, row.spans, row.kept, row._rest, row.key, row.id) == ("own", 1, 2, "s", "k", 3, 4, 5)


def ids_of(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_not_toxic(spark, tables):
    kept = ids_of(STAGES["toxicity"](spark, frame(spark, ROWS), tables[0]))
    assert {i for i in range(0, 160, 8)}.isdisjoint(kept) and {i for i in range(160) if i % 8} <= set(kept) and {300, 301, 302} <= set(kept)


def test_of_known_language(spark, tables):
    kept = ids_of(STAGES["language"](spark, frame(spark, ROWS), tables[0]))
    assert set(range(160)) <= set(kept) and {300, 301, 302, 304}.isdisjoint(kept)


def test_one_of_each_group(spark, tables):
    rows = [*ROWS, ROWS[7], (None, ROWS[9][1], "xx", "s", 1), (None, "no other text is like this one " * 3, "xx", "s", 1), (7, ROWS[40][1] + " more", "xx", "s", 1)]
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in STAGES["near_duplicates"](spark, frame(spark, rows), tables[0]).select("doc_id", "text").collect())
    of = brute_components([(i, t or "", s) for i, t, _, s, _ in ROWS], 5)
    assert kept == sorted([(i, t or "") for i, t, *_ in ROWS if of[i][2] and i != 40] + [(-1, rows[-2][1])] + [(7, rows[-1][1])])


def test_without_repeated_passages(spark, tables):
    got = {r.doc_id: r for r in STAGES["repeated_passages"](spark, frame(spark, ROWS), tables[0]).collect()}
    for i, n, removed, digest in brute_removed([(i, t, s) for i, t, _, s, _ in ROWS], 50):
        if n == removed:
            assert i not in got
        else:
            assert hashlib.sha256(" ".join(WORD.findall(got[i].text)).encode()).hexdigest() == digest and got[i].n_chars == len(got[i].text)


def test_packed(spark, tables):
    rows = STAGES["packing"](spark, frame(spark, ROWS), tables[0]).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS} and max(r.offset + r.length for r in rows) <= packing.CAPACITY


def test_run(spark, tables):
    """The whole chain, against the stages' own rules: nothing toxic, of no language, or twice comes through."""
    ids = {r.doc_id for r in corpus_pipeline.run(spark, tables[0]).collect()}
    assert {i for i in range(0, 160, 8)}.isdisjoint(ids) and {300, 301, 302, 304, 201, 202, 203}.isdisjoint(ids) and {i for i in range(160) if i % 8 and i != 31} <= ids | {7, 30}
    assert corpus_pipeline.run(spark, tables[1]).collect() == []
