"""From raw documents to packed sequences: five stages, each an operator of weft.llm.

Every stage gets what the one before kept, as a table of documents (doc_id,
text, lang, source, n_chars and any other columns), and all but the last return
such a table.  Null and empty texts pass the toxicity stage with the score of a
text without features, are rejected as of no language by the second, and so
never reach the others; documents without an id stay where a group is reduced
to one; empty tables give empty tables of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import language, neardup, packing, substrings, toxicity
from weft.llm.scratch import bounded_batches, table, written

#: A document whose most likely language is less likely than this is of no known language.
LEAST_LANGUAGE = 0.35


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """doc_id, text and all other columns as one, so that no name of theirs meets one that an operator adds; and how to get them back."""
    bounded_batches(docs.sparkSession)
    own = ("doc_id", "text")
    rest = [F.col(c) for c in docs.columns if c not in own] or [F.lit(None).cast("string").alias("none")]
    return docs.select(*own, F.struct(*rest).alias("_rest")), [F.col(c) if c in own else F.col("_rest")[c].alias(c) for c in docs.columns]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of operator 5, trained on all labels of the corpus."""
    rows, columns = _apart(docs)
    model = toxicity.train_on_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(rows, model).where(F.col("score") < toxicity.THRESHOLD).select(*columns)


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that operator 4 has learned from the corpus and is sure enough of."""
    rows, columns = _apart(docs)
    net = language.train(docs)
    return language.predict(rows, net).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates, once."""
    rows, columns = _apart(docs)
    return neardup.one_of_each_group(rows).select(*columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that operator 9 removes; those with nothing left go."""
    rows, columns = _apart(docs)
    cut = substrings.cut_texts(rows).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10's pieces with their sequences and places."""
    bounded_batches(spark)
    return packing.pack(written(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


STAGES = [
    ("toxicity", not_toxic),
    ("language", of_known_language),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", without_repeated_passages),
    ("packing", packed),
]

#: Three of the stages learn, hash or search in ways that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
