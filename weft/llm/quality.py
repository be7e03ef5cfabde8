"""Quality rules by cross-document line frequency (operator 7); DataFrame functions only.

Every line is normalised and hashed together with its host (the document's
source), the distinct documents that hold it are counted per host, and lines in
more documents than the limit are removed.  A document is rejected once too
little of it is left, or by the per-document base rules.

Lines are made once and written, as hashes and lengths.  The rows that hold a
line are counted first, with partial sums; only for lines in more rows than the
limit are distinct documents told apart.

Defined results: null text has no words and fails the base rules; a null host
is a host of its own; rows of equal id, text and host are one document, and get
equal results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: A line in more documents of one host than this is removed.
MAX_DOCS = 20
#: A document keeps its place while this share of the characters of its distinct lines is left.
MIN_LEFT = 0.3
#: Lines (of 8 bytes) that are broadcast at most, and the parts of a line's documents beyond that.
BROADCAST, SALTS = 500_000, 32

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once and not at each place where it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """The runs of other characters than ASCII white space."""
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t\\n\\x0B\\f\\r]+"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the array.

    Windows are compared by a 64-bit hash.  Only arrays with equal hashes are
    sorted to find where they stand.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))

    def covered(placed: Column) -> Column:
        again = F.filter(
            F.transform(placed, lambda x, k: F.when((F.get(placed, k - 1).h == x.h) | (F.get(placed, k + 1).h == x.h), x.i)),
            lambda i: i.isNotNull(),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))

    def sort(hs: Column) -> Column:
        return F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    some = _bound(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(_bound(sort(hs), covered)))
    return F.when(F.size(words) < 4, 0).otherwise(some).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(
        "*",
        F.length(_without(text, _BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, _SYMBOLS))).cast("long").alias("n_symbols"),
        _bound(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _bound(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).alias("n_repeat_words"))).alias("w"),
    ).select("*", "w.*").drop("w")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def hashed_lines(text: Column, host: Column) -> Column:
    """Each distinct normalised line with a word, as (hash with the host, length).

    Normalised: lower case, runs of blanks as one, none at the ends, numbers as 0.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\x0B\\f\\r]+", " "), "[0-9]+", "0")
    lines = F.array_distinct(F.transform(_lines(plain), lambda x: F.btrim(x)))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(host, x).alias("line"), F.length(x).cast("long").alias("n")))


def _key(host: str) -> list[Column]:
    """What a document is known by: id and key, a hash of its text and host."""
    return [F.col("doc_id").cast("long").alias("id"), F.xxhash64("text", host, F.col("text").isNull(), F.col(host).isNull()).alias("key")]


def line_table(docs: DataFrame, host: str = "source") -> DataFrame:
    """id, key and lines (array of line hash and length) of every row, written."""
    return written(docs.select(*_key(host), hashed_lines(F.col("text"), F.col(host)).alias("lines")), "lines")


def _of(each: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of each whose line is in lines (line): broadcast up to BROADCAST lines, else dealt out with a salt, since a line may be very common."""
    if lines.count() <= BROADCAST:
        return each.join(F.broadcast(lines), "line")
    salted = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return each.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"]).drop("salt")


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """id, key, line and n of the lines that stand in more than max_docs distinct documents of one host; of a line_table, written."""
    each = lines.select("id", "key", F.explode("lines").alias("x")).select("id", "key", "x.line", "x.n")
    often = written(each.groupBy("line").count().where(F.col("count") > max_docs).select("line"), "often")
    held = written(_of(each, often).groupBy("line", "id", "key").agg(F.max("n").alias("n")), "held")
    frequent = written(held.groupBy("line").count().where(F.col("count") > max_docs).select("line"), "frequent")
    return written(_of(held, frequent), "removed")


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """Documents' doc_id with base features, line_chars, removed_chars and the verdict ``kept``."""
    lines = line_table(docs, host)
    removed = frequent_lines(lines, max_docs).groupBy("id", "key").agg(F.sum("n").alias("removed_chars"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x.n)
    sums = lines.select("id", "key", total.alias("line_chars"), F.lit(0).cast("long").alias("removed_chars")).unionByName(removed.withColumn("line_chars", F.lit(0).cast("long")))
    sums = sums.groupBy("id", "key").agg(F.max("line_chars").alias("line_chars"), F.max("removed_chars").alias("removed_chars"))
    base = features(docs.select("doc_id", "text", host)).select("*", *_key(host)).drop("text", host)
    joined = base.alias("b").join(written(sums, "sums").alias("s"), F.col("b.id").eqNullSafe(F.col("s.id")) & (F.col("b.key") == F.col("s.key")))
    left = F.col("line_chars") - F.col("removed_chars")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_chars", "removed_chars",
        (~F.col("base_failed") & (left >= min_left * F.col("line_chars"))).alias("kept"),
    )


def without_frequent_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """docs with the frequent lines taken out of their texts; other lines stay as they are."""
    marks = frequent_lines(line_table(docs, host), max_docs).groupBy("id", "key").agg(F.collect_set("line").alias("frequent"))
    marks = marks.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("frequent").alias("_frequent"))
    plain = docs.drop("_id", "_key", "_frequent")
    own_id, own_key = _key(host)
    joined = plain.join(marks, own_id.eqNullSafe(F.col("_id")) & (own_key == F.col("_key")), "left")
    line_hash = lambda x: F.get(F.transform(hashed_lines(x, F.col(host)), lambda h: h.line), 0)
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains("_frequent", line_hash(x)), F.lit(False)))
    return joined.withColumn("text", F.when(F.col("_frequent").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*plain.columns)
