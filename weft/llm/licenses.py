"""License scans (operator 3); DataFrame functions only.

The method is an exact set-similarity join between license templates and the
blocks of all texts.  Blocks are sentences, and passages of consecutive words,
which cross line ends and 'v. 2.0': two passages overlap by half, so every
window of a template's width lies in one of them, and a template is found in a
passage if one such window holds the share of its tokens.  Tokens are ordered
by their frequency in the whole corpus, rarest first.  A block that holds the
share of a template's tokens must hold one of the template's prefix tokens,
must have at least that many tokens, and must stand early enough in the common
order to still reach the overlap: these prefix, length and positional filters
lose no match, and the exact overlap is counted last.

Defined results: null and empty texts have no words, places or labels and score
0; repeated rows get equal results; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices by which public licenses are granted, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "You may not use this file except in compliance with the License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
]
#: The share of a template's tokens that a block must hold.
CONTAINMENT = 0.95

#: Whole notices, found in windows only, with a share that allows for changed words.
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
]
NOTICE_CONTAINMENT = 0.9

_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _places(phrases: list[str]) -> str:
    """A regular expression of the places of phrases; A-Z counts as a-z."""
    return f"(?is)(?<!{_WORD})(?:{'|'.join(_GAP.join(p.split()) for p in phrases)})(?!{_WORD})"


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{_WORD}+")).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _GAP), "")


def tokens_of(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(words_of(text))


def base(docs: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_labels (an array)."""
    text, places = F.coalesce("text", F.lit("")), _places(list(PHRASES))
    found = F.col("n_base") > 0
    before = lambda lazy: _n_words(F.regexp_extract(text, f"(?is)^(.*{lazy}){places[5:]}", 1))
    return (
        docs.withColumn("n_words", _n_words(text))
        .withColumn("n_base", F.regexp_count(text, F.lit(places)).cast("long"))
        .withColumn("first_word", F.when(found, before("?")))
        .withColumn("last_word", F.when(found, before("")))
        .withColumn("base_labels", F.when(found, F.array_compact(F.array(*[F.when(text.rlike(_places([p])), F.lit(v)) for p, v in PHRASES.items()]))).otherwise(F.array().cast("array<string>")))
    )


def blocks(text: Column) -> Column:
    """The sentences of a text: cut at line ends and at white space behind . ! or ?"""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r\x0B\f]+", "$1\n"), "\n")


def template_table(spark, templates, containment: float, frequency: dict[str, int], notices=(), notice_containment: float = NOTICE_CONTAINMENT) -> tuple[DataFrame, list[str]]:
    """Templates' and notices' prefix tokens with their places, and all their tokens in global order."""
    wanted = [(label, _plain(text), containment, False) for label, text in templates] + [(label, _plain(text), notice_containment, True) for label, text in notices]
    order = sorted({w for _, t, _, _ in wanted for w in t}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for k, (label, text, share, notice) in enumerate(wanted):
        sorted_tokens = sorted(set(text), key=rank.__getitem__)
        size = len(sorted_tokens)
        need = math.ceil(share * size - 1e-9)
        rows += [(k, label, w, i, size, need, width(text, share), notice, sorted_tokens) for i, w in enumerate(sorted_tokens[: size - need + 1])]
    return spark.createDataFrame(rows, "template int, label string, token string, place int, size int, need int, width int, notice boolean, tokens array<string>"), order


def width(text: list[str], share: float) -> int:
    """The words of a window in which a template is looked for: as many foreign words may stand in it as may be missing."""
    return math.ceil(len(text) / share - 1e-9)


def passages(words: Column, wide: int) -> Column:
    """Runs of 2 * wide words, one from every wide words on, so that each run of wide words lies in one."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(wide))
    return F.transform(starts, lambda i: F.slice(words, i + 1, 2 * wide))


def matches(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, notices=NOTICES) -> DataFrame:
    """One row or more per block and template that meet the threshold: doc_id, text_hash, label, containment.

    The templates' tokens are the only ones whose frequencies decide anything,
    so only those are counted, over all texts; their number is bounded by the
    templates, not by the corpus.
    """
    spark = docs.sparkSession
    words = sorted({w for _, t in [*templates, *notices] for w in _plain(t)})
    literal = F.array(*map(F.lit, words))
    counts = docs.select(F.explode(F.array_intersect(tokens_of(F.col("text")), literal)).alias("token")).groupBy("token").count()
    prefixes, order = template_table(spark, templates, containment, {r.token: r["count"] for r in counts.collect()}, notices)
    rare = F.array(*map(F.lit, sorted({r.token for r in prefixes.select("token").collect()})))
    least, wide = prefixes.agg(F.min("need"), F.max("width")).first()
    ordered = F.array(*map(F.lit, order))
    block = lambda words, passage: F.struct(words.alias("words"), F.lit(passage).alias("passage"))
    with_rare = lambda found: F.filter(found, lambda b: F.arrays_overlap(b.words, rare))
    candidates = (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", words_of(F.col("text")).alias("words"))
        .where(F.arrays_overlap("words", rare))
        .select("doc_id", "text_hash", F.explode(F.concat(
            with_rare(F.transform(blocks(F.col("text")), lambda b: block(words_of(b), False))),
            with_rare(F.transform(passages(F.col("words"), wide), lambda w: block(w, True))),
        )).alias("block"))
        .select("doc_id", "text_hash", F.col("block.words").alias("words"), F.col("block.passage").alias("passage"), F.array_distinct("block.words").alias("held"))
        .where(F.size("held") >= least)  # length filter, for the smallest template
        .select("doc_id", "text_hash", "words", "passage", F.size("held").alias("n"), F.array_intersect(ordered, F.col("held")).alias("held"))
        .select("doc_id", "text_hash", "words", "passage", "n", "held", F.posexplode("held").alias("at", "token"))
    )
    fits = (F.col("n") >= F.col("need")) & (F.lit(1) + F.least(F.col("size") - F.col("place") - 1, F.size("held") - F.col("at") - 1) >= F.col("need"))
    overlap = F.size(F.array_intersect("tokens", "held"))
    heads = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains("tokens", F.get("words", i - 1)))  # a window may begin with a template's token
    in_window = F.array_max(F.transform(heads, lambda i: F.size(F.array_intersect("tokens", F.slice("words", i, F.col("width"))))))
    return (
        candidates.join(F.broadcast(prefixes), "token").where(fits & (F.col("passage") | ~F.col("notice")))  # prefix, length and positional filters
        .where(overlap >= F.col("need"))
        .withColumn("overlap", F.when(F.col("passage"), in_window).otherwise(overlap))
        .where("overlap >= need")
        .select("doc_id", "text_hash", "label", (F.col("overlap") / F.col("size")).alias("containment"))
    )


def _plain(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, notices=NOTICES) -> DataFrame:
    """doc_id with the base columns, labels (array) and score."""
    found = written(
        matches(docs, templates, containment, notices).groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"))
        .agg(F.collect_set("label").alias("found_labels"), F.max("containment").alias("containment")),
        "licenses",
    )
    held = base(docs.select("doc_id", "text")).withColumn("text_hash", F.xxhash64("text")).drop("text")
    joined = held.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    no_labels = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_sort("base_labels").alias("base_labels"),
        F.array_sort(F.array_union("base_labels", F.coalesce("found_labels", no_labels))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
