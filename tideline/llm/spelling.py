"""Spelling variants grouped by symmetric deletion.

Every word of the vocabulary emits the hash of itself and of each distinct single deletion; words that share a key are
candidates, and those at an edit distance of exactly one are near. A key's words differ in one place of the same string, so
a key holds at most (length + 1) * letters of the alphabet words, whatever the corpus. Key rows carry a word's number and not
its letters, so that a long word costs 16 bytes a deletion. Each word takes the most frequent near word as its form if that is
at least twice as frequent; roots are found by pointer doubling, as a form is always more frequent than its word.
Built-in functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut

RUN = r"[A-Za-zÀ-ÿ]+"
#: A run whose hash this divides loses one letter.
EDITED = 97
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2


def folded(word: Column) -> Column:
    """Lower-case A-Z only."""
    slow = F.translate(word, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(slow)


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """documents -> (word, n): runs of letters after the edit, of LEAST_LETTERS letters and `least` occurrences or more."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("w")).select("doc_id", folded(F.col("w")).alias("w"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "w").cast("binary"))
    at = (F.col("h") % F.length("w")).cast("int")
    shorter = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % EDITED == 0, shorter).otherwise(F.col("w")).alias("word"))
    return words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near_words(words: DataFrame) -> DataFrame:
    """(id long, word) -> (a, b): ids of words that differ by exactly one inserted, deleted or replaced letter, once a pair."""
    n = F.length("word")
    deleted = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, n))))
    keys = words.select("id", F.explode(F.array_distinct(F.concat(F.array(F.xxhash64("word")), deleted))).alias("k"))
    pairs = keys.toDF("a", "k").join(keys.toDF("b", "k"), "k").where("a < b").select("a", "b").distinct()
    full = pairs.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b")
    return full.where(F.levenshtein("wa", "wb", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, up) with up null at the top -> (word, root), by doubling: each round follows twice as many forms."""
    up = cut(forms.select("word", F.coalesce("up", "word").alias("root")))
    while True:
        over = up.where("word <> root").select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        nxt = cut(up.join(over, up.root == over["_w"], "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        up = nxt.select("word", "root")
        if nxt.where("moved").head() is None:
            return up


def group_variants(docs: DataFrame) -> DataFrame:
    """documents -> word, form, root, n, n_near, form_n; one row a word of the vocabulary.

    Null and empty texts have no word; runs in a row with a null doc_id keep all their letters; repeated rows count as often as they
    stand. Very long texts and runs are taken whole. Of near words with equal n the smallest in code-point order is the form. Extra columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    words = cut(vocabulary(docs).select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = cut(near_words(words.select("id", "word")))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    d = words.join(best, words.id == best.a, "left")
    enough = -F.col("best.less") >= RATIO * F.col("n")
    d = cut(d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    top = roots(d.select("word", F.col("form").alias("up")))
    return d.join(top, "word").select("word", "form", "root", "n", "n_near", "form_n")
