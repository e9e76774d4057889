"""License scans by diagonal voting.

All rolling word 2-grams of all documents are hash-joined to the 2-gram positions of license templates; a hit votes for
the diagonal (document position - template position). Neighbouring diagonals of a template are merged, so that
words put in or left out move a passage by a few diagonals without losing it, and each merged span is verified by
the share of the template's 2-grams that it holds and by its length. A merged span that is too long, as where notices follow
each other closely, is searched for all spans within it that are not. Base phrases are templates whose
2-grams must all lie on one diagonal. The template table is a parameter of fixed, checked size, so it is broadcast;
documents are never shuffled, only their hits and their word counts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import pieces

#: What lies between words; A-Z are lower-cased only where words are compared, as it changes no boundary.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Phrase -> label, found wherever the words stand consecutively.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license notices, by the label that the method gives.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "gpl": ["licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["under the terms of the gnu lesser general public license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license"],
    "proprietary": ["all rights reserved", "no part of this publication may be reproduced or transmitted in any form without prior written permission"],
}
#: Diagonals this near belong to one passage.
NEAR = 4
#: Share of a template's 2-grams that a span must hold, and its greatest length in template lengths.
COVERAGE, STRETCH = 0.8, 1.5
MOST_TEMPLATE_WORDS = 100_000


def words(text: Column) -> Column:
    return pieces(F.coalesce(text, F.lit("")), SEPARATORS)


def spans_within(hits: Column, t_words: Column, repeats: int) -> Column:
    """Hits (pos, tpos) in order -> (first, share, last) of the span of the greatest allowed length from each hit on, where it holds enough."""
    longest = F.floor(F.lit(STRETCH) * t_words).cast("int")

    def held(x: Column, i: Column) -> Column:
        near = F.filter(F.slice(hits, i + 1, longest * repeats), lambda y: y["pos"] - x["pos"] + 2 <= longest)
        share = F.size(F.array_distinct(F.transform(near, lambda y: y["tpos"]))) / (t_words - 1)
        return F.struct(x["pos"].alias("first"), share.alias("share"), (F.array_max(F.transform(near, lambda y: y["pos"])) + 1).alias("last"))

    return F.filter(F.transform(hits, held), lambda x: x["share"] >= COVERAGE)


def apart(spans: Column) -> Column:
    """How many of the spans, taken from the left, share no word."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(x["first"] > a["last"], F.struct(x["last"].alias("last"), (a["n"] + 1).alias("n"))).otherwise(a)
    return F.aggregate(spans, start, step, lambda a: a["n"])


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """documents -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans; a row per row.

    Null or empty texts have no words, no labels (empty strings) and score 0. Rows that repeat a doc_id and text
    each get the same result. Extra columns are ignored, whatever their names. Very long texts are scanned whole; an empty table gives an
    empty result. Among spans of one template those that start first count. score is the best coverage of a verified span, 1 for a base phrase.
    """
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    known = [(True, p.split(), label) for p, label in base.items()] + [(False, p.split(), label) for label, ps in templates.items() for p in ps]
    if any(len(w) < 2 or not " ".join(w).isascii() for _, w, _ in known) or sum(len(w) for _, w, _ in known) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates need two ASCII words each, and {MOST_TEMPLATE_WORDS} in all at most")
    repeats = max((w[k:].count(x) for _, w, _ in known for k, x in enumerate(w)), default=1)
    spark = docs.sparkSession
    grams = spark.createDataFrame([(i, j, a, b) for i, (_, w, _) in enumerate(known) for j, (a, b) in enumerate(zip(w, w[1:]))], "t int, tpos int, ta string, tb string")
    grams = grams.withColumn("h", F.xxhash64("ta", "tb"))
    about = F.broadcast(spark.createDataFrame([(i, b, len(w), label) for i, (b, w, label) in enumerate(known)], "t int, is_base boolean, t_words int, label string"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    counted = rows.select("doc_id", "th", F.size("w").cast("long").alias("n_words"))
    pairs = rows.select("doc_id", "th", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("pos", "g"))
    pairs = pairs.select("doc_id", "th", "pos", "g.a", "g.b", F.xxhash64(F.lower("g.a"), F.lower("g.b")).alias("h"))
    # template words are ASCII: of a word's own letters only A-Z may have been folded
    same = "lower(a) = ta and lower(b) = tb and length(a) = octet_length(a) and length(b) = octet_length(b)"
    hits = pairs.join(F.broadcast(grams), "h").where(same).select("doc_id", "th", "t", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    diagonals = hits.groupBy("doc_id", "th", "t", "diagonal").agg(F.collect_set("tpos").alias("seen")).join(about, "t")
    key = ["doc_id", "th"]
    along = Window.partitionBy(*key, "t").orderBy("diagonal")
    span = diagonals.where("not is_base").withColumn("starts", F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= NEAR, 0).otherwise(1))
    span = span.withColumn("part", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    span = span.groupBy(*key, "t", "t_words", "label", "part").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"),
        F.min(F.col("diagonal") + F.array_min("seen")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("seen") + 1).alias("last"),
        # sorted once here: an expression inside the lambda below would be evaluated again at every hit
        F.array_sort(F.flatten(F.collect_list(F.transform("seen", lambda x: F.struct((F.col("diagonal") + x).alias("pos"), x.alias("tpos")))))).alias("hits"),
    )
    span = span.withColumn("share", F.col("votes") / (F.col("t_words") - 1)).where(F.col("share") >= COVERAGE)
    short = F.col("last") - F.col("first") + 1 <= STRETCH * F.col("t_words")
    whole = F.array(F.struct(F.col("first"), F.col("share"), F.col("last")))
    span = span.withColumn("spans", F.when(short, whole).otherwise(spans_within(F.col("hits"), F.col("t_words"), repeats))).where("size(spans) > 0")
    span = span.withColumn("n", apart(F.col("spans"))).withColumn("share", F.array_max(F.transform("spans", lambda x: x["share"])))
    exact = diagonals.where("is_base and size(seen) = t_words - 1")
    found = exact.select(*key, "label", F.col("diagonal").cast("long").alias("start"), F.lit(1.0).alias("share"), F.lit(0).alias("n")).unionByName(
        span.select(*key, "label", F.lit(None).cast("long").alias("start"), "share", "n")
    )
    per = found.groupBy(*key).agg(
        F.count("start").alias("n_base"),
        F.min("start").alias("first_word"),
        F.max("start").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
        F.sum("n").alias("n_spans"),
    )
    per = per.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    out = counted.join(per, F.expr("doc_id <=> _d and th = _t"), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
