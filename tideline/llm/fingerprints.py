"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (line) has a wide vector: lanes expanded from its digest, counters of the hash bits of its pieces, and the
number of its pieces. A document's fingerprint is the sum of its paragraphs' vectors modulo 2**32 in every lane. So the
order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting its vector. The first lanes
tell multisets of paragraphs apart; the counters are small sums of signs in disguise (2 * counter - pieces), so that their
inner products estimate how much two documents share even where no paragraph is whole in both.
Pieces are cut by what they hold, so that an edit changes those around it alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import cut

#: Lanes from the digest, and counters; all modulo 2**32.
WIDE, COUNTERS = 32, 64
MASK = 0xFFFFFFFF
#: 8 characters or more of a line, up to a word that ends in one of a few letters or in a stop.
PIECE = r"[^\n]{8,}?(?:[dtyo.,;:!?|%#$&*)](?=\s)|(?=\n)|$)|[^\n]+"
_LOW = 0x0000000100000001


def _wide_lanes(paragraphs: Column) -> Column:
    """Sum of the digest lanes of an array of paragraphs."""
    digests = F.transform(paragraphs, lambda p: F.sha2(p.cast("binary"), 256))
    zero = F.array_repeat(F.lit(0).cast("long"), WIDE)
    return F.aggregate(digests, zero, lambda acc, d: F.transform(acc, lambda a, i: (a + F.xxhash64(d, i).bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _hex(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def paragraph_vector(paragraph: Column) -> Column:
    """All lanes of one paragraph, as an array of longs."""
    hashes = F.transform(_pieces(paragraph), lambda x: F.xxhash64(x))
    counts = F.transform(F.sequence(F.lit(0), F.lit(COUNTERS - 1)), lambda b: F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)).cast("long"))
    return F.concat(_wide_lanes(F.array(paragraph)), counts, F.array(F.size(hashes).cast("long")))


def insert(lanes: Column, paragraph: Column) -> Column:
    """The fingerprint lanes with a paragraph more."""
    return F.zip_with(lanes, paragraph_vector(paragraph), lambda a, b: (a + b).bitwiseAND(F.lit(MASK)))


def delete(lanes: Column, paragraph: Column) -> Column:
    """The fingerprint lanes with a paragraph less; undoes insert()."""
    return F.zip_with(lanes, paragraph_vector(paragraph), lambda a, b: (a - b).bitwiseAND(F.lit(MASK)))


def as_string(lanes: Column) -> Column:
    return _hex(lanes)


def fingerprint_lanes(docs: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """keys, text (not null), more -> keys, more, lanes. Rows with equal keys must be one row; nothing is shuffled that is partitioned by the keys."""
    # two steps: what stands beside a generator in one select is computed for each row that it makes
    d = docs.select(*keys, *more, _wide_lanes(F.split("text", "\n")).alias("wide"), _pieces(F.col("text")).alias("pieces"))
    d = d.select(*keys, *more, "wide", F.explode_outer("pieces").alias("piece"))
    d = d.select(*keys, *more, "wide", F.when(F.col("piece").isNotNull(), F.xxhash64("piece")).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LOW))).alias(f"s{j}") for j in range(32)]
    g = d.groupBy(*keys, *more, "wide").agg(F.count("h").alias("n"), *sums)
    got = [F.coalesce(f"s{j}", F.lit(0).cast("long")) for j in range(32)]
    counts = F.array(*[x.bitwiseAND(F.lit(MASK)) for x in got], *[F.shiftrightunsigned(x, 32) for x in got])
    return g.select(*keys, *more, F.concat("wide", counts, F.array(F.col("n"))).alias("lanes"))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints' lanes, 0 to 1: twice the shared pieces (squared counts) by all, as the counters estimate it; 1 if they are equal."""

    def signs(lanes: Column) -> Column:
        n = F.element_at(lanes, WIDE + COUNTERS + 1)
        return F.transform(F.slice(lanes, WIDE + 1, COUNTERS), lambda c: (2 * c - n).cast("double"))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    sa, sb = signs(a), signs(b)
    shared = total(F.zip_with(sa, sb, lambda x, y: x * y))
    size = total(F.transform(sa, lambda x: x * x)) + total(F.transform(sb, lambda x: x * x))
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * shared / size)))


def next_in_order(keys: DataFrame) -> DataFrame:
    """(doc, th, n), distinct -> the same with ndoc, nth: the next key in descending order; after the last comes the first.

    Keys are range-partitioned; the next one is found inside each partition, and over its border from
    the partitions' first keys, of which there are as many as partitions.
    """
    down = [F.desc("doc"), F.desc("th")]
    d = cut(keys.repartitionByRange(*down).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*down)
    d = d.withColumn("next", F.lead(F.struct("doc", "th")).over(inside))
    starts = d.groupBy("part").agg(F.max(F.struct("doc", "th")).alias("start"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = starts.select("part", F.coalesce(F.lead("start").over(Window.orderBy("part")), F.first("start").over(over)).alias("after"))
    d = d.join(starts, "part").withColumn("next", F.coalesce("next", "after"))
    return cut(d.select("doc", "th", "n", F.col("next.doc").alias("ndoc"), F.col("next.th").alias("nth")))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's. Null texts are empty. Rows that repeat a doc_id and text are one document and give one row; different texts of
    one doc_id are ordered by their hash, null doc_ids come last. A single document is its own next. Extra columns are ignored, whatever their names.
    Very long texts are hashed whole; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id")).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys = texts.select("doc", "th", F.length("text").alias("n"))
    order = next_in_order(keys.distinct())
    if order.count() < docs.count():
        texts = texts.dropDuplicates(["doc", "th"])
    own = fingerprint_lanes(texts, ["doc", "th"])
    before = order.select(F.col("ndoc").alias("doc"), F.col("nth").alias("th"), F.col("doc").alias("pdoc"), F.col("th").alias("pth"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    heads = texts.join(before, ["doc", "th"]).select(F.col("pdoc").alias("doc"), F.col("pth").alias("th"), "half", F.substring("text", F.lit(1), F.col("half")).alias("head"))
    n = F.length("text")
    edited = texts.join(heads, ["doc", "th"]).select("doc", "th", n.alias("n"), F.concat(F.substring("text", F.lit(1), n - F.col("half")), "head").alias("text"))
    edited = edited.select("doc", "th", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"), "text")
    edited = fingerprint_lanes(edited, ["doc", "th"], "n_chars", "edited_sha256").withColumnRenamed("lanes", "edited")
    following = own.join(before, ["doc", "th"]).select(F.col("pdoc").alias("doc"), F.col("pth").alias("th"), F.col("lanes").alias("following"))
    all_ = edited.join(own, ["doc", "th"]).join(following, ["doc", "th"])
    return all_.select(
        F.when(F.col("doc.known"), F.col("doc.id")).alias("doc_id"), "n_chars", "edited_sha256", _hex(F.col("lanes")).alias("fingerprint"), _hex(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited")).alias("near_edited"), likeness(F.col("lanes"), F.col("following")).alias("near_next"),
    )
