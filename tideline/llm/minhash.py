"""MinHash near-duplicates by fast similarity sketching (Dahlgaard, Knudsen and Thorup 2017).

A document's set of word shingles becomes a sketch of BINS values in rounds: round i hashes every shingle to one bin and a
value, a bin keeps the least (round, value), and from round BINS on the bin is i - BINS, so that every bin is filled after
2 * BINS rounds at the latest. A set of many shingles needs one round. The share of equal bins estimates the likeness as
BINS independent minima would.

Links are searched among distinct sets (nodes), so that exact copies cost one node. BANDS bands of ROWS bins give each node
its buckets. No bucket makes all its pairs:

1. every member is held against the bucket's first node (a star), and components are formed;
2. a bucket whose members are all in one component is settled, as pairs within a component say nothing new;
3. nodes of the other buckets meet nodes of other components by their rarest shingles, first one node a shingle (a star again), then
   all (rare_pairs), which loses no pair: a text with too many shingles of its own for any link makes none, however large the bucket.

Pairs whose sketches say less than FLOOR (six standard deviations below the similarity) are dropped; the others are
confirmed on the full sets of shingles, as words, read from the texts themselves. A pair at the similarity shares a bucket but for
(1 - 0.8 ** ROWS) ** BANDS = 3e-6, and a component may still join it by others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tideline.llm.common import connected_components, cut, one_row_each, stored

#: Words of a shingle, and the similarity of linked sets in hundredths.
SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Share of equal bins below which a pair can't have the similarity: six standard deviations of BINS bins.
FLOOR = PERCENT / 100 - 6 * (PERCENT / 100 * (1 - PERCENT / 100) / BINS) ** 0.5
#: Words hashed, and bytes of text split, at a time.
CHUNK_WORDS, CHUNK_BYTES = 1 << 20, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of each value, another one for each seed."""
    x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash a word, in order; a long text is split piece by piece, between words."""
    out, at = [], 0
    while at < len(text):
        stop = at + CHUNK_BYTES
        end = m.start() if stop < len(text) and (m := SPACE.search(text, stop)) else len(text)
        words = text[at:end].lower().split()
        out.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles; with fewer words of the whole sequence, without words none."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    size = min(size, n)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = mixed(h ^ w[k : n - size + 1 + k], k)
    return np.unique(h)


def sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sets (values from starts[i] to starts[i + 1], none empty) -> one row of BINS 16-bit values a set."""
    n = len(starts) - 1
    best = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    of = np.repeat(np.arange(n), np.diff(starts))
    live = np.arange(n)
    for i in range(2 * BINS):
        h = mixed(values, 101 + i)
        bin_ = ((h >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64) if i < BINS else i - BINS
        # the round stands above the value: what an earlier round has put into a bin stays
        np.minimum.at(best, of * BINS + bin_, np.uint64(i << 40) | (h & np.uint64(0xFFFFFFFFFF)))
        open_ = (best.reshape(n, BINS)[live] == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.all():
            live = live[open_]
            if not len(live):
                break
            keep = np.isin(of, live)
            values, of = values[keep], of[keep]
    return mixed(best, 7).astype(np.uint16).reshape(n, BINS)


def _sketch_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts = [batch.column(i) for i in range(3)], batch.column(3)
            at = 0
            while at < batch.num_rows:
                sets, words, start = [], 0, at
                while at < batch.num_rows and words < CHUNK_WORDS:
                    text = texts[at].as_py()
                    sets.append(shingle_hashes(text.encode() if text else b"", size))
                    words += len(sets[-1])
                    at += 1
                lengths = np.array([len(x) for x in sets])
                full = lengths > 0
                values = np.concatenate(sets)
                ends = np.cumsum(lengths[full])
                sums = np.zeros((2, len(sets)), np.uint64)
                rows = np.array([b""] * len(sets), object)
                if full.any():
                    starts = np.r_[0, ends]
                    for k in (0, 1):
                        sums[k, full] = np.add.reduceat(mixed(values, 31 + k), starts[:-1])
                    rows[full] = [x.tobytes() for x in sketches(values, starts)]
                cols = [c.slice(start, at - start) for c in kept]
                cols += [pa.array(lengths, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(list(rows), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k1", "k2", "n", "s1", "s2", "sketch"])

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, a, b) -> (u, v) of the pairs whose sketches a and b agree in FLOOR of their bins or more."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BINS) for i in (2, 3))
        near = pa.array((a == b).sum(axis=1) >= FLOOR * BINS)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(near) for i in (0, 1)], names=["u", "v"])


def shingles(text: str, size: int) -> set:
    """The set itself: tuples of words."""
    w = text.encode().lower().split()
    return set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} if w else set()


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            keep = []
            v, a, b = batch.column(1), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if (now := v[i].as_py()) != last:  # rows that share v follow each other
                    last, held = now, shingles(b[i].as_py(), size)
                mine = shingles(a[i].as_py(), size)
                both = len(mine & held)
                keep.append(100 * both >= percent * (len(mine) + len(held) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["u", "v"])

    return run


def shared_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each of the nodes (node, k1, k2), in the shared folder: the only time that texts are shuffled by their hash."""
    # copies of one text meet in their own task first, so that none is sent twice by it
    one = _keyed(docs).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return stored(nodes.join(one, ["k1", "k2"]).select("node", "text"))


def near_links(nodes: DataFrame, texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Distinct candidate pairs (u, v) of nodes -> those that the full sets of their texts confirm."""
    about = nodes.select("node", "n", "sketch")
    p = pairs.join(about.toDF("u", "nu", "a"), "u").join(about.toDF("v", "nv", "b"), "v")
    p = p.where(F.lit(100) * F.least("nu", "nv") >= F.lit(percent) * F.greatest("nu", "nv")).select("u", "v", "a", "b")
    p = stored(p.mapInArrow(_alike, "u long, v long"))
    full = p.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v").select("u", "v", "a", "b")
    return full.mapInArrow(_confirm(size, percent), "u long, v long")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and 128 bits that stand for the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")


def _shingle_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                h = shingle_hashes(text.as_py().encode(), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), node.as_py())), pa.array(h.view(np.int64))], names=["node", "h"])

    return run


def rare_shingles(open_: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node) -> (h, node, n, at): each set's shingles up to place n - percent / 100 * n + 1, in an order of all shingles, rarest first.

    Two sets of the similarity have their first common shingle among these of both, and enough shingles from there on. A text whose own edits
    are too many for any link has nothing here but shingles that nobody shares, which are left out.
    """
    shingled = cut(texts.join(open_, "node", "left_semi").select("node", "text").mapInArrow(_shingle_rows(size), "node long, h long"))
    shared = shingled.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    known = shingled.join(shared, "h").join(nodes.select("node", "n"), "node")
    mine = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "h"))
    known = known.withColumn("at", place).where(F.lit(100) * (F.col("n") - F.col("at") + 1) >= F.lit(percent) * F.col("n"))
    return stored(known.select("h", "node", "n", "at"))


def rare_pairs(known: DataFrame, labels: DataFrame, percent: int, star: bool) -> DataFrame:
    """Pairs (u, v) of nodes of different components that share a rare shingle and can have the similarity.

    At each shingle the nodes outside its largest component meet the others; with star only the one node of that component which has most of its set to come.
    """
    d = known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = d.groupBy("h", "label").agg(F.count("*").alias("c"), F.min(F.struct("at", "node", "n")).alias("x"))
    largest = groups.groupBy("h").agg(F.max(F.struct("c", "label", "x")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("h", "top")
    few = d.join(largest, "h").where(F.col("label") != F.col("top.label")).select("h", F.col("node").alias("u"), F.col("label").alias("lu"), F.col("n").alias("nu"), F.col("at").alias("au"), "top")
    if star:
        pairs = few.select("u", "lu", "nu", "au", F.col("top.x.node").alias("v"), F.col("top.label").alias("lv"), F.col("top.x.n").alias("nv"), F.col("top.x.at").alias("av"))
    else:
        other = d.select("h", F.col("node").alias("v"), F.col("label").alias("lv"), F.col("n").alias("nv"), F.col("at").alias("av"))
        pairs = few.drop("top").join(other, "h")
    fit = F.lit(100 + percent) * F.least(F.col("nu") - F.col("au") + 1, F.col("nv") - F.col("av") + 1) >= F.lit(percent) * (F.col("nu") + F.col("nv"))
    return pairs.where((F.col("lu") != F.col("lv")) & fit).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def linked_nodes(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """nodes -> (node, label) of the nodes that have links; label is the smallest node of the component."""
    w = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(j), F.substring("sketch", 1 + w * j, w)) for j in range(BANDS)])
    members = nodes.select("node", F.explode(keys).alias("key"))
    first = members.groupBy("key").agg(F.min("node").alias("u"), F.count("*").alias("c")).where("c > 1")
    # what joins make is stored: a checkpoint would carry their estimated sizes on into all that follows
    starred = stored(members.join(first, "key").select("key", "node", "u", "c"))
    texts = shared_texts(docs, starred.select("node").distinct().join(nodes.select("node", "k1", "k2"), "node"))
    tested = starred.where("node <> u").select("u", F.col("node").alias("v")).distinct()
    labels = stored(connected_components(near_links(nodes, texts, tested, size, percent)))
    named = starred.where("c > 2").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    settled = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    known = rare_shingles(named.join(settled, "key").select("node").distinct(), nodes, texts, size, percent)
    for star in (True, False):
        pairs = stored(rare_pairs(known, labels, percent, star).join(tested, ["u", "v"], "left_anti"))
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        found = near_links(nodes, texts, pairs, size, percent)
        labels = stored(connected_components(found.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))))
    return labels


def _grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, k1, k2, n, s1, s2; sets: s1, s2, n, label, component): label names the component, component is its smallest doc_id."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = _keyed(docs).select("doc_id", "k1", "k2", "text").mapInArrow(_sketch_batches(size), f"doc_id {id_type}, k1 long, k2 long, n long, s1 long, s2 long, sketch binary")
    rows = cut(rows)
    nodes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("k1", "k2", "sketch")).alias("x"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "first_id", "x.*"))
    labels = linked_nodes(docs, nodes, size, percent)
    named = nodes.select("node", "s1", "s2", "n", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named.groupBy("label").agg(F.min("first_id").alias("component"))
    return rows.drop("sketch"), named.join(groups, "label").select("s1", "s2", "n", "label", "component")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept; one row a row.

    Null, empty and blank texts have no shingle, link with nothing and are their own component. Rows that repeat a doc_id
    or a text each get a row; equal sets are linked. A null doc_id keeps its row and names a component only if all its members are
    null. kept is doc_id = component_id (true where both are null), so rows that repeat the kept doc_id are all kept. Very long texts are read whole; extra columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    rows, sets = _grouped(docs, size, percent)
    out = rows.join(sets, ["s1", "s2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_representatives(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group: of the texts under its smallest doc_id the one of the smallest hash. Columns as given.

    Texts without a word are in no group and all stay. Documents are told apart by doc_id and text; a null doc_id is kept only where all of
    a group are null; of rows that repeat the kept doc_id and text one stays. An empty table gives an empty result; columns may have any name.
    """
    rows, sets = _grouped(docs, size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("k1").alias("th"))).alias("x")
    kept = rows.where("n > 0").join(sets, ["s1", "s2", "n"]).groupBy("label").agg(first).select("x.doc_id", "x.th")
    return one_row_each(docs, kept.unionByName(rows.where("n = 0").select("doc_id", F.col("k1").alias("th")).distinct()))
