"""Exact substring deduplication by prefix-free parsing.

A rolling hash of the next few bytes is taken at every position; the trigger of a window is its smallest hash, so that
phrases between triggers are bounded and an n-byte string has its trigger at the same place wherever it occurs.
A phrase is what shares one trigger: the starts p whose window has its minimum there, with all bytes of their n-byte strings.

* Dictionary: phrases meet by the hash of the bytes after the trigger. Equal phrases (all their bytes) are one
  dictionary word; every occurrence but the first in corpus order repeats it whole.
* Parse: what differs around an equal trigger (ends of repeats) is resolved within those phrases only, first
  in blocks of a few starts at equal distances from the trigger, then, where blocks differ that share all but a few bytes, among their
  n-byte suffixes: equal suffixes are put in corpus order and all but the first repeat.

No suffix array is built, neither the dictionary's nor the parse's (the README has the figures): a phrase carries the n
bytes that follow each of its starts, and only equality to n bytes decides what repeats, so grouping by 128 bits of hash
replaces both arrays.

Texts move once, to their own keys, and that exchange is read for every step. Hot triggers are split where texts are parsed: a
phrase that came before in the batch repeats whole at once, and a trigger that a batch holds many times in different phrases leaves
two of them in its group and sends the others on to the next step directly. A suffix that came before in the batch repeats at
once as well. So a group has a few rows for each batch of texts and not one for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import cut

#: Length of strings that count as repeats, and bytes hashed for the trigger and after it.
LENGTH, TRIGGER, AFTER = 100, 8, 32
BASES = np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xD6E8FEB86659FD93 | 5)
#: Bytes of text that are parsed at a time (a longer text is parsed alone), and phrases of a trigger from which it is hot in them.
AT_ONCE, HOT = 8_000_000, 32
#: Starts of a block.
BLOCK = 8


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any substring of a byte array, from prefix sums modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def powers(cls, n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers.get(int(base), ((), ()))[0]) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, base), np.full(size, np.uint64(pow(int(base), -1, 1 << 64)))
            up[0] = down[0] = 1
            cls._powers[int(base)] = np.cumprod(up), np.cumprod(down)
        return cls._powers[int(base)]

    def __init__(self, data: np.ndarray, base: np.uint64 = BASES[0]):
        up, self.down = self.powers(len(data) + 1, base)
        values = _mix(np.arange(256, dtype=np.uint64) + base)[data]
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * up[: len(data)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def _triggers(data: np.ndarray, length: int, trigger: int, after: int) -> np.ndarray:
    """For each start p (len - length + 1 of them) the position of the smallest trigger hash in [p, p + length - after]."""
    n = len(data) - length + 1
    window = length - after + 1
    m = n + window - 1
    h = np.zeros(m, np.uint64)
    for k in range(trigger):
        h = (h ^ data[k : k + m]) * np.uint64(0x100000001B3)
    # the hash's upper bits, then the position: ties go to the leftmost
    low = (_mix(h) & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    span = 1
    while span * 2 <= window:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[window - span : window - span + n])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _parse(data: np.ndarray, length: int, trigger: int, after: int):
    """Phrases of one text: hash after the trigger, hash of all bytes and the trigger's place, place(), and bits of both sides.

    Starts up to `half` bytes before the trigger share length - half bytes after it, all others the half + 1 bytes before
    it: 8 bits of hash of either side (0 where a phrase has no such start) tell most phrases apart that share a trigger by chance.
    """
    at = _triggers(data, length, trigger, after)
    cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = np.r_[0, cuts], np.r_[cuts, len(at)] - 1
    t = at[first]
    h = Rolling(data)
    half = (length - after) // 2
    near, far = last >= t - half, first < t - half
    right = np.where(near, 1 + h(t, np.minimum(t + length - half, len(data))) % np.uint64(255), np.uint64(0))
    left = np.where(far, 1 + h(np.maximum(t - half - 1, 0), t) % np.uint64(255), np.uint64(0))
    k, c = h(t, t + after), _mix(h(first, last + length) ^ _mix(((t - first).astype(np.uint64) << np.uint64(8)) + np.uint64(1)))
    return k, c, place(first, last, t - first), (right << np.uint64(8) | left).astype(np.int32)


def _blocks(data: np.ndarray, places: np.ndarray, length: int):
    """Blocks of the phrases at these places: hash of the bytes that all starts of a block share, of all its bytes, its place, and no sides."""
    first, last = spans_of(places)
    t = first + (np.asarray(places, np.int64) >> 15 & 0x7FFF)
    near, far = (t - last) // BLOCK, (t - first) // BLOCK
    n = far - near + 1
    t, first, last = np.repeat(t, n), np.repeat(first, n), np.repeat(last, n)
    j = np.repeat(near, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low, high = t - BLOCK * j - BLOCK + 1, t - BLOCK * j
    first, last = np.maximum(first, low), np.minimum(last, high)
    h = Rolling(data)
    k = _mix(h(high, low + length) ^ _mix(j.astype(np.uint64)))
    c = _mix(h(first, last + length) ^ _mix((high - first).astype(np.uint64) << np.uint64(8) | (last - first).astype(np.uint64)))
    return k, c, place(first, last, np.zeros(len(first), np.int64)), np.zeros(len(first), np.int32)


def place(first: np.ndarray, last: np.ndarray, trigger: np.ndarray) -> np.ndarray:
    """First start, the trigger's distance and starts less one, as one number in text order."""
    return first << 30 | trigger << 15 | (last - first)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a sorted array has a value for the first time."""
    return np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])


def spans_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts."""
    places = np.asarray(places, np.int64)
    first = places >> 30
    return first, first + (places & 0x7FFF)


#: What is known of a phrase when its batch is parsed: it is WHOLE a repeat, or its trigger is hot and it is SENT on, or STAYS for those sent on.
PLAIN, WHOLE, SENT, STAYS = range(4)


def _pieces(cut_up: Callable, length: int):
    """(id, text, and phrases if these are to be cut up) -> a row for each piece: k (what its starts share), c (all it holds), id, place, sides << 2 | known.

    Pieces that are decided need no comparison, so their k is scattered.
    """

    def combine(held: list[tuple]) -> pd.DataFrame:
        k, c, places, sides, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((places, ids, c, k))
        k, c, places, sides, ids = k[order], c[order], places[order], sides[order], ids[order]
        new_k = _changes(k)
        new = new_k | _changes(c)
        known = np.where(new, PLAIN, WHOLE).astype(np.int8)
        words = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_k))[np.cumsum(new_k) - 1]
        of_hot = np.flatnonzero(new & (words > HOT))
        known[of_hot] = SENT
        first = np.flatnonzero(_changes(k[of_hot]))
        known[of_hot[np.concatenate([first, first + 1])]] = STAYS
        decided = (known == WHOLE) | (known == SENT)
        k[decided] = _mix(_mix(ids[decided].view(np.uint64)) ^ places[decided].view(np.uint64))
        # in text order ids and places compress well on their way
        d = pd.DataFrame({"k": k.view(np.int64), "c": c.view(np.int64), "id": ids, "place": places, "sides": sides << 2 | known})
        return d.iloc[np.lexsort((places, ids))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            for i, text, *phrases in f.itertuples(index=False):
                raw = _bytes_of(text)
                if len(raw) < length:
                    continue
                piece = cut_up(raw, *phrases)
                held.append((*piece, np.full(len(piece[0]), i, np.int64)))
                size += len(raw)
                if size >= AT_ONCE:
                    yield combine(held)
                    held, size = [], 0
        if held:
            yield combine(held)

    return run


PIECES = "k long, c long, id long, place long, sides int"


def _suffixes(length: int):
    """(id, text, ends: blocks) -> 128 bits of hash and the place of each start's suffix; again: an equal suffix came before it in the batch."""

    def combine(held: list[tuple]) -> pd.DataFrame:
        s, z, ids, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, ids, z, s))
        s, z, ids, at = s[order], z[order], ids[order], at[order]
        again = ~(_changes(s) | _changes(z))
        s[again] = _mix(_mix(ids[again].view(np.uint64)) ^ at[again].view(np.uint64))
        z[again] = 0
        return pd.DataFrame({"s": s.view(np.int64), "z": z.view(np.int64), "id": ids, "at": at, "again": again})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            for i, text, ends in zip(f["id"].to_numpy(), f["text"], f["ends"]):
                raw = _bytes_of(text)
                first, last = spans_of(ends)
                p = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
                held.append((Rolling(raw)(p, p + length), Rolling(raw, BASES[1])(p, p + length), np.full(len(p), i), p))
                size += len(raw)
                if size >= AT_ONCE:
                    yield combine(held)
                    held, size = [], 0
        if held:
            yield combine(held)

    return run


def _removals(length: int):
    """(row, text, whole: pieces and single: starts that repeat) -> row and what removing their strings leaves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, phrases, blocks, single in zip(f["text"], f["phrases"], f["blocks"], f["single"]):
                raw = _bytes_of(text)
                first, last = spans_of(np.concatenate([np.asarray([] if x is None else x, np.int64) for x in (phrases, blocks)]))
                single = np.asarray([] if single is None else single, np.int64)
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, np.concatenate([first, single]), 1)
                np.add.at(edge, np.concatenate([last, single]) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            d = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield pd.concat([f[["doc", "known", "n"]].reset_index(drop=True), d], axis=1)

    return run


def _place(first: Column, last: Column, trigger: Column) -> Column:
    """As place()."""
    return F.shiftleft(first, 30).bitwiseOR(F.shiftleft(trigger, 15)).bitwiseOR(last - first)


def settle(pieces: DataFrame, half: int | None = None) -> DataFrame:
    """Pieces -> id, found: array of place << 1 | whole.

    whole: every start of the piece repeats an earlier one. Otherwise other pieces share what its starts share, so
    that single starts may repeat; all other pieces are left out. With half (see _parse()) so are the starts whose side no other piece shares.
    """
    # one exchange by what the starts share; pieces of a key are sorted by content, then in corpus order
    every = Window.partitionBy("k")
    pieces = pieces.withColumn("known", F.col("sides").bitwiseAND(F.lit(3)))
    d = pieces.select("*", F.lag("c").over(every.orderBy("c", "id", "place")).alias("before"), F.min("c").over(every).alias("low"), F.max("c").over(every).alias("high"), F.max("known").over(every).alias("most"))
    whole = F.expr(f"known = {WHOLE} or coalesce(before = c, false)")
    d = d.select("k", "c", "id", "place", "sides", "known", "most", whole.alias("whole")).where(F.expr(f"whole or known = {SENT} or low < high"))
    if half is not None:
        for name, bits in (("right", F.shiftright("sides", 10)), ("left", F.shiftright("sides", 2).bitwiseAND(F.lit(0xFF)))):
            side = Window.partitionBy("k", name)
            d = d.withColumn(name, bits).withColumn(f"by_{name}", F.expr(f"most >= {SENT}") | ((F.col(name) > 0) & (F.min("c").over(side) < F.max("c").over(side))))
        first, mask = F.shiftright("place", 30), F.lit(0x7FFF).cast("long")
        last, t = first + F.col("place").bitwiseAND(mask), first + F.shiftright("place", 15).bitwiseAND(mask)
        left, right = F.greatest(first, t - half), F.least(last, t - half - 1)
        kept = F.when(F.expr("whole or (by_right and by_left)"), F.col("place")).when(F.col("by_right"), _place(left, last, t - left)).when(F.col("by_left"), _place(first, right, t - first))
        d = d.where(F.expr("whole or by_right or by_left")).withColumn("place", kept)
    return d.groupBy("id").agg(F.collect_list(F.col("place") * 2 + F.col("whole").cast("long")).alias("found"))


def _places(whole: bool) -> Column:
    """Places of the found pieces that repeat whole, or of those that don't."""
    return F.transform(F.filter("found", lambda x: x % 2 == int(whole)), lambda x: F.shiftright(x, 1))


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256: what is left without repeated strings of `length` bytes.

    A byte goes if it lies in a string of `length` bytes that starts earlier as well: in a document of smaller doc_id, or in the
    same document before it. Null texts are empty; texts under `length` bytes never lose any; a very long text is parsed
    alone, with a few hundred bytes of memory to each of its bytes. A null doc_id comes before all others.
    Rows that repeat a doc_id and text are one document and each get its result; different texts of one
    doc_id are ordered by their hash. Extra columns are ignored; an empty table gives an empty result.
    """
    if not 16 <= length < 1 << 15:
        raise ValueError("length must be from 16 to 32767 bytes")
    key = ["doc", "known", "th"]
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc"), F.col("doc_id").isNotNull().alias("known"), F.xxhash64(text).alias("th"), text.alias("text"))
    # ids in corpus order; what follows carries one number for a document
    ids = cut(texts.groupBy(*key).agg(F.count("*").alias("n")).sort("known", "doc", "th").select("*", F.monotonically_increasing_id().alias("id")))
    moved = texts.dropDuplicates(key) if ids.where("n > 1").head() else texts.repartition(*key)
    trigger, after = min(TRIGGER, length // 4), min(AFTER, length // 3)

    def of(found: DataFrame) -> DataFrame:
        """Texts with the pieces that are not settled."""
        ends = ids.join(found.select("id", _places(False).alias("ends")).where("size(ends) > 0"), "id").select(*key, "id", "ends")
        return moved.join(ends.hint("shuffle_hash"), key).select("id", "text", "ends")

    phrases = settle(moved.join(ids.hint("shuffle_hash"), key).select("id", "text").mapInPandas(_pieces(lambda raw: _parse(raw, length, trigger, after), length), PIECES), (length - after) // 2)
    blocks = settle(of(phrases).mapInPandas(_pieces(lambda raw, places: _blocks(raw, places, length), length), PIECES))
    suffixes = of(blocks).mapInPandas(_suffixes(length), "s long, z long, id long, at long, again boolean")
    before = F.lag("id").over(Window.partitionBy("s", "z").orderBy("id", "at"))
    single = suffixes.select("id", "at", (F.col("again") | before.isNotNull()).alias("repeats")).where("repeats").groupBy("id").agg(F.collect_list("at").alias("single"))
    gone = ids.join(phrases.select("id", _places(True).alias("phrases")), "id", "left").join(blocks.select("id", _places(True).alias("blocks")), "id", "left").join(single, "id", "left")
    left = moved.join(gone.drop("id").hint("shuffle_hash"), key)
    left = left.mapInPandas(_removals(length), "doc long, known boolean, n long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    each = left.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return each.select(F.when(F.col("known"), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
