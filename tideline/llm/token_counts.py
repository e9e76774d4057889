"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut by the tokenizer's special strings and its pre-tokenizer pattern; each piece starts as a linked list of
byte symbols, the adjacent pair of lowest rank is popped from a heap until none can merge, and the piece's count is its
initial symbols minus its merges. No identifiers are made. Counts of pieces are remembered in each worker, up to a
bound; a whole text of any length is one walk over its pieces.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's public pattern, frequent alternatives first (they start differently). \s is spelled out, as engines differ over U+001C to U+001F.
PATTERN = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
OVER = 1024
#: Pieces that a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 600_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens as the library does for a byte-level BPE file, special strings inside texts included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE files are supported")
        added = [t for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that strip or match words only are not supported")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        vocab = model["vocab"]
        self.first = [0] * 256
        for letter, b in _byte_letters().items():
            self.first[b] = vocab[letter]
        #: left symbol << 32 | right symbol -> rank << 32 | merged symbol
        self.merge: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        self.split = regex.compile(PATTERN).findall
        self.space_runs = regex.compile(r" (?:\p{White_Space}|\Z)").search
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one pre-tokenized piece."""
        first, merge = self.first, self.merge
        sym = [first[b] for b in text.encode("utf-8")]
        n = len(sym)
        if n < 2:
            return n
        heap = []
        for i in range(n - 1):
            m = merge.get(sym[i] << 32 | sym[i + 1])
            if m is not None:
                heap.append((m, i))
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            m, i = heappop(heap)
            j = after[i]
            # the popped pair must still stand at i: sym is -1 where a symbol was merged away
            if j >= n or sym[i] < 0 or merge.get(sym[i] << 32 | sym[j]) != m:
                continue
            sym[i], sym[j] = m & 0xFFFFFFFF, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merge.get(sym[i] << 32 | sym[k])
                if m is not None:
                    heappush(heap, (m, i))
            k = before[i]
            if k >= 0:
                m = merge.get(sym[k] << 32 | sym[i])
                if m is not None:
                    heappush(heap, (m, k))
        return left

    def cut(self, text: str) -> int:
        """A text without special strings, cut by the pattern."""
        known, total = self.known, 0
        for p in self.split(text):
            c = known.get(p)
            if c is None:
                c = self.piece(p)
                if len(p) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = c
            total += c
        return total

    def plain(self, text: str) -> int:
        """A text without special strings. Where each space stands before other text, no piece reaches over a space but to
        take it as its first character, so that what follows a space counts alike wherever it stands."""
        if self.space_runs(text):
            return self.cut(text)
        head, *rest = text.split(" ")
        total, words = self.cut(head), self.words
        for w, c in zip(rest, map(words.get, rest)):
            if c is None:
                c = words.get(w)
                if c is None:
                    c = self.cut(" " + w)
                    if len(w) <= LONGEST:
                        if len(words) >= REMEMBERED:
                            words.clear()
                        words[w] = c
            total += c
        return total

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_udf(path: str) -> Callable:
    def tokens(texts: pd.Series) -> pd.Series:
        count = counter(path).count
        return pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(tokens, "long")


def count_tokens(docs: DataFrame, vocabulary: str | None = None, over: int = OVER) -> DataFrame:
    """documents -> doc_id, n_bytes, n_tokens, over_limit; one row for each row given.

    Null and empty texts have no bytes and no tokens. Repeated rows each get their count. Extra columns are ignored, whatever their names. Very long
    texts are counted whole; an empty table gives an empty result.
    vocabulary is a path that every executor can open (installed files); no begin, end or other tokens are added.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count_udf(vocabulary or default_vocabulary())(text).alias("n_tokens"))
    return d.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
