"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary; every language has a probability for each piece, fitted by
expectation-maximisation on a bounded sample of labelled documents. A word's probability in a language is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words. Words are runs of
letters, lower-cased, with the vocabulary's word-start mark before them. Workers remember word scores up to a bound;
new words are scored together, length by length, over arrays.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Documented bound of the fit: about this many documents of a language, chosen by hash; languages that may be learned.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 200, 500
ROUNDS, SMOOTHING = 2, 0.05
#: A character that no piece covers has this probability in every language.
UNKNOWN = 1e-9
#: Longer words are scored alone, with rescaling; words that a worker remembers.
ARRAY_WORD, REMEMBERED = 40, 400_000
#: Characters of text that a worker takes apart at a time (a longer text is taken alone).
AT_ONCE = 500_000
UNDETERMINED = "und"
_READY: dict[str, Model] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """Pieces of letters, with or without the mark, lower-cased and distinct."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys(sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return [p for p in found if p.removeprefix(MARK).isalpha() or p == MARK]


def is_held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    """Piece probabilities by language, and the forward algorithm over them."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray):
        self.languages, self.pieces, self.probs = languages, pieces, probs
        self.key = uuid.uuid4().hex
        self.prepare()

    def __getstate__(self):
        return self.languages, self.pieces, self.probs, self.key

    def __setstate__(self, state):
        self.languages, self.pieces, self.probs, self.key = state

    def in_worker(self) -> Model:
        """This model, made ready once for all tasks of a worker; a worker keeps the last one only."""
        if self.key not in _READY:
            _READY.clear()
            self.prepare()
            _READY[self.key] = self
        return _READY[self.key]

    def prepare(self):
        """Piece numbers, and an open-addressed table of piece hashes for lookups over arrays."""
        self.row = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces), default=1)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.languages)))
        size = 1 << 18
        self.slots, self.slot_row = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        for i, p in enumerate(self.pieces):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for ch in p:
                    h = self.step(h, np.uint64(ord(ch)))
            at = int(h >> np.uint64(46))
            while self.slot_row[at] >= 0:
                at = (at + 1) % size
            self.slots[at], self.slot_row[at] = h, i

    @staticmethod
    def step(h, ch):
        return (h ^ ch) * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of hashes, -1 where there is none."""
        at = (h >> np.uint64(46)).astype(np.int64)
        row = self.slot_row[at].copy()
        todo = np.flatnonzero((row >= 0) & (self.slots[at] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.slots)
            row[todo] = self.slot_row[at[todo]]
            todo = todo[(row[todo] >= 0) & (self.slots[at[todo]] != h[todo])]
        return row

    def long_word(self, word: str) -> np.ndarray:
        """Log probabilities of one word of any length; forward values are rescaled at every step."""
        w = MARK + word
        alpha = [np.ones(len(self.languages))]
        log = np.zeros(len(self.languages))
        for end in range(1, len(w) + 1):
            a = np.zeros(len(self.languages))
            for n in range(1, min(self.longest, end) + 1):
                r = self.row.get(w[end - n : end])
                if r is not None:
                    a += alpha[-n] * self.probs[r]
                elif n == 1:
                    a += alpha[-1] * UNKNOWN
            top = a.max()
            log += math.log(top)
            alpha = [x / top for x in alpha[-self.longest :]] + [a / top]
        return log + np.log(np.maximum(alpha[-1], 1e-300))

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words, (words, languages)."""
        out = np.empty((len(words), len(self.languages)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes):
            which = np.flatnonzero(sizes == n)
            if n > ARRAY_WORD:
                for i in which:
                    out[i] = self.long_word(words[i])
                continue
            text = (MARK + MARK.join(words[i] for i in which)).encode("utf-32-le")
            codes = np.frombuffer(text, np.uint32).reshape(len(which), n + 1).astype(np.uint64).T
            alpha = np.zeros((n + 2, len(which), len(self.languages)))
            alpha[0] = 1
            for i in range(n + 1):
                h = np.zeros(len(which), np.uint64)
                for j in range(i, min(n + 1, i + self.longest)):
                    h = self.step(h, codes[j])
                    row = self.find(h)
                    hit = np.flatnonzero(row >= 0)
                    if len(hit):
                        alpha[j + 1, hit] += alpha[i, hit] * self.probs[row[hit]]
                    if j == i and len(hit) < len(which):
                        miss = row < 0
                        alpha[j + 1, miss] += alpha[i, miss] * UNKNOWN
            out[which] = np.log(np.maximum(alpha[n + 1], 1e-300))
        return out

    def texts(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior under equal priors; a text without letters has none and 0."""
        names, sure, start = [], [np.zeros(0)], 0
        while start < len(texts):
            end, size = start + 1, len(texts[start] or "")
            while end < len(texts) and size + len(texts[end] or "") <= AT_ONCE:
                size += len(texts[end] or "")
                end += 1
            n, s = self.some_texts(texts[start:end])
            names += n
            sure.append(s)
            start = end
        return names, np.concatenate(sure)

    def some_texts(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        lists = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(lists)) if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(dict.fromkeys(chain.from_iterable(lists)))
        if new:
            start = len(self.known)
            if start + len(new) > len(self.scores):
                grown = np.zeros((max(2 * len(self.scores), start + len(new)), len(self.languages)))
                grown[:start] = self.scores[:start]
                self.scores = grown
            self.scores[start : start + len(new)] = self.words(new)
            self.known.update(zip(new, range(start, start + len(new))))
        names, sure = [], np.zeros(len(texts))
        for k, ws in enumerate(lists):
            if not any(c.isalpha() for w in ws for c in w):  # the pattern takes numerals such as U+00B2 as well
                names.append(UNDETERMINED)
                continue
            total = self.scores[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            sure[k] = 1 / np.exp(np.minimum(total - total[best], 0)).sum()
        return names, sure


def _expect(words: Counter, row: dict[str, int], p: np.ndarray, longest: int) -> np.ndarray:
    """Expected piece counts of one language's whole words under piece probabilities p (forward and backward).

    Both passes are rescaled at every position, so that words of any length keep their weight.
    """
    counts = np.zeros(len(p))
    probs = p.tolist()
    for word, times in words.items():
        w = MARK + word
        n = len(w)
        arcs = [(i, j, r) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if (r := row.get(w[i:j])) is not None]
        covered = {i for i, j, _ in arcs if j == i + 1}
        arcs += [(i, i + 1, -1) for i in range(n) if i not in covered]
        ending: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for i, j, r in arcs:
            ending[j].append((i, probs[r] if r >= 0 else UNKNOWN, r))
        # f[j] is divided by the product of scale[1..j], so that it stays 1; an arc then weighs its own part of that product
        f, b, log = [1.0] + [0.0] * n, [0.0] * n + [1.0], [0.0] * (n + 1)
        for j in range(1, n + 1):
            f[j] = sum(f[i] * x * math.exp(log[i] - log[j - 1]) for i, x, _ in ending[j])
            log[j] = log[j - 1] + math.log(f[j])
            f[j] = 1.0
        for j in range(n, 0, -1):
            for i, x, r in ending[j]:
                share = x * math.exp(log[i] - log[j]) * b[j]
                b[i] += share
                if r >= 0:
                    counts[r] += times * share
    return counts


def fit(samples: list[tuple[str, str]], pieces: list[str]) -> Model | None:
    """(text, language) pairs -> model; None where no word was labelled."""
    counted: dict[str, Counter] = {}
    for text, lang in samples:
        counted.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
    counted = {lang: c for lang, c in counted.items() if c}
    if not counted:
        return None
    languages = sorted(counted)
    row, longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
    probs = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for k, lang in enumerate(languages):
        for _ in range(ROUNDS):
            c = _expect(counted[lang], row, probs[:, k], longest) + SMOOTHING
            probs[:, k] = c / c.sum()
    return Model(languages, pieces, probs)


def train(docs: DataFrame, vocabulary: str | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on documents that are not held out and have text and language.

    The number of each language's documents sets the share of hash space that is fetched, so that about
    per_language of them (never above twice that) reach the driver, wherever they lie; no language is gathered in one task.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    at = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(1_000_000))
    share = F.create_map(*chain.from_iterable((F.lit(r["lang"]), F.lit(min(1_000_000, math.ceil(1e6 * per_language / r["count"])))) for r in sizes))
    picked = known.where(at < F.element_at(share, F.col("lang"))).select("text", "lang").limit(2 * per_language * len(sizes))
    return fit([tuple(r) for r in picked.toLocalIterator()], load_pieces(vocabulary or default_vocabulary()))


def predict_udf(model: Model) -> Callable:
    shared: list[Model] = [model]

    def predict(texts: pd.Series) -> pd.DataFrame:
        names, sure = shared[0].in_worker().texts(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": sure})

    return F.pandas_udf(predict, "lang_pred string, score double")


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """documents -> the kept columns, lang_pred, score; one row for each row given.

    Null and empty texts, texts without letters, and every text where nothing was learned: lang_pred `und`, score 0. Ties go to
    the language that sorts first. Repeated rows get equal results. Only text is read for a prediction, so columns of any name may be there. Very
    long texts and words are scored whole; an empty table gives an empty result.
    """
    nothing = F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    p = predict_udf(model)(F.coalesce("text", F.lit(""))) if model else nothing
    return docs.select(*keep, p.alias("_p")).select(*keep, "_p.lang_pred", "_p.score")


def identify(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score: fitted on its own labelled documents, see train() and predict()."""
    held = docs.withColumn("held_out", is_held_out(F.col("doc_id")))
    return predict(held, train(docs, vocabulary), "doc_id", "held_out")


def keep_identified(docs: DataFrame, least: float = 0.5, vocabulary: str | None = None) -> DataFrame:
    """The documents whose language is found with a posterior of `least` or more; columns as given, whatever their names. Null and empty texts go; repeated rows stay as often as they are; an empty table gives an empty result."""
    taken = docs.select("text", F.struct(*docs.columns).alias("_row"))
    found = predict(taken, train(docs, vocabulary), "_row")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("_row.*")
