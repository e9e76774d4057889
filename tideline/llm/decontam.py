"""Benchmark decontamination by template canonicalisation.

Texts become token sequences (words; characters in scripts written without spaces) in which numbers, units after numbers and names (capitalised words inside a sentence) are
typed placeholders, so that a question with other numbers or names has the same templates. Windows of five tokens are
hash-joined between documents and benchmark items; a pair is reported where the document holds 80 % or more of the
item's distinct windows and its slots are consistent: what one value of the item became in the document must be one
value at all places of an occurrence. Windows that meet in order, near one diagonal (document place - item place), are an
occurrence; one consistent occurrence is enough, whatever else the document holds. Windows that are placeholders nearly
alone are matched by their raw tokens, and items of under five tokens as a whole. The benchmark's windows are broadcast only up to a checked number and else shuffled like the documents'.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut

WINDOW, SIMILARITY = 5, 0.8
#: A window may have this many placeholders at most: with more, its template says nothing and its raw tokens are matched.
MOST_SLOTS = 3
#: Benchmark windows, and candidate documents, that are broadcast at most (about 100 bytes each).
MOST_BROADCAST = 500_000
NUM, NAME, UNIT = "¤n", "¤a", "¤u"
#: Units of measure, as written after a number.
UNITS = ["cm", "cents", "day", "days", "dollars", "euros", "feet", "g", "grams", "h", "hour", "hours", "inches", "kg", "km", "kmh", "l", "lb", "litres", "liters", "m", "meters", "metres", "mg", "miles", "min", "minute", "minutes", "ml", "mm", "mph", "ms", "percent", "s", "second", "seconds", "week", "weeks", "year", "years"]
#: Code points of scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, Han).
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}"
A_CHARACTER = rf"[{UNSPACED}&&[\p{{L}}\p{{M}}]]"
#: A token is a number, a letter of an unspaced script or a run of other letters; canonical tokens stand at the same numbers.
TOKEN = rf"\p{{N}}+(?:[.,]\p{{N}}+)*|{A_CHARACTER}|[\p{{L}}\p{{M}}&&[^{UNSPACED}]]+"
A_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
A_NAME = r"(?<=[\p{L}\p{M}\p{N},)] )\p{Lu}\p{Ll}[\p{L}\p{M}]*"
A_UNIT = rf"{NUM} ( ?)(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])"


def raw_tokens(text: Column) -> Column:
    """Tokens as they are written."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "¤", " "), F.lit(TOKEN), F.lit(0))


def canonical_tokens(text: Column) -> Column:
    """Tokens as lower-case words and placeholders, in four passes over the text."""
    t = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "¤", " "), rf"({A_CHARACTER}) ?", " $1 ")
    t = F.regexp_replace(t, A_NAME, f" {NAME} ")
    t = F.regexp_replace(t, A_NUMBER, f" {NUM} ")
    t = F.regexp_replace(t, A_UNIT, f"{NUM} {UNIT} ")
    return F.array_remove(F.split(F.lower(t), r"[^\p{L}\p{M}\p{N}¤]+"), "")


def _windows(d: DataFrame, keys: list[str], size: int, raw: bool) -> DataFrame:
    """keys, c (canonical tokens), r (raw tokens, if raw) -> keys, pos, h, slots of every window.

    h is of the template, or of the raw tokens where a template has too many placeholders (without raw such windows are left out).
    """
    n = F.greatest(F.size("c") - (size - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(c, k + 1, n).alias(f"{c}{k}") for c in ("cr" if raw else "c") for k in range(size)])
    d = d.select(*keys, F.posexplode(zipped).alias("pos", "w"))
    each = [F.col(f"w.c{k}") for k in range(size)]
    slots = sum((F.when(x.isin(NUM, NAME, UNIT), 1).otherwise(0) for x in each), F.lit(0))
    h = F.xxhash64(*each)
    if raw:
        h = F.when(slots <= MOST_SLOTS, h).otherwise(F.xxhash64(F.lit("raw"), *[F.lower(f"w.r{k}") for k in range(size)]))
    d = d.select(*keys, "pos", h.alias("h"), slots.alias("slots"))
    return d if raw else d.where(F.col("slots") <= MOST_SLOTS)


def _inside(c: Column, r: Column) -> Column:
    """Canonical tokens of a text that stands inside a sentence: a capitalised first word is a name there."""
    name = (F.size("c") > 0) & F.get(r, F.lit(0)).rlike(r"^\p{Lu}\p{Ll}[\p{L}\p{M}]*$")
    return F.when(name, F.concat(F.array(F.lit(NAME)), F.slice(c, 2, F.greatest(F.size(c), F.lit(1))))).otherwise(c)


def _short(docs: DataFrame, items: DataFrame, size: int) -> DataFrame | None:
    """doc_id, th, item_id of the items of under `size` tokens that a document holds as a whole; None without such items."""
    items = items.where(F.size("r").between(1, size - 1))
    known = cut(items.select("item_id", F.size("r").alias("n"), F.xxhash64(*[F.lower(F.get("r", F.lit(k))) for k in range(size - 1)]).alias("h")).distinct())
    lengths = [x.n for x in known.select("n").distinct().collect()]
    if not lengths:
        return None
    zipped = F.arrays_zip(*[F.slice("r", k + 1, F.greatest(F.size("r") - k, F.lit(0))).alias(f"w{k}") for k in range(size - 1)])
    each = [F.lower(f"w.w{k}") for k in range(size - 1)]
    spans = [F.when(each[n - 1].isNotNull(), F.struct(F.lit(n).alias("n"), F.xxhash64(*each[:n]).alias("h"))) for n in lengths]
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), raw_tokens(F.col("text")).alias("r")).select("doc_id", "th", F.explode(zipped).alias("w"))
    d = d.select("doc_id", "th", F.explode(F.array(*spans)).alias("s")).where("s is not null").select("doc_id", "th", "s.n", "s.h")
    return d.join(_small(known, known.count()), ["n", "h"]).select("doc_id", "th", "item_id").distinct()


def _small(d: DataFrame, n: int) -> DataFrame:
    return F.broadcast(d) if n <= MOST_BROADCAST else d


def occurrences(met: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """(item place, document place) of equal windows -> sets of them that can be one occurrence of the item.

    These are the single diagonals, and chains that run forward in both texts and may change their diagonal; every step aside
    costs a window, so that a chain doesn't leave its diagonal for a window that is met by chance.
    """
    lines = defaultdict(list)
    for i, p in met:
        lines[p - i].append((i, p))
    out = [*lines.values()]
    if len(lines) == 1:
        return out
    met = sorted(set(met), key=lambda x: (x[1], x[0]))
    longest = max(i for i, _ in met) - min(i for i, _ in met) + 1
    score, back, first = {}, {}, 0
    for k, (i, p) in enumerate(met):
        # a step aside of more than the item's own length costs more than any chain holds
        while met[first][1] < p - 2 * longest:
            first += 1
        best, at = 0, None
        for j, q in met[first:k]:
            if j < i and q < p and (gain := score[j, q] - abs((p - i) - (q - j))) > best:
                best, at = gain, (j, q)
        score[i, p], back[i, p] = best + 1, at
    used = set()
    for end in sorted(met, key=lambda x: -score[x]):
        chain, at = [], end
        while at is not None and at not in used:
            chain.append(at)
            at = back[at]
        used.update(chain)
        out.append(chain)
    return out


def best_occurrence(places: list, slots: list, size: int) -> tuple[list, list] | None:
    """Of the places of one text of an item within a stretch of a document: the windows (w, raw) and slots of its largest consistent occurrence."""
    filled = {(s.ipos, s.pos): s for s in slots or []}
    at = {(x.ipos, x.pos): (x.w, x.raw) for x in places}
    for _, met in sorted(((len({at[m] for m in met}), met) for met in occurrences(list(at))), key=lambda x: -x[0]):
        became: dict[tuple, str] = {}
        for i, p in {(i + k, p + k) for i, p in met for k in range(size)}:
            s = filled.get((i, p))
            if s is not None and became.setdefault((s.kind, s.old), s.new) != s.new:
                break
        else:
            return sorted({at[m] for m in met}), sorted(f"{kind} {old}" for kind, old in became)
    return None


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(documents, benchmark) -> doc_id, item_id, n_windows, n_shared, similarity, n_slots: the contaminated pairs only.

    n_windows, n_shared and similarity are of an item's template windows, or of all its windows where more of those are shared.
    Null and empty texts, and items without a token, match nothing; very long texts are read whole, and their occurrences judged stretch by stretch; a text of fewer than `size` tokens is matched as a whole, as one window. Items that share an item_id
    are one item (all their windows). Rows that repeat a doc_id and text count once; a null doc_id is
    reported as null. Extra columns are ignored, whatever their names; empty tables give an empty result.
    """
    return _contaminated(docs, benchmark, size, similarity).drop("th").distinct()


def _contaminated(docs: DataFrame, benchmark: DataFrame, size: int, similarity: float) -> DataFrame:
    """The contaminated pairs with th, the hash of the document's text."""
    items = benchmark.select("item_id", F.xxhash64("text").alias("ih"), canonical_tokens(F.col("text")).alias("c"), raw_tokens(F.col("text")).alias("r"))
    both = F.array(F.struct(F.lit(False).alias("inside"), F.col("c")), F.struct(F.lit(True).alias("inside"), _inside(F.col("c"), F.col("r")).alias("c")))
    known = _windows(items.select("item_id", "ih", "r", F.explode(both).alias("b")).select("item_id", "ih", "r", "b.*"), ["item_id", "ih", "inside"], size, True)
    own = ~F.col("inside")
    known = known.groupBy("item_id", "ih", "pos").agg(F.max(F.when(own, F.col("h"))).alias("w"), F.max(F.when(own, F.col("slots"))).alias("slots"), F.max("slots").alias("most"), F.collect_set("h").alias("h"))
    known = cut(known.select("item_id", "ih", F.col("pos").alias("ipos"), "w", "slots", (F.col("slots") > MOST_SLOTS).alias("raw"), "most", F.explode("h").alias("h")))
    wanted = known.groupBy("item_id").agg(
        F.count_distinct("w").cast("long").alias("n_all"), F.count_distinct(F.when(~F.col("raw"), F.col("w"))).cast("long").alias("n_template"), F.bool_or(F.col("slots") > 0).alias("slotted")
    )
    # documents need raw tokens only where the benchmark has a window that is matched by them
    raw = known.where(F.col("most") > MOST_SLOTS).head() is not None
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), canonical_tokens(F.col("text")).alias("c"), *([raw_tokens(F.col("text")).alias("r")] if raw else []))
    at_item = known.select("h", "item_id", "ih", "ipos", "w", "raw")
    hits = _windows(rows, ["doc_id", "th"], size, raw).join(_small(at_item, known.count()), "h")
    pairs = hits.groupBy("doc_id", "th", "item_id").agg(
        F.size(F.collect_set("w")).cast("long").alias("s_all"), F.size(F.collect_set(F.when(~F.col("raw"), F.col("w")))).cast("long").alias("s_template"),
    )
    share = {k: F.struct((F.col(f"s_{k}") / F.col(f"n_{k}")).alias("similarity"), F.col(f"n_{k}").alias("n_windows"), F.col(f"s_{k}").alias("n_shared")) for k in ("all", "template")}
    pairs = pairs.join(wanted, "item_id").withColumn("best", F.greatest(share["all"], F.when(F.col("n_template") > 0, share["template"])))
    pairs = cut(pairs.select("doc_id", "th", "item_id", "slotted", "n_all", "n_template", "best.*").where(F.col("similarity") >= similarity))
    out = ["doc_id", "th", "item_id", "n_windows", "n_shared", "similarity"]
    plain = pairs.where("not slotted").select(*out, F.lit(0).cast("long").alias("n_slots"))
    if (short := _short(docs, items, size)) is not None:
        one = F.lit(1).cast("long")
        plain = plain.unionByName(short.select("doc_id", "th", "item_id", one.alias("n_windows"), one.alias("n_shared"), F.lit(1.0).alias("similarity"), F.lit(0).cast("long").alias("n_slots")))

    # slot consistency, of the pairs whose item has placeholders: only their documents are read again, place by place
    check = pairs.where("slotted")
    n = check.count()
    if not n:
        return plain.distinct()
    pair = ["doc_id", "th", "item_id"]
    ids = check.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    held = cut(held.join(_small(ids, n), F.expr("doc_id <=> _d and th = _t"), "left_semi").dropDuplicates(["doc_id", "th"]))
    wanted_pairs = _small(check.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("item_id").alias("_i")), n)
    same_pair = F.expr("doc_id <=> _d and th = _t and item_id <=> _i")
    again = held.select("doc_id", "th", canonical_tokens(F.col("text")).alias("c"), *([raw_tokens(F.col("text")).alias("r")] if raw else []))
    met = _windows(again, ["doc_id", "th"], size, raw).select("doc_id", "th", "pos", "h").join(_small(at_item, known.count()), "h")
    met = cut(met.join(wanted_pairs, same_pair, "left_semi").select(*pair, "ih", "ipos", "pos", "w", "raw").distinct())
    place = met.select(*pair, "ih", "ipos", "pos", "raw", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    place = place.groupBy(*pair, "ih", (F.col("ipos") + F.col("k")).alias("ipos"), (F.col("pos") + F.col("k")).alias("pos")).agg(F.bool_or(~F.col("raw")).alias("template"))

    def slot_values(d: DataFrame, keys: list[str]) -> DataFrame:
        both = F.arrays_zip(raw_tokens(F.col("text")).alias("value"), canonical_tokens(F.col("text")).alias("c"))
        d = d.select(*keys, F.posexplode(both).alias("pos", "v")).where(F.col("v.c").isin(NUM, NAME, UNIT))
        return d.select(*keys, "pos", F.col("v.c").alias("kind"), F.lower("v.value").alias("value"))

    mine = slot_values(held, ["doc_id", "th"]).withColumnsRenamed({"doc_id": "_d", "th": "_t", "pos": "_p", "value": "new"}).drop("kind")
    theirs = slot_values(benchmark.select("item_id", "text", F.xxhash64("text").alias("ih")).dropDuplicates(["item_id", "ih"]), ["item_id", "ih"]).withColumnsRenamed({"item_id": "_i", "ih": "_h", "pos": "_q", "value": "old"})
    filled = place.join(theirs, F.expr("item_id <=> _i and ih = _h and ipos = _q")).join(mine, F.expr("doc_id <=> _d and th = _t and pos = _p"))
    filled = cut(filled.select(*pair, "ih", "ipos", "pos", "template", "kind", "old", "new"))
    # what one value of the item became over all template windows of the document
    became = filled.groupBy(*pair, "kind", "old").agg(F.min(F.when(F.col("template"), F.col("new"))).alias("low"), F.max(F.when(F.col("template"), F.col("new"))).alias("high"))
    became = became.groupBy(*pair).agg(F.bool_and(F.coalesce(F.col("low") == F.col("high"), F.lit(True))).alias("one"), F.count("*").alias("n_slots"))
    became = became.withColumnsRenamed({"doc_id": "_d", "th": "_t", "item_id": "_i"})
    judged = cut(check.join(became, same_pair, "left").drop("_d", "_t", "_i").withColumn("one", F.coalesce("one", F.lit(True))))
    out_of_one = judged.where("one").select(*out, F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"))
    several = judged.where("not one").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("item_id").alias("_i"))

    # the others by occurrence: stretches of four times a text's length, every two, so that one holds any occurrence whole and none is longer than that
    long = known.groupBy("item_id", "ih").agg((F.max("ipos") - F.min("ipos") + size).alias("span")).withColumnsRenamed({"item_id": "_j", "ih": "_jh"})

    def stretches(d: DataFrame) -> DataFrame:
        d = d.join(several, same_pair, "left_semi").join(long, F.expr("item_id <=> _j and ih = _jh"))
        b = F.floor(F.col("pos") / (2 * F.col("span")))
        return d.withColumn("b", F.explode(F.array(b, b - 1))).drop("_j", "_jh", "span")

    stretch = [*pair, "ih", "b"]
    places = stretches(met).groupBy(*stretch).agg(F.collect_list(F.struct("ipos", "pos", "w", "raw")).alias("places"))
    slots = stretches(filled).groupBy(*stretch).agg(F.collect_list(F.struct("ipos", "pos", "kind", "old", "new")).alias("slots"))
    slots = slots.withColumnsRenamed({"doc_id": "_d", "th": "_t", "item_id": "_i", "ih": "_h", "b": "_b"})
    both = places.join(slots, F.expr("doc_id <=> _d and th = _t and item_id <=> _i and ih = _h and b = _b"), "left")
    judging = F.udf(lambda places, slots: best_occurrence(places, slots, size), "held array<struct<w: bigint, raw: boolean>>, slots array<string>")
    best = both.select(*pair, "ih", judging("places", "slots").alias("o")).where("o is not null")
    best = best.groupBy(*pair, "ih").agg(F.max_by("o", F.size("o.held")).alias("o")).groupBy(*pair).agg(F.array_distinct(F.flatten(F.collect_list("o.held"))).alias("held"), F.size(F.array_distinct(F.flatten(F.collect_list("o.slots")))).cast("long").alias("found"))
    best = best.withColumnsRenamed({"doc_id": "_d", "th": "_t", "item_id": "_i"})
    won = judged.where("not one").drop("n_slots").join(best, same_pair)
    of_template = F.size(F.filter("held", lambda x: ~x["raw"]))
    enough = (F.size("held") >= similarity * F.col("n_all")) | ((F.col("n_template") > 0) & (of_template >= similarity * F.col("n_template")))
    return plain.unionByName(out_of_one).unionByName(won.where(enough).select(*out, F.col("found").alias("n_slots"))).distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; columns as given.

    Documents are told apart by doc_id and text: another text under the doc_id of a contaminated one stays, and so do other texts
    with a null doc_id. Rows that repeat a contaminated doc_id and text go together. Null and empty texts stay; very long texts are searched
    whole; without items nothing goes; an empty table gives an empty result; columns may have any name.
    """
    found = _contaminated(docs, benchmark, WINDOW, SIMILARITY).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    taken = docs.select("doc_id", F.xxhash64("text").alias("th"), F.struct(*docs.columns).alias("_row"))
    return taken.join(found, F.expr("doc_id <=> _d and th = _t"), "left_anti").select("_row.*")
