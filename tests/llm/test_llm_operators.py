"""Each training-data operator against brute force, and on nulls, empty tables, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import common, decontam, fingerprints, langid, license_scan, mixing, sa_dedup, sharding, simhash, token_counts, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, fp string, rate string, slot string, score string, component_id string"
LONG = "word and other words here. " * 3000


def docs(spark, rows, parts=3):
    """rows of (doc_id, text); the other columns have names that operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", "a", "b", "c") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "no id at all"), (5, LONG), (6, "漢字 ünï 😀"), (7, "tie tie tie tie"), (8, "tie tie tie tie")]


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(400, 600)] + [(i, i + 1) for i in range(700, 760)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.label for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_carry_no_estimates_and_stop_at_stars(spark):
    sc = spark.sparkContext

    def run(edges):
        sc.setJobGroup(group := f"components {len(edges)}", "")
        out = common.connected_components(spark.createDataFrame(edges, "u long, v long"))
        labels = {(r.node, r.label) for r in out.collect()}
        sc.setLocalProperty("spark.jobGroup.id", None)
        return labels, len(sc.statusTracker().getJobIdsForGroup(group)), int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    path, _, estimated = run([(i, i + 1) for i in range(100)])
    assert path == {(i, 0) for i in range(101)} and estimated < 1e6
    stars, jobs, _ = run([(10 * i + j, 10 * i) for i in range(20) for j in range(1, 10)] + [(0, 5)])
    assert stars == {(10 * i + j, 10 * i) for i in range(20) for j in range(10)} and jobs <= 10


# 1

def test_fingerprints(spark):
    rows = [(i, t) for i, t in EDGE if i is not None] + [(9, "b line\na line"), (10, "a line\nb line"), (11, "a line\nb line")]
    got = {(r.doc_id): r for r in fingerprints.fingerprint_edits(docs(spark, rows)).collect()}
    order = sorted({(i, t or "") for i, t in rows}, reverse=True)
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        nxt, h = order[(k + 1) % len(order)][1], len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
        assert got[i].n_chars == len(t) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[9].fingerprint == got[10].fingerprint == got[11].fingerprint
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert got[7].fingerprint == got[8].fingerprint
    assert got[11].near_next == 1.0
    assert fingerprints.fingerprint_edits(docs(spark, [])).count() == 0
    one = fingerprints.fingerprint_edits(docs(spark, [(None, "abcd")])).collect()[0]
    assert one.doc_id is None and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_fingerprints_are_homomorphic(spark):
    d = spark.createDataFrame([(1, "first line, here\nsecond line. and more words"), (2, "first line, here")], "doc_id long, text string")
    lanes = {r.doc_id: r.lanes for r in fingerprints.fingerprint_lanes(d, ["doc_id"]).collect()}
    x = spark.createDataFrame([(lanes[1], lanes[2], "second line. and more words")], "a array<long>, b array<long>, p string")
    r = x.select(fingerprints.insert(F.col("b"), F.col("p")).alias("more"), fingerprints.delete(F.col("a"), F.col("p")).alias("less")).first()
    assert r.more == lanes[1] and r.less == lanes[2]


# 2

def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_counts.default_vocabulary())
    rng = random.Random(2)
    alphabet = [*"abcde ' \n\t<|>0129.,!éß漢  ", "<|endoftext|>", "'ll", "'s", "  ", "the", "ing", " ", "\x1c"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(3000)] + ["a" * 50_000, "<|endoftext|><|endoftext|>", LONG]
    c = token_counts.counter(token_counts.default_vocabulary())
    assert [c.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    got = token_counts.count_tokens(docs(spark, EDGE)).collect()
    want = sorted((i or 0, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(docs(spark, [])).count() == 0


# 3

def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    rng = random.Random(3)
    bits = ["CC", "by", "general", "Public", "LICENSE", "all", "rights", "reserved", "K", "é", "x", "GENERAL PUBLIC LICENSE", "cc-by"]
    rows = [(100 + i, "".join(rng.choice(bits) + rng.choice([" ", "-", "\n", "[", "_", "É"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [*EDGE, (50, "Licensed under the Apache License, Version 2.0."), (51, "x Licensed under the new Apache License, Version 2.0"), (52, "Released under the MIT License"), (53, "cc BY"), (54, "cc bY")]
    got = license_scan.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert by[50].labels == "apache" and by[50].score == 1 and by[51].labels == "apache" and by[52].labels == "mit"
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_license_notices_that_follow_each_other(spark):
    gap = "words of the text between them " * 3
    rows = [
        (1, "All rights reserved. All rights reserved."), (2, "CC BY, CC BY, licensed under CC BY-NC 4.0"), (3, "All rights reserved. " * 4 + gap + "All rights reserved."),
        (4, "CC BY, CC BY, licensed under the CC BY-NC 4.0"), (5, "cc by cc by cc by cc by cc by cc by"), (6, "All rights reserved."),
    ]
    got = {r.doc_id: (r.labels, r.score, r.n_spans) for r in license_scan.scan(docs(spark, rows)).collect()}
    assert got[1] == ("proprietary,reserved", 1.0, 2) and got[3] == ("proprietary,reserved", 1.0, 5) and got[6] == ("proprietary,reserved", 1.0, 1)
    assert "cc-by-nc" in got[2][0].split(",") and "cc-by-nc" in got[4][0].split(",") and got[5] == ("cc-by", 1.0, 0)


# 4

def test_mixing(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = mixing.mix(d.select("doc_id", "text"), labels).collect()
    assert len(rows) == d.count() and all(r.rate >= 0 and abs(sum(r.posterior.values()) - 1) < 1e-6 for r in rows)
    total = sum(r.n_tokens for r in rows)
    got = {k: sum(r.n_tokens * r.rate * r.posterior[k] for r in rows) / total for k in rows[0].posterior}
    # what is missed is what the operator says
    for k in got:
        assert abs(got[k] - mixing.WEIGHTS.get(k, 0) - rows[0].missed[k]) < 1e-9, got
        assert abs(rows[0].missed[k]) < 0.04
    assert all(r.n_tokens == len(r.text.split()) for r in rows)


def test_mixing_fits_on_texts_taken_one_by_one():
    import tracemalloc

    def samples():
        for k in range(400):
            yield " ".join([f"word{k % 40}", "bad" if k % 2 else "good"] * 2000), f"q{k % 2}_t0"

    mixing.fit(samples())
    tracemalloc.start()
    model = mixing.fit(samples())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6 < sum(len(t) for t, _ in samples())
    assert (model.posteriors(["good", "bad"]).argmax(axis=1) == [0, 1]).all() and mixing.fit(iter([])) is None


def test_mixing_classifier_on_rows_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = mixing.train(d, labels.where("doc_id % 5 <> 0"))
    asked = d.join(labels.where("doc_id % 5 = 0"), "doc_id").select("text", "toxic").collect()
    p = model.posteriors([r.text or "" for r in asked])
    said = p[:, [k.endswith("t1") for k in model.domains]].sum(axis=1) > 0.5
    truth = np.array([r.toxic == 1 for r in asked])
    assert len(asked) > 500 and (said == truth).mean() > 0.96 and said[truth].mean() > 0.8 and said[~truth].mean() < 0.02


@pytest.mark.parametrize("goal", [(0.5, 0.4, 0.1), (0.34, 0.33, 0.33), (2.0, 0.0, 0.5), (0.0, 0.0, 0.0)])
def test_rates_minimise_the_squared_error(spark, goal):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.2, 0.2, 0.2], 400)
    tokens = rng.integers(1, 500, 400).astype(float)
    soft = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, p array<double>")
    wanted = {k: g * tokens.sum() for k, g in zip("abc", goal)}
    multipliers, at = mixing.fit_rates(soft, wanted, list("abc"))
    t = np.array(list(wanted.values()))
    size = tokens @ p
    # plain projected gradient on the rates, run until it stands still
    r = np.ones(400)
    for _ in range(20000):
        r = np.maximum(0, r - 0.3 * (p @ (((r * tokens) @ p - t) / size) + mixing.PULL * (r - 1)))
    assert np.allclose(np.maximum(0, 1 - p @ np.array(multipliers)), r, atol=1e-4)
    assert np.allclose(list(at.values()), (r * tokens) @ p, atol=1e-4 * tokens.sum())


def test_mixing_keeps_columns_of_any_name(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, EDGE).withColumns({c: F.lit(c) for c in ("p", "_t", "_d", "_th", "_i", "_h", "_row", "tokens", "_n", "missed")})
    got = mixing.mix(d, labels)
    assert got.columns == [c for c in d.columns if c not in ("rate", "missed")] + ["n_tokens", "domain", "posterior", "rate", "copies", "missed"]
    assert all(r["_row"] == "_row" and r["p"] == "p" for r in got.collect())
    assert mixing.resample(d, labels, {"q1_t0": 1.0}, relative=True).columns == d.columns


def test_mixing_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, None, 1), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs(spark, EDGE), labels).count() == len(EDGE)
    assert mixing.mix(docs(spark, []), labels).count() == 0
    none = mixing.mix(docs(spark, EDGE), labels.limit(0)).collect()
    assert len(none) == len(EDGE) and all(r.rate == 1 for r in none)
    back = mixing.resample(docs(spark, EDGE), labels.limit(0), {})
    assert back.columns == docs(spark, EDGE).columns and back.count() == len(EDGE) and {r.rate for r in back.collect()} == {"z"}
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, EDGE), labels, {"q1_t0": -1.0})


# 5

def test_decontamination(spark):
    item = "Alice bought 3 apples for 12 dollars and Alice sold 3 pears to Bob. What is left of the money now?"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "plain words that stand in one long line without any slots in them")], "item_id long, text string")
    rows = [
        (1, "Before it. " + item + " After it."),
        (2, "So Maria bought 5 apples for 90 dollars and Maria sold 5 pears to Tom. What is left of the money now?"),
        (3, "So Maria bought 5 apples for 90 dollars and Clara sold 7 pears to Tom. What is left of the money now?"),
        (4, "xx plain words that stand in one long line without any slots in them yy"),
        (5, "plain words that stand apart from everything else in this line of text"),
        (6, None), (7, ""), (8, LONG), (9, "Before it. " + item), (9, "Before it. " + item), (None, item),
    ]
    got = decontam.contaminated(docs(spark, rows), bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (1, 1), (2, 1), (4, 4), (9, 1)]
    assert all(r.similarity >= 0.8 for r in got)
    kept = decontam.keep_clean(docs(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 8] and kept.columns == docs(spark, rows).columns
    assert decontam.contaminated(docs(spark, []), bench).count() == 0
    assert decontam.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_judges_each_occurrence(spark):
    own = "Tom has 3 red apples in the old basket and then Ann has 5 red apples in the new basket of the house by the sea"
    other = "then Bob bought 4 green pears for 9 dollars and sold all of them on the market in the old town"
    bench = spark.createDataFrame([(1, own), (2, other)], "item_id long, text string")
    again = other.replace("4", "6").replace("9", "8")
    rows = [
        (1, f"before it. {own}. after it."),
        (2, f"before it. {other}. after it. {again}. {LONG}"),
        (3, f"{LONG} {other}. and once more he bought 7 green pears for 2 dollars and went"),
        (4, own.replace("has 3", "has 7").replace("has 5", "has 8")),
        (5, f"{other.replace('of them', 'of them there and then')}. {again}"),
        (7, own.replace("has 3", "has 7").replace("has 5", "has 7").replace("Tom", "Eve")),
    ]
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, rows), bench).collect())
    assert got == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 2), (7, 1)]
    twice = spark.createDataFrame([(1, "we saw Alice take 3 apples home and later on we saw Alice bring 3 pears to Bob on the long way")], "item_id long, text string")
    mixed = "we saw Maria take 3 apples home and later on we saw Clara bring 4 pears to Bob on the long way"
    assert decontam.contaminated(docs(spark, [(1, mixed), (2, f"{mixed}. {mixed}")]), twice).count() == 0
    # an item against all crossings of a text that repeats one window
    met = [(i, p) for i in (0, 3, 6) for p in (10, 13, 16)]
    assert [(0, 10), (3, 13), (6, 16)] in [sorted(x) for x in decontam.occurrences(met)]


def test_decontamination_finds_short_and_number_heavy_items(spark):
    texts = ["12 + 30 + 45 + 7 + 9", "What is 2+2?", "Yes", "Tom met Ann, Bob, Eve and Kim Lee", "Ann likes red and blue", "?!", "the sum of 1 2 3 4 5 6 7 is what we now want to know in the end"]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(i, f"so it says {t} and more") for i, t in enumerate(texts)] + [(10, "Sum: 12 + 30 + 45 + 7 + 8"), (11, "what is 2+3?"), (12, "12 + 30 + 45 + 7 + 9"), (13, "what is 2 + 2"), (None, "yes"), (14, None)]
    rows += [(15, "Is the sum of 8 2 3 4 5 6 7 is what we now want to know in the end"), (16, LONG)]
    got = decontam.contaminated(docs(spark, rows), bench).collect()
    want = [(i, i) for i in range(7) if i != 5] + [(12, 0), (13, 1), (15, 6), (-1, 2)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got) == sorted(want)
    assert all(0.8 <= r.similarity <= 1 and r.n_shared <= r.n_windows for r in got)


def test_decontamination_finds_planted_items(spark, sf):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, items = d.collect(), b.collect()
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    planted = {(x.doc_id, i.item_id) for x in texts for i in items if norm(i.text) in norm(x.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert planted <= got


def test_decontamination_of_scripts_without_spaces(spark):
    item, thai = "小明有12个苹果,他给了小红5个,还剩下多少个苹果?", "แม่มีส้ม 12 ผลและให้ลูก 5 ผล"
    rows = [
        (1, f"前面的话说了很多{item}后面的话也不少"), (2, item.replace("12", "30").replace("5", "7")), (3, "小红今天去学校,她在路上看到了很多花和树,非常高兴。"), (4, "x" + thai + "y"),
        (5, "今天天气很好,我有12个朋友,他们都住在5号楼里。"), (6, "Ask: " + item.replace("小明", "Alice")), (7, "日本"), (8, "これは日本です"), (9, None),
    ]
    items = spark.createDataFrame([(1, item), (2, thai), (3, "日本語"), (4, "日本")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, rows), items).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (6, 1), (7, 4), (8, 4)}
    texts = [item, thai, "二〇二四年Alice和Bob走了3.5公里", "ガッツポーズ abc日本ABC x5日", "漢\ufe00字 한국어 문장", "𠀀𠀁 ok", "", "日 本 Alice"]
    d = docs(spark, list(enumerate(texts))).select(F.size(decontam.raw_tokens(F.col("text"))).alias("raw"), F.size(decontam.canonical_tokens(F.col("text"))).alias("canonical"))
    assert all(r.raw == r.canonical for r in d.collect())


# 6

def test_url_filter(spark):
    canon = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.example.org/es/x", None), (2, "http://alias.net/p", canon.format("https://a.example.org/es/x")), (3, "https://EXAMPLE.org/en/12?q", ""),
        (4, None, None), (5, "no scheme", "x"), (6, "http://x.com/fr/1#a", ""), (7, "http://x.com/de/1", ""), (8, "http://badexample.org/es/", ""),
        (9, "http://m.other.net/q", '<meta http-equiv="refresh" content="0; url=http://x.com/de/1">'), (10, "http://other.net/q", ""), (11, "http://free.net/z", ""),
        (12, "http://both.net/1", canon.format("http://x.com/de/1") + '<meta http-equiv="refresh" content="0;url=http://x.com/fr/1">'), (11, "http://free.net/z", ""),
    ]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit("clash")).withColumn("node", F.lit(1))
    got = url_filter.judge(p).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and by[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[4] == by[5] == ("", "", None, "allow") and by[6][2:] == ("com/fr/", "allow") and by[7][2:] == ("com/de/", "block") and by[8][2:] == ("org/", "allow")
    assert by[2][2:] == (None, "block") and by[11][2:] == (None, "allow")
    # the component of 7, 9, 10 and 12 holds an explicit allow (6), which takes precedence
    assert by[9][3] == by[10][3] == by[12][3] == "allow"
    without = {r.page_id: r.verdict for r in url_filter.judge(p.where("page_id <> 12")).collect()}
    assert without[9] == without[10] == "block"
    assert url_filter.judge(p.limit(0)).count() == 0


def test_url_filter_resolves_every_target(spark):
    canon, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "http://x.com/de/y", ""), (2, "http://x.com/x", refresh.format("/de/y")), (3, "http://a.net/p", canon.format("//x.com/de/y")), (4, "http://x.com/de/q?s", None),
        (5, "http://x.com/b/c", refresh.format("../de/./y")), (6, "http://a.net/2", canon.format("http://free.net/") + canon.format("http://x.com/de/y")),
        (7, "http://a.net/3", f'<link title="{"x" * 3000}" rel="canonical" href="http://x.com/de/y">'), (8, "http://a.net/4", canon.format("mailto:a@x.com")), (9, "http://a.net/5", canon.format("page.html")),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "allow"}
    links = ["/de/y", "page.html", "//h/p", "?q", "#f", "https://h/p", "../../../z", "", "g/..", "page.html?a=../b"]
    d = spark.createDataFrame([(x, "http://e.com/a/b?k#z") for x in links], "l string, b string").coalesce(1)
    at = [r[0] for r in d.select(url_filter.resolve(F.col("l"), F.col("b"))).collect()]
    assert at == ["http://e.com/de/y", "http://e.com/a/page.html", "http://h/p", "http://e.com/a/b?q", "http://e.com/a/b?k", "https://h/p", "http://e.com/z", None, "http://e.com/a/", "http://e.com/a/page.html?a=../b"]


# 7

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    bits, h = [0] * 64, [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    for x in h:
        for b in range(64):
            bits[b] += x >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(h))


def test_simhash(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + (i or 0), t) for i, t in EDGE] + [(2000, " A B É"), (2001, "\x1ca b\x0bc\x85d")]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", find(i)) for i in fps}
    assert len(got) == len(fps)
    kept = simhash.keep_representatives(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in fps}) and kept.columns == docs(spark, rows).columns
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert {r.component_id for r in simhash.near_duplicates(docs(spark, [(None, "a"), (None, "b c d e")])).collect()} == {None}


@pytest.mark.parametrize("n", [2, 10, 24, 25, 400])
def test_bk_shards_lose_no_component(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    v = base[rng.integers(0, 5, n)]
    for _ in range(4):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    v = np.unique(v)

    def groups(pairs):
        root = list(range(len(v)))
        at = {x: i for i, x in enumerate(v.tolist())}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            ra, rb = find(at[a]), find(at[b])
            root[max(ra, rb)] = min(ra, rb)
        return [find(i) for i in range(len(v))]

    all_pairs = [(a, b) for i, a in enumerate(v.tolist()) for b in v.tolist()[:i] if (a ^ b).bit_count() <= 3]
    u, w = simhash.shard_links(v, 3)
    assert groups(zip(u.tolist(), w.tolist())) == groups(all_pairs) and len(u) < len(v)


def test_every_close_pair_shares_a_shard():
    rng = random.Random(0)
    for n in (10, 10**7, 10**10):
        masks = simhash.block_choices(n)
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not d & m for m in masks)
    assert len(simhash.block_choices(10)) == 4 < len(simhash.block_choices(10**7))


# 8

def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aab", "▁ab"]
    m = langid.fit([("ab aab ba", "x"), ("bb b bab", "y")], pieces)

    def brute(word):
        w, total = langid.MARK + word, 0
        for mask in range(1 << (len(w) - 1)):
            parts, start = [], 0
            for i in range(len(w) - 1):
                if mask >> i & 1:
                    parts.append(w[start : i + 1])
                    start = i + 1
            p = 1
            for x in [*parts, w[start:]]:
                r = m.row.get(x)
                p = p * (m.probs[r] if r is not None else (langid.UNKNOWN if len(x) == 1 else 0))
            total = total + p
        return np.log(total)

    words = ["a", "ab", "abba", "aabb", "zab", "zz"]
    assert np.allclose(m.words(words), [brute(w) for w in words]) and np.allclose([m.long_word(w) for w in words], [brute(w) for w in words])
    assert np.isfinite(m.long_word("ab" * 5000)).all()


def test_language_id(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    edge = docs(spark, EDGE)
    e = langid.identify(edge).collect()
    assert len(e) == len(EDGE) and {r.lang_pred for r in e if r.doc_id in (1, 2, 3)} == {"und"} and {r.lang_pred for r in e if r.doc_id in (4, 5)} == {"en"}
    assert langid.identify(docs(spark, [])).count() == 0
    assert langid.fit([("some words", "x")], ["▁", "a"]).texts(["² ½ 12 _", "a", "", None])[0] == ["und", "x", "und", "und"]
    assert {r.lang_pred for r in langid.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_identified(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 5, 6, 7, 8]


# 9

def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 1009)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(names[a] != names[:-1][b] for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.2 * 1009
    got = sharding.place(docs(spark, EDGE), names, 1009)
    assert got.count() == len(EDGE) and got.columns[-2:] == ["slot", "shard"]
    for r in got.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:12], 16) % 1009
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.place(docs(spark, [])).count() == 0
    for bad in (1000, 5):
        with pytest.raises(ValueError):
            sharding.fill_table(names, bad)


# 10

def brute_dedup(rows, n):
    seen, out = set(), {}
    for i, t in sorted({(-1 if i is None else i, t or "") for i, t in rows}, key=lambda x: (x[0] != -1, x)):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            if raw[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(raw[p : p + n])
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("ab" if seed == 1 else "abcdé ñ", k=rng.randrange(250))) for _ in range(10)]
    cut = lambda b: b[rng.randrange(len(b) + 1) :][: rng.randrange(120)]
    rows = [(i, "".join(cut(rng.choice(base)) for _ in range(rng.randrange(6))) + rng.choice(["", "a" * 90])) for i in range(40)]
    rows += [(rows[3][0], rows[3][1]), (None, rows[5][1]), (99, None), (100, "")]
    got = sa_dedup.deduplicate(docs(spark, rows), 24).collect()
    want = brute_dedup(rows, 24)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[-1 if r.doc_id is None else r.doc_id]


def test_substring_dedup_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sa_dedup.deduplicate(docs(spark, rows)).collect()
    want = brute_dedup(rows, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sa_dedup.deduplicate(docs(spark, [])).count() == 0
    assert sa_dedup.deduplicate(docs(spark, EDGE)).count() == len(EDGE)


def test_substring_dedup_splits_hot_triggers(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(30)
    rows = [(i, text(rng.randrange(12)) + " " + passage[rng.randrange(9) :] + " " + text(rng.randrange(12))) for i in range(150)]
    rows += [(200 + i, passage[40:] + text(3)) for i in range(3)] + [(-5, passage[:130])]
    want = brute_dedup(rows, 60)
    for parts in (1, 4):
        got = sa_dedup.deduplicate(docs(spark, rows, parts), 60).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def duck(name, rows, columns):
    """The registered SQL of a query on a small table."""
    import duckdb
    import pandas as pd

    from tideline.llm.oracles import ORACLE_SQL

    con = duckdb.connect()
    table = {"op3_license_scans": "documents", "op6_url_filters": "pages"}[name]
    con.register("given", pd.DataFrame(rows, columns=[c.split()[0] for c in columns]))
    con.execute(f"create table {table} as select {', '.join(f'{c.split()[0]}::{c.split()[1]} as {c.split()[0]}' for c in columns)} from given")
    r = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    return {row[0]: dict(zip(names, row)) for row in r.fetchall()}


def test_url_filter_equals_its_sql_where_pages_declare_links(spark):
    rng = random.Random(5)
    hosts, paths = ["x.com", "www.x.com", "example.org", "m.free.net", "free.net", "a.net"], ["/de/1", "/fr/1", "/es/2", "/view", "/view.html", "/a/b/c", "", "/a/b/"]
    tails = ["", "?id=1", "?id=2", "#f", "?", "/"]
    links = ["/de/1", "../../de/1", "./c", "page.html", "//x.com/fr/9", "?id=2", "#top", "", "mailto:a@b", "http://free.net/view?id=1", "https://example.org/es/2", "..", "g/../h", "/de/./1/.."]
    tag = lambda x: rng.choice([f"<base href='{x}'>", f'<!-- <link rel=canonical href="{x}"> -->', f'<LINK rel="canonical" data-x="{"y" * rng.choice([0, 3000])}" href="{x}">', f"<meta http-equiv=refresh content='0; url={x}'>"])
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}", "".join(tag(rng.choice(links)) for _ in range(rng.randrange(3)))) for i in range(150)]
    rows += [(900, None, tag("/de/1")), (901, "no scheme", tag("/de/1")), (902, "http://only.net/view?id=1", ""), (903, "http://only.net/view?id=2", "")]
    rows += [x for i in range(9) for x in ((300 + i, f"http://iso{i}.net/p/q", f'<link rel=canonical href="//z{i}.com/de/./{i}">'), (400 + i, f"http://z{i}.com/de/{i}", "" if i % 3 else '<meta http-equiv="refresh" content="1;url=../fr/">'), (500 + i, f"http://z{i}.com/fr/", ""))]
    columns = ["page_id bigint", "url varchar", "html varchar"]
    got = {r.page_id: r.asDict() for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = duck("op6_url_filters", rows, columns)
    assert got == want and sum(r["propagated"] for r in got.values()) > 5


def test_url_filter_reads_markup_as_browsers_do(spark):
    canon, to = '<link rel="canonical" href="{}">', "http://x.com/de/1"
    pages = {
        '<link rel="shortlink Canonical" href="http://x.com/de/1">': "block",  # several words
        '<base href="http://x.com/de/"><link rel=canonical href=1>': "block",
        '<link rel=canonical href=1><base target=_top><base href="http://x.com/de/"><base href="http://free.net/">': "block",  # the first base with a target, wherever it stands
        '<link title="a > b" rel="canonical" href="http://x.com/de/1">': "block",
        '<link rel="canonical" href="http:&#x2F;&#47;x.com&sol;de/1">': "block",
        '<link rel="canonical" href="http://x.com/v?a=1&amp;b=2">': "block",  # http://x.com/v?a=1&b=2 leads to a blocked page
        '<link rel="canonical" href="http://x.com/v?a=1&amp;amp;b=2">': "allow",  # decoded once
        '<link rel="canonical" data-href="http://x.com/de/1" href="http://free.net/">': "allow",
        '<link rel="canonical" data-href="http://x.com/de/1">': "allow",
        '<link title="rel=canonical href=http://x.com/de/1" rel="icon" href="/i.png">': "allow",
        f"<!-- {canon.format(to)} -->": "allow",
        f"<!-- never closed {canon.format(to)}": "allow",
        f"<!-->{canon.format(to)}": "block",
        f"<SCRIPT type='x'>var a = '{canon.format(to)}';</SCRIPT>": "allow",
        f"<script>1</script>{canon.format(to)}": "block",
        f"<title>{canon.format(to)}</title>": "allow",
        f"<img alt='{canon.format(to)}'>": "allow",
        f"<p don't>{canon.format(to)}": "block",  # a quote that follows no = opens nothing
        f"<linked rel=canonical href={to}>": "allow",
        f"<link rel=canonical href={to}": "allow",  # no end
        f"<link rel=canonical href=' {to}\n'>": "block",
        f"<link rel=canonical href=http://free.net/ href={to}>": "allow",  # the first of equal names counts
        f"<meta http-equiv=refresh content='0;{to}'>": "block",
        f'<meta content="5 , URL = \'{to}\' x" http-equiv=" Refresh ">': "block",
        f"<meta http-equiv=refresh content='{to}'>": "allow",
        "<meta http-equiv=refresh content=5>": "allow",
        f"<meta name=refresh content='0;url={to}'>": "allow",
        f"<link rel=canonical href='http://x.com/de/1&#xD800;&#0;&#9999999;&nothing;&'>": "block",
        "<link rel>": "allow",
        "": "allow",
    }
    rows = [(i, f"http://s{i}.net/p", html) for i, html in enumerate(pages)] + [(900, to, ""), (901, "http://x.com/v?a=1&b=2", canon.format(to))]
    columns = ["page_id bigint", "url varchar", "html varchar"]
    got = {r.page_id: r.asDict() for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {html: got[i]["verdict"] for i, html in enumerate(pages)} == pages
    assert got == duck("op6_url_filters", rows, columns)


def test_url_filter_reads_hostile_markup_in_one_pass(spark):
    """A million unclosed tags, comments, quotes and attributes: neither quadratic time nor a deep stack."""
    n = 200_000
    rows = [(i, f"http://s{i}.net/p", html + '<link rel=canonical href="http://x.com/de/1">') for i, html in enumerate(["<link " * n, "<!--" * n, "<a b=\"" * n, "<link " + "a='b' " * n, "<script>" * n, "&amp;" * n, "<" * n])]
    began = time.monotonic()
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[5] == got[6] == "block" and time.monotonic() - began < 60


def test_url_filter_writes_a_value_once_in_its_plan(spark):
    """The driver keeps and logs the plan's text again and again; copies in copies had made it 700,000 characters long."""
    pages = spark.createDataFrame([(1, "http://a.net/p", "")], "page_id long, url string, html string")
    plans = [url_filter.edges(pages), pages.select(url_filter.resolve(F.col("html"), F.col("url"))), pages.select(url_filter.attribute(F.col("html"), "href"))]
    assert [len(p._jdf.queryExecution().optimizedPlan().toString()) < n for p, n in zip(plans, (40_000, 7_000, 6_000))] == [True, True, True]
    texts = spark.createDataFrame([("x",), (None,)], "t string").select(common.let(F.col("t"), lambda t: F.coalesce(F.concat(t, t), F.lit("-"))).alias("t"))
    assert {r.t for r in texts.collect()} == {"xx", "-"}


def test_addresses_keep_their_query(spark):
    canon = '<link rel="canonical" href="http://x.com/de/1">'
    rows = [(1, "http://only.net/view?id=1", canon), (2, "http://only.net/view?id=2", ""), (3, "http://www.only.net/view?id=1#x", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


def brute_spans(text):
    """The labels that the method gives, from its definition: template by template, over plain lists."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found, n, best = set(), 0, 0.0
    for label, phrases in license_scan.TEMPLATES.items():
        for phrase in phrases:
            t = phrase.split()
            hits = sorted((p, k) for p in range(len(words) - 1) for k in range(len(t) - 1) if words[p : p + 2] == t[k : k + 2])
            parts, last = [], None
            for d in sorted({p - k for p, k in hits}):
                if last is None or d - last > license_scan.NEAR:
                    parts.append(set())
                parts[-1].add(d)
                last = d
            for part in parts:
                here = [x for x in hits if x[0] - x[1] in part]
                share = lambda hs: len({k for _, k in hs}) / (len(t) - 1)
                if share(here) < license_scan.COVERAGE:
                    continue
                if here[-1][0] + 2 - here[0][0] <= license_scan.STRETCH * len(t):
                    spans = [here]
                else:
                    spans, end = [], -1
                    for p in sorted({p for p, _ in here}):
                        near = [x for x in here if p <= x[0] <= p + int(license_scan.STRETCH * len(t)) - 2]
                        if share(near) >= license_scan.COVERAGE:
                            best = max(best, share(near))
                            found.add(label)
                            if p > end:
                                spans.append(near)
                                end = near[-1][0] + 1
                n += len(spans)
                if spans:
                    found.add(label)
                    best = max(best, *(share(s) for s in spans))
    return found, n, best


def test_license_spans_equal_brute_force_and_sql(spark):
    rng = random.Random(11)
    notices = [p for ps in license_scan.TEMPLATES.values() for p in ps]
    def near(p):
        w = p.split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [w[at], "new"], ["other"]])
        return " ".join(w)
    rows = [(i, rng.choice([" ", ". ", " and then some more words follow here "]).join(near(rng.choice(notices[:12] if i % 2 else notices)) for _ in range(rng.randrange(7)))) for i in range(80)]
    rows += [(100, "All rights reserved. " * 6), (101, "CC BY, CC BY, licensed under CC BY-NC 4.0"), (102, None)]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, rows)).collect()}
    want = duck("op3_license_scans", rows, ["doc_id bigint", "text varchar"])
    for i, t in rows:
        labels, n, best = brute_spans(t)
        base = brute_licenses(t)
        r = got[i]
        assert (set(filter(None, r.labels.split(","))), r.n_spans) == (labels | set(filter(None, base[4].split(","))), n), t
        assert abs(r.score - max(best, 1.0 if base[1] else 0.0)) < 1e-12
        assert r.asDict() == want[i], t


def brute_lanes(text):
    """A fingerprint's lanes from their definition."""
    import struct

    lanes = [0] * (fingerprints.WIDE + fingerprints.COUNTERS + 1)
    for paragraph in text.split("\n"):
        digest = hashlib.sha256(paragraph.encode()).hexdigest()
        for i in range(fingerprints.WIDE):
            h = xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(digest.encode(), 42))
            lanes[i] = (lanes[i] + (h & 0xFFFFFFFF)) % 2**32
    for piece in re.findall(fingerprints.PIECE, text):
        h = xxhash.xxh64_intdigest(piece.encode(), 42)
        for b in range(fingerprints.COUNTERS):
            lanes[fingerprints.WIDE + b] += h >> b & 1
        lanes[-1] += 1
    return lanes


def test_fingerprints_equal_brute_force_and_likeness_is_near_the_truth(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts |= {1000 + i: t or "" for i, t in enumerate(t for _, t in EDGE)}
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs(spark, list(texts.items()))).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].fingerprint == "".join(f"{x:08x}" for x in brute_lanes(t)) and got[i].edited_fingerprint == "".join(f"{x:08x}" for x in brute_lanes(edited))
        a, b = Counter(re.findall(fingerprints.PIECE, t)), Counter(re.findall(fingerprints.PIECE, edited))
        if t == edited:
            assert got[i].near_edited == 1
        elif min(a.total(), b.total()) >= 8:
            exact = 2 * sum(n * b[x] for x, n in a.items()) / (sum(n * n for n in a.values()) + sum(n * n for n in b.values()))
            errors.append(got[i].near_edited - exact)
    assert len(errors) > 100 and abs(np.mean(errors)) < 0.05 and np.sqrt(np.mean(np.square(errors))) < 0.2


def test_table_is_filled_by_turns():
    names, size = ["a", "b", "c", "d"], 101
    digest = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:16], 16)
    wishes = {n: [(digest(f"offset:{n}") + j * (digest(f"skip:{n}") % (size - 1) + 1)) % size for j in range(size)] for n in names}
    assert all(sorted(w) == list(range(size)) for w in wishes.values())
    owner, turn = {}, 0
    while len(owner) < size:
        n = names[turn % len(names)]
        owner[next(s for s in wishes[n] if s not in owner)] = n
        turn += 1
    assert [names[i] for i in sharding.fill_table(names, size)] == [owner[s] for s in range(size)]


def test_a_hundred_thousand_notices_are_scanned_in_seconds(spark):
    import time

    d = spark.createDataFrame([(1, "all rights reserved " * 100_000), (2, "all rights reserved " * 1_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = sorted((r.doc_id, r.n_base, r.n_spans, r.labels) for r in license_scan.scan(d).collect())
    assert got == [(1, 100_000, 100_000, "proprietary,reserved"), (2, 1_000, 1_000, "proprietary,reserved")]
    assert time.perf_counter() - began < 60
