import corpus_pipeline
from tideline.llm import queries


def test_stages_keep_columns_and_clean_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns[: len(columns)] == columns and (len(out.columns) == len(columns) or k == len(corpus_pipeline.STAGES) - 1)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert all(a >= b for a, b in zip(sizes, sizes[1:])) and sizes[-1] > 0.6 * sizes[0]
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in docs.collect())


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_on_nulls_repeats_empty_tables_and_clashing_names(spark, sf):
    from pyspark.sql import functions as F

    long = "some words of a text that goes on and on " * 2000
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "no id at all"), (5, long), (6, "tie tie tie tie"), (7, "tie tie tie tie")]
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    d = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    d = d.withColumns({c: F.lit(c) for c in ("th", "fp", "p", "_row", "rate", "h", "score", "found", "component_id")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        added = ["slot", "shard"] if name == "sharding" else []
        assert out.columns == d.columns + added, name
        got = [r.doc_id for r in out.collect()]
        assert stage(spark, d.limit(0), sf).count() == 0, name
        want = {"language_id": {None, 4, 5, 6, 7}, "near_dedup": {None, 1, 4, 5, 6}}.get(name, {None, 1, 2, 3, 4, 5, 6, 7})
        assert set(got) == want, name
        if name == "near_dedup":
            assert len(got) == len(want)


def test_other_texts_under_a_repeated_or_null_id_stay(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 60").first().text
    words = ["stone river lamp cloud paper", "green valley bread honey market", "iron winter boat candle forest", "silver garden horse letter window"]
    clean = [" ".join(f"{w}{k}" for k in range(12) for w in x.split()) for x in words]
    rows = [(5, clean[0]), (5, clean[1]), (None, clean[2]), (None, clean[3]), (5, item), (None, "before it " + item), (5, clean[0]), (4, clean[0] + " end")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    got = sorted((tuple(r) for r in stages["decontamination"](spark, d, sf).collect()), key=str)
    assert got == sorted((r for r in rows if item not in r[1]), key=str)
    got = sorted((tuple(r) for r in stages["near_dedup"](spark, d, sf).collect()), key=str)
    # the two that hold the item are near copies, and so are the first and the last
    assert got == sorted((r for r in set(rows) if r != (5, clean[0]) and r != rows[5]), key=str)


def test_near_copies_go_and_one_of_each_group_stays(spark, sf):
    base = [[f"{c}{k}" for k in range(80)] for c in "abcdefgh"]
    rows = []
    for i, words in enumerate(base):
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 4):
            edited = list(words)
            edited[9 * j + i] = "changed"
            rows.append((10 * i + j, " ".join(edited)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, d, sf).collect()) == [10 * i for i in range(8)]
