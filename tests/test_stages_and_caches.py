"""Stages that skip what is done, and caches that are merged on read."""

import json

import pytest
from pyspark.sql import functions as F

from tideline.sources import stages, store
from tideline.sources.cache import KeyedCache


def test_a_second_run_reads_no_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "p string, v int").write.partitionBy("p").parquet(src)
    seen = spark.sparkContext.accumulator(0)

    def stage(d):
        def count(frames):
            for f in frames:
                seen.add(len(f))
                yield f

        return d.mapInPandas(count, d.schema).groupBy("p").agg(F.sum("v").alias("s"))

    def run():
        before = seen.value
        d, done = stages.run_stage(spark, src, "v int, p string", "p", out, stage)
        return sorted((r.p, r.s) for r in d.collect()), done, seen.value - before

    assert run() == ([("a", 3), ("b", 3)], ["a", "b"], 3)
    assert run() == ([("a", 3), ("b", 3)], [], 0)
    spark.createDataFrame([("b", 10), ("c", 1)], "p string, v int").write.mode("append").partitionBy("p").parquet(src)
    assert run() == ([("a", 3), ("b", 13), ("c", 1)], ["b", "c"], 3)
    # a partition that is gone has no result, whatever is on disk
    for f in (tmp_path / "in" / "p=a").iterdir():
        f.unlink()
    (tmp_path / "in" / "p=a").rmdir()
    assert run() == ([("b", 13), ("c", 1)], [], 0)


def test_a_broken_run_is_done_again(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1)], "p string, v int").write.partitionBy("p").parquet(src)

    def broken(d):
        raise RuntimeError("broke off")

    with pytest.raises(RuntimeError):
        stages.run_stage(spark, src, "v int, p string", "p", out, broken)
    d, done = stages.run_stage(spark, src, "v int, p string", "p", out, lambda d: d)
    assert done == ["a"] and [(r.p, r.v) for r in d.collect()] == [("a", 1)]


def test_cache_last_version_wins_and_is_not_moved(spark, tmp_path):
    c = KeyedCache(spark, str(tmp_path / "cache"), "k string, v int, w string", 4)
    assert c.rows().collect() == [] and [r.hit for r in c.lookup(spark.createDataFrame([("a",)], "k string")).collect()] == [False]
    put = lambda rows: c.append(spark.createDataFrame(rows, "k string, v int, w string"))
    put([("a", 1, "x"), ("b", 2, None), (None, 9, "z"), ("c", 3, "y"), ("c", 4, "y")])
    put([("a", 5, "new")])
    want = {("a", 5, "new"), ("b", 2, None), ("c", 4, "y")}
    assert {tuple(r) for r in c.rows().collect()} == want
    c.compact()
    assert {tuple(r) for r in c.rows().collect()} == want and c.log() is None
    put([("b", 7, "late"), ("d", 8, "d")])
    want = want - {("b", 2, None)} | {("b", 7, "late"), ("d", 8, "d")}
    assert {tuple(r) for r in c.rows().collect()} == want
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("e", 3), ("a", 4), (None, 5)], "k string, i int")
    got = {(r.i, r.k, r.v, r.w, r.hit) for r in c.lookup(asked).collect()}
    assert got == {(1, "a", 5, "new", True), (2, "b", 7, "late", True), (3, "e", None, None, False), (4, "a", 5, "new", True), (5, None, None, None, False)}
    assert {r.k for r in c.misses(asked).collect()} == {"e", None}
    c.compact()
    again = KeyedCache(spark, str(tmp_path / "cache"), "k string, v int, w string", 4)
    assert {tuple(r) for r in again.rows().collect()} == want and again.log() is None


def test_lookup_plan_has_no_exchange_over_the_cache(spark, tmp_path):
    c = KeyedCache(spark, str(tmp_path / "cache"), "k bigint, v bigint", 4)
    c.append(spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    c.compact()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.range(100).withColumnRenamed("id", "k").join(c.base(), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[: plan.index("FileScan")].split("SortMergeJoin")[1]
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and "Exchange" in above


def test_the_last_reply_of_an_id_counts(spark, tmp_path):
    say = lambda i, text: json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": text}}]}}})
    (tmp_path / "1.jsonl").write_text("\n".join([say("a", '{"x": 1}'), say("b", "no"), say("a", '{"x": 2}')]))
    (tmp_path / "2.jsonl").write_text(say("b", '{"x": 3}'))
    got = {r.custom_id: r.parsed and r.parsed.x for r in store.read_responses(spark, str(tmp_path / "*.jsonl"), "x int").collect()}
    assert got == {"a": 2, "b": 3}
