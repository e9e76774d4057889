from pyspark.sql import functions as F

from tideline.config import DAY, HOUR
from tideline.operators import timeops
from tideline.plans.registry import events
from tideline.streaming import streams


def source(spark, sf, tmp_path, n=3):
    d = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").coalesce(1)
    for i in range(n):
        d.where(F.pmod("event_id", F.lit(n)) == i).write.parquet(str(tmp_path / "in" / f"part={i}"))
    return streams.event_stream(spark, str(tmp_path / "in" / "*"), "60 days", files_per_trigger=1)


def test_windows_equal_batch(spark, sf, tmp_path):
    got = streams.drain(streams.hop_windows(source(spark, sf, tmp_path), ["user_id"], "1 day", "6 hours"), "hops", "complete")
    want = timeops.hop_stats(events(spark, sf), ["user_id"], "t", "value", DAY, 6 * HOUR)
    assert sorted(tuple(r) for r in got.select("user_id", "window_end", "n").collect()) == sorted(tuple(r) for r in want.select("user_id", "window_end", "n").collect())


def test_sessions_and_dedupe(spark, sf, tmp_path):
    s = streams.drain(streams.session_windows(source(spark, sf, tmp_path), ["user_id"], "6 hours"), "sessions", "complete")
    assert s.agg(F.sum("n")).first()[0] == events(spark, sf).count()
    d = source(spark, sf, tmp_path / "again")
    once = streams.drain(streams.once_only(d.unionByName(d), ["event_id"]).select("event_id"), "once")
    assert once.count() == events(spark, sf).count()


def test_online_density_scores_full_blocks(spark, sf, tmp_path):
    got = streams.drain(streams.online_density(source(spark, sf, tmp_path, 2), "user_id"), "density")
    sizes = {r.user_id: r["count"] for r in events(spark, sf).groupBy("user_id").count().collect()}
    assert got.count() == sum(max(0, n // 10 - 1) for n in sizes.values())


def test_draining_waits_for_a_long_stream(spark, sf, tmp_path, monkeypatch):
    from pyspark.sql.streaming import StreamingQuery

    wait = StreamingQuery.awaitTermination
    # a stream that outlasts any time limit
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self) if timeout is None else False)
    assert streams.drain(source(spark, sf, tmp_path).select("event_id"), "long").count() == events(spark, sf).count()
