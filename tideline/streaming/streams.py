"""Structured Streaming forms: hopping and session windows, deduplication, keyed online state.

Event time must be a TIMESTAMP at the stream's edge. A hopping window closes when the watermark passes its end; its state
is dropped then. Files are replayed at a chosen pace with maxFilesPerTrigger.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.config import Density
from tideline.operators.density import DecayedMixture
from tideline.session import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, delay: str = "1 hour", files_per_trigger: int | None = None, schema: str = EVENTS) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def hop_windows(stream: DataFrame, keys: list[str], size: str, slide: str) -> DataFrame:
    """keys, window_end (microseconds), n, mean: the batch operator's windows, with late rows dropped by the watermark."""
    d = stream.groupBy(*keys, F.window("ts", size, slide).alias("w")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return d.select(*keys, F.unix_micros("w.end").alias("window_end"), "n", "mean")


def session_windows(stream: DataFrame, keys: list[str], gap: str) -> DataFrame:
    d = stream.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return d.select(*keys, F.unix_micros("w.start").alias("s"), F.unix_micros("w.end").alias("e"), "n")


def once_only(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows reprocessed within the watermark's delay are dropped."""
    return stream.dropDuplicatesWithinWatermark(keys)


def online_density(stream: DataFrame, key: str, cfg: Density = Density()) -> DataFrame:
    """key, block, score: the decayed mixture of each key lives in state; a block is scored when it is full."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        rows, block, packed = state.get if state.exists else ("[]", 0, "")
        x = np.array(json.loads(rows) + sorted((t.value // 1000, v) for f in frames for t, v in zip(f["ts"], f["value"])), float).reshape(-1, 2)
        model = None
        if packed:
            model = DecayedMixture(cfg.components, cfg.decay, cfg.epsilon)
            for name, v in json.loads(packed).items():
                setattr(model, name, np.array(v))
        out = []
        while len(x) >= cfg.block:
            part, x = x[: cfg.block, 1:], x[cfg.block :]
            if model is None:
                model = DecayedMixture(cfg.components, cfg.decay, cfg.epsilon).fit(part)
            else:
                out.append((k[0], block, float(model.log_density(part).mean())))
                model.update(part)
            block += 1
        packed = json.dumps({n: getattr(model, n).tolist() for n in ("weight", "mean", "cov", "m", "c")}) if model else ""
        state.update((json.dumps(x.tolist()), block, packed))
        yield pd.DataFrame(out, columns=[key, "block", "score"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, block long, score double", "rows string, block long, model string", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, name: str, mode: str = "append", seconds: int | None = None) -> DataFrame:
    """Run a stream over what is there into Parquet in the shared folder, and read it.

    Executors write it batch by batch, so nothing is gathered on the driver. In complete mode the last batch's table stays. Each call
    has a place of its own, so that no earlier run's state is taken up. It ends when all is read, however long that takes; only where
    `seconds` are given is a longer run an error.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/drained/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, i: int) -> None:
        # a batch that is run again writes the same place
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={i}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    try:
        if seconds is None:
            q.awaitTermination()
        elif not q.awaitTermination(seconds):
            raise TimeoutError(name)
    finally:
        q.stop()
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
