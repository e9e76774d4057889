"""A data source of raw frame files: fixed-size frames one after the other, no codec.

spark.dataSource.register(RawFrames); spark.read.format("raw_frames").options(height=.., width=.., ...).load(path). Partitions are runs of frames of a file, read
by seeking, so frames that are skipped, filtered away or cropped are not read. With the option push, and spark.sql.python.filterPushdown.enabled set, filters on
`frame` and `file` reach the source; others stay with Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import datasource as ds

KINDS = {"uint8": 1, "uint16": 2, "float32": 4, "float64": 8}
SCHEMA = "file string, frame bigint, t double, pixels array<array<double>>"


@dataclass
class Run(ds.InputPartition):
    file: str
    first: int
    stop: int


class RawFrames(ds.DataSource):
    """Options: height, width, dtype (uint8), fps (1), target_fps (every max(1, int(fps / target))-th frame is read), crop ("x0:x1" of the columns), split_mb (64), push (false).

    frame counts from 0 in its file, t is frame / fps in seconds. A last frame that is cut short is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        push = {k.lower(): v for k, v in self.options.items()}.get("push", "false").lower() == "true"
        return (PushingReader if push else FrameReader)(self.options)


class FrameReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.height, self.width, self.dtype = o["path"], int(o["height"]), int(o["width"]), o.get("dtype", "uint8")
        if self.dtype not in KINDS or self.height < 1 or self.width < 1:
            raise ValueError("height and width are at least 1, dtype is one of " + ", ".join(KINDS))
        self.fps = float(o.get("fps", 1))
        self.skip = max(1, int(self.fps / float(o["target_fps"]))) if "target_fps" in o else 1
        x0, x1 = (o.get("crop") or ":").split(":")
        self.x0, self.x1 = int(x0 or 0), min(int(x1 or self.width), self.width)
        self.size = self.height * self.width * KINDS[self.dtype]
        self.split = max(1, int(float(o.get("split_mb", 64)) * 1e6) // self.size)
        self.low, self.high, self.files = 0, None, None

    def partitions(self) -> list[Run]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(root)
        files = fs.get_file_info(pafs.FileSelector(root)) if found.type == pafs.FileType.Directory else [found]
        out = []
        for f in sorted((f for f in files if f.type == pafs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path):
            if self.files is not None and f.path not in self.files:
                continue
            n = f.size // self.size
            stop = n if self.high is None else min(n, self.high)
            out += [Run(f.path, a, min(a + self.split, stop)) for a in range(self.low, stop, self.split)]
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[tuple]:
        first = -(-partition.first // self.skip) * self.skip
        if first >= partition.stop:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        kind, step = np.dtype(self.dtype), KINDS[self.dtype]
        whole = self.x0 == 0 and self.x1 == self.width
        with fs.open_input_file(partition.file) as f:
            for i in range(first, partition.stop, self.skip):
                if whole:
                    a = np.frombuffer(f.read_at(self.size, i * self.size), kind).reshape(self.height, self.width)
                else:
                    # of a cropped frame only the columns kept, row by row
                    rows = (f.read_at((self.x1 - self.x0) * step, i * self.size + (y * self.width + self.x0) * step) for y in range(self.height))
                    a = np.stack([np.frombuffer(r, kind) for r in rows])
                yield partition.file, i, i / self.fps, a.astype(float).tolist()


class PushingReader(FrameReader):
    """A session without filter pushdown refuses readers that offer it, so only the option `push` asks for this one."""

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        """Takes bounds of `frame` and one name of `file`; gives back what it can't take."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("frame",) and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, ds.GreaterThan))
            elif column == ("frame",) and isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                stop = f.value + isinstance(f, ds.LessThanOrEqual)
                self.high = stop if self.high is None else min(self.high, stop)
            elif column == ("frame",) and isinstance(f, ds.EqualTo):
                self.low = max(self.low, f.value)
                self.high = f.value + 1 if self.high is None else min(self.high, f.value + 1)
            elif column == ("file",) and isinstance(f, ds.EqualTo):
                self.files = {f.value} if self.files is None else self.files & {f.value}
            else:
                yield f
