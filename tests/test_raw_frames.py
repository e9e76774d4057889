"""Raw frame files: ranges, skipped and cropped frames are not read."""

import numpy as np
import pytest
from pyspark.sql import datasource as ds

from tideline.sources import frames


@pytest.fixture
def files(tmp_path):
    a = np.arange(20 * 4 * 6, dtype="uint16").reshape(20, 4, 6)
    (tmp_path / "a.raw").write_bytes(a[:12].tobytes())
    (tmp_path / "b.raw").write_bytes(a[12:].tobytes() + b"cut short")
    (tmp_path / "_hidden").write_bytes(b"x" * 500)
    return str(tmp_path), a


@pytest.mark.parametrize("push", ["false", "true"])
def test_frames_skip_crop_and_ranges(spark, files, push):
    path, a = files
    spark.dataSource.register(frames.RawFrames)
    pushing = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(pushing)
    spark.conf.set(pushing, push)
    try:
        scans(spark, path, a, push)
    finally:
        spark.conf.set(pushing, before)


def scans(spark, path, a, push):
    d = lambda **o: spark.read.format("raw_frames").options(**{"height": 4, "width": 6, "dtype": "uint16", "split_mb": 0.0002, "push": push, **o}).load(path)
    got = {(r.file[-5], r.frame): np.array(r.pixels) for r in d().collect()}
    assert sorted(got) == [("a", i) for i in range(12)] + [("b", i) for i in range(8)] and all(np.array_equal(x, a[i + 12 * (f == "b")]) for (f, i), x in got.items())
    got = sorted((r.file[-5], r.frame, r.t, r.pixels) for r in d(fps=30, target_fps=8, crop="0:3").where("frame >= 4 and frame < 10").collect())
    assert [x[:3] for x in got] == [("a", 6, 0.2), ("a", 9, 0.3), ("b", 6, 0.2)] and got[0][3] == a[6, :, :3].tolist()
    assert d().where("frame = 3 and t > 1").count() == 2 and d().where("frame > 100").count() == 0
    with pytest.raises(Exception, match="dtype"):
        d(dtype="int7").count()


def test_only_wanted_bytes_are_read(files, monkeypatch):
    path, _ = files
    read = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            read.append((n, at))
            return self.f.read_at(n, at)

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def open_input_file(self, p):
            return Counting(self.fs.open_input_file(p))

    from_uri = frames.pafs.FileSystem.from_uri
    monkeypatch.setattr(frames.pafs, "FileSystem", type("X", (), {"from_uri": staticmethod(lambda p: (Fs(from_uri(p)[0]), from_uri(p)[1]))}))
    r = frames.PushingReader({"path": path, "height": "4", "width": "6", "dtype": "uint16", "fps": "8", "target_fps": "2", "crop": "0:3"})
    left = list(r.pushFilters([ds.GreaterThan(("frame",), 1), ds.LessThanOrEqual(("frame",), 8), ds.EqualTo(("t",), 1.0)]))
    assert left == [ds.EqualTo(("t",), 1.0)]
    got = [row for p in r.partitions() for row in r.read(p)]
    assert [x[1] for x in got] == [4, 8, 4] and sum(n for n, _ in read) == 3 * 4 * 3 * 2
