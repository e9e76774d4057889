"""Wrist motion features of one window: aggregates over rows of (accelerometer, gyroscope, magnetometer) readings.

All but the spectral features are built-in aggregates, so that a window's rows are combined before they are shuffled where
no order is needed. The spectral ones (FFT, Welch, step peaks) work on a window's short array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.filters import cascade
from tideline.functions.scalar import correlation
from tideline.operators.timeops import wrapped_turn

RATE = 50.0


def magnitude(x: str, y: str, z: str) -> Column:
    return F.sqrt(F.col(x) ** 2 + F.col(y) ** 2 + F.col(z) ** 2)


def tilt(x: str, y: str, z: str) -> Column:
    return F.atan2(F.col(z), F.sqrt(F.col(x) ** 2 + F.col(y) ** 2))


def _corr(a: str, b: str) -> Column:
    return F.coalesce(F.nanvl(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)), F.lit(0.0))


def accelerometer(prefix: str = "a") -> dict[str, Column]:
    x, y, z = (f"{prefix}{c}" for c in "xyz")
    m = magnitude(x, y, z)
    return {
        "mag_mean": F.avg(m), "mag_std": F.stddev_pop(m), "mag_max": F.max(m),
        "x_std": F.stddev_pop(x), "y_std": F.stddev_pop(y), "z_std": F.stddev_pop(z),
        "xy_corr": _corr(x, y), "xz_corr": _corr(x, z), "yz_corr": _corr(y, z),
        "sma": F.sum(F.abs(x) + F.abs(y) + F.abs(z)), "tilt": F.avg(tilt(x, y, z)),
    }


def gyroscope(prefix: str = "g") -> dict[str, Column]:
    x, y, z = (f"{prefix}{c}" for c in "xyz")
    m = magnitude(x, y, z)
    return {"gyro_mean": F.avg(m), "gyro_std": F.stddev_pop(m), "gyro_max": F.max(m), "gx_std": F.stddev_pop(x), "gy_std": F.stddev_pop(y), "gz_std": F.stddev_pop(z)}


def crossed(a: str = "a", g: str = "g") -> dict[str, Column]:
    """Both sensors together; needs columns am and gm (magnitudes)."""
    return {
        "am_gm_corr": _corr("am", "gm"),
        "energy_ratio": F.sum(F.col("gm") ** 2) / (F.sum(F.col("am") ** 2) + 1e-8),
        "combined": F.sqrt(F.avg(F.col("am") ** 2) + F.avg(F.col("gm") ** 2)),
    }


def magnetometer(prefix: str = "m") -> dict[str, Column]:
    m = magnitude(*(f"{prefix}{c}" for c in "xyz"))
    return {"field_mean": F.avg(m), "field_std": F.stddev_pop(m)}


def ordered_features(df: DataFrame, keys: list[str], order: list[str], lag: int) -> DataFrame:
    """Order-dependent features of windows: autocorrelation, zero crossings, smoothness, intensity, tilt and heading changes.

    Needs am, gm (magnitudes), tilt and heading. One sort serves all of them.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumns({
        "_l": F.lag("am", lag).over(w), "_p": F.lag("am").over(w), "_q": F.lag("am", 2).over(w),
        "_t": F.abs(F.col("tilt") - F.lag("tilt").over(w)), "_h": wrapped_turn(F.col("heading") - F.lag("heading").over(w)),
    })
    jerk = F.col("am") - 2 * F.col("_p") + F.col("_q")
    return d.groupBy(*keys).agg(
        correlation("am", "_l").alias("autocorr"), (F.count_if(F.signum("am") * F.signum("_p") < 0) / F.count("*")).alias("zero_cross_rate"),
        (-F.coalesce(F.sum(jerk**2), F.lit(0.0))).alias("smoothness"), F.ln(1 + F.var_pop("am") + F.var_pop("gm")).alias("intensity"),
        F.count_if(F.col("_t") > 0.2).alias("tilt_changes"), F.coalesce(F.avg("_h"), F.lit(0.0)).alias("heading_change"),
    )


def spectrum(x: np.ndarray, rate: float = RATE) -> dict[str, float]:
    """Dominant frequency (without DC), centroid and entropy (nats) of the first half of the magnitude spectrum."""
    n = len(x)
    half = n // 2
    if half < 2:
        return {"dominant": 0.0, "centroid": 0.0, "entropy": 0.0}
    mag, freq = np.abs(np.fft.fft(x))[:half], np.fft.fftfreq(n, 1 / rate)[:half]
    total = mag.sum()
    p = mag / total if total > 0 else np.zeros(half)
    return {"dominant": float(freq[1 + int(mag[1:].argmax())]), "centroid": float((freq * p).sum()), "entropy": float(-(p[p > 0] * np.log(p[p > 0])).sum())}


def welch(x: np.ndarray, rate: float = RATE, segment: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Power density: Hann windows of `segment` samples, half overlapping, means removed."""
    n = min(len(x), segment)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = max(1, n - n // 2)
    parts = [x[i : i + n] for i in range(0, len(x) - n + 1, step)]
    psd = np.mean([np.abs(np.fft.rfft((p - p.mean()) * w)) ** 2 for p in parts], axis=0) / (rate * (w**2).sum())
    psd[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / rate), psd


def bands(x: np.ndarray, rate: float = RATE) -> dict[str, float]:
    """Energy shares of the posture, movement and tremor bands and of periodic movement."""
    if len(x) < 4:
        return {"low": 0.0, "mid": 0.0, "high": 0.0, "periodicity": 0.0}
    f, p = welch(x, rate)
    total = p.sum() + 1e-8
    share = lambda m: float(p[m].sum() / total)
    return {"low": share(f <= 0.3), "mid": share((f > 0.3) & (f <= 3)), "high": share((f > 3) & (f <= 15)), "periodicity": share((f >= 0.3) & (f <= 3.5))}


def peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima of at least `height`, the higher ones first, that lie `distance` samples apart or more."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)) + 1
    stays = np.ones(len(at), bool)
    for i in np.argsort(-x[at], kind="stable"):
        if stays[i]:
            # only neighbours within the distance are looked at
            stays[np.searchsorted(at, at[i] - distance, "right") : np.searchsorted(at, at[i] + distance, "left")] = False
            stays[i] = True
    return at[stays]


def steps(x: np.ndarray, rate: float = RATE) -> int:
    """Peaks of the band-passed window (0.5 to 3 Hz, from rest) that are a deviation high and 0.3 s apart; 0 for 8 samples or fewer."""
    if len(x) <= 8:
        return 0
    _, y = cascade(0.5, 3.0, rate).run(None, x)
    return len(peaks(y, float(y.std()), int(0.3 * rate)))


def spectral_features(df: DataFrame, keys: list[str], order: list[str], value: str, rate: float = RATE) -> DataFrame:
    """keys and the ten spectral features, from each window's own series (bounded by its length)."""
    series = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda r: r["_v"]).alias("x"))
    names = ["dominant", "centroid", "entropy", "low", "mid", "high", "periodicity", "steps"]

    def all_of(x: pd.Series) -> pd.DataFrame:
        rows = []
        for v in x:
            v = np.nan_to_num(np.asarray(v, float))
            rows.append({**spectrum(v, rate), **bands(v, rate), "steps": float(steps(v, rate))})
        return pd.DataFrame(rows, columns=names)

    f = F.pandas_udf(all_of, ", ".join(f"{n} double" for n in names))
    return series.select(*keys, f("x").alias("f")).select(*keys, "f.*")

