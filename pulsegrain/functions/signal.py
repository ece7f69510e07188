"""Signal kernels that need whole windows of samples: vectorised functions over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def band_pass_array(x: np.ndarray, rate: float, low: float = 0.5, high: float = 4.0) -> np.ndarray:
    """Zero-phase band pass: frequencies outside the band are removed from the spectrum."""
    if len(x) < 4:
        return x - x.mean() if len(x) else x
    spectrum = np.fft.rfft(x - x.mean())
    f = np.fft.rfftfreq(len(x), 1 / rate)
    spectrum[(f < low) | (f > high)] = 0
    return np.fft.irfft(spectrum, len(x))


def peaks_array(x: np.ndarray, rate: float, least_gap_s: float = 0.25, level: float = 0.3) -> np.ndarray:
    """Local maxima above a share of the range, at least a gap apart, higher ones first."""
    if len(x) < 3:
        return np.zeros(0, int)
    inner = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    inner = inner[x[inner] > x.mean() + level * x.std()]
    kept: list[int] = []
    for k in inner[np.argsort(-x[inner], kind="stable")]:
        if all(abs(k - j) >= least_gap_s * rate for j in kept):
            kept.append(int(k))
    return np.array(sorted(kept), int)


def without_dicrotic(peaks: np.ndarray, rate: float) -> np.ndarray:
    """Two passes that drop a peak whose gap to the kept one before is under half the upper quartile."""
    for _ in range(2):
        if len(peaks) < 3:
            break
        limit = 0.5 * np.percentile(np.diff(peaks), 75)
        keep = [0]
        for k in range(1, len(peaks)):
            if peaks[k] - peaks[keep[-1]] >= limit:
                keep.append(k)
        peaks = peaks[keep]
    return peaks


def dominant_frequency_array(x: np.ndarray, rate: float, low: float = 0.7, high: float = 3.0) -> tuple[float, float]:
    """Strongest frequency of the band, and the band's share of all power."""
    if len(x) < 8:
        return float("nan"), 0.0
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    f = np.fft.rfftfreq(len(x), 1 / rate)
    band = (f >= low) & (f <= high)
    total = power[1:].sum()
    if not band.any() or total <= 0:
        return float("nan"), 0.0
    return float(f[band][power[band].argmax()]), float(power[band].sum() / total)


def dominant_rate_array(x: np.ndarray, rate: float, low: float = 0.7, high: float = 3.0) -> list[float]:
    """Beats a minute of the strongest frequency of the band and its share of the band's power; zeros under four seconds."""
    x = x[np.isfinite(x)]
    if len(x) < max(8, rate * 4):
        return [0.0, 0.0]
    power, f = np.abs(np.fft.rfft(x - x.mean())) ** 2, np.fft.rfftfreq(len(x), 1 / rate)
    band = (f >= low) & (f <= high)
    if not band.any() or power[band].sum() <= 0:
        return [0.0, 0.0]
    top = int(power[band].argmax())
    return [float(f[band][top] * 60), float(power[band][top] / power[band].sum())]


def sample_entropy_array(x: np.ndarray, m: int = 2, share: float = 0.2, most: int = 1000) -> float:
    """-log of the share of m-matches that stay matches with one value more; nan without matches."""
    x = x[:most]
    if len(x) < m + 2:
        return float("nan")
    r = share * x.std()

    def matches(k: int) -> int:
        t = np.lib.stride_tricks.sliding_window_view(x, k)[: len(x) - m]
        return sum(int((np.abs(t[i + 1 :] - t[i]).max(axis=1) <= r).sum()) for i in range(len(t) - 1))

    b, a = matches(m), matches(m + 1)
    return float(-np.log(a / b)) if a and b else float("nan")


def resample_array(x: np.ndarray, n: int) -> np.ndarray:
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x) if len(x) else np.zeros(n)


def _each(series: pd.Series, rates: pd.Series, f) -> pd.Series:
    return pd.Series([f(np.asarray([] if x is None else x, float), float(r)) for x, r in zip(series, rates, strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def band_pass(signal: pd.Series, rate: pd.Series) -> pd.Series:
    return _each(signal, rate, band_pass_array)


@F.pandas_udf(T.ArrayType(T.LongType()))
def pulse_peaks(signal: pd.Series, rate: pd.Series) -> pd.Series:
    return _each(signal, rate, lambda x, r: without_dicrotic(peaks_array(band_pass_array(x, r), r), r))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def dominant_frequency(signal: pd.Series, rate: pd.Series) -> pd.Series:
    return _each(signal, rate, lambda x, r: list(dominant_frequency_array(x, r)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def dominant_rate(signal: pd.Series, rate: pd.Series) -> pd.Series:
    return _each(signal, rate, dominant_rate_array)


@F.pandas_udf(T.DoubleType())
def sample_entropy(values: pd.Series) -> pd.Series:
    return values.map(lambda x: sample_entropy_array(np.asarray([] if x is None else x, float)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resampled(values: pd.Series, size: pd.Series) -> pd.Series:
    return _each(values, size, lambda x, n: resample_array(x, int(n)))
