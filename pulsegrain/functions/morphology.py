"""ECG wave delineation and lead findings, one vectorised call per column of leads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .signal import peaks_array

RESULT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("qrs_ms", "pr_ms", "qt_ms", "qtc_ms", "st_mv", "t_mv", "q_depth_mv", "q_ms", "r_mv")] + [T.StructField("beats", T.LongType())])
#: Plausible ranges of intervals in ms, and limits of findings in mV and ms.
PLAUSIBLE = {"qrs_ms": (40.0, 200.0), "pr_ms": (80.0, 400.0), "qt_ms": (200.0, 600.0)}
ST_UP, ST_DOWN, T_FLAT, Q_DEPTH, Q_WIDTH, Q_SHARE = 0.1, -0.05, 0.05, 0.1, 40.0, 0.33


def delineate(x: np.ndarray, rate: float) -> dict[str, float]:
    """Means over beats: intervals by slope around each R peak, ST at J + 60 ms, T and Q against the beat's baseline."""
    peaks = peaks_array(x, rate, 0.3, 2.0)
    if len(peaks) < 2:
        return {"beats": len(peaks)}
    slope = np.abs(np.gradient(x)) * rate
    ms = lambda n: 1000.0 * n / rate
    at = lambda t: int(round(t * rate))
    found: dict[str, list[float]] = {k: [] for k in ("qrs_ms", "pr_ms", "qt_ms", "st_mv", "t_mv", "q_depth_mv", "q_ms", "r_mv")}
    for r in peaks:
        low, high = r - at(0.3), r + at(0.5)
        if low < 0 or high >= len(x):
            continue
        limit = 0.1 * slope[r - at(0.06) : r + at(0.06) + 1].max()
        on = next((k for k in range(r - at(0.02), low, -1) if (slope[max(low, k - at(0.01)) : k + 1] < limit).all()), low)
        off = next((k for k in range(r + at(0.02), r + at(0.12)) if (slope[k : k + at(0.01) + 1] < limit).all()), r + at(0.12))
        base = float(np.median(x[max(low, on - at(0.06)) : max(low + 1, on - at(0.01))]))
        p = low + at(0.05) + int(np.argmax(x[low + at(0.05) : max(low + at(0.05) + 1, on - at(0.02))]))
        t_from = off + at(0.08)
        t = t_from + int(np.argmax(np.abs(x[t_from:high] - base)))
        t_end = next((k for k in range(t, high) if abs(x[k] - base) < 0.1 * abs(x[t] - base) + 1e-9), high)
        st = x[off + at(0.05) : off + at(0.07) + 1].mean() - base
        below = np.flatnonzero(x[on:r] < base - 1e-3)
        for name, value in (("qrs_ms", ms(off - on)), ("pr_ms", ms(on - p)), ("qt_ms", ms(t_end - on)), ("st_mv", st), ("t_mv", x[t] - base), ("r_mv", x[r] - base)):
            if name not in PLAUSIBLE or PLAUSIBLE[name][0] <= value <= PLAUSIBLE[name][1]:
                found[name].append(float(value))
        if len(below):
            found["q_depth_mv"].append(float(base - x[on:r].min()))
            found["q_ms"].append(ms(len(below)))
    out = {k: float(np.mean(v)) for k, v in found.items() if v}
    rr = float(np.mean(np.diff(peaks))) / rate
    if "qt_ms" in out:
        out["qtc_ms"] = out["qt_ms"] / np.sqrt(rr)
    return out | {"beats": len(peaks)}


@F.pandas_udf(RESULT)
def wave_intervals(signal: pd.Series, rate: pd.Series) -> pd.DataFrame:
    rows = [delineate(np.asarray([] if x is None else x, float), float(r)) for x, r in zip(signal, rate, strict=True)]
    return pd.DataFrame([{f.name: row.get(f.name, 0 if f.name == "beats" else None) for f in RESULT.fields} for row in rows], columns=RESULT.names).astype({"beats": "int64", **{n: "float64" for n in RESULT.names[:-1]}})


def findings(w: F.Column) -> F.Column:
    """Names of what a lead's waves show."""
    names = [
        F.when(w["st_mv"] > ST_UP, "st_elevation"),
        F.when(w["st_mv"] < ST_DOWN, "st_depression"),
        F.when(F.abs(w["t_mv"]) < T_FLAT, "t_flat").when(w["t_mv"] < 0, "t_inverted"),
        F.when((w["q_depth_mv"] > Q_DEPTH) & (w["q_ms"] > Q_WIDTH) & (F.try_divide(w["q_depth_mv"], w["r_mv"]) > Q_SHARE), "q_pathological"),
    ]
    return F.array_compact(F.array(*names))


def r_progression(heights: F.Column) -> F.Column:
    """normal if the last R is higher than the first and none drops below 0.7 of the one before; needs four leads."""
    steps = F.zip_with(F.slice(heights, 2, F.greatest(F.size(heights) - 1, F.lit(1))), F.slice(heights, 1, F.greatest(F.size(heights) - 1, F.lit(1))), lambda b, a: b >= 0.7 * a)
    return F.when(F.size(heights) < 4, None).when((F.element_at(heights, -1) > F.element_at(heights, 1)) & F.forall(steps, lambda s: s), "normal").otherwise("poor")
