"""Heart-rate variability, irregularity and quality as expressions over arrays.

All functions take and give columns and stay inside the JVM.  Arrays are small (one window); nothing
here needs a shuffle.  Divisions that have no meaning give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def finite(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def plausible(intervals: Column, low: float, high: float) -> Column:
    return F.filter(intervals, lambda x: x.between(low, high))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def _squares(values: Column, centre: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - centre) * (x - centre))


def _let(value: Column, body) -> Column:
    """Names an intermediate column once, so that it is not computed again wherever it is used."""
    return F.transform(F.array(value), body)[0]


def std(values: Column, ddof: int = 0) -> Column:
    return _let(mean(values), lambda m: F.when(F.size(values) > ddof, F.sqrt(_squares(values, m) / (F.size(values) - ddof))))


def differences(values: Column) -> Column:
    """Each value minus the one before."""
    return F.when(F.size(values) < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(1))), lambda b, a: b - a))


def heart_rate(intervals: Column) -> Column:
    return F.try_divide(F.lit(60000.0), mean(intervals))


def sdnn(intervals: Column) -> Column:
    return F.when(F.size(intervals) >= 3, std(intervals, 1))


def rmssd(intervals: Column) -> Column:
    return F.when(F.size(intervals) >= 3, _let(differences(intervals), lambda d: F.sqrt(mean(F.transform(d, lambda x: x * x)))))


def pnn50(intervals: Column) -> Column:
    return _let(differences(intervals), lambda d: F.try_divide(F.lit(100.0) * F.size(F.filter(d, lambda x: F.abs(x) > 50)), F.size(d)))


def variation(intervals: Column, ddof: int = 0) -> Column:
    return F.try_divide(std(intervals, ddof), mean(intervals))


def turning_points(values: Column) -> Column:
    """Share of strict local extrema among inner values."""
    n = F.size(values)
    inner = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
    v = lambda i: F.get(values, i)
    hits = F.filter(inner, lambda i: ((v(i) > v(i - 1)) & (v(i) > v(i + 1))) | ((v(i) < v(i - 1)) & (v(i) < v(i + 1))))
    return F.when(n >= 3, F.size(hits) / (n - 2))


def delta_entropy(intervals: Column, bins: int = 16) -> Column:
    """Shannon entropy of the differences over equal bins of their range, as a share of the largest possible one."""

    def over(d: Column) -> Column:
        low, high = F.array_min(d), F.array_max(d)
        placed = F.transform(d, lambda x: F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)))

        def of(p: Column) -> Column:
            counts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(p, lambda x: x == b)))
            share = lambda c: c / F.size(p)
            return F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))) / F.log2(F.lit(float(bins)))

        return F.when(F.size(d) == 0, None).when(high - low < 1e-6, F.lit(0.0)).otherwise(_let(placed, of))

    return _let(differences(intervals), over)


def classify_rhythm(intervals: Column) -> Column:
    """Unknown, AF, N or Other from the clean intervals; thresholds are fixed values."""

    def over(rr: Column) -> Column:
        return F.transform(
            F.array(F.struct(variation(rr).alias("cv"), delta_entropy(rr).alias("h"), turning_points(rr).alias("t"))),
            lambda x: F.when((x["cv"] > 0.06) & (x["h"] > 0.50) & x["t"].between(0.45, 0.80), "AF").when(x["cv"] < 0.05, "N").otherwise("Other"),
        )[0]

    clean = plausible(finite(intervals), 200, 2500)
    return F.when(intervals.isNull() | (F.size(clean) < 5), "Unknown").otherwise(_let(clean, over))


def poincare(intervals: Column) -> Column:
    """SD1 and SD2 of successive pairs."""

    def over(d: Column) -> Column:
        sd1 = std(d, 1) / F.sqrt(F.lit(2.0))
        sd2 = F.sqrt(F.greatest(F.lit(0.0), 2 * F.pow(std(intervals, 1), F.lit(2.0)) - F.pow(std(d, 1), F.lit(2.0)) / 2))
        return F.struct(sd1.alias("sd1"), sd2.alias("sd2"), F.try_divide(sd1, sd2).alias("ratio"))

    return _let(differences(intervals), over)


def pulse_irregular(cv: Column, pnn: Column, rms: Column, quality: Column) -> Column:
    """At least two of three signs, unless the quality is too low to tell."""
    votes = (cv >= 0.18).cast("int") + (pnn >= 35).cast("int") + (rms >= 120).cast("int")
    return F.when(quality < 0.6, False).otherwise(votes >= 2)


def hr_category(hr: Column) -> Column:
    return F.when(hr.isNull(), None).when(hr < 60, "low").when(hr > 100, "high").otherwise("normal")


def hr_assessment(hr: Column) -> Column:
    return F.when(hr.isNull(), None).when(hr < 60, "bradycardia").when(hr > 100, "tachycardia").otherwise("normal")


def rr_category(rr: Column) -> Column:
    return F.when(rr.isNull(), None).when(rr < 600, "below_normal").when(rr > 1000, "above_normal").otherwise("normal")


def quality_label(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score >= 0.8, "good").when(score >= 0.5, "acceptable").otherwise("poor")


def weighted_quality(scores: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the known scores, weights renormalised."""
    top = sum((F.coalesce(s, F.lit(0.0)) * w for s, w in scores), F.lit(0.0))
    return F.try_divide(top, sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in scores), F.lit(0.0)))


def snr_proxy(values: Column) -> Column:
    """Spread of the signal against the spread of its differences."""
    return _let(differences(values), lambda d: F.try_divide(std(values), std(d)))


def saturated(ratio: Column, scale: float) -> Column:
    return F.tanh(ratio / scale)


def motion_level(x: Column, y: Column, z: Column) -> Column:
    """low, medium or high from the spread of the acceleration's length."""
    length = F.transform(F.arrays_zip(x.alias("x"), y.alias("y"), z.alias("z")), lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"]))
    return _let(std(length), lambda s: F.when(s.isNull(), None).when(s < 0.02, "low").when(s < 0.08, "medium").otherwise("high"))


def motion_intensity(x: Column, y: Column, z: Column) -> Column:
    size = F.transform(F.arrays_zip(x.alias("x"), y.alias("y"), z.alias("z")), lambda v: F.abs(v["x"]) + F.abs(v["y"]) + F.abs(v["z"]))
    return F.tanh(2 * mean(size))


def baseline_drift(values: Column) -> Column:
    """Mean of the last quarter minus that of the first."""
    q = F.greatest(F.lit(1), F.floor(F.size(values) / 4).cast("int"))
    return mean(F.slice(values, F.size(values) - q + 1, q)) - mean(F.slice(values, F.lit(1), q))


def slope(first: Column, last: Column, duration: Column) -> Column:
    return F.try_divide(last - first, duration)


def decimate(values: Column, target: int, digits: int = 6) -> Column:
    """Every ceil(n / target)-th value, at most `target` of them, rounded."""
    step = F.greatest(F.lit(1), F.ceil(F.size(values) / target)).cast("int")
    return F.slice(F.transform(F.filter(values, lambda x, i: i % step == 0), lambda x: F.round(x, digits)), 1, target)


def z_scores(values: Column) -> Column:
    return _let(F.struct(mean(values).alias("m"), std(values).alias("s")), lambda t: F.transform(values, lambda x: F.coalesce(F.try_divide(x - t["m"], t["s"]), F.lit(0.0))))


def time_slice(values: Column, start_s: Column, end_s: Column, rate: Column) -> Column:
    """Samples [round(start rate), round(end rate)) within bounds; halves round to even."""
    low = F.least(F.greatest(F.bround(start_s * rate).cast("int"), F.lit(0)), F.size(values))
    high = F.least(F.greatest(F.bround(end_s * rate).cast("int"), low), F.size(values))
    return F.slice(values, low + 1, high - low)


def samples_for(seconds: Column, rate: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(seconds * rate).cast("long"))


def range_flag(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNull(), None).when(value < low, "below").when(value > high, "above").otherwise("within")


def peak_instant_rate(intervals: Column) -> Column:
    return F.try_divide(F.lit(60000.0), F.array_min(intervals))


def variability_label(per_hour: Column) -> Column:
    return F.when(per_hour.isNull(), None).when(per_hour <= 0, "stable").when(per_hour <= 3, "occasional_changes").otherwise("frequent_changes")


def usability(values: Column, beats: Column) -> Column:
    """unusable, poor, limited or usable from finite share, amplitude range and number of beats."""
    good = finite(values)
    spread = F.array_max(good) - F.array_min(good)
    return F.when(values.isNull() | (F.size(good) == 0), "unusable").when((F.size(good) < 0.98 * F.size(values)) | (spread <= 1e-6), "poor").when(beats < 3, "limited").otherwise("usable")


def stability(sustained: Column, dominant_share: Column, valid: Column) -> Column:
    """How steady a rhythm is, from the classes with sustained runs."""
    irregular = F.arrays_overlap(sustained, F.array(F.lit("AF"), F.lit("Other")))
    normal = F.array_contains(sustained, "N")
    return (
        F.when((valid == 0) | dominant_share.isNull(), "unknown")
        .when(normal & irregular, "frequent_changes")
        .when(normal | irregular, "stable")
        .when(dominant_share >= 0.5, "stable")
        .otherwise("occasional_changes")
    )
