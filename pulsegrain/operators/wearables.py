"""Wearable recordings converted to one row a channel: window slices, the feature vector, label windows.

channels: (subject, channel, samples, width); a channel of width 3 holds its axes one after the other,
sample by sample.  windows: (subject, start_s, end_s) and whatever else names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrain.functions import records as rc
from pulsegrain.functions import signal as sg
from pulsegrain.functions import vitals as vt

#: Channels of both wearable sets and their rates in Hz.
RATES = {"label": 700.0, "signal.wrist.BVP": 64.0, "signal.wrist.ACC": 32.0, "signal.wrist.EDA": 4.0, "signal.wrist.TEMP": 4.0, "signal.chest.Resp": 700.0, "signal.chest.ECG": 700.0}
#: Names of the window features, in their order.
FEATURES = "bvp_mean bvp_std bvp_min bvp_max bvp_range bvp_abs_mean bvp_diff_std bvp_dom_hr_bpm bvp_dom_power_ratio eda_mean eda_std eda_min eda_max eda_range eda_slope_per_s eda_diff_abs_mean acc_mag_mean acc_mag_std acc_mag_range acc_diff_abs_mean acc_x_std acc_y_std acc_z_std temp_mean temp_std temp_slope_per_s resp_mean resp_std resp_range resp_diff_std".split()
#: Protocol labels that are states, and the activities.
PROTOCOL = {1: "baseline", 2: "stress", 3: "amusement", 4: "meditation"}
ACTIVITIES = {1: "sitting", 2: "stairs", 3: "table_soccer", 4: "cycling", 5: "driving", 6: "lunch", 7: "walking", 8: "working", 9: "clean_baseline"}


def windowed(channels: DataFrame, windows: DataFrame, names: list[str], rates: dict[str, float] = RATES) -> DataFrame:
    """The windows with their slice of each channel as a column (dots as underscores); an unknown channel is null."""
    out = windows
    for name in names:
        column = name.replace(".", "_")
        one = channels.where(F.col("channel") == name).select(F.col("subject"), F.col("samples").alias("_all"), F.col("width").alias("_width"))
        at = lambda second, rate=rates[name]: F.bround(second * rate) * F.coalesce("_width", F.lit(1))
        low = F.least(F.greatest(at(F.col("start_s")), F.lit(0)), F.size("_all")).cast("int")
        high = F.least(F.greatest(at(F.col("end_s")), F.lit(0)), F.size("_all")).cast("int")
        out = out.join(one, "subject", "left").withColumn(column, F.when(F.col("_all").isNotNull(), F.slice("_all", low + 1, F.greatest(high - low, F.lit(0))))).drop("_all", "_width")
    return out


def axis(values: Column, k: int, width: int = 3) -> Column:
    return F.filter(values, lambda x, i: i % width == k)


def _or_zero(*columns: Column) -> list[Column]:
    return [F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c) for c in columns]


def features(channels: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows with their 30 features; a missing or empty channel gives zeros."""
    names = ["signal.wrist.BVP", "signal.wrist.EDA", "signal.wrist.ACC", "signal.wrist.TEMP", "signal.chest.Resp"]
    rows = windowed(channels, windows, names)
    empty = F.array().cast("array<double>")
    rows = rows.withColumns({n.replace(".", "_"): F.coalesce(n.replace(".", "_"), empty) for n in names})
    bvp, eda, acc, temp, resp = (F.col(n.replace(".", "_")) for n in names)
    duration = F.col("end_s") - F.col("start_s")
    clean = F.transform(acc, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x))
    x, y, z = (axis(clean, k) for k in range(3))
    rows = rows.withColumns({"_mag": F.transform(F.arrays_zip(x.alias("x"), y.alias("y"), z.alias("z")), lambda v: F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])), "_dom": sg.dominant_rate(bvp, F.lit(RATES["signal.wrist.BVP"]))})
    mag = F.col("_mag")
    warm, breath = rc.trend_features(temp, duration), rc.stats_features(resp, True)
    values = [
        *rc.stats_features(bvp, True), *_or_zero(F.get("_dom", F.lit(0)), F.get("_dom", F.lit(1))), *rc.trend_features(eda, duration),
        *_or_zero(vt.mean(mag), vt.std(mag), F.array_max(mag) - F.array_min(mag), vt.mean(F.transform(vt.differences(mag), F.abs)), vt.std(x), vt.std(y), vt.std(z)),
        warm[0], warm[1], warm[5], breath[0], breath[1], breath[4], breath[6],
    ]
    return rows.select(*windows.columns, *(v.alias(n) for n, v in zip(FEATURES, values, strict=True)))


def labels(channels: DataFrame, channel: str = "label") -> DataFrame:
    """(subject_id, recording_id, sample, label) of a label channel."""
    one = channels.where(F.col("channel") == channel)
    return one.select(F.col("subject").alias("subject_id"), F.col("subject").alias("recording_id"), F.posexplode("samples").alias("sample", "label")).withColumn("label", F.col("label").cast("int"))


def clean_grid(channels: DataFrame, width_s: float, stride_s: float, allowed: list[int], least: float, cap: int) -> DataFrame:
    """(subject, start_s, end_s, label, share) of windows on a grid whose dominant allowed label holds its share; at most cap a label."""
    from pyspark.sql import Window

    from .intervals import mode_smallest

    rate = RATES["label"]
    width, stride = round(width_s * rate), round(stride_s * rate)
    marks = labels(channels)
    size = marks.groupBy("subject_id").agg(F.max("sample").alias("_last"))
    # each sample lies in the windows that begin within one width before it
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("sample") - width + 1) / stride)), F.floor(F.col("sample") / stride))
    inside = marks.join(size, "subject_id").withColumn("place", F.explode(starts)).where(F.col("place") * stride + width <= F.col("_last") + 1)
    found = mode_smallest(inside, ["subject_id", "place"], "label").where(F.col("mode").isin(allowed) & (F.col("fraction") >= least))
    w = Window.partitionBy("subject_id", "mode").orderBy("place")
    kept = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    return kept.select(F.col("subject_id").alias("subject"), (F.col("place") * stride / rate).alias("start_s"), ((F.col("place") * stride + width) / rate).alias("end_s"), F.col("mode").alias("label"), F.col("fraction").alias("share"))
