"""Recordings converted to Parquet: blocks of samples with range pruning, chunks with optional signals, locator views.

A long signal is stored in blocks (subject, channel, block_start, block_end, samples), so that a range
reads the blocks it meets and no others; a chunk is one row with all its channels.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what a record id may hold.
RECORD_ID = r"[A-Za-z0-9._-]+"


def write_blocks(samples: DataFrame, path: str, keys: list[str], place: str, value: str, size: int) -> None:
    """Samples (keys, place, value) in blocks of `size` places."""
    block = F.floor(F.col(place) / size)
    listed = samples.groupBy(*keys, block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("v")))).alias("r"))
    blocks = listed.select(*keys, (F.col("block") * size).alias("block_start"), (F.col("block") * size + F.size("r")).alias("block_end"), F.transform("r", lambda x: x["v"]).alias("samples"))
    blocks.write.mode("overwrite").parquet(path)


def read_range(spark: SparkSession, path: str, keys: list[str], start: int = 0, end: int | None = None) -> DataFrame:
    """(keys, start, samples) of [start, end): blocks outside are not read, those at the edges are cut."""
    blocks = spark.read.parquet(path).where(F.col("block_end") > start)
    if end is not None:
        blocks = blocks.where(F.col("block_start") < end)
    low = F.greatest(F.lit(start) - F.col("block_start"), F.lit(0))
    high = F.size("samples") if end is None else F.least(F.lit(end) - F.col("block_start"), F.size("samples"))
    cut = blocks.select(*keys, (F.col("block_start") + low).alias("at"), F.slice("samples", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("part"))
    joined = cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("r"))
    return joined.select(*keys, F.get("r", F.lit(0))["at"].alias("start"), F.flatten(F.transform("r", lambda x: x["part"])).alias("samples"))


def read_chunks(spark: SparkSession, path: str, include_signals: bool = True, signals: tuple[str, ...] = ("green", "ambient", "accel_x", "accel_y", "accel_z")) -> DataFrame:
    """The chunks of recordings, one partition or more a file; without signals their columns are not read."""
    rows = spark.read.parquet(path)
    return rows if include_signals else rows.drop(*signals)


def accel_slice(values: Column, start: Column, end: Column, ratio: Column, rounded: bool = False) -> Column:
    """The accelerometer samples beside [start, end): positions times the ratio of rates, cut or rounded to even."""
    at = lambda p: (F.bround(p * ratio) if rounded else F.floor(p * ratio)).cast("int")
    return F.slice(values, at(start) + 1, F.greatest(at(end) - at(start), F.lit(0)))


def signal_views(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """The part of a signal that each request (request_id, patient, chunk, window, from_s, to_s) names.

    By a window's sample bounds (window struct of chunk, start, end), else by a time range that one chunk
    must hold as a whole (the first such chunk), else a chunk as a whole; requests that fit nothing are left
    out.  Chunks: patient, chunk, start_s, end_s, rate, accel_rate, green, accel_x, accel_y, accel_z.
    """
    at = F.col("window.chunk").isNotNull()
    timed = F.col("from_s").isNotNull() & F.col("to_s").isNotNull()
    pairs = requests.join(chunks.withColumnRenamed("chunk", "of_chunk"), "patient")
    by_window = at & (F.col("of_chunk") == F.col("window.chunk")) & (F.col("window.end") <= F.size("green")) & (F.col("chunk").isNull() | (F.col("chunk") == F.col("of_chunk")))
    by_time = ~at & timed & (F.col("start_s") <= F.col("from_s")) & (F.col("to_s") <= F.col("end_s")) & (F.col("chunk").isNull() | (F.col("chunk") == F.col("of_chunk")))
    whole = ~at & ~timed & (F.col("of_chunk") == F.coalesce("chunk", F.lit(0)))
    fits = pairs.where(F.coalesce(by_window, F.lit(False)) | F.coalesce(by_time, F.lit(False)) | F.coalesce(whole, F.lit(False)))
    first = fits.groupBy("request_id").agg(F.min("of_chunk").alias("of_chunk"))
    found = fits.join(first, ["request_id", "of_chunk"])
    place = lambda second: F.bround((second - F.col("start_s")) * F.col("rate")).cast("int")
    low = F.when(at, F.col("window.start")).when(timed, place(F.col("from_s"))).otherwise(0).cast("int")
    high = F.when(at, F.col("window.end")).when(timed, F.least(place(F.col("to_s")), F.size("green"))).otherwise(F.size("green")).cast("int")
    bounded = found.withColumns({"low": low, "high": high})
    ratio = F.col("accel_rate") / F.col("rate")
    axes = {f"{c}_part": accel_slice(F.col(c), F.col("low"), F.col("high"), ratio) for c in ("accel_x", "accel_y", "accel_z")}
    return bounded.select("request_id", "patient", F.col("of_chunk").alias("chunk"), "low", "high", F.slice("green", F.col("low") + 1, F.col("high") - F.col("low")).alias("green"), *(c.alias(n) for n, c in axes.items()))


def nested(payload: Column, path: str) -> Column:
    """The value under a dotted path of a nested payload."""
    for name in path.split("."):
        payload = payload[name]
    return payload


class RecordStore:
    """Records by id, each read once and kept; uploads are written beside them as one JSON document."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.held: dict[str, DataFrame] = {}

    def write(self, row: DataFrame, record_id: str | None = None) -> str:
        """A one-row table of (sampling_rate, lead_name, samples, metadata) under a valid id, which is made up where there is none."""
        name = (record_id or f"aw-{uuid.uuid4().hex[:12]}").strip()
        if not re.fullmatch(RECORD_ID, name):
            raise ValueError(f"invalid record id: {record_id!r}")
        row.withColumn("record_id", F.lit(name)).coalesce(1).write.mode("overwrite").json(f"{self.folder}/{name}.json")
        self.held.pop(name, None)
        return name

    def get(self, record_id: str) -> DataFrame:
        if record_id not in self.held:
            self.held[record_id] = self.spark.read.json(f"{self.folder}/{record_id}.json").cache()
        return self.held[record_id]
