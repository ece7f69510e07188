"""Annotation markers, calendar repair and catalogues of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import line

#: Rhythm markers and the classes they stand for.
RHYTHM_MARKERS = {"N": "N", "AFIB": "AF", "AF": "AF", "AFL": "AF", "AFLT": "AF"}


def map_label(raw: F.Column) -> F.Column:
    """N or AF of a raw marker with or without its bracket, null for others."""
    table = F.create_map(*(F.lit(x) for kv in RHYTHM_MARKERS.items() for x in kv))
    return table[F.upper(F.regexp_replace(F.trim(raw), r"^\(|\)$", ""))]


def marker_spans(markers: DataFrame, keys: list[str], at: str, note: str, total: str) -> DataFrame:
    """Spans of rhythm markers: `(X` opens X and closes what is open, `)` closes, the last open one ends at the total.

    Markers are taken in order of sample and position; an opening without a label opens nothing.
    """
    events = markers.where(F.col(note).startswith("(") | (F.col(note) == ")"))
    w = Window.partitionBy(*keys).orderBy(at, "position")
    ends = events.withColumn("span_end", F.coalesce(F.lead(at).over(w), F.col(total)))
    label = F.regexp_replace(F.col(note), r"^\(", "")
    return ends.where(F.col(note).startswith("(") & (label != "")).select(*keys, F.col(at).alias("span_start"), F.least("span_end", total).alias("span_end"), label.alias("label")).where("span_end > span_start")


def repaired_days(chunks: DataFrame, keys: list[str], order: list[str], day: str, clock: str) -> DataFrame:
    """Adds full_day: blank day indices filled from the nearest known day, one more at each passing of midnight."""
    w = line(keys, order)
    crossed = F.when(F.col(clock) < F.lag(clock).over(w), 1).otherwise(0)
    marked = chunks.withColumn("_c", crossed).withColumn("_m", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.col(day) - F.col("_m")
    forward = F.last(base, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first(base, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumn("full_day", F.coalesce(F.col(day), forward + F.col("_m"), backward + F.col("_m"))).drop("_c", "_m")


def catalogue(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Ids that both listings have."""
    return first.select(key).distinct().join(second.select(key).distinct(), key, "left_semi")


def clipped_length(slices: DataFrame, keys: list[str], start: str, end: str, total: str) -> DataFrame:
    """Total length of requested slices within a recording."""
    return slices.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.least(end, total) - F.col(start))).alias("length"))
