"""The state store: contexts, current, range, previous and trend summaries over timelines of states.

A timeline is the rows of one set of keys in the order of start and index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def timeline_order(start: str, index: str) -> list[Column]:
    """Null starts and indices sort as zero."""
    return [F.coalesce(start, F.lit(0.0)), F.coalesce(index, F.lit(0))]


def matching(states: DataFrame, **wanted) -> DataFrame:
    """Equality on the given keys only."""
    for key, value in wanted.items():
        if value is not None:
            states = states.where(F.col(key) == F.lit(value))
    return states


def overlapping(states: DataFrame, start, end, start_column: str, end_column: str) -> DataFrame:
    """States that meet [start, end); nothing when the range is empty; null bounds never meet."""
    return states.where((F.lit(end) > F.lit(start)) & (F.col(start_column) < F.lit(end)) & (F.col(end_column) > F.lit(start)))


def with_total(states: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows and, beside them, how many there were."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    total = states.agg(F.count(F.lit(1)).alias("total_count"))
    return states.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))


def require_unambiguous(states: DataFrame, keys: list[str]) -> None:
    """Refuses an unqualified query over more than one context."""
    if len(states.select(*keys).distinct().take(2)) > 1:
        raise ValueError("the query fits more than one monitoring context; name it")


def contexts(states: DataFrame, keys: list[str], order: str, modality: str, start: str, end: str) -> DataFrame:
    """Per timeline: first known modality, number of states, first start and last end."""
    return states.groupBy(*keys).agg(
        F.min_by(modality, F.when(F.col(modality).isNotNull(), F.col(order))).alias("modality"), F.count(F.lit(1)).alias("state_count"), F.min(start).alias("start"), F.max(end).alias("end")
    )


def current_as_of(states: DataFrame, probes: DataFrame, keys: list[str], start: str, end: str, order: str, at: str) -> DataFrame:
    """For each probe (keys, at) the first state that contains it, else the latest with start <= at.

    Probes and states are merged in one sorted pass per timeline: the latest state before a probe is
    carried forward, and with it how far any state reaches, which tells the probes that need a search.
    """
    known = states.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    tagged = known.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_probe"), F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(order).alias("o")).alias("_state"), F.lit(None).cast(dict(probes.dtypes)[at]).alias(at))
    asked = probes.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_probe"), F.lit(None).cast(tagged.schema["_state"].dataType).alias("_state"), at)
    both = tagged.unionByName(asked)
    w = Window.partitionBy(*keys).orderBy("_t", "_probe", "_state.o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_last", F.last("_state", ignorenulls=True).over(w)).withColumn("_reach", F.max("_state.e").over(w)).where("_probe = 1")
    simple = carried.select(*keys, at, F.col("_last.o").alias("picked"), (F.col("_last.e") > F.col(at)).alias("contains"), (F.col("_reach") > F.col(at)).alias("_any"))
    # Only probes whose latest state has ended while an earlier, longer one still runs need the overlap search.
    # A state is in the two bins it may touch among bins of its own length (a power of two), a probe in one
    # bin of each length that its timeline has: equi-joins whose pairs are near overlaps.
    odd = simple.where("_any AND NOT contains").select(*keys, at)
    length = F.col(end) - F.col(start)
    sized = known.where(length > 0).withColumn("_level", F.ceil(F.log2(length.cast("double"))).cast("int"))
    step = F.pow(F.lit(2.0), F.col("_level"))
    place = F.floor(F.col(start) / step)
    placed = sized.select(*keys, "_level", F.explode(F.array(place, place + 1)).alias("_bin"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(order).alias("_o"))
    asking = odd.join(sized.select(*keys, "_level").distinct(), keys).withColumn("_bin", F.floor(F.col(at) / step))
    first = asking.join(placed, [*keys, "_level", "_bin"]).where((F.col("_s") <= F.col(at)) & (F.col("_e") > F.col(at))).groupBy(*keys, at).agg(F.min("_o").alias("_first"))
    return simple.join(first, [*keys, at], "left").select(*keys, at, F.coalesce("_first", "picked").alias("picked"), (F.col("contains") | F.col("_first").isNotNull()).alias("contains"))


def previous(states: DataFrame, keys: list[str], order: list[str], columns: list[str], offset: int = 1) -> DataFrame:
    """Adds previous_<column>: the value `offset` rows earlier in the timeline (an offset below 1 is 1)."""
    w = line(keys, order)
    return states.withColumns({f"previous_{c}": F.lag(c, max(1, offset)).over(w) for c in columns})


def previous_if_adjacent(states: DataFrame, keys: list[str], order: list[str], start: str, end: str, column: str, gap: float) -> DataFrame:
    """The previous value only where the gap to it is at most `gap`."""
    w = line(keys, order)
    return states.withColumn(f"previous_{column}", F.when(F.col(start) - F.lag(end).over(w) <= gap, F.lag(column).over(w)))


def last_write(states: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """One row per key: the last in the given order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return states.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def missing_fields(states: DataFrame, required: list[str]) -> DataFrame:
    """Adds complete and n_missing: only null is missing, 0 and false are values."""
    return states.withColumn("n_missing", sum((F.col(c).isNull().cast("int") for c in required), F.lit(0))).withColumn("complete", F.col("n_missing") == 0)


def hr_summary(states: DataFrame, keys: list[str], hr: Column, peak: Column) -> DataFrame:
    return states.groupBy(*keys).agg(F.avg(hr).alias("mean_hr"), F.min(hr).alias("min_hr"), F.max(hr).alias("max_hr"), F.count(hr).alias("hr_count"), F.max(peak).alias("peak_hr"), F.count(peak).alias("peak_count"))


def burden_summary(states: DataFrame, keys: list[str], ratio: Column, label: Column, wanted: str, order: str) -> DataFrame:
    """Ratio statistics, the latest ratio, and the share of the wanted label among labelled states."""
    return states.groupBy(*keys).agg(
        F.avg(ratio).alias("mean_burden"),
        F.max(ratio).alias("max_burden"),
        F.max_by(ratio, F.when(ratio.isNotNull(), F.col(order))).alias("latest_burden"),
        F.count(ratio).alias("burden_count"),
        F.avg(F.when(label.isNotNull(), (label == wanted).cast("double"))).alias("label_fraction"),
    )


def labelled_duration(states: DataFrame, keys: list[str], label: Column, wanted: str, duration: Column) -> DataFrame:
    """Total duration of a label; none is 0, not null."""
    return states.groupBy(*keys).agg(F.coalesce(F.sum(F.when(label == wanted, duration)), F.lit(0)).alias("duration"))


def distribution(states: DataFrame, keys: list[str], label: str) -> DataFrame:
    return states.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def capabilities(states: DataFrame, keys: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """Per key, which targets some state has all fields for."""
    return states.groupBy(*keys).agg(*(F.bool_or(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in columns))).alias(target) for target, columns in fields.items()))
