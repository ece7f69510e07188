"""Seeded hash order, stratified samples, splits and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int, identity: str) -> Column:
    """Order of a seeded draw: the digest of `<seed>:<id>`."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(identity).cast("string")), 256)


def _nth(df: DataFrame, strata: list[str], seed: int, identity: str) -> DataFrame:
    w = Window.partitionBy(*strata).orderBy(hash_key(seed, identity), identity)
    return df.withColumn("_n", F.row_number().over(w))


def ranked(df: DataFrame, strata: list[str], seed: int, identity: str) -> DataFrame:
    """Adds _n, the place of every row in its stratum's draw.

    A stratum may hold most rows, so it is ranked in 4,096 slices of its hash order: rows are numbered
    within a slice, and slices begin where the counts of those before them end.
    """
    tagged = df.withColumn("_h", hash_key(seed, identity)).withColumn("_slice", F.substring("_h", 1, 3))
    sizes = tagged.groupBy(*strata, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*strata).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*(F.col(c).alias(f"_k_{c}") for c in strata), F.col("_slice").alias("_k_slice"), before.alias("_start"))
    local = tagged.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_slice").orderBy("_h", identity)))
    same = F.col("_slice") == F.col("_k_slice")
    for c in strata:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return local.join(starts, same).withColumn("_n", F.col("_r") + F.col("_start")).select(*df.columns, "_n")


def per_stratum(df: DataFrame, strata: list[str], rows: int, seed: int, identity: str) -> DataFrame:
    return _nth(df, strata, seed, identity).where(F.col("_n") <= rows).drop("_n")


def stratified(df: DataFrame, stratum: str, cap: int, seed: int, identity: str) -> DataFrame:
    """At most cap rows: an even quota per stratum, the remainder to the first strata by name; short ones are not refilled."""
    names = df.select(stratum).distinct()
    placed = names.withColumn("_place", F.row_number().over(Window.orderBy(stratum)) - 1).crossJoin(F.broadcast(names.agg(F.count(F.lit(1)).alias("_strata"))))
    quota = placed.withColumn("_quota", F.floor(F.lit(cap) / F.col("_strata")) + (F.col("_place") < F.lit(cap) % F.col("_strata")).cast("int"))
    few = _nth(df, [stratum], seed, identity).where(F.col("_n") <= cap)  # a limit that is pushed below the shuffle
    return few.join(quota, stratum).where(F.col("_n") <= F.col("_quota")).drop("_n", "_place", "_strata", "_quota")


def split(df: DataFrame, strata: list[str], share: float, seed: int, identity: str, first: str = "dev", rest: str = "test") -> DataFrame:
    """Adds split: the first int(n share) rows of each stratum in hash order, and the others."""
    sizes = df.groupBy(*strata).agg(F.floor(F.count(F.lit(1)) * share).alias("_cut")).select(*(F.col(c).alias(f"_k_{c}") for c in strata), "_cut")
    same = F.lit(True)
    for c in strata:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return ranked(df, strata, seed, identity).join(sizes, same).select(*df.columns, F.when(F.col("_n") <= F.col("_cut"), first).otherwise(rest).alias("split"))


def preload(df: DataFrame, share: float, seed: int, identity: str) -> DataFrame:
    """Adds preloaded: round-half-even(share n) rows, but at least one is left out where there are two or more."""
    counted = ranked(df.withColumn("_all", F.lit(1)), ["_all"], seed, identity).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_total"))))
    missing = F.least(F.greatest(F.col("_total") - F.bround(F.col("_total") * share), F.lit(1)), F.greatest(F.col("_total") - 1, F.lit(0)))
    return counted.withColumn("preloaded", F.col("_n") > missing).select(*df.columns, "preloaded")


def duplicates(df: DataFrame, identity: str, first: int = 10) -> DataFrame:
    """The first repeated ids; none means that ids are unique."""
    return df.groupBy(identity).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(identity).limit(first)


def union_by_priority(parts: list[DataFrame], order: list[str], limit: int) -> DataFrame:
    """Rows of the first part, filled up from the next ones."""
    every = None
    for k, part in enumerate(parts):
        ranked = part.withColumn("_part", F.lit(k))
        every = ranked if every is None else every.unionByName(ranked, allowMissingColumns=True)
    return every.orderBy("_part", *order).limit(limit).drop("_part")


def same_totals(left: DataFrame, right: DataFrame, strata: list[str]) -> DataFrame:
    """The strata whose numbers of rows differ."""
    count = lambda df, name: df.groupBy(*strata).agg(F.count(F.lit(1)).alias(name))
    both = count(left, "left_n").join(count(right, "right_n"), strata, "full_outer").fillna(0, ["left_n", "right_n"])
    return both.where("left_n <> right_n")
