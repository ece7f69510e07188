"""What the text operators share: table access, shared folders and row-wise Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrain.runtime import shared_folder, ship

_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it (names do not differ by case alone)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text_column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text: sizes intermediate parts, never decides results."""
    found = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_column))).first()
    return found[0], found[1] or 0


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """The rows written once to the shared folder and read again: cuts lineage and survives lost executors.

    Not with the default codec, whose buffers outside the heap stay until they are garbage: large binary
    values make them large.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        delete_folder(df.sparkSession, df.scratch_path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps: Spark deletes them once their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows and bytes of text that are handed to a Python worker at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def prepare(spark: SparkSession) -> None:
    """Ships the source to the workers and lowers the session's Arrow batches, for less memory in executors and workers."""
    ship(spark)
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


def map_batches(df: DataFrame, columns: list[str], schema: str, function: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over the named columns only; `function` maps one batch to one batch or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
            del batch, out
            trim()

    prepare(df.sparkSession)
    return df.select(*columns).mapInArrow(run, schema)


def trim() -> None:
    """Gives memory that is free but held back to the system; workers are reused for many tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_column: str, sample_docs: int, sample_bytes: int, id_column: str, text_column: str) -> tuple[DataFrame | None, dict[int, int]]:
    """Whole texts for training, (_y, _text), and the number of labels of each kind; None unless there are both kinds.

    The ids of each label are taken in the order of their hash, at most `sample_docs`, while their texts
    add up to `sample_bytes` (the first always): the length of a text alone excludes no document.  A
    repeated id stands for the text with the least hash among its own.
    """
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    valid = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    seen = {r["_y"]: r["count"] for r in valid.groupBy("_y").count().collect()}
    if len(seen) < 2:
        return None, seen
    picked = []
    for value in (0, 1):
        part = valid.where(F.col("_y") == value).select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
        picked += [(k, r[0], value) for k, r in enumerate(part.collect())]
    chosen = F.broadcast(spark.createDataFrame(picked, f"_nth long, _id {kind}, _y int"))
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).where(F.length("_text") > 0)
    one = texts.join(chosen, "_id").groupBy("_y", "_nth").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    sizes = one.select("_y", "_nth", F.octet_length("_text").alias("n")).orderBy("_y", "_nth").collect()
    total, last = {0: 0, 1: 0}, {0: -1, 1: -1}
    for r in sizes:
        if not total[r["_y"]] or total[r["_y"]] + r["n"] <= sample_bytes:
            last[r["_y"]] = r["_nth"]
        total[r["_y"]] += r["n"]
    within = (F.col("_y") == 0) & (F.col("_nth") <= last[0]) | (F.col("_y") == 1) & (F.col("_nth") <= last[1])
    return one.where(within).select("_y", "_text"), seen


def crc32_text(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))
