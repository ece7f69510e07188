"""Readers and writers of states, questions, contexts and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrain.schema import STATE

#: Column names that hold samples and times in uploaded tables.
SAMPLE_COLUMNS = ("sample", "voltage")
TIME_COLUMNS = ("time_ms", "timestamp_ms")
#: Keys of phone exports in both languages, and what they hold.
EXPORT_KEYS = {
    "设备": "device", "Device": "device",
    "记录日期": "recorded_at", "记录时间": "recorded_at", "Recorded Date": "recorded_at", "recorded_at": "recorded_at",
    "分类": "classification", "Classification": "classification", "Rhythm Classification": "classification",
    "症状": "symptoms", "Symptoms": "symptoms",
    "软件版本": "software_version", "Software Version": "software_version",
    "姓名": "name", "Name": "name",
    "出生日期": "birth_date", "Date of Birth": "birth_date",
    "采样率": "sample_rate", "Sampling Rate": "sample_rate", "sampling_rate": "sample_rate",
    "导联": "lead", "Lead": "lead", "lead_name": "lead",
    "单位": "unit", "Unit": "unit", "Units": "unit",
}
MICROVOLTS = ("µv", "μv", "uv", "microvolt", "microvolts")

QUESTION = T.StructType([T.StructField(n, T.StringType()) for n in ("question_id", "state_id", "template_id", "tier", "question_type", "question", "evaluation_method")] + [T.StructField("answer", T.ArrayType(T.StringType())), T.StructField("numeric_tolerance", T.DoubleType()), T.StructField("answer_set", T.ArrayType(T.StringType()))])


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """State lines under the fixed schema: unknown fields are ignored, blank lines skipped, `Unknown` rhythms are null."""
    rows = spark.read.schema(STATE).json(path)
    return rows.withColumns({c: F.nullif(c, F.lit("Unknown")) for c in ("rhythm_class", "previous_rhythm_class")})


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question lines; any line that is no record is an error that names it."""
    broken = "_broken"
    kind = T.StructType([*QUESTION.fields, T.StructField(broken, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", kind, {"columnNameOfCorruptRecord": broken}).alias("q")).select("q.*")
    found = rows.where(F.col(broken).isNotNull()).select(broken).limit(1).collect()
    if found:
        raise ValueError(f"not a question record: {found[0][0][:200]}")
    return rows.drop(broken)


def views(questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three disjoint projections: what an agent sees, what scoring needs, what describes the row."""
    agent, scoring = ["question_id", "state_id", "question"], ["question_id", "answer", "evaluation_method", "numeric_tolerance", "answer_set"]
    clean = questions.withColumn("answer_set", F.when(F.size("answer_set") > 0, F.col("answer_set")))
    rest = [c for c in questions.columns if c not in {*agent, *scoring}]
    return clean.select(*agent), clean.select(*scoring), clean.select("question_id", *rest)


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Context records of a replay file (lines of that record type) or of a single document."""
    rows = spark.read.option("multiLine", False).json(path)
    return rows.where(F.col("record_type") == "patient_context") if "record_type" in rows.columns else rows


def read_upload_table(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded table as one row: samples in order and the rate by the median time step.

    Blank samples are skipped; times that do not increase, or by steps more than 5 % off the median, are an error.
    """
    rows = spark.read.option("header", True).csv(path).withColumn("_n", F.monotonically_increasing_id())
    names = {c.strip().lower(): c for c in rows.columns}
    sample = next((names[c] for c in SAMPLE_COLUMNS if c in names), None)
    if sample is None:
        raise ValueError(f"no sample column among {rows.columns}")
    time = next((names[c] for c in TIME_COLUMNS if c in names), None)
    kept = rows.select("_n", F.col(sample).try_cast("double").alias("x"), (F.col(time) if time else F.lit(None)).try_cast("double").alias("t")).where("x IS NOT NULL")
    folded = kept.agg(F.array_sort(F.collect_list(F.struct("_n", "x", "t"))).alias("r"))
    steps = F.filter(F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.get("r", i)["t"] - F.get("r", i - 1)["t"]), lambda d: d.isNotNull())
    ordered = F.array_sort(F.when(F.size("r") > 1, steps).otherwise(F.array().cast("array<double>")))
    middle = (F.get(ordered, F.floor((F.size(ordered) - 1) / 2).cast("int")) + F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))) / 2
    return folded.select(F.transform("r", lambda v: v["x"]).alias("signal"), F.when(F.size(ordered) == 0, None).when((F.array_min(ordered) <= 0) | F.exists(ordered, lambda d: F.abs(d - middle) > 1e-3 + 0.05 * middle), F.raise_error(F.lit("times must increase evenly")).cast("double")).otherwise(F.bround(1000.0 / middle)).alias("sample_rate"))


def read_upload_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_phone_export(spark: SparkSession, path: str) -> DataFrame:
    """A phone's text export as one row: a line with one number is a sample, one with more cells is metadata.

    Microvolts become millivolts; without a unit samples are millivolts; a file without samples is an error.
    """
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    cells = F.filter(F.transform(F.split("value", r"[,;\t]"), lambda c: F.trim(c)), lambda c: c != "")
    split = lines.select("_n", cells.alias("c")).where(F.size("c") > 0)
    number = F.get("c", F.lit(0)).try_cast("double")
    key = F.create_map(*(F.lit(x) for kv in EXPORT_KEYS.items() for x in kv))[F.get("c", F.lit(0))]
    marked = split.select("_n", F.when(F.size("c") == 1, number).alias("x"), F.when(F.size("c") >= 2, key).alias("k"), F.get("c", F.lit(1)).alias("v"))
    folded = marked.agg(
        F.array_sort(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("_n", "x")))).alias("r"),
        F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("metadata"),
    )
    if folded.select(F.size("r")).first()[0] == 0:
        raise ValueError("the export holds no samples")
    micro = F.lower(F.coalesce(F.col("metadata")["unit"], F.lit("mv"))).isin(*MICROVOLTS)
    rate = F.nullif(F.regexp_extract(F.coalesce(F.col("metadata")["sample_rate"], F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    rate = F.bround(rate)
    return folded.select(F.transform("r", lambda v: F.when(micro, v["x"] / 1000).otherwise(v["x"])).alias("signal"), rate.alias("sample_rate"), "metadata")


READERS = {".json": read_upload_document, ".csv": read_upload_table, ".tsv": read_phone_export, ".txt": read_phone_export}


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension."""
    for ending, reader in READERS.items():
        if path.lower().endswith(ending):
            return reader(spark, path)
    raise ValueError(f"unknown upload format: {path}")


def read_guidelines(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as sections: file, section title, body."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    cut = whole.select("file", F.posexplode(F.split("value", r"(?m)^##\s+")).alias("place", "part")).where("place > 0")
    return cut.select("file", "place", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("title"), F.btrim(F.regexp_extract("part", r"(?s)^[^\n]*\n(.*)$", 1), F.lit(" \n\r\t")).alias("body"))
