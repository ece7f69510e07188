"""Clinical indexes, subject sheets, listings, and the formats that are converted once."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Sex codes of the clinical index.
SEX = {"0": "male", "1": "female"}


def read_index(spark: SparkSession, index: str, statements: str, code_column: str = "scp_codes", key: str = "ecg_id") -> DataFrame:
    """The record index with its diagnostic superclasses: codes looked up in the statement table, distinct and sorted."""
    rows = spark.read.option("header", True).option("escape", '"').csv(index)
    known = spark.read.option("header", True).option("escape", '"').csv(statements)
    code = known.columns[0]
    dimension = known.where(F.col("diagnostic") == "1.0").select(F.col(code).alias("code"), F.col("diagnostic_class").alias("class")) if "diagnostic" in known.columns else known.select(F.col(code).alias("code"), F.col("diagnostic_class").alias("class"))
    codes = F.map_keys(F.from_json(F.replace(code_column, F.lit("'"), F.lit('"')), "map<string,double>"))
    classes = rows.select(key, F.explode(codes).alias("code")).join(dimension, "code").where("class IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_set("class")).alias("classes"))
    sex = F.create_map(*(F.lit(x) for kv in SEX.items() for x in kv))[F.regexp_replace("sex", r"\.0$", "")] if "sex" in rows.columns else F.lit(None).cast("string")
    return rows.join(classes, key, "left").withColumns({"classes": F.coalesce("classes", F.array().cast("array<string>")), "sex_text": sex})


def newest(files: DataFrame, limit: int) -> DataFrame:
    """Record files of a listing, newest first; empty ones cannot be read and are left out."""
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return files.select(name.alias("record_id"), "modificationTime", "length").where("length > 0").orderBy(F.desc("modificationTime"), "record_id").limit(limit)


def uploaded(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """Uploaded record files, newest first."""
    return newest(spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder), limit)


def patients(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct patient numbers of a directory layout `p00123/...`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return files.select(F.regexp_extract("path", r"/p(\d+)/", 1).alias("patient")).where("patient <> ''").distinct()


def read_sheet(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """A small XLSX sheet as text columns, read from its XML; a subject list fits the driver."""
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SHEET}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{SHEET}t")))
        rows = []
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{SHEET}row"):
            cells: dict[int, str | None] = {}
            for cell in row.iter(f"{SHEET}c"):
                letters = re.match(r"[A-Z]+", cell.get("r", "A"))[0]
                place = 0
                for ch in letters:
                    place = place * 26 + ord(ch) - 64
                value = cell.find(f"{SHEET}v")
                inline = "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
                text = inline if value is None else value.text
                cells[place - 1] = shared[int(text)] if cell.get("t") == "s" and text is not None else text or None
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    if not rows:
        raise ValueError(f"{path} has no rows")
    names = [str(n or f"c{k}") for k, n in enumerate(rows[0])]
    body = [tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:]]
    return spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))


def flatten(nested: dict, prefix: str = "") -> dict[str, np.ndarray]:
    """Arrays of a nested payload under dotted names."""
    out: dict[str, np.ndarray] = {}
    for k, v in nested.items():
        key = k.decode() if isinstance(k, bytes) else str(k)
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{key}.")
        else:
            out[prefix + key] = np.asarray(v)
    return out


def convert_payload(payload: dict, subject: str, target: str) -> None:
    """One subject's nested arrays as one Parquet row per channel; for payloads that are trusted and already loaded."""
    rows = [(subject, name, np.ravel(v).astype(float).tolist(), int(v.shape[1]) if v.ndim > 1 else 1) for name, v in flatten(payload).items() if v.dtype.kind in "biuf"]
    pd.DataFrame(rows, columns=["subject", "channel", "samples", "width"]).to_parquet(target)


def read_hdf5(path: str, datasets: list[str], start: int = 0, end: int | None = None) -> dict[str, np.ndarray]:
    """Rows [start, end) of named datasets; needs h5py, which is optional."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py; convert the recordings to Parquet first") from e
    with h5py.File(path, "r") as f:
        return {name: f[name][start:end] for name in datasets if name in f}
