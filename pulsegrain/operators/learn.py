"""The stress classifier: a forest over window features, trained and judged subject by subject."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean_windows(rows: DataFrame, label: str, share: str, least: float, keys: list[str], order: str, cap: int) -> DataFrame:
    """Windows whose dominant label holds at least a share of them; at most cap of each label and key, earliest first."""
    w = Window.partitionBy(*keys, label).orderBy(order)
    return rows.where((F.col(share) >= least) & F.col(label).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def train(rows: DataFrame, features: list[str], label: str, trees: int = 80, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Scaled features, class weights by inverse frequency."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    shape = sizes.agg(F.sum("_c").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weighted = rows.join(F.broadcast(sizes.crossJoin(shape)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_c")))
    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), RandomForestClassifier(featuresCol="_scaled", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(weighted)


def guard(train_subjects: DataFrame, held: DataFrame, key: str) -> None:
    """Refuses to train on a subject that is held out."""
    if train_subjects.select(key).intersect(held.select(key)).take(1):
        raise ValueError("a held-out subject is among the training subjects")


def leave_one_out(rows: DataFrame, features: list[str], label: str, subject: str, folds: int = 20, **options: int) -> DataFrame:
    """Accuracy per subject of a model that has not seen it.

    Subjects are dealt into at most `folds` groups by their order, and a group is left out at a time: with
    no more subjects than folds that is one subject each, and the number of models never follows the data.
    """
    from pulsegrain.runtime import shared_folder

    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/folds-{uuid.uuid4().hex}"
    order = Window.orderBy("_bucket")
    # subjects are numbered by a hash in bounded buckets, so that no list of them is gathered
    numbered = rows.withColumn("_bucket", F.pmod(F.xxhash64(subject), F.lit(100_000)))
    buckets = numbered.select("_bucket").distinct().withColumn("_fold", (F.row_number().over(order) - 1) % folds)
    dealt = numbered.join(F.broadcast(buckets), "_bucket").drop("_bucket")
    for k in range(min(folds, buckets.count())):
        held = F.col("_fold") == k
        scored = train(dealt.where(~held).drop("_fold"), features, label, **options).transform(dealt.where(held))
        scored.groupBy(subject).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy")).write.parquet(f"{folder}/fold={k}")
    return spark.read.parquet(folder).drop("fold")


def save(model: PipelineModel, path: str, metadata: dict) -> None:
    """A trained model with what there is to know of it, as one JSON line beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])


def probabilities(scored: DataFrame, names: list[str]) -> DataFrame:
    """Adds the probability of each class under its name."""
    p = vector_to_array("probability")
    return scored.withColumns({f"p_{n}": F.get(p, F.lit(k)) for k, n in enumerate(names)})
