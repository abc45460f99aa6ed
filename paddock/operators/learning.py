"""Model tables: time split, boosted trees, calibration, rank measures."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the scores in which ranks are counted, so that no task orders all rows.
PARTS = 1000


def time_split(rows: DataFrame, day: str, cut: str) -> tuple[DataFrame, DataFrame]:
    """Rows before a day to learn from, and rows from it on to test with."""
    at = F.lit(cut).cast("date")
    return rows.where(F.col(day) < at), rows.where(F.col(day) >= at)


def ranked(rows: DataFrame, score: str, row_id: str) -> DataFrame:
    """Adds the 1-based ``rank`` by score (ties by id), ``mid_rank`` (ties averaged) and ``total``.

    Counts by part of the scores come first, the parts' bounds being approximate quantiles; only
    rows of one part are ordered together. Equal scores are in one part.
    """
    known = rows.where(F.col(score).isNotNull())
    inner = sorted(set(known.approxQuantile(score, [i / PARTS for i in range(1, PARTS)], 1 / (4 * PARTS))))
    bounds = [float("-inf"), *inner, float("inf")]
    r = Bucketizer(splits=bounds, inputCol=score, outputCol="_p").transform(known) if inner else known.withColumn("_p", F.lit(0.0))
    parts = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = parts.withColumns({"_b": F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy())}).drop("_n")
    w = Window.partitionBy("_p")
    tie = Window.partitionBy("_p", score)
    r = r.withColumns({"_rn": F.row_number().over(w.orderBy(score, row_id)), "_first": F.rank().over(w.orderBy(score)), "_same": F.count(F.lit(1)).over(tie)})
    out = r.join(F.broadcast(before), "_p")
    return out.withColumns({"rank": F.col("_b") + F.col("_rn"), "mid_rank": F.col("_b") + F.col("_first") + (F.col("_same") - 1) / 2}).drop("_p", "_b", "_rn", "_first", "_same")


def auc(rows: DataFrame, score: str, label: str, row_id: str) -> DataFrame:
    """Area under the ROC curve by the sum of ranks, with the class counts."""
    r = ranked(rows, score, row_id)
    s = r.agg(F.sum(F.when(F.col(label), F.col("mid_rank"))).alias("s"), F.count(F.when(F.col(label), 1)).alias("pos"), F.count(F.when(~F.col(label), 1)).alias("neg"))
    return s.select("pos", "neg", F.round((F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / F.when(F.col("pos") * F.col("neg") > 0, F.col("pos") * F.col("neg")), 6).alias("auc"))


def calibration(rows: DataFrame, score: str, label: str, row_id: str, bins: int = 10) -> DataFrame:
    """Rows, mean score and share of hits of each tenth by score."""
    r = ranked(rows, score, row_id).withColumn("bin", (F.floor((F.col("rank") - 1) * bins / F.col("total")) + 1).cast("int"))
    return r.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(F.col(label).cast("double")), 6).alias("hit_rate"))


def fitted(train: DataFrame, features: list[str], label: str, seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees on the features; missing values are a value of their own."""
    cols = [f"{c}_" for c in features]
    ready = train.select(*(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"{c}_") for c in features), F.col(label).cast("double").alias("label")).where("label is not null")
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), GBTClassifier(maxIter=10, maxDepth=3, seed=seed)]).fit(ready)


def scored(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows with the probability ``p`` of the label."""
    ready = rows.withColumns({f"{c}_": F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features})
    return model.transform(ready).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction", *(f"{c}_" for c in features))
