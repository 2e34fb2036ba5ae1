"""A walk-forward job that can be stopped and started again, and its model contract.

`ColumnEstimator` fits a regressor of `pyspark.ml` on named columns; its `ColumnModel` keeps the columns in their order,
refuses rows whose columns come in another, and has a writer and a reader of its own. `run` keeps one folder per fold:
first the model, then the scores of the test part, which Spark commits last. A fold whose scores are committed is not
fitted again, so a job that was killed goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from importlib import import_module

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import metrics

#: What a fold's scores hold.
SCORES = ("fold_id", "datetime", "instrument", "score", "label", "model_id")
INPUT, OUTPUT = "_features", "score"


def in_order(rows: DataFrame, columns: list[str]) -> None:
    """Raises unless the rows have the columns, in this order among themselves."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"columns {missing} are missing")
    found = [c for c in rows.columns if c in set(columns)]
    if found != list(columns):
        at = next(k for k, (a, b) in enumerate(zip(found, columns, strict=True)) if a != b)
        raise ValueError(f"column {at} is {found[at]} where the model has {columns[at]}")


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    in_order(rows, columns)
    return VectorAssembler(inputCols=list(columns), outputCol=INPUT).transform(rows)


class ColumnEstimator(Estimator):
    """A regressor over named columns. `fitter` takes (train, valid) with the feature vector in `_features` and the
    column `label`, and returns a fitted regressor that writes `score`; rows tell their part in `segment`."""

    def __init__(self, columns: list[str], fitter: Callable[[DataFrame, DataFrame], Model]):
        super().__init__()
        self.columns, self.fitter = list(columns), fitter

    def _fit(self, dataset: DataFrame) -> ColumnModel:
        rows = assembled(dataset, self.columns).select(INPUT, "label", "segment")
        part = lambda name: rows.where(F.col("segment") == name).drop("segment")
        return ColumnModel(self.columns, self.fitter(part("train"), part("valid")))


class ColumnModel(Model, MLWritable, MLReadable):
    def __init__(self, columns: list[str], inner: Model):
        super().__init__()
        self.columns, self.inner = list(columns), inner

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.inner.transform(assembled(dataset, self.columns)).drop(INPUT)

    def write(self) -> MLWriter:
        return ColumnWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ColumnReader()


class ColumnWriter(MLWriter):
    def __init__(self, model: ColumnModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        kind = f"{type(self.model.inner).__module__}.{type(self.model.inner).__name__}"
        spark.createDataFrame([(json.dumps({"columns": self.model.columns, "inner": kind}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")
        self.model.inner.write().overwrite().save(f"{path}/inner")


class ColumnReader(MLReader):
    def load(self, path: str) -> ColumnModel:
        contract = json.loads(SparkSession.active().read.text(f"{path}/contract").first().value)
        module, name = contract["inner"].rsplit(".", 1)
        return ColumnModel(contract["columns"], getattr(import_module(module), name).load(f"{path}/inner"))


def done(spark: SparkSession, path: str) -> bool:
    """Have the scores under a path been committed?"""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def agreed(spark: SparkSession, folder: str, spec: dict) -> None:
    """The job's terms are written at its first start; a later start with others raises."""
    text = json.dumps(spec, sort_keys=True)
    if done(spark, f"{folder}/spec"):
        if (before := spark.read.text(f"{folder}/spec").first().value) != text:
            raise ValueError(f"the folder belongs to another job: {before}")
        return
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/spec")


def run(rows: DataFrame, fold_ids: list[str], estimator: ColumnEstimator, folder: str, model_id: str) -> DataFrame:
    """Scores of every fold's test part, out of sample. `rows` is a stored table with fold_id, segment, datetime,
    instrument, label and the columns. A fold without training or test rows has no scores."""
    spark = rows.sparkSession
    agreed(spark, folder, {"columns": estimator.columns, "model_id": model_id})
    kind = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kind.get(c, 'string' if c == 'model_id' else 'double')}" for c in SCORES)
    for fold in fold_ids:
        scores = f"{folder}/{fold}/scores"
        if done(spark, scores):
            continue
        own = rows.where(F.col("fold_id") == fold)
        train, test = own.where("segment <> 'test' and label is not null"), own.where("segment = 'test'")
        if train.where("segment = 'train'").isEmpty():
            continue
        estimator.fit(train).write().overwrite().save(f"{folder}/{fold}/model")
        # Scored by the model as it was stored, so that what is published can be had again from the folder.
        stored = ColumnModel.read().load(f"{folder}/{fold}/model")
        out = stored.transform(test).withColumn("model_id", F.lit(model_id)).select(*SCORES)
        out.write.mode("overwrite").parquet(scores)
    parts = [spark.read.schema(schema).parquet(f"{folder}/{f}/scores") for f in fold_ids if done(spark, f"{folder}/{f}/scores")]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def measured(scores: DataFrame) -> DataFrame:
    """Rank IC of every fold and, as fold `all`, over all folds' dates, from stored scores."""
    return metrics.by_fold(scores)
