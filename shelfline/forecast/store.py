"""Trained models kept in a folder, so that every later query or application reads them back.

A model's place is named by everything its training depends on: the estimator's
settings, the features and their order, and a fingerprint of the series. Members are
written one by one as they finish, under another name first and then renamed, so a
reader never meets half a model and a run that was stopped goes on with the members that are missing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.base import Estimator, Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfline.forecast.boosting import BoostedModel
from shelfline.session import path_exists, remove_path, shared_folder

#: Session setting that names the folder; without it models lie in the shared folder.
FOLDER_SETTING = "spark.shelfline.models"


def series_fingerprint(series: DataFrame) -> str:
    """Rows and checksum of a series; values count to the cent, whatever order they were summed in."""
    columns = [F.round(F.col(c) * 100).cast("decimal(30,0)") if c == "y" else F.col(c) for c in sorted(series.columns)]
    rows, total = series.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return f"{rows}-{total}"


def settings_of(estimator: Estimator) -> dict[str, str]:
    return {"class": type(estimator).__name__, **{p.name: str(v) for p, v in sorted(estimator.extractParamMap().items(), key=lambda x: x[0].name)}}


class ModelStore:
    """``folder``: where models lie; a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = (folder or spark.conf.get(FOLDER_SETTING, None) or f"{shared_folder(spark)}/models").rstrip("/")

    def path(self, estimator: Estimator, features: Sequence[str], fingerprint: str) -> str:
        """The place of the model that ``estimator`` gives; the estimator's own id does not matter."""
        key = json.dumps([settings_of(estimator), list(features), fingerprint, self.spark.version])
        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def load(self, path: str) -> Model:
        if DefaultParamsReader.loadMetadata(path, self.spark)["class"] == "org.apache.spark.ml.regression.GBTRegressionModel":
            return BoostedModel.load(path)
        return DefaultParamsReader.loadParamsInstance(path, self.spark)

    def save(self, model: Model, path: str) -> None:
        """Write aside, then rename; the first of several writers wins."""
        aside = f"{path}-{uuid.uuid4().hex}"
        model.write().save(aside)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        target = hadoop(path)
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if path_exists(self.spark, path) or not files.rename(hadoop(aside), target):
            remove_path(self.spark, aside)

    def fit(self, estimators: Mapping[str, Estimator], features: Sequence[str], fingerprint: str,
            rows: Callable[[], DataFrame]) -> dict[str, Model]:
        """A model per estimator, read where it is stored, else trained on ``rows()`` side by side and stored."""
        paths = {name: self.path(e, features, fingerprint) for name, e in estimators.items()}
        missing = {name for name, path in paths.items() if not path_exists(self.spark, path)}
        training = rows() if missing else None

        def model(name: str) -> Model:
            if name not in missing:
                return self.load(paths[name])
            trained = estimators[name].fit(training)
            self.save(trained, paths[name])
            return trained

        try:
            with ThreadPoolExecutor(max_workers=max(1, len(paths))) as pool:
                jobs = [pool.submit(inheritable_thread_target(self.spark)(model), name) for name in paths]
                return {name: job.result() for name, job in zip(paths, jobs)}
        finally:
            if training is not None:
                training.unpersist()
