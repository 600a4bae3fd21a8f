"""An ensemble of regression models over all series, and its recursive multi-step forecast."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.base import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.config import LagAgg, SeriesConfig, TreeParams
from shelfline.forecast.boosting import BoostedTrees
from shelfline.forecast.calendar import DateFeature
from shelfline.forecast.features import feature_names, known_features, known_names, lag_names, reach
from shelfline.forecast.store import ModelStore, series_fingerprint
from shelfline.forecast.trees import TreeArrays, tree_arrays
from shelfline.session import remove_path, shared_folder, stored, work_path

#: Training rows in one partition. A boosting round is some ten short jobs, so few rows mean few tasks.
ROWS_PER_PARTITION = 100_000
#: Boosting rounds between two writes that cut the lineage.
ROUNDS_PER_CHECKPOINT = 25
#: A state has one reader, which starts when it is whole.
NO_MARK = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def build_estimators(params: Mapping[str, TreeParams]) -> dict[str, Estimator]:
    """Spark's boosted trees for the given settings (leaf counts and penalties have no counterpart)."""
    return {name: BoostedTrees(
        featuresCol="features", labelCol="y", maxIter=p.max_iter, stepSize=p.step_size, maxDepth=p.max_depth,
        minInstancesPerNode=p.min_instances, subsamplingRate=p.subsampling, checkpointInterval=ROUNDS_PER_CHECKPOINT,
        featureSubsetStrategy=str(p.feature_share), seed=p.seed, maxMemoryInMB=512)
        for name, p in params.items()}


@dataclass(frozen=True)
class Ensemble:
    models: dict[str, Model]

    @property
    def names(self) -> list[str]:
        return list(self.models)

    @cached_property
    def trees(self) -> dict[str, TreeArrays]:
        """Node tables of the members, for the attribution; boosted trees only."""
        return {n: tree_arrays(m) for n, m in self.models.items()}


def assemble(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature vector; an unknown value (a lag before the first day) is NaN in it."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(matrix)


def fit_ensemble(matrix: DataFrame, cfg: SeriesConfig, estimators: Mapping[str, Estimator],
                 features: Mapping[str, DateFeature] | None = None, store: ModelStore | None = None,
                 fingerprint: str | None = None) -> Ensemble:
    """One global model per estimator, trained on all series together.

    Any estimator that learns ``y`` from ``features`` and adds ``prediction`` will do. The
    estimators share the assembled rows and train side by side, as the tuning
    tools of Spark ML do. Models are kept in ``store`` and read from it where they
    are there already; ``fingerprint`` names the series behind the matrix (the matrix' own by default).
    ``features`` are the date features that the matrix was made with.
    """
    spark = matrix.sparkSession
    shared_folder(spark)  # boosting cuts its lineage in the checkpoint folder
    names = feature_names(cfg, features)

    def rows() -> DataFrame:
        known = assemble(matrix.na.drop(subset=["y"]), names).select("features", "y").persist(StorageLevel.MEMORY_AND_DISK)
        count = known.count()
        parts = max(1, -(-count // ROWS_PER_PARTITION))
        if parts >= known.rdd.getNumPartitions():
            return known
        few = known.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
        few.count()
        known.unpersist()
        return few

    store = store or ModelStore(spark)
    return Ensemble(store.fit(estimators, names, fingerprint or series_fingerprint(matrix.select("unique_id", "ds", "y")), rows))


def step_size(cfg: SeriesConfig) -> int:
    """Days that can be predicted at once: nothing looks back less than this."""
    return min([*cfg.lags, *[r.lag for r in cfg.rolling]])


def memory(cfg: SeriesConfig) -> int:
    """Past days a feature can reach."""
    return reach(cfg)


def _number(value: Column) -> Column:
    """As a feature: unknown is NaN."""
    return F.coalesce(value.cast("double"), F.lit(float("nan")))


def _lag_features(past: str, cfg: SeriesConfig) -> list[Column]:
    """Lag and rolling features of the day ``_at`` days behind the end of the array ``past``."""
    end = F.size(past) + F.col("_at")

    def rolled(spec: LagAgg) -> Column:
        start = end - (spec.lag + spec.window - 1)
        first = F.greatest(start, F.lit(0))
        held = F.slice(past, first + 1, F.greatest(start + spec.window - first, F.lit(0)))
        if spec.fn == "mean":
            total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
            return F.when(F.size(held) > 0, total / F.size(held)).alias(spec.name)
        return {"max": F.array_max, "min": F.array_min}[spec.fn](held).alias(spec.name)

    return [F.get(past, end - n).alias(f"lag{n}") for n in cfg.lags] + [rolled(spec) for spec in cfg.rolling]


def recursive_forecast(ensemble: Ensemble, history: DataFrame, future: DataFrame, cfg: SeriesConfig,
                       step: int | None = None, features: Mapping[str, DateFeature] | None = None) -> DataFrame:
    """Predict every scenario and day of ``future``; each model feeds on its own predictions.

    The members know nothing of each other, so they go side by side; each of them goes
    block by block of ``step`` days, for all series and scenarios together: its state
    is one row per (scenario, series) with the last year of values and what it
    has predicted so far. A block gathers its days and the state by line, builds the lags from the
    array, lets the model transform the rows, and writes the longer state to the
    shared folder, all in one shuffle; the state before it is then removed. So work spreads over series and
    scenarios, a row never exceeds a year plus the horizon, lineage is one block long, and a lost executor costs one block at most.
    A block is a view over the member's folder, read again as it stands for every block: `transform` sends
    the whole model to the executors each time it is called, so it is called once a member.
    ``future`` carries the features that need no past value.
    """
    step = step or step_size(cfg)
    if step > step_size(cfg):
        raise ValueError(f"at most {step_size(cfg)} days can be predicted at once")
    spark, line = future.sparkSession, ["scenario", "unique_id"]
    recent = history.select("unique_id", "ds", "y").where(F.col("y").isNotNull())
    newest = recent.groupBy("unique_id").agg(F.max("ds").alias("_last"))
    recent = (recent.join(newest, "unique_id").where(F.col("ds") > F.date_sub("_last", memory(cfg)))
              .groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("_held"))
              .select("unique_id", F.col("_held.y").alias("_past")))

    # The known features travel as one array. Days are sorted by block, so a block skips the row groups of the others.
    # A block's name is a string: a number would be part of the generated code, which is compiled once this way.
    place = F.row_number().over(Window.partitionBy(*line).orderBy("ds")) - 1
    fixed = F.array(*[_number(F.col(c)) for c in known_names(cfg, features)]).alias("_fixed")
    ahead_path = work_path(spark, "ahead")
    ahead = future.select(*line, "ds", fixed, place.alias("_place"))
    (ahead.select("*", F.expr(f"_place % {step}").alias("_at"), F.expr(f"_place div {step}").cast("string").alias("_block"))
     .orderBy("_block", *line).write.parquet(ahead_path))
    ahead = spark.read.parquet(ahead_path)

    start = stored(ahead.select(*line).distinct().join(recent, "unique_id").select(*line, F.size("_past").alias("_known"), "_past"),
                   "state")
    state_schema = start.withColumn("_block", F.lit("0")).schema
    last = ahead.agg(F.max("_place")).first()[0]
    blocks = 0 if last is None else last // step + 1
    # Every column is a call to the JVM, so what all members share is built once.
    vector = array_to_vector(F.concat(F.array(*map(_number, _lag_features("_past", cfg))), "_fixed")).alias("_features")
    found = [F.sort_array(F.collect_list(F.struct("_at", "_made"))).alias("_made"), F.first("_known").alias("_known"),
             F.first("_past").alias("_past")]
    longer = F.concat("_past", "_made._made").alias("_past")

    def predicted(name: str) -> DataFrame:
        """The member's last state: what it was given and all that it predicts."""
        if not blocks:
            return start
        model, path, view = ensemble.models[name], work_path(spark, "states"), f"shelfline_block_{uuid.uuid4().hex}"
        start.write.parquet(f"{path}/_block=0")
        days = ahead.select(*line, "_block", F.struct("_at", "_fixed").alias("_day"))
        # Gathered and not joined: the prediction is grouped by the same keys, so it needs no second shuffle.
        rows = days.unionByName(spark.read.schema(state_schema).parquet(path), allowMissingColumns=True).groupBy(*line, "_block").agg(
            F.first("_known", True).alias("_known"), F.first("_past", True).alias("_past"), F.collect_list("_day").alias("_days"))
        rows = rows.where(F.col("_past").isNotNull()).select(*line, "_block", "_known", "_past", F.explode("_days").alias("_day"))
        rows = rows.select(*line, "_block", "_day._at", "_known", "_past", "_day._fixed").select(*line, "_block", "_at", "_known", "_past", vector)
        rows = model.transform(rows, {model.getParam("featuresCol"): "_features", model.getParam("predictionCol"): "_made"})
        rows.groupBy(*line, "_block").agg(*found).select(*line, "_block", "_known", longer).createTempView(view)
        try:
            for block in range(blocks):
                if block:
                    spark.catalog.refreshTable(view)  # lists the folder anew
                spark.table(view).where(F.col("_block") == str(block)).drop("_block").write.options(**NO_MARK).parquet(f"{path}/_block={block + 1}")
                remove_path(spark, f"{path}/_block={block}")
        finally:
            spark.catalog.dropTempView(view)
        return spark.read.schema(start.schema).parquet(f"{path}/_block={blocks}")

    done = ahead.select(*line, "ds", "_place")
    with ThreadPoolExecutor(max_workers=max(1, len(ensemble.names))) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(predicted), name) for name in ensemble.names]
        for name, job in zip(ensemble.names, jobs):
            value = F.get("_past", F.col("_known") + F.col("_place")).alias(name)
            done = done.join(job.result(), line).select(*done.columns, value)
    return done.drop("_place")


def future_features(future: DataFrame, profile: DataFrame, cfg: SeriesConfig,
                    features: Mapping[str, DateFeature] | None = None) -> DataFrame:
    """The days ahead with every feature known in advance; order matches ``feature_names``."""
    assert feature_names(cfg, features) == [*lag_names(cfg), *known_names(cfg, features)]
    return known_features(future, profile, cfg, features)
