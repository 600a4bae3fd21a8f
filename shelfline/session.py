"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the next step then has to shuffle again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_shipped: set[str] = set()
_to_clear: set[str] = set()


def tuned(spark: SparkSession) -> SparkSession:
    """Prepare a session that somebody else made; nothing here changes a result's rows."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        name = os.path.join(tempfile.mkdtemp(prefix="shelfline-package-"), "shelfline")
        context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(context.applicationId)


def build_session(app: str = "shelfline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and Arrow switched on.

    Cluster-wide sizes (executors, memory, shuffle partitions) are left to
    spark-submit; AQE then merges or splits shuffle partitions by their size.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a single-machine session (tests) may leave it unset; it then gets a
    temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shelfline-"))
    return context.getCheckpointDir()


def work_root(spark: SparkSession) -> str:
    """Folder of this application inside the shared folder; `clear_work` removes it."""
    context = spark.sparkContext
    root = os.path.join(shared_folder(spark), f"work-{context.applicationId}")
    if context.applicationId not in _to_clear:
        _to_clear.add(context.applicationId)
        atexit.register(_clear_at_exit, spark, context.applicationId)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return os.path.join(work_root(spark), f"{name}-{uuid.uuid4().hex}")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that `work_path` named, through the file system it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_work(spark: SparkSession) -> None:
    """Remove all work folders of this application; frames that read them are void from then on."""
    remove_path(spark, work_root(spark))


def _clear_at_exit(spark: SparkSession, application: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and context.applicationId == application:
        clear_work(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For results that several later steps read: the work is done once, lineage
    ends at the files, and a lost executor costs no recomputation.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
