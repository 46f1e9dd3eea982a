"""Spark session settings and durable lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on.  They are also applied to a session that somebody else built.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a batch of long texts ends by its bytes
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def get_spark(master: str = "local[*]", name: str = "partmill", **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` adds or overrides (dots written as ``__``)."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**RUNTIME, "spark.ui.enabled": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true", **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Applies :data:`RUNTIME` to an existing session (a no-op for settings that already agree)."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each Spark context (an archive of source files)."""
    context = spark.sparkContext
    if getattr(context, "_partmill_shipped", False):
        return
    here = Path(__file__).resolve().parent
    # Spark's file server reads the archive when an executor asks for it, so it stays until the driver ends
    folder = Path(tempfile.mkdtemp(prefix="partmill-package-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(here, folder / "tree" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / "partmill_package"), "zip", folder / "tree"))
    context._partmill_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the shared folder named by ``spark.checkpoint.dir``; sets a local one only where none is set and all executors
    are in this process (tests).  On a cluster without a shared folder it is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="partmill-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Materialises ``df`` once in the shared checkpoint folder: lineage is cut and a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
