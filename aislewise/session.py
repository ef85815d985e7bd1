"""Session defaults and the one place that decides how lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "aislewise", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.executorEnv.PYTHONPATH": _worker_path(),
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _worker_path() -> str:
    """Where Python workers find this package when it is on the driver's path only, not installed.

    On a cluster whose machines do not share that folder, install the package or name it in
    ``spark.submit.pyFiles``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return os.pathsep.join(p for p in (root, os.environ.get("PYTHONPATH", "")) if p)


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a scratch folder only for local runs."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = os.environ.get("AISLEWISE_SCRATCH") or tempfile.mkdtemp(prefix="aislewise-")
    os.environ["AISLEWISE_SCRATCH"] = path
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends the plan's lineage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts lineage and what the planner knows of earlier steps.

    For loops that rename columns: a checkpoint keeps their constraints, which multiply from round to round.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widen(scan: DataFrame) -> DataFrame:
    """Spread a plain scan stored in fewer splits than there are cores, for costly row work.

    A large table has more splits than cores and comes back unchanged, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
