"""Session and storage helpers shared by the whole library."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "pagemill", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; production code is handed its session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make the package importable on every executor, once per application.

    The driver serves the archive to executors, those that join later included.
    """
    context = spark.sparkContext
    if getattr(context, "_pagemill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pagemill-")) / "pagemill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    context.addPyFile(str(archive))
    context._pagemill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, prefix: str) -> str:
    """A new folder's path for tables written on the way, beside the checkpoints."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/{prefix}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage in the shared folder that ``spark.checkpoint.dir`` names.

    Only where the setting is absent on a single machine (tests) a temporary folder is
    used; on a cluster the folder has to be one that all executors reach, so that a
    lost executor costs nothing, and a missing setting is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pagemill-checkpoint-"))
    return df.checkpoint(eager)


def spread(df: DataFrame, per_task: int = 4 << 20) -> DataFrame:
    """Rows over all cores before a Python stage, if the input is so small that it comes in fewer parts.

    Large inputs have enough parts by themselves and are never shuffled for this. The size
    is that of the plan's sources, known to the optimizer before anything runs.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    held = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if held < cores * per_task else df
