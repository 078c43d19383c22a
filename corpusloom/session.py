"""Session helpers: defaults for local work and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """``spark``, whose Python workers can import this package: its modules are sent with the job, once.

    Executors need not have the package installed; Spark's file server hands the archive out.
    """
    context = spark.sparkContext
    if not getattr(context, "_corpusloom_shipped", False):
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="corpusloom-package-")) / "corpusloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for module in sorted(package.rglob("*.py")):
                z.write(module, module.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._corpusloom_shipped = True
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    The files go to the folder the cluster names in ``spark.checkpoint.dir``. Without one a folder of
    this machine serves local sessions (tests, one-machine work); on a cluster other machines could
    not read it, so there it raises. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark
    deletes a checkpoint's files once nothing refers to it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))
    return df.checkpoint(eager=True)
