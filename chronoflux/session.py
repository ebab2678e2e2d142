"""Session helpers: a builder for tests and benches, and the lineage-cut folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "chronoflux", **conf: str) -> SparkSession:
    """Local session used by the tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session (tests) without the setting gets a fresh temporary folder; any other
    session without it is refused, because executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="chronoflux-")


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder for intermediate tables, in the shared folder."""
    return f"{shared_folder(spark)}/chronoflux-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_chronoflux_sent", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="chronoflux-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in package.rglob("*.py"):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._chronoflux_sent = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that lost executors cost no rerun."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stage_table(df: DataFrame) -> DataFrame:
    """Write a large intermediate as Parquet in the shared folder and read it back.

    Unlike a checkpoint the stage keeps columns apart: later steps read only the ones
    they use and push their filters into the scan.
    """
    path = f"{scratch_folder(df.sparkSession)}/stage"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
