"""Session helpers: the shared folder for cut lineage, and a local test session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = "8m"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benches."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wristwave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers wherever the driver was started from, and bound their Arrow batches."""
    # rows hold arrays, so batches are bounded by bytes; scalars still go by 10,000 rows
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_wristwave_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-wristwave-pkg-"), "wristwave.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("wristwave", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._wristwave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one only where none is named and there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_wristwave_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="spark-wristwave-")
        spark.sparkContext._wristwave_dir = own
    return own


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/wristwave-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage, survives executor loss, and keeps column pruning and
    filter pushdown for the readers (unlike an RDD checkpoint).
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    made_tables(spark).append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made_tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that ``materialise`` has written in this application and nobody has dropped."""
    sc = spark.sparkContext
    if not hasattr(sc, "_wristwave_made"):
        sc._wristwave_made = []
    return sc._wristwave_made


def drop_tables(spark: SparkSession, paths: list[str], keep_for: DataFrame | None = None) -> None:
    """Delete stored tables through Spark's file system; those that ``keep_for`` reads stay."""
    read = {f.split(":", 1)[-1].lstrip("/") for f in keep_for.inputFiles()} if keep_for is not None else set()
    made = made_tables(spark)
    for path in paths:
        bare = path.split(":", 1)[-1].lstrip("/")
        if any(f.startswith(bare) for f in read):
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in made:
            made.remove(path)
