"""Session helpers that every part of the library shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over more tasks than there are cores.

    A file of few row groups is read by as few tasks, whatever its size; work that
    costs much for each row must not stay in them. AQE leaves a given number alone.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per context.

    Functions of an importable module are pickled by reference, so executors
    need the source; Spark's file server carries a small archive to them.
    """
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    archive = os.path.join(folder, "corpusloom_src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    sc.addPyFile(archive)
    sc._corpusloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none (tests, local mode) a local one is made.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        base = getattr(sc, "_corpusloom_dir", None)
        if base is None:
            base = sc._corpusloom_dir = tempfile.mkdtemp(prefix="corpusloom-shared-")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage and survives lost executors. The files go when the
    application ends, or earlier by unstage().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing needs any more."""
    path = getattr(df, "_corpusloom_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
