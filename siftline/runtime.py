"""Session, shared-folder and materialisation helpers.

Everything that must outlive a stage is written to the folder named by
``spark.checkpoint.dir``, which all executors share, so losing an executor
never loses the only copy of an intermediate result.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siftline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; where it is unset a local session makes and sets one, a cluster raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siftline-")
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def hadoop_fs(spark: SparkSession, path: str):
    """(FileSystem, Path) of a path, through the Hadoop API, so that any shared store works."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        fs, p = hadoop_fs(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone at interpreter exit
        pass


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one operator's tables under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/siftline/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def materialise(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives executor loss."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread the rows of a source with fewer partitions than cores, such as one small file; a larger source stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors, once per context, wherever the driver was started."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_siftline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not root.endswith(".zip") and os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="siftline-"), "siftline.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("siftline", os.path.relpath(full, root)))
        sc.addPyFile(path)
    sc._siftline_shipped = True
