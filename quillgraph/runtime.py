"""Session, table and intermediate-result helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", memory: str = "12g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillgraph")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set.

    Only a local master, where driver and executors are one process on one machine, falls back to a
    temporary folder; on a cluster a missing setting is an error rather than a machine-local path.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="quillgraph-")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work in Python that one small file, or a small
    shuffle's result, would leave to one task. Large inputs stay as they are. Nothing is run to find out: a plan
    without shuffles tells its partitions, and for one with shuffles the size of what it reads decides."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(x in plan.toString() for x in ("Join", "Aggregate", "Window", "Sort", "Repartition", "Limit")):
        least = cores * int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")))
        leaves = plan.collectLeaves()
        size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
        return df if size >= least else df.repartition(cores)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Scratch:
    """Intermediate tables in the shared folder: lineage is cut, and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.seq = 0

    def keep(self, df: DataFrame, partition: str | None = None) -> DataFrame:
        """Write df, partitioned by a column if given, and read it back."""
        self.seq += 1
        path = f"{self.root}/{self.seq}"
        (df.write.partitionBy(partition) if partition else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quill_path = path  # noqa: SLF001 - a tag for drop()
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        path = getattr(df, "_quill_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cpu_count(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
