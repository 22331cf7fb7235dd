"""Session settings the library expects, and the shared scratch folder."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Deletes a query's shuffle files when it ends; its result must have been written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def apply_recommended(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def store_dir(spark: SparkSession, name: str) -> str:
    """A path under the cluster's checkpoint folder, visible to every executor, the same for equal names.

    The folder is read from ``spark.checkpoint.dir``. Only a local session without
    one gets a temporary folder; a cluster session without one is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="voltlattice-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the cluster's checkpoint folder."""
    return store_dir(spark, f"{purpose}-{uuid.uuid4().hex}")


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(matching(spark, path))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob pattern finds in the store it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return [str(f.getPath()) for f in found or []]


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors.

    For results several later steps read, which Spark would otherwise compute once per reader. What was
    shuffled for it is deleted as soon as it is written.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unbroadcast(df: DataFrame) -> DataFrame:
    """Join this table by sorting and never send it whole to every task.

    For read-back tables that may be large: Spark judges them by the size of their files, and sorted, repetitive
    rows take a hundredth of their memory there, so that millions of them would pass through the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by their keys before each becomes many: an explicit number, which Spark doesn't merge again."""
    return df.repartition(spread_tasks(df.sparkSession), *keys)


def spread_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
