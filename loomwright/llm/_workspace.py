"""Written intermediate tables: they cut lineage and survive the loss of any executor."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset, on a local master."""
    if found := spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="loomwright-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


class Workspace:
    """Parquet tables of one run in the shared folder.

    `table` runs a frame once and returns what it wrote, so that a later loss of executors re-reads files instead of
    recomputing; shuffle files of that run are released at its end. `drop` frees a table that is no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, frame: DataFrame, name: str, by: str | None = None) -> DataFrame:
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            writer = frame.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.read(name, frame.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Frees all tables but these."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
        self.drop(*(n for x in found if (n := x.getPath().getName()) not in names))

    def drop(self, *names: str) -> None:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(hadoop).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The cluster's shuffle width; every fixed layout here follows it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
