"""A table by key that grows: rows lie in buckets of their keys, and an upsert rewrites only the buckets that it touches.

A store is a folder of bucket folders, each written once, and of numbered manifests that name the current folder of each bucket. An upsert reads
the touched buckets, merges the batch into them, writes them under new names, and publishes the next manifest; the file
system lets a manifest's name be made once, so that of two writers at a time the second fails and nothing is lost. Readers see one manifest's
state throughout. All access is by Spark and its file systems.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """`schema` is the rows' DDL, `keys` their key columns. The number of buckets is fixed when the store is made."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        if (found := self._manifest()) is None:
            self.buckets = buckets
            self._publish(0, {"buckets": buckets, "at": {}})
        else:
            self.buckets = found[1]["buckets"]

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _manifest(self) -> tuple[int, dict] | None:
        """The last manifest's number and content: the number of buckets, and the folder of each that has rows."""
        folder = self._at("_manifests")
        if not self._fs.exists(folder):
            return None
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(folder) if x.getPath().getName().endswith(".json"))
        if not names:
            return None
        stream = self._fs.open(self._at(f"_manifests/{names[-1]}"))
        try:
            return int(names[-1][:9]), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, content: dict) -> None:
        raw, place = json.dumps(content).encode(), self._at(f"_manifests/{number:09d}.json")
        try:
            stream = self._fs.create(place, False)  # not if it is there
        except Exception as e:
            raise RuntimeError("another write to this store came first; nothing was changed") from e
        stream.write(raw)
        stream.close()

    def bucketed(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; only their folders are scanned."""
        return self._rows(self._manifest()[1], buckets)

    def _rows(self, manifest: dict, buckets: list[int] | None) -> DataFrame:
        at = [f"{self.path}/{folder}" for b, folder in sorted(manifest["at"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets."""
        wanted = keys.select(*self.keys).distinct()
        return self.read(self._touched(wanted)).join(wanted, self.keys, "left_semi")

    def _touched(self, frame: DataFrame) -> list[int]:
        return [r["bucket"] for r in self.bucketed(frame).select("bucket").distinct().collect()]  # `buckets` rows at most

    def upsert(self, batch: DataFrame, order: str | None = None) -> int:
        """Merges a batch: its rows replace those of equal keys and others are added. Of a batch's rows of one key the one with the greatest
        `order` counts, or any. Returns the number of buckets that were rewritten."""
        number, manifest = self._manifest()
        names = [f.name for f in self.schema]
        rows = batch.select(*names, *([order] if order and order not in names else []))
        touched = self._touched(rows)
        if not touched:
            return 0
        rest = [c for c in names if c not in self.keys]
        old = self._rows(manifest, touched).select(*names, F.lit(0).alias("_new"), F.lit(None).cast(batch.schema[order].dataType if order else "int").alias("_order"))
        new = rows.select(*names, F.lit(1).alias("_new"), (F.col(order) if order else F.lit(None).cast("int")).alias("_order"))
        both = old.unionByName(new).groupBy(*self.keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(1), F.struct("_new", "_order")).alias("r"))
        merged = self.bucketed(both.select(*self.keys, *(F.col(f"r.`{c}`").alias(c) for c in rest)))
        folder = f"write-{uuid.uuid4().hex}"
        merged.repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        at = manifest["at"] | {str(b): f"{folder}/bucket={b}" for b in touched}
        self._publish(number + 1, {"buckets": self.buckets, "at": at})
        return len(touched)
