"""Structured Streaming forms of the incremental jobs: resume by anti-join, and the running reward baseline.

They are additions: the batch forms are `datasets.unprocessed` and `rewards.baselines`.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import KeyedStore


def resume(stream: DataFrame, out: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame]):
    """Starts a query that puts each new row, whose key `out` does not have yet, through `work` and appends the result.

    A batch that is run again finds its rows done, so that restarts do not repeat rows. Each batch reads the keys of all
    output so far; `resume_into` does not.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(out)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            batch = batch.join(spark.read.parquet(out).select(key), key, "left_anti")
        work(batch.dropDuplicates([key])).write.mode("append").parquet(out)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def resume_into(stream: DataFrame, store: KeyedStore, checkpoint: str, work: Callable[[DataFrame], DataFrame]):
    """The same into a keyed store: each batch reads the buckets of its own keys alone, however much the store holds, and
    rewrites those that get rows. A batch that is run again changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        done = store.lookup(batch).select(*store.keys)
        new = batch.join(done, store.keys, "left_anti").dropDuplicates(store.keys)
        store.upsert(work(new))

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


class _Baseline(StatefulProcessor):
    """A user's sum and count so far; each reward's baseline is the mean of the earlier ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("mean", "total double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, n = self.state.get() if self.state.exists() else (0.0, 0)
        for pdf in rows:
            pdf = pdf.sort_values(["ts", "event_id"])
            before = pdf["value"].cumsum() - pdf["value"] + total
            counts = n + pd.Series(range(len(pdf)), index=pdf.index)
            base = (before / counts.where(counts > 0)).fillna(0.0)
            total, n = total + float(pdf["value"].sum()), n + len(pdf)
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "baseline": base, "advantage": pdf["value"] - base})
        self.state.update((total, n))

    def close(self) -> None: ...


def running_baseline(events: DataFrame) -> DataFrame:
    """user_id, event_id, baseline, advantage of a stream of rewards, in the order in which batches bring them. Needs the
    RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(_Baseline(), outputStructType="user_id long, event_id long, baseline double, advantage double", outputMode="append", timeMode="none")


def windowed_rewards(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Reward sums by event type and tumbling window, with a watermark for late rows."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
