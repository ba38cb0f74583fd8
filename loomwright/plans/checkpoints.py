"""States of training runs as tables: saved by run and step, the latest loaded, and weights split by the prefixes of their keys."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(weights: DataFrame, path: str, run: str, step: int) -> None:
    """Writes `weights` (key and values) as one step of a run, in a folder of its own; a step that is there already is an error."""
    folder = f"{path.rstrip('/')}/run={run}/step={step}"
    weights.write.mode("errorifexists").parquet(folder)


def load(spark: SparkSession, path: str, schema: str, run: str | None = None, step: int | None = None) -> DataFrame:
    """run, step and the weights: of one step, or of the latest step of each run. Only the folders of these steps are scanned."""
    rows = spark.read.schema(f"{schema}, run string, step long").parquet(path)
    rows = rows if run is None else rows.where(F.col("run") == run)
    if step is not None:
        return rows.where(F.col("step") == step)
    last = rows.select("run", "step").distinct().groupBy("run").agg(F.max("step").alias("step"))  # from the folders' names; a row a run
    return rows.join(F.broadcast(last), ["run", "step"])


def split_by_prefix(weights: DataFrame, prefixes: list[str], rest: str, key: str = "key") -> DataFrame:
    """`weights` with `part`: the longest prefix that a key begins with, without its dot, whose key loses it; others are `rest`."""
    part, bare = F.lit(rest), F.col(key)
    for p in sorted(prefixes, key=len):
        hit = F.startswith(F.col(key), F.lit(p))
        part, bare = F.when(hit, F.lit(p.rstrip("."))).otherwise(part), F.when(hit, F.substring(F.col(key), F.lit(len(p) + 1), F.length(key))).otherwise(bare)
    return weights.withColumn("part", part).withColumn(key, bare)
