"""Whole jobs: from files to files, or from a table to a table."""

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrays import top_band
from ..operators import datasets
from ..sources import readers, writers
from . import generation, settings

#: Keys of all workers' pools together, which are broadcast.
POOL_KEYS = 1_000_000

#: Field transforms by name: functions from a text column to a column.
TRANSFORMS = settings.Registry("transform")
for _name, _function in (("lower", F.lower), ("upper", F.upper), ("tokens", text.tokens), ("words", text.words), ("strip", text.pystrip), ("lines", text.stripped_lines)):
    TRANSFORMS.add(_name)(_function)


def with_transforms(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    """`frame` with registered transforms put on fields: field -> name; an unknown name or field is an error."""
    return datasets.transformed(frame, {c: TRANSFORMS[n] for c, n in names.items()})


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def to_store(spark: SparkSession, source: str, target: str, schema: str, order: list[str]) -> DataFrame:
    """JSON lines into a record store, numbered in `order`; a malformed line stops the job before anything is written."""
    writers.records(readers.jsonl(spark, source, schema), target, order=[F.col(c) for c in order])
    return readers.records(spark, target)


def pretokenized(spark: SparkSession, store: str, tokenize: Callable[[Column], Column], fields: list[str]) -> DataFrame:
    """A record store with `pretokenized` (a struct of each field's token ids), written once beside it and read from then on."""
    target = f"{store.rstrip('/')}-pretokenized"
    if not exists(spark, f"{target}/_SUCCESS"):
        rows = readers.records(spark, store)
        ids = F.struct(*(tokenize(F.col(c)).alias(c) for c in fields)).alias("pretokenized")
        rows.select("*", ids).write.mode("overwrite").parquet(target)
    return readers.records(spark, target)


def inference(rows: DataFrame, model: generation.Generator, target: str, id: str, source: str, reference: str) -> DataFrame:
    """Generates a hypothesis of each row and writes Input, Reference, Hypothesis as CSV with a header."""
    made = generation.generated(rows, model, id=id, source=source).select(F.col("id").alias(id), F.col("output").alias("Hypothesis"))
    out = rows.select(id, F.col(source).alias("Input"), F.col(reference).alias("Reference")).join(made, id)
    writers.csv(out.select("Input", "Reference", "Hypothesis"), target)
    return readers.csv(rows.sparkSession, target, schema="Input string, Reference string, Hypothesis string")


def band_picks(frame: DataFrame, scores: str, row_id: str, first: int, last: int, plain: int, seed: int) -> DataFrame:
    """`frame` with `token`: of the scores' ranks `first` to `last` one by the md5 of seed and row; every (plain + 1)-th row
    takes the best one."""
    band = top_band(F.col(scores), first, last)
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))), 1, 8), 16, 10).cast("long")
    picked = F.get(band, (number % F.size(band)).cast("int"))
    best = F.get(top_band(F.col(scores), 1, 1), 0)
    return frame.withColumn("token", F.when((F.col(row_id) + 1) % (plain + 1) == 0, best).otherwise(picked))


def batch_lengths(batches: DataFrame, batch: str, longest: int, lower: int, seed: int) -> DataFrame:
    """`batches` with `max_length`: each batch's random output length, as `settings.random_length` gives it."""
    low, high = settings.length_range(longest, lower)
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(batch).cast("string"))), 1, 8), 16, 10).cast("long")
    return batches.withColumn("max_length", (F.lit(low) + number % (high - low + 1)).cast("int"))


def assigned(requests: DataFrame, keys: DataFrame, workers: int, number: str, key: str, seed: int) -> DataFrame:
    """`requests` (numbered from 0) with `worker` and `key`: workers take turns, and each hands its keys round in an order of its
    own, by md5 of seed, worker and key. Keys are names; secrets stay out of tables."""
    own = keys.select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(workers - 1).cast("long"))).alias("worker"))
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("worker").cast("string"), "_key"))
    pools = own.groupBy("worker").agg(F.array_sort(F.collect_list(F.struct(mixed.alias("m"), "_key"))).alias("pool"))
    if keys.count() * workers > POOL_KEYS:
        raise ValueError(f"{workers} workers share a pool of {POOL_KEYS // workers} keys at most")
    dealt = requests.withColumn("worker", F.col(number) % workers)
    turn = (F.floor(F.col(number) / workers) % F.size("pool")).cast("int")
    return dealt.join(F.broadcast(pools), "worker").withColumn("key", F.get("pool", turn)["_key"]).drop("pool")


def latest_states(states: DataFrame, run: str, step: str) -> DataFrame:
    """The last state of each run, from a log of states."""
    rest = [c for c in states.columns if c not in (run, step)]
    last = F.max_by(F.struct(*rest), step).alias("last")
    return states.groupBy(run).agg(F.max(step).alias(step), last).select(run, step, *(F.col(f"last.{c}").alias(c) for c in rest))


def main(arguments: list[str] | None = None) -> None:
    """The command line: `to-store SOURCE TARGET --schema DDL --order COLUMN...` and `split STORE TARGET --eval-rows N`."""
    parser = argparse.ArgumentParser(prog="loomwright", description=main.__doc__)
    parser.add_argument("--log-level", default="WARNING", type=str.upper, choices=sorted(settings.LEVELS))
    commands = parser.add_subparsers(dest="command", required=True)
    store = commands.add_parser("to-store")
    store.add_argument("source")
    store.add_argument("target")
    store.add_argument("--schema", required=True)
    store.add_argument("--order", nargs="+", required=True)
    split = commands.add_parser("split")
    split.add_argument("store")
    split.add_argument("target")
    split.add_argument("--eval-rows", type=int, default=0)
    split.add_argument("--ratio", type=float, default=0.9)
    split.add_argument("--seed", type=int, default=0)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("loomwright").getOrCreate()
    spark.sparkContext.setLogLevel({"CRITICAL": "FATAL", "WARNING": "WARN", "NOTSET": "ALL"}.get(given.log_level, given.log_level))
    if given.command == "to-store":
        rows = to_store(spark, given.source, given.target, given.schema, given.order).count()
        print(json.dumps({"rows": rows}))
    else:
        datasets.split(readers.records(spark, given.store), given.eval_rows, given.ratio, given.seed).write.partitionBy("split").parquet(given.target)


if __name__ == "__main__":
    main(sys.argv[1:])
