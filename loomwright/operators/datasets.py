"""Datasets with an explicit ordinal (`row_id`): lookups, slices, samples, splits, batches and retention.

Global numbering goes through `numbered`, which counts by range, so that no window holds all rows in one task.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import new_path


def lookup(frame: DataFrame, row: int, row_id: str = "row_id", transform=None) -> DataFrame:
    """The row of an ordinal; `transform` (name -> function from Column to Column) is put on its fields."""
    return transformed(frame.where(F.col(row_id) == row), transform or {})


def transformed(frame: DataFrame, by: dict) -> DataFrame:
    """`frame` with functions put on fields: name -> function from Column to Column; other columns stay, in place."""
    if missing := by.keys() - set(frame.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    return frame.select(*(by[c](F.col(f"`{c}`")).alias(c) if c in by else F.col(f"`{c}`") for c in frame.columns))


def sliced(frame: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, row_id: str = "row_id") -> DataFrame:
    """Rows start, start + step, ... before stop, by ordinal; missing bounds are open."""
    if step < 1:
        raise ValueError("step must be positive")
    first, keep = start or 0, F.lit(True)
    keep = keep & (F.col(row_id) >= first)
    if stop is not None:
        keep = keep & (F.col(row_id) < stop)
    return frame.where(keep & ((F.col(row_id) - first) % step == 0))


def hash_order(seed: int, row_id: str = "row_id") -> Column:
    """A seeded random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def numbered(frame: DataFrame, order: list[Column], name: str = "_n") -> DataFrame:
    """`frame` with a number from 1 over all rows in ascending `order` (nulls first); rows that tie on all of it are numbered
    in any order.

    Rows are dealt by range, sorted and written, one file a range. A row's number is its place in its file behind the
    sizes of the files before it (a row a file, broadcast). No window sees all rows, and the plan has the same size however
    many ranges there are. Ties on the first keys spread over ranges by the later ones.
    """
    spark, path = frame.sparkSession, new_path(frame.sparkSession, "numbered")
    frame.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).parquet(path)
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    rows = spark.read.schema(frame.schema).parquet(path).select("*", file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_file", before.alias("_before"))  # a row a file
    out = rows.join(F.broadcast(offsets), "_file")
    return out.select(*frame.columns, (F.col("_before") + F.col("_row") + 1).alias(name))


def prefix_sums(frame: DataFrame, order: list[Column], value: str, name: str, number: str | None = None) -> DataFrame:
    """`frame` with the sum of `value` over all rows before, in ascending `order`, and the row's `number` from 1 if asked for. As in `numbered`, ranges are written a file
    each; sums run within a file, behind the sums of the files before it, so that no window sees all rows."""
    rows = numbered(frame, order, "_n")
    spark, path = frame.sparkSession, new_path(frame.sparkSession, "sums")
    rows.withColumn("_range", F.floor((F.col("_n") - 1) / RANGE_ROWS)).write.parquet(path)
    rows = spark.read.schema(rows.withColumn("_range", F.lit(0).cast("long")).schema).parquet(path)
    ranges = rows.groupBy("_range").agg(F.sum(value).alias("_sum"))  # a row a range
    none = F.lit(0).cast(ranges.schema["_sum"].dataType)
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), none)
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), none)
    out = rows.withColumn("_own", own).join(ranges.select("_range", before.alias("_before")), "_range")
    return out.select(*frame.columns, (F.col("_before") + F.col("_own")).alias(name), *([F.col("_n").alias(number)] if number else []))


#: Rows whose sums one task runs over.
RANGE_ROWS = 100_000
#: Positions of a bin when ranges are joined.
BIN = 64


def regrouped(values: DataFrame, groups: DataFrame, pos: str = "pos", order: list[Column] | None = None, size: str = "size") -> DataFrame:
    """`values` (numbered from 0 by `pos`) with the columns of the group that each falls into: groups stand in `order` and have `size`
    values each. Values beyond all groups are left out; a size of 0 or null has none; a negative size is an error.

    The groups' boundaries are prefix sums of their sizes. A group is joined in each bin of positions that it overlaps, so that
    values meet the groups of their bin by an equality, BIN of either at most."""
    sizes = F.coalesce(F.when(F.assert_true(F.coalesce(F.col(size), F.lit(0)) >= 0, F.lit("a group has a negative size")).isNull(), F.col(size)).cast("long"), F.lit(0).cast("long"))
    bounds = prefix_sums(groups.withColumn("_size", sizes), order, "_size", "_first").withColumn("_stop", F.col("_first") + F.col("_size")).where("_size > 0")
    bins = bounds.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_first") / BIN), F.floor((F.col("_stop") - 1) / BIN))))
    met = values.withColumn("_bin", F.floor(F.col(pos) / BIN)).join(bins, "_bin")
    return met.where((F.col(pos) >= F.col("_first")) & (F.col(pos) < F.col("_stop"))).drop("_bin", "_size", "_first", "_stop")


#: Rounds of the permutation, and steps after which it has come back into range but for a chance of one in 10^18.
ROUNDS, STEPS = 4, 24


def permuted(row_id: Column, rows: int, seed: int) -> Column:
    """The place of an ordinal in a seeded permutation of 0 to rows - 1, by arithmetic on the ordinal alone.

    A Feistel network over a rectangle of a x b places, a = ceil(sqrt(rows)) and b = ceil(rows / a): its rounds add a mixed value of one
    coordinate to the other, which can be undone, so that no two ordinals share a place. The places beyond `rows`, fewer than a, are put
    through again until they fall below. Any engine with 64-bit integers repeats it."""
    a = max(math.isqrt(max(rows, 1) - 1) + 1, 1)
    b = max(-(-rows // a), 1)
    div = lambda x, y: F.call_function("div", x, F.lit(y))  # noqa: E731  of integers
    mixed = lambda x, r: div((x * 40503 + (seed * 7919 + r * 104729) % 1000003) * 12289, 128)

    def once(x):
        left, right = div(x, b), x % b
        for r in range(ROUNDS):
            if r % 2:
                right = (right + mixed(left, r)) % b
            else:
                left = (left + mixed(right, r)) % a
        return left * b + right

    first = once(row_id.cast("long"))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, lambda x, _: F.when(x < rows, x).otherwise(once(x)))
    place = F.when(first < rows, first).otherwise(again)
    return F.when(F.assert_true(place < rows, F.lit("the permutation needs more steps")).isNull(), place)


def by_index(frame: DataFrame, indexes: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The rows that a list of ordinals names, in the list's order (`pos`), as often as it names them."""
    return indexes.select("pos", F.col("idx").alias(row_id)).join(frame, row_id)


def sampled(frame: DataFrame, k: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """A seeded sample of k rows: a top-k by hash, without a full sort."""
    return frame.orderBy(hash_order(seed, row_id), row_id).limit(k)


def split_sizes(rows: int, eval_rows: int = 0, ratio: float = 0.9) -> int:
    """How many rows train. A given number of evaluation rows wins over the ratio and is clamped to the rows there are;
    by ratio at least one row trains. No rows is an error."""
    if rows <= 0:
        raise ValueError("the dataset is empty")
    return max(rows - eval_rows, 0) if eval_rows > 0 else max(int(ratio * rows), 1)


def split(frame: DataFrame, eval_rows: int = 0, ratio: float = 0.9, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """`frame` with `split`: 'train' or 'eval', in exact numbers, in seeded random order."""
    train = split_sizes(frame.count(), eval_rows, ratio)
    rows = numbered(frame, [hash_order(seed, row_id), F.col(row_id)])
    return rows.withColumn("split", F.when(F.col("_n") <= train, "train").otherwise("eval")).drop("_n")


def batches(frame: DataFrame, size: int, order: list[Column], drop_last: bool = False) -> DataFrame:
    """`frame` with `batch` (from 0): consecutive chunks of `size` rows; the last may be short, or is dropped."""
    rows = numbered(frame, order)
    out = rows.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long"))
    if drop_last:
        out = out.where(F.col("_n") <= frame.count() // size * size)
    return out.drop("_n")


def epoch(frame: DataFrame, seed: int, number: int, size: int, row_id: str = "row_id") -> DataFrame:
    """An epoch's batches: a fresh seeded permutation, the short last batch dropped."""
    return batches(frame, size, [hash_order(seed + number, row_id), F.col(row_id)], drop_last=True)


def permuted_epoch(frame: DataFrame, rows: int, seed: int, number: int, size: int, row_id: str = "row_id", skip: int = 0) -> DataFrame:
    """An epoch's batches over ordinals from 0 to rows - 1: `batch` and `place` (in the epoch), the short last batch dropped and `skip`
    batches left out, as they were done. A projection and a filter: nothing is sorted, shuffled or written."""
    place = permuted(F.col(row_id), rows, seed + number)
    out = frame.withColumn("place", place).where((F.col("place") >= skip * size) & (F.col("place") < rows // size * size))
    return out.withColumn("batch", F.floor(F.col("place") / size))


def first_of_each(frame: DataFrame, key: str, order: str) -> DataFrame:
    """Ordered de-duplication: of equal keys the first row."""
    cols = [c for c in frame.columns if c != key]
    first = F.min(F.struct(order, *[c for c in cols if c != order])).alias("_first")
    return frame.groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in cols])


def retained(checkpoints: DataFrame, keep: int, by: list[str]) -> DataFrame:
    """`checkpoints` (name, mtime, is_best, is_current, and the run's columns `by`) with `kept`: of each run the best, then
    the current, then others by time, newest first; the first `keep` stay, and 0 keeps all."""
    order = Window.partitionBy(*by).orderBy(F.desc("is_best"), F.desc("is_current"), F.desc("mtime"), "name")
    return checkpoints.withColumn("kept", (F.row_number().over(order) <= keep) | F.lit(keep == 0))


def unprocessed(frame: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys `done` does not have: what a restart still has to do."""
    return frame.join(done.select(*keys).distinct(), keys, "left_anti")
