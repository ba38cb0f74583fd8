"""Text files by line: ordinals of lines and records that span lines, without a task that reads a whole file.

Spark cuts a large file into splits at line ends. One pass counts each split's lines and quotes; prefix sums over the splits (a row a split)
tell how many lines lie before each, and whether it begins inside quotes. A second pass numbers the lines of each split, from
what it has of the split alone, and takes the rest from these sums. No line is shuffled, but for those of records that span lines.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import new_path

#: Splits whose sums are broadcast, some 20 MB; of more, they are exchanged.
BROADCAST_SPLITS = 100_000
_WALKED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("even", pa.int64()), ("odd", pa.int64()), ("value", pa.string())])


def _scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start (of the split), value: lines between line feeds."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _splits(scan: DataFrame) -> DataFrame:
    """file, start, lines (in all splits before), file_lines (in those of the file), quoted (1 if it begins inside quotes)."""
    spark, path = scan.sparkSession, new_path(scan.sparkSession, "splits")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    scan.groupBy("file", "start").agg(F.count("*").alias("n"), F.sum(quotes).alias("q")).write.parquet(path)
    counted = spark.read.schema("file string, start long, n long, q long").parquet(path)
    whole = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    own = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    sums = counted.select("file", "start", F.coalesce(F.sum("n").over(whole), none).alias("lines"), F.coalesce(F.sum("n").over(own), none).alias("file_lines"), (F.coalesce(F.sum("q").over(own), none) % 2).alias("quoted"))
    return F.broadcast(sums) if counted.count() <= BROADCAST_SPLITS else sums


def _walked(batches):
    """For each line of a split its place `at`; the parity of the split's quotes before and after it; and the place of the
    line where its record begins, if the split begins outside quotes (even) or inside (odd), -1 if before the split."""
    key, at, parity, last = None, 0, 0, [-1, -1]
    for batch in batches:
        files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        quotes = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        codes = files.indices.to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b == a:
                continue
            own = (files.dictionary[int(codes[a])].as_py(), int(starts[a]))
            if own != key:
                key, at, parity, last = own, 0, 0, [-1, -1]
            place = np.arange(at, at + b - a)
            after = (parity + np.cumsum(quotes[a:b])) % 2
            before = np.concatenate(([parity], after[:-1]))
            begun = [np.maximum(np.maximum.accumulate(np.where(before == k, place, -1)), last[k]) for k in (0, 1)]
            at, parity, last = at + b - a, int(after[-1]), [int(x[-1]) for x in begun]
            part = batch.slice(a, b - a)
            columns = [part.column(0), part.column(1), pa.array(place), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), *map(pa.array, begun), part.column(2)]
            yield pa.RecordBatch.from_arrays(columns, schema=_WALKED)


def _placed(spark: SparkSession, path: str | list[str], split_bytes: int | None) -> DataFrame:
    """The walked lines with their split's sums; a written table, so that both passes cut files alike."""
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split_bytes:
            spark.conf.set(name, split_bytes)
        scan = _scan(spark, path)
        rows = scan.mapInArrow(_walked, "file string, start long, at long, before int, after int, even long, odd long, value string").join(_splits(scan), ["file", "start"], "left")
        out = new_path(spark, "lines")
        rows.write.option("compression", "zstd").parquet(out)
        return spark.read.schema(rows.schema).parquet(out)
    finally:
        spark.conf.set(name, before)


def numbered_lines(spark: SparkSession, path: str | list[str], split_bytes: int | None = None) -> DataFrame:
    """row_id, value: the lines of a file, or of all files in the order of their paths, with their ordinals from 0.

    A line's value is without its end, be it a line feed or one with a carriage return; a last line without an end counts."""
    lines = _placed(spark, path, split_bytes)
    return lines.select((F.col("lines") + F.col("at")).alias("row_id"), F.regexp_replace("value", r"\r$", "").alias("value"))


def csv_records(spark: SparkSession, path: str | list[str], schema: str, header: bool = True, sep: str = ",", split_bytes: int | None = None, exact: bool = False) -> DataFrame:
    """RFC 4180 CSV whose fields may hold line breaks, read by as many tasks as its files have splits.

    A quote inside quotes is doubled, and no field without quotes holds one, so that a line break ends a record if the quotes
    before it are even in number. The lines of a record that spans several are brought together; all others stay where they are. With
    `header`, the first record of each file is its header. Empty lines between records are no records. Line breaks inside quotes are read
    as line feeds, and empty fields as null, as by `readers.csv`. `exact` is for files of `writers.csv`, whose records end in line feeds:
    carriage returns are kept, and an empty field is null without quotes and an empty string with them."""
    lines = _placed(spark, path, split_bytes)
    quoted = F.col("quoted") == 1
    begun = F.when(quoted, F.col("odd")).otherwise(F.col("even"))
    lines = lines.select("file", "start", "value", (F.col("file_lines") + F.col("at")).alias("line"), ((F.col("before") + F.col("quoted")) % 2 == 0).alias("first"), ((F.col("after") + F.col("quoted")) % 2 == 0).alias("last"), F.when(begun >= 0, F.col("file_lines") + begun).alias("record"))
    single = lines.where("first AND last").select("file", "line", "value")
    parts = lines.where("NOT (first AND last)")
    # a part without a record's begin belongs to the last one that began in the splits before
    ends = lines.groupBy("file", "start").agg(F.max("record").alias("latest"))
    open_ = F.last("latest", ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.join(ends.select("file", "start", open_.alias("open")), ["file", "start"]).withColumn("record", F.coalesce("record", "open"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    spanning = parts.groupBy("file", "record").agg((whole if exact else F.replace(whole, F.lit("\r\n"), F.lit("\n"))).alias("value")).select("file", F.col("record").alias("line"), "value")
    records = single.unionByName(spanning)
    records = (records if exact else records.withColumn("value", F.regexp_replace("value", r"\r$", ""))).where("value <> ''")
    if header:
        records = records.where("line > 0")
    parsed = lambda **more: F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"', **more})
    if not exact:
        return records.select(parsed().alias("r")).select("r.*")
    # a field that is written like nullValue is null too, but none is written like both of these; without charToEscapeQuoteEscaping, NUL is lost
    names, kept = T.StructType.fromDDL(schema).names, {"charToEscapeQuoteEscaping": '"'}
    rows = records.select("value", parsed(nullValue="null", **kept).alias("r"))
    rows = rows.select("r", F.when(F.exists(F.array(*(F.col("r")[n].isNull() for n in names)), lambda x: x), parsed(nullValue="-", **kept)).alias("s"))
    return rows.select(*(F.coalesce(F.col("r")[n], F.col("s")[n]).alias(n) for n in names))
