"""Shared pieces of the text operators that run in Arrow batches.

Words are the maximal runs of bytes other than space and \\t \\n \\v \\f \\r; `bytes.split()` gives exactly these.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Odd 64-bit multipliers of the rolling hashes.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def spread(frame: DataFrame) -> DataFrame:
    """`frame` over all cores, if it is a scan of so few partitions that half of the cores or more would have none: files of few
    row groups, whose texts are few then too. Larger inputs, and frames that are dealt already, stay as they are."""
    execution, cores = frame._jdf.queryExecution(), frame.sparkSession.sparkContext.defaultParallelism
    if execution.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return frame
    return frame.repartition(cores) if 0 < 2 * execution.toRdd().getNumPartitions() <= cores else frame


def map_columns(frame: DataFrame, start: Callable, ddl: str, rows: int = 256) -> DataFrame:
    """mapInArrow over slices of `rows` rows. `start()` runs once a task and returns a function from a list of input
    columns (lists; strings come as UTF-8 bytes) to a list of output columns."""
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches):
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in batch.slice(at, rows).columns]
                out = step([c.to_pylist() for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return spread(frame).mapInArrow(run, schema)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n consecutive words, from the words' hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(ODD[0]) + h[i : i + len(out)]
    return mixed(out + np.uint64(n))


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys a sorted table has."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def has_columns(frame: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the operator's own names, cast; other columns never reach the operator, so that
    their names cannot clash with its own."""
    return frame.select(*(F.col(f"`{source}`").cast(kind).alias(name) for name, (source, kind) in wanted.items()))


def row_key(id: str, text: str) -> Column:
    """A 128-bit digest of doc_id and text. Rows that are equal in both have one key."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("-")), F.lit("\0"), F.coalesce(F.col(f"`{text}`"), F.lit("")))))


#: Rows of a table of keys that is broadcast: some 30 MB.
BROADCAST_ROWS = 200_000


def small(table: DataFrame) -> DataFrame:
    """A written table of short rows, marked for a broadcast if it has BROADCAST_ROWS at most; a larger one is joined by
    an exchange of both sides."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def append_column(frame: DataFrame, text: str, values: Callable, name: str, kind: str, rows: int = 256) -> DataFrame:
    """`frame` and a column that `values` makes of slices of the text column (as UTF-8 bytes); all others pass through."""
    schema = T.StructType([*frame.schema.fields, *schema_of(f"`{name}` {kind}").fields])
    at, arrow = frame.columns.index(text), to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                texts = part.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values(texts), type=arrow.field(name).type)], schema=arrow)

    return spread(frame).mapInArrow(run, schema)
