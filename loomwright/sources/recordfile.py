"""Record files: a data source of numbered records with an offset table, read at any ordinal without what lies before it.

A store is a folder of parts. A part's `.index` has the number of its records (4 bytes) and the offset of each in its `.data` (6
bytes each), big-endian; records are JSON in UTF-8. Each task writes a part of its own; the commit publishes them, in
the order of the tasks, in a manifest of part names and sizes. An append adds a manifest of all parts so far and its own, made so
that only one of several appenders at a time can; parts of a write that failed are in no manifest and never seen.

    spark.dataSource.register(RecordFile)
    frame.select(F.to_json(...).alias("value")).write.format("recordfile").option("path", ...).mode("append").save()
    spark.read.format("recordfile").option("path", ...).option("start", 10).option("stop", 20).load()

Paths are those of a file system that is mounted at the driver and the executors (`file:` or plain).
"""

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fixed values of the format: bytes of the count, of an offset, and the largest values.
COUNT, OFFSET = 4, 6
MOST, LAST = (1 << 8 * COUNT) - 1, (1 << 8 * OFFSET) - 1
SCHEMA = "row_id long, value string"
TASK_ROWS = 50_000


def _local(path: str) -> str:
    if re.match(r"(?!file:)[a-zA-Z][\w+.-]+:", path):
        raise ValueError("a record file lies on a mounted file system")
    return re.sub(r"^file:/*", "/", path)


def _manifests(folder: str) -> list[str]:
    return sorted(x for x in os.listdir(folder) if re.fullmatch(r"manifest-\d{9}\.json", x)) if os.path.isdir(folder) else []


def parts_of(path: str) -> list[tuple[str, int]]:
    """Name and number of records of each part, in order."""
    folder = _local(path)
    found = _manifests(folder)
    if not found:
        raise FileNotFoundError(f"no record file at {path}")
    with open(f"{folder}/{found[-1]}") as f:
        return [(name, n) for name, n in json.load(f)]


@dataclass
class _Range(InputPartition):
    """Records `first`, first + step, ... before `stop` of a part; the part's first one has the ordinal `base`."""

    part: str
    base: int
    first: int
    stop: int
    step: int


@dataclass
class _Written(WriterCommitMessage):
    task: int
    part: str
    n: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _local(options["path"])
        self.parts = parts_of(options["path"])
        total = sum(n for _, n in self.parts)
        self.range = range(total)[int(options.get("start", 0)) : int(options.get("stop", total)) : int(options.get("step", 1))]
        if self.range.step < 1:
            raise ValueError("step must be positive")

    def partitions(self):
        out, base, step = [], 0, self.range.step
        for name, n in self.parts:
            lo, hi = max(self.range.start, base), min(self.range.stop, base + n)
            lo += (self.range.start - lo) % step  # the first ordinal of the range in this part
            for a in range(lo, hi, TASK_ROWS * step):
                out.append(_Range(name, base, a - base, min(hi, a + TASK_ROWS * step) - base, step))
            base += n
        return out or [_Range("", 0, 0, 0, 1)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.stop:
            return
        with open(f"{self.folder}/{partition.part}.index", "rb") as index, open(f"{self.folder}/{partition.part}.data", "rb") as data:
            count = int.from_bytes(index.read(COUNT), "big")
            size = os.fstat(data.fileno()).st_size
            for a in range(partition.first, partition.stop, 1024 * partition.step):
                rows = range(a, min(partition.stop, a + 1024 * partition.step), partition.step)
                values = []
                if partition.step == 1:  # neighbours in one go
                    index.seek(COUNT + OFFSET * a)
                    at = _offsets(index.read(OFFSET * (len(rows) + 1)))
                    ends = at[1:] if len(at) > len(rows) else [*at[1:], size]
                    data.seek(at[0])
                    block = data.read(ends[-1] - at[0])
                    values = [block[x - at[0] : y - at[0]] for x, y in zip(at, ends)]
                else:
                    for i in rows:
                        index.seek(COUNT + OFFSET * i)
                        at = _offsets(index.read(2 * OFFSET))
                        data.seek(at[0])
                        values.append(data.read((at[1] if i + 1 < count else size) - at[0]))
                ids = pa.array([partition.base + i for i in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(values, pa.binary()).cast(pa.string())], names=["row_id", "value"])


def _offsets(raw: bytes) -> list[int]:
    table = np.frombuffer(raw, np.uint8).reshape(-1, OFFSET).astype(np.int64)
    return (table << (8 * np.arange(OFFSET - 1, -1, -1))).sum(axis=1).tolist()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = _local(options["path"]), overwrite
        os.makedirs(self.folder, exist_ok=True)
        self.before = _manifests(self.folder)  # what this write appends to

    def write(self, iterator) -> _Written:
        task = TaskContext.get().partitionId()
        part, offsets, at = f"part-{task:05d}-{uuid.uuid4().hex}", [], 0
        with open(f"{self.folder}/{part}.data", "wb") as data:
            for batch in iterator:
                for value in batch.column(batch.schema.get_field_index("value")).cast(pa.binary()).to_pylist():
                    if value is None:
                        raise ValueError("a record must not be null")
                    offsets.append(at)
                    data.write(value)
                    at += len(value)
        if len(offsets) > MOST or at > LAST + 1:
            raise ValueError("a part has too many records or bytes")
        table = np.array(offsets, ">u8").view(np.uint8).reshape(-1, 8)[:, 8 - OFFSET :]
        with open(f"{self.folder}/{part}.index", "wb") as index:
            index.write(len(offsets).to_bytes(COUNT, "big"))
            index.write(table.tobytes())
        return _Written(task, part, len(offsets))

    def commit(self, messages) -> None:
        old = [] if self.overwrite or not self.before else [list(x) for x in parts_of(self.folder)]
        new = [[m.part, m.n] for m in sorted((m for m in messages if m), key=lambda m: m.task) if m.n]
        number = int(self.before[-1][9:18]) + 1 if self.before else 0
        # a file beside it first, so that a manifest is whole once it has its name; the name can be given once only
        draft = f"{self.folder}/.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump(old + new, f)
        try:
            os.link(draft, f"{self.folder}/manifest-{number:09d}.json")
        except FileExistsError:
            raise RuntimeError("another write to this record file came first; nothing was added") from None
        finally:
            os.unlink(draft)

    def abort(self, messages) -> None:
        for m in messages:
            if m:
                for end in ("data", "index"):
                    if os.path.exists(f"{self.folder}/{m.part}.{end}"):
                        os.unlink(f"{self.folder}/{m.part}.{end}")


class RecordFile(DataSource):
    """Options: path, and for reading start, stop, step (ordinals, as of a Python slice)."""

    @classmethod
    def name(cls) -> str:
        return "recordfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def write_records(frame: DataFrame, path: str, order: list[Column], mode: str = "append") -> None:
    """The rows of `frame` as records, in `order`: ranges of it are dealt to tasks, a part each."""
    frame.sparkSession.dataSource.register(RecordFile)
    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select(F.to_json(F.struct(*frame.columns)).alias("value")).write.format("recordfile").option("path", path).mode(mode).save()


def read_records(spark: SparkSession, path: str, schema: str, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """row_id and the columns of `schema`: all records, or those of a slice; only these are read."""
    spark.dataSource.register(RecordFile)
    options = {k: str(v) for k, v in (("start", start), ("stop", stop), ("step", step)) if v is not None}
    rows = spark.read.format("recordfile").options(path=path, **options).load()
    return rows.select("row_id", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("row_id", "r.*")


def record(spark: SparkSession, path: str, row: int, schema: str) -> DataFrame:
    """One record by its ordinal: two reads, of its offset and of itself. None beyond the end."""
    return read_records(spark, path, schema, row, row + 1)
