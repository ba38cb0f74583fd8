"""Conflict-constrained best-fit packing of documents into training sequences.

Every bin (sequence) holds `capacity` units: words, or tokens of a given tokenizer. Longer texts are cut into pieces of at
most so many, between words or pre-tokens; a text's pieces put together are the text. No two pieces in a bin share a
source or a duplicate cluster. Packing is sequential, so pieces are dealt by hash into shards of about `shard_rows`, and each is
packed alone, best fit decreasing: open bins lie in order of what they have left and carry bitmaps of their sources and
clusters; the search starts at the first bin that is large enough and goes on to the next larger until one is compatible,
which is the tightest compatible bin. A hot source, cluster or repeated row spreads over all shards. Texts go along with
their pieces through the one exchange, so that each shard gives whole sequences.
"""

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ._text import map_columns, schema_of
from .tokens import Tokens

CAPACITY, SHARD_ROWS = 2048, 8192
PIECE = "struct<doc_id: long, piece: int, piece_start: long, length: long, text: string>"
SEQUENCE = f"bin_id long, bin_used long, pieces array<{PIECE}>"
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Words:
    """Cuts texts by words (runs of bytes other than white space); white space stays with the word before it. A word is one unit
    of any length, so that a piece has no bound in bytes."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def load(self) -> Callable[[list[bytes]], list[list[tuple[bytes, int]]]]:
        return lambda texts: [self._cut(x) for x in texts]

    def _cut(self, text: bytes) -> list[tuple[bytes, int]]:
        n = len(text.split())
        if n <= self.capacity:
            return [(text, n)]
        space = _SPACE[np.frombuffer(text, np.uint8)]
        starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        ends = [*starts[self.capacity :: self.capacity].tolist(), len(text)]
        sizes = [self.capacity] * (len(ends) - 1)
        return list(zip((text[a:b] for a, b in zip([0, *ends], ends)), [*sizes, n - sum(sizes)]))


class TokenPieces:
    """Cuts texts by a tokenizer's tokens, at starts of pre-tokens; one that is longer than a piece is cut between characters.

    A piece's length is what the tokenizer gives for the piece alone. Between pre-tokens that is its share of the whole text;
    pieces within a pre-token (of long letters and digits, or of scripts without spaces) are encoded by themselves, and end earlier if
    they would be too long. Only a single character of more tokens than the capacity is a longer piece.
    """

    def __init__(self, capacity: int, vocabulary: str, **options):
        self.capacity, self.tokens = capacity, Tokens(vocabulary, **options)

    def load(self) -> Callable[[list[bytes]], list[list[tuple[bytes, int]]]]:
        def cut(texts):
            # texts that are surely or probably longer than a piece are encoded once, with their boundaries
            long = [len(x) > 4 * self.capacity for x in texts]
            counts = iter(self.tokens.counts([x for x, far in zip(texts, long) if not far]))
            out = []
            for x, far in zip(texts, long):
                n = None if far else next(counts)
                out.append([(x, n)] if n is not None and n <= self.capacity else self._cut(x.decode()))
            return out

        return cut

    def _cut(self, text: str) -> list[tuple[bytes, int]]:
        at, before, n = self.tokens.boundaries(text)  # positions of pre-tokens, the tokens before each, and all
        at, before = [*at, len(text)], [*before, n]
        out, i = [], 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(before, before[i] + self.capacity, "right")) - 1)
            part, size = text[at[i] : at[j]], before[j] - before[i]
            while size <= self.capacity and j < len(at) - 1 and part[-2:].isspace() and len(part) > 1:
                # several spaces may be other tokens at a text's end than before a word
                size = self.tokens.counts([part.encode()])[0]
                if size <= self.capacity or j == i + 1:
                    break
                j -= 1
                part, size = text[at[i] : at[j]], before[j] - before[i]
            out += [(part.encode(), size)] if size <= self.capacity else self._between_characters(part, size)
            i = j
        return out

    def _between_characters(self, part: str, size: int) -> list[tuple[bytes, int]]:
        """`part`, of about `size` tokens, in pieces that are as long as the tokens so far let expect, and counted alone."""
        out, at, chars = [], 0, len(part) * self.capacity // size
        while at < len(part):
            width = min(max(1, chars), len(part) - at)
            while True:
                piece = part[at : at + width].encode()
                n = self.tokens.counts([piece])[0]
                if n <= self.capacity or width == 1:
                    break
                width = max(1, min(width - 1, width * self.capacity // n))
            out.append((piece, n))
            at += width
            chars = width * self.capacity // max(n, 1)
        return out


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin number of each item (length, source, cluster), which come in packing order; None never conflicts.

    Of the open bins that have room and share neither source nor cluster, an item takes the one with the least room; of
    equals, the oldest. An item as long as the capacity, or longer, gets a bin of its own.
    """
    numbers: tuple[dict, dict] = ({}, {})

    def bit(kind: int, key) -> int:
        return 0 if key is None else 1 << numbers[kind].setdefault(key, len(numbers[kind]))

    seen: dict = {}
    for _, _, cluster in items:
        seen[cluster] = seen.get(cluster, 0) + 1
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        s = bit(0, source)
        c = bit(1, cluster) if cluster is not None and seen[cluster] > 1 else 0  # a cluster's only row conflicts with none
        at = bisect_left(rooms, (length, -1))
        while at < len(rooms) and (sources[rooms[at][1]] & s or clusters[rooms[at][1]] & c):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
            sources[b] |= s
            clusters[b] |= c
        else:
            room, b = capacity, len(sources)
            sources.append(s)
            clusters.append(c)
        if room - length > 0:
            insort(rooms, (room - length, b))
        out.append(b)
    return out


def sequences(spark: SparkSession, documents: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source", cluster: str | None = None, capacity: int = CAPACITY, cutter=None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """bin_id, bin_used (units), pieces (doc_id, piece, piece_start in code points, length in units, text): a row a sequence,
    with its pieces in order.

    `cutter` cuts and measures texts; without it, `Words`. `cluster` names a column of duplicate clusters; without it, texts
    that are equal but for case are one cluster. Null, empty and blank texts have nothing to pack: a row of its own with
    null bin_id, bin_used 0 and one piece of length 0. Null sources are one source; null clusters conflict with none. Repeated rows are packed each, in different
    bins, as they share a cluster; a task that meets over 100,000 different rows deals later repeats from the first shard on again. Ties go by length, then doc_id, piece, source, cluster. An empty table gives an empty
    result. Other columns are not read, whatever their names.
    """
    rows = documents.select(
        F.col(f"`{id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("\0"))).alias("source"),
        (F.xxhash64(F.lower(F.col(f"`{text}`"))) if cluster is None else F.when(F.col(f"`{cluster}`").isNotNull(), F.xxhash64(F.col(f"`{cluster}`")))).alias("cluster"),
    )
    n, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    shards = max(1, math.ceil((n + (chars or 0) // (2 * capacity)) / shard_rows))  # a shard is a partition
    cutter = cutter or Words(capacity)
    schema = to_arrow_schema(schema_of(SEQUENCE))

    def start():
        cut, nth = cutter.load(), {}

        def step(columns):
            ids, texts, sources, clusters = columns
            out = [[] for _ in range(8)]
            for i, s, c, pieces in zip(ids, sources, clusters, cut(texts)):
                key = (i, c)
                if len(nth) > 100_000:  # later repeats start again in the first shard, so that a shard may get some of equal keys
                    nth.clear()
                nth[key] = again = nth.get(key, -1) + 1  # repeated rows of a task go to different shards
                starts = accumulate((len(x.decode()) for x, _ in pieces), initial=0)
                for k, ((part, size), first) in enumerate(zip(pieces, starts)):
                    for column, value in zip(out, (again, i, k, first, size, s, c, part.decode())):
                        column.append(value)
            return out

        return step

    pieces = map_columns(rows, start, "again int, doc_id long, piece int, piece_start long, length long, source long, cluster long, text string")
    pieces = pieces.repartition(shards, F.xxhash64("doc_id", "piece", "cluster", "again")).drop("again")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if batches and sum(x.num_rows for x in batches):
            yield from packed_shard(pa.Table.from_batches(batches), TaskContext.get().partitionId()).to_batches()

    def packed_shard(table: pa.Table, shard: int) -> pa.Table:
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "source", "cluster"))])
        length = table.column("length").to_numpy()
        some = int((length > 0).sum())  # sorted: those that have something to pack come first
        b = best_fit(list(zip(length[:some].tolist(), table.column("source").to_pylist(), table.column("cluster").to_pylist())), capacity)
        b = np.concatenate((np.array(b, np.int64), np.arange(some, len(length))))  # each of the others stands alone
        order = np.argsort(b, kind="stable")
        _, first = np.unique(b[order], return_index=True)
        used = np.add.reduceat(length[order], first) if len(order) else length
        bins = b[order][first] + (shard << 32)
        moved = table.take(pa.array(order)).combine_chunks()
        fields = schema.field("pieces").type.value_type
        items = pa.StructArray.from_arrays([_whole(moved.column(f.name)).cast(f.type) for f in fields], fields=list(fields))
        lists = pa.ListArray.from_arrays(pa.array([*first, len(order)], pa.int32()), items)
        return pa.Table.from_arrays([pa.array(bins, mask=used == 0), pa.array(used), lists.cast(schema.field("pieces").type)], schema=schema)

    return pieces.mapInArrow(pack, SEQUENCE)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def packed(spark: SparkSession, documents: DataFrame, **options) -> DataFrame:
    """bin_id, doc_id, piece, piece_start, length, bin_offset, bin_used, text: one row a piece; options, awkward cases and units
    are those of `sequences`. Rows of null bin_id, for texts without anything to pack, have bin_offset 0."""
    each = sequences(spark, documents, **options)
    before = F.transform("pieces", lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice("pieces", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("at")))
    rows = each.select("bin_id", "bin_used", F.explode(before).alias("x"))
    return rows.select("bin_id", "x.p.doc_id", "x.p.piece", "x.p.piece_start", "x.p.length", F.col("x.at").alias("bin_offset"), "bin_used", "x.p.text")
