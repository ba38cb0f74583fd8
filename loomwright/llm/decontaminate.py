"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as sequences of words: lower case, ASCII punctuation and white space between. An item of n
words may differ from a passage by k = floor(rate * n) inserted, deleted or replaced words. Cut into k + 1 pieces, one
must occur unchanged in any such passage. Pieces are found by rolling hashes in one pass over each whole text; around each
hit, Myers' bit-parallel algorithm verifies the item's least distance to any passage. That holds for items of any length;
below 1 / rate words, the only piece is the item itself. Whoever has items of a word or two should leave them out of the
benchmark, as clean text holds them too.

Items are taken in blocks of `block` items and BLOCK_CHARS characters. One block at a time is broadcast, and freed before the
next: memory does not grow with the benchmark, only the number of passes does.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import append_column, gram_hashes, has_columns, map_columns, row_key, unused, word_hashes
from ._workspace import Workspace

RATE, BLOCK, BLOCK_CHARS = 0.2, 20_000, 20_000_000
HITS = "array<struct<item_id: long, distance: int, end_word: long>>"
#: ASCII letters go to lower case, digits and the bytes of other letters stay, all else separates words.
_WORDS = bytes(x if chr(x).isalnum() and x < 128 or x > 127 else 0x20 for x in range(256))
_SLICE = 100_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").decode().lower().encode().translate(_WORDS).split()


def myers(pattern: list[int], passage: list[int]) -> tuple[int, int]:
    """The least edit distance of the pattern to any run of the passage, and where (after how many symbols) such a run ends first."""
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for i, x in enumerate(pattern):
        masks[x] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best = (m, 0)
    for j, x in enumerate(passage, 1):
        eq = masks.get(x, 0)
        cross = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(across | up))
        minus = up & across
        distance += bool(plus & top) - bool(minus & top)
        plus = (plus << 1) & full  # row zero stays zero: a match may start anywhere
        minus = (minus << 1) & full
        up = minus | (full & ~(cross | plus))
        down = plus & cross
        if distance < best[0]:
            best = (distance, j)
    return best


class Pieces:
    """A block of items, cut into pieces and hashed."""

    def __init__(self, items: list[tuple[int, bytes | None]], rate: float):
        self.items: list[tuple[int, list[int], int]] = []  # id, words' hashes, budget
        by: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            h = word_hashes(words_of(text))
            if not len(h):
                continue
            k = int(rate * len(h))
            at = len(self.items)
            self.items.append((item, h.tolist(), k))
            cuts = [len(h) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                by[b - a][int(gram_hashes(h[a:b], b - a)[0])].append((at, a))
        self.by = {n: (np.array(sorted(d), np.uint64), dict(d)) for n, d in by.items()}

    def found(self, words: list[bytes]) -> dict[int, tuple[int, int]]:
        """Item id -> (least distance, word at which that passage first ends), of all items within their budget."""
        out: dict[int, tuple[int, int]] = {}
        h = word_hashes(words)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)  # where each item may lie, from its pieces' hits
        for n, (keys, where) in self.by.items():
            for start in range(0, max(0, len(h) - n + 1), _SLICE):
                grams = gram_hashes(h[start : start + _SLICE + n - 1], n)
                place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                for i in np.flatnonzero(keys[place] == grams).tolist():
                    for at, offset in where[int(grams[i])]:
                        _, pattern, k = self.items[at]
                        first = start + i - offset
                        spans[at].append((max(0, first - k), first + len(pattern) + k))
        for at, own in spans.items():
            item, pattern, k = self.items[at]
            for a, b in _merged(own):  # overlapping spans are read once, so repetitive texts cost no more than others
                distance, end = myers(pattern, h[a:b].tolist())
                if distance <= k and (item not in out or (distance, a + end) < out[item]):
                    out[item] = (distance, a + end)
        return out


def _merged(spans: list[tuple[int, int]]):
    spans.sort()
    a, b = spans[0]
    for x, y in spans[1:]:
        if x > b:
            yield a, b
            a, b = x, y
        b = max(b, y)
    yield a, b


def blocks(benchmark: DataFrame, item: str, text: str, block: int) -> Iterator[list[tuple[int, bytes | None]]]:
    """The benchmark's rows in blocks of so many items, and of BLOCK_CHARS characters or one item. One block is on the driver
    at a time; no item at all makes one empty block."""
    part, size, none = [], 0, True
    for i, t in benchmark.select(F.col(f"`{item}`").cast("long"), F.col(f"`{text}`").cast("string")).toLocalIterator():
        if part and (len(part) == block or size + len(t or "") > BLOCK_CHARS):
            yield part
            part, size = [], 0
        part.append((i, None if t is None else t.encode()))
        size, none = size + len(t or ""), False
    if part or none:
        yield part


def _last_apart(parts: Iterator) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the last."""
    before = next(parts)
    for part in parts:
        yield before, False
        before = part
    yield before, True


def matches(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item: str = "item_id", item_text: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, hits (array of item_id, distance, end_word): one row a row of documents.

    Items without words match nothing. Null texts have no words; very long ones are read whole, in slices; repeated rows and
    items stay as they are, with null ids as null; an empty benchmark or table of documents gives no hits or no rows. Other
    columns of either table are not read, whatever their names.

    The last block's pass gives the rows. Those of earlier blocks write what they hit, by a digest of doc_id and text.
    """
    ws = Workspace(spark, "decontaminate")
    rows = has_columns(documents, doc_id=(id, "long"), text=(text, "string"))
    earlier = None
    for n, (part, last) in enumerate(_last_apart(blocks(benchmark, item, item_text, block))):
        shared = spark.sparkContext.broadcast(Pieces(part, rate))

        def start(shared=shared):
            pieces = shared.value

            def step(columns):
                words = [words_of(x) for x in columns[1]]
                return [columns[0], columns[2], list(map(len, words)), [_hits(pieces, w) for w in words]]

            return step

        only = last and earlier is None  # a benchmark of one block needs no digest
        keyed = rows.withColumn("rid", F.lit(None).cast("binary") if only else row_key("doc_id", "text"))
        found = map_columns(keyed, start, f"doc_id long, rid binary, n_words long, hits {HITS}")
        if not last:
            table = ws.table(found.where(F.size("hits") > 0).select("rid", F.col("hits").alias("before")), f"hits_{n}")
            earlier = table if earlier is None else earlier.unionByName(table)
            shared.destroy()
    if earlier is None:
        return found.select("doc_id", "n_words", "hits")
    # rows that are equal in id and text have equal hits in each block
    before = earlier.distinct().groupBy("rid").agg(F.flatten(F.collect_list("before")).alias("before"))
    hits = F.when(F.col("before").isNull(), F.col("hits")).otherwise(F.array_sort(F.concat("before", "hits")))
    return found.join(before, "rid", "left").select("doc_id", "n_words", hits.alias("hits"))


def _hits(pieces: Pieces, words: list[bytes]) -> list[dict]:
    found = sorted(pieces.found(words).items(), key=lambda y: (y[0] is not None, y[0] or 0))
    return [{"item_id": i, "distance": d, "end_word": e} for i, (d, e) in found]


def clean(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """`documents` without those in which an item occurs within its budget; columns stay as they are, whatever their names.

    Null and empty texts hold no item and stay; repeated rows stay or go together; an empty benchmark rejects nothing, an
    empty table gives an empty result. With several blocks, what each leaves is a written table, so that one is alive at a
    time; nothing is shuffled.
    """
    ws, name, schema = Workspace(spark, "decontaminate"), unused(documents, "leaks"), documents.schema
    for n, (part, last) in enumerate(_last_apart(blocks(benchmark, item, item_text, block))):
        shared = spark.sparkContext.broadcast(Pieces(part, rate))
        found = lambda texts, shared=shared: [len(shared.value.found(words_of(x))) for x in texts]
        left = append_column(documents, text, found, name, "int").where(F.col(name) == 0).drop(name)
        if last:
            return left
        documents = ws.table(left, f"left_{n}")
        shared.destroy()
        if n:
            ws.drop(f"left_{n - 1}")
    return spark.createDataFrame([], schema)
