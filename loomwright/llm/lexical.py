"""Ranked lexical search over an index of two levels: bounds from bytes, then exact integers.

Documents are dealt into blocks as they lie, and each block is an index of its own: nothing is shuffled to build it. A block
has a row for each of its terms: the documents that hold the term, one byte an impact, and how often they hold it; and a row
of the documents' ids and lengths. An impact is a term's share of a document's score without the term's weight, divided by
STEP and rounded upwards, so that a sum of weighted impacts is an upper bound of a score, and one of impacts less one a
lower bound.

A search reads the rows of the items' terms, brings those of a block together, and passes over the blocks twice. The first
pass sums lower bounds and keeps each item's k highest by task; the k-th of all is what a document must reach. The second sums
upper bounds, and every document that reaches it is scored exactly, in integers, from the second level.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ._text import has_columns, schema_of, spread
from ._workspace import Workspace
from .decontaminate import blocks

TOP, ITEMS = 20, 512
#: Documents of a block, whose places have 16 bits, and bytes of their texts.
DOCS, BYTES = 4096, 8 << 20
#: An exact share is below a million, so that an impact is at most 255.
SCALE = 1_000_000_000
STEP = -(-1_000_000 // 255)
#: Bytes that are in no term, and capital letters.
_APART = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_CAPITALS = bytes(range(0x41, 0x5B))
_PLAIN = bytes.maketrans(_APART + _CAPITALS, b" " * len(_APART) + _CAPITALS.lower())
ROWS = "block long, term string, df int, docs binary, impacts binary, tfs binary, ids array<long>, sizes array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def length_share(n: int, documents: int, terms: int) -> int:
    """A document's m: its length in per cent of the mean, a quarter of it, and three quarters of the mean."""
    return 75 + 25 * n * documents // terms


def shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term gives a document's score, but for the term's weight."""
    return SCALE * tf // (1000 * tf + 12 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _slices(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Consecutive slices of an array as bytes, without a copy."""
    ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _indexed(schema: pa.Schema, block: int, ids: list, found: list[list[bytes]], documents: int, terms: int) -> list[pa.RecordBatch]:
    """The rows of one block."""
    sizes = [len(x) for x in found]
    codes = pa.array([w for x in found for w in x], pa.binary()).dictionary_encode()
    key, tf = np.unique(codes.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, doc = np.divmod(key, len(ids))
    m = np.array([length_share(n, documents, terms) for n in sizes], np.int64)
    impact = -(-shares(tf, m[doc]) // STEP)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    n = len(starts)  # the dictionary has each term once, in order
    df = np.diff(np.append(starts, len(key))).astype(np.int32)
    columns = [pa.array(np.full(n, block)), codes.dictionary.cast(pa.string()), pa.array(df), _slices(doc.astype("<u2"), starts), _slices(impact.astype(np.uint8), starts), _slices(tf.astype("<u4"), starts), pa.nulls(n, schema.field("ids").type), pa.nulls(n, schema.field("sizes").type)]
    head = [[block], [None], [None], [None], [None], [None], [ids], [sizes]]
    return [pa.RecordBatch.from_arrays(columns, schema=schema), pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(head, schema)], schema=schema)]


class LexicalIndex:
    """An index of all documents, for any number of searches until `drop`.

    Null and empty texts and texts without a term have no rank; very long texts are indexed whole, as a block of their own if
    need be; each repeated row is a document. A null id comes after others of its score. An empty table, or one without terms, finds nothing.
    Columns besides id and text are not read, whatever their names.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, text: str = "text", id: str = "doc_id", docs: int = DOCS, size: int = BYTES):
        self.spark, self.ws = spark, Workspace(spark, "lexical")
        rows = has_columns(documents, doc_id=(id, "long"), text=(text, "string")).where("text IS NOT NULL")
        self.searches = 0

        def counted(batches):
            for batch in batches:
                sizes = [len(terms_of(x)) for x in batch.column(0).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))]), pa.array([sum(sizes)])], names=["documents", "terms"])

        found = spread(rows.select("text")).mapInArrow(counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
        self.documents, self.terms = found[0] or 0, found[1] or 0
        n, terms, schema = self.documents, self.terms, to_arrow_schema(schema_of(ROWS))

        def run(batches):
            block = TaskContext.get().partitionId() << 33
            ids, found, held = [], [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for i, x in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                        if not (words := terms_of(x)):
                            continue
                        if len(ids) == docs or ids and held + len(x) > size:
                            yield from _indexed(schema, block, ids, found, n, terms)
                            block, ids, found, held = block + 1, [], [], 0
                        ids.append(i)
                        found.append(words)
                        held += len(x)
            if ids:
                yield from _indexed(schema, block, ids, found, n, terms)

        self.index = self.ws.table(spread(rows).mapInArrow(run, ROWS), "index")

    def drop(self) -> None:
        """Frees the index; results that were returned stay readable."""
        self.ws.drop("index")

    def search(self, items: DataFrame, top: int = TOP, item: str = "item_id", text: str = "text", block: int = ITEMS) -> DataFrame:
        """item_id, rank, doc_id, score: each item's `top` documents of the highest scores above 0, equal ones by id.

        Items are taken in blocks, of bounded text. Null and empty items, and items whose terms no document has, find nothing; an
        item's repeated terms count as often; repeated items are answered each; an empty table of items gives an empty result.
        """
        out = self.spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        for part in blocks(items, item, text, block):
            if self.documents and any(terms_of(x) for _, x in part):
                out = out.unionByName(self._answered(part, top))
        return out

    def _answered(self, part: list, top: int) -> DataFrame:
        self.searches += 1
        asked = [Counter(terms_of(x)) for _, x in part]
        distinct = sorted(set().union(*asked))
        wanted = F.broadcast(self.spark.createDataFrame(pa.table({"term": pa.array(distinct, pa.binary()).cast(pa.string())})))  # a block's terms
        rows = self.index.join(wanted, "term", "left_semi").unionByName(self.index.where("term IS NULL").select("term", *(c for c in self.index.columns if c != "term")))
        posting = F.when(F.col("term").isNotNull(), F.struct("term", "df", "docs", "impacts", "tfs"))
        # a block's rows of these terms: no more than its documents hold
        met = rows.groupBy("block").agg(F.collect_list(posting).alias("postings"), F.max("ids").alias("ids"), F.max("sizes").alias("sizes"))
        hits = self.ws.table(met.where(F.size("postings") > 0), f"hits_{self.searches}")
        df = hits.select(F.explode("postings").alias("p")).groupBy("p.term").agg(F.sum("p.df").alias("df")).toArrow()  # a block's terms
        weights = {t.encode(): weight(n, self.documents) for t, n in zip(*(df.column(i).to_pylist() for i in range(2)))}
        of: dict[bytes, tuple[list, list]] = {}
        for i, terms in enumerate(asked):
            for term, times in terms.items():
                if weights.get(term):
                    of.setdefault(term, ([], []))[0].append(i)
                    of[term][1].append(times * weights[term])
        of = {t: (np.array(i), np.array(w, np.int64)) for t, (i, w) in of.items()}
        shared = self.spark.sparkContext.broadcast(of)
        numbers = self.spark.createDataFrame([(k, i) for k, (i, _) in enumerate(part)], "item int, item_id long")

        lower = hits.select(F.size("ids").alias("n"), F.transform("postings", lambda p: F.struct(p["term"], p["docs"], p["impacts"])).alias("postings"))
        best = lower.mapInArrow(_lower_bounds(shared, len(part), top), "item int, bound long")
        best = best.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound")))).where(F.col("at") == top)
        needed = np.ones(len(part), np.int64)  # without `top` documents, all that hold a term
        for r in best.select("item", "bound").collect():  # a row an item
            needed[r["item"]] = max(1, r["bound"])
        scored = hits.select("postings", "ids", "sizes").mapInArrow(_rescored(shared, needed, self.documents, self.terms, top), "item int, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ranked = ranked.join(F.broadcast(numbers), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        answer = self.ws.table(ranked, f"answer_{self.searches}")
        self.ws.drop(f"hits_{self.searches}")
        shared.destroy()
        return answer


def _postings(batch: pa.RecordBatch, name: str = "postings"):
    """For each row, the term, places, impacts and, if there, counts of each of its postings."""
    column = batch.column(batch.schema.get_field_index(name))
    for row in column.to_pylist():
        yield [{k: v.encode() if k == "term" else v for k, v in p.items()} for p in row]


def _summed(of: dict, postings: list[dict], items: int, docs: int, less: int) -> np.ndarray:
    """Sums of weighted impacts, less `less` each, by item and document."""
    out = np.zeros((items, docs), np.int64)
    for p in postings:
        if (found := of.get(p["term"])) is not None:
            at = np.frombuffer(p["docs"], "<u2").astype(np.int64)
            impact = np.maximum(np.frombuffer(p["impacts"], np.uint8).astype(np.int64) - less, 0)
            which, weights = found
            if len(which) == 1:
                out[which[0], at] += weights[0] * impact
            else:
                out[which[:, None], at] += weights[:, None] * impact
    return out


def _lower_bounds(shared, items: int, top: int):
    def run(batches):
        best = np.zeros((items, top), np.int64)
        for batch in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            bounds = _summed(shared.value, next(_postings(batch)), items, batch.column(0)[0].as_py(), 1)
            both = np.concatenate((best, bounds), axis=1)
            best = np.partition(both, both.shape[1] - top, axis=1)[:, -top:]
        item, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(best[item, place])], names=["item", "bound"])

    return run


def _rescored(shared, needed: np.ndarray, documents: int, terms: int, top: int):
    none = np.iinfo(np.int64).max  # a null id, which comes last

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (x.slice(i, 1) for x in batches for i in range(x.num_rows)):
            postings, of = next(_postings(batch)), shared.value
            ids, sizes = (batch.column(i)[0].as_py() for i in (1, 2))
            reached = _summed(of, postings, len(needed), len(ids), 0) >= needed[:, None]
            if not reached.any():
                continue
            ids = np.array([none if i is None else i for i in ids], np.int64)
            m = np.array([length_share(n, documents, terms) for n in sizes], np.int64)
            score = np.zeros(reached.shape, np.int64)
            some = reached.any(axis=0)  # documents that any item's bound takes
            for p in postings:
                if (found := of.get(p["term"])) is not None:
                    at = np.frombuffer(p["docs"], "<u2").astype(np.int64)
                    if (kept := some[at]).any():
                        at, tf = at[kept], np.frombuffer(p["tfs"], "<u4").astype(np.int64)[kept]
                        score[found[0][:, None], at] += found[1][:, None] * shares(tf, m[at])
            for i in np.flatnonzero(reached.any(axis=1)).tolist():
                at = np.flatnonzero(reached[i] & (score[i] > 0))
                s, d = score[i, at], ids[at]
                if i in best:
                    s, d = np.concatenate((best[i][0], s)), np.concatenate((best[i][1], d))
                order = np.lexsort((d, -s))[:top]
                best[i] = s[order], d[order]
        item = np.repeat(np.array(list(best), np.int32), [len(s) for s, _ in best.values()])
        s, d = (np.concatenate([x[k] for x in best.values()] or [np.empty(0, np.int64)]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(d, mask=d == none), pa.array(s)], names=["item", "doc_id", "score"])

    return run


def searched(spark: SparkSession, documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The result of one search over an index that is made for it; cases are those of `LexicalIndex`."""
    index = LexicalIndex(spark, documents)
    out = index.search(items, **options)
    index.drop()
    return out
