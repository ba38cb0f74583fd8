"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs of neighbours and pairs with one word between are hashed to 2^20 places. FTRL keeps a learning rate for each
place, and its L1 term leaves most weights at zero; the rest is a compact table that is broadcast (bounded by 2^20
weights whatever the corpus). Gradients of toxic rows, which are few, count `toxic_weight` times. Learning takes a bounded
sample of labelled rows (`sample` rows, SAMPLE_BYTES of features); scoring takes every whole text.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import crc_mod, sampled
from ._text import ODD, append_column, has_columns, map_columns, mixed, spread, unused, word_hashes
from ._workspace import Workspace

PLACES = 1 << 20
SAMPLE, SAMPLE_BYTES = 16_000, 128_000_000
#: Punctuation counts as space, so that "word!!" is the word.
_PLAIN = bytes(x if chr(x).isalnum() or x in (0x27,) or x > 127 else 0x20 for x in range(256))
_CHUNK = 200_000


def places(text: bytes | None):
    """Arrays of the places of a text's features, repeats included; a long text comes in several arrays, none of whose
    features is in another. Text is lower-cased, and ASCII other than letters, digits and ' is space."""
    words = (text or b"").decode().lower().encode().translate(_PLAIN).split()
    for at in range(0, len(words), _CHUNK):
        h = word_hashes(words[at : at + _CHUNK + 2])
        near = mixed(h[:-1] * np.uint64(ODD[0]) + h[1:])
        skip = mixed(h[:-2] * np.uint64(ODD[1]) + h[2:] + np.uint64(1))
        yield (np.concatenate((h[:_CHUNK], near[:_CHUNK], skip[:_CHUNK])) & np.uint64(PLACES - 1)).astype(np.int32)


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2 terms; `bias` is unpenalised."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 0.01
    epochs: int = 10
    toxic_weight: float = 6.0

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Places with a weight, their weights, and the bias. Rows hold distinct places. With no row, all scores are low."""
        if not rows:
            return np.empty(0, np.int32), np.empty(0, np.float32), -4.0
        z, n, bias = np.zeros(PLACES), np.zeros(PLACES), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        bias_n = self.beta
        order = np.random.default_rng(5)
        for _ in range(self.epochs):
            for i in order.permutation(len(rows)):
                at = rows[i]
                zi, ni = z[at], n[at]
                root = np.sqrt(ni)
                w = np.where(np.abs(zi) > self.l1, (np.sign(zi) * self.l1 - zi) / ((self.beta + root) / self.alpha + self.l2), 0.0)
                g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y[i]) * (self.toxic_weight if y[i] else 1.0)
                n[at] = ni + g * g
                z[at] = zi + g - (np.sqrt(ni + g * g) - root) / self.alpha * w
                bias_n += g * g
                bias -= self.alpha * 0.1 * g / np.sqrt(bias_n)
        w = np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)
        at = np.flatnonzero(w).astype(np.int32)
        return at, w[at].astype(np.float32), bias


def score(text: bytes | None, dense: np.ndarray, bias: float) -> float:
    hit = [x[dense[x] != 0] for x in places(text)]
    total = float(dense[np.unique(np.concatenate(hit))].sum(dtype=np.float64)) if hit else 0.0
    return float(1 / (1 + np.exp(-np.clip(total + bias, -35, 35))))


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each value's bytes as numbers, without a copy."""
    out = []
    for chunk in (x for x in column.chunks if len(x)):
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        out += [data[a:b].view(np.int32) for a, b in zip(ends, ends[1:])]
    return out


class Toxicity:
    """A fitted model. `learn` is a condition over doc_id (of labels) that says which labels may be learnt from.

    Ids that are labelled repeatedly count once, with their largest label; null ids or labels, and labels of ids without a
    document, are left out; of documents with one id the text of the smallest features learns. Without any label left, or
    without documents, all scores are low. Very long texts learn from all their features; with SAMPLE_BYTES reached, labelled rows
    beyond, in the order of their ids' hash, are left out. Ties of that order go by id. Other columns are not read, whatever
    their names.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id: str = "doc_id", learn=None, sample: int = SAMPLE, ftrl: Ftrl | None = None):
        ids = sampled(labels, label, F.lit(True) if learn is None else learn, sample)
        rows = spread(has_columns(documents, doc_id=(id, "long"), text=(text, "string")))
        rows = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")  # `sample` ids at most

        def start():
            def step(columns):
                ids, y, texts = columns
                return [ids, y, [np.unique(np.concatenate([*places(x), np.empty(0, np.int32)])).tobytes() for x in texts]]

            return step

        # of repeated ids one text, so that the sample stays in bounds
        each = map_columns(rows, start, "doc_id long, y int, at binary").groupBy("doc_id", "y").agg(F.min("at").alias("at"))
        ws = Workspace(spark, "toxicity")
        each = ws.table(each.withColumn("size", F.length("at")), "features")
        sizes = each.select("doc_id", "size", F.xxhash64("doc_id").alias("k")).toPandas().sort_values(["k", "doc_id"])  # `sample` rows
        chosen = sizes["doc_id"][(sizes["size"].cumsum() <= SAMPLE_BYTES).to_numpy()]
        if len(chosen) < len(sizes):
            each = each.join(F.broadcast(spark.createDataFrame(chosen.to_frame(), "doc_id long")), "doc_id", "left_semi")
        got = each.select("doc_id", "y", "at").toArrow()
        ws.drop("features")
        order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")  # the same model whatever order the rows arrive in
        found = _views(got.column("at"))
        self.places, self.weights, self.bias = (ftrl or Ftrl()).fit([found[i] for i in order.tolist()], got.column("y").to_numpy().astype(np.float64)[order])
        del got, found
        pa.default_memory_pool().release_unused()  # else the driver keeps the sample's memory
        self.shared = spark.sparkContext.broadcast((self.places, self.weights, self.bias))

    def _dense(self):
        shared = self.shared

        def load():
            at, w, bias = shared.value
            dense = np.zeros(PLACES, np.float32)
            dense[at] = w
            return dense, bias

        return load

    def scores(self, documents: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
        """doc_id, score: one row a row of documents; null counts as empty, an empty text has the bias's score, a very long one
        is scored whole, in chunks; repeated rows have one score; an empty table gives an empty result."""
        load = self._dense()

        def start():
            dense, bias = load()
            return lambda columns: [columns[0], [score(x, dense, bias) for x in columns[1]]]

        return map_columns(has_columns(documents, doc_id=(id, "long"), text=(text, "string")), start, "doc_id long, score double")

    def accepted(self, documents: DataFrame, text: str = "text", below: float = 0.5) -> DataFrame:
        """`documents` without those that score `below` or more; columns stay as they are, and other cases as in `scores`."""
        load, held, name = self._dense(), [], unused(documents, "toxicity")

        def values(texts):
            if not held:
                held.append(load())
            return [score(x, *held[0]) for x in texts]

        return append_column(documents, text, values, name, "double").where(F.col(name) < below).drop(name)


def held_in(by: int = 5):
    """The contract's fold: labels of ids whose crc32 modulo `by` is not zero may be learnt."""
    return crc_mod("doc_id", by) != 0


def measured(scores: pd.DataFrame, truth: pd.Series) -> dict[str, float]:
    """Precision, recall and accuracy at 0.5 of scored rows."""
    hit, said = (scores["score"] >= 0.5) & (truth == 1), scores["score"] >= 0.5
    return {"precision": float(hit.sum() / max(1, said.sum())), "recall": float(hit.sum() / max(1, (truth == 1).sum())), "accuracy": float((said == (truth == 1)).mean())}
