"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are 24 numbers. Trees are grown on a bounded sample of labelled rows (`sample`), over quantile
bins, by histograms of gradients; they are flattened into arrays (feature, threshold, value; children of node i are
2i + 1 and 2i + 2), which all rows of a batch walk at once in numpy. Every whole text is scored.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import crc_mod, sampled
from ._text import has_columns, map_columns, spread

SAMPLE = 20_000
FEATURES = 24
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B)]] = 1
_CLASS[[*range(0x61, 0x7B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>{}[]\\/=+~^_@`"]] = 6
_CLASS[128:] = 7


def statistics(text: bytes | None) -> list[float]:
    """FEATURES numbers; all are zero for null, empty or blank texts."""
    words = (text or b"").split()
    if not words:
        return [0.0] * FEATURES
    n = len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    size, ink = len(text), max(1, len(text) - int(kinds[4]))
    lengths = np.fromiter(map(len, words), np.int64, n)
    count = Counter(words)
    tops = sorted(count.values(), reverse=True)
    pairs = Counter(zip(words, words[1:]))
    runs = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x.strip() for x in text.split(b"\n")]
    lines = [x for x in lines if x]
    line_count = Counter(lines)
    freq = np.fromiter(count.values(), np.float64, len(count)) / n
    ended = sum(x.endswith((b".", b"!", b"?")) for x in words)
    short = int((lengths <= 3).sum())
    return [
        float(np.log1p(n)), float(np.log1p(size)), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        kinds[1] / ink, kinds[2] / ink, kinds[3] / ink, kinds[5] / ink, kinds[6] / ink, kinds[7] / ink,
        len(count) / n, tops[0] / n, sum(tops[:5]) / n, runs / n,
        1 - len(pairs) / max(1, n - 1), max(pairs.values(), default=0) / max(1, n - 1),
        len(lines) / n, 1 - len(line_count) / len(lines), max(line_count.values()) / len(lines),
        float(-(freq * np.log(freq)).sum() / max(1e-9, np.log(max(2, n)))), ended / n, short / n, text.count(b"!") / n,
    ]


@dataclass
class Forest:
    """Flattened trees: arrays of shape (trees, nodes); a leaf's feature is -1 and passes rows to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[tree, node]
            right = x[row, np.maximum(f, 0)] > self.threshold[tree, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return self.base + self.value[tree, node].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Boosted trees of logistic loss. `least`: the least sum of second derivatives in a leaf. No rows, or one label
    only: no tree, and the base is the smoothed rate's."""
    nodes = 2 ** (depth + 1) - 1
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.full((1, nodes), -1), np.zeros((1, nodes)), np.zeros((1, nodes)), base, depth)
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(d) * bins
    feature, threshold, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node, live = np.zeros(n, np.int64), np.ones(n, bool)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            where = ((node[live] - first)[:, None] * (d * bins) + flat[live]).ravel()
            gl, hl = (np.bincount(where, np.repeat(v[live], d), wide * d * bins).reshape(wide, d, bins).cumsum(axis=2) for v in (g, h))
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            for k, best in enumerate(gain.reshape(wide, -1).argmax(axis=1)):
                j, b = divmod(int(best), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            f = feature[t, node]
            live &= f >= 0
            node = np.where(live, 2 * node + 1 + (x[np.arange(n), np.maximum(f, 0)] > threshold[t, node]), node)
        value[t] = -np.bincount(node, g, nodes) / (np.bincount(node, h, nodes) + l2) * rate
        score += value[t][node]
    return Forest(feature, threshold, value, base, depth)


class Quality:
    """A fitted model. `learn` is a condition over doc_id (of labels) that says which labels may be learnt from.

    Ids that are labelled repeatedly count once, with their largest label; null ids or labels, and labels of ids without a
    document, are left out; of documents with one id the least statistics learn. With one label only, or none, or
    without documents, all scores are the smoothed rate's. Very long texts are counted whole. Ties between splits go to the
    first feature and bin. Other columns are not read, whatever their names.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id: str = "doc_id", learn=None, sample: int = SAMPLE):
        ids = sampled(labels, label, F.lit(True) if learn is None else learn, sample)
        rows = spread(has_columns(documents, doc_id=(id, "long"), text=(text, "string")))
        rows = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")  # `sample` ids at most

        def start():
            return lambda columns: [columns[0], columns[1], [statistics(x) for x in columns[2]]]

        # of repeated ids one text, so that the sample stays in bounds
        got = map_columns(rows, start, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toArrow().to_pandas()
        got = got.sort_values("doc_id")  # the same model whatever order the rows arrive in
        x = np.array(got["x"].tolist(), np.float64).reshape(len(got), FEATURES)
        self.forest = grow(x, got["y"].to_numpy(np.float64))
        self.shared = spark.sparkContext.broadcast(self.forest)

    def scores(self, documents: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
        """doc_id, score: one row a row of documents; null counts as empty, all empty or blank texts have one score, a very long
        text is scored whole; repeated rows have one score; an empty table gives an empty result."""
        shared = self.shared

        def start():
            forest = shared.value
            return lambda columns: [columns[0], forest.scores(np.array([statistics(x) for x in columns[1]]).reshape(-1, FEATURES))]

        return map_columns(has_columns(documents, doc_id=(id, "long"), text=(text, "string")), start, "doc_id long, score double")


def held_in(by: int = 3):
    """The contract's fold: labels of ids whose crc32 modulo `by` is not one may be learnt."""
    return crc_mod("doc_id", by) != 1
