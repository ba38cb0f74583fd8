"""Embeddings: isotropy, pooling, cosine rewards, greedy matching of token vectors."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import cosine, normalized
from .datasets import prefix_sums


def sums(frame: DataFrame, by: str, vector: str) -> DataFrame:
    """by, dim, s, q, n: sums over each sequence's unit vectors, by dimension, and how many vectors there are."""
    unit = frame.select(by, normalized(F.col(vector)).alias("v"))
    each = unit.select(by, F.posexplode("v").alias("dim", "x"))
    return each.groupBy(by, "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))


def self_similarity(frame: DataFrame, by: str, vector: str) -> DataFrame:
    """by, n, similarity: the mean cosine of all pairs in a sequence; sequences of one vector are left out.

    The sum over pairs is (|sum of units|^2 - sum of squared lengths) / 2, so vectors are summed by dimension, with
    map-side partial sums, and no pair is formed.
    """
    total = sums(frame, by, vector).groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("q").alias("own"), F.max("n").alias("n"))
    n = F.col("n")
    return total.where("n > 1").select(by, "n", ((F.col("all") - F.col("own")) / (n * (n - 1))).alias("similarity"))


def isotropy(frame: DataFrame, by: str, vector: str) -> DataFrame:
    """One row: 1 - the mean self-similarity over sequences; null without any."""
    return self_similarity(frame, by, vector).agg((1 - F.avg("similarity")).alias("isotropy"))


def interim(similarities: DataFrame, by: str, every: int) -> DataFrame:
    """sequences, isotropy after each `every` sequences in the order of `by`, from prefix sums by range."""
    upto = prefix_sums(similarities.select(by, "similarity"), [F.col(by)], "similarity", "_before", number="_n").where(F.col("_n") % every == 0)
    return upto.select(F.col("_n").alias("sequences"), (1 - (F.col("_before") + F.col("similarity")) / F.col("_n")).alias("isotropy"))


def mean_pooled(frame: DataFrame, by: str, vector: str, mask: str, least: float = 1e-9) -> DataFrame:
    """by, pooled: the mean of each sequence's masked token vectors, by dimension."""
    each = frame.select(by, F.col(mask).cast("double").alias("m"), F.posexplode(vector).alias("dim", "x"))
    dims = each.groupBy(by, "dim").agg((F.sum(F.col("x") * F.col("m")) / F.greatest(F.sum("m"), F.lit(least))).alias("x"))
    return dims.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("pooled"))


def cosine_reward(frame: DataFrame, a: str, b: str, scale: float = 5.0) -> DataFrame:
    """`frame` with `reward`: the cosine of two embeddings times `scale`."""
    return frame.withColumn("reward", cosine(F.col(a), F.col(b)) * scale)


def anchored_reward(frame: DataFrame, anchor: str, document: str, reference: str, hypothesis: str, scale: float = 5.0) -> DataFrame:
    """`frame` with `reward`: the scaled cosine of a hypothesis and its anchor, which is the document's or the reference's vector."""
    if anchor not in ("document", "reference"):
        raise ValueError(f"unknown anchor {anchor!r}")
    return cosine_reward(frame, document if anchor == "document" else reference, hypothesis, scale)


def _matched(hyp: np.ndarray, ref: np.ndarray, rows: int = 1024) -> tuple[float, float]:
    """Mean best cosines of either side's vectors, in blocks of `rows`, so that long texts need no whole matrix."""
    if not len(hyp) or not len(ref):
        return 0.0, 0.0
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    h, r = unit(hyp), unit(ref)
    best_h, best_r = np.empty(len(h)), np.full(len(r), -np.inf)
    for at in range(0, len(h), rows):
        c = h[at : at + rows] @ r.T
        best_h[at : at + rows] = c.max(axis=1)
        best_r = np.maximum(best_r, c.max(axis=0))
    return float(best_h.mean()), float(best_r.mean())


def greedy_match(frame: DataFrame, hyp: str, ref: str) -> DataFrame:
    """`frame` without the vectors, with bert_p, bert_r, bert_f: each token vector's best cosine on the other side, averaged.

    `hyp` and `ref` are arrays of vectors of one pair, so the comparison stays within a row; it is a matrix product, for
    which arrays of arrays have no expression. An empty or null side scores 0.
    """

    rest = [f for f in frame.schema.fields if f.name not in (hyp, ref)]
    kinds = T.StructType([*rest, *(T.StructField(f"bert_{x}", T.DoubleType()) for x in "prf")])

    def run(parts):
        matrix = lambda x: np.array([]) if x is None or len(x) == 0 else np.stack([np.asarray(v, float) for v in x])
        for pdf in parts:
            pr = [_matched(matrix(a), matrix(b)) for a, b in zip(pdf[hyp], pdf[ref])]
            p, r = (np.array([x[i] for x in pr], float) for i in (0, 1))
            f = np.divide(2 * p * r, p + r, out=np.zeros(len(pr)), where=p + r != 0)
            yield pdf[[x.name for x in rest]].assign(bert_p=p, bert_r=r, bert_f=f)

    return frame.mapInPandas(run, kinds)
