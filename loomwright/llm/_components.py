"""Connected components over a distributed edge table, by alternating stars."""

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._workspace import Workspace


def _forest(batches, names=("u", "v")):
    """Of each task's edges, a spanning forest as (node, smallest node): linear in nodes, however many edges there were."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    columns = [pd.Series(nodes, dtype="int64"), pd.Series([find(x) for x in nodes], dtype="int64")]
    yield pd.DataFrame(dict(zip(names, columns)))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges have u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    return small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()


#: Edges, some 2 MB, that one task may join.
AT_ONCE = 100_000


def components(edges: DataFrame, ws: Workspace, name: str = "stars", at_once: int = AT_ONCE) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge, but for roots. Edges u, v are numbers without
    nulls; loops and repeated edges change nothing; without edges there are no rows.

    Each task first reduces its edges to a forest. If `at_once` edges are left at most, one task joins them; if more, rounds
    of stars do, each of which is spread over all tasks. Each round's edges are a written table. A round leaves every node with one edge to its component's smallest node once
    nothing changes any more; rounds grow with the logarithm of the longest chain. Nothing is gathered on the driver but
    two sums.
    """
    now = ws.table(edges.mapInPandas(_forest, "u long, v long"), f"{name}/0")
    if now.count() <= at_once:
        return ws.table(now.coalesce(1).mapInPandas(partial(_forest, names=("node", "root")), "node long, root long"), f"{name}/whole")
    done, at = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == done or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        done, at = state, at + 1
        now = ws.table(_stars(now), f"{name}/{at}")
        ws.drop(f"{name}/{at - 1}")
