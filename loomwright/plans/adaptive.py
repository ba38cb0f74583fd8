"""Rankings from as few judged pairs as a merge sort needs, of all samples at once.

A sample's names are runs of one name each at first. Neighbouring runs are merged, all of a sample and all samples side by side: a
round asks for one pair of each merge, the heads of both its runs, and its answer moves the better one to the end of what is
merged. When all merges of a sample are through, the results are the runs of its next ones. So a sample of n names has at most
n log2 n pairs judged, and never one whose order follows from others.

A round is a step of an iteration over tables: it asks, judges and merges by joins on the sample, and writes what it was told
and where each sample stands. A run that broke off is taken up again with the comparisons that it wrote (`done`).
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_path

_RUN = "array<struct<pos: long, name: string>>"
_MERGES = f"array<struct<a: {_RUN}, b: {_RUN}, out: {_RUN}>>"
_TOLD = "x string, y string, preferred int, judged boolean, round int"


def _paired(runs: Column) -> Column:
    """Merges of neighbouring runs; the last of an odd number stands alone."""
    none = F.array().cast(_RUN)
    one = lambda i: F.struct(F.get(runs, 2 * i).alias("a"), F.coalesce(F.get(runs, 2 * i + 1), none).alias("b"), none.alias("out"))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(runs) / 2).cast("int") - 1), one).cast(_MERGES)


def _open(m: Column) -> Column:
    return (F.size(m["a"]) > 0) & (F.size(m["b"]) > 0)


def _advanced(merges: Column, winners: Column) -> Column:
    """`merges` after a round: `winners` has 1 for the head of a, -1 for that of b, by the merge's place."""

    def step(m, i):
        w, tail = F.try_element_at(winners, i), lambda x: F.slice(x, 2, F.size(x))
        first = F.struct(tail(m["a"]).alias("a"), m["b"].alias("b"), F.concat(m["out"], F.slice(m["a"], 1, 1)).alias("out"))
        second = F.struct(m["a"].alias("a"), tail(m["b"]).alias("b"), F.concat(m["out"], F.slice(m["b"], 1, 1)).alias("out"))
        return F.when(w == 1, first).when(w == -1, second).otherwise(m)

    return F.transform(merges, step)


def _settled(frame: DataFrame) -> DataFrame:
    """`frame` (merges) with the results of samples all of whose merges are through as the runs of the next ones."""
    through = ~F.exists("merges", _open)
    results = F.transform("merges", lambda m: F.concat(m["out"], m["a"], m["b"]))
    return frame.withColumn("merges", F.when(through & (F.size("merges") > 1), _paired(results)).otherwise(F.col("merges")))


def adaptive_tournament(samples: DataFrame, judge: Callable[[DataFrame], DataFrame], done: DataFrame | None = None, id: str = "sample_id", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rankings (id, ranking, status) and comparisons (id, x, y, preferred, judged, round).

    `samples` has id, name, pos and content by candidate, names once a sample. `judge` takes pairs (id, x, y, content_x, content_y; x stands before y in
    the sample) and gives id, x, y, preferred: 1 for x, -1 for y, null if it cannot tell. Pairs that `done` (id, x, y, preferred)
    has in either order with a preference are not judged again. A sample is 'ranked', best name first, or has a null ranking: 'undecided', once
    the judge could not tell a pair that its merges need. There are about as many rounds as twice the names of the largest sample.
    """
    spark, path = samples.sparkSession, path or new_path(samples.sparkSession, "tournament")
    kind = samples.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, merges {_MERGES}, undecided boolean"
    names = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "name")))
    start = samples.groupBy(id).agg(names.alias("names")).select(id, F.transform("names", lambda x: F.array(x)).alias("runs"))
    state = start.select(id, _paired(F.col("runs")).alias("merges"), F.lit(False).alias("undecided"))
    texts = samples.select(id, "name", "content")
    known = None if done is None else _both_ways(done.where("preferred IN (1, -1)"), id)
    n = 0
    while True:
        # samples that have pairs left go on, all others are through
        going = F.exists("merges", _open) & ~F.col("undecided")
        state.withColumn("going", going).write.partitionBy("going").parquet(f"{path}/state/{n}")
        state = spark.read.schema(schema).parquet(f"{path}/state/{n}/going=true") if _any(spark, f"{path}/state/{n}/going=true") else None
        if state is None:
            break
        heads = state.select(id, F.posexplode("merges").alias("i", "m")).where(_open(F.col("m"))).select(id, F.col("i"), F.col("m.a")[0].alias("a"), F.col("m.b")[0].alias("b"))
        first = F.col("a.pos") < F.col("b.pos")
        asked = heads.select(id, "i", F.when(first, F.col("a.name")).otherwise(F.col("b.name")).alias("x"), F.when(first, F.col("b.name")).otherwise(F.col("a.name")).alias("y"), F.when(first, 1).otherwise(-1).alias("sign"))
        told = _told(asked, texts, known, judge, id).withColumn("round", F.lit(n))
        told.write.parquet(f"{path}/told/{n}")
        told = spark.read.schema(f"`{id}` {kind}, i int, sign int, {_TOLD}").parquet(f"{path}/told/{n}")
        answers = told.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("i", (F.col("preferred") * F.col("sign")).alias("w")))).alias("winners"), F.bool_or(F.col("preferred").isNull()).alias("none"))
        moved = state.join(answers, id, "left").select(id, _advanced(F.col("merges"), F.col("winners")).alias("merges"), F.coalesce("none", F.lit(False)).alias("undecided"))
        state, n = _settled(moved), n + 1
    through = spark.read.schema(f"{schema}").parquet(*(f"{path}/state/{k}/going=false" for k in range(n + 1) if _any(spark, f"{path}/state/{k}/going=false"))) if samples.take(1) else spark.createDataFrame([], schema)
    last = F.get("merges", F.lit(0))
    order = F.transform(F.concat(last["out"], last["a"], last["b"]), lambda x: x["name"])
    rankings = through.select(id, F.when(~F.col("undecided"), order).alias("ranking"), F.when(F.col("undecided"), "undecided").otherwise("ranked").alias("status"))
    made = spark.read.schema(f"`{id}` {kind}, {_TOLD}").parquet(*(f"{path}/told/{k}" for k in range(n))) if n else spark.createDataFrame([], f"`{id}` {kind}, {_TOLD}")
    return rankings, made


def _both_ways(done: DataFrame, id: str) -> DataFrame:
    turned = done.select(id, F.col("y").alias("x"), F.col("x").alias("y"), (-F.col("preferred")).alias("preferred"))
    return done.select(id, "x", "y", "preferred").unionByName(turned).dropDuplicates([id, "x", "y"])


def _any(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _told(asked: DataFrame, texts: DataFrame, known: DataFrame | None, judge, id: str) -> DataFrame:
    """`asked` (id, i, x, y, sign) with preferred, and whether the judge was asked."""
    asked = asked if known is None else asked.join(known, [id, "x", "y"], "left")
    left = asked if known is None else asked.where("preferred IS NULL").drop("preferred")
    side = lambda c: texts.select(id, F.col("name").alias(c), F.col("content").alias(f"content_{c}"))
    pairs = left.select(id, "x", "y").join(side("x"), [id, "x"]).join(side("y"), [id, "y"]).select(id, "x", "y", "content_x", "content_y")
    judged = left.join(judge(pairs).select(id, "x", "y", F.col("preferred").cast("int").alias("preferred")), [id, "x", "y"], "left").withColumn("judged", F.lit(True))
    out = judged if known is None else judged.unionByName(asked.where("preferred IS NOT NULL").withColumn("judged", F.lit(False)))
    return out.select(id, "i", "sign", "x", "y", "preferred", "judged")
