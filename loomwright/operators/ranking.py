"""Rankings of candidates, their agreement, and preferences between pairs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(candidates: DataFrame, id: str, pos: str, score: str) -> DataFrame:
    """id, ranking: each item's candidate numbers (1-based positions), best score first, ties in input order."""
    order = F.struct((-F.col(score)).alias("s"), F.col(pos).alias("p"))
    best = F.array_sort(F.collect_list(order))
    return candidates.groupBy(id).agg(F.transform(best, lambda x: (x["p"] + 1).cast("int")).alias("ranking"))


def identity_ranking(outputs: Column) -> Column:
    """The ranking of items that stand in order of preference already."""
    return F.when(F.size(outputs) > 0, F.sequence(F.lit(1), F.size(outputs))).otherwise(F.array().cast("array<int>"))


def agreement(ranking: Column, references: Column) -> Column:
    """Of the pairs on whose order all references agree, the part that `ranking` orders as the first reference does.

    Null where no pair is left. An id that a reference misses is an error.
    """
    n = F.size(ranking)
    known = F.forall(references, lambda r: F.size(F.array_except(ranking, r)) == 0)
    pairs = F.flatten(F.transform(ranking, lambda a, i: F.transform(F.slice(ranking, i + 2, n), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    diff = lambda r, p: F.array_position(r, p["a"]) - F.array_position(r, p["b"])
    first = F.element_at(references, 1)
    agreed = F.filter(pairs, lambda p: F.forall(references, lambda r: diff(r, p) * diff(first, p) >= 0))
    same = F.filter(agreed, lambda p: diff(first, p) < 0)
    return F.when(F.assert_true(known, F.lit("a reference ranking misses an id")).isNull(), F.try_divide(F.size(same).cast("double"), F.size(agreed).cast("double")))


def by_position(**tables: DataFrame) -> DataFrame:
    """Rows of several tables joined on their explicit ordinal `row_id`; each table's other columns as a struct."""
    out = None
    for name, frame in tables.items():
        part = frame.select("row_id", F.struct(*[c for c in frame.columns if c != "row_id"]).alias(name))
        out = part if out is None else out.join(part, "row_id")
    return out


def latest_by_name(names: Column, values: Column) -> Column:
    """A map from name to value; of repeated names the last wins."""
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.transform(F.slice(names, i + 2, F.size(names)), lambda n: n), x["k"]))
    return F.map_from_entries(last)


def comparisons_to_make(samples: DataFrame, pairs: DataFrame | None = None, done: DataFrame | None = None, id: str = "sample_id") -> DataFrame:
    """Each sample's pairs (x, y) of candidate names that it has both, without those in `done`.

    `samples` has id, name and content by candidate. `pairs` is a fixed list of ordered pairs of names; without it, `samples`
    has `pos` too, and each name is x of a sample's later ones.
    """
    x = samples.select(id, F.col("name").alias("x"), F.col("content").alias("content_x"), *([F.col("pos").alias("_x")] if pairs is None else []))
    y = samples.select(id, F.col("name").alias("y"), F.col("content").alias("content_y"), *([F.col("pos").alias("_y")] if pairs is None else []))
    out = x.join(y, id).where("_x < _y").drop("_x", "_y") if pairs is None else x.join(pairs, "x").join(y, [id, "y"])
    return out if done is None else out.join(done.select(id, "x", "y"), [id, "x", "y"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of equal keys the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = both.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"))))
    return last.where("_rank = 1").drop("_new", "_rank")


def _words(places: Column, n: Column) -> Column:
    """A set of places from 0 to n - 1 as an array of longs, a bit a place."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63))
    word = lambda q: F.aggregate(F.filter(places, lambda x: F.shiftright(x, 6) == q), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x)))
    return F.transform(F.sequence(F.lit(0), F.shiftright(n - 1, 6)), word)


def _has(words: Column, place: Column) -> Column:
    return F.call_function("shiftright", F.get(words, F.shiftright(place, 6)), place.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long")) == 1


def _reached(edges: DataFrame, id: str, names: DataFrame | None = None) -> DataFrame:
    """id, names, reach: a sample's names in order, and of each name the set of those that it beats over chains of any length.

    Names are numbered in their row, and a set is an array of longs: with n names a sample, n^2 unions of n / 64 longs
    (Warshall). `names` (id, names) adds names without an edge."""
    out = edges.groupBy(id, "w").agg(F.collect_set("l").alias("ls")).groupBy(id).agg(F.collect_list(F.struct("w", "ls")).alias("lists"))
    met = F.concat(F.transform("lists", lambda e: e["w"]), F.flatten(F.transform("lists", lambda e: e["ls"])))
    if names is not None:
        out = names.withColumnRenamed("names", "_all").join(out, id, "left").withColumn("lists", F.coalesce("lists", F.array().cast("array<struct<w:string,ls:array<string>>>")))
        met = F.concat(F.col("_all"), met)
    out = out.select(id, F.array_sort(F.array_distinct(met)).alias("names"), F.map_from_entries("lists").alias("beats"))
    n = F.size("names")
    places = lambda ls: F.transform(ls, lambda x: (F.array_position(F.col("names"), x) - 1).cast("int"))
    first = F.transform("names", lambda x: _words(F.coalesce(places(F.try_element_at("beats", x)), F.array().cast("array<int>")), n))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    join = lambda rows, k: F.transform(rows, lambda r: F.when(_has(r, k), F.zip_with(r, F.get(rows, k), lambda a, b: a.bitwiseOR(b))).otherwise(r))
    # the first sets are a column of their own, so that they are made once
    return out.withColumn("first", first).select(id, "names", F.aggregate(steps, F.col("first"), join).alias("reach"))


def decided(comparisons: DataFrame, id: str = "sample_id") -> DataFrame:
    """id, w, l of the comparisons (x, y, preferred: 1 for x, -1 for y) that have a winner."""
    won = F.when(F.col("preferred") == 1, F.col("x")).otherwise(F.col("y"))
    lost = F.when(F.col("preferred") == 1, F.col("y")).otherwise(F.col("x"))
    return comparisons.where(F.col("preferred").isin(1, -1)).select(id, won.alias("w"), lost.alias("l"))


def tournament(comparisons: DataFrame, id: str = "sample_id") -> DataFrame:
    """id, ranking (names, best first), status.

    `comparisons` has x, y and preferred (1 for x, -1 for y, else none). Comparisons that follow from others need not be
    there: a sample has a ranking ('ranked') when the closure of its decided comparisons orders all its names. If the
    closure puts a name over itself, the sample is 'cyclic'; if names are left whose order does not follow, 'incomplete'.
    Both have a null ranking.
    """
    named = comparisons.groupBy(id).agg(F.array_distinct(F.flatten(F.collect_set(F.array("x", "y")))).alias("names"))
    per = _reached(decided(comparisons, id), id, named)
    n = F.size("names")
    beaten = F.transform("reach", lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + F.bit_count(x)))
    per = per.withColumn("beaten", beaten).withColumn("cyclic", F.exists(F.sequence(F.lit(0), n - 1), lambda i: _has(F.get("reach", i), i)))
    total = F.aggregate("beaten", F.lit(0), lambda a, x: a + x) == n * (n - 1) / 2
    order = F.transform(F.array_sort(F.zip_with("names", "beaten", lambda x, b: F.struct((-b).alias("b"), x.alias("name")))), lambda x: x["name"])
    status = F.when(F.col("cyclic"), "cyclic").when(total, "ranked").otherwise("incomplete")
    return per.select(id, F.when(~F.col("cyclic") & total, order).alias("ranking"), status.alias("status"))


def closure(edges: DataFrame, id: str = "sample_id") -> DataFrame:
    """id, w, l: who beats whom over chains of comparisons of any length; (a, a) tells a cycle."""
    # outer, as Spark would otherwise test the sets' size before it makes them, by making them
    per = _reached(edges, id).select(id, "names", F.posexplode_outer("reach").alias("i", "r"))
    lost = F.filter("names", lambda x, j: _has(F.col("r"), j))
    return per.select(id, F.get("names", F.col("i")).alias("w"), F.explode_outer(lost).alias("l")).where("l IS NOT NULL")


def undecided(pairs: DataFrame, comparisons: DataFrame, id: str = "sample_id") -> DataFrame:
    """Of pairs (id, x, y, ...), those whose order does not follow from the decided comparisons: what a judge still has to see."""
    known = closure(decided(comparisons, id), id)
    either = known.select(id, F.col("w").alias("x"), F.col("l").alias("y")).unionByName(known.select(id, F.col("l").alias("x"), F.col("w").alias("y")))
    return pairs.join(either.distinct(), [id, "x", "y"], "left_anti")
