"""ROUGE-N and its averages over tables of pairs.

Pairs are dealt once by id, so what is shuffled are the texts, not their n-grams. A pair's n-grams are counted within its row: both
sides' are sorted together and walked once. So a task holds one pair's n-grams, not those of all pairs that are dealt to it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import ngrams
from ..functions.text import tokens


def try_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_score(p: Column, r: Column, alpha: float = 0.5) -> Column:
    """R P / (alpha R + (1 - alpha) P); 0 where either is 0."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be between 0 and 1")
    return F.when((p == 0) | (r == 0), F.lit(0.0)).otherwise(r * p / (alpha * r + (1 - alpha) * p))


def weighted(x: Column, weight: float) -> Column:
    """x to the power of 1 / weight; weights are 1 or more."""
    if weight < 1:
        raise ValueError("weight must be at least 1")
    return F.pow(x, F.lit(1.0 / weight))


def scores(matches: Column, hyp: Column, ref: Column, alpha: float = 0.5) -> tuple[Column, Column, Column]:
    """Precision, recall and F of counts."""
    p, r = try_ratio(matches, hyp), try_ratio(matches, ref)
    return p, r, f_score(p, r, alpha)


def gathered(pairs: DataFrame, id: str, **texts: Column) -> DataFrame:
    """id and `rows`: the structs of the named columns of all rows with this id, one row an id."""
    dealt = pairs.select(id, F.struct(*(c.alias(name) for name, c in texts.items())).alias("row")).repartition(F.col(id))
    return dealt.groupBy(id).agg(F.collect_list("row").alias("rows"))


def grams(rows: str, name: str, n: int) -> Column:
    """The n-grams of all `name` (tokens) in gathered rows; none cross from one text to another, a null one has none."""
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(rows, lambda x: F.coalesce(ngrams(x[name], n), none)))


def matches(a: Column, b: Column) -> Column:
    """How many n-grams two arrays share, each as often as both have it."""
    side = lambda c, k: F.transform(c, lambda g: F.struct(g.alias("gram"), F.lit(k).alias("side")))
    state = lambda gram, left, n: F.struct(gram.alias("gram"), left.alias("left"), n.alias("n"))

    def step(s, x):
        left = F.when(x["gram"].eqNullSafe(s["gram"]), s["left"]).otherwise(0)  # of b's, those that no one of a's took yet
        taken = F.when(left > 0, 1).otherwise(0)
        return F.when(x["side"] == 0, state(x["gram"], left + 1, s["n"])).otherwise(state(x["gram"], left - taken, s["n"] + taken))

    start = state(F.lit("").cast("string"), F.lit(0), F.lit(0))
    return F.aggregate(F.sort_array(F.concat(side(b, 0), side(a, 1))), start, step, lambda s: s["n"].cast("long"))


def overlaps_by_size(pairs: DataFrame, id: str, hyp: str, ref: str, ns: tuple[int, ...], tokenized: bool = False) -> DataFrame:
    """id, and for each n matches_n (clipped), hyp_size_n, ref_size_n of each pair, in one exchange for all n.

    Pairs without n-grams, of null texts too, have zeros. Rows with one id are one pair, of the n-grams of all its rows.
    """
    out = gathered(pairs, id, hyp=F.col(hyp), ref=F.col(ref))
    if not tokenized:
        out = out.withColumn("rows", F.transform("rows", lambda x: F.struct(*(tokens(x[side]).alias(side) for side in ("hyp", "ref")))))
    out = out.select(id, *(grams("rows", side, n).alias(f"{side}_{n}") for n in ns for side in ("hyp", "ref")))
    size = lambda c: F.size(c).cast("long")
    return out.select(id, *(x for n in ns for x in (matches(F.col(f"hyp_{n}"), F.col(f"ref_{n}")).alias(f"matches_{n}"), size(f"hyp_{n}").alias(f"hyp_size_{n}"), size(f"ref_{n}").alias(f"ref_size_{n}"))))


def overlaps(pairs: DataFrame, id: str, hyp: str, ref: str, n: int, tokenized: bool = False) -> DataFrame:
    """id, matches, hyp_size, ref_size of each pair, for one n."""
    out = overlaps_by_size(pairs, id, hyp, ref, (n,), tokenized)
    return out.select(id, *(F.col(f"{c}_{n}").alias(c) for c in ("matches", "hyp_size", "ref_size")))


def rouge(pairs: DataFrame, id: str, hyp: str, ref: str, ns: tuple[int, ...] = (1, 2), alpha: float = 0.5, tokenized: bool = False) -> DataFrame:
    """id and rouge{n}_p, rouge{n}_r, rouge{n}_f for each n."""
    out = overlaps_by_size(pairs, id, hyp, ref, ns, tokenized)
    columns = []
    for n in ns:
        p, r, f = scores(F.col(f"matches_{n}"), F.col(f"hyp_size_{n}"), F.col(f"ref_size_{n}"), alpha)
        columns += [p.alias(f"rouge{n}_p"), r.alias(f"rouge{n}_r"), f.alias(f"rouge{n}_f")]
    return out.select(id, *columns)


def macro(scored: DataFrame, ns: tuple[int, ...] = (1, 2), alpha: float = 0.5) -> DataFrame:
    """One row: mean precision and recall of each n, and the F of these means (not the mean of F)."""
    means = scored.agg(*(F.avg(f"rouge{n}_{x}").alias(f"rouge{n}_{x}") for n in ns for x in "pr"))
    return means.select(*means.columns, *(f_score(F.col(f"rouge{n}_p"), F.col(f"rouge{n}_r"), alpha).alias(f"rouge{n}_f") for n in ns))


def micro(counts: DataFrame, alpha: float = 0.5) -> DataFrame:
    """One row: scores of the summed counts. Sums merge, so they can be taken in parts."""
    total = counts.agg(*(F.sum(c).alias(c) for c in ("matches", "hyp_size", "ref_size")))
    p, r, f = scores(F.col("matches"), F.col("hyp_size"), F.col("ref_size"), alpha)
    return total.select("matches", "hyp_size", "ref_size", p.alias("p"), r.alias("r"), f.alias("f"))
