"""Rewards: means, baselines, advantages and best-so-far, over steps of independent sequences."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def statistics(frame: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation (null for one row), count and sum of a reward, overall or by group."""
    aggs = (F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"), F.sum(value).alias("total"))
    return frame.groupBy(*(by or [])).agg(*aggs)


def average(frame: DataFrame, value: str) -> DataFrame:
    """One row: the mean reward so far, 0.0 without rows."""
    return frame.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("average"))


def baselines(frame: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """`frame` with `baseline`, the mean of all earlier rewards of its sequence (0.0 for the first), and `advantage`."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.avg(value).over(before), F.lit(0.0))
    return frame.withColumn("baseline", base).withColumn("advantage", F.col(value) - F.col("baseline"))


def seeded(frame: DataFrame, value: str, order: list[str], first: int) -> DataFrame:
    """One row: the mean reward of the first rows, which seeds a baseline."""
    return average(frame.orderBy(*order).limit(first), value)


def every(frame: DataFrame, step: str, n: int) -> DataFrame:
    """Steps at which something is logged or saved."""
    return frame.where(F.col(step) % n == 0)


def best_so_far(frame: DataFrame, metric: str, by: list[str], order: list[str], lower_is_better: bool = False) -> DataFrame:
    """`frame` with `is_best`: strictly better than all earlier rows of its sequence; the metric keeps its sign."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if lower_is_better:
        return frame.withColumn("is_best", F.col(metric) < F.coalesce(F.min(metric).over(before), F.lit(float("inf"))))
    return frame.withColumn("is_best", F.col(metric) > F.coalesce(F.max(metric).over(before), F.lit(float("-inf"))))


#: Size of a sketch; its quantiles' ranks, and those of merged ones, are within RANK_ERROR of exact ones.
SKETCH, RANK_ERROR = 800, 0.01


def sketched(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, sketch: of each group a quantile sketch of some kilobytes, whatever its rows; nulls do not count."""
    return frame.groupBy(*by).agg(F.call_function("kll_sketch_agg_double", F.col(value).cast("double"), F.lit(SKETCH)).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, as of all steps from those that each step has stored."""
    return sketches.groupBy(*by).agg(F.call_function("kll_merge_agg_double", F.col("sketch"), F.lit(SKETCH)).alias("sketch"))


def quantiles(sketches: DataFrame, by: list[str], ps: list[float]) -> DataFrame:
    """by, p, q: approximate quantiles of each sketch."""
    at = F.array(*(F.lit(float(p)) for p in ps))
    pairs = F.arrays_zip(at.alias("p"), F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), at).alias("q"))
    return sketches.select(*by, F.explode(pairs).alias("x")).select(*by, "x.p", "x.q")


def log_rows(columns: DataFrame, id: list[str]) -> DataFrame:
    """Rows of a batch that is stored as one array a column."""
    names = [c for c in columns.columns if c not in id]
    return columns.select(*id, F.explode(F.arrays_zip(*names)).alias("_row")).select(*id, *(F.col(f"_row.{c}").alias(c) for c in names))


def long_enough(frame: DataFrame, response: str, least: int = 4) -> DataFrame:
    """Rows whose response has at least `least` tokens; whole rows go, so that queries and rewards stay aligned."""
    return frame.where(F.size(response) >= least)


def metric(stats: dict, name: str) -> float:
    """A metric by name; a missing one is an error that lists what there is."""
    if name not in stats:
        raise KeyError(f"no metric {name!r}; there are {sorted(stats)}")
    return stats[name]
