"""Generation, judging and evaluation jobs around pluggable models.

A model runs in `mapInPandas`, loaded once a task; the classes here that need no model stand in for one in tests.
"""

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import filled, latex_escaped, preferred_name
from ..operators import ranking, rouge

#: Length presets by dataset (output, input).
PRESETS = {"vietnews": (200, None), "xsum": (80, 512), "cnndm": (120, 1024)}


class Generator(Protocol):
    """Makes an output of each input; `load` runs once a task."""

    def load(self) -> None: ...

    def generate(self, inputs: list[str]) -> list[str]: ...


class Scorer(Protocol):
    """Scores pairs of texts; `load` runs once a task."""

    def load(self) -> None: ...

    def score(self, first: list[str], second: list[str]) -> list[float]: ...


class LeadingWords:
    """Stands in for a generator: the first n words."""

    def __init__(self, n: int):
        self.n = n

    def load(self) -> None: ...

    def generate(self, inputs: list[str]) -> list[str]:
        return [" ".join((x or "").split()[: self.n]) for x in inputs]


class Overlap:
    """Stands in for a learned scorer: the part of the second text's words that the first has."""

    def load(self) -> None: ...

    def score(self, first: list[str], second: list[str]) -> list[float]:
        out = []
        for a, b in zip(first, second):
            words = (b or "").split()
            have = set((a or "").split())
            out.append(sum(w in have for w in words) / len(words) if words else 0.0)
        return out


def generated(rows: DataFrame, model: Generator, done: DataFrame | None = None, batch: int = 10, id: str = "id", source: str = "input") -> DataFrame:
    """id, input, output of all rows that `done` (an earlier run's output) does not have."""
    todo = rows if done is None else rows.join(done.select(id).distinct(), id, "left_anti")
    kind = todo.schema[id].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.load()
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield part.assign(output=model.generate(part["input"].tolist()))[["id", "input", "output"]]

    return todo.select(F.col(id).alias("id"), F.col(source).alias("input")).mapInPandas(run, f"id {kind}, input string, output string")


def scored(rows: DataFrame, model: Scorer, first: str, second: str, batch: int = 64) -> DataFrame:
    """`rows` without the two texts, and their score."""
    rest = [f for f in rows.schema.fields if f.name not in (first, second)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.load()
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield part[[f.name for f in rest]].assign(score=model.score(part[first].tolist(), part[second].tolist()))

    return rows.mapInPandas(run, f"{ddl}, score double")


def ranked_by_scorer(candidates: DataFrame, model: Scorer, id: str, pos: str, reference: str, hypothesis: str, batch: int = 64) -> DataFrame:
    """id, ranking: each item's candidates (places from 1), best score first, ties in input order."""
    each = scored(candidates.select(id, pos, reference, hypothesis), model, reference, hypothesis, batch)
    return ranking.ranked(each.withColumn("score", F.round("score", 9)), id, pos, "score")


class RewardModel(Protocol):
    """Rewards triples of document, hypothesis and reference; `load` runs once a task."""

    def load(self) -> None: ...

    def reward(self, documents: list[str], hypotheses: list[str], references: list[str]) -> list[float]: ...


def rewarded(rows: DataFrame, model: RewardModel, document: str, hypothesis: str, reference: str, batch: int = 64) -> DataFrame:
    """`rows` with `reward`, from all three texts."""
    kinds = T.StructType([*rows.schema.fields, T.StructField("reward", T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.load()
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield part.assign(reward=model.reward(*(part[c].tolist() for c in (document, hypothesis, reference))))

    return rows.mapInPandas(run, kinds)


def evaluated(pairs: DataFrame, id: str, hyp: str, ref: str, mode: str = "all", ns: tuple[int, ...] = (1, 2)) -> DataFrame:
    """One row: macro ROUGE (mode 'metric'), the mean ROUGE-1 reward ('reward'), or both ('all')."""
    if mode not in ("metric", "reward", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    each = rouge.rouge(pairs, id, hyp, ref, ns if mode != "reward" else (1,))
    reward = F.avg("rouge1_f").alias("mean_reward")
    if mode == "reward":
        return each.agg(reward)
    means = each.agg(*([reward] if mode == "all" else []), *(F.avg(f"rouge{n}_{x}").alias(f"rouge{n}_{x}") for n in ns for x in "pr"))
    return means.select(*means.columns, *(rouge.f_score(F.col(f"rouge{n}_p"), F.col(f"rouge{n}_r")).alias(f"rouge{n}_f") for n in ns))


def listwise_prompt(template: str, article: Column, items: Column) -> Column:
    """A prompt that asks to rank named summaries; `items` has name and content."""
    listed = F.array_join(F.transform(items, lambda o: F.concat(F.lit("[ID="), o["name"], F.lit("] "), o["content"])), "\n--------------\n")
    return filled(template, article=article, summaries=listed)


def preferences(comparisons: DataFrame) -> DataFrame:
    """Adds `preferred` (1 for x, -1 for y, null when the completion names none or several) and `warning`."""
    name = preferred_name(F.col("completion"), F.array("x", "y"))
    out = comparisons.withColumn("_name", name)
    sign = F.when(F.col("_name") == F.col("x"), 1).when(F.col("_name") == F.col("y"), -1).cast("int")
    return out.withColumn("preferred", sign).withColumn("warning", F.when(F.col("_name").isNull(), F.lit("undecided"))).drop("_name")


def classified_errors(replies: DataFrame, error: str = "error") -> DataFrame:
    """Adds error_type: null without an error, 'graceful' for a JSON error object, 'unexpected' for any other text."""
    kind = F.when(F.col(error).isNull(), F.lit(None)).when(F.try_parse_json(F.col(error)).isNotNull(), "graceful").otherwise("unexpected")
    return replies.withColumn("error_type", kind.cast("string"))


def latex_lines(rows: DataFrame, number: str, columns: list[str], numbered: bool = False) -> DataFrame:
    """`rows` with `line`: a table row, every second one banded; `number` counts rows from 1."""
    cells = [latex_escaped(F.col(c).cast("string")) for c in columns]
    cells = [F.col(number).cast("string"), *cells] if numbered else cells
    band = F.when(F.col(number) % 2 == 0, F.lit("\\rowcolor{light-gray}")).otherwise(F.lit(""))
    return rows.withColumn("line", F.concat(band, F.concat_ws(" & ", *cells), F.lit("\\\\")))


def presets(spark: SparkSession) -> DataFrame:
    rows = [(k, o, i) for k, (o, i) in PRESETS.items()]
    return spark.createDataFrame(rows, "dataset string, max_output int, max_input int")
