"""Sinks. All write in parallel part files; a driver-side render is kept to reports that are small by nature."""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.datasets import numbered
from ..plans.generation import latex_lines


def records(frame: DataFrame, path: str, order: list[Column] | None = None, append: bool = False) -> None:
    """A record store. With `order`, rows get an ordinal `row_id` from 0 and lie in that order; else they must have one."""
    if order:
        frame = numbered(frame, order).withColumn("row_id", F.col("_n") - 1).drop("_n")
    if "row_id" not in frame.columns:
        raise ValueError("a record store needs row_id")
    frame.write.mode("append" if append else "errorifexists").parquet(path)


def append_records(frame: DataFrame, path: str, order: list[Column]) -> None:
    """Appends rows, in order, behind the last ordinal of a store, or makes it. One appender at a time: two would give the
    same ordinals. `recordfile.write_records` refuses the second of two."""
    spark = frame.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    last = spark.read.parquet(path).agg(F.max("row_id")).first()[0] if there else None
    first = 0 if last is None else last + 1
    rows = numbered(frame.drop("row_id"), order)
    rows.withColumn("row_id", F.col("_n") - 1 + first).drop("_n").write.mode("append").parquet(path)


def jsonl(frame: DataFrame, path: str, append: bool = True) -> None:
    frame.write.mode("append" if append else "errorifexists").option("ignoreNullFields", False).json(path)


def csv(frame: DataFrame, path: str) -> None:
    """Fields keep the white space at their ends; null is nothing, and an empty string is two quotes."""
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    frame.write.options(header=True, quote='"', escape='"', **exact).csv(path)


def rankings(frame: DataFrame, path: str, ranking: str = "ranking") -> None:
    """One ranking a line, '2, 1, 3'."""
    frame.select(F.array_join(F.transform(ranking, lambda x: x.cast("string")), ", ").alias("value")).write.text(path)


def numbers(frame: DataFrame, path: str, value: str) -> None:
    """One number a line; null is an empty line."""
    frame.select(F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value")).write.text(path)


def samples(frame: DataFrame, path: str, times: tuple[str, ...] = ("createdAt", "updatedAt")) -> None:
    """Filtered samples as JSON lines, with their timestamps as strings."""
    frame.withColumns({c: F.col(c).cast("string") for c in times}).write.json(path)


def both_formats(frame: DataFrame, path: str, kind: str) -> None:
    """A sample as JSON lines, as records, or as both."""
    if kind not in ("jsonl", "records", "both"):
        raise ValueError(f"unknown output format {kind!r}")
    if kind in ("jsonl", "both"):
        frame.write.json(f"{path}/jsonl")
    if kind in ("records", "both"):
        frame.write.parquet(f"{path}/records")


def comparisons(frame: DataFrame, path: str) -> None:
    """Comparisons as JSON lines, with sample_id, x and y as columns of their own; nulls are kept. A later run appends."""
    if missing := {"sample_id", "x", "y", "preferred"} - set(frame.columns):
        raise ValueError(f"comparisons need {sorted(missing)}")
    jsonl(frame, path)


def stats(spark, values: dict, path: str) -> None:
    """Appends one row of statistics."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").write.mode("append").text(path)


def isotropy_report(score: float | None, sequences: int) -> str:
    return f"Sequences: {sequences}\nIsotropy: {'undefined' if score is None else f'{score:.6f}'}\n"


def latex_table(rows: DataFrame, order: list[Column], columns: list[str], layout: list[float], width: float, template: str, add_order: bool = False) -> str:
    """A LaTeX document of a table that is small enough to print. `template` has {width}, {layout} and {content}."""
    names = (["ID"] if add_order else []) + columns
    if len(layout) != len(names):
        raise ValueError("the layout needs a width for each column")
    body = latex_lines(numbered(rows, order), "_n", columns, add_order).orderBy("_n")
    # fixed values: the column layout of the printed table
    size = [rf"{x}\linewidth-2\tabcolsep-.6pt" for x in layout]
    spec = "".join(("P" if add_order and i == 0 else "p") + "{" + s + "}" for i, s in enumerate(size))
    bold = [rf"\textbf{{{n}}}" if add_order and i == 0 else rf"\multicolumn{{1}}{{P{{{s}}}}}{{\textbf{{{n}}}}}" for i, (n, s) in enumerate(zip(names, size))]
    content = r"\rowcolor{light-gray}" + " & ".join(bold) + "\\\\\n" + "".join(r["line"] + "\n" for r in body.select("line").toLocalIterator())
    return template.replace("{width}", str(width)).replace("{layout}", spec).replace("{content}", content)

