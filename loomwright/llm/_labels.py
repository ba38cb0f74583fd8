"""Bounded training samples: labelled ids first, then only their texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crc_mod(column: str, by: int):
    """crc32 of the id as text, modulo `by`; null ids count as text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null"))) % by


def sampled(labels: DataFrame, label: str, learn, bound: int, id: str = "doc_id") -> DataFrame:
    """doc_id, y of at most `bound` labelled ids for which `learn` holds, in the order of their hash.

    Ids that are labelled repeatedly count once with their largest label; null ids or labels are left out.
    """
    rows = labels.select(F.col(id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(learn)
    return rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
