"""A corpus from raw documents to packed training sequences, in stages that are written and read again."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import decontaminate, packing, simhash, substring, toxicity
from loomwright.llm._workspace import Workspace


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more. The model learns from labelled documents of this stage's input; without
    any, all scores are low. Null and empty texts have the bias's score, repeated rows have one score, very long texts are
    scored whole; an empty table gives an empty result; all columns stay, whatever their names."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.Toxicity(spark, docs, labels, learn=toxicity.held_in()).accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 or more over five-word shingles, the document with the
    smallest id stays. Null and empty texts are one group; other cases are those of `simhash.deduplicated`."""
    return simhash.deduplicated(spark, docs, similar_by=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every word that a window of 35 words covers which occurs twice or more in this stage's input. Texts that
    lose none, null and short ones among them, stay as they are; a text that loses all its words stays as an empty one; other
    cases are those of `substring.SubstringDedup`."""
    dedup = substring.SubstringDedup(spark, docs)
    out = dedup.applied(docs, length="n_chars")
    dedup.drop()
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which a benchmark item occurs within its error budget. Null and empty texts stay; other cases
    are those of `decontaminate.clean`."""
    return decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of up to 2,048 tokens, of all texts that remain: bin_id, bin_used, doc_ids, and pieces (doc_id,
    piece, piece_start, length, text) in order. A text without tokens has a row of its own with null bin_id; other cases
    are those of `packing.sequences`."""
    cutter = packing.TokenPieces(packing.CAPACITY, str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = packing.sequences(spark, docs, cutter=cutter)
    return rows.withColumn("doc_ids", F.transform("pieces", lambda p: p["doc_id"]))


#: Each takes what the one before it kept, reread from Parquet.
STAGES = [("toxicity", toxicity_filter), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: Learning, fingerprints and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
