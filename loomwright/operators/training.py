"""Features and metrics of sequence-to-sequence training: hashed ids, collation, accuracy, perplexity."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import attention_mask, ended, padded, shifted_right, truncated
from ..functions.text import tokens

IGNORED = -100


def hashed_ids(text: Column, size: int = 32_000, reserved: int = 3) -> Column:
    """A vocabulary-free tokenizer: each token's number from its md5, above the reserved ids. Any engine can repeat it."""
    number = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % (size - reserved) + reserved).cast("int")
    return F.transform(tokens(text), number)


def model_inputs(pairs: DataFrame, source: str, target: str, max_source: int, max_target: int, eos: int, start: int) -> DataFrame:
    """Adds input_ids, labels and decoder_input_ids: truncated ids, and the labels shifted right."""
    out = pairs.withColumn("input_ids", truncated(F.col(source), max_source, eos)).withColumn("labels", ended(F.col(target), max_target, eos))
    return out.withColumn("decoder_input_ids", shifted_right(F.col("labels"), start))


def collated(rows: DataFrame, batch: str, pad: int) -> DataFrame:
    """Pads input_ids, attention_mask, decoder_input_ids and labels (with -100) to their batch's longest."""
    w = Window.partitionBy(batch)
    out = rows.withColumn("_in", F.max(F.size("input_ids")).over(w)).withColumn("_out", F.max(F.size("labels")).over(w))
    return out.select(
        *[c for c in rows.columns if c not in ("input_ids", "labels", "decoder_input_ids")],
        padded(F.col("input_ids"), F.col("_in"), pad).alias("input_ids"),
        attention_mask(F.col("input_ids"), F.col("_in")).alias("attention_mask"),
        padded(F.col("decoder_input_ids"), F.col("_out"), pad).alias("decoder_input_ids"),
        padded(F.col("labels"), F.col("_out"), IGNORED).alias("labels"),
    )


def active(labels: Column, predictions: Column) -> Column:
    """Pairs of label and prediction of the places that count."""
    return F.filter(F.arrays_zip(labels.alias("label"), predictions.alias("prediction")), lambda x: x["label"] != IGNORED)


def token_accuracy(rows: DataFrame, labels: str, predictions: str) -> DataFrame:
    """One row: the part of active labels that are predicted; null without any."""
    pairs = rows.select(active(F.col(labels), F.col(predictions)).alias("a"))
    hit = F.size(F.filter("a", lambda x: x["label"] == x["prediction"]))
    return pairs.agg(F.try_divide(F.sum(hit).cast("double"), F.sum(F.size("a")).cast("double")).alias("accuracy"))


def perplexity(rows: DataFrame, log_prob: str) -> DataFrame:
    """One row: exp of the mean negative log-probability of the labels, at most 1e5."""
    return rows.agg(F.exp(F.least(-F.avg(log_prob), F.lit(math.log(1e5)))).alias("perplexity"))


def label_log_probs(logits: Column, labels: Column) -> Column:
    """An array of the log-probability of each label that counts, from a row of logits a place (log-softmax, shifted by its
    largest logit so that it does not overflow)."""
    pairs = F.filter(F.arrays_zip(logits.alias("logits"), labels.alias("label")), lambda x: x["label"] != IGNORED)

    def one(x):
        top = F.array_max(x["logits"])
        total = F.aggregate(x["logits"], F.lit(0.0).cast("double"), lambda a, v: a + F.exp(v.cast("double") - top))
        return F.get(x["logits"], x["label"]).cast("double") - top - F.log(total)

    return F.transform(pairs, one)


def perplexity_of_logits(rows: DataFrame, logits: str, labels: str) -> DataFrame:
    """One row: perplexity over all active labels of all rows; each row's own labels pick its own logits."""
    each = rows.select(F.explode(label_log_probs(F.col(logits), F.col(labels))).alias("log_prob"))
    return perplexity(each, "log_prob")


def cross_encoder_ids(document: Column, hypothesis: Column, sep: int, eos: int) -> Column:
    """The ids a cross-encoder scores: document, separator, hypothesis, end."""
    return F.concat(document, F.array(F.lit(sep)), hypothesis, F.array(F.lit(eos)))
