"""The summary quality filter: reasons to reject a text, samples without a bad output, counters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_punctuation, words

#: Rejected beginnings, the phrase that may not stand in the first words, and the limits.
PREFIXES = ("bài báo", "bài viết", "văn bản")
PHRASE, PHRASE_WORDS, LEAST_KNOWN = "tóm tắt", 8, 0.4


def plain(text: Column) -> Column:
    """What the rules look at; `text` should be NFKC already. Leading punctuation becomes a space, so that it hides a
    rejected beginning."""
    return F.lower(without_punctuation(text))


def reasons(texts: DataFrame, dictionary: DataFrame, id: list[str], text: str, prefixes=PREFIXES, phrase: str = PHRASE) -> DataFrame:
    """The id columns and `reason`: prefix, phrase, empty, unknown, or null for texts that pass, in that order of tests.

    A text's words are made once: they meet the dictionary, which Spark broadcasts when it is small, with what the other rules say
    of the text, and are counted by text, first where they are.
    """
    base = texts.select(*id, plain(F.col(text)).alias("_plain")).select(*id, "_plain", words(F.col("_plain")).alias("_words"))
    starts = F.lit(False)
    for p in prefixes:
        starts = starts | F.col("_plain").startswith(p)
    told = F.contains(F.array_join(F.slice("_words", 1, PHRASE_WORDS), " "), F.lit(phrase))
    each = base.select(*id, starts.alias("_starts"), told.alias("_phrase"), F.size("_words").alias("_size"), F.explode_outer("_words").alias("word"))
    marked = each.join(dictionary.select("word").distinct().withColumn("_in", F.lit(1)), "word", "left")
    counted = marked.groupBy(*id).agg(*(F.first(c).alias(c) for c in ("_starts", "_phrase", "_size")), F.coalesce(F.sum("_in"), F.lit(0)).alias("_known"))
    ratio = F.try_divide(F.col("_known"), F.col("_size"))
    reason = F.when(F.col("_starts"), "prefix").when(F.col("_phrase"), "phrase").when(F.col("_size") == 0, "empty").when(ratio <= LEAST_KNOWN, "unknown")
    return counted.select(*id, reason.alias("reason"))


def accepted_samples(samples: DataFrame, judged: DataFrame, id: str) -> DataFrame:
    """Samples none of whose outputs is rejected."""
    return samples.join(judged.where("reason IS NOT NULL").select(id).distinct(), id, "left_anti")


def reason_counts(judged: DataFrame, id: str, pos: str) -> DataFrame:
    """reason, n: by sample the first rejected output only, as the first ends a sample's test."""
    first = judged.where("reason IS NOT NULL").groupBy(id).agg(F.min_by("reason", pos).alias("reason"))
    return first.groupBy("reason").agg(F.count("*").alias("n"))
