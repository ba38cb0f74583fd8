"""Quality rules of a document and of its host.

Each document is counted and judged alone (base rules). Then failures are aggregated by host, each host's failure rate is
shrunk to the corpus by a beta prior fitted to the hosts' rates by moments, and documents of hosts whose shrunk rate is
over the limit are rejected too. Only counts are shuffled, pre-aggregated by host, never texts.
"""

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import has_columns, map_columns
from ._workspace import Workspace

MIN_WORDS, MAX_REPEAT_PERCENT, MAX_HOST_RATE = 50, 50, 0.5
#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside windows of n words that occur twice or more, the first occurrence included."""
    if len(words) < n:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    key = w[: len(w) - n + 1]
    for i in range(1, n):
        # exact: pairs are renumbered whenever the product could leave 63 bits
        if len(ids) * (int(key.max()) + 1) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + w[i : len(w) - n + 1 + i]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    covered = np.zeros(len(w), bool)
    for i in range(n):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def count_text(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    ink = text.translate(None, _SPACE)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(ink.decode()), len(ink) - len(ink.translate(None, SYMBOLS)), len(lines) - len(Counter(lines)), repeated_words(words)


def judged(documents: DataFrame, text: str = "text", id: str = "doc_id", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept.

    One row a row of documents. Null text counts as empty and fails the base rules; very long texts are counted whole; null
    hosts are one host; repeated rows count as often as they occur; a single host, or hosts of one rate, have the raw mean
    rate; an empty table gives an empty result. Columns besides the three are not read, whatever their names.
    """

    def start():
        def step(columns):
            ids, hosts, texts = columns
            hosts = [x if x is None else x.decode() for x in hosts]
            return [ids, hosts, *([list(x) for x in zip(*map(count_text, texts))] or [[]] * len(COUNTS))]

        return step

    rows = has_columns(documents, doc_id=(id, "long"), host=(host, "string"), text=(text, "string"))
    counted = map_columns(rows, start, "doc_id long, host string, " + ", ".join(f"{x} long" for x in COUNTS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # a written table of counts: both the hosts' rates and the join read it, so texts are read once
    counted = Workspace(documents.sparkSession, "rules").table(counted.withColumn("base_failed", failed), "counted")
    hosts = host_rates(counted)
    joined = counted.join(hosts, counted.host.eqNullSafe(hosts.of_host)).drop("of_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))


def host_rates(judged_rows: DataFrame) -> DataFrame:
    """of_host, host_rate: the posterior mean of each host's failure rate under the fitted beta prior.

    With mean m and variance v of the hosts' raw rates, the prior has a + b = m (1 - m) / v - 1 pseudo-documents, at
    least one; where v is zero, the rate is m.
    """
    hosts = judged_rows.groupBy(F.col("host").alias("of_host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("bad"))
    m, v = hosts.agg(F.avg(F.col("bad") / F.col("n")), F.var_pop(F.col("bad") / F.col("n"))).first()  # one row, nulls without hosts
    if not v:
        return hosts.select("of_host", F.lit(m).cast("double").alias("host_rate"))
    weight = max(m * (1 - m) / v - 1, 1.0)
    return hosts.select("of_host", ((F.col("bad") + weight * m) / (F.col("n") + weight)).alias("host_rate"))
