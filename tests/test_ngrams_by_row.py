"""N-grams are counted within a pair's row: repeated ids, null and odd texts, and what a task holds."""

from collections import Counter

from pyspark.sql import functions as F

from loomwright.functions import arrays, text
from loomwright.operators import rouge
from loomwright.plans import catalog


def test_repeated_ids_and_null_texts(spark):
    rows = [(1, "a b a b", "a b b"), (2, None, "x y"), (2, "y x y x", "y x"), (3, None, None), (4, "", "!"), (5, "one", "One, one"), (None, "n n", "n")]
    got = {r[0]: tuple(r)[1:] for r in rouge.overlaps_by_size(spark.createDataFrame(rows, "id long, h string, r string"), "id", "h", "r", (1, 2)).collect()}
    want = {}
    for i in {r[0] for r in rows}:
        out = []
        for n in (1, 2):
            bags = [Counter(), Counter()]
            for row in (r for r in rows if r[0] == i):
                for bag, x in zip(bags, row[1:]):
                    t = (x or "").lower().replace(",", " ").replace("!", " ").split()
                    bag.update(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
            out += [sum((bags[0] & bags[1]).values()), *(sum(b.values()) for b in bags)]
        want[i] = tuple(out)
    assert got == want


def test_ngrams_compute_their_tokens_once(spark):
    """Of a text of 20,000 words, which took a tokenization for each bigram before."""
    frame = spark.createDataFrame([(" ".join(f"w{i % 7}" for i in range(20_000)),)], "t string")
    row = frame.select(arrays.ngrams(text.tokens(F.col("t")), 2).alias("g")).select(F.size("g"), F.size(F.array_distinct("g")), F.col("g")[6]).first()
    assert tuple(row) == (19_999, 7, "w6 w0")


def test_no_ngram_is_a_row(spark, sf):
    for name in ("rouge_pairs", "ngram_counts", "bag_union_intersect"):
        assert "Generate" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
