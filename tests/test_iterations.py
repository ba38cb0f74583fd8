"""Jobs that iterate over tables, held against plain forms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import datasets, ranking, vectors
from loomwright.operators.patterns import occurrences
from loomwright.plans.adaptive import adaptive_tournament

SAMPLES = "sample_id string, name string, pos int, content string"


def judged_by(scores: dict, seen: list | None = None):
    """A judge that prefers the higher score; None where a score is None."""
    table = [(s, n, v) for (s, n), v in scores.items()]

    def judge(pairs):
        spark = pairs.sparkSession
        if seen is not None:
            seen.extend(tuple(r) for r in pairs.select("sample_id", "x", "y").collect())
        v = spark.createDataFrame(table, "sample_id string, name string, v double")
        side = lambda c: v.select("sample_id", F.col("name").alias(c), F.col("v").alias(f"v_{c}"))
        both = pairs.join(side("x"), ["sample_id", "x"]).join(side("y"), ["sample_id", "y"])
        return both.withColumn("preferred", F.when(F.col("v_x") > F.col("v_y"), 1).when(F.col("v_x") < F.col("v_y"), -1))

    return judge


def test_adaptive_rounds_judge_few_pairs_and_rank_right(spark):
    rng = random.Random(4)
    sizes = {"one": 1, "two": 2, "three": 3, "six": 6}
    scores = {(s, f"n{i}"): float(v) for s, n in sizes.items() for i, v in enumerate(rng.sample(range(100), n))}
    rows = [(s, name, int(name[1:]), f"text of {name}") for s, name in scores]
    rng.shuffle(rows)
    seen = []
    rankings, made = adaptive_tournament(spark.createDataFrame(rows, SAMPLES), judged_by(scores, seen))
    got = {r.sample_id: (r.ranking, r.status) for r in rankings.collect()}
    assert got == {s: (sorted((n for t, n in scores if t == s), key=lambda n: -scores[s, n]), "ranked") for s in sizes}
    assert len(set(seen)) == len(seen) == made.count()
    for s, n in sizes.items():
        assert sum(t == s for t, _, _ in seen) <= n * math.log2(n)
    assert all(int(x[1:]) < int(y[1:]) for _, x, y in seen)  # the one that stands first in the sample is x


def test_adaptive_rounds_take_up_what_was_told(spark):
    scores = {("s", f"n{i}"): float(i * 3 % 5) for i in range(5)} | {("t", "n0"): 1.0, ("t", "n1"): 1.0, ("t", "n2"): 5.0}
    frame = spark.createDataFrame([(s, n, int(n[1:]), "") for s, n in scores], SAMPLES)
    rankings, made = adaptive_tournament(frame, judged_by(scores))
    want = {r.sample_id: (r.ranking, r.status) for r in rankings.collect()}
    assert want["t"] == (None, "undecided") and want["s"][1] == "ranked"
    told = [(r.sample_id, r.y, r.x, -r.preferred) for r in made.collect() if r.preferred]  # the other way round
    seen = []
    rankings, rest = adaptive_tournament(frame, judged_by(scores, seen), done=spark.createDataFrame(told[::2], "sample_id string, x string, y string, preferred int"))
    assert {r.sample_id: (r.ranking, r.status) for r in rankings.collect()} == want
    assert not {(s, x, y) for s, x, y in seen} & {(s, y, x) for s, x, y, _ in told[::2]} and rest.where("NOT judged").count() > 0


def test_adaptive_rounds_of_no_samples(spark):
    rankings, made = adaptive_tournament(spark.createDataFrame([], SAMPLES), judged_by({("a", "b"): 1.0}))
    assert rankings.collect() == [] and made.collect() == []


@pytest.mark.parametrize("block", [100_000, 3])
def test_occurrences_of_many_patterns(spark, block):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice(["a", "b", "ab", "é", "🙂", " "]) for _ in range(n))
    texts = [(i, make(rng.randrange(60))) for i in range(40)] + [(40, None), (41, ""), (None, "abab"), (3, "aaa"), (3, "aaa"), (42, "ab" * 50_000)]
    patterns = sorted({make(rng.randrange(1, 4)) for _ in range(20)} | {"aa", "ab", "abab", "nowhere"})
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("pattern", F.lit(1)).repartition(3)
    asked = spark.createDataFrame([(p,) for p in [*patterns, "", None, "ab"]], "pattern string")
    got = sorted(map(tuple, occurrences(frame, asked, "doc_id", block=block).collect()), key=repr)
    count = lambda t, p: sum(t.startswith(p, i) for i in range(len(t)))
    assert got == sorted(((i, p, n) for i, t in texts if t for p in patterns if (n := count(t, p))), key=repr)
    assert occurrences(frame, asked.limit(0), "doc_id").collect() == []


def test_interim_isotropy_has_no_window_over_all(spark, monkeypatch):
    monkeypatch.setattr(datasets, "RANGE_ROWS", 4)
    rows = spark.createDataFrame([(i, (i * 37 % 11) / 11) for i in range(23)], "s long, similarity double").repartition(4)
    got = {r.sequences: r.isotropy for r in vectors.interim(rows, "s", 5).collect()}
    assert got == {n: pytest.approx(1 - sum((i * 37 % 11) / 11 for i in range(n)) / n) for n in (5, 10, 15, 20)}


def test_pairs_of_names(spark):
    rows = [("s", "a", 0, "x"), ("s", "b", 1, "y"), ("s", "c", 2, "z"), ("t", "a", 0, "w")]
    frame = spark.createDataFrame(rows, SAMPLES)
    done = spark.createDataFrame([("s", "a", "c", 1)], "sample_id string, x string, y string, preferred int")
    assert sorted((r.sample_id, r.x, r.y, r.content_x, r.content_y) for r in ranking.comparisons_to_make(frame, done=done).collect()) == [("s", "a", "b", "x", "y"), ("s", "b", "c", "y", "z")]
    fixed = spark.createDataFrame([("c", "a"), ("a", "b")], "x string, y string")
    assert sorted((r.x, r.y) for r in ranking.comparisons_to_make(frame, fixed).collect()) == [("a", "b"), ("c", "a")]


def test_closure_of_very_many_names(spark):
    """300 names a sample, by chains of single comparisons: seconds, not hours."""
    chain = spark.createDataFrame([("s", f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(299)], "sample_id string, x string, y string, preferred int")
    assert ranking.closure(ranking.decided(chain)).count() == 300 * 299 // 2
    r = ranking.tournament(chain).first()
    assert r.status == "ranked" and r.ranking == [f"n{i:03d}" for i in range(300)]
