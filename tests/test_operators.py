"""Operators on hand-made cases: the quirks, properties, and plans."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import arrays
from loomwright.operators import datasets, quality, ranking, rewards, rouge, training, vectors
from loomwright.plans import decoding, generation, jobs, settings


def python_rouge(h, r, n):
    bag = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    a, b = bag(h.split()), bag(r.split())
    m, x, y = sum((a & b).values()), sum(a.values()), sum(b.values())
    p, q = m / x if x else 0.0, m / y if y else 0.0
    return p, q, 2 * p * q / (p + q) if p and q else 0.0


def test_rouge_cases(spark):
    rng = random.Random(1)
    texts = [("", "a"), ("a", ""), ("", ""), ("a a a", "a"), ("a", "a a a"), ("!!!", "..."), ("a b", "b a"), ("same text here", "same text here")]
    texts += [(" ".join(rng.choices("abcd", k=rng.randrange(12))), " ".join(rng.choices("abcd", k=rng.randrange(12)))) for _ in range(40)]
    pairs = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(texts)], "id long, h string, r string")
    got = {x.id: x for x in rouge.rouge(pairs, "id", "h", "r", ns=(1, 2)).collect()}
    back = {x.id: x for x in rouge.rouge(pairs, "id", "r", "h", ns=(1, 2)).collect()}
    for i, (h, r) in enumerate(texts):
        for n in (1, 2):
            want = python_rouge(h.replace("!", " ").replace(".", " "), r.replace(".", " "), n)
            assert tuple(got[i][f"rouge{n}_{x}"] for x in "prf") == pytest.approx(want)
            assert got[i][f"rouge{n}_p"] == back[i][f"rouge{n}_r"]
    assert got[3].rouge1_p == pytest.approx(1 / 3) and got[3].rouge1_r == 1


def test_rouge_shuffles_once(spark):
    pairs = spark.createDataFrame([(1, "a", "b")], "id long, h string, r string")
    plan = rouge.overlaps(pairs, "id", "h", "r", 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_f_score_limits():
    with pytest.raises(ValueError):
        rouge.f_score(F.lit(1.0), F.lit(1.0), 1.5)
    with pytest.raises(ValueError):
        rouge.weighted(F.lit(1.0), 0.5)


def test_micro_is_mergeable(spark):
    counts = spark.createDataFrame([(1, 2, 4), (3, 3, 3)], "matches long, hyp_size long, ref_size long")
    r = rouge.micro(counts).first()
    assert (r.p, r.r) == (4 / 5, 4 / 7)


def agreement(spark, ranked, refs):
    frame = spark.createDataFrame([(ranked, refs)], "a array<int>, b array<array<int>>")
    return frame.select(ranking.agreement(F.col("a"), F.col("b"))).first()[0]


def test_agreement_cases(spark):
    assert agreement(spark, [1], [[1]]) is None
    assert agreement(spark, [1, 2], [[1, 2], [2, 1]]) is None
    assert agreement(spark, [2, 3, 1], [[2, 3, 1]]) == 1.0
    assert agreement(spark, [1, 3, 2], [[2, 3, 1]]) == 0.0
    assert agreement(spark, [1, 2, 3], [[1, 2, 3], [2, 1, 3]]) == 1.0
    with pytest.raises(Exception, match="misses an id"):
        agreement(spark, [1, 2], [[1]])


def test_ties_keep_input_order(spark):
    frame = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.5)], "id int, pos int, s double")
    assert ranking.ranked(frame, "id", "pos", "s").first().ranking == [2, 1, 3]


def test_last_duplicate_name_wins(spark):
    frame = spark.createDataFrame([(["a", "b", "a"], [1, 2, 3])], "n array<string>, v array<int>")
    assert frame.select(ranking.latest_by_name(F.col("n"), F.col("v"))).first()[0] == {"a": 3, "b": 2}


def test_tournaments(spark):
    rows = [("t", "a", "b", 1), ("t", "b", "c", 1), ("t", "a", "c", 1), ("c", "a", "b", 1), ("c", "b", "c", 1), ("c", "a", "c", -1), ("i", "a", "b", 1), ("i", "b", "c", None)]
    frame = spark.createDataFrame(rows, "sample_id string, x string, y string, preferred int")
    got = {r.sample_id: (r.ranking, r.status) for r in ranking.tournament(frame).collect()}
    assert got == {"t": (["a", "b", "c"], "ranked"), "c": (None, "cyclic"), "i": (None, "incomplete")}
    edges = frame.where("sample_id = 'c'").select("sample_id", F.when(F.col("preferred") == 1, F.col("x")).otherwise(F.col("y")).alias("w"), F.when(F.col("preferred") == 1, F.col("y")).otherwise(F.col("x")).alias("l"))
    assert ranking.closure(edges).where("w = l").count() == 3


def test_closure_of_long_chains(spark):
    chain = spark.createDataFrame([("s", f"{i:02}", f"{i + 1:02}") for i in range(40)], "sample_id string, w string, l string")
    assert ranking.closure(chain).count() == 41 * 40 // 2
    assert ranking.closure(spark.createDataFrame([], "sample_id string, w string, l string")).collect() == []


def test_rankings_from_partial_comparisons(spark):
    """Comparisons that follow need not be there; against a plain closure over random sets."""
    rng = random.Random(2)
    rows, want, skip = [("chain", "a", "b", 1), ("chain", "c", "b", -1), ("chain", "c", "d", 1)], {"chain": (["a", "b", "c", "d"], "ranked")}, {}
    for s in range(60):
        names = "abcdef"[: rng.randrange(2, 7)]
        order = rng.sample(names, len(names))
        known, seen = set(), set()
        for i, x in enumerate(names):
            for y in names[i + 1 :]:
                if rng.random() < 0.6:
                    p = rng.choice([1, 1, 1, 1, None, -1 if s % 5 == 0 else 1]) if order.index(x) < order.index(y) else -1
                    rows.append((str(s), x, y, p))
                    seen |= {x, y}
                    known |= {(x, y)} if p == 1 else {(y, x)} if p == -1 else set()
        while more := {(a, d) for a, b in known for c, d in known if b == c} - known:
            known |= more
        if seen:
            cyclic, total = any(a == b for a, b in known), len(known) == len(seen) * (len(seen) - 1) // 2
            best = sorted(seen, key=lambda x: (-sum(a == x for a, _ in known), x))
            want[str(s)] = (None, "cyclic") if cyclic else (best, "ranked") if total else (None, "incomplete")
        skip[str(s)] = {(x, y) for i, x in enumerate(names) for y in names[i + 1 :]} - known - {(b, a) for a, b in known}
    frame = spark.createDataFrame(rows, "sample_id string, x string, y string, preferred int")
    assert {r.sample_id: (r.ranking, r.status) for r in ranking.tournament(frame).collect()} == want
    pairs = spark.createDataFrame([(s, "abcdef"[i], "abcdef"[j]) for s in skip for i in range(6) for j in range(i + 1, 6)], "sample_id string, x string, y string")
    got = {}
    for r in ranking.undecided(pairs, frame).collect():
        got.setdefault(r.sample_id, set()).add((r.x, r.y))
    assert all(skip[s] <= got.get(s, set()) for s in skip)
    assert all(len(got.get(s, set()) & {(x, y) for x, y in skip[s]}) == len(skip[s]) for s in skip)


def test_log_probs_and_perplexity_of_logits(spark):
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(3, 4, 7)) * 50
    labels = [[1, 6, -100, 0], [-100, 2, 2, 3], [5, 5, 5, 5]]
    frame = spark.createDataFrame([(x.tolist(), y) for x, y in zip(logits, labels)], "logits array<array<double>>, labels array<int>")
    flat = [x[y] - x.max() - np.log(np.exp(x - x.max()).sum()) for a, b in zip(logits, labels) for x, y in zip(a, b) if y != -100]
    got = [v for r in frame.select(training.label_log_probs(F.col("logits"), F.col("labels")).alias("p")).collect() for v in r.p]
    assert np.allclose(got, flat)
    assert abs(training.perplexity_of_logits(frame, "logits", "labels").first()[0] - np.exp(min(-np.mean(flat), np.log(1e5)))) < 1e-6


def test_transforms_by_name(spark):
    frame = spark.createDataFrame([(1, "A b", "X")], "row_id long, text string, other string")
    assert tuple(jobs.with_transforms(frame, {"text": "tokens"}).first()) == (1, ["a", "b"], "X")
    assert datasets.lookup(frame, 1, transform={"other": F.lower}).first().other == "x"
    with pytest.raises(KeyError):
        jobs.with_transforms(frame, {"text": "none"})
    with pytest.raises(ValueError):
        jobs.with_transforms(frame, {"absent": "lower"})


def test_random_lengths_and_bands(spark):
    frame = jobs.batch_lengths(spark.range(200), "id", 300, 100, 7)
    lengths = {r.id: r.max_length for r in frame.collect()}
    assert lengths == {i: settings.random_length(7, i, 300, 100) for i in range(200)}
    assert 200 <= min(lengths.values()) < 220 and 280 < max(lengths.values()) <= 300
    rows = spark.createDataFrame([(i, [float((i * 7 + j * 3) % 11) for j in range(11)]) for i in range(40)], "id long, s array<double>")
    for r in jobs.band_picks(rows, "s", "id", 2, 4, 3, 1).collect():
        rank = sorted(range(11), key=lambda j: -r.s[j]).index(r.token) + 1
        assert rank == 1 if (r.id + 1) % 4 == 0 else 2 <= rank <= 4


def test_preferences(spark):
    frame = spark.createDataFrame([("a.b", "c", "a.b!"), ("a.b", "c", "axb"), ("a.b", "c", "c then a.b"), ("a.b", "c", "c")], "x string, y string, completion string")
    got = [(r.preferred, r.warning) for r in generation.preferences(frame).collect()]
    assert got == [(1, None), (None, "undecided"), (None, "undecided"), (-1, None)]


def test_splits(spark):
    assert datasets.split_sizes(700, 1000) == 0 and datasets.split_sizes(5, 2) == 3 and datasets.split_sizes(3, ratio=0.1) == 1
    with pytest.raises(ValueError):
        datasets.split_sizes(0)
    rows = spark.range(101).withColumnRenamed("id", "row_id")
    n = Counter(r.split for r in datasets.split(rows, ratio=0.8, seed=1).collect())
    assert n == {"train": 80, "eval": 21}


def test_numbering_and_batches(spark):
    rows = spark.range(1000).withColumnRenamed("id", "row_id").repartition(7)
    got = {r.row_id: r._n for r in datasets.numbered(rows, [-F.col("row_id")]).collect()}
    assert got == {i: 1000 - i for i in range(1000)}
    tied = spark.range(5000).selectExpr("id AS row_id", "IF(id % 7 = 0, NULL, id % 3) AS k").repartition(3)
    order = sorted(range(5000), key=lambda i: (-1 if i % 7 == 0 else i % 3, i))
    for width in ("1", "4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            frame = datasets.numbered(tied, [F.col("k"), F.col("row_id")])
            assert {r.row_id: r._n for r in frame.collect()} == {i: n for n, i in enumerate(order, 1)}
            assert frame.count() == 5000 and "CASE WHEN" not in frame._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert datasets.numbered(rows.where("false"), [F.col("row_id")]).collect() == []
    whole = datasets.batches(rows, 64, [F.col("row_id")]).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in whole] == [64] * 15 + [40]
    assert datasets.epoch(rows, 1, 0, 64).count() == 960
    one, two = ([r.row_id for r in datasets.epoch(rows, 1, e, 64).where("batch = 0").collect()] for e in (0, 1))
    assert set(one) != set(two)


def test_slices_and_lists(spark):
    rows = spark.range(20).withColumnRenamed("id", "row_id")
    assert sorted(r.row_id for r in datasets.sliced(rows, stop=3).collect()) == [0, 1, 2]
    assert sorted(r.row_id for r in datasets.sliced(rows, 3, 10, 3).collect()) == [3, 6, 9]
    with pytest.raises(ValueError):
        datasets.sliced(rows, step=0)
    idx = spark.createDataFrame([(0, 5), (1, 2), (2, 5)], "pos int, idx long")
    assert [r.row_id for r in datasets.by_index(rows, idx).orderBy("pos").collect()] == [5, 2, 5]


def test_retention(spark):
    cps = spark.createDataFrame([("r", "a", 1, True, True), ("r", "b", 2, False, False), ("r", "c", 3, False, False)], "run string, name string, mtime int, is_best boolean, is_current boolean")
    kept = lambda k: {r.name for r in datasets.retained(cps, k, ["run"]).where("kept").collect()}
    assert kept(2) == {"a", "c"} and kept(0) == {"a", "b", "c"}


def test_resume_is_idempotent(spark):
    rows = spark.createDataFrame([(i, f"w{i} x") for i in range(6)], "id long, input string")
    first = generation.generated(rows.where("id < 3"), generation.LeadingWords(1))
    rest = generation.generated(rows, generation.LeadingWords(1), done=first)
    assert sorted(r.id for r in rest.collect()) == [3, 4, 5]
    assert generation.generated(rows, generation.LeadingWords(1), done=first.union(rest)).count() == 0


def test_quality_reasons(spark):
    texts = ["The start is bad", "'The start hides", "one two of the three", " ?! ", "known zzz zzz", "known known zzz", "known known zzz zzz zzz", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("sample", F.col("id") % 3)
    words = spark.createDataFrame([("known",), ("the",), ("start",), ("hides",), ("one",), ("two",), ("of",), ("three",)], "word string")
    judged = quality.reasons(frame, words, ["id", "sample"], "text", ("the ",), " of the ")
    got = {r.id: r.reason for r in judged.collect()}
    assert {k: got[k] for k in range(7)} == {0: "prefix", 1: None, 2: "phrase", 3: "empty", 4: "unknown", 5: None, 6: "unknown"}
    assert {r.sample for r in quality.accepted_samples(frame.select("sample").distinct(), judged, "sample").collect()} == set()
    assert {r.reason: r.n for r in quality.reason_counts(judged, "sample", "id").collect()} == {"prefix": 1, "phrase": 1, "unknown": 1}


def test_isotropy_cases(spark):
    rows = [("one", [1.0, 0.0]), ("same", [2.0, 2.0]), ("same", [1.0, 1.0]), ("right", [1.0, 0.0]), ("right", [0.0, 3.0])]
    frame = spark.createDataFrame(rows, "k string, v array<double>")
    got = {r.k: r.similarity for r in vectors.self_similarity(frame, "k", "v").collect()}
    assert got == pytest.approx({"same": 1.0, "right": 0.0}, abs=1e-12)
    assert vectors.isotropy(frame.where("k = 'one'"), "k", "v").first()[0] is None
    rng = np.random.default_rng(0)
    v = rng.normal(size=(30, 5))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    c = u @ u.T
    frame = spark.createDataFrame([("k", x.tolist()) for x in v], "k string, v array<double>")
    assert vectors.self_similarity(frame, "k", "v").first().similarity == pytest.approx(c[np.triu_indices(30, 1)].mean())


def test_greedy_match(spark):
    frame = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]]), ([], [[1.0, 0.0]])], "h array<array<double>>, r array<array<double>>")
    got = [(r.bert_p, r.bert_r) for r in vectors.greedy_match(frame, "h", "r").collect()]
    assert got == [(0.5, 1.0), (0.0, 0.0)]


def test_rewards(spark):
    frame = spark.createDataFrame([("u", 1, 4.0), ("u", 2, 2.0), ("u", 3, 4.0), ("v", 1, 1.0)], "u string, t int, x double")
    got = {(r.u, r.t): (r.baseline, r.advantage) for r in rewards.baselines(frame, "x", ["u"], ["t"]).collect()}
    assert got == {("u", 1): (0.0, 4.0), ("u", 2): (4.0, -2.0), ("u", 3): (3.0, 1.0), ("v", 1): (0.0, 1.0)}
    assert [r.is_best for r in rewards.best_so_far(frame, "x", ["u"], ["t"]).orderBy("u", "t").collect()] == [True, False, False, True]
    assert [r.is_best for r in rewards.best_so_far(frame, "x", ["u"], ["t"], lower_is_better=True).orderBy("u", "t").collect()] == [True, True, False, True]
    assert rewards.average(frame.where("false"), "x").first()[0] == 0.0
    assert rewards.statistics(frame, "x", ["u"]).where("u = 'v'").first()["std"] is None
    with pytest.raises(KeyError, match="there are"):
        rewards.metric({"a": 1.0}, "b")


def test_features(spark):
    frame = spark.createDataFrame([([5, 6, 7, 8],), ([5],), ([],)], "ids array<int>")
    out = lambda c: [r[0] for r in frame.select(c).collect()]
    ids = F.col("ids")
    assert out(arrays.truncated(ids, 3, 1)) == [[5, 6, 1], [5], []]
    assert out(arrays.ended(ids, 3, 1)) == [[5, 6, 1], [1], []]
    assert out(arrays.shifted_right(ids, 0)) == [[0, 5, 6, 7], [0], [0]]
    assert out(arrays.shifted_left(ids)) == [[6, 7, 8], [], []]
    assert out(arrays.padded(ids, 3, 0)) == [[5, 6, 7, 8], [5, 0, 0], [0, 0, 0]]
    assert out(arrays.attention_mask(ids, 2)) == [[1, 1, 1, 1], [1, 0], [0, 0]]
    pads = spark.createDataFrame([([5, 6, 0, 0],), ([5, 6],), ([0, 5],)], "ids array<int>")
    assert [r[0] for r in pads.select(arrays.pooled_index(F.col("ids"), 0)).collect()] == [1, 1, 1]
    assert [r[0] for r in spark.createDataFrame([([0.5, 0.9, 0.9],)], "v array<double>").select(arrays.top_band(F.col("v"), 1, 2)).collect()] == [[1, 2]]


def test_ngrams_of_short_texts(spark):
    frame = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],)], "t array<string>")
    assert [r[0] for r in frame.select(arrays.ngrams(F.col("t"), 2)).collect()] == [[], [], ["a b", "b c"]]


def test_metrics_of_training(spark):
    rows = spark.createDataFrame([([1, 2, -100], [1, 3, 7])], "l array<int>, p array<int>")
    assert training.token_accuracy(rows, "l", "p").first()[0] == 0.5
    assert training.perplexity(spark.createDataFrame([(-100.0,)], "x double"), "x").first()[0] == pytest.approx(1e5)
    assert training.perplexity(spark.createDataFrame([(math.log(0.5),)], "x double"), "x").first()[0] == pytest.approx(2.0)


def test_decoding_blocks_ngrams():
    table = {0: [0, 5, 4, 0], 1: [0, 1, 9, 0], 2: [0, 8, 1, 3], 3: [0, 0, 0, 9]}
    def logits(seqs, rows):
        return np.array([table[s[-1]] for s in seqs], float)
    assert decoding.decode(logits, 1, 0, 3, longest=6) == [[0, 1, 2, 1, 2, 1, 2]]
    assert decoding.decode(logits, 1, 0, 3, longest=9, block=2) == [[0, 1, 2, 1, 1, 0, 2, 3]]
    ends = lambda seqs, rows: np.array([[0, 0, 0, 1.0] if i == 0 else [0, 1.0, 0, 0] for i in rows])
    assert decoding.decode(ends, 2, 0, 3, longest=3) == [[0, 3], [0, 1, 1, 1]]


def test_samplers():
    s = decoding.BandSampler(2, 3, 2, seed=1)
    logits = np.array([[0.1, 0.9, 0.5, 0.3]])
    picks = [int(s(logits)[0]) for _ in range(9)]
    assert picks[2] == picks[5] == picks[8] == 1 and all(p in (2, 3) for i, p in enumerate(picks) if i % 3 != 2)
    assert decoding.SAMPLERS["top10_30"]().last == 30
    with pytest.raises(ValueError):
        decoding.BandSampler(3, 2)


def test_trie():
    t = decoding.Trie()
    for w in ("ab", "abc", "b"):
        t.add(w)
    assert "ab" in t and "a" not in t and sorted(t.beginning("a")) == [("a", "b"), ("a", "b", "c")] and t.beginning("x") == []


def test_settings():
    with pytest.warns(UserWarning, match="unknown setting"):
        s = settings.JobSettings.of(batch_size=3, other=1)
    assert s.batch_size == 3 and s.extra == {"other": 1}
    assert settings.overlaid({"a": 1, "b": 1, "c": 1}, '{"b": 2, "c": 2}', {"c": 3, "a": None}) == {"a": 1, "b": 2, "c": 3}
    assert settings.log_level("info") == 20 and settings.log_level("x") == 0
    assert len(settings.run_id()) == 16 and settings.length_range(120, 100) == (50, 150)
    r = settings.Registry("reward")
    r.add("one")(1)
    assert r["one"] == 1
    with pytest.raises(KeyError, match="there are"):
        r["two"]
    with pytest.raises(ValueError, match="missing parameters: b"):
        settings.required({"a": 1, "b": ""}, "a", "b")
    assert settings.JudgeError("x", "Timeout", "graceful").row()["error_type"] == "graceful"


def test_error_types(spark):
    frame = spark.createDataFrame([(None,), ('{"code": 1}',), ("boom",)], "error string")
    assert [r.error_type for r in generation.classified_errors(frame).collect()] == [None, "graceful", "unexpected"]


def test_anchors_and_worker_keys(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [1.0, 0.0])], "d array<double>, r array<double>, h array<double>")
    got = [vectors.anchored_reward(frame, a, "d", "r", "h").first().reward for a in ("document", "reference")]
    assert got == [5.0, 0.0]
    with pytest.raises(ValueError):
        vectors.anchored_reward(frame, "summary", "d", "r", "h")
    requests, keys = spark.range(60).withColumnRenamed("id", "n"), spark.createDataFrame([(k,) for k in "abcd"], "k string")
    rows = jobs.assigned(requests, keys, 3, "n", "k", 1).collect()
    assert Counter(r.worker for r in rows) == {0: 20, 1: 20, 2: 20}
    for w in range(3):
        handed = [r.key for r in sorted(rows, key=lambda r: r.n) if r.worker == w]
        assert handed[:4] * 5 == handed and sorted(handed[:4]) == list("abcd")
    assert len({tuple(r.key for r in sorted(rows, key=lambda r: r.n) if r.worker == w)[:4] for w in range(3)}) > 1


def test_models_by_triple_and_rankings_by_scorer(spark):
    class Lengths:
        def load(self): ...

        def reward(self, documents, hypotheses, references):
            return [float(len(a) + 10 * len(b) + 100 * len(c)) for a, b, c in zip(documents, hypotheses, references)]

    frame = spark.createDataFrame([(1, "d", "hh", "rrr")], "id long, d string, h string, r string")
    assert generation.rewarded(frame, Lengths(), "d", "h", "r").first().reward == 321.0
    rows = spark.createDataFrame([(1, 0, "a b", "x"), (1, 1, "a b", "a"), (1, 2, "a b", "b")], "id long, pos int, ref string, hyp string")
    assert generation.ranked_by_scorer(rows, generation.Overlap(), "id", "pos", "ref", "hyp").first().ranking == [2, 3, 1]
