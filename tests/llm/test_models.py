import math
import random
import re
import zlib
from collections import Counter

import numpy as np

import pytest
import xxhash

from loomwright.llm import lm, quality, queries, toxicity

from .cases import empty, messy

BIG = "/root/testdata/sf0.1"


def held_out(spark, f, label):
    scores = f(spark, BIG).where("held_out").join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").toPandas()
    return toxicity.measured(scores, scores[label])


def test_quality_on_held_out_labels(spark):
    assert held_out(spark, queries.op4_quality, "quality")["accuracy"] > 0.97


def test_toxicity_on_held_out_labels(spark):
    got = held_out(spark, queries.op8_toxicity, "toxic")
    assert got["precision"] > 0.9 and got["recall"] > 0.8


@pytest.mark.parametrize("kind, by, out", [(quality, 3, 1), (toxicity, 5, 0)])
def test_folds(spark, kind, by, out):
    ids = spark.range(300).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in ids.where(kind.held_in()).collect()}
    assert got == {i for i in range(300) if zlib.crc32(str(i).encode()) % by != out}


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text int")


def test_awkward_rows_are_scored(spark):
    docs = messy(spark)
    labels = _labels(spark, [(1, 1, 0, 0), (7, 0, 1, 0), (7, 0, 1, 0), (9, None, None, 0), (None, 1, 1, 0), (10, 1, 0, 0)])
    for model in (quality.Quality(spark, docs, labels), toxicity.Toxicity(spark, docs, labels)):
        got = model.scores(docs).toPandas()
        assert len(got) == docs.count() and got["score"].between(0, 1).all() and got["score"].notna().all()


def test_no_labels_or_documents(spark):
    docs, none = messy(spark), _labels(spark, [])
    assert toxicity.Toxicity(spark, docs, none).accepted(docs).count() == docs.count()
    assert quality.Quality(spark, docs, none).scores(docs).count() == docs.count()
    assert toxicity.Toxicity(spark, empty(spark), none).scores(empty(spark)).collect() == []
    assert quality.Quality(spark, empty(spark), none).scores(empty(spark)).collect() == []


def test_forest_walks_like_a_loop():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    f = quality.grow(x, y, trees=20, depth=3)
    assert ((f.scores(x) >= 0.5) == y).mean() > 0.95

    def one(row):
        total = f.base
        for t in range(len(f.feature)):
            node = 0
            while f.feature[t, node] >= 0:
                node = 2 * node + 1 + (row[f.feature[t, node]] > f.threshold[t, node])
            total += f.value[t, node]
        return total

    assert np.allclose(f.logits(x), [one(r) for r in x])


def slow_places(text):
    words = re.findall(r"[^ ]+", re.sub(r"[^0-9a-z'\u0080-\U0010ffff]", " ", (text or "").lower()))
    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
    top = 2**64

    def mixed(x):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % top
        x = (x ^ x >> 29) * 0xA0761D6478BD642F % top
        return x ^ x >> 32

    near = [mixed((a * 0x9E3779B97F4A7C15 + b) % top) for a, b in zip(h, h[1:])]
    skip = [mixed((a * 0xC2B2AE3D27D4EB4F + b + 1) % top) for a, b in zip(h, h[2:])]
    return sorted(x % toxicity.PLACES for x in h + near + skip)


@pytest.mark.parametrize("chunk", [7, 200_000])
def test_features_against_a_slow_form(spark, monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "_CHUNK", chunk)
    texts = [r.text for r in messy(spark).collect()] + ["it's!!a B-c", "a", "a b", "É è"]
    for t in texts:
        t = t and t[:3000]
        got = [x for part in toxicity.places(t and t.encode()) for x in part.tolist()]
        assert sorted(got) == slow_places(t)


def test_ftrl_against_a_slow_form():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 8)).astype(np.int32) for _ in range(80)]
    y = np.array([float(r[0] < 6) for r in rows])
    at, w, bias = toxicity.Ftrl(l1=0.5, epochs=3).fit(rows, y)
    z, n, b, b_n = Counter(), Counter(), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 1.0

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.5 else (math.copysign(0.5, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / 2.0 + 0.01)

    order = np.random.default_rng(5)
    for _ in range(3):
        for k in order.permutation(len(rows)):
            own = {i: weight(i) for i in rows[k].tolist()}
            g = (1 / (1 + math.exp(-(sum(own.values()) + b))) - y[k]) * (6 if y[k] else 1)
            for i, wi in own.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 2.0 * wi
                n[i] += g * g
            b_n += g * g
            b -= 2.0 * 0.1 * g / math.sqrt(b_n)
    want = {i: weight(i) for i in range(60) if weight(i)}
    assert at.tolist() == sorted(want) and np.allclose(w, [want[i] for i in sorted(want)], rtol=1e-4) and abs(bias - b) < 1e-9


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"bad{i % 3} " * 3 + " ".join(f"w{j}" for j in range(50))) for i in range(60)], "doc_id long, text string")
    labels = _labels(spark, [(i, 0, int(i % 3 == 0), 0) for i in range(60)])
    taken = []
    monkeypatch.setattr(toxicity.Ftrl, "fit", lambda self, rows, y: taken.append(sum(r.nbytes for r in rows)) or (np.empty(0, np.int32), np.empty(0, np.float32), 0.0))
    toxicity.Toxicity(spark, docs, labels)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 10_000)
    toxicity.Toxicity(spark, docs, labels)
    assert taken[0] > 30_000 and 9_000 < taken[1] <= 10_000


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return [0.0] * quality.FEATURES
    raw, n = text.encode(), len(words)
    of = lambda chars: sum(raw.count(c.encode()) for c in chars)
    ink = len(raw) - of(" \t\n\r\v\f")
    sizes = [len(w.encode()) for w in words]
    mean = sum(sizes) / n
    count, pairs = Counter(words), Counter(zip(words, words[1:]))
    lines = Counter(x.strip(" \t\n\r\v\f") for x in text.split("\n"))
    lines.pop("", None)
    n_lines, top = sum(lines.values()), sorted(count.values(), reverse=True)
    entropy = -sum(c / n * math.log(c / n) for c in count.values())
    return [
        math.log1p(n), math.log1p(len(raw)), mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / n), max(sizes),
        of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / ink, of("abcdefghijklmnopqrstuvwxyz") / ink, of("0123456789") / ink, of(".,;:!?'\"()-") / ink, of("#*$%&|<>{}[]\\/=+~^_@`") / ink, sum(x > 127 for x in raw) / ink,
        len(count) / n, top[0] / n, sum(top[:5]) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(pairs) / max(1, n - 1), max(pairs.values(), default=0) / max(1, n - 1),
        n_lines / n, 1 - len(lines) / n_lines, max(lines.values()) / n_lines,
        entropy / max(1e-9, math.log(max(2, n))), sum(w[-1] in ".!?" for w in words) / n, sum(x <= 3 for x in sizes) / n, raw.count(b"!") / n,
    ]


def test_statistics_against_a_slow_form(spark):
    texts = [r.text for r in messy(spark).collect()] + ["A1 b2! #tag\n\nA1 b2! #tag\nend.", "é É ß", "x"]
    for t in texts:
        assert np.allclose(quality.statistics(t and t.encode()), slow_statistics(t)), t and t[:40]


def slow_grow(x, y, trees, depth, rate=0.15, bins=64, l2=1.0, least=2.0):
    """Scores of trees whose every split is searched over all thresholds, with sums over the rows themselves."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    score = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)

        def leaf(rows, level):
            best = (1e-6, None)
            if level < depth:
                for j in range(x.shape[1]):
                    for e in edges[j]:
                        left = rows[x[rows, j] <= e]
                        hl, gl, ht, gt = h[left].sum(), g[left].sum(), h[rows].sum(), g[rows].sum()
                        if hl >= least and ht - hl >= least:
                            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                            if gain > best[0] + 1e-12:
                                best = (gain, (j, e))
            if best[1] is None:
                score[rows] += -g[rows].sum() / (h[rows].sum() + l2) * rate
            else:
                j, e = best[1]
                leaf(rows[x[rows, j] <= e], level + 1)
                leaf(rows[x[rows, j] > e], level + 1)

        leaf(np.arange(len(y)), 0)
    return score


def test_trees_against_a_slow_form():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(150, 3)), 2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] < -0.1)).astype(float)
    f = quality.grow(x, y, trees=5, depth=3)
    assert np.allclose(f.logits(x), slow_grow(x, y, 5, 3))


def test_ftrl_is_sparse_and_accurate():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(10, 5000, 40)).astype(np.int32) for _ in range(600)]
    y = (rng.random(600) < 0.2).astype(float)
    rows = [np.unique(np.append(r, [rng.integers(0, 5)])).astype(np.int32) if v else r for r, v in zip(rows, y)]
    at, w, bias = toxicity.Ftrl(l1=4.0, epochs=5, toxic_weight=1.0).fit(rows, y)
    assert set(range(5)) <= set(at.tolist()) and len(at) < 400
    dense = np.zeros(toxicity.PLACES)
    dense[at] = w
    assert np.mean([(dense[r].sum() + bias > 0) == (v > 0) for r, v in zip(rows, y)]) > 0.97


# language model --------------------------------------------------------------------------------------------------------
def brute_lm(rows, vocabulary, backoff=0.4, least=lm.LEAST, order=3):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    count = Counter(w for t in texts for w in t)
    h = {w: int(lm.word_hashes([w.encode()]).view(np.int64)[0]) for w in count}
    known = set(sorted(count, key=lambda w: (-count[w], h[w]))[:vocabulary])
    texts = [[w if w in known else None for w in t] for t in texts]
    ones = Counter(w for t in texts for w in t)
    pairs = Counter(p for t in texts for p in zip(t, t[1:]))
    triples = Counter(p for t in texts for p in zip(t, t[1:], t[2:]))
    n = sum(ones.values())
    out = []
    for (doc, _), t in zip(rows, texts):
        s = math.log(ones[t[0]] / n) if t else 0.0
        for i, b in enumerate(t[1:], 1):
            a, before = t[i - 1], t[i - 2] if i > 1 else None
            two = pairs[a, b] / ones[a] if pairs[a, b] >= least else backoff * ones[b] / n
            if i > 1 and order == 3:
                two = triples[before, a, b] / pairs[before, a] if triples[before, a, b] >= least else backoff * two
            s += math.log(two)
        out.append((doc, len(t), round(s, 6)))
    return out


@pytest.mark.parametrize("vocabulary, order, least", [(5, 2, 1), (5, 3, 2), (300, 2, 2), (300, 3, 1), (65_535, 2, 1), (65_535, 3, 2)])
def test_scores_match_brute_force(spark, vocabulary, order, least):
    docs = messy(spark)
    got = lm.scored(spark, docs, vocabulary=vocabulary, order=order, least=least).collect()
    want = brute_lm([(r.doc_id, r.text) for r in docs.collect()], vocabulary, order=order, least=least)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-5)


def test_lm_of_random_texts_and_of_none(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"v{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(50)))) for i in range(80)]
    got = {r.doc_id: r.log_score for r in lm.scored(spark, spark.createDataFrame(rows, "doc_id long, text string"), vocabulary=20, order=3).collect()}
    assert all(got[i] == pytest.approx(s, abs=1e-5) for i, _, s in brute_lm(rows, 20))
    assert lm.scored(spark, empty(spark)).collect() == []


@pytest.mark.parametrize("least", [1, 2])
def test_every_word_has_its_own_key(spark, least):
    docs = messy(spark)
    got = lm.scored(spark, docs, least=least, ranked=300).collect()
    want = brute_lm([(r.doc_id, r.text) for r in docs.collect()], None, least=least, order=2)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-5)


def test_words_beyond_the_ranked_ones_keep_their_counts(spark):
    rows = [(i, f"u{2 * i} u{2 * i + 1}") for i in range(33_000)] * 2  # 66,000 words, more than have a rank
    got = {r.doc_id: r.log_score for r in lm.scored(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 33_000 and all(x == pytest.approx(math.log(2 / 132_000)) for x in got.values())
