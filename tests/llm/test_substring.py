import hashlib
import random
import re
from collections import Counter

import pytest

from loomwright.llm.substring import FingerprintIndex, SubstringDedup
from loomwright.llm._workspace import Workspace

from .cases import DDL, empty, messy


def brute(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {p for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for p in range(s, s + window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def check(spark, docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = SubstringDedup(spark, docs, **options).rows
    want = brute(rows, options.get("window", 35))
    assert sorted(map(repr, [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()])) == sorted(map(repr, want))


@pytest.mark.parametrize("window", [35, 5])
def test_awkward_texts(spark, window):
    check(spark, messy(spark), window=window)


@pytest.mark.parametrize("batches", [1, 3])
def test_random_texts_with_shared_passages(spark, batches):
    rng = random.Random(batches)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(30, 50))] for k in range(4)]
    rows = []
    for i in range(60):
        w = [f"u{i}_{j}" for j in range(rng.randrange(0, 60))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[: rng.randrange(25, len(p) + 1)] if rng.random() < 0.5 else p
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w), None, None, None))
    rows += [(100 + i, "a b " * rng.randrange(10, 40), None, None, None) for i in range(4)] + [rows[3], rows[3]]
    check(spark, spark.createDataFrame(rows, DDL).repartition(5), batches=batches)


def test_a_passage_in_all_texts_is_not_dealt_to_one_task(spark, monkeypatch):
    rng = random.Random(8)
    passage = [f"shared{i}" for i in range(60)]
    rows = [(i, " ".join([f"u{i}_{j}" for j in range(rng.randrange(50))] + passage), None, None, None) for i in range(1500)]
    dealt, before = [], SubstringDedup._dealt

    def watched(entries, often):
        out = before(entries, often)
        dealt.append((out.count(), out.groupBy("h").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(SubstringDedup, "_dealt", staticmethod(watched))
    index = SubstringDedup(spark, spark.createDataFrame(rows, DDL).repartition(4))
    assert len(dealt) == 2 and all(rows > 300 and most <= 64 for rows, most in dealt)
    removed = {r.doc_id: r.n_removed for r in index.rows.collect()}
    assert removed == {i: 60 for i in range(1500)}
    index.drop()


def test_applied_keeps_clean_texts_and_columns(spark):
    docs = messy(spark)
    out = SubstringDedup(spark, docs).applied(docs, length="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count()
    of = {(r.doc_id, r.fp): r for r in out.collect()}
    before = {(r.doc_id, r.fp): r for r in docs.collect()}
    assert of[12, 0].text == before[12, 0].text and of[12, 0].n_chars == 9
    assert of[3, 0].text != before[3, 0].text
    assert of[2, 0].text == "" and of[2, 0].n_chars == 0


def test_index_of_batches(spark):
    index = FingerprintIndex(Workspace(spark, "t"))
    batch = lambda *hs: spark.createDataFrame([(h,) for h in hs], "h long")
    said = lambda hs: sorted(map(tuple, index.add(batch(*hs)).collect()))
    assert said([1, 1, 2, 3, 5, 6, 7, 8, 9]) == [(1, False)]
    index.compact()
    assert said([3, 4, 1]) == [(1, False), (3, True)]
    index.compact()  # the older run is much longer, so it is not rewritten
    assert [n for _, n in index.runs] == [9, 3]
    assert said([3, 4, 5, 10]) == [(3, True), (4, True), (5, True)]
    index.compact()  # the two short runs become one, and that one and the long one too
    assert [n for _, n in index.runs] == [16]
    assert sorted(map(tuple, spark.table(index.runs[0][0]).collect())) == [(1, 3), (2, 1), (3, 3), (4, 2), (5, 2), (6, 1), (7, 1), (8, 1), (9, 1), (10, 1)]
    index.drop()
    assert index.runs == []


def test_history_is_not_dealt_again(spark):
    index = FingerprintIndex(Workspace(spark, "t"))
    index.add(spark.range(1000).selectExpr("id * 2 AS h"))
    met = index.add(spark.range(1000).selectExpr("id * 3 AS h"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def _random(rng, n, first=0):
    passages = [[f"p{k}_{i}" for i in range(45)] for k in range(6)]
    rows = []
    for i in range(first, first + n):
        w = [f"u{i}_{j}" for j in range(rng.randrange(0, 60))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(3) :]
        rows.append((i, " ".join(w), None, None, None))
    return rows


def test_later_batches_against_a_kept_index(spark):
    """After each batch, all documents so far are judged as if they had come at once."""
    rng = random.Random(11)
    one, two = _random(rng, 40), _random(rng, 12, 100)
    alone = (500, " ".join(f"a{i}" for i in range(50)), None, None, None)  # in one batch, then repeated in the next
    three = [(600, "x " + alone[1], None, None, None), (601, alone[1], None, None, None), one[5], two[3], two[3], (602, None, None, None, None)]
    dedup, sofar = SubstringDedup(spark), []
    for rows in (one + [alone], two, three, messy(spark, extra=False).collect()):
        batch = spark.createDataFrame(rows, DDL)
        dedup.add(batch)
        sofar += [(r[0], r[1]) for r in rows]
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup.rows.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(sofar)))
    assert len(dedup.index.runs) <= 4
    dedup.drop()
    assert dedup.rows.count() == len(sofar)


def test_passage_of_very_many_texts(spark):
    """Its fingerprints are frequent, so that its windows are counted apart."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"u{i} v{i} {passage} w{i}", None, None, None) for i in range(150)] + [(900 + i, passage + f" z{i}", None, None, None) for i in range(2)]
    docs = spark.createDataFrame(rows, DDL)
    dedup = SubstringDedup(spark, docs)
    assert len(dedup.index.frequent())
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup.rows.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute([(r[0], r[1]) for r in rows])))


def test_empty(spark):
    assert SubstringDedup(spark, empty(spark)).rows.collect() == []
