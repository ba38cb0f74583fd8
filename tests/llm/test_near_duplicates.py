import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwright.llm import simhash, similar
from loomwright.llm._components import components
from loomwright.llm._workspace import Workspace

from .cases import empty, messy


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(values, bits=2):
    values, root = list(values), {}
    for v in values:
        root[v] = v
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_fingerprints_of_awkward_texts(spark):
    got = simhash.fingerprints(messy(spark)).collect()
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in messy(spark).collect()]
    assert sorted(map(repr, [(r.doc_id, r.fp % 2**64) for r in got])) == sorted(map(repr, want))


def test_jvm_hash_is_the_same(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64
    assert h == xxhash.xxh64_intdigest(b"a b c", 42)


def test_components_match_brute_force(spark):
    got = simhash.near_duplicates(spark, messy(spark)).collect()
    roots = brute_roots({r.fp for r in got})
    least = {}
    for r in got:
        ids = least.setdefault(roots[r.fp], [])
        ids += [r.doc_id] if r.doc_id is not None else []
    assert len(got) == messy(spark).count()
    for r in got:
        assert r.component_id == min(least[roots[r.fp]], default=None)


@pytest.mark.parametrize("limit", [0, 3, 512])
def test_links_by_any_bucket_limit(spark, limit):
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    values = set(centres)
    for c in centres:
        for _ in range(40):
            v = c
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                v ^= 1 << b
            values.add(v)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    ws = Workspace(spark, "t")
    classes = ws.table(spark.createDataFrame([(v,) for v in signed], "fp long"), "classes")
    rows = simhash.links(classes, ws, bucket_limit=limit).collect()
    got = {frozenset((r.u, r.v)) for r in rows}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 2}
    assert got == want


@pytest.mark.parametrize("at_once", [0, 100_000])
def test_components_of_chains_and_stars(spark, at_once):
    ws = Workspace(spark, "t")
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (200, 202)]
    frame = ws.table(spark.createDataFrame(edges, "u long, v long").repartition(6), "e")
    got = {r.node: r.root for r in components(frame, ws, at_once=at_once).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 201: 200, 202: 200}
    assert components(ws.table(frame.where("false"), "none"), ws, "no", at_once).collect() == []


def test_one_row_of_each_component_stays(spark):
    docs = messy(spark)
    kept = simhash.deduplicated(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(13) == 1
    assert kept.where("doc_id IN (4, 5, 6)").count() == 1  # texts without words are one group
    assert kept.where("doc_id = 1").count() == 2  # two different texts of one id


def test_empty(spark):
    assert simhash.near_duplicates(spark, empty(spark)).collect() == []
    assert simhash.deduplicated(spark, empty(spark)).collect() == []


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(8)
    texts = [None, "", "one", "two words", "Two words"]
    for n in (6, 20, 60, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for change in (1, 2, n // 40 + 1, n // 20 + 1):
                words = list(base)
                for i in rng.sample(range(n), change):
                    words[i] = "other"
                texts.append(" ".join(words))
            texts.append(" ".join(base + base[: n // 9]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.deduplicated(spark, docs, similar_by=5).collect())
    assert got == brute_similar(list(enumerate(texts)))
    assert len(got) < simhash.deduplicated(spark, docs).count()


def brute_similar(rows, n=5):
    """The smallest id of each component of texts, all pairs of which are compared."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or {" ".join(w)} - {""})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(least.values())


def test_large_group_of_near_copies_against_all_pairs(spark):
    """Copies that lie around one text, at all distances, and a second group that shares some of its words."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    other = base[:60] + [f"v{rng.randrange(9000)}" for _ in range(90)]
    texts = []
    for k in range(240):
        words = list(base if k % 3 else other)
        for i in rng.sample(range(150), k % 12):
            words[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ws = Workspace(spark, "t")
    marked = similar.sets(spark, docs, "text", "doc_id", ws)
    found = similar.Similar(docs, "text", "doc_id", marked, ws, lambda c: simhash.links(c, ws))
    ws.table(found.links, "links")
    assert sorted({r.component_id for r in found.kept().collect()}) == brute_similar(list(enumerate(texts)))
    sets = {i: set(similar.shingles(t.encode()).tolist()) for i, t in enumerate(texts)}
    similar_pairs = sum(10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for i in sets for j in range(i))
    assert spark.read.parquet(ws.path("first_pairs")).count() + spark.read.parquet(ws.path("second_pairs")).count() < similar_pairs / 2
    ws.keep("links", "one")
    assert spark.read.parquet(ws.path("links")).count() > 0
    with pytest.raises(Exception):
        spark.read.parquet(ws.path("index"))


def test_a_shingle_of_very_many_texts_gives_no_quadratic_join(spark, monkeypatch):
    """Dissimilar texts that begin with the same words, of which the sample tells nothing; some have a near copy."""
    monkeypatch.setattr(similar, "_frequent", lambda documents, shingle: np.empty(0, np.uint64))
    rng, texts = random.Random(3), []
    begin = min((f"all of them begin so{j}" for j in range(200)), key=lambda x: int(similar.shingles(x.encode())[0]))  # low in the order
    for k in range(300):
        words = [*begin.split(), *(f"w{rng.randrange(10**6)}" for _ in range(25))]
        texts.append(" ".join(words))
        if k % 20 == 0:
            texts.append(" ".join([*words, "end"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    widest = {}
    for crowd in (10**9, 10):
        monkeypatch.setattr(similar, "CROWD", crowd)
        ws = Workspace(spark, "t")
        marked = similar.sets(spark, docs, "text", "doc_id", ws)
        found = similar.Similar(docs, "text", "doc_id", marked, ws, lambda c: spark.createDataFrame([], "u long, v long"))
        assert sorted({r.component_id for r in found.kept().collect()}) == brute_similar(list(enumerate(texts)))
        widest[crowd] = found.index.agg(F.max("c")).first()[0]
        assert (found.reordered > 0) == (crowd == 10)
    assert widest[10] <= 20 < widest[10**9]


def test_repeated_rows_that_differ_elsewhere(spark):
    rows = [(1, "same text here", x) for x in ("b", "a", None, "c")] + [(2, "same text here", "0"), (3, "other words", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for by in (None, 5):
        got = sorted((r.doc_id, r.source) for r in simhash.deduplicated(spark, docs.repartition(3), similar_by=by).collect())
        assert got == [(1, "a"), (3, "z")]


def test_similar_rows_with_clashing_columns_and_nulls(spark):
    docs = messy(spark)
    for name in ("sketch", "sim", "prefix", "keeps", "row"):
        docs = docs.withColumn(name, F.lit(1))
    kept = simhash.deduplicated(spark, docs, similar_by=5)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(13) == 1 and kept.where("doc_id IN (4, 5, 6)").count() == 1
    assert simhash.deduplicated(spark, empty(spark), similar_by=5).collect() == []


def test_sketches_never_overstate(spark):
    rng = random.Random(6)
    values = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    rows, want = [], []
    for k in range(40):
        a = np.unique(values[rng.sample(range(3000), rng.choice([0, 1, 40, 300, 2000]))])
        b = np.unique(np.concatenate((a[: len(a) * rng.randrange(5) // 4], values[rng.sample(range(3000), rng.choice([0, 3, 700]))])))
        lanes = [similar.lanes_for(len(x)) for x in (a, b)]
        assert all(n == 8 or 64 * n >= len(x) > 32 * n for n, x in zip(lanes, (a, b)))
        rows.append((k, *(similar.sketch(x, n).tolist() for x, n in zip((a, b), lanes))))
        least = min(lanes)
        same = similar.sketch(a, least) ^ similar.sketch(b, least)
        want.append(sum(bin(int(x) % 2**64).count("1") for x in same))
        assert want[-1] <= len(set(a.tolist()) ^ set(b.tolist()))
    got = spark.createDataFrame(rows, "k int, u array<long>, v array<long>").select("k", F.expr(similar._apart_finely("u", "v")).alias("d"))
    assert [r.d for r in got.orderBy("k").collect()] == want
