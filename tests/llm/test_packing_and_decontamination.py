import random
import weakref
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwright.llm import decontaminate, packing, tokens

from .cases import empty, messy, prose


def brute_fit(items, capacity):
    bins, out = [], []
    for length, source, cluster in items:
        fits = [(capacity - b[0], i) for i, b in enumerate(bins) if capacity - b[0] >= length and source not in b[1] and cluster not in b[2]]
        if fits:
            i = min(fits)[1]
        else:
            bins.append((0, set(), set()))
            i = len(bins) - 1
        used, sources, clusters = bins[i]
        bins[i] = (used + length, sources | ({source} - {None}), clusters | ({cluster} - {None}))
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_matches_brute_force(seed):
    rng = random.Random(seed)
    items = [(rng.randint(1, 100), rng.choice([None, 1, 2, 3, 4, 4, 4]), rng.choice([None, *range(25)])) for _ in range(150)]
    items.sort(key=lambda x: -x[0])
    assert packing.best_fit(items, 100) == brute_fit(items, 100)


def rebuilt(docs, sequences, capacity):
    """Checks that sequences hold every text once, whole and in order, within capacity and without conflicts."""
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    sources = {(r.doc_id, r.text or ""): r.source for r in docs.collect()}
    parts = {}
    for r in sequences:
        assert (r.bin_id is None) == (r.bin_used == 0) and r.bin_used == sum(p.length for p in r.pieces) <= capacity
        for p in r.pieces:
            parts.setdefault(p.doc_id, []).append((p.piece, p.piece_start, p.text, r.bin_id))
    got = Counter()
    for doc, own in parts.items():
        by = {}
        for k, at, text, _ in sorted(own, key=lambda x: x[:3]):
            by.setdefault(k, []).append((at, text))
        tails = {}  # texts so far -> how many
        for k in sorted(by):
            if k == 0:
                tails = Counter(t for _, t in by[0])
                continue
            for at, t in by[k]:
                head = next(h for h in tails if len(h) == at and tails[h] > 0 and any((doc, whole) in texts and whole.startswith(h + t) for whole in (w for d, w in texts if d == doc)))
                tails[head] -= 1
                tails[head + t] = tails.get(head + t, 0) + 1
        for t, n in tails.items():
            if n:
                got[doc, t] += n
    assert got == texts
    for r in sequences:
        if r.bin_id is not None and len(r.pieces) > 1:
            whole = [next(((d, t) for d, t in texts if d == p.doc_id and p.text in t)) for p in r.pieces]
            assert len({sources[w] for w in whole}) == len(whole) and len({t.lower() for _, t in whole}) == len(whole)


@pytest.mark.parametrize("shard_rows", [4, 8192])
def test_sequences_hold_whole_texts_without_conflicts(spark, shard_rows):
    docs = messy(spark)
    got = packing.sequences(spark, docs, capacity=150, shard_rows=shard_rows).collect()
    rebuilt(docs, got, 150)
    assert sum(p.length for r in got for p in r.pieces) == sum(len((r.text or "").split()) for r in docs.collect())
    rows = packing.packed(spark, docs, capacity=150, shard_rows=shard_rows).collect()
    assert sorted((r.bin_id, r.bin_offset) for r in rows if r.bin_id is not None) == sorted((r.bin_id, sum(p.length for p in r.pieces[:i])) for r in got if r.bin_id is not None for i in range(len(r.pieces)))


def test_sequences_by_tokens(spark):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    docs = messy(spark).unionByName(messy(spark).where("doc_id = 14").withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit("z" * 4000 + " 🙂é" * 300)))
    cutter = packing.TokenPieces(200, path, whole_chars=3_000, overlap=200)
    got = packing.sequences(spark, docs, capacity=200, cutter=cutter).collect()
    rebuilt(docs, got, 200)
    counts = {(r.doc_id, r.n_bytes): r.n_tokens for r in tokens.token_counts(docs, path).collect()}
    sums = Counter()
    for r in got:
        for p in r.pieces:
            sums[p.doc_id] += p.length
    assert sums[12] == next(n for (i, _), n in counts.items() if i == 12)
    pieces = [p for r in got for p in r.pieces]
    assert tokens.Tokens(path).counts([p.text.encode() for p in pieces]) == [p.length for p in pieces]


def hard_texts():
    rng = random.Random(12)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    cjk, thai, code = "".join(map(chr, range(0x4E00, 0x4F00))), "".join(map(chr, range(0xE01, 0xE2F))), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = ["the " * 3000 + pick(cjk, 3000), pick(code, 40_000), pick(cjk, 12_000), pick(thai, 9000), pick(code, 5000) + " it's  \n\n  we'll " * 900 + pick("0123456789", 7000), "🙂" * 4000, "x" * 9000]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "'s", "don't", pick(code, 9), "12", "-", "é", pick(cjk, 3), "\t"]) for _ in range(9000)) for _ in range(4)]
    return texts


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("capacity", [2048, 100])
def test_every_piece_has_the_tokens_it_states(vocabulary, capacity):
    """Each piece, encoded alone, has its stated length, which is no more than the capacity; together they are the text."""
    path = str(public_tokenizers.path(vocabulary))
    cutter = packing.TokenPieces(capacity, path, whole_chars=20_000, overlap=500)
    for text, pieces in zip(texts := hard_texts(), cutter.load()([x.encode() for x in texts])):
        assert b"".join(p for p, _ in pieces).decode() == text
        alone = cutter.tokens.counts([p for p, _ in pieces])
        assert alone == [n for _, n in pieces] and max(alone) <= capacity
        assert len(pieces) <= 1.6 * sum(alone) / capacity + 3  # and few are needed


def test_a_character_of_more_tokens_than_a_piece():
    cutter = packing.TokenPieces(1, str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = cutter.load()(["a🙂b".encode()])[0]
    assert b"".join(p for p, _ in pieces).decode() == "a🙂b" and max(n for _, n in pieces) > 1


def test_cuts_lie_between_words():
    cut = packing.Words(3)._cut
    assert cut(b"  a b\n c  d e f g ") == [(b"  a b\n c  ", 3), (b"d e f ", 3), (b"g ", 1)]
    assert cut(b"") == [(b"", 0)] and cut(b" \t") == [(b" \t", 0)] and cut(b"a b c") == [(b"a b c", 3)]


def test_repeated_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(None, "same words", "a")] * 200, "doc_id long, text string, source string").coalesce(1)
    rows = packing.packed(spark, docs, capacity=10, shard_rows=20).collect()
    assert len({r.bin_id for r in rows}) == 200 and len({r.bin_id >> 32 for r in rows}) > 5


def test_packing_is_the_brute_force_packing(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 40)), rng.choice("abcde"), rng.choice([None, 1, 2])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, group long")
    for cluster in (None, "group"):
        got = {r.doc_id: r.bin_id for r in packing.packed(spark, docs, capacity=60, cluster=cluster).collect()}
        items = sorted(((len(t.split()), i, s, g if cluster else t.lower()) for i, t, s, g in rows), key=lambda x: (-x[0], x[1]))
        assert [got[i] for _, i, _, _ in items] == brute_fit([(n, s, c) for n, _, s, c in items], 60)
    assert packing.packed(spark, empty(spark)).collect() == []


# decontamination -------------------------------------------------------------------------------------------------------
def brute_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for x in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != x)))
        row, best = new, min(best, new[-1])
    return best


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + (kind != 0)] = [] if kind == 2 else [f"new{rng.randrange(99)}"]
    return words


def test_hits_match_brute_force(spark):
    rng = random.Random(7)
    items = [(i, " ".join(f"i{i}w{rng.randrange(25)}" for _ in range(rng.randrange(8, 45)))) for i in range(12)] + [(50, "tiny item"), (51, ""), (52, None), (None, None), (53, "short five word item here"), (54, "now this item has six words")]
    docs = []
    for d in range(90):
        words = prose(rng, rng.randrange(5, 80)).split()
        if d % 2:
            item = rng.choice(items[:12])[1].split()
            at = rng.randrange(len(words))
            words[at:at] = edited(rng, item, rng.randrange(0, len(item) // 3))
        text = " ".join(words)
        docs.append((d, text.upper() + "!!" if d % 5 == 0 else text.replace(" ", ", ", 3)))
    docs += [(200, "Tiny, item."), (201, "a tiny item in a text"), (202, None), (204, "w1 " * 30 + "a short, FIVE word item here. w2 w3"), (205, "w4 w5 now this has six words w6"), (206, "w4 now that has ten words w6"), (203, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (5, 1000):
        got = {}
        for r in decontaminate.matches(spark, frame, bench, block=block).collect():
            got.setdefault(r.doc_id, {}).update({h.item_id: h.distance for h in r.hits})
        for d, t in docs:
            words, want = decontaminate.words_of(t and t.encode()), {}
            for i, x in (x for x in items if x[1]):
                pattern = decontaminate.words_of(x.encode())
                if (k := brute_distance(pattern, words)) <= int(0.2 * len(pattern)):
                    want[i] = k
            assert got[d] == want, d
        assert got[201] == {50: 0} and got[204] == {53: 0} and got[205] == {54: 1} and got[206] == {}


def test_clean_drops_leaks_only(spark):
    rng = random.Random(9)
    item = prose(rng, 30, 4000)
    docs = messy(spark)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.clean(spark, docs, bench).count() == docs.count()
    leak = docs.where("doc_id = 12").withColumn("text", F.concat("text", F.lit(" " + item.upper())))
    out = decontaminate.clean(spark, docs.unionByName(leak), bench)
    assert out.count() == docs.count() and out.columns == docs.columns


def test_one_block_at_a_time(spark, monkeypatch):
    """Ten blocks give what one gives, and no more than one is held beside the one that is being built."""
    rng = random.Random(10)
    items = [(i, prose(rng, 12, 4000)) for i in range(20)]
    bench = spark.createDataFrame([(*x, 0, 0) for x in items], "item_id long, text string, rid long, hits long").repartition(2)
    rows = [(d, prose(rng, 20, 4000) + " " + items[d % 20][1] + " x " + items[(d + 7) % 20][1] if d % 25 < 18 else prose(rng, 20), d) for d in range(40)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None, 0)], "doc_id long, text string, hits long")
    alive, most = weakref.WeakSet(), [0]

    class Counted(decontaminate.Pieces):
        def __init__(self, *a):
            alive.add(self)
            most[0] = max(most[0], len(alive))
            super().__init__(*a)

        def __reduce__(self):
            return (_plain, (self.__dict__,))

    told = lambda block: sorted(repr((r.doc_id, r.n_words, sorted(r.hits))) for r in decontaminate.matches(spark, docs, bench, block=block).collect())
    stay = lambda block: sorted(map(repr, decontaminate.clean(spark, docs, bench, block=block).collect()))
    one = told(1000), stay(1000)
    monkeypatch.setattr(decontaminate, "Pieces", Counted)
    assert (told(2), stay(2)) == one and most[0] <= 2
    assert 0 < len(one[1]) < len(one[0]) == 42


def _plain(state):
    out = decontaminate.Pieces.__new__(decontaminate.Pieces)
    out.__dict__.update(state)
    return out


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = messy(spark)
    assert all(r.hits == [] for r in decontaminate.matches(spark, docs, bench).collect())
    assert decontaminate.matches(spark, empty(spark), bench).collect() == []
    assert decontaminate.clean(spark, docs, bench).count() == docs.count()
