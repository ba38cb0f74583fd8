import re
import zlib

import public_tokenizers

import corpus_pipeline
from loomwright.llm import _text, decontaminate, queries, simhash, substring, tokens
from loomwright.llm._text import spread

from .cases import empty, messy
from .test_near_duplicates import brute_similar
from .test_packing_and_decontamination import brute_distance, rebuilt
from .test_substring import brute as brute_substring


def _tables(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, "p q r s t u v w x y z")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "best_fit_packing"]
    of = dict(corpus_pipeline.STAGES)
    clean = spark.createDataFrame(of["toxicity"](spark, docs, sf).collect(), docs.schema)
    assert clean.columns == docs.columns and clean.count() >= 0.8 * docs.count()

    one = of["simhash_near_dedup"](spark, clean, sf)
    rows = clean.collect()
    assert sorted(r.doc_id for r in one.collect()) == brute_similar([(r.doc_id, r.text) for r in rows])

    kept = spark.createDataFrame(one.collect(), docs.schema)
    cut = {r.doc_id: r for r in of["substring_dedup"](spark, kept, sf).collect()}
    before = {r.doc_id: r for r in kept.collect()}
    want = brute_substring([(r.doc_id, r.text) for r in before.values()])
    assert len(cut) == len(want)
    for i, n, gone, _ in want:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", cut[i].text or "")) == n - gone
        assert gone or cut[i].text == before[i].text

    part = spark.createDataFrame(list(cut.values()), docs.schema)
    left = of["decontamination"](spark, part, sf).collect()
    items = [decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {}
    for i, r in cut.items():
        words = decontaminate.words_of((r.text or "").encode())
        # an item cannot be within its budget if it shares too few words with the text at all
        held[i] = any(len(set(x) - set(words)) <= int(0.2 * len(x)) and brute_distance(x, words) <= int(0.2 * len(x)) for x in items)
    assert sorted(r.doc_id for r in left) == sorted(i for i, leak in held.items() if not leak) and any(held.values())

    last = spark.createDataFrame(left, docs.schema)
    sequences = of["best_fit_packing"](spark, last, sf).collect()
    rebuilt(last, sequences, 2048)
    assert all(r.doc_ids == [p.doc_id for p in r.pieces] for r in sequences)

    # the whole run gives the texts that these stages leave, in pieces of the tokens that they state
    pieces = [p for r in corpus_pipeline.run(spark, sf).collect() for p in r.pieces]
    texts = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.piece)):
        assert p.piece_start == len(texts.get(p.doc_id, ""))
        texts[p.doc_id] = texts.get(p.doc_id, "") + p.text
    assert texts == {r.doc_id: r.text or "" for r in left}
    counted = tokens.Tokens(str(public_tokenizers.path("byte_bpe_50k.json"))).counts([p.text.encode() for p in pieces])
    assert counted == [p.length for p in pieces]


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    for name, docs in (("messy", messy(spark)), ("plain", messy(spark, extra=False)), ("none", empty(spark))):
        path = f"{tmp_path}/{name}"
        _tables(spark, path, docs)
        got = corpus_pipeline.run(spark, path).collect()
        assert (len(got) > 0) == (name != "none")


def test_queries_are_registered(spark, sf):
    names = sorted(queries.queries(), key=lambda x: (len(x), x))
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert zlib.crc32(b"0") >= 0 and set(queries.oracle_sql()) <= set(names)


def test_beyond_the_broadcasts_bound(spark, monkeypatch):
    """The same results where tables of keys are too long to be broadcast."""
    docs = messy(spark)
    told = lambda frame: sorted(map(repr, frame.collect()))
    results = []
    for bound in (200_000, 0):
        monkeypatch.setattr(_text, "BROADCAST_ROWS", bound)
        dedup = substring.SubstringDedup(spark, docs)
        results.append((told(simhash.deduplicated(spark, docs, similar_by=5)), told(dedup.applied(docs, length="n_chars")), told(dedup.rows)))
        dedup.drop()
    assert results[0] == results[1]


def test_small_scans_use_all_cores(spark, tmp_path):
    docs = messy(spark, extra=False)
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    docs.repartition(4).write.parquet(f"{tmp_path}/four")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    width = lambda frame: frame.rdd.getNumPartitions()
    assert width(spread(read("one"))) == 4 and spread(read("one")).count() == docs.count()
    dealt = read("one").repartition(1)
    assert spread(dealt) is dealt
