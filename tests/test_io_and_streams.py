"""Sources, sinks and streams over small files."""

import csv
import datetime
import json

import pytest
from pyspark.sql import functions as F

from loomwright.plans import jobs as tasks
from loomwright.sources import readers, writers
from loomwright.sources.store import KeyedStore
from loomwright.streaming import jobs


def test_csv_cases(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes(b'x,y\r\n1,"a ""q"" b"\r\n2,"line\nbreak"\r\n3,last')
    got = [(r.x, r.y) for r in readers.csv(spark, str(p)).collect()]
    assert got == [("1", 'a "q" b'), ("2", "line\nbreak"), ("3", "last")]
    assert len(readers.csv(spark, str(p), header=False).collect()) == 4
    with pytest.raises(ValueError):
        readers.csv(spark, str(p), sep=";;")


def test_csv_round_trip(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string"), "text")
    writers.csv(docs, f"{tmp_path}/c")
    assert sorted(map(tuple, readers.csv(spark, f"{tmp_path}/c").collect())) == sorted(map(tuple, docs.collect()))
    with open(next((tmp_path / "c").glob("part*.csv")), newline="") as f:
        assert next(csv.reader(f)) == ["doc_id", "text"]


def test_jsonl_and_formats(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"sentence": "a"}\n{"sentence": ""}\n{"sentence": null}\n')
    assert [r.sentence for r in readers.sentences(spark, str(p)).collect()] == ["a"]
    p.write_text('{"sentence": "a"}\n{oops\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(p), readers.SENTENCES).collect()
    loose = readers.jsonl(spark, str(p), readers.SENTENCES, strict=False).cache().collect()
    assert [r._corrupt_record for r in loose] == [None, "{oops"]
    (tmp_path / "l.json").write_text(json.dumps([{"sentence": "x"}, {"sentence": "y"}], indent=1))
    assert readers.load(spark, f"{tmp_path}/l.json", "json", readers.SENTENCES).count() == 2
    with pytest.raises(ValueError, match="unknown format"):
        readers.load(spark, "x", "xml")
    assert readers.in_memory(spark, [{"a": 1}, {"a": 2}], "a int").where("row_id = 1").first().a == 2


def test_corpora(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps({"single_documents": [{"raw_text": "a"}, {"raw_text": "b"}], "summary": "s"}) + "\n")
    assert tuple(readers.multi_document(spark, f"{tmp_path}/m.jsonl").first()) == ("a b", "s")
    (tmp_path / "s.jsonl").write_text(json.dumps({"src_txt": ["a", "b"], "tgt_txt": "t"}) + "\n")
    assert tuple(readers.shards(spark, f"{tmp_path}/s.jsonl").first()) == ("a b", "t")
    d = tmp_path / "v" / "deep"
    d.mkdir(parents=True)
    (d / "1.txt").write_text("Summary: the\nsum \nContent:\n text\nmore ")
    (d / "2.txt").write_text("nothing")
    assert [(r.input, r.output) for r in readers.labelled(readers.whole_files(spark, f"{tmp_path}/v")).collect()] == [("text\nmore", "the\nsum")]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "0001.txt").write_text("title \n \nsummary  \n\nbody one\t\nbody two\n\nrest")
    assert [(r.input, r.output) for r in readers.segmented(readers.whole_files(spark, f"{tmp_path}/n")).collect()] == [("body one\nbody two", "summary")]


def test_small_files(spark, tmp_path):
    (tmp_path / "r.txt").write_text(" 2, 1 ,3\n")
    assert readers.rankings(spark.read.text(f"{tmp_path}/r.txt")).first().ranking == [2, 1, 3]
    (tmp_path / "k.txt").write_text(" a \n\n b\n")
    assert [r.value for r in readers.lines(spark, f"{tmp_path}/k.txt").collect()] == ["a", "b"]
    assert readers.lines(spark, f"{tmp_path}/k.txt", keep_empty=True).count() == 3
    (tmp_path / "i.json").write_text("[3, 1, 3]")
    assert [(r.pos, r.idx) for r in readers.index_list(spark, f"{tmp_path}/i.json").collect()] == [(0, 3), (1, 1), (2, 3)]
    s = tmp_path / "side" / "s1"
    s.mkdir(parents=True)
    for name in ("m1", "prompt"):
        (s / f"{name}.txt").write_text(f"of {name}")
    assert [tuple(r) for r in readers.sidecars(spark, f"{tmp_path}/side").collect()] == [("s1", "m1", "of m1")]
    assert readers.processed_ids(spark, f"{tmp_path}/none", "sampleId", readers.GENERATED).count() == 0
    assert readers.document_store_uri("h", 1, "a@b", "p:/") == "mongodb://a%40b:p%3A%2F@h:1"


def test_nested_strings(spark):
    frame = spark.createDataFrame([("a", ["", "b"], {"k": "c"}, (1, "d"))], "s string, l array<string>, m map<string, string>, t struct<i: int, x: string>")
    r = readers.with_mapped_strings(frame, lambda c: F.concat(F.lit("<"), c, F.lit(">"))).first()
    assert (r.s, r.l, r.m, tuple(r.t)) == ("<a>", ["", "<b>"], {"k": "<c>"}, (1, "<d>"))


def test_record_store(spark, tmp_path):
    rows = spark.createDataFrame([("b",), ("a",)], "x string")
    writers.records(rows, f"{tmp_path}/r", order=[F.col("x")])
    writers.append_records(spark.createDataFrame([("d",), ("c",)], "x string"), f"{tmp_path}/r", [F.col("x")])
    assert sorted((r.row_id, r.x) for r in readers.records(spark, f"{tmp_path}/r").collect()) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        writers.records(rows, f"{tmp_path}/q")


def test_text_sinks(spark, tmp_path):
    frame = spark.createDataFrame([([2, 1], 0.5), ([1], None)], "ranking array<int>, a double")
    writers.rankings(frame, f"{tmp_path}/k")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/k").collect()) == ["1", "2, 1"]
    writers.numbers(frame, f"{tmp_path}/n", "a")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/n").collect()) == ["", "0.5"]
    t = datetime.datetime(2024, 1, 2)
    writers.samples(spark.createDataFrame([("s", t, t)], "sampleId string, createdAt timestamp, updatedAt timestamp"), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first().createdAt == "2024-01-02 00:00:00"
    writers.both_formats(frame, f"{tmp_path}/b", "both")
    assert spark.read.parquet(f"{tmp_path}/b/records").count() == spark.read.json(f"{tmp_path}/b/jsonl").count() == 2
    writers.jsonl(frame, f"{tmp_path}/j")
    writers.jsonl(frame, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 4
    writers.stats(spark, {"a": 1}, f"{tmp_path}/st")
    assert json.loads(spark.read.text(f"{tmp_path}/st").first().value) == {"a": 1}
    assert "undefined" in writers.isotropy_report(None, 0) and "0.500000" in writers.isotropy_report(0.5, 3)


def test_latex_table(spark):
    frame = spark.createDataFrame([("b & c", "2"), ("a", "1")], "x string, y string")
    out = writers.latex_table(frame, [F.col("y")], ["x", "y"], [0.1, 0.5, 0.4], 4.0, "W{width} L{layout}\n{content}", add_order=True)
    assert out.splitlines()[0].startswith("W4.0 LP{0.1\\linewidth")
    assert out.splitlines()[2:] == ["1 & a & 1\\\\", "\\rowcolor{light-gray}2 & b \\& c & 2\\\\"]
    with pytest.raises(ValueError):
        writers.latex_table(frame, [F.col("y")], ["x"], [0.1, 0.2], 4.0, "")


def test_resumed_stream(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = spark.range(4).withColumnRenamed("id", "k")
    for part in (rows, rows.where("k > 1"), spark.range(10, 12).withColumnRenamed("id", "k")):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        jobs.resume(stream, out, f"{tmp_path}/cp", "k", lambda b: b.withColumn("done", F.lit(True))).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 10, 11]


def test_stream_resumed_into_a_store(spark, tmp_path):
    src, worked = f"{tmp_path}/in", []
    store = KeyedStore(spark, f"{tmp_path}/out", "k long, batch int", ["k"], buckets=8)
    rows = spark.range(40).withColumnRenamed("id", "k")
    for n, part in enumerate((rows, rows.where("k > 35").union(rows.where("k > 35")), spark.range(100, 101).withColumnRenamed("id", "k"))):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        before = store._manifest()[1]["at"]
        jobs.resume_into(stream, store, f"{tmp_path}/cp", lambda b, n=n: worked.append(b.count()) or b.withColumn("batch", F.lit(n))).awaitTermination()
        changed = {b for b, at in store._manifest()[1]["at"].items() if before.get(b) != at}
        assert len(changed) == (8 if n == 0 else n // 2)
    assert worked == [40, 0, 1]
    assert sorted((r.k, r.batch) for r in store.read().collect()) == [*((k, 0) for k in range(40)), (100, 2)]


def test_running_baseline_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    q = jobs.running_baseline(stream).writeStream.format("memory").queryName("base").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    from loomwright.operators.rewards import baselines

    want = {r.event_id: r.baseline for r in baselines(events, "value", ["user_id"], ["ts", "event_id"]).collect()}
    got = {r.event_id: r.baseline for r in spark.table("base").collect()}
    assert got == pytest.approx(want)


def test_windowed_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    q = jobs.windowed_rewards(stream).writeStream.format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/cp").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("win").agg(F.sum("n")).first()[0] == events.count()


def test_jobs_on_files(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text('{"id": 2, "text": "b"}\n{"id": 1, "text": "a c"}\n')
    out = tasks.to_store(spark, str(p), f"{tmp_path}/store", "id long, text string", ["id"])
    assert sorted((r.row_id, r.id) for r in out.collect()) == [(0, 1), (1, 2)]
    first = tasks.pretokenized(spark, f"{tmp_path}/store", F.length, ["text"])
    writers.records(spark.createDataFrame([(2, "later", 9)], "id long, text string, row_id long"), f"{tmp_path}/store", append=True)
    again = tasks.pretokenized(spark, f"{tmp_path}/store", F.length, ["text"])
    assert first.count() == again.count() == 2  # written once, then read
    assert {r.id: r.pretokenized.text for r in again.collect()} == {1: 3, 2: 1}
    p.write_text('{"id": 2, "text": "b"}\n{"id": \n')
    with pytest.raises(Exception):
        tasks.to_store(spark, str(p), f"{tmp_path}/none", "id long, text string", ["id"])
    assert not (tmp_path / "none" / "_SUCCESS").exists()


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "in.jsonl"
    p.write_text("".join(f'{{"id": {i}}}\n' for i in range(20)))
    tasks.main(["to-store", str(p), f"{tmp_path}/store", "--schema", "id long", "--order", "id"])
    assert '"rows": 20' in capsys.readouterr().out
    tasks.main(["split", f"{tmp_path}/store", f"{tmp_path}/split", "--eval-rows", "5"])
    assert {r.split: r["count"] for r in spark.read.parquet(f"{tmp_path}/split").groupBy("split").count().collect()} == {"train": 15, "eval": 5}
    with pytest.raises(SystemExit):
        tasks.main(["--log-level", "loud", "split", "a", "b"])
    spark.sparkContext.setLogLevel("OFF")


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    writers.csv(spark.createDataFrame([("a,b", 'c"d'), ("", None)], "x string, y string"), f"{tmp_path}/c")
    rows = [sorted(map(repr, readers.csv(spark, f"{tmp_path}/c", line_breaks=b).collect())) for b in (True, False)]
    assert rows[0] == rows[1] and len(rows[0]) == 2


def test_document_store_needs_its_connector(spark):
    with pytest.raises(Exception, match="mongodb"):
        readers.document_store(spark, readers.document_store_uri("h", 1), "d", "c", "x string").collect()


def test_comparisons_need_their_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.comparisons(spark.range(1), f"{tmp_path}/c")
