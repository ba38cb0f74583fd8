"""Files by line, record files, stores by key, and the structures over ordinals, held against plain forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import datasets, rewards
from loomwright.plans import checkpoints
from loomwright.sources import lines, readers, recordfile
from loomwright.sources.store import KeyedStore


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


# lines -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("split", [None, 90, 700])
def test_lines_are_numbered_across_splits_and_files(spark, tmp_path, split):
    rng = random.Random(3)
    files = {"a.txt": ["x" * rng.randrange(90) for _ in range(40)], "b.txt": [], "c.txt": ["", "", "last without an end"], "d.txt": ["é🙂", "", "one\ttwo"] * 30}
    for name, values in files.items():
        end = "\r\n" if name == "d.txt" else "\n"
        (tmp_path / name).write_text(end.join(values) + (end if values and name != "c.txt" else ""), newline="")
    got = sorted((r.row_id, r.value) for r in lines.numbered_lines(spark, str(tmp_path), split_bytes=split).collect())
    want = [v for name in sorted(files) for v in files[name]]
    assert got == list(enumerate(want))


def csv_text(rng, rows, end):
    field = lambda: rng.choice(["", "plain", "two words", '"quoted"', '"a ""b"" c"', f'"line{end}break"', f'"{end}{end}x"', '""', '","', '"' + "long " * rng.randrange(60) + f'{end}"'])
    return "".join(f"{i},{field()},{field()}{end}{end if rng.random() < 0.05 else ''}" for i in range(rows))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [150, 1500])
def test_split_csv_equals_the_one_task_reader(spark, tmp_path, end, split):
    rng = random.Random(split)
    schema = "id string, a string, b string"
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text(f"id,a,b{end}" + csv_text(rng, 60, end) + ('999,"no end",x' if k else ""), newline="")
    got = lines.csv_records(spark, str(tmp_path), schema, split_bytes=split)
    want = readers.csv(spark, str(tmp_path), schema=schema)
    key = lambda rows: sorted(map(repr, rows.collect()))
    assert key(got) == key(want) and got.count() == 121
    bare = lines.csv_records(spark, str(tmp_path / "0.csv"), schema, header=False, split_bytes=split)
    assert key(bare) == key(readers.csv(spark, str(tmp_path / "0.csv"), header=False, schema=schema))


def test_a_record_over_many_splits_and_odd_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id;t\n1;"' + "line\n" * 150 + '"\n2;short\n3\n4;a;too long\n5;"end"')
    got = {r.id: r.t for r in lines.csv_records(spark, str(tmp_path), "id string, t string", sep=";", split_bytes=100).collect()}
    assert got == {"1": "line\n" * 150, "2": "short", "3": None, "4": "a", "5": "end"}
    split = lines._placed(spark, str(tmp_path), 100)
    assert split.select("start").distinct().count() > 5


# record files ------------------------------------------------------------------------------------------------------------
RECORD = "name string, n long, tags array<string>"


def some(spark, first, n):
    return spark.createDataFrame([(f"é{i}🙂" if i % 5 else None, i, ["a"] * (i % 3)) for i in range(first, first + n)], RECORD)


def test_record_file_format_and_slices(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/r"
    recordfile.write_records(some(spark, 0, 40).repartition(3), path, [F.col("n")])
    recordfile.write_records(some(spark, 40, 11), path, [F.desc("n")])
    order = [*range(40), *range(50, 39, -1)]
    for a, b, step in ((None, None, 1), (3, 45, 1), (38, 51, 4), (50, 60, 1), (51, 99, 1), (0, 0, 1), (1, None, 7)):
        got = sorted((r.row_id, r.n, r.name, r.tags) for r in recordfile.read_records(spark, path, RECORD, a, b, step).collect())
        assert got == [(i, order[i], f"é{order[i]}🙂" if order[i] % 5 else None, ["a"] * (order[i] % 3)) for i in range(51)[a:b:step]]
    parts = recordfile.parts_of(path)
    assert sum(n for _, n in parts) == 51
    for name, n in parts:
        raw, data = ((tmp_path / "r" / f"{name}.{x}").read_bytes() for x in ("index", "data"))
        assert int.from_bytes(raw[:4], "big") == n and len(raw) == 4 + 6 * n
        at = [int.from_bytes(raw[4 + 6 * i : 10 + 6 * i], "big") for i in range(n)]
        assert at == sorted(at) and at[0] == 0 and data[at[-1] :].decode().startswith("{")


def test_a_lookup_reads_its_record_alone(spark, tmp_path):
    path = f"{tmp_path}/r"
    recordfile.write_records(some(spark, 0, 30).coalesce(1), path, [F.lit(1), F.col("n")])
    (name, _), *_ = [x for x in recordfile.parts_of(path) if x[1] > 9]
    raw = open(f"{path}/{name}.index", "rb").read()
    at = [int.from_bytes(raw[4 + 6 * i : 10 + 6 * i], "big") for i in (4, 5)]
    with open(f"{path}/{name}.data", "r+b") as f:  # all others are spoilt
        whole = f.read()
        f.seek(0)
        f.write(b"\xff" * at[0] + whole[at[0] : at[1]] + b"\xff" * (len(whole) - at[1]))
    with open(f"{path}/{name}.index", "r+b") as f:
        f.seek(4)
        f.write(b"\xee" * 24 + raw[28:40] + b"\xee" * (len(raw) - 40))
    base = sum(n for x, n in recordfile.parts_of(path)[: [x for x, _ in recordfile.parts_of(path)].index(name)])
    found = recordfile.record(spark, path, base + 4, RECORD).collect()
    assert len(found) == 1 and found[0].row_id == base + 4
    assert recordfile.record(spark, path, 30, RECORD).collect() == []


def test_appenders_to_a_record_file(spark, tmp_path):
    path = f"{tmp_path}/r"
    recordfile.write_records(some(spark, 0, 5), path, [F.col("n")])
    late = recordfile._Writer({"path": path}, False)  # began before the next one, and commits after it
    recordfile.write_records(some(spark, 5, 5), path, [F.col("n")])
    with pytest.raises(RuntimeError, match="came first"):
        late.commit([recordfile._Written(0, "part-x", 3)])
    assert recordfile.read_records(spark, path, RECORD).count() == 10
    recordfile.write_records(some(spark, 0, 0), path, [F.col("n")])
    assert sorted(r.n for r in recordfile.read_records(spark, path, RECORD).collect()) == list(range(10))
    recordfile.write_records(some(spark, 3, 2), path, [F.col("n")], mode="overwrite")
    assert [r.n for r in recordfile.read_records(spark, path, RECORD).orderBy("row_id").collect()] == [3, 4]
    with pytest.raises(Exception, match="no record file"):
        recordfile.read_records(spark, f"{tmp_path}/none", RECORD).collect()
    with pytest.raises(ValueError):
        recordfile.parts_of("hdfs://x/y")


# stores ------------------------------------------------------------------------------------------------------------------
def test_store_against_a_dictionary(spark, tmp_path):
    rng, want = random.Random(2), {}
    store = KeyedStore(spark, str(tmp_path / "s"), "a long, b string, v int, w string", ["a", "b"], buckets=8)
    assert store.read().count() == 0 and store.upsert(spark.createDataFrame([], "a long, b string, v int, w string")) == 0
    for _ in range(4):
        batch = [(rng.choice([None, *range(12)]), rng.choice("xyz"), i, rng.choice([None, "t"])) for i in range(25)]
        store.upsert(spark.createDataFrame(batch, "a long, b string, v int, w string"), order="v")
        want |= {(a, b): (v, w) for a, b, v, w in batch}
        again = KeyedStore(spark, str(tmp_path / "s"), "a long, b string, v int, w string", ["a", "b"])  # opened anew
        assert again.buckets == 8 and {(r.a, r.b): (r.v, r.w) for r in again.read().collect()} == want and again.read().count() == len(want)
    keys = spark.createDataFrame([(3, "x"), (77, "x")], "a long, b string")
    assert {(r.a, r.b): r.v for r in store.lookup(keys).collect()} == {k: v[0] for k, v in want.items() if k in {(3, "x"), (77, "x")}}


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "a long, v int", ["a"], buckets=16)
    store.upsert(spark.range(400).select(F.col("id").alias("a"), F.lit(0).alias("v")))
    before = store._manifest()[1]["at"]
    assert store.upsert(spark.createDataFrame([(5, 1), (5, 2), (1000, 3)], "a long, v int"), order="v") <= 2
    after = store._manifest()[1]["at"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 0 < len(changed) <= 2 and store.read().count() == 401 and store.read().where("a = 5").first().v == 2
    scanned = store.lookup(spark.createDataFrame([(5,)], "a long"))
    assert {os.path.basename(os.path.dirname(f)) for f in scanned.inputFiles()} <= {f"bucket={b}" for b in changed} | {""}


def test_of_two_writers_the_second_fails(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "a long, v int", ["a"], buckets=4)
    store.upsert(spark.createDataFrame([(1, 1)], "a long, v int"))
    stale = store._manifest()
    store.upsert(spark.createDataFrame([(2, 2)], "a long, v int"))
    store._manifest, fresh = (lambda: stale), store._manifest
    with pytest.raises(RuntimeError, match="came first"):
        store.upsert(spark.createDataFrame([(3, 3)], "a long, v int"))
    store._manifest = fresh
    assert sorted(r.a for r in store.read().collect()) == [1, 2]


# ordinals ----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("rows", [1, 2, 3, 17, 1000, 4097])
def test_permutations_are_permutations(spark, rows):
    frame = spark.range(rows).select("id", *(datasets.permuted(F.col("id"), rows, seed).alias(f"p{seed}") for seed in (0, 5)))
    got = frame.collect()
    for c in ("p0", "p5"):
        assert sorted(r[c] for r in got) == list(range(rows))
    if rows >= 1000:
        assert sum(r.p0 == r.p5 for r in got) < rows / 50 and sum(r.p0 == r.id for r in got) < rows / 50
        pairs = sum(abs(a.p0 - b.p0) < rows / 10 for a, b in zip(got, got[1:]))
        assert pairs < rows / 3  # neighbours do not stay together


def test_permuted_epochs_need_no_exchange(spark):
    frame = spark.range(103).withColumnRenamed("id", "row_id")
    whole = datasets.permuted_epoch(frame, 103, seed=3, number=0, size=10)
    assert "Exchange" not in plan(whole) and "Sort" not in plan(whole)
    sizes = {r.batch: r["count"] for r in whole.groupBy("batch").count().collect()}
    assert sizes == {b: 10 for b in range(10)}
    rest = datasets.permuted_epoch(frame, 103, seed=3, number=0, size=10, skip=7)
    assert {(r.row_id, r.batch) for r in rest.collect()} == {(r.row_id, r.batch) for r in whole.collect() if r.batch >= 7}
    other = datasets.permuted_epoch(frame, 103, seed=3, number=1, size=10)
    assert {r.row_id: r.place for r in other.collect()} != {r.row_id: r.place for r in whole.collect()}


def test_regrouping_matches_slices(spark, monkeypatch):
    monkeypatch.setattr(datasets, "RANGE_ROWS", 7)
    rng = random.Random(1)
    sizes = [rng.choice([0, 0, 1, 2, 5, 63, 64, 65, 300]) for _ in range(60)] + [None]
    total = sum(x or 0 for x in sizes)
    groups = spark.createDataFrame(list(enumerate(sizes)), "g long, size int").repartition(3)
    values = spark.range(total + 20).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("v"))
    out = datasets.regrouped(values, groups, order=[F.col("g")])
    want, at = {}, 0
    for g, n in enumerate(sizes):
        if n:
            want[g] = [3 * i for i in range(at, at + n)]
            at += n
    assert {r.g: sorted(r.vs) for r in out.groupBy("g").agg(F.collect_list("v").alias("vs")).collect()} == want
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    with pytest.raises(Exception, match="negative"):
        datasets.regrouped(values, spark.createDataFrame([(0, -1)], "g long, size int"), order=[F.col("g")]).collect()


def test_prefix_sums(spark, monkeypatch):
    monkeypatch.setattr(datasets, "RANGE_ROWS", 5)
    rng = random.Random(7)
    values = [(i, rng.randrange(9)) for i in range(53)]
    got = {r.i: r.s for r in datasets.prefix_sums(spark.createDataFrame(values, "i long, v long").repartition(4), [F.col("i")], "v", "s").collect()}
    assert got == {i: sum(v for _, v in values[:i]) for i, _ in values}
    assert datasets.prefix_sums(spark.createDataFrame([], "i long, v long"), [F.col("i")], "v", "s").collect() == []


# sketches ----------------------------------------------------------------------------------------------------------------
def test_merged_sketches_are_near_exact(spark):
    frame = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 37).alias("step"), F.when(F.col("id") % 11 > 0, F.exp(F.rand(4) * 12)).alias("v"))
    frame = spark.createDataFrame(frame.collect(), frame.schema)  # the same values in both readings
    steps = rewards.sketched(frame, ["g", "step"], "v")
    merged = rewards.quantiles(rewards.merged_sketches(steps, ["g"]), ["g"], [0.01, 0.5, 0.9, 0.999]).collect()
    assert len(merged) == 8
    for r in merged:
        of = frame.where(f"g = {r.g} AND v IS NOT NULL")
        assert abs(of.where(F.col("v") <= r.q).count() / of.count() - r.p) <= rewards.RANK_ERROR


# checkpoints and trees -----------------------------------------------------------------------------------------------------
def test_checkpoints_are_saved_loaded_and_split(spark, tmp_path):
    path = str(tmp_path / "c")
    made = lambda v: spark.createDataFrame([("v_head.a", v), ("v_head.deep.b", v), ("model.v_head.c", v), ("v", v)], "key string, value long")
    for run, step in (("x", 2), ("x", 10), ("y", 1)):
        checkpoints.save(made(step), path, run, step)
    with pytest.raises(Exception, match="exists"):
        checkpoints.save(made(0), path, "x", 10)
    load = lambda **o: {(r.run, r.step, r.value) for r in checkpoints.load(spark, path, "key string, value long", **o).collect()}
    assert load() == {("x", 10, 10), ("y", 1, 1)} and load(run="x") == {("x", 10, 10)} and load(run="x", step=2) == {("x", 2, 2)}
    got = {(r.part, r.key) for r in checkpoints.split_by_prefix(made(1), ["v_head.", "v_head.deep."], "rest").collect()}
    assert got == {("v_head", "a"), ("v_head.deep", "b"), ("rest", "model.v_head.c"), ("rest", "v")}


def test_trees_are_walked_folders_first(spark):
    paths = ["t/z.txt", "t/a.txt", "t/b/1.txt", "t/b/c/9.txt", "t/b-x/0.txt", "t/b/a.txt"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in frame.orderBy(readers.tree_order(F.col("path"))).collect()] == ["t/b/c/9.txt", "t/b/1.txt", "t/b/a.txt", "t/b-x/0.txt", "t/a.txt", "t/z.txt"]
