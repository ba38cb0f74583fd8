"""Queries over files that are read by several tasks: joins by line, record files with an offset table, CSV with line breaks."""

from pyspark.sql import functions as F

from ..operators import datasets, ranking
from ..sources import lines, readers, recordfile, writers
from ..sources.scratch import new_path
from . import checkpoints
from .catalog import CANDIDATES, candidates, query, table

#: Bytes of a split in these queries, so that small files too are cut into several.
SPLIT = 2_000


@query(f"""WITH {CANDIDATES}, per AS (SELECT conv_id, list(CAST(pos + 1 AS INTEGER) ORDER BY length(hyp) DESC, pos) AS a, list(CAST(pos + 1 AS INTEGER) ORDER BY pos DESC) AS b, list(CAST(pos + 1 AS INTEGER) ORDER BY md5(hyp), pos) AS c FROM candidates GROUP BY conv_id)
SELECT row_number() OVER (ORDER BY conv_id) - 1 AS row_id, array_to_string(a, ' ') AS length, array_to_string(b, ' ') AS last, array_to_string(c, ' ') AS digest FROM per""")
def rankings_by_line(spark, sf_dir):
    """Three text files of rankings, joined by the numbers of their lines."""
    each = candidates(spark, sf_dir).groupBy("conv_id").agg(F.collect_list(F.struct("pos", "hyp")).alias("c"))
    number = lambda key: F.transform(F.array_sort(F.transform("c", lambda x: F.struct(*key(x), x["pos"].alias("pos")))), lambda x: (x["pos"] + 1).cast("int"))
    keys = {"length": lambda x: [(-F.length(x["hyp"])).alias("k")], "last": lambda x: [(-x["pos"]).alias("k")], "digest": lambda x: [F.md5(x["hyp"]).alias("k")]}
    read = {}
    for name, key in keys.items():
        path = new_path(spark, name)
        writers.rankings(each.select("conv_id", number(key).alias("ranking")).orderBy("conv_id").coalesce(1), path)
        read[name] = readers.rankings(lines.numbered_lines(spark, path, split_bytes=SPLIT)).select("row_id", "ranking")
    joined = ranking.by_position(**read)
    return joined.select("row_id", *(F.array_join(F.transform(f"{c}.ranking", lambda x: x.cast("string")), " ").alias(c) for c in read))


_RECORDS = "doc_id long, text string, lang string, n_chars long"


def _record_file(spark, sf_dir):
    path = new_path(spark, "records")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    recordfile.write_records(rows.where("doc_id % 3 > 0"), path, [F.col("doc_id")])
    recordfile.write_records(rows.where("doc_id % 3 = 0"), path, [F.col("doc_id")])
    return path


_IN_FILE = "SELECT row_number() OVER (ORDER BY doc_id % 3 = 0, doc_id) - 1 AS row_id, doc_id, md5(text) AS digest, lang, n_chars FROM documents"


def _digested(rows):
    return rows.select("row_id", "doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query(_IN_FILE)
def record_file_scan(spark, sf_dir):
    """A record file that was written, appended to, and read whole."""
    return _digested(recordfile.read_records(spark, _record_file(spark, sf_dir), _RECORDS))


@query(f"SELECT * FROM ({_IN_FILE}) WHERE row_id >= 10 AND row_id < 150 AND (row_id - 10) % 7 = 0 OR row_id = 199")
def record_file_slice(spark, sf_dir):
    """A slice and one record of it, by its offset table."""
    path = _record_file(spark, sf_dir)
    rows = recordfile.read_records(spark, path, _RECORDS, 10, 150, 7).unionByName(recordfile.record(spark, path, 199, _RECORDS))
    return _digested(rows)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source FROM documents")
def csv_scan_split(spark, sf_dir):
    """CSV files with line breaks in their fields, one a partition of the table, each read by a task a split."""
    path = new_path(spark, "csv")
    writers.csv(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text", "source"), path)
    return lines.csv_records(spark, path, "doc_id string, text string, source string", split_bytes=50 * SPLIT, exact=True)


@query("SELECT row_number() OVER (ORDER BY item_id = 0, 'a=' || (item_id % 4), 'n=' || item_id) AS place, md5(text || chr(10)) AS digest FROM benchmark")
def directory_walk(spark, sf_dir):
    """The files of a tree, those of its folders before its own."""
    path = new_path(spark, "tree")
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("a"), F.col("item_id").alias("n"), "text")
    b.where("n > 0").select("a", "n", "text").write.partitionBy("a", "n").text(path)
    b.where("n = 0").select("text").coalesce(1).write.mode("append").text(path)
    walked = datasets.numbered(readers.whole_files(spark, path), [readers.tree_order(F.col("path"))], "place")
    return walked.select("place", F.md5("value").alias("digest"))


@query("""SELECT run, CASE run WHEN 'a' THEN 3 ELSE 2 END AS step, part, count(*) AS n, md5(string_agg(key, ' ' ORDER BY key)) AS keys, round(sum(v) * CASE run WHEN 'a' THEN 3 ELSE 2 END, 4) AS total
FROM (SELECT CASE WHEN vec_id % 4 = 0 THEN 'v_head' ELSE 'pretrained' END AS part, 'layer.' || vec_id AS key, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM embeddings), (VALUES ('a'), ('b')) t(run) GROUP BY run, part""")
def checkpoint_parts(spark, sf_dir):
    """The latest weights of two runs, by the parts that their keys name."""
    path = new_path(spark, "checkpoints")
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.when(F.col("vec_id") % 4 == 0, "v_head.").otherwise(""), F.lit("layer."), F.col("vec_id").cast("string")).alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("value"))
    for run, steps in (("a", 3), ("b", 2)):
        for step in range(1, steps + 1):
            checkpoints.save(e.withColumn("value", F.transform("value", lambda x: x * step)), path, run, step)
    rows = checkpoints.split_by_prefix(checkpoints.load(spark, path, "key string, value array<double>"), ["v_head."], "pretrained")
    total = F.aggregate("value", F.lit(0.0), lambda a, x: a + x)
    keys = F.md5(F.array_join(F.array_sort(F.collect_list("key")), " "))
    return rows.groupBy("run", F.col("step").cast("int").alias("step"), "part").agg(F.count("*").alias("n"), keys.alias("keys"), F.round(F.sum(total), 4).alias("total"))
