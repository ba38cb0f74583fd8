"""Queries that read files: each writes a table in one of the layouts that the readers know, and reads it back."""

from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import datasets, ranking, vectors
from ..operators.decoding import greedy
from ..sources import lines, readers, writers
from ..sources.scratch import new_path
from . import generation
from .catalog import CANDIDATES, PAIRS, TOKENS, article_pairs, candidates, query, rounded, table


def _written_json(frame, spark, name: str) -> str:
    path = new_path(spark, name)
    writers.jsonl(frame, path)
    return path


def _written_text(frame, spark, name: str) -> str:
    """One file a row, whole, named by the row's number: for layouts of one document a file."""
    path = new_path(spark, name)
    frame.write.partitionBy("n").text(path)
    return path


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source FROM documents")
def csv_scan(spark, sf_dir):
    path = new_path(spark, "csv")
    writers.csv(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "text", "source"), path)
    return lines.csv_records(spark, path, "doc_id string, text string, source string")


@query("SELECT CAST(item_id AS VARCHAR) AS _c0, text AS _c1 FROM benchmark")
def csv_scan_headerless(spark, sf_dir):
    path = new_path(spark, "csv")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string"), "text")
    rows.write.option("header", False).option("quote", '"').option("escape", '"').option("sep", ";").csv(path)
    return lines.csv_records(spark, path, "_c0 string, _c1 string", header=False, sep=";")


@query(f"WITH {PAIRS} SELECT pair_id, input, output FROM pairs")
def jsonl_scan(spark, sf_dir):
    path = _written_json(article_pairs(spark, sf_dir).select("pair_id", "input", "output"), spark, "jsonl")
    return readers.load(spark, path, "jsonlines", "pair_id long, input string, output string")


@query("SELECT text AS sentence FROM conversations WHERE turn % 2 = 0 AND text <> ''")
def sentence_corpus(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("sentence"))
    return readers.sentences(spark, _written_json(rows, spark, "sentences"))


@query("SELECT string_agg(text, ' ' ORDER BY turn) AS input, 'conv-' || conv_id AS output FROM conversations GROUP BY conv_id")
def multi_document_scan(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    rows = t.select(F.transform("t", lambda x: F.struct(x["text"].alias("raw_text"))).alias("single_documents"), F.concat(F.lit("conv-"), "conv_id").alias("summary"))
    return readers.multi_document(spark, _written_json(rows, spark, "multi"))


@query(f"WITH {PAIRS} SELECT array_to_string(string_split(input, ' '), ' ') AS input, output FROM pairs")
def shard_scan(spark, sf_dir):
    rows = article_pairs(spark, sf_dir).select(F.split("input", " ").alias("src_txt"), F.col("output").alias("tgt_txt"))
    return readers.shards(spark, _written_json(rows, spark, "shards"))


@query(r"SELECT trim(text, ' ' || chr(10)) AS input, 'item ' || item_id AS output FROM benchmark WHERE item_id % 2 = 0")
def labelled_text_scan(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    value = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Summary: item "), "item_id", F.lit(" \nContent:\n"), "text")).otherwise("no labels here")
    files = readers.whole_files(spark, _written_text(b.select(F.col("item_id").alias("n"), value.alias("value")), spark, "labelled"))
    return readers.labelled(files).orderBy("path").select("input", "output")


@query("SELECT regexp_replace(text, '[ ]+(\\n|$)', '\\1', 'g') AS input, 'item ' || item_id AS output FROM benchmark")
def segmented_scan(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    value = F.concat(F.lit("title\n\nitem "), "item_id", F.lit("\n\n"), "text", F.lit("\n\nrest"))
    files = readers.whole_files(spark, _written_text(b.select(F.col("item_id").alias("n"), value.alias("value")), spark, "segmented"))
    return readers.segmented(files).select("input", "output")


@query("SELECT conv_id, CAST(u AS INTEGER) AS place, CAST(r[u] AS INTEGER) AS candidate FROM (SELECT conv_id, r, unnest(range(1, len(r) + 1)) AS u FROM (SELECT conv_id, list(turn + 1 ORDER BY turn DESC) AS r FROM conversations GROUP BY conv_id))")
def ranking_file_scan(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list("turn"))).alias("t"))
    line = F.concat(F.lit(" "), F.array_join(F.transform("t", lambda x: (x + 1).cast("string")), " , "), F.lit("\t"))
    parsed = readers.rankings(t.select("conv_id", line.alias("value")))
    return parsed.select("conv_id", F.posexplode("ranking").alias("place", "candidate")).select("conv_id", (F.col("place") + 1).alias("place"), "candidate")


@query("SELECT trim(url, ' ') AS value FROM pages")
def line_list_scan(spark, sf_dir):
    path = new_path(spark, "lines")
    rows = table(spark, sf_dir, "pages").select(F.explode(F.array(F.concat(F.lit("  "), "url", F.lit("\t")), F.lit(" "))).alias("value"))
    rows.write.text(path)
    return readers.lines(spark, path)


@query(f"WITH {PAIRS} SELECT pair_id AS id, input, array_to_string(list_filter(string_split_regex(input, '\\s+'), lambda x: x <> '')[1:5], ' ') AS output FROM pairs")
def generation_resume(spark, sf_dir):
    """A run that broke off is taken up: both runs' outputs together have each input once."""
    rows = article_pairs(spark, sf_dir).select(F.col("pair_id").alias("id"), "input")
    model, schema = generation.LeadingWords(5), "id long, input string, output string"
    path = _written_json(generation.generated(rows.where("id % 3 = 0"), model), spark, "generated")
    rest = generation.generated(rows, model, done=readers.processed_ids(spark, path, "id", schema))
    return readers.jsonl(spark, path, schema).unionByName(rest)


@query("SELECT CAST(event_id AS VARCHAR) AS sampleId, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created FROM events")
def sample_sink_times(spark, sf_dir):
    path = new_path(spark, "samples")
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("sampleId"), F.col("ts").cast("timestamp").alias("createdAt"), F.col("ts").cast("timestamp").alias("updatedAt"))
    writers.samples(e, path)
    return spark.read.schema("sampleId string, createdAt string").json(path).select("sampleId", F.substring("createdAt", 1, 19).alias("created"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words, md5(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ')) AS digest FROM documents")
def whitespace_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(x, '([一-鿿])', '\1 ', 'g'), '(^|[^ ])([一-鿿])', '\1 \2', 'g')) AS digest FROM (SELECT doc_id, replace(text, 'the', '中') AS x FROM documents)")
def cjk_spacing(spark, sf_dir):
    """The tables have no CJK text, so one character stands for a frequent word."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("the"), F.lit("中")).alias("x"))
    return d.select("doc_id", F.md5(text.spaced_cjk(F.col("x"))).alias("digest"))


@query(f"WITH words AS (SELECT DISTINCT unnest({TOKENS('text')}) AS word FROM benchmark) SELECT word, word IN (SELECT DISTINCT unnest({TOKENS('text')}) FROM conversations) AS known FROM words WHERE starts_with(word, 'th')")
def prefix_lookup(spark, sf_dir):
    """What a prefix tree answers: the words that begin with a prefix, and whether another dictionary has them."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    other = words("conversations").withColumn("known", F.lit(True))
    return words("benchmark").where(F.startswith("word", F.lit("th"))).join(other, "word", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT conv_id, role, arg_max(md5(text), turn) AS digest FROM conversations GROUP BY conv_id, role")
def last_name_wins(spark, sf_dir):
    """A lookup from name to text, in which the last of repeated names stays."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    of = ranking.latest_by_name(F.col("t.role"), F.col("t.text"))
    return t.select("conv_id", F.explode(of).alias("role", "text")).select("conv_id", "role", F.md5("text").alias("digest"))


@query(f"WITH {CANDIDATES} SELECT conv_id, 'turn-' || arg_max(turn, length(hyp) * 10000 - turn) AS best FROM candidates GROUP BY conv_id")
def listwise_judging(spark, sf_dir):
    """A stand-in judge ranks by length; its reply is parsed as a hosted model's would be."""
    c = candidates(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("hyp")).alias("k"), "turn"))).alias("o"))
    reply = F.concat(F.lit("Ranking: ["), F.array_join(F.transform("o", lambda x: F.concat(F.lit("turn-"), x["turn"].cast("string"))), ","), F.lit("] by length"))
    return c.select("conv_id", F.element_at(text.ranking_reply(reply), 1).alias("best"))


@query("SELECT user_id, CAST(count(*) AS INTEGER) AS n, CAST(sum(event_id % 5) AS BIGINT) AS total FROM events GROUP BY user_id")
def flattened_lists(spark, sf_dir):
    """A user's lists, one an event type, flattened into one."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.collect_list(F.col("event_id") % 5).alias("n"))
    nested = e.groupBy("user_id").agg(F.flatten(F.collect_list("n")).alias("xs"))
    return nested.select("user_id", F.size("xs").alias("n"), F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT vec_id, md5(array_to_string(list_transform(embedding[2:], lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',')) AS digest FROM embeddings")
def labels_shifted_left(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", arrays.shifted_left(F.col("embedding")).alias("x"))
    digits = F.transform("x", lambda v: F.floor(v.cast("double") * 1000000).cast("string"))
    return e.select("vec_id", F.md5(F.array_join(digits, ",")).alias("digest"))


@query("""WITH u AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings),
d AS (SELECT label, k, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS k FROM u) GROUP BY label, k),
p AS (SELECT label, (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) AS c FROM d GROUP BY label HAVING max(n) > 1)
SELECT 'Sequences: ' || count(*) || chr(10) || 'Isotropy: ' || printf('%.4f', round(1 - avg(c), 4)) AS report FROM p""")
def isotropy_report(spark, sf_dir):
    s = vectors.self_similarity(table(spark, sf_dir, "embeddings"), "label", "embedding")
    s = s.agg(F.count("*").alias("n"), F.round(1 - F.avg("similarity"), 4).alias("i"))
    return s.select(F.format_string("Sequences: %d\nIsotropy: %.4f", "n", "i").alias("report"))


@query("SELECT doc_id AS row_id, n_chars FROM documents ORDER BY doc_id")
def record_store_scan(spark, sf_dir):
    """Rows written as a record store, in order, and read back by ordinal."""
    path = new_path(spark, "records")
    writers.records(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), path, order=[F.col("doc_id")])
    return readers.records(spark, path).select("row_id", "n_chars")


_BEST = """list_sort(list_transform(list_filter(range(1, len(names) + 1), lambda i: NOT list_contains(used, out[-1] || ' ' || names[i])),
  lambda i: {'c': -len(list_filter(pairs, lambda p: p = out[-1] || ' ' || names[i])), 'i': i}))"""


@query(f"""WITH RECURSIVE texts AS (SELECT item_id AS id, text AS input, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark
), told AS (SELECT id, input, list_concat(['<s>', '</s>'], list_filter(w, lambda x, i: list_position(w, x) = i)) AS names,
  list_transform(range(0, len(w) + 1), lambda i: CASE WHEN i = 0 THEN '<s>' ELSE w[i] END || ' ' || CASE WHEN i = len(w) THEN '</s>' ELSE w[i + 1] END) AS pairs FROM texts
), steps AS (SELECT id, 0 AS n, names, pairs, ['<s>'] AS out, CAST([] AS VARCHAR[]) AS used FROM told
  UNION ALL SELECT id, n + 1, names, pairs, list_append(out, token), list_append(used, out[-1] || ' ' || token) FROM (
    SELECT *, coalesce(names[({_BEST}[1]).i], '</s>') AS token FROM steps WHERE n < 12 AND out[-1] <> '</s>'))
SELECT id, input, array_to_string(list_filter(arg_max(out, n), lambda x: x NOT IN ('<s>', '</s>')), ' ') AS output FROM steps JOIN told USING (id) GROUP BY id, input""")
def greedy_decoding(spark, sf_dir):
    """Texts continued by their own transitions, token by token, with repeated pairs blocked."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("input"))
    return b.select("id", "input", F.array_join(greedy(text.words(F.col("input")), 12), " ").alias("output"))


@query("SELECT path FROM (SELECT 'n=' || item_id AS path FROM benchmark) ORDER BY path")
def directory_order(spark, sf_dir):
    """Files of a tree in the order of their paths."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("n"), F.col("text").alias("value"))
    files = readers.whole_files(spark, _written_text(b, spark, "tree"))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("path")).orderBy("path")


@query("SELECT conv_id, turn, text AS input FROM conversations")
def field_rename(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("input"))


@query("SELECT row_id, CAST(row_id % 2 = 0 AS BOOLEAN) AS banded FROM (SELECT row_number() OVER (ORDER BY item_id) AS row_id FROM benchmark)")
def row_banding(spark, sf_dir):
    rows = datasets.numbered(table(spark, sf_dir, "benchmark").select("item_id"), [F.col("item_id")])
    return rows.select(F.col("_n").alias("row_id"), (F.col("_n") % 2 == 0).alias("banded"))
