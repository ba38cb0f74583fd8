"""Queries over whole jobs, sinks that are read back, and preferences from partial comparisons."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import datasets, ranking, training, vectors
from ..sources import readers, writers
from ..sources.scratch import new_path
from . import generation, jobs
from .catalog import _TWO, CANDIDATES, PAIRS, _comparisons, _preferences, article_pairs, candidates, query, rounded, table
from .scans import _written_json


@query("SELECT doc_id, upper(lang) AS lang, md5(lower(text)) AS digest, source FROM documents")
def field_transform(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source")
    return jobs.with_transforms(d, {"lang": "upper", "text": "lower"}).select("doc_id", "lang", F.md5("text").alias("digest"), "source")


@query("SELECT doc_id AS row_id, upper(lang) AS lang, n_chars FROM documents WHERE doc_id = 23")
def lookup_transform(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "lang", "n_chars")
    return datasets.lookup(d, 23, transform={"lang": F.upper})


@query(f"WITH {PAIRS} SELECT kind, pair_id, input, output FROM pairs, (VALUES ('json'), ('jsonlines'), ('records'), ('csv')) v(kind)")
def format_dispatch(spark, sf_dir):
    """One table in each format that `load` knows."""
    rows = article_pairs(spark, sf_dir).select("pair_id", "input", "output")
    schema, out = "pair_id long, input string, output string", None
    for kind in readers.FORMATS:
        path = new_path(spark, kind)
        if kind == "csv":
            writers.csv(rows, path)
        elif kind == "records":
            writers.records(rows.withColumn("row_id", F.col("pair_id")), path)
        elif kind == "json":
            path = _arrays(spark, rows)
        else:
            writers.jsonl(rows, path)
        part = readers.load(spark, path, kind, schema)
        part = part.select(F.lit(kind).alias("kind"), "pair_id", "input", "output")
        out = part if out is None else out.unionByName(part)
    return out


def _arrays(spark, rows) -> str:
    """JSON documents that hold an array each: one a conversation, so that none holds everything."""
    path = new_path(spark, "arrays")
    arrays = rows.groupBy((F.col("pair_id") / 10000).cast("long").alias("c")).agg(F.to_json(F.collect_list(F.struct("pair_id", "input", "output"))).alias("value"))
    arrays.select("c", "value").write.partitionBy("c").text(path)
    return f"{path}/*"


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, CAST(n_nationkey * 3 AS BIGINT) AS idx FROM nation")
def index_list_scan(spark, sf_dir):
    """A file of one JSON list, as index files are; a list of nations is bounded."""
    path = new_path(spark, "index")
    listed = table(spark, sf_dir, "nation").agg(F.to_json(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda i: i * 3)).alias("value"))
    listed.write.text(path)
    return readers.index_list(spark, path)


@query(f"WITH {PAIRS} SELECT input AS \"in\", output AS \"out\" FROM pairs")
def raw_pair_scan(spark, sf_dir):
    """JSON lines of in and out, read as they are."""
    rows = article_pairs(spark, sf_dir).select(F.col("input").alias("in"), F.col("output").alias("out"))
    return readers.jsonl(spark, _written_json(rows, spark, "raw"), "`in` string, `out` string")


@query("SELECT n_name AS value, 1 AS n FROM nation UNION ALL SELECT '', CAST(count(*) AS INTEGER) FROM nation")
def key_lines_scan(spark, sf_dir):
    """Lines with blank ones kept, and counted."""
    path = new_path(spark, "keys")
    table(spark, sf_dir, "nation").select(F.explode(F.array(F.concat("n_name", F.lit(" \t")), F.lit("  "))).alias("value")).write.text(path)
    return readers.lines(spark, path, keep_empty=True).groupBy("value").agg(F.count("*").cast("int").alias("n"))


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS row_id, item_id, CASE WHEN item_id % 3 > 0 THEN text END AS text FROM benchmark")
def list_dataset(spark, sf_dir):
    """A list of records in memory, here the test items, as a dataset."""
    rows = [{"item_id": r["item_id"], "text": r["text"] if r["item_id"] % 3 else None} for r in table(spark, sf_dir, "benchmark").orderBy("item_id").toLocalIterator()]
    return readers.in_memory(spark, rows, "item_id long, text string")


@query(f"WITH {PAIRS} SELECT row_number() OVER (ORDER BY pair_id) - 1 AS row_id, pair_id, input FROM pairs")
def jsonl_to_store(spark, sf_dir):
    path = _written_json(article_pairs(spark, sf_dir).select("pair_id", "input"), spark, "lines")
    return jobs.to_store(spark, path, new_path(spark, "store"), "pair_id long, input string", ["pair_id"])


@query("""WITH o AS (SELECT doc_id, n_chars, doc_id % 2 AS late, count(*) FILTER (WHERE doc_id % 2 = 0) OVER () AS n FROM documents)
SELECT row_number() OVER (PARTITION BY late ORDER BY doc_id) - 1 + CASE WHEN late = 1 THEN n ELSE 0 END AS row_id, doc_id, n_chars FROM o""")
def append_to_store(spark, sf_dir):
    """A store that is made by its first batch and grows by a second."""
    d, path = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), new_path(spark, "store")
    for late in (0, 1):
        writers.append_records(d.where(F.col("doc_id") % 2 == late), path, [F.col("doc_id")])
    return readers.records(spark, path)


@query("SELECT value, count(*) AS n FROM (SELECT array_to_string(list(turn + 1 ORDER BY turn DESC), ', ') AS value FROM conversations GROUP BY conv_id) GROUP BY value")
def ranking_sink(spark, sf_dir):
    """Rankings written one a line and read back."""
    path = new_path(spark, "rankings")
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.col("turn") + 1))).alias("ranking"))
    writers.rankings(t, path)
    back = readers.rankings(readers.lines(spark, path))
    return back.select(F.array_join(F.transform("ranking", lambda x: x.cast("string")), ", ").alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT value, count(*) AS n FROM (SELECT coalesce(CAST(CASE WHEN turn % 5 > 0 THEN turn END AS VARCHAR), '') AS value FROM conversations) GROUP BY value")
def number_sink(spark, sf_dir):
    """Numbers written one a line, null as an empty line."""
    path = new_path(spark, "numbers")
    writers.numbers(table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 5 > 0, F.col("turn")).alias("x")), path, "x")
    return readers.lines(spark, path, keep_empty=True).groupBy("value").agg(F.count("*").alias("n"))


_JUDGED = f"""{_TWO}, judged AS (SELECT conv_id, x, y, CAST(CASE WHEN length(hx) > length(hy) OR length(hx) = length(hy) AND x < y THEN 1 ELSE -1 END AS INTEGER) AS preferred,
  CAST(substr(x, 6) AS INTEGER) AS i, CAST(substr(y, 6) AS INTEGER) AS j FROM two)"""


def _judged(spark, sf_dir):
    turn = lambda c: F.substring(c, 6, 9).cast("int")
    return _preferences(spark, sf_dir).select("conv_id", "x", "y", "preferred", turn("x").alias("i"), turn("y").alias("j"))


@query(f"WITH {_JUDGED} SELECT conv_id AS sample_id, x, y, CASE WHEN conv_id % 3 = 0 THEN -preferred ELSE preferred END AS preferred FROM judged")
def comparison_sink(spark, sf_dir):
    """A run's comparisons are stored, a later run appends some again; of equal keys the later one counts."""
    path = new_path(spark, "comparisons")
    rows = _judged(spark, sf_dir).select(F.col("conv_id").alias("sample_id"), "x", "y", "preferred", F.lit(0).alias("run"))
    again = rows.where("sample_id % 3 = 0").withColumns({"preferred": -F.col("preferred"), "run": F.lit(1)})
    writers.comparisons(rows, path)
    writers.comparisons(again, path)
    stored = readers.jsonl(spark, path, "sample_id long, x string, y string, preferred int, run int")
    latest = ranking.upserted(stored.where("run = 0"), stored.where("run = 1"), ["sample_id", "x", "y"])
    return latest.select("sample_id", "x", "y", "preferred")


@query(f"WITH {_JUDGED} SELECT conv_id, x, y FROM judged WHERE (i + j) % 4 <> 1")
def comparisons_resume(spark, sf_dir):
    """Pairs that an earlier run has judged are skipped."""
    done = _judged(spark, sf_dir).where("(i + j) % 4 = 1").select("conv_id", "x", "y")
    return _comparisons(spark, sf_dir, done).select("conv_id", "x", "y")


_PARTIAL = """made AS (SELECT * FROM judged WHERE (i + j) % 3 <> 0), edges AS (
  SELECT DISTINCT conv_id, CASE WHEN preferred = 1 THEN x ELSE y END AS w, CASE WHEN preferred = 1 THEN y ELSE x END AS l FROM made
), closed AS (SELECT * FROM edges UNION SELECT c.conv_id, c.w, e.l FROM closed c JOIN edges e ON e.conv_id = c.conv_id AND e.w = c.l)"""


@query(f"""WITH RECURSIVE {_JUDGED}, {_PARTIAL}, names AS (SELECT DISTINCT conv_id, unnest([x, y]) AS name FROM made
), won AS (SELECT n.conv_id, n.name, count(c.l) AS n FROM names n LEFT JOIN closed c ON c.conv_id = n.conv_id AND c.w = n.name GROUP BY n.conv_id, n.name
), per AS (SELECT conv_id, list(name ORDER BY n DESC, name) AS r, count(*) AS k, sum(n) AS pairs FROM won GROUP BY conv_id)
SELECT conv_id, CASE WHEN pairs = k * (k - 1) / 2 THEN array_to_string(r, ' > ') END AS ranking, CASE WHEN pairs = k * (k - 1) / 2 THEN 'ranked' ELSE 'incomplete' END AS status FROM per""")
def tournament_partial(spark, sf_dir):
    """Rankings where a third of the comparisons was never made: those that follow from others are not needed."""
    out = ranking.tournament(_judged(spark, sf_dir).where("(i + j) % 3 <> 0"), "conv_id")
    return out.select("conv_id", F.array_join("ranking", " > ").alias("ranking"), "status")


@query(f"""WITH RECURSIVE {_JUDGED}, {_PARTIAL}
SELECT conv_id, x, y FROM judged j WHERE NOT EXISTS (SELECT 1 FROM closed c WHERE c.conv_id = j.conv_id AND (c.w = j.x AND c.l = j.y OR c.w = j.y AND c.l = j.x))""")
def transitive_skip(spark, sf_dir):
    """Pairs whose order does not follow from the comparisons there are."""
    j = _judged(spark, sf_dir)
    return ranking.undecided(j.select("conv_id", "x", "y"), j.where("(i + j) % 3 <> 0"), "conv_id")


@query(f"""WITH {PAIRS} SELECT input AS "Input", output AS "Reference", array_to_string(list_filter(string_split_regex(input, '\\s+'), lambda x: x <> '')[1:8], ' ') AS "Hypothesis" FROM pairs""")
def inference_csv(spark, sf_dir):
    rows = article_pairs(spark, sf_dir).select("pair_id", "input", "output")
    return jobs.inference(rows, generation.LeadingWords(8), new_path(spark, "hypotheses"), "pair_id", "input", "output")


_IDS = lambda c: f"array_to_string(list_transform(list_filter(string_split_regex(lower(regexp_replace({c}, '[!-/:-@\\[-`{{-~]', ' ', 'g')), '\\s+'), lambda x: x <> ''), lambda t: CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 31997 + 3 AS INTEGER)), ' ')"


@query(f"WITH {PAIRS} SELECT row_number() OVER (ORDER BY pair_id) - 1 AS row_id, md5({_IDS('input')}) AS input, md5({_IDS('output')}) AS output FROM pairs")
def pretokenize_store(spark, sf_dir):
    """Token ids written beside a store; the second call reads what the first has written."""
    path = new_path(spark, "store")
    writers.records(article_pairs(spark, sf_dir).select("pair_id", "input", "output"), path, order=[F.col("pair_id")])
    for _ in range(2):
        rows = jobs.pretokenized(spark, path, training.hashed_ids, ["input", "output"])
    digest = lambda c: F.md5(F.array_join(F.transform(f"pretokenized.{c}", lambda x: x.cast("string")), " ")).alias(c)
    return rows.select("row_id", digest("input"), digest("output"))


@query("""SELECT round(exp(least(avg(ln(s) + m - x), ln(1e5))), 6) AS perplexity FROM (
  SELECT list_max(v) AS m, v[1 + vec_id % 64] AS x, list_sum(list_transform(v, lambda y: exp(y - list_max(v)))) AS s FROM (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings) WHERE vec_id % 5 > 0)""")
def perplexity_logits(spark, sf_dir):
    """Vectors as a place's logits, one place a row; every fifth place does not count."""
    e = table(spark, sf_dir, "embeddings").select(F.array("embedding").alias("logits"), F.array(F.when(F.col("vec_id") % 5 > 0, (F.col("vec_id") % 64).cast("int")).otherwise(training.IGNORED)).alias("labels"))
    return rounded(training.perplexity_of_logits(e, "logits", "labels"), "perplexity")


@query("SELECT event_type, CAST(floor(value / 25) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type, bin")
def reward_distribution(spark, sf_dir):
    """How rewards are distributed: counts by bins of equal width."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.groupBy("event_type", F.floor(F.col("value") / 25).alias("bin")).agg(F.count("*").alias("n"))


class _Covered:
    """Stands in for a reward model: the part of a hypothesis's words that document and reference have, averaged."""

    def load(self) -> None:
        self.scorer = generation.Overlap()

    def reward(self, documents, hypotheses, references):
        return [(a + b) / 2 for a, b in zip(self.scorer.score(documents, hypotheses), self.scorer.score(references, hypotheses))]


_PART = lambda a: f"CASE WHEN len(h) = 0 THEN 0.0 ELSE len(list_filter(h, lambda w: list_contains({a}, w))) / len(h) END"
_WORDS = lambda c: f"list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


@query(f"""WITH {PAIRS} SELECT pair_id, round(({_PART('d')} + {_PART('r')}) / 2, 6) AS reward
FROM (SELECT pair_id, {_WORDS('input')} AS d, {_WORDS('output')} AS r, {_WORDS("substr(input, 1, 40) || ' ' || substr(output, 1, 40)")} AS h FROM pairs)""")
def reward_triples(spark, sf_dir):
    p = article_pairs(spark, sf_dir).withColumn("hypothesis", F.concat_ws(" ", F.substring("input", 1, 40), F.substring("output", 1, 40)))
    out = generation.rewarded(p.select("pair_id", "input", "output", "hypothesis"), _Covered(), "input", "hypothesis", "output")
    return rounded(out.select("pair_id", "reward"), "reward")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY user_id")
def run_states(spark, sf_dir):
    """The last state of each run, from a log that states are appended to."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return rounded(jobs.latest_states(e, "user_id", "event_id"), "value")


@query("""WITH r AS (SELECT vec_id, list_transform(list_sort(list_transform(range(64), lambda i: {'v': -embedding[i + 1], 'i': i})), lambda s: s.i) AS o FROM embeddings)
SELECT vec_id, CAST(CASE WHEN (vec_id + 1) % 4 = 0 THEN o[1] ELSE o[1 + ('0x' || substr(md5('5:' || vec_id), 1, 8))::BIGINT % 21 + 9] END AS INTEGER) AS token FROM r""")
def band_sample(spark, sf_dir):
    """A token of rank 10 to 30 by hash; every fourth row takes the best."""
    return jobs.band_picks(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", 10, 30, 3, 5).select("vec_id", F.col("token").cast("int").alias("token"))


@query("SELECT c_custkey, CAST(100 + ('0x' || substr(md5('7:' || c_custkey), 1, 8))::BIGINT % 101 AS INTEGER) AS max_length FROM customer")
def batch_lengths(spark, sf_dir):
    """A random output length for each batch, here a customer's."""
    return jobs.batch_lengths(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 200, 120, 7)


@query(r"""SELECT unicode(x) AS code, count(*) AS n, regexp_matches(x, '[\p{P}!-/:-@\[-`{-~]') AS punctuation,
  regexp_matches(x, '[\t-\r\x1c-\x1f\x{85}\p{Z}]') AND unicode(x) <> 5760 AS space, regexp_matches(x, '[\p{Cc}\p{Cf}\x{fffc}\x{fffd}]') AND NOT regexp_matches(x, '[\t-\r\x1c-\x1f\x{85}]') AS control
FROM (SELECT unnest(string_split(text, '')) AS x FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) WHERE x <> '' GROUP BY x""")
def character_classes(spark, sf_dir):
    """What the characters of all texts count as, and how many there are; characters that no text has are tested by hand."""
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    c = texts.select(F.explode(F.split("text", "")).alias("x")).where("x <> ''").groupBy("x").agg(F.count("*").alias("n"))
    found = lambda pattern: F.regexp_like("x", F.lit(pattern))
    return c.select(F.ascii("x").alias("code"), "n", text.punctuated(F.col("x")).alias("punctuation"), found(text.CLEAN_SPACE).alias("space"), found(text.CLEAN_CONTROL).alias("control"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'graceful' WHEN 1 THEN 'unexpected' END AS error_type, CASE event_id % 3 WHEN 1 THEN 'code ' || user_id ELSE 'x' END AS shown FROM events""")
def error_classes(spark, sf_dir):
    """Error replies: a JSON object, plain text, or none."""
    body = F.when(F.col("event_id") % 3 == 0, F.lit('{"x": "x"}')).when(F.col("event_id") % 3 == 1, F.concat(F.lit("code "), "user_id"))
    e = generation.classified_errors(table(spark, sf_dir, "events").select("event_id", body.alias("error")))
    shown = F.coalesce(F.get_json_object("error", "$.x"), F.when(F.col("error").isNull(), "x").otherwise(text.error_text(F.col("error"))))
    return e.select("event_id", "error_type", shown.alias("shown"))


@query("""SELECT conv_id, turn, CASE WHEN role = '' THEN '' ELSE '<' || role END AS role, md5(array_to_string(list_transform(string_split(text, ' '), lambda x: CASE WHEN x = '' THEN '' ELSE '<' || x END), '|')) AS digest FROM conversations""")
def nested_strings(spark, sf_dir):
    """A function put on every string of nested values; keys and other types stay."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("role", F.array(F.struct(F.split("text", " ").alias("parts"))).alias("inner")).alias("x"))
    up = readers.with_mapped_strings(t, lambda x: F.concat(F.lit("<"), x))
    return up.select("conv_id", "turn", F.col("x.role").alias("role"), F.md5(F.array_join(F.col("x.inner")[0]["parts"], "|")).alias("digest"))


@query(f"WITH {CANDIDATES} SELECT conv_id, CAST(count(*) AS INTEGER) AS n, arg_max(md5(hyp), turn) AS last FROM candidates GROUP BY conv_id")
def candidate_lists(spark, sf_dir):
    """Samples with their outputs as an array, stored as JSON lines and as records, and read back from either."""
    path = new_path(spark, "samples")
    s = candidates(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("hyp").alias("content")))).alias("outputs"))
    writers.both_formats(s, path, "both")
    lines = readers.jsonl(spark, f"{path}/jsonl", "conv_id long, outputs array<struct<turn: long, content: string>>").select("conv_id", F.size("outputs").alias("n"))
    stored = readers.records(spark, f"{path}/records").select("conv_id", F.md5(F.element_at("outputs", -1)["content"]).alias("last"))
    return lines.join(stored, "conv_id")


@query("""WITH u AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings),
d AS (SELECT label, k, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS k FROM u) GROUP BY label, k),
p AS (SELECT label, (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) AS c FROM d GROUP BY label HAVING max(n) > 1),
r AS (SELECT *, row_number() OVER (ORDER BY label) AS k, avg(c) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) AS m FROM p)
SELECT k AS sequences, round(1 - m, 6) AS isotropy FROM r WHERE k % 3 = 0""")
def isotropy_interim(spark, sf_dir):
    """Isotropy after every third sequence, as a long run reports it."""
    return rounded(vectors.interim(vectors.self_similarity(table(spark, sf_dir, "embeddings"), "label", "embedding"), "label", 3), "isotropy")


_UNITS = "unit AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)"
_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}.v) + 1), lambda i: {a}.v[i] * {b}.v[i]))"


@query(f"""WITH {_UNITS} SELECT a.vec_id, round(5 * {_DOT('a', 'h')}, 6) AS by_document, round(5 * {_DOT('b', 'h')}, 6) AS by_reference
FROM unit a JOIN unit b ON b.vec_id = a.vec_id + 1 JOIN unit h ON h.vec_id = a.vec_id + 2""")
def anchored_reward(spark, sf_dir):
    """Cosine rewards with either anchor, over three vectors in a row as document, reference and hypothesis."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    at = lambda k, name: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(name))
    rows = at(0, "d").join(at(1, "r"), "vec_id").join(at(2, "h"), "vec_id")
    for anchor in ("document", "reference"):
        rows = vectors.anchored_reward(rows, anchor, "d", "r", "h").withColumnRenamed("reward", f"by_{anchor}")
    return rounded(rows.select("vec_id", "by_document", "by_reference"), "by_document", "by_reference")


@query(f"""WITH {PAIRS}, numbered AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS n FROM pairs),
pools AS (SELECT w AS worker, list(r_name ORDER BY md5('3:' || w || ':' || r_name)) AS pool FROM region, (SELECT unnest(range(3)) AS w) GROUP BY w)
SELECT pair_id, n % 3 AS worker, pool[1 + CAST((n // 3) % len(pool) AS INTEGER)] AS key FROM numbered JOIN pools ON worker = n % 3""")
def worker_keys(spark, sf_dir):
    """Requests dealt to three workers, each of which hands round its own order of keys."""
    rows = datasets.numbered(article_pairs(spark, sf_dir).select("pair_id"), [F.col("pair_id")]).withColumn("n", F.col("_n") - 1)
    return jobs.assigned(rows, table(spark, sf_dir, "region"), 3, "n", "r_name", 3).select("pair_id", "worker", "key")
