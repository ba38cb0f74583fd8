"""The queries over the test tables, each with DuckDB SQL that computes the same rows."""



from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..functions.porter import stemmed
from ..functions.unicode import clean_text, nfkc
from ..operators import datasets, quality, ranking, rewards, rouge, training, vectors
from . import generation

QUERIES: dict = {}
SQL: dict[str, str] = {}
PLACES = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, PLACES) for c in columns})


def bigint(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


# SQL pieces ---------------------------------------------------------------------------------------------------------
_PLAIN = r"regexp_replace({0}, '[!-/:-@\[-`{{-~]', ' ', 'g')"
_TOKENS = r"list_filter(string_split_regex(lower(" + _PLAIN + r"), '\s+'), lambda x: x <> '')"
TOKENS = _TOKENS.format
PLAIN = _PLAIN.format
#: user turn and next assistant turn
PAIRS = """pairs AS (
  SELECT u.conv_id * 10000 + u.turn AS pair_id, u.conv_id, u.turn, u.text AS input, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
#: a conversation's assistant turns as candidates, against its first user turn
CANDIDATES = """refs AS (
  SELECT conv_id, arg_min(text, turn) AS ref FROM conversations WHERE role = 'user' GROUP BY conv_id
), candidates AS (
  SELECT c.conv_id, c.turn, c.text AS hyp, r.ref, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS pos
  FROM conversations c JOIN refs r ON r.conv_id = c.conv_id WHERE c.role = 'assistant')"""


def _rouge_sql(source: str, id: str, hyp: str, ref: str, n: int, name: str) -> str:
    gram = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
    side = lambda c, s: f"SELECT {id}, '{s}' AS side, {gram} AS gram FROM (SELECT {id}, t, unnest(range(1, len(t) - {n - 2})) AS i FROM (SELECT {id}, {TOKENS(c)} AS t FROM {source}) WHERE len(t) >= {n})"
    return f"""{name}_grams AS ({side(hyp, 'h')} UNION ALL {side(ref, 'r')}
), {name}_bags AS (
  SELECT {id}, gram, count(*) FILTER (WHERE side = 'h') AS h, count(*) FILTER (WHERE side = 'r') AS r FROM {name}_grams GROUP BY {id}, gram
), {name}_counts AS (
  SELECT p.{id}, CAST(coalesce(sum(least(h, r)), 0) AS BIGINT) AS matches, CAST(coalesce(sum(h), 0) AS BIGINT) AS hyp_size, CAST(coalesce(sum(r), 0) AS BIGINT) AS ref_size
  FROM {source} p LEFT JOIN {name}_bags b ON b.{id} = p.{id} GROUP BY p.{id}
), {name} AS (
  SELECT *, CASE WHEN p = 0 OR r = 0 THEN 0.0 ELSE r * p / (0.5 * r + 0.5 * p) END AS f FROM (
    SELECT {id}, matches, hyp_size, ref_size, CASE WHEN hyp_size = 0 THEN 0.0 ELSE matches / hyp_size END AS p, CASE WHEN ref_size = 0 THEN 0.0 ELSE matches / ref_size END AS r FROM {name}_counts))"""


# pairs and candidates -------------------------------------------------------------------------------------------------
def article_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, conv_id, turn, input (a user turn), output (the next turn, if it is the assistant's)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "next_turn": F.lead("turn").over(w), "output": F.lead("text").over(w)})
    t = t.where("role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1")
    return t.select((F.col("conv_id") * 10000 + F.col("turn")).alias("pair_id"), "conv_id", "turn", F.col("text").alias("input"), "output")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, pos, hyp (an assistant turn), ref (the first user turn)."""
    t = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    ref = F.first(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = t.withColumn("ref", ref).where("role = 'assistant' AND ref IS NOT NULL")
    return t.select("conv_id", "turn", (F.row_number().over(w) - 1).alias("pos"), F.col("text").alias("hyp"), "ref")


_PAIR_ROUGE = f"WITH {PAIRS}, {_rouge_sql('pairs', 'pair_id', 'output', 'input', 1, 'r1')}, {_rouge_sql('pairs', 'pair_id', 'output', 'input', 2, 'r2')}"


@query(f"""{_PAIR_ROUGE} SELECT pair_id, round(r1.p, 6) AS rouge1_p, round(r1.r, 6) AS rouge1_r, round(r1.f, 6) AS rouge1_f,
  round(r2.p, 6) AS rouge2_p, round(r2.r, 6) AS rouge2_r, round(r2.f, 6) AS rouge2_f FROM r1 JOIN r2 USING (pair_id)""")
def rouge_pairs(spark, sf_dir):
    out = rouge.rouge(article_pairs(spark, sf_dir), "pair_id", "output", "input")
    return rounded(out, *[c for c in out.columns if c != "pair_id"])


_MACRO = """SELECT round(p1, 6) AS rouge1_p, round(r1, 6) AS rouge1_r, round(p2, 6) AS rouge2_p, round(r2, 6) AS rouge2_r,
  round(CASE WHEN p1 = 0 OR r1 = 0 THEN 0.0 ELSE r1 * p1 / (0.5 * r1 + 0.5 * p1) END, 6) AS rouge1_f,
  round(CASE WHEN p2 = 0 OR r2 = 0 THEN 0.0 ELSE r2 * p2 / (0.5 * r2 + 0.5 * p2) END, 6) AS rouge2_f
FROM (SELECT avg(r1.p) AS p1, avg(r1.r) AS r1, avg(r2.p) AS p2, avg(r2.r) AS r2 FROM r1 JOIN r2 USING (pair_id))"""


@query(f"{_PAIR_ROUGE} {_MACRO}")
def rouge_macro(spark, sf_dir):
    out = rouge.macro(rouge.rouge(article_pairs(spark, sf_dir), "pair_id", "output", "input"))
    return rounded(out, *out.columns)


@query(f"""WITH {PAIRS}, {_rouge_sql('pairs', 'pair_id', 'output', 'input', 2, 'r2')}
SELECT m AS matches, h AS hyp_size, r AS ref_size, round(m / h, 6) AS p, round(m / r, 6) AS r, round(2 * (m / h) * (m / r) / (m / h + m / r), 6) AS f
FROM (SELECT CAST(sum(matches) AS BIGINT) AS m, CAST(sum(hyp_size) AS BIGINT) AS h, CAST(sum(ref_size) AS BIGINT) AS r FROM r2)""")
def rouge_micro(spark, sf_dir):
    return rounded(rouge.micro(rouge.overlaps(article_pairs(spark, sf_dir), "pair_id", "output", "input", 2)), "p", "r", "f")


@query(f"""WITH {PAIRS}, {_rouge_sql('pairs', 'pair_id', 'output', 'input', 1, 'r1')}
SELECT pair_id, round(f, 6) AS reward, round(sqrt(f), 6) AS weighted FROM r1""")
def rouge1_reward(spark, sf_dir):
    out = rouge.rouge(article_pairs(spark, sf_dir), "pair_id", "output", "input", ns=(1,))
    return out.select("pair_id", F.round("rouge1_f", PLACES).alias("reward"), F.round(rouge.weighted(F.col("rouge1_f"), 2.0), PLACES).alias("weighted"))


@query(f"""{_PAIR_ROUGE} SELECT (SELECT round(avg(f), 6) FROM r1) AS mean_reward, m.* FROM ({_MACRO}) m""")
def evaluate_generator(spark, sf_dir):
    out = generation.evaluated(article_pairs(spark, sf_dir), "pair_id", "output", "input", mode="all")
    return rounded(out, *out.columns)


@query(f"""WITH {PAIRS}, grams AS (SELECT pair_id, t[i] || ' ' || t[i + 1] AS gram FROM (SELECT pair_id, t, unnest(range(1, len(t))) AS i FROM (SELECT pair_id, {TOKENS('output')} AS t FROM pairs) WHERE len(t) >= 2))
SELECT pair_id, count(*) AS n_grams, count(DISTINCT gram) AS n_distinct FROM grams GROUP BY pair_id""")
def ngram_counts(spark, sf_dir):
    each = rouge.gathered(article_pairs(spark, sf_dir), "pair_id", output=F.col("output"))
    each = each.withColumn("rows", F.transform("rows", lambda x: F.struct(text.tokens(x["output"]).alias("output")))).select("pair_id", rouge.grams("rows", "output", 2).alias("grams"))
    counts = each.select("pair_id", F.size("grams").cast("long").alias("n_grams"), F.size(F.array_distinct("grams")).cast("long").alias("n_distinct"))
    return counts.where("n_grams > 0")


@query(f"""WITH {PAIRS}, {_rouge_sql('pairs', 'pair_id', 'output', 'input', 1, 'r1')}
SELECT pair_id, CAST(sum(least(h, r)) AS BIGINT) AS n_intersection, CAST(sum(greatest(h, r)) AS BIGINT) AS n_union FROM r1_bags GROUP BY pair_id""")
def bag_union_intersect(spark, sf_dir):
    out = rouge.overlaps(article_pairs(spark, sf_dir), "pair_id", "output", "input", 1).where("hyp_size + ref_size > 0")
    return out.select("pair_id", F.col("matches").alias("n_intersection"), (F.col("hyp_size") + F.col("ref_size") - F.col("matches")).alias("n_union"))


def _candidate_scores(spark, sf_dir, n: int) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("cand_id", F.col("conv_id") * 10000 + F.col("turn"))
    scored = rouge.rouge(c, "cand_id", "hyp", "ref", ns=(n,)).withColumnRenamed(f"rouge{n}_f", "score")
    return c.select("cand_id", "conv_id", "pos").join(scored.select("cand_id", "score"), "cand_id")


_KEYED = CANDIDATES + ", keyed AS (SELECT *, conv_id * 10000 + turn AS cand_id FROM candidates)"
_RANKED = lambda n, name: f"{name} AS (SELECT conv_id, list(CAST(pos + 1 AS INTEGER) ORDER BY f DESC, pos) AS ranking FROM keyed JOIN s{n} USING (cand_id) GROUP BY conv_id)"
_S1, _S2 = (_rouge_sql("keyed", "cand_id", "hyp", "ref", n, f"s{n}") for n in (1, 2))


@query(f"WITH {_KEYED}, {_S2}, {_RANKED(2, 'ranked')} SELECT conv_id, array_to_string(ranking, ', ') AS ranking FROM ranked")
def rank_by_rouge2(spark, sf_dir):
    out = ranking.ranked(_candidate_scores(spark, sf_dir, 2), "conv_id", "pos", "score")
    return out.select("conv_id", F.array_join("ranking", ", ").alias("ranking"))


_AGREE = """SELECT conv_id, round(CASE WHEN total = 0 THEN NULL ELSE same / total END, 6) AS agreement FROM (
  SELECT conv_id, count(*) FILTER (WHERE d1 * d2 >= 0) AS total, count(*) FILTER (WHERE d1 * d2 >= 0 AND d1 < 0) AS same FROM (
    SELECT conv_id, list_position(a, h[i]) - list_position(a, h[j]) AS d1, list_position(b, h[i]) - list_position(b, h[j]) AS d2
    FROM (SELECT conv_id, h, a, b, unnest(range(1, len(h) + 1)) AS i FROM three) x, LATERAL (SELECT unnest(range(x.i + 1, len(x.h) + 1)) AS j) y) GROUP BY conv_id
  UNION ALL SELECT conv_id, 0, 0 FROM three WHERE len(h) < 2)"""


@query(f"""WITH {_KEYED}, {_S1}, {_S2}, {_RANKED(1, 'a')}, {_RANKED(2, 'h')},
b AS (SELECT conv_id, list(CAST(pos + 1 AS INTEGER) ORDER BY length(hyp) DESC, pos) AS ranking FROM keyed GROUP BY conv_id),
three AS (SELECT conv_id, h.ranking AS h, a.ranking AS a, b.ranking AS b FROM h JOIN a USING (conv_id) JOIN b USING (conv_id)) {_AGREE}""")
def ranking_agreement(spark, sf_dir):
    by_length = candidates(spark, sf_dir).select("conv_id", "pos", F.length("hyp").alias("score"))
    files = {"h": _candidate_scores(spark, sf_dir, 2), "a": _candidate_scores(spark, sf_dir, 1), "b": by_length}
    ranked = {k: ranking.ranked(v, "conv_id", "pos", "score").withColumnRenamed("conv_id", "row_id") for k, v in files.items()}
    three = ranking.by_position(**ranked)
    refs = F.array("a.ranking", "b.ranking")
    return three.select(F.col("row_id").alias("conv_id"), F.round(ranking.agreement(F.col("h.ranking"), refs), PLACES).alias("agreement"))


@query(f"""WITH {_KEYED}, {_S2}, {_RANKED(2, 'h')}, three AS (SELECT conv_id, ranking AS h, range(1, len(ranking) + 1) AS a, range(1, len(ranking) + 1) AS b FROM h) {_AGREE}""")
def manual_label_agreement(spark, sf_dir):
    ranked = ranking.ranked(_candidate_scores(spark, sf_dir, 2), "conv_id", "pos", "score")
    return ranked.select("conv_id", F.round(ranking.agreement(F.col("ranking"), F.array(ranking.identity_ranking(F.col("ranking")))), PLACES).alias("agreement"))


# datasets -------------------------------------------------------------------------------------------------------------
def _ordinal(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")


@query("SELECT count(*) AS n FROM documents")
def dataset_length(spark, sf_dir):
    return _ordinal(spark, sf_dir).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS row_id, text, lang FROM documents WHERE doc_id = 17")
def dataset_lookup(spark, sf_dir):
    return datasets.lookup(_ordinal(spark, sf_dir), 17).select("row_id", "text", "lang")


@query("SELECT doc_id AS row_id, n_chars FROM documents WHERE doc_id >= 10 AND doc_id < 500 AND (doc_id - 10) % 7 = 0")
def dataset_slice(spark, sf_dir):
    return datasets.sliced(_ordinal(spark, sf_dir), 10, 500, 7).select("row_id", "n_chars")


@query("SELECT doc_id AS row_id, lang, source, n_chars FROM documents ORDER BY doc_id")
def dataset_scan(spark, sf_dir):
    return _ordinal(spark, sf_dir).select("row_id", "lang", "source", "n_chars").orderBy("row_id")


@query("SELECT doc_id AS row_id, text FROM documents ORDER BY doc_id LIMIT 200")
def first_rows(spark, sf_dir):
    return _ordinal(spark, sf_dir).orderBy("row_id").limit(200).select("row_id", "text")


@query("""WITH idx AS (SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS pos, (item_id * 7) % 100 AS idx FROM benchmark)
SELECT pos, doc_id AS row_id, n_chars FROM idx JOIN documents ON doc_id = idx""")
def extract_by_index(spark, sf_dir):
    items = datasets.numbered(table(spark, sf_dir, "benchmark").select("item_id"), [F.col("item_id")])
    idx = items.select((F.col("_n") - 1).cast("int").alias("pos"), (F.col("item_id") * 7 % 100).alias("idx"))
    return datasets.by_index(_ordinal(spark, sf_dir), idx).select("pos", "row_id", "n_chars")


@query("SELECT doc_id AS row_id, md5('11:' || doc_id) AS k FROM documents ORDER BY k, doc_id LIMIT 100")
def hash_sample(spark, sf_dir):
    return datasets.sampled(_ordinal(spark, sf_dir), 100, 11).select("row_id", datasets.hash_order(11).alias("k"))


@query("SELECT doc_id AS row_id, CASE WHEN row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) <= greatest(CAST(floor(0.9 * (SELECT count(*) FROM documents)) AS BIGINT), 1) THEN 'train' ELSE 'eval' END AS split FROM documents")
def train_eval_split(spark, sf_dir):
    return datasets.split(_ordinal(spark, sf_dir).select("row_id"), ratio=0.9, seed=3)


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) <= (SELECT count(*) - 100 FROM documents) AS train FROM documents)
SELECT to_json(list(doc_id ORDER BY doc_id) FILTER (WHERE NOT train)) AS eval_indexes, count(*) FILTER (WHERE train) AS n_train FROM s""")
def split_index_lists(spark, sf_dir):
    s = datasets.split(_ordinal(spark, sf_dir).select("row_id"), eval_rows=100, seed=3)
    held = F.array_sort(F.collect_list(F.when(F.col("split") == "eval", F.col("row_id"))))  # eval_rows numbers
    return s.agg(F.to_json(held).alias("eval_indexes"), F.count_if(F.col("split") == "train").alias("n_train"))


@query("""SELECT row_id, CAST((n - 1) // 64 AS BIGINT) AS batch FROM (SELECT doc_id AS row_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) AS n FROM documents)
WHERE n <= (SELECT count(*) // 64 * 64 FROM documents)""")
def epoch_shuffle_droplast(spark, sf_dir):
    return datasets.epoch(_ordinal(spark, sf_dir).select("row_id"), 7, 2, 64)


@query("SELECT row_id, batch FROM (SELECT doc_id AS row_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 10 AS BIGINT) AS batch FROM documents) WHERE batch >= 5")
def batch_resume_skip(spark, sf_dir):
    return datasets.batches(_ordinal(spark, sf_dir).select("row_id"), 10, [F.col("row_id")]).where("batch >= 5")


@query("""SELECT name, row_number() OVER (PARTITION BY user_id ORDER BY is_best DESC, is_current DESC, mtime DESC, name) <= 3 AS kept FROM (
  SELECT user_id, 'cp-' || event_id AS name, ts AS mtime, event_id % 40 = 0 AS is_best, event_id % 99 = 0 AS is_current FROM events)""")
def checkpoint_retention(spark, sf_dir):
    """Events as the checkpoints of one run a user."""
    e = table(spark, sf_dir, "events")
    cps = e.select("user_id", F.concat(F.lit("cp-"), "event_id").alias("name"), F.col("ts").alias("mtime"), (F.col("event_id") % 40 == 0).alias("is_best"), (F.col("event_id") % 99 == 0).alias("is_current"))
    return datasets.retained(cps, 3, ["user_id"]).select("name", "kept")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark, sf_dir):
    return datasets.unprocessed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query(f"""WITH {PAIRS} SELECT pair_id, 'model-b' AS model FROM pairs WHERE turn % 3 = 0 UNION ALL SELECT pair_id, m FROM pairs, (VALUES ('model-a'), ('model-b')) v(m) WHERE turn % 3 <> 0""")
def resume_by_model(spark, sf_dir):
    p = article_pairs(spark, sf_dir)
    wanted = p.select("pair_id", F.explode(F.array(F.lit("model-a"), F.lit("model-b"))).alias("model"))
    done = p.where("turn % 3 = 0").select("pair_id", F.lit("model-a").alias("model"))
    return datasets.unprocessed(wanted, done, ["pair_id", "model"])


@query("SELECT md5(text) AS digest, min(doc_id) AS row_id, count(*) AS n FROM documents GROUP BY md5(text)")
def ordered_dedup(spark, sf_dir):
    d = _ordinal(spark, sf_dir).select("row_id", F.md5("text").alias("digest"))
    return d.groupBy("digest").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))


@query("SELECT doc_id, lang, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_of_each_source(spark, sf_dir):
    """Ordered de-duplication of whole rows: the first document of each language and source."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("key"), "doc_id", "lang", F.length("text").cast("long").alias("n"))
    return datasets.first_of_each(d, "key", "doc_id").select("doc_id", "lang", "n")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang FROM documents")
def append_outputs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.where("doc_id % 3 = 0").unionByName(d)  # a part that was done before, then everything


@query("SELECT doc_id, CASE WHEN doc_id = 0 THEN source ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents")
def falsy_coalesce_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.falsy_coalesce(F.col("doc_id").cast("string"), F.col("source")).alias("id"))


# text -----------------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, CAST(len({TOKENS('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({TOKENS('text')})) AS BIGINT) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, chr(9) || ' ' || chr(13))), lambda l: l <> ''), chr(10)) || chr(10)) AS digest FROM documents")
def strip_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.stripped_lines(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(replace(text, chr(10), ' ')) AS digest FROM documents")
def clean_text_nfkc(spark, sf_dir):
    """The tables' texts are NFKC-stable and have no control characters, so that SQL can tell the result."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean_text(F.col("text"), replace_newline=True)).alias("digest"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(regexp_replace(regexp_replace(text, '\\', chr(1), 'g'), '([%$&#_{}])', '\\\1', 'g'), chr(1), '\textbackslash'), '~', '\textasciitilde'), '^', '\textasciicircum')) AS digest
FROM documents""")
def latex_escape(spark, sf_dir):
    """No text of the tables has a raw block, of which SQL knows nothing; those are tested by hand."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.latex_escaped(F.col("text"))).alias("digest"))


@query(r"""SELECT CAST(item_id AS BIGINT) AS row_no, (CASE WHEN n % 2 = 0 THEN '\rowcolor{light-gray}' ELSE '' END) || n || ' & ' || replace(replace(replace(text, '\', '\textbackslash'), '%', '\%'), '&', '\&') || '\\' AS line
FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM benchmark)""")
def latex_rows(spark, sf_dir):
    rows = datasets.numbered(table(spark, sf_dir, "benchmark").select("item_id", "text"), [F.col("item_id")])
    return generation.latex_lines(rows, "_n", ["text"], numbered=True).select(F.col("item_id").alias("row_no"), "line")


@query("SELECT page_id, url, (contains(url, 'a') OR NOT contains(url, 'e')) AS ignored_strict, (contains(url, 'a') AND NOT contains(url, 'e')) AS ignored_loose, CASE WHEN length(url) > 20 THEN '...' || right(url, 17) ELSE url END AS shown FROM pages")
def path_filter(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", text.path_ignored(u, ["a"], ["e"]).alias("ignored_strict"), text.path_ignored(u, ["a"], ["e"], include_wins=True).alias("ignored_loose"), text.ellipsis_path(u, 20).alias("shown"))


_DICTIONARY = f"words AS (SELECT DISTINCT unnest({TOKENS('text')}) AS word FROM benchmark)"
_PREFIXES, _PHRASE = ("the ", "la "), " of the "
_REASONS = f"""{_DICTIONARY}, outs AS (
  SELECT conv_id, turn, lower({PLAIN('text')}) AS plain, list_filter(string_split_regex(lower({PLAIN('text')}), '\\s+'), lambda x: x <> '') AS w FROM conversations WHERE role = 'assistant'
), hits AS (
  SELECT conv_id, turn, count(*) AS n FROM (SELECT conv_id, turn, unnest(w) AS word FROM outs) JOIN words USING (word) GROUP BY conv_id, turn
), judged AS (
  SELECT o.conv_id, o.turn, CASE WHEN starts_with(plain, 'the ') OR starts_with(plain, 'la ') THEN 'prefix'
    WHEN contains(array_to_string(w[1:8], ' '), ' of the ') THEN 'phrase' WHEN len(w) = 0 THEN 'empty'
    WHEN coalesce(n, 0) / len(w) <= 0.4 THEN 'unknown' END AS reason
  FROM outs o LEFT JOIN hits h ON h.conv_id = o.conv_id AND h.turn = o.turn)"""


def _judged(spark, sf_dir) -> DataFrame:
    """The quality rules over assistant turns, with words of the benchmark as the dictionary and phrases of these texts."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("word"))
    outs = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("text", nfkc("text"))
    return quality.reasons(outs, words, ["conv_id", "turn"], "text", _PREFIXES, _PHRASE)


@query(f"WITH {_REASONS} SELECT conv_id, turn, reason FROM judged")
def quality_reasons(spark, sf_dir):
    return _judged(spark, sf_dir)


@query(f"WITH {_REASONS} SELECT DISTINCT conv_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.conv_id = c.conv_id AND reason IS NOT NULL)")
def quality_filter(spark, sf_dir):
    samples = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return quality.accepted_samples(samples, _judged(spark, sf_dir), "conv_id")


@query(f"WITH {_REASONS} SELECT reason, count(*) AS n FROM (SELECT conv_id, arg_min(reason, turn) AS reason FROM judged WHERE reason IS NOT NULL GROUP BY conv_id) GROUP BY reason")
def quality_counters(spark, sf_dir):
    return quality.reason_counts(_judged(spark, sf_dir), "conv_id", "turn")


# prompts, replies, preferences ----------------------------------------------------------------------------------------
_OUTPUTS = "outs AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS input, list('[ID=turn-' || turn || '] ' || text ORDER BY turn) FILTER (WHERE role = 'assistant') AS items FROM conversations GROUP BY conv_id)"


@query(f"""WITH {_OUTPUTS} SELECT conv_id, md5('Rank these summaries.' || chr(10) || 'Article:' || chr(10) || input || chr(10) || 'Summaries:' || chr(10) || array_to_string(items, chr(10) || '--------------' || chr(10))) AS digest
FROM outs WHERE input IS NOT NULL AND items IS NOT NULL""")
def prompt_listwise(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("input"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("outputs"),
    )
    t = t.where("input IS NOT NULL AND size(outputs) > 0")
    items = F.transform("outputs", lambda o: F.struct(F.concat(F.lit("turn-"), o["turn"].cast("string")).alias("name"), o["text"].alias("content")))
    prompt = generation.listwise_prompt("Rank these summaries.\nArticle:\n{article}\nSummaries:\n{summaries}", F.col("input"), items)
    return t.select("conv_id", F.md5(prompt).alias("digest"))


_TWO = f"""{CANDIDATES}, two AS (SELECT x.conv_id, 'turn-' || x.turn AS x, 'turn-' || y.turn AS y, x.hyp AS hx, y.hyp AS hy, x.ref FROM candidates x JOIN candidates y ON y.conv_id = x.conv_id AND x.turn < y.turn)"""


def _named(spark, sf_dir) -> DataFrame:
    """conv_id, name, pos, content: a conversation's candidates under the names of their turns."""
    return candidates(spark, sf_dir).select("conv_id", F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("name"), "pos", F.col("hyp").alias("content"))


def _comparisons(spark, sf_dir, done: DataFrame | None = None) -> DataFrame:
    return ranking.comparisons_to_make(_named(spark, sf_dir), done=done, id="conv_id")


@query(f"""WITH {_TWO} SELECT conv_id, x, y, md5('Choose the better summary.' || chr(10) || ref || chr(10) || '[ID=' || x || '] ' || hx || chr(10) || '[ID=' || y || '] ' || hy) AS digest FROM two""")
def prompt_pairwise(spark, sf_dir):
    refs = candidates(spark, sf_dir).select("conv_id", "ref").distinct()
    c = _comparisons(spark, sf_dir).join(refs, "conv_id")
    prompt = text.filled("Choose the better summary.\n{article}\n[ID={id1}] {summary1}\n[ID={id2}] {summary2}", article=F.col("ref"), id1=F.col("x"), id2=F.col("y"), summary1=F.col("content_x"), summary2=F.col("content_y"))
    return c.select("conv_id", "x", "y", F.md5(prompt).alias("digest"))


_PREFERRED = f"""{_TWO}, judged AS (SELECT conv_id, x, y, CASE WHEN length(hx) > length(hy) OR length(hx) = length(hy) AND x < y THEN 1 ELSE -1 END AS preferred FROM two)"""


def _preferences(spark, sf_dir) -> DataFrame:
    """A deterministic judge in place of a hosted model: the longer summary wins, then the smaller name."""
    reply = F.when((F.length("content_x") > F.length("content_y")) | ((F.length("content_x") == F.length("content_y")) & (F.col("x") < F.col("y"))), F.col("x")).otherwise(F.col("y"))
    return generation.preferences(_comparisons(spark, sf_dir).withColumn("completion", F.concat(F.lit("I prefer "), reply)))


@query(f"WITH {_PREFERRED} SELECT conv_id, x, y, CAST(preferred AS INTEGER) AS preferred FROM judged")
def parse_preference(spark, sf_dir):
    return _preferences(spark, sf_dir).select("conv_id", "x", "y", "preferred")


@query(f"WITH {_PREFERRED} SELECT conv_id, name, CAST(sum(w) AS BIGINT) AS wins FROM (SELECT conv_id, x AS name, CAST(preferred = 1 AS INTEGER) AS w FROM judged UNION ALL SELECT conv_id, y, CAST(preferred = -1 AS INTEGER) FROM judged) GROUP BY conv_id, name")
def pairwise_wins(spark, sf_dir):
    p = _preferences(spark, sf_dir)
    side = lambda c, v: p.select("conv_id", F.col(c).alias("name"), (F.col("preferred") == v).cast("long").alias("w"))
    return side("x", 1).unionByName(side("y", -1)).groupBy("conv_id", "name").agg(F.sum("w").alias("wins"))


@query(f"""WITH {_TWO} SELECT conv_id, array_to_string(list('turn-' || turn ORDER BY length(hyp) DESC, 'turn-' || turn), ' > ') AS ranking, 'ranked' AS status FROM candidates WHERE conv_id IN (SELECT conv_id FROM two) GROUP BY conv_id""")
def tournament_rank(spark, sf_dir):
    out = ranking.tournament(_preferences(spark, sf_dir), "conv_id")
    return out.select("conv_id", F.array_join("ranking", " > ").alias("ranking"), "status")


@query(f"""WITH RECURSIVE {_PREFERRED}, edges AS (SELECT DISTINCT conv_id, CASE WHEN preferred = 1 THEN x ELSE y END AS w, CASE WHEN preferred = 1 THEN y ELSE x END AS l FROM judged
), closed AS (SELECT * FROM edges UNION SELECT c.conv_id, c.w, e.l FROM closed c JOIN edges e ON e.conv_id = c.conv_id AND e.w = c.l)
SELECT conv_id, count(*) AS n_ordered, count(*) FILTER (WHERE w = l) AS n_cycles FROM closed GROUP BY conv_id""")
def preference_closure(spark, sf_dir):
    p = _preferences(spark, sf_dir)
    w, l = (F.when(F.col("preferred") == v, F.col("x")).otherwise(F.col("y")) for v in (1, -1))  # noqa: E741
    closed = ranking.closure(p.select("conv_id", w.alias("w"), l.alias("l")), "conv_id")
    return closed.groupBy("conv_id").agg(F.count("*").alias("n_ordered"), F.count_if(F.col("w") == F.col("l")).alias("n_cycles"))


@query(f"""WITH {_PREFERRED} SELECT conv_id, x, y, CAST(CASE WHEN conv_id % 4 = 0 THEN -preferred ELSE preferred END AS INTEGER) AS preferred FROM judged""")
def upsert_comparisons(spark, sf_dir):
    old = _preferences(spark, sf_dir).select("conv_id", "x", "y", "preferred")
    new = old.where("conv_id % 4 = 0").withColumn("preferred", -F.col("preferred"))
    return ranking.upserted(old, new, ["conv_id", "x", "y"])


@query(f"""WITH {PAIRS} SELECT pair_id, CAST((row_number() OVER (ORDER BY pair_id) - 1) % 3 AS INTEGER) AS worker FROM pairs""")
def round_robin_workers(spark, sf_dir):
    rows = datasets.numbered(article_pairs(spark, sf_dir).select("pair_id"), [F.col("pair_id")])
    return rows.select("pair_id", ((F.col("_n") - 1) % 3).cast("int").alias("worker"))


@query("SELECT conv_id, array_to_string(string_split(substr(reply, 11, length(reply) - 11), ','), '|') AS items FROM (SELECT conv_id, 'Ranking: [' || array_to_string(list(turn ORDER BY turn DESC), ', ') || ']' AS reply FROM conversations GROUP BY conv_id)")
def parse_ranking_reply(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list("turn"))).alias("turns"))
    reply = F.concat(F.lit("Ranking: ["), F.array_join(F.transform("turns", lambda x: x.cast("string")), ", "), F.lit("]"))
    return t.select("conv_id", F.array_join(text.ranking_reply(reply), "|").alias("items"))


# vectors --------------------------------------------------------------------------------------------------------------
_UNIT = "unit AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)"
_SELF = f"""WITH {_UNIT}, dims AS (SELECT label, d, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS d FROM unit) GROUP BY label, d),
per AS (SELECT label, max(n) AS n, (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1)) AS similarity FROM dims GROUP BY label HAVING max(n) > 1)"""


@query(f"{_SELF} SELECT label, n, round(similarity, 6) AS similarity FROM per")
def self_similarity(spark, sf_dir):
    return rounded(vectors.self_similarity(table(spark, sf_dir, "embeddings"), "label", "embedding"), "similarity")


@query(f"{_SELF} SELECT round(1 - avg(similarity), 6) AS isotropy FROM per")
def isotropy(spark, sf_dir):
    return rounded(vectors.isotropy(table(spark, sf_dir, "embeddings"), "label", "embedding"), "isotropy")


@query(f"""WITH {_UNIT} SELECT a.vec_id, round(5 * list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 6) AS reward FROM unit a JOIN unit b ON b.vec_id = a.vec_id + 1""")
def cosine_reward(spark, sf_dir):
    """A vector and its successor, as an anchor's and a hypothesis's."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return rounded(vectors.cosine_reward(pairs, "embedding", "next").select("vec_id", "reward"), "reward")


@query("""WITH dims AS (SELECT label, d, sum(x * m) / greatest(sum(m), 1e-9) AS x FROM (SELECT label, CAST(vec_id % 3 <> 0 AS INTEGER) AS m, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings) GROUP BY label, d)
SELECT label, CAST(d AS INTEGER) AS dim, round(x, 6) AS x FROM dims""")
def mean_pool(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    out = vectors.mean_pooled(e, "label", "embedding", "mask").select("label", F.posexplode("pooled").alias("dim", "x"))
    return out.select("label", (F.col("dim") + 1).alias("dim"), F.round("x", PLACES).alias("x"))


# rewards --------------------------------------------------------------------------------------------------------------
#: Half-way values fall to either side in the last bit, as sums depend on their order; a shift takes them off the half.
_SHIFT = 1e-10


@query("""SELECT event_id, round(coalesce(b, 0.0) + 1e-10, 6) AS baseline, round(value - coalesce(b, 0.0) + 1e-10, 6) AS advantage FROM (
  SELECT event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)""")
def reward_baseline(spark, sf_dir):
    out = rewards.baselines(table(spark, sf_dir, "events"), "value", ["user_id"], ["ts", "event_id"])
    return out.select("event_id", *(F.round(F.col(c) + _SHIFT, PLACES).alias(c) for c in ("baseline", "advantage")))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def reward_stats(spark, sf_dir):
    out = rewards.statistics(table(spark, sf_dir, "events"), "value", ["event_type"])
    return rounded(out, "mean", "std").withColumn("total", F.round("total", 3))


@query("SELECT round(coalesce(avg(value), 0.0), 6) AS average FROM (SELECT value FROM events ORDER BY ts, event_id LIMIT 100)")
def seed_baseline(spark, sf_dir):
    return rounded(rewards.seeded(table(spark, sf_dir, "events"), "value", ["ts", "event_id"], 100), "average")


@query("""SELECT event_id, value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS is_best FROM events""")
def best_so_far(spark, sf_dir):
    return rewards.best_so_far(table(spark, sf_dir, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "is_best")


@query("SELECT event_id, value FROM events WHERE event_id % 50 = 0")
def log_every(spark, sf_dir):
    return rewards.every(table(spark, sf_dir, "events"), "event_id", 50).select("event_id", "value")


@query("SELECT user_id, event_id, value FROM events")
def log_batch_rows(spark, sf_dir):
    batch = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("r"))  # a batch as one array a column
    return rewards.log_rows(batch.select("user_id", F.col("r.event_id").alias("event_id"), F.col("r.value").alias("value")), ["user_id"])


# features -------------------------------------------------------------------------------------------------------------
_IDS = lambda c: f"list_transform({TOKENS(c)}, lambda t: CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % 31997 + 3 AS INTEGER))"
_FEATURES = f"""{PAIRS}, ids AS (SELECT pair_id, turn, {_IDS('input')} AS i, {_IDS('output')} AS o FROM pairs),
cut AS (SELECT pair_id, turn, CASE WHEN len(i) > 32 THEN list_append(i[1:31], 1) ELSE i END AS input_ids, CASE WHEN len(o) > 0 THEN list_append(o[1:least(len(o), 24) - 1], 1) ELSE o END AS labels FROM ids),
shifted AS (SELECT *, CASE WHEN len(labels) > 0 THEN list_prepend(0, labels[1:len(labels) - 1]) ELSE [0] END AS decoder_input_ids FROM cut)"""


def _features(spark, sf_dir, pairs: DataFrame | None = None) -> DataFrame:
    p = article_pairs(spark, sf_dir) if pairs is None else pairs
    rest = [c for c in p.columns if c not in ("input", "output", "conv_id")]
    p = p.select(*rest, training.hashed_ids(F.col("input")).alias("source"), training.hashed_ids(F.col("output")).alias("target"))
    return training.model_inputs(p, "source", "target", 32, 24, 1, 0).select(*rest, "input_ids", "labels", "decoder_input_ids")


def _batched(spark, sf_dir) -> DataFrame:
    """Features in batches of 8, in order; pairs are numbered first, so that features are made once."""
    return _features(spark, sf_dir, datasets.batches(article_pairs(spark, sf_dir).drop("turn"), 8, [F.col("pair_id")]))


@query(f"""WITH {_FEATURES} SELECT pair_id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(labels, ' ') AS labels, array_to_string(decoder_input_ids, ' ') AS decoder_input_ids FROM shifted""")
def shift_right(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("pair_id", *(F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in ("input_ids", "labels", "decoder_input_ids")))


@query(f"""WITH {_FEATURES}, batched AS (SELECT *, CAST((row_number() OVER (ORDER BY pair_id) - 1) // 8 AS BIGINT) AS batch FROM shifted),
sized AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch) AS mi, max(len(labels)) OVER (PARTITION BY batch) AS mo FROM batched)
SELECT pair_id, batch, md5(array_to_string(list_concat(input_ids, list_transform(range(mi - len(input_ids)), lambda x: 0)), ' ')) AS input_ids,
  CAST(len(input_ids) AS BIGINT) AS n_active, CAST(mi AS BIGINT) AS width,
  md5(array_to_string(list_concat(labels, list_transform(range(mo - len(labels)), lambda x: -100)), ' ')) AS labels FROM sized""")
def token_truncate_pad(spark, sf_dir):
    c = training.collated(_batched(spark, sf_dir), "batch", 0)
    digest = lambda x: F.md5(F.array_join(F.transform(x, lambda v: v.cast("string")), " ")).alias(x)
    n = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long")
    return c.select("pair_id", "batch", digest("input_ids"), n.alias("n_active"), F.size("input_ids").cast("long").alias("width"), digest("labels"))


@query(f"""WITH {_FEATURES} SELECT round(sum(hit) / sum(n), 6) AS accuracy FROM (SELECT len(labels) AS n, len(list_filter(range(1, len(labels) + 1), lambda i: labels[i] = CASE WHEN i % 3 = 0 THEN labels[i] ELSE labels[i] + 1 END)) AS hit FROM shifted)""")
def token_accuracy(spark, sf_dir):
    f = training.collated(_batched(spark, sf_dir), "batch", 0)
    guess = F.transform("labels", lambda x, i: F.when((i + 1) % 3 == 0, x).otherwise(x + 1))
    return rounded(training.token_accuracy(f.withColumn("guess", guess), "labels", "guess"), "accuracy")


@query("SELECT round(exp(least(-avg(-abs(value) / 100.0), ln(1e5))), 6) AS perplexity FROM events")
def perplexity(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("log_prob", -F.abs("value") / 100.0)
    return rounded(training.perplexity(e, "log_prob"), "perplexity")


@query(f"""WITH {_FEATURES} SELECT pair_id, array_to_string(list_concat(input_ids, [2], labels, [1]), ' ') AS ids, CAST(len(input_ids) + len(labels) + 1 AS INTEGER) AS pooled FROM cut""")
def crossenc_inputs(spark, sf_dir):
    f = _features(spark, sf_dir)
    ids = training.cross_encoder_ids(F.col("input_ids"), F.col("labels"), 2, 1)
    return f.select("pair_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"), arrays.pooled_index(arrays.padded(ids, 80, 0), 0).alias("pooled"))


@query(f"""WITH {_FEATURES} SELECT pair_id FROM shifted WHERE len(labels) >= 20""")
def short_response_skip(spark, sf_dir):
    return rewards.long_enough(_features(spark, sf_dir), "labels", 20).select("pair_id")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings")
def argmax_token(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.argmax(F.col("embedding")).alias("best"))


@query(f"""WITH {PAIRS}, named AS (SELECT pair_id, CASE pair_id % 3 WHEN 0 THEN 'vietnews' WHEN 1 THEN 'xsum' ELSE 'cnndm' END AS dataset,
  len(list_filter(string_split_regex(input, '\\s+'), lambda x: x <> '')) AS i, len(list_filter(string_split_regex(output, '\\s+'), lambda x: x <> '')) AS o FROM pairs)
SELECT pair_id, n.dataset, CAST(least(i, coalesce(max_input, i)) AS INTEGER) AS n_input, CAST(least(o, max_output) AS INTEGER) AS n_output
FROM named n JOIN (VALUES ('vietnews', 200, NULL), ('xsum', 80, 512), ('cnndm', 120, 1024)) t(dataset, max_output, max_input) ON t.dataset = n.dataset""")
def dataset_presets(spark, sf_dir):
    """Words of pairs that the length limits of their dataset leave; every third pair is of one dataset."""
    of = F.element_at(F.array(F.lit("vietnews"), F.lit("xsum"), F.lit("cnndm")), (F.col("pair_id") % 3 + 1).cast("int"))
    rows = article_pairs(spark, sf_dir).withColumn("dataset", of).join(F.broadcast(generation.presets(spark)), "dataset")  # a row a dataset
    n = lambda c: F.size(text.words(F.col(c)))
    return rows.select("pair_id", "dataset", F.least(n("input"), F.coalesce("max_input", n("input"))).alias("n_input"), F.least(n("output"), F.col("max_output")).alias("n_output"))


# without SQL ----------------------------------------------------------------------------------------------------------
@query()
def porter_rouge(spark, sf_dir):
    p = article_pairs(spark, sf_dir)
    stems = lambda c: stemmed(text.tokens(F.col(c)))
    p = p.select("pair_id", stems("output").alias("h"), stems("input").alias("r"))
    out = rouge.rouge(p, "pair_id", "h", "r", ns=(1,), tokenized=True)
    return rounded(out, "rouge1_p", "rouge1_r", "rouge1_f")


@query("SELECT doc_id AS id, text AS input, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:12], ' ') AS output FROM documents")
def generate_stub(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("input"))
    return generation.generated(d, generation.LeadingWords(12))


_WORDS = lambda c: f"list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


@query(f"""WITH {PAIRS} SELECT pair_id, round(CASE WHEN len(o) = 0 THEN 0.0 ELSE len(list_filter(o, lambda w: list_contains(i, w))) / len(o) END, 6) AS score
FROM (SELECT pair_id, {_WORDS('input')} AS i, {_WORDS('output')} AS o FROM pairs)""")
def crossenc_stub(spark, sf_dir):
    p = article_pairs(spark, sf_dir)
    return rounded(generation.scored(p.select("pair_id", "input", "output"), generation.Overlap(), "input", "output"), "score")


@query(f"""WITH {CANDIDATES}, scored AS (SELECT conv_id, pos, round(CASE WHEN len(h) = 0 THEN 0.0 ELSE len(list_filter(h, lambda w: list_contains(r, w))) / len(h) END, 9) AS f
  FROM (SELECT conv_id, pos, {_WORDS('ref')} AS r, {_WORDS('hyp')} AS h FROM candidates))
SELECT conv_id, array_to_string(list(CAST(pos + 1 AS INTEGER) ORDER BY f DESC, pos), ', ') AS ranking FROM scored GROUP BY conv_id""")
def crossenc_rank(spark, sf_dir):
    """Candidates ranked by a cross-encoder's score; the stand-in scorer takes its place."""
    out = generation.ranked_by_scorer(candidates(spark, sf_dir), generation.Overlap(), "conv_id", "pos", "ref", "hyp")
    return out.select("conv_id", F.array_join("ranking", ", ").alias("ranking"))


_VECTOR = "list_transform(range(1, 9), lambda i: CAST(ascii(substr(md5(w), i, 1)) - 75 AS DOUBLE))"


@query(f"""WITH {CANDIDATES}, words AS (
  SELECT conv_id, pos, 'h' AS side, unnest({TOKENS('hyp')}) AS w FROM candidates UNION ALL SELECT conv_id, pos, 'r', unnest({TOKENS('ref')}) FROM candidates
), counted AS (SELECT conv_id, pos, side, w, count(*) AS n FROM words GROUP BY ALL
), vectors AS (SELECT w, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM (SELECT w, {_VECTOR} AS v FROM (SELECT DISTINCT w FROM words))
), matched AS (
  SELECT a.conv_id, a.pos, a.w AS a, b.w AS b, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(list_sum(list_transform(range(1, 9), lambda i: x.u[i] * y.u[i]))) AS c
  FROM counted a JOIN counted b ON b.conv_id = a.conv_id AND b.pos = a.pos AND a.side = 'h' AND b.side = 'r' JOIN vectors x ON x.w = a.w JOIN vectors y ON y.w = b.w GROUP BY a.conv_id, a.pos, a.w, b.w
), p AS (SELECT conv_id, pos, sum(n * c) / sum(n) AS p FROM (SELECT conv_id, pos, a, any_value(na) AS n, max(c) AS c FROM matched GROUP BY conv_id, pos, a) GROUP BY conv_id, pos
), r AS (SELECT conv_id, pos, sum(n * c) / sum(n) AS r FROM (SELECT conv_id, pos, b, any_value(nb) AS n, max(c) AS c FROM matched GROUP BY conv_id, pos, b) GROUP BY conv_id, pos
), scored AS (SELECT c.conv_id, c.pos, round(coalesce(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 0.0), 9) AS f FROM candidates c LEFT JOIN p USING (conv_id, pos) LEFT JOIN r USING (conv_id, pos))
SELECT conv_id, array_to_string(list(CAST(pos + 1 AS INTEGER) ORDER BY f DESC, pos), ', ') AS ranking FROM scored GROUP BY conv_id""")
def bertscore_rank(spark, sf_dir):
    c = candidates(spark, sf_dir)
    # a token's vector from its md5, in place of a model's
    vector = lambda t: F.transform(text.tokens(t), lambda w: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.ascii(F.substring(F.md5(w), i, F.lit(1))).cast("double") - 75))
    scored = vectors.greedy_match(c.withColumn("h", vector(F.col("hyp"))).withColumn("r", vector(F.col("ref"))), "h", "r")
    out = ranking.ranked(scored.select("conv_id", "pos", F.round("bert_f", 9).alias("score")), "conv_id", "pos", "score")
    return out.select("conv_id", F.array_join("ranking", ", ").alias("ranking"))
