"""Queries that iterate over tables or need a structure of their own: adaptive rankings, permutations, regrouping, sketches."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import datasets, patterns, rewards, rouge
from ..sources.scratch import new_path
from ..sources.store import KeyedStore
from .adaptive import adaptive_tournament
from .catalog import _TWO, PAIRS, TOKENS, _named, _preferences, _rouge_sql, article_pairs, query, rounded, table
from .tasks import _JUDGED


def longer_first(pairs):
    """A deterministic judge in place of a hosted model: the longer summary wins, then the smaller name."""
    first = (F.length("content_x") > F.length("content_y")) | ((F.length("content_x") == F.length("content_y")) & (F.col("x") < F.col("y")))
    return pairs.withColumn("preferred", F.when(first, 1).otherwise(-1))


_ADAPTIVE = f"""{_TWO}, whole AS (SELECT conv_id, count(*) AS k, array_to_string(list('turn-' || turn ORDER BY length(hyp) DESC, 'turn-' || turn), ' > ') AS ranking FROM candidates GROUP BY conv_id)"""


@query(f"WITH {_ADAPTIVE} SELECT conv_id, ranking, 'ranked' AS status, k AS n_names, true AS few FROM whole")
def tournament_adaptive(spark, sf_dir):
    """Rankings by rounds in which only the pairs that each merge needs next are judged; few: within n log2 n pairs of n names."""
    rankings, made = adaptive_tournament(_named(spark, sf_dir), longer_first, id="conv_id")
    out = rankings.join(made.where("judged").groupBy("conv_id").agg(F.count("*").alias("pairs")), "conv_id", "left")
    n = F.size("ranking").cast("long")
    return out.select("conv_id", F.array_join("ranking", " > ").alias("ranking"), "status", n.alias("n_names"), (F.coalesce("pairs", F.lit(0)) <= n * F.log2(n)).alias("few"))


@query(f"WITH {_ADAPTIVE} SELECT w.conv_id, ranking, 'ranked' AS status, CAST(0 AS BIGINT) AS again FROM whole w")
def tournament_resumed(spark, sf_dir):
    """The same with the comparisons of a run that broke off after its first round: none of them is judged again."""
    names = _named(spark, sf_dir)
    _, made = adaptive_tournament(names, longer_first, id="conv_id")
    done = made.where("round = 0").select("conv_id", "x", "y", "preferred")
    rankings, rest = adaptive_tournament(names, longer_first, done=done, id="conv_id")
    again = rest.where("judged").join(done, ["conv_id", "x", "y"], "left_semi").groupBy("conv_id").agg(F.count("*").alias("again"))
    return rankings.join(again, "conv_id", "left").select("conv_id", F.array_join("ranking", " > ").alias("ranking"), "status", F.coalesce("again", F.lit(0).cast("long")).alias("again"))


def _permuted_sql(rows: str, seed: int) -> str:
    """The same arithmetic as `datasets.permuted`: a table walk (i, x, step) of each ordinal's way to its place."""
    right, left = "x % b", "x // b"
    for r in range(datasets.ROUNDS):
        key = f"(({{}}) * 40503 + {(seed * 7919 + r * 104729) % 1000003}) * 12289 // 128"
        if r % 2:
            right = f"(({right}) + ({key.format(left)})) % b"
        else:
            left = f"(({left}) + ({key.format(right)})) % a"
    once = f"({left}) * b + {right}"
    return f"""whole AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a, CAST(ceil(count(*) / ceil(sqrt(count(*)))) AS BIGINT) AS b FROM {rows}
), walk AS (SELECT i, i AS x, 0 AS step FROM {rows} UNION ALL SELECT i, {once} AS x, step + 1 FROM walk, whole WHERE step = 0 OR x >= n
), places AS (SELECT i, arg_max(x, step) AS place FROM walk GROUP BY i)"""


@query(f"""WITH RECURSIVE ids AS (SELECT doc_id AS i FROM documents), {_permuted_sql('ids', 11 + 2)}
SELECT i AS doc_id, place, place // 16 AS batch FROM places, whole WHERE place >= 3 * 16 AND place < n // 16 * 16""")
def epoch_permutation(spark, sf_dir):
    """The third epoch's batches from the fourth on, by arithmetic on the ordinal."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return datasets.permuted_epoch(d, d.count(), seed=11, number=2, size=16, row_id="doc_id", skip=3)


@query("""WITH sizes AS (SELECT o_orderkey, coalesce(count(l_orderkey), 0) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
), bounds AS (SELECT o_orderkey, n, coalesce(sum(n) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM sizes
), flat AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS pos, l_extendedprice AS score FROM lineitem)
SELECT o_orderkey AS item, count(*) AS n, round(sum(score), 2) AS total, CAST(min(pos) AS BIGINT) AS first_pos FROM flat JOIN bounds ON pos >= first AND pos < first + n GROUP BY o_orderkey""")
def regroup_scores(spark, sf_dir):
    """A flat list of scores, cut into its items again by their numbers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"))
    flat = datasets.numbered(lines, [F.col("l_orderkey"), F.col("l_linenumber")], "pos").select((F.col("pos") - 1).alias("pos"), "score")
    counts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("size"))
    groups = table(spark, sf_dir, "orders").select("o_orderkey").join(counts, "o_orderkey", "left")
    out = datasets.regrouped(flat, groups, order=[F.col("o_orderkey")])
    return out.groupBy(F.col("o_orderkey").alias("item")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"), F.min("pos").alias("first_pos"))


@query(f"""WITH {_JUDGED} SELECT conv_id AS sample_id, x, y, CASE WHEN conv_id % 16 = 3 THEN -preferred ELSE preferred END AS preferred, CASE WHEN conv_id % 16 = 3 THEN 1 ELSE 0 END AS run FROM judged""")
def store_upsert(spark, sf_dir):
    """Comparisons in a store of buckets; a later run's batch rewrites the buckets of its samples alone."""
    rows = _preferences(spark, sf_dir).select(F.col("conv_id").alias("sample_id"), "x", "y", "preferred", F.lit(0).alias("run"))
    store = KeyedStore(spark, new_path(spark, "comparisons"), "sample_id long, x string, y string, preferred int, run int", ["sample_id", "x", "y"], buckets=16)
    store.upsert(rows)
    store.upsert(rows.where("sample_id % 16 = 3").withColumns({"preferred": -F.col("preferred"), "run": F.lit(1)}), order="run")
    return store.read()


@query("""SELECT event_type, p, true AS near, true AS as_whole FROM (SELECT DISTINCT event_type FROM events WHERE value IS NOT NULL), (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) v(p)""")
def reward_quantiles(spark, sf_dir):
    """Quantiles from sketches by step, merged; their ranks against exact ones, and against one sketch of everything."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_type", "value", F.pmod("event_id", F.lit(20)).alias("step"))
    path = new_path(spark, "sketches")
    rewards.sketched(e, ["event_type", "step"], "value").write.parquet(path)
    steps = spark.read.parquet(path)
    ps = [0.05, 0.25, 0.5, 0.75, 0.95]
    merged = rewards.quantiles(rewards.merged_sketches(steps, ["event_type"]), ["event_type"], ps)
    whole = rewards.quantiles(rewards.sketched(e, ["event_type"], "value"), ["event_type"], ps).withColumnRenamed("q", "q_whole")
    both = merged.join(whole, ["event_type", "p"])
    rank = lambda q: F.avg((F.col("value") <= F.col(q)).cast("double"))
    exact = e.join(F.broadcast(both), "event_type").groupBy("event_type", "p").agg(rank("q").alias("r"), rank("q_whole").alias("r_whole"))
    near = lambda x, y: F.abs(x - y) <= rewards.RANK_ERROR
    return exact.select("event_type", F.col("p").cast("decimal(3,2)").alias("p"), near(F.col("r"), F.col("p")).alias("near"), near(F.col("r"), F.col("r_whole")).alias("as_whole"))


@query(f"""WITH words AS (SELECT DISTINCT unnest({TOKENS('text')}) AS word FROM benchmark)
SELECT doc_id, word AS pattern, CAST((length(text) - length(replace(text, word, ''))) / length(word) AS BIGINT) > 0 AS there FROM documents JOIN words ON contains(text, word)""")
def dictionary_hits(spark, sf_dir):
    """All words of a dictionary that occur in each text, within words too."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("pattern")).distinct()
    return patterns.occurrences(table(spark, sf_dir, "documents"), words, "doc_id").select("doc_id", "pattern", (F.col("n") > 0).alias("there"))


def _lowered(c: str) -> str:
    """SQL of a text that is put into lower case before anything else."""
    return f"lower({c})"


@query(f"WITH {PAIRS}, low AS (SELECT pair_id, {_lowered('input')} AS input, {_lowered('output')} AS output FROM pairs), {_rouge_sql('low', 'pair_id', 'output', 'input', 1, 'r1')} SELECT pair_id, round(p, 6) AS rouge1_p, round(r, 6) AS rouge1_r, round(f, 6) AS rouge1_f FROM r1")
def rouge_lower_first(spark, sf_dir):
    """The variant that lowers texts before punctuation goes."""
    p = article_pairs(spark, sf_dir).select("pair_id", text.tokens(F.lower("output")).alias("h"), text.tokens(F.lower("input")).alias("r"))
    return rounded(rouge.rouge(p, "pair_id", "h", "r", ns=(1,), tokenized=True), "rouge1_p", "rouge1_r", "rouge1_f")
