"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, collocations, decontaminate, lexical, lm, packing, quality, rules, simhash, substring, tokens, toxicity, urls

#: The text of both turns of the extra conversation of the formatting query.
EXTRA = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(spark, _table(spark, sf_dir, "documents"))
    return rows.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    turns = turns.unionByName(extra)
    read = chat.parsed(chat.formatted(turns))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM rows
), sized AS (
  SELECT *,
    length(regexp_replace(text, '(\\*(?:### |</turn>|<\+>))', '\\\1', 'g'))
    + CASE WHEN before = role THEN 5
           ELSE 4 + length(CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'Role(' || url_encode(role) || ')' END) + 2 + 9 END AS chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    dedup = substring.SubstringDedup(spark, _table(spark, sf_dir, "documents"))
    rows = dedup.rows
    dedup.drop()
    return rows.drop("rid")


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35)
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM again)
), kept AS (
  SELECT o.doc_id, string_agg(o.x, ' ' ORDER BY o.p) AS line, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) o
  ANTI JOIN gone g ON g.doc_id = o.doc_id AND g.p = o.p GROUP BY o.doc_id
)
SELECT a.doc_id, CAST(len(a.w) AS BIGINT) AS n_words, CAST(len(a.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.line, '')) AS kept_sha256
FROM words a LEFT JOIN kept k ON k.doc_id = a.doc_id
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality.Quality(spark, documents, _table(spark, sf_dir, "labels"), learn=quality.held_in())
    return _judged(model.scores(documents), ~quality.held_in())


def _judged(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", (F.size("hits") > 0).alias("contaminated"), F.transform("hits", lambda h: h["item_id"]).alias("item_ids"), F.array_min(F.transform("hits", lambda h: h["distance"])).alias("least_distance"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.Toxicity(spark, documents, _table(spark, sf_dir, "labels"), learn=toxicity.held_in())
    return _judged(model.scores(documents), ~toxicity.held_in())


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.judged(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *rules.COUNTS, "base_failed", "kept")


OP9_SQL = r"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS n
  FROM (SELECT doc_id, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM texts WHERE len(w) >= 3))
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM texts) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT t.doc_id, t.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(a.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t LEFT JOIN lines l ON l.doc_id = t.doc_id LEFT JOIN again a ON a.doc_id = t.doc_id
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM based GROUP BY source
), fit AS (
  SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM hosts
), rates AS (
  SELECT source, CASE WHEN v > 0 THEN (bad + greatest(m * (1 - m) / v - 1, 1.0) * m) / (n + greatest(m * (1 - m) / v - 1, 1.0)) ELSE m END AS rate FROM hosts, fit
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM based b JOIN rates r ON r.source IS NOT DISTINCT FROM b.source
"""


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm.scored(spark, _table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})  # sums depend on their order in the last bits


OP10_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS b FROM texts
), pairs AS (
  SELECT r, i, b, lag(b) OVER (PARTITION BY r ORDER BY i) AS a FROM words
), ones AS (
  SELECT b AS w, count(*) AS c FROM words GROUP BY b
), twos AS (
  SELECT a, b, count(*) AS c FROM pairs WHERE a IS NOT NULL GROUP BY a, b
), scored AS (
  SELECT r, sum(CASE WHEN p.a IS NULL THEN ln(y.c / n) WHEN t.c >= 1 THEN ln(t.c / x.c) ELSE ln(0.4 * y.c / n) END) AS s
  FROM pairs p JOIN ones y ON y.w = p.b LEFT JOIN ones x ON x.w = p.a LEFT JOIN twos t ON t.a = p.a AND t.b = p.b, (SELECT count(*) AS n FROM words) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 6) AS log_score, round(s / len(w), 6) AS mean_log_score FROM texts LEFT JOIN scored USING (r)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, _table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), phrases AS (
  SELECT lang, k, w[i:i + k - 1] AS w FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM pieces) WHERE len(w) >= k)
), counted AS (
  SELECT lang, k, array_to_string(w, ' ') AS phrase, any_value(w) AS w, count(*) AS f FROM phrases GROUP BY lang, k, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.w, cut, array_to_string(c.w[1:cut], ' ') AS x, array_to_string(c.w[cut + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM counted WHERE k > 1) c
), scored AS (
  SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM cuts c JOIN counted l ON l.lang = c.lang AND l.phrase = x JOIN counted r ON r.lang = c.lang AND r.phrase = y
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, f FROM (
    SELECT lang, w, f, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM counted WHERE k > 2))
), covers AS (
  SELECT lang, phrase, max(f) AS f FROM inner_phrases GROUP BY lang, phrase
), kept AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank
  FROM lowest l LEFT JOIN covers c ON c.lang = l.lang AND c.phrase = l.phrase WHERE c.f IS NULL OR 100 * c.f < 80 * a
)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM kept k JOIN totals t ON t.lang = k.lang WHERE rank <= 2000
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.searched(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sums AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM texts
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM texts) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings, sums GROUP BY term, docs
), lengths AS (
  SELECT r, doc_id, 100 - 25 + ((25 * CAST(len(w) AS BIGINT) * docs) // total) AS m FROM texts, sums WHERE len(w) > 0
), asked AS (
  SELECT i, item_id, term, count(*) AS times FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, * FROM benchmark)) GROUP BY i, item_id, term
), scores AS (
  SELECT i, item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY i, item_id, r, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""


#: The rules of the URL query.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.UrlFilter(spark, _table(spark, sf_dir, "pages"), URL_RULES).judged().drop("difference")


OP13_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM cut
), rules(rule, rule_host, rule_path, ruling) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
  SELECT r, rule, ruling FROM parsed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC, rule) = 1
), marked AS (
  SELECT p.*, rule, ruling, CAST('0x' || substr(md5(host || path), 1, 8) AS BIGINT) % 5 = 0 AS held,
    'zzzzzzzz' || hex(encode(host || path)) || '$$' AS h, octet_length(encode(host || path)) + 1 AS n
  FROM parsed p LEFT JOIN fits USING (r)
), symbols AS (
  SELECT r, i, k, ruling, held, substr(h, 2 * (4 + i - k) + 1, 2 * k) AS context, substr(h, 2 * (4 + i) + 1, 2) AS symbol
  FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS k FROM (SELECT *, unnest(range(0, n)) AS i FROM marked))
), grams AS (
  SELECT ruling AS side, k, context, symbol, count(*) AS c FROM symbols WHERE ruling IS NOT NULL AND NOT held GROUP BY side, k, context, symbol
), contexts AS (
  SELECT side, k, context, sum(c) AS n, count(*) AS t FROM grams GROUP BY side, k, context HAVING sum(c) >= 2
  QUALIFY row_number() OVER (PARTITION BY side ORDER BY sum(c) DESC, k, context) <= 16384
), stats AS (
  SELECT s.r, s.i, s.k, v.side, coalesce(x.n, 0) AS n, coalesce(x.t, 0) AS t, coalesce(g.c, 0) AS c
  FROM symbols s CROSS JOIN (VALUES ('allow'), ('block')) v(side)
  LEFT JOIN contexts x ON x.side = v.side AND x.k = s.k AND x.context = s.context
  LEFT JOIN grams g ON g.side = v.side AND g.k = s.k AND g.context = s.context AND g.symbol = s.symbol
), wide AS (
  SELECT r, i, side, max(n) FILTER (k = 0) AS n0, max(t) FILTER (k = 0) AS t0, max(c) FILTER (k = 0) AS c0, max(n) FILTER (k = 1) AS n1, max(t) FILTER (k = 1) AS t1, max(c) FILTER (k = 1) AS c1,
    max(n) FILTER (k = 2) AS n2, max(t) FILTER (k = 2) AS t2, max(c) FILTER (k = 2) AS c2, max(n) FILTER (k = 3) AS n3, max(t) FILTER (k = 3) AS t3, max(c) FILTER (k = 3) AS c3,
    max(n) FILTER (k = 4) AS n4, max(t) FILTER (k = 4) AS t4, max(c) FILTER (k = 4) AS c4
  FROM stats GROUP BY r, i, side
), chances AS (
  SELECT r, i, side, CASE WHEN n0 > 0 THEN (c0 + t0 * (1 / 257)) / (n0 + t0) ELSE 1 / 257 END AS p0, CASE WHEN n1 > 0 THEN (c1 + t1 * p0) / (n1 + t1) ELSE p0 END AS p1,
    CASE WHEN n2 > 0 THEN (c2 + t2 * p1) / (n2 + t2) ELSE p1 END AS p2, CASE WHEN n3 > 0 THEN (c3 + t3 * p2) / (n3 + t3) ELSE p2 END AS p3,
    CASE WHEN n4 > 0 THEN (c4 + t4 * p3) / (n4 + t4) ELSE p3 END AS p FROM wide
), gains AS (
  SELECT r, i, max(ln(p)) FILTER (side = 'allow') - max(ln(p)) FILTER (side = 'block') AS gain FROM chances GROUP BY r, i
), binned AS (
  SELECT r, CAST(greatest(-1000, least(1000, floor(sum(gain) / count(*) * 100))) AS BIGINT) AS bin FROM gains GROUP BY r
), sides AS (
  SELECT bin, count(*) FILTER (ruling = 'allow') AS a, count(*) FILTER (ruling = 'block') AS b FROM binned JOIN marked USING (r) WHERE ruling IS NOT NULL AND held GROUP BY bin
), tried AS (
  SELECT t, coalesce(sum(a) FILTER (bin >= t), 0) * (SELECT coalesce(sum(b), 0) FROM sides) + coalesce(sum(b) FILTER (bin < t), 0) * (SELECT coalesce(sum(a), 0) FROM sides) AS told
  FROM (SELECT unnest(range(-1000, 1002)) AS t) LEFT JOIN sides ON true GROUP BY t
), chosen AS (
  SELECT t FROM tried ORDER BY told DESC, abs(t), t LIMIT 1
)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN bin >= (SELECT t FROM chosen) THEN 'allow' ELSE 'block' END) AS verdict FROM marked JOIN binned USING (r)
"""


def queries() -> dict:
    own = (op1_packing, op2_chat, op3_substring, op4_quality, op5_decontaminate, op6_simhash, op7_tokens, op8_toxicity, op9_rules, op10_lm, op11_collocations, op12_search, op13_urls)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op2_chat": OP2_SQL, "op3_substring": OP3_SQL, "op9_rules": OP9_SQL, "op10_lm": OP10_SQL, "op11_collocations": OP11_SQL, "op12_search": OP12_SQL, "op13_urls": OP13_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in sql.items() if v}
