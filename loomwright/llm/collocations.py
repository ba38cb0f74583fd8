"""Phrase collocations: neighbouring words that occur together more often than their parts alone would have it.

Texts are cut into pieces at punctuation and line ends. Identical pieces of a language become one with a multiplicity, so
that copied passages are counted once. Phrases of 1 to LONGEST words are counted in rounds, weighted by multiplicity: each
task sums what it has, rows are dealt by language and phrase into hash buckets, and each bucket is summed by DuckDB, which
streams its rows and spills beyond its memory limit. A phrase cannot be frequent unless both phrases of one word less are,
so a round only forms those whose shorter ones pass a bitmap of the frequent ones: of fixed size, whatever the corpus, and
without false negatives, so that it saves work and loses no phrase.

Each frequent phrase then asks for the counts of its parts: a lookup request for each side of each cut, shuffled to the
bucket that holds the part's count, and answered back to the phrase. A part has no more requests than its own count allows,
so only the parts of the highest counts can be hot; HOT of them are a bounded table that is broadcast, and only other
requests are shuffled.
"""

import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import gram_hashes, has_columns, mixed, spread, word_hashes
from ._workspace import Workspace

LEAST, LONGEST, TOP, COVER_PERCENT = 30, 4, 2000, 80
#: Bits of the bitmap that tells frequent phrases (8 MB), and counts of parts that are broadcast.
BITS, HOT = 26, 4096
#: Parts of a language that are ranked alone before their best are ranked together.
SALTS = 256
#: DuckDB's memory in a task, and the bytes of pieces that a task counts at a time.
MEMORY, CHUNK = "256MB", 8 << 20
#: The pieces' separators.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_ENDS + bytes(range(65, 91)), b"\n" * len(_ENDS) + bytes(range(97, 123)))
_PIECES = pa.schema([("lang", pa.string()), ("piece", pa.string()), ("words", pa.int64()), ("m", pa.int64())])
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def pieces_of(text: bytes) -> list[bytes]:
    """The pieces of a text that have a word, lower-cased, their words joined by one space."""
    return [p for x in text.translate(_PLAIN).split(b"\n") if (p := b" ".join(x.split()))]


def distinct_pieces(documents: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, piece, words, m: each distinct piece of a language, its number of words, and how often it occurs."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, found = batch.slice(at, 512), {}
                for name, x in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    for p in pieces_of(x):
                        found[name, p] = found.get((name, p), 0) + 1
                pieces = pa.array([p for _, p in found], pa.binary())
                words = pa.array([p.count(b" ") + 1 for _, p in found], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pieces.cast(pa.string()), words, pa.array(found.values(), pa.int64())], schema=_PIECES)

    rows = has_columns(documents, lang=(lang, "string"), text=(text, "string"))
    rows = spread(rows.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    return rows.mapInArrow(run, "lang string, piece string, words long, m long").groupBy("lang", "piece", "words").agg(F.sum("m").alias("m"))


def _hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """A hash for each word of a language, of equally long arrays."""
    one = lambda x: word_hashes(x.cast(pa.binary()).to_pylist())
    return mixed(one(words) + mixed(one(langs)))


class _Bitmap:
    """2^bits bits, of which those are set that the hashes of frequent phrases point to."""

    def __init__(self, level: DataFrame, bits: int):
        self.bits = bits
        place = F.shiftrightunsigned("h", 64 - bits)
        words = level.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set"))
        found = words.toArrow()  # 2^(bits - 6) rows at most
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _phrases(table: pa.Table, k: int, shorter: _Bitmap | None) -> pa.RecordBatch:
    """lang, phrase, f: the phrases of k words of some distinct pieces whose shorter ones may be frequent, with their counts there."""
    split = pc.split_pattern(table.column("piece").combine_chunks(), " ")
    words, sizes = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False)
    encoded, langs = words.dictionary_encode(), table.column("lang").combine_chunks().dictionary_encode()
    code, named = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
    lang = np.repeat(langs.indices.to_numpy().astype(np.int64), sizes)
    distinct, word = np.unique(lang * named + code, return_inverse=True)  # words are numbered by language
    piece, times = np.repeat(np.arange(len(sizes)), sizes), np.repeat(table.column("m").to_numpy(), sizes)
    at = np.arange(len(word) - k + 1) if len(word) >= k else np.empty(0, np.int64)
    at = at[piece[at] == piece[at + k - 1]]
    if shorter is not None:
        h = _hashes(langs.dictionary.take(pa.array(distinct // named)), encoded.dictionary.take(pa.array(distinct % named)))[word]
        passed = shorter.has(gram_hashes(h, k - 1))
        at = at[passed[at] & passed[at + 1]]
    key = word[at]
    for i in range(1, k):  # exact: phrases so far are numbered anew before each word
        key = np.unique(key, return_inverse=True)[1] * len(distinct) + word[at + i]
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    f = np.bincount(inverse, times[at], len(first)).astype(np.int64)
    at = at[first]
    phrase = pc.binary_join_element_wise(*(words.take(pa.array(at + i)) for i in range(k)), " ")
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[at])), phrase, pa.array(f)], schema=_COUNTS)


def _formed(pieces: DataFrame, k: int, shorter, chunk: int) -> DataFrame:
    """lang, phrase, f of each task's chunks of pieces."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= chunk:
                yield _phrases(pa.Table.from_batches(held), k, shorter and shorter.value)
                held, size = [], 0
        if held:
            yield _phrases(pa.Table.from_batches(held), k, shorter and shorter.value)

    return pieces.where(F.col("words") >= k).select("lang", "piece", "m").mapInArrow(run, "lang string, phrase string, f long")


def _counted(formed: DataFrame, k: int, least: int, memory: str) -> DataFrame:
    """lang, phrase, f, h: each hash bucket's sums of `least` or more, and a hash of each phrase.

    A bucket is streamed through DuckDB, which spills to a folder of the task's own that ends with it."""

    def run(batches):
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill}) as db:
            db.register("bucket", pa.RecordBatchReader.from_batches(_COUNTS, (b.cast(_COUNTS) for b in batches)))
            sums = db.sql(f"SELECT lang, phrase, CAST(sum(f) AS BIGINT) AS f FROM bucket GROUP BY lang, phrase HAVING sum(f) >= {int(least)}")
            for batch in sums.to_arrow_reader(50_000):
                langs, phrases, f = batch.columns
                words = pc.split_pattern(phrases, " ").flatten()
                h = _hashes(langs.take(pa.array(np.repeat(np.arange(len(f)), k))), words)
                h = np.concatenate([gram_hashes(h, k)[::k], np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([langs, phrases, f, pa.array(h)], names=["lang", "phrase", "f", "h"])

    return formed.repartition("lang", "phrase").mapInArrow(run, "lang string, phrase string, f long, h long")


def frequent_phrases(spark: SparkSession, documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = BITS, memory: str = MEMORY, chunk: int = CHUNK) -> tuple[list[DataFrame], DataFrame]:
    """For each number of words from 1 to `longest` a written table lang, phrase, f of the phrases that occur `least` times
    or more, and a table lang, n of the occurrences of all words. Cases are those of `collocations`."""
    ws = Workspace(spark, "collocations")
    pieces = ws.table(distinct_pieces(documents, text, lang), "pieces")
    totals = ws.table(pieces.groupBy("lang").agg(F.sum(F.col("m") * F.col("words")).alias("n")), "totals")
    levels: list[DataFrame] = []
    for k in range(1, longest + 1):
        shorter = spark.sparkContext.broadcast(_Bitmap(levels[-1], bits)) if levels else None
        levels.append(ws.table(_counted(_formed(pieces, k, shorter, chunk), k, least, memory), f"words_{k}"))
    ws.drop("pieces")
    return [x.select("lang", "phrase", "f") for x in levels], totals


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def _asked(candidates: DataFrame, hot: DataFrame, rest: DataFrame) -> DataFrame:
    """lang, phrase, f, cut, side, part_f: a candidate's lookups of both parts of each cut, answered."""
    w = F.split("phrase", " ")
    part = lambda i, first: F.array_join(F.slice(w, 1, i) if first else F.slice(w, i + 1, F.size(w)), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array(*(F.struct(i.alias("cut"), F.lit(first).alias("first"), part(i, first).alias("part")) for first in (True, False))))
    requests = candidates.select("lang", "phrase", "f", F.explode(F.flatten(cuts)).alias("x")).select("lang", "phrase", "f", "x.*")
    of = lambda counts: counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    hot = F.broadcast(of(hot))  # HOT rows
    near, far = requests.join(hot, ["lang", "part"]), requests.join(hot, ["lang", "part"], "left_anti")
    return near.unionByName(far.join(of(rest).hint("merge"), ["lang", "part"]))


def collocations(spark: SparkSession, documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover_percent: int = COVER_PERCENT, hot: int = HOT, salts: int = SALTS, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by score, then a, both descending, then phrase.

    a, l and r are the occurrences of the phrase and of its parts at the cut that scores lowest (of equals, the first),
    n those of all words of the language, score floor(2000000 * a / (l + r)), computed exactly. Phrases inside a longer
    frequent one that has `cover_percent` or more of their occurrences are left out.

    Null texts and texts without words give nothing; a null language is `und`; very long texts and pieces are counted whole;
    repeated rows count each; ties are ranked by the phrase's bytes; an empty table gives an empty result. Columns besides
    text and lang are not read, whatever their names. `options` are those of `frequent_phrases`.
    """
    levels, totals = frequent_phrases(spark, documents, text, lang, least, longest, **options)
    ws = Workspace(spark, "ranked")
    candidates, parts = _union(levels[1:]), _union(levels[:-1])
    often = ws.table(parts.orderBy(F.desc("f"), "lang", "phrase").limit(hot), "hot")
    answers = _asked(candidates, often, parts).select("lang", "phrase", F.col("f").alias("a"), F.struct("cut", "first", "part_f").alias("answer"))
    w = F.split("phrase", " ")
    # the phrases of two words or more inside a longer one
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    covers = _union(levels[2:]).select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("cover")).groupBy("lang", "phrase").agg(F.max("cover").alias("cover")) if longest > 2 else None
    # a phrase's answers (2 * (longest - 1) at most) and its cover meet in one exchange
    met = _union([answers, covers] if covers is not None else [answers.withColumn("cover", F.lit(None).cast("long"))])
    met = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("cover").alias("cover"), F.collect_list("answer").alias("answers"))
    met = met.where(F.col("cover").isNull() | (100 * F.col("cover") < cover_percent * F.col("a")))
    side = lambda cut, first: F.filter("answers", lambda x: (x["cut"] == cut) & (x["first"] == F.lit(first)))[0]["part_f"]
    cuts = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(i.alias("cut"), side(i, True).alias("l"), side(i, False).alias("r")))
    scored = met.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    # the product may pass 64 bits; the score is a million at most
    scored = scored.withColumn("score", F.expr("cast((cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r) as bigint)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt")
    best = lowest.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
