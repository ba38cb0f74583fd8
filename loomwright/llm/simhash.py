"""SimHash near-duplicate detection by multi-index hashing.

A document's fingerprint has a bit set where over half of its 3-word shingles' XXH64 have it. Two fingerprints link at
two differing bits or fewer. By pigeonhole over two 32-bit segments, a link has either at most one differing bit in the
high segment, or none in the low one. So each fingerprint looks up the ball of radius one around its high segment and its
exact low segment in tables of segments, and every match is verified on all 64 bits. A ball's keys are enumerated from
the fingerprint that has the differing bit set only, which finds each link once.

A segment that very many distinct fingerprints share would give all pairs of them. Beyond `bucket_limit` the lookup
enumerates instead what is left of the ball in the other segment and matches whole fingerprints, of which each exists
once: at most 529 exact lookups a fingerprint and key, whatever the bucket's size. No case is dropped.
"""

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import similar
from ._components import components
from ._text import map_columns, row_key, small, unused
from ._workspace import Workspace

BITS = 2
CHUNK = 50_000


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxhash.xxh64_intdigest(line[s:e], 42) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """rid, doc_id, fp (the fingerprint as a signed long): one row a row of documents. Null text: no words, fp 0."""

    def start():
        def step(columns):
            rids, ids, texts = columns
            return [rids, ids, np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)]

        return step

    rows = documents.select(row_key(id, text).alias("rid"), F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return map_columns(rows, start, "rid binary, doc_id long, fp long")


def _ball(value: str, width: int, radius: int) -> str:
    """SQL for the array of all values that differ from `value` in up to `radius` of the low `width` bits."""
    one = f"transform(sequence(0, {width - 1}), i -> {value} ^ shiftleft(1L, i))"
    two = f"flatten(transform(sequence(1, {width - 1}), i -> transform(sequence(0, i - 1), j -> {value} ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
    return f"concat({', '.join([f'array({value})', one, two][: radius + 1])})"


def links(classes: DataFrame, ws: Workspace, bucket_limit: int = 512) -> DataFrame:
    """u, v: all pairs of distinct fingerprints at one or two differing bits. `classes` has distinct `fp`, at rest."""
    fps = classes.select("fp", F.expr("shiftrightunsigned(fp, 32)").alias("hi"), F.expr("fp & 4294967295L").alias("lo"))
    store = fps.select("fp", F.explode(F.array("hi", F.expr("lo + 4294967296L"))).alias("key"))
    probes = fps.select(
        F.col("fp").alias("p"),
        F.explode(F.expr("concat(array(struct(hi as key, 0 as cleared), struct(lo + 4294967296L as key, 2 as cleared)), transform(filter(sequence(0, 31), i -> (hi & shiftleft(1L, i)) <> 0), i -> struct(hi ^ shiftleft(1L, i) as key, 1 as cleared)))")).alias("x"),
    ).select("p", "x.key", "x.cleared")
    sizes = store.groupBy("key").agg(F.count("*").alias("n"))
    hot = ws.table(sizes.where(F.col("n") > bucket_limit).select("key"), "hot")
    busy = hot.take(1) != []
    light = probes.join(hot, "key", "left_anti") if busy else probes
    apart = F.expr("bit_count(p ^ fp)")
    once = (F.col("cleared") == 1) | (F.col("p") < F.col("fp"))
    near = light.join(store, "key").where(once & apart.between(1, BITS))
    # what the three kinds of keys leave open: beside an exact high segment, two bits below; beside one cleared bit, one bit; beside an exact low segment, two bits above
    near = near.where((F.col("cleared") != 2) | F.expr("bit_count(shiftrightunsigned(p ^ fp, 32)) = 2")).select(F.col("p").alias("u"), F.col("fp").alias("v"))
    if not busy:
        return near
    high = "shiftleft(key, 32)"
    low = "(p & 4294967295L)"
    whole = F.expr(
        f"CASE cleared WHEN 0 THEN transform({_ball(low, 32, 2)}, b -> {high} | b) WHEN 1 THEN transform({_ball(low, 32, 1)}, b -> {high} | b)"
        f" ELSE transform(filter({_ball('shiftrightunsigned(p, 32)', 32, 2)}, a -> bit_count(a ^ shiftrightunsigned(p, 32)) = 2), a -> shiftleft(a, 32) | (key & 4294967295L)) END"
    )
    exact = probes.join(hot, "key", "left_semi").select("p", "cleared", F.explode(whole).alias("fp")).join(fps.select("fp"), "fp")
    return near.unionByName(exact.where(once & apart.between(1, BITS)).select(F.col("p").alias("u"), F.col("fp").alias("v")))


def _classes(marked: DataFrame, ws: Workspace, bucket_limit: int) -> DataFrame:
    """fp, component_id, keep (the key of the row that stays) of every fingerprint in `marked`."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "rid")).alias("least")
    classes = ws.table(marked.groupBy("fp").agg(least), "classes")
    roots = components(ws.table(links(classes, ws, bucket_limit), "links"), ws)
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    keep = named.groupBy("root").agg(F.min("least").alias("keep"))
    out = ws.table(named.join(keep, "root").select("fp", F.col("keep.doc_id").alias("component_id"), F.col("keep.rid").alias("keep")), "components")
    ws.drop("classes", "links", "hot", "stars")
    return out


def near_duplicates(spark: SparkSession, documents: DataFrame, text: str = "text", id: str = "doc_id", bucket_limit: int = 512) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links).

    One row a row of documents. Null or empty text has fingerprint zero and links like any other; a very long text is
    counted in chunks; repeated rows share a class; a null doc_id is a component's id only if all its ids are null; an
    empty table gives an empty result. Columns besides id and text are not read, whatever their names.
    """
    ws = Workspace(spark, "simhash")
    marked = ws.table(fingerprints(documents, text, id), "fingerprints")
    return marked.join(_classes(marked, ws, bucket_limit), "fp").select("doc_id", "fp", "component_id")


def deduplicated(spark: SparkSession, documents: DataFrame, text: str = "text", id: str = "doc_id", bucket_limit: int = 512, similar_by: int | None = None) -> DataFrame:
    """`documents` with one row of each component: that of the smallest doc_id (null ids last; of repeated ids in one
    component, the smallest fingerprint and key; of rows equal in id and text, the first in the order of their JSON).

    With `similar_by`, texts link instead where their shingles of so many words have a Jaccard similarity of 0.8 or more:
    multi-index hashing finds most such links, and `similar` those that lie beyond its radius.

    Null and empty texts are copies of one another. All columns stay as they are, whatever their names; an empty table
    gives an empty result. Texts are not shuffled unless very many rows go (`small`).
    """
    ws = Workspace(spark, "simhash")
    if similar_by:
        marked = similar.sets(spark, documents, text, id, ws, similar_by)
        kept = similar.Similar(documents, text, id, marked, ws, lambda classes: links(classes, ws, bucket_limit), similar_by).kept()
    else:
        marked = ws.table(fingerprints(documents, text, id), "fingerprints")
        kept = _classes(marked, ws, bucket_limit)
    keep = kept.select(F.col("keep").alias("rid")).distinct().withColumn("keeps", F.lit(True))
    told = marked.groupBy("rid").agg(F.count("*").alias("n")).join(keep, "rid", "left")
    told = ws.table(told.where("keeps IS NULL OR n > 1").select("rid", F.coalesce("keeps", F.lit(False)).alias("keeps")), "told")
    ws.keep("told")
    key = unused(documents, "rid")
    whole = documents.withColumn(key, row_key(id, text))
    rest = whole.join(small(told.select(F.col("rid").alias(key))), key, "left_anti").select(documents.columns)
    several = told.where("keeps").select(F.col("rid").alias(key))
    if not several.take(1):
        return rest
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    one = whole.join(small(several), key, "left_semi").groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return rest.unionByName(one.select("row.*"))
