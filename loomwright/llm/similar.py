"""Near copies for deduplication: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more, without a miss.

Three steps give a component for every distinct set; each keeps what it forms linear in the size of a group of copies.

1. SimHash: the sets' 64-bit fingerprints are matched by multi-index hashing (`simhash.links`), and sets of one fingerprint
   with the first of them.
2. Hubs: similarity 0.8 means that of sets of n and m shingles 4 (n + m) / 9 are shared. In one order of all shingles, the
   first shared one is then among the first n - ceil(0.8 n) + 1 of either set (its prefix). Each shingle that several prefixes have
   points at one hub, the set whose prefix is the most common, and its sets are matched with the hub only.
3. The rest: what lies beyond a fingerprint's radius and is similar to no hub. Prefixes are joined by shingle, but only
   sets that are not in one component yet, and a shingle whose sets are all in one is left out before the join.

Every match is verified on the whole sets. Before that, a match goes if the sets' sizes, places in the prefix, or odd
sketches (parities of which each differing one takes a shingle that one set alone has) prove that too few are shared. The
join across components compares sketches of 512 parities, the verification those of as many as a set has shingles.

Any order of shingles gives the same result. Those that are frequent in a sample come last, as they give many matches. A shingle that
the sample missed and that many sets of different components have in their prefixes (CROWD partners a set) is put last too: the
sets that have it are read again for their new prefixes, before step 3 joins anything. So what a shingle's sets give there
grows with their number, not with its square, unless they have hardly any other shingles.
"""

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._text import among, gram_hashes, has_columns, map_columns, row_key, small, word_hashes
from ._workspace import Workspace

SHINGLE = 5
#: Texts and shingles of the sample that sets the order; they do not bear on the result.
_TEXTS, _FREQUENT = 8_000, 65_535
#: Partners that a set has on average where a shingle is crowded, and shingles that come last at most (8 MB).
CROWD, LATE = 1_000, 1 << 20
_LANES = 8
_CHUNK = 50_000


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's runs of `shingle` words; a shorter text is one run, one without words has none."""
    h = word_hashes((text or b"").lower().split())
    return np.unique(gram_hashes(h, min(shingle, len(h)))) if len(h) else np.empty(0, np.uint64)


def simhash(h: np.ndarray) -> int:
    """64 bits, each set if over half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        counts += np.unpackbits(h[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def lanes_for(n: int) -> int:
    """The power of two that gives a set of n a fine sketch of n to 2 n places, _LANES at least."""
    return max(_LANES, 1 << max(0, (n - 1) // 64).bit_length())


def sketch(h: np.ndarray, lanes: int = _LANES) -> np.ndarray:
    """Parities of how many hashes fall on each of 64 * lanes places, as longs. A sketch of half the lanes is both halves' xor."""
    odd = np.bincount((h & np.uint64(64 * lanes - 1)).astype(np.int64), minlength=64 * lanes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _prefix(h: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, those of `late` after all others."""
    last = among(h, late)
    return np.concatenate((h[~last], h[last]))[: prefix_length(len(h))].view(np.int64)


def _frequent(documents: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that three or more texts of the sample have."""
    rows = documents.select("text").where("text IS NOT NULL")
    share = min(1.0, _TEXTS / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).distinct()

    def start():
        return lambda columns: [[shingles(x, shingle).view(np.int64) for x in columns[0]]]

    each = map_columns(some, start, "h array<long>").select(F.explode("h").alias("h"))
    top = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(_FREQUENT)
    return np.sort(top.select("h").toArrow().column(0).to_numpy().view(np.uint64))


def sets(spark: SparkSession, documents: DataFrame, text: str, id: str, ws: Workspace, shingle: int = SHINGLE) -> DataFrame:
    """rid, doc_id, fp (a hash of the whole set), n (its size), sim (its SimHash), sketch, fine (a longer one), prefix: one row
    a row of documents. Null, empty and blank texts have the empty set, without a prefix; null ids stay null; an empty table
    gives an empty one."""
    frequent = spark.sparkContext.broadcast(_frequent(has_columns(documents, text=(text, "string")), shingle))

    def start():
        late = frequent.value

        def step(columns):
            rids, ids, texts = columns
            fps, sizes, sims, sketches, fine, prefixes = [], [], [], [], [], []
            for x in texts:
                h = shingles(x, shingle)
                fps.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                sizes.append(len(h))
                sims.append(simhash(h))
                sketches.append(sketch(h))
                fine.append(sketch(h, lanes_for(len(h))))
                prefixes.append(_prefix(h, late))
            return [rids, ids, np.array(fps, np.uint64).view(np.int64), sizes, np.array(sims, np.uint64).view(np.int64), sketches, fine, prefixes]

        return step

    rows = documents.select(row_key(id, text).alias("rid"), F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return ws.table(map_columns(rows, start, "rid binary, doc_id long, fp long, n int, sim long, sketch array<long>, fine array<long>, prefix array<long>"), "sets")


def _apart(a: str, b: str) -> str:
    """SQL for the number of differing parities of two sketches."""
    return " + ".join(f"bit_count({a}.sketch[{i}] ^ {b}.sketch[{i}])" for i in range(_LANES))


def _apart_finely(u: str, v: str) -> str:
    """The same of two sketches of any lengths, each folded to the shorter one's."""
    lanes = f"least(size({u}), size({v}))"
    folded = lambda x: f"aggregate(sequence(i, size({x}) - 1, {lanes}), 0L, (y, j) -> y ^ {x}[j])"
    return f"aggregate(transform(sequence(0, {lanes} - 1), i -> bit_count({folded(u)} ^ {folded(v)})), 0, (a, x) -> a + x)"


class Similar:
    """Components of the distinct sets of `marked` (what `sets` gives); `linked` matches fingerprints by multi-index hashing."""

    def __init__(self, documents: DataFrame, text: str, id: str, marked: DataFrame, ws: Workspace, linked: Callable, shingle: int = SHINGLE):
        self.documents, self.text, self.id, self.ws, self.shingle = documents, text, id, ws, shingle
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
        first = (F.first(c).alias(c) for c in ("n", "sim", "sketch", "fine", "prefix"))  # equal for all rows of a set
        self.one = ws.table(marked.groupBy("fp").agg(least, F.min("rid").alias("rid"), *first), "one")
        self.reordered = 0
        self.index = self._index()
        found = ws.table(self._verified(self._by_fingerprint(linked).union(self._by_hub()).distinct(), "first"), "found")
        roots = components(found, ws, "first_roots")
        rest = ws.table(self._verified(self._across(roots), "second"), "rest")
        self.links = found.unionByName(rest)
        self.roots = components(self.links, ws, "roots") if rest.take(1) else roots

    def _index(self) -> DataFrame:
        """h, fp, n, at, c: the prefixes' shingles that c > 1 sets have in their prefixes."""
        every = self.one.select("fp", "n", F.posexplode("prefix").alias("at", "h"))
        shared = every.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
        return self.ws.table(every.join(shared, "h"), f"index_{self.reordered}")

    def _by_fingerprint(self, linked: Callable) -> DataFrame:
        """u, v: sets of one fingerprint, each with the first; and the first sets of linked fingerprints."""
        firsts = self.ws.table(self.one.groupBy(F.col("sim").alias("fp")).agg(F.min("fp").alias("u")), "fingerprints")
        same = self.one.select(F.col("fp").alias("v"), F.col("sim")).join(firsts, F.col("sim") == firsts.fp).where("u <> v").select("u", "v")
        near = linked(firsts.select("fp")).select(F.col("u").alias("s"), F.col("v").alias("t"))
        first = lambda c, out: firsts.select(F.col("fp").alias(c), F.col("u").alias(out))
        return same.union(near.join(first("s", "u"), "s").join(first("t", "v"), "t").select("u", "v"))

    def _by_hub(self) -> DataFrame:
        """u, v: each shingle's sets with its hub."""
        common = self.index.groupBy("fp").agg(F.sum("c").alias("common"))
        hub = F.max(F.struct("common", "fp", "n", "at")).alias("hub")
        hubs = self.index.join(common, "fp").groupBy("h").agg(hub)
        met = self.index.join(hubs, "h").where("fp <> hub.fp AND 9L * least(n - at, hub.n - hub.at) >= 4L * (n + hub.n)")
        return met.select(F.least("fp", "hub.fp").alias("u"), F.greatest("fp", "hub.fp").alias("v"))

    def _across(self, roots: DataFrame) -> DataFrame:
        """u, v: sets that share a shingle of their prefixes, pass the filters and are in different components."""
        late = None
        while True:
            named = self.index.join(roots, self.index.fp == roots.node, "left").select("h", "fp", "n", "at", "c", F.coalesce("root", "fp").alias("root"))
            named = self.ws.table(named, f"named_{self.reordered}")
            crowded = self._crowded(named)
            if len(crowded) and late is None:
                late = _frequent(has_columns(self.documents, text=(self.text, "string")), self.shingle)
            if not len(crowded) or among(crowded, late).all() or len(late) > LATE:
                break
            late = np.union1d(late, crowded)
            self._reorder(crowded, late)
        mixed = named.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
        rows = self.ws.table(named.join(mixed, "h").join(self.one.select("fp", "sketch"), "fp"), "mixed")
        a, b = rows.alias("a"), rows.alias("b")
        enough = f"a.h = b.h AND a.fp < b.fp AND a.root <> b.root AND 9L * least(a.n - a.at, b.n - b.at) >= 4L * (a.n + b.n) AND 9 * ({_apart('a', 'b')}) <= a.n + b.n"
        return a.join(b, F.expr(enough)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()

    @staticmethod
    def _crowded(named: DataFrame) -> np.ndarray:
        """Sorted shingles whose sets have more than CROWD partners of other components on average."""
        own = named.where(F.col("c") > CROWD).groupBy("h", "root").agg(F.count("*").cast("double").alias("n"))
        every = own.groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).where(F.col("n") * F.col("n") - F.col("own") > CROWD * F.col("n"))
        return np.sort(every.orderBy(F.desc("n"), "h").limit(_FREQUENT).select("h").toArrow().column(0).to_numpy().view(np.uint64))

    def _reorder(self, crowded: np.ndarray, late: np.ndarray) -> None:
        """New prefixes of the sets that have a crowded shingle in theirs; others' stay as they are in the new order."""
        spark, shingle, shared = self.ws.spark, self.shingle, self.ws.spark.sparkContext.broadcast(late)
        few = F.broadcast(spark.createDataFrame([(x,) for x in crowded.view(np.int64).tolist()], "h long"))
        nodes = self.index.join(few, "h").select("fp").distinct()
        self.reordered += 1
        chosen = self.ws.table(self.one.select("fp", "rid").join(nodes, "fp"), f"crowded_{self.reordered}")

        def start():
            return lambda columns: [columns[0], [_prefix(shingles(x, shingle), shared.value) for x in columns[1]]]

        texts = self.documents.select(row_key(self.id, self.text).alias("rid"), F.col(f"`{self.text}`").cast("string").alias("text"))
        texts = texts.join(small(chosen), "rid").select("fp", "text").dropDuplicates(["fp"])
        new = self.ws.table(map_columns(texts, start, "fp long, later array<long>"), f"prefixes_{self.reordered}")
        one = self.one.join(new, "fp", "left").withColumn("prefix", F.coalesce("later", "prefix")).drop("later")
        self.one = self.ws.table(one, f"one_{self.reordered}")
        self.index = self._index()

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those pairs whose whole sets are similar."""
        side = lambda c: self.one.select(F.col("fp").alias(c), F.struct("n", "fine").alias(f"of_{c}"))
        likely = pairs.join(side("u"), "u").join(side("v"), "v").where(F.expr(f"9 * {_apart_finely('of_u.fine', 'of_v.fine')} <= of_u.n + of_v.n"))
        near = self.ws.table(likely.select("u", "v"), f"{name}_pairs")
        nodes = near.select(F.col("u").alias("fp")).union(near.select(F.col("v").alias("fp"))).distinct()
        chosen = self.ws.table(self.one.select("fp", "rid").join(nodes, "fp"), f"{name}_nodes")

        def start():
            return lambda columns: [columns[0], [shingles(x, self_shingle).view(np.int64) for x in columns[1]]]

        self_shingle = self.shingle
        texts = self.documents.select(row_key(self.id, self.text).alias("rid"), F.col(f"`{self.text}`").cast("string").alias("text"))
        texts = texts.join(small(chosen), "rid").select("fp", "text").dropDuplicates(["fp"])
        whole = self.ws.table(map_columns(texts, start, "fp long, h array<long>"), f"{name}_whole")
        u, v = (whole.select(F.col("fp").alias(c), F.col("h").alias(f"h_{c}")) for c in "uv")
        shared = F.size(F.array_intersect("h_u", "h_v"))
        return near.join(u, "u").join(v, "v").where(9 * shared >= 4 * (F.size("h_u") + F.size("h_v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def kept(self) -> DataFrame:
        """fp, component_id, keep (the key of the row that stays): one row a distinct set."""
        named = self.one.join(self.roots, self.one.fp == self.roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        keep = named.groupBy("root").agg(F.min("least").alias("keep"))
        return named.join(keep, "root").select("fp", F.col("keep.doc_id").alias("component_id"), F.col("keep.rid").alias("keep"))
