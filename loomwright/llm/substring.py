"""Exact substring deduplication with a log-structured fingerprint index.

A window is `window` consecutive words. Of a window's runs of `GRAM` words, the one with the least hash stands for it
(the first of equals): it depends on the window's words alone, so equal windows are found under one fingerprint, while
neighbouring windows mostly share it, and only about one word in thirteen gives an index entry.

The index is a log of sorted immutable runs of (fingerprint, count), bucketed by fingerprint and sorted in each bucket. Each
batch of documents becomes a run, which is merge-joined with the runs of history: a fingerprint that history has, or that
the batch has twice, makes its windows candidates; one that history had just once makes the older document's windows
candidates too. Then runs are compacted by merge joins, a run with those before it that are not much longer, so that a long
history is not rewritten for a short batch. As all runs have equal buckets, none of these joins deals the history out again.

Candidates are verified: a 128-bit digest of each candidate window's own words must occur twice. Digests of fingerprints
that very many texts have are counted by a pre-aggregation; all others meet their occurrences in their hash partition.

Exact copies of a whole text within a batch are settled by one digest of the text and only one of each group is indexed, so
that large groups of copies cost no windows. Rows are told apart by a digest of doc_id and text; rows that are equal in both
are copies of each other.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._text import among, gram_hashes, map_columns, row_key, small, unused, word_hashes
from ._workspace import Workspace, partitions

WINDOW, GRAM, BATCHES = 35, 10, 2
#: Fingerprints that more than one in so many entries has are frequent: there are fewer than that many of them.
FREQUENT = 65_536
_SLICE = 200_000


def fingerprints(words: list[bytes], window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the words, in order: its fingerprint, and the position of the run of words that it comes from."""
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = min(gram, window)
    grams, wide = gram_hashes(word_hashes(words), gram), window - gram + 1
    least = [np.lib.stride_tricks.sliding_window_view(grams[at : at + _SLICE + wide - 1], wide).argmin(axis=1) for at in range(0, len(grams) - wide + 1, _SLICE)]
    at = np.concatenate(least) + np.arange(len(grams) - wide + 1)
    return grams[at], at


class FingerprintIndex:
    """Sorted runs of (h, n): fingerprints and how often each occurs, bucketed alike so that merge joins need no exchange."""

    def __init__(self, ws: Workspace, name: str = "index"):
        self.ws, self.name, self.buckets = ws, f"{name}_{ws.root[-12:]}", partitions(ws.spark)
        self.runs: list[tuple[str, int]] = []  # table and its number of entries, oldest first
        self.made = 0

    def _write(self, frame: DataFrame) -> str:
        """`frame` must be dealt by h over `buckets` partitions, so that each bucket becomes one sorted file."""
        self.made += 1
        run = f"{self.name}_{self.made}"
        writer = frame.sortWithinPartitions("h").write.bucketBy(self.buckets, "h").sortBy("h")
        writer.option("path", self.ws.path(run)).option("compression", "zstd").mode("overwrite").saveAsTable(run)
        return run

    def _drop(self, run: str) -> None:
        self.ws.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.ws.drop(run)

    def drop(self) -> None:
        for run, _ in self.runs:
            self._drop(run)
        self.runs = []

    def add(self, entries: DataFrame) -> DataFrame:
        """Appends one batch's fingerprints (column h, repeats included) as a run. Returns h, late: those that history has
        or that the batch has twice; late if a run of history has it once. Read it before the next `compact`. Fingerprints are numbers
        without nulls; a batch without any becomes an empty run."""
        counted = entries.groupBy("h").agg(F.count("*").alias("n"))
        run = self._write(counted.repartition(self.buckets, "h"))
        out = self.ws.spark.table(run).select("h", "n", F.lit(False).alias("known"), F.lit(False).alias("late"))
        for old, _ in self.runs:
            history = self.ws.spark.table(old).select("h", F.col("n").alias("m"))
            met = out.hint("merge").join(history, "h", "left")
            out = met.select("h", "n", (F.col("known") | F.col("m").isNotNull()).alias("known"), (F.col("late") | F.coalesce(F.col("m") == 1, F.lit(False))).alias("late"))
        self.runs.append((run, self.ws.spark.table(run).agg(F.sum("n")).first()[0] or 0))
        return out.where("known OR n > 1").select("h", "late")

    @staticmethod
    def _often(entries: int) -> int:
        return max(64, entries // FREQUENT)

    def often(self) -> DataFrame:
        """h: what the last run has more than one in FREQUENT of its entries under (and 64 at least); `add` has returned all of them."""
        run, n = self.runs[-1]
        return self.ws.spark.table(run).where(F.col("n") > self._often(n)).select("h")

    def compact(self, times: int = 2) -> None:
        """Merges the last run with the one before it, as long as that has at most `times` its entries."""
        while len(self.runs) > 1 and self.runs[-2][1] <= times * self.runs[-1][1]:
            (a, n), (b, m) = self.runs[-2:]
            left, right = self.ws.spark.table(a), self.ws.spark.table(b).withColumnRenamed("n", "more")
            merged = left.hint("merge").join(right, "h", "full").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
            self.runs = [*self.runs[:-2], (self._write(merged), n + m)]
            self._drop(a)
            self._drop(b)

    def frequent(self) -> np.ndarray:
        """Sorted fingerprints that a run has more than one in FREQUENT of its entries under (and 64 at least)."""
        found = [self.ws.spark.table(run).where(F.col("n") > self._often(n)).select("h").toArrow().column(0).to_numpy() for run, n in self.runs]
        return np.unique(np.concatenate([np.empty(0, np.int64), *found]))


class SubstringDedup:
    """Judges all windows of all documents that were added, in whatever batches, on the input.

    A word goes if any window over it occurs (starts) anywhere else, in the same text or another, of any batch. Null texts
    have no words; texts shorter than a window stay whole; very long texts are windowed in slices; rows that are repeated
    are copies, so all their windows repeat; an empty table gives empty results. Columns besides id and text are not read,
    whatever their names.

    `documents` are dealt into `batches` by text; `add` takes later ones. Documents stay where they are: only
    fingerprints are kept, and a text is read again if it has a candidate. The tables lie in the shared folder until `drop`.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame | None = None, text: str = "text", id: str = "doc_id", window: int = WINDOW, batches: int = BATCHES):
        self.ws, self.text, self.id, self.window = Workspace(spark, "substring"), text, id, window
        self.index = FingerprintIndex(self.ws)
        self.texts: list[DataFrame] = []
        self.seen: list[DataFrame] = []  # of each batch a table: a row a text, with its fingerprints
        self.copies: list[DataFrame] = []
        self.hits: list[DataFrame] = []
        self.entries: list[DataFrame] = []
        self._judged: tuple[DataFrame, DataFrame] | None = None
        if documents is not None:
            try:
                self._add(documents, batches)
            except BaseException:
                self.drop()  # tables of the catalog outlive a failed run
                raise

    def add(self, documents: DataFrame) -> None:
        """Takes one more batch: its fingerprints are matched with history, and become part of it."""
        self._add(documents, 1)

    def _add(self, documents: DataFrame, batches: int) -> None:
        n = len(self.texts)
        rid, text = row_key(self.id, self.text).alias("rid"), F.coalesce(F.col(f"`{self.text}`"), F.lit("")).alias("text")
        texts = documents.select(rid, F.col(f"`{self.id}`").cast("long").alias("doc_id"), text)
        seen = self._seen(texts, n)
        copies = self.ws.table(seen.groupBy("sha").agg(F.count("*").alias("copies"), F.min("rid").alias("first")).where("copies > 1"), f"copies_{n}")
        rest = seen.where(F.size("hs") > 0).join(copies, "sha", "left").where(F.col("first").isNull() | (F.col("first") == F.col("rid")))
        batch = F.pmod(F.xxhash64("sha"), F.lit(batches)).cast("int").alias("batch")
        # a text counts each of its fingerprints once, or twice if it repeats, so that none has more entries than two a text
        entries = self.ws.table(rest.select("rid", "hs", "own", batch), f"entries_{n}", by="batch")
        for i in range(batches):
            self._match(entries.where(F.col("batch") == i))
        self.texts.append(texts)
        self.seen.append(seen)
        self.copies.append(copies)
        self._judged = None

    def _match(self, entries: DataFrame) -> None:
        """Merge-joins a batch's fingerprints with history, notes the candidates, and compacts.

        Texts that have a frequent fingerprint find it in a broadcast table, of fewer than FREQUENT rows, so that only entries
        of which none is frequent are dealt by fingerprint."""
        met = self.index.add(entries.select(F.explode(F.concat("hs", "own")).alias("h")))
        probed = lambda rows, keys: rows.select(F.explode("hs").alias("h"), "rid").join(keys, "h")
        often = F.broadcast(self.index.often())
        found = self._dealt(entries, often).join(met.select("h").hint("merge"), "h").unionByName(probed(entries, often))
        if self.entries:
            older = self.entries[0]
            for x in self.entries[1:]:
                older = older.unionByName(x)
            # a short batch has few of them, so that history's entries are read, but not shuffled
            late = self.ws.table(met.where("late").select("h"), f"late_{len(self.hits)}")
            found = found.unionByName(probed(older, small(late)))
        self.hits.append(self.ws.table(found.groupBy("rid").agg(F.collect_list("h").alias("hs")), f"hits_{len(self.hits)}"))
        self.entries.append(entries)
        self.index.compact()

    @staticmethod
    def _dealt(entries: DataFrame, often: DataFrame) -> DataFrame:
        """h, rid: the entries that an exchange deals by fingerprint."""
        return entries.select(F.explode("hs").alias("h"), "rid").join(often, "h", "left_anti")

    def _seen(self, texts: DataFrame, n: int) -> DataFrame:
        window = self.window

        def start():
            def step(columns):
                rids, ids, raw = columns
                n, sha, hs, own = [], [], [], []
                for x in raw:
                    words = x.split()
                    n.append(len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).digest())
                    h, at = fingerprints(words, window)
                    places = h[np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))] if len(h) else h
                    once, times = np.unique(places.view(np.int64), return_counts=True)
                    hs.append(once)
                    own.append(once[times > 1])
                return [rids, ids, n, sha, hs, own]

            return step

        return self.ws.table(map_columns(texts, start, "rid binary, doc_id long, n_words long, sha binary, hs array<long>, own array<long>"), f"seen_{n}")

    def _judge(self) -> tuple[DataFrame, DataFrame]:
        if self._judged is None:
            union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
            hits = union(self.hits).groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs"))
            hits = self.ws.table(hits, "candidates")
            texts = union(self.texts).select("rid", "text").join(small(hits.select("rid")), "rid", "left_semi")
            held = self.ws.table(texts.join(hits, "rid"), "held")
            changed = self._verified(held)
            self._judged = self._rows(changed), changed
            self.ws.drop("held", "candidates")
        return self._judged

    @property
    def rows(self) -> DataFrame:
        """rid, doc_id, n_words, n_removed, kept_sha256, one row a row of documents."""
        return self._judge()[0]

    @property
    def changed(self) -> DataFrame:
        """rid, kept (the words that stay, joined by one space), of the rows that lose a word."""
        return self._judge()[1]

    def drop(self) -> None:
        """Frees the index and the tables of candidates; results that were asked for stay readable."""
        self.index.drop()
        self.ws.drop(*(f"{x}_{i}" for i in range(len(self.hits)) for x in ("hits", "late", "entries")))

    def _verified(self, held: DataFrame) -> DataFrame:
        window = self.window
        frequent = self.ws.spark.sparkContext.broadcast(self.index.frequent())  # FREQUENT a run at most

        def windows():
            often = frequent.value

            def step(columns):
                rids, raw, hs = columns
                out = []
                for x, h in zip(raw, hs):
                    words = x.split()
                    at = fingerprints(words, window)[0].view(np.int64)
                    hit = np.flatnonzero(np.isin(at, np.array(h, np.int64)))
                    many = among(at[hit], often)
                    line = b" ".join(words)
                    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                    first = np.concatenate(([0], end[:-1] + 1))
                    found: dict[bytes, dict] = {}
                    for at, a, b, hot in zip(hit.tolist(), first[hit].tolist(), end[hit + window - 1].tolist(), many.tolist()):
                        digest = hashlib.blake2b(line[a:b], digest_size=16).digest()
                        if (w := found.get(digest)) is None:
                            found[digest] = {"digest": digest, "start": at, "more": None, "often": hot}
                        else:
                            w["more"] = w["more"] or []
                            w["more"].append(at)
                    out.append(list(found.values()))
                return [rids, out]

            return step

        packed = self.ws.table(map_columns(held, windows, "rid binary, windows array<struct<digest: binary, start: int, more: array<int>, often: boolean>>"), "windows")
        # a row a text and distinct window, whatever often the text has it, so that a digest has no more rows than there are texts
        each = packed.select("rid", F.explode("windows").alias("w")).select("rid", "w.*")
        n = F.sum(F.when(F.col("more").isNull(), 1).otherwise(1 + F.size("more")))
        # digests' counts and occurrences meet in the digest's hash partition: one exchange for both
        rare = each.where("NOT often").withColumn("n", n.over(Window.partitionBy("digest"))).where("n > 1").select("rid", "start", "more")
        # digests that many texts may have: a table that is counted map-side, then joined
        often = self.ws.table(each.where("often"), "often")
        counted = self.ws.table(often.groupBy("digest").agg(n.alias("n")).where("n > 1").select("digest"), "counted")
        twice = rare.unionByName(often.join(small(counted), "digest").select("rid", "start", "more"))
        starts = F.concat(F.collect_list("start"), F.flatten(F.collect_list("more")))  # a text's own windows
        marks = twice.groupBy("rid").agg(starts.alias("starts"))

        def cut():
            def step(columns):
                rids, raw, starts = columns
                kept, n = [], []
                for x, at in zip(raw, starts):
                    words = x.split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge += np.bincount(np.array(at, np.int64), minlength=len(edge)) - np.bincount(np.array(at, np.int64) + window, minlength=len(edge))
                    stay = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                    n.append(len(words) - len(stay))
                    kept.append(b" ".join([words[i] for i in stay.tolist()]))
                return [rids, n, [hashlib.sha256(x).hexdigest() for x in kept], [x.decode() for x in kept]]

            return step

        done = map_columns(held.select("rid", "text").join(marks, "rid"), cut, "rid binary, n_removed long, kept_sha256 string, kept string")
        out = self.ws.table(done, f"changed_{len(self.hits)}")
        self.ws.drop("windows", "often", "counted")
        return out

    def _rows(self, changed: DataFrame) -> DataFrame:
        """The copies of a batch lose all their windows; other texts what their verified windows cover."""
        of = None
        for seen, copies in zip(self.seen, self.copies):
            part = seen.drop("hs", "own").join(copies.select("sha", "copies"), "sha", "left")
            of = part if of is None else of.unionByName(part)
        of = of.join(changed.drop("kept").dropDuplicates(["rid"]), "rid", "left")
        gone = F.col("copies").isNotNull() & (F.col("n_words") >= self.window)
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        removed = F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        sha = F.when(gone, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha"))))
        return of.select("rid", "doc_id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))

    def applied(self, documents: DataFrame, length: str | None = None) -> DataFrame:
        """`documents` with the kept words as text where words went (as it was elsewhere), and the new length in `length`.
        Only texts that lose words are shuffled, unless very many do (`small`)."""
        lost = self.rows.where("n_removed > 0").select("rid", (F.col("n_removed") == F.col("n_words")).alias("all")).dropDuplicates(["rid"])
        lost = lost.join(self.changed.select("rid", "kept").dropDuplicates(["rid"]), "rid", "left")
        key, kept = unused(documents, "rid"), unused(documents, "kept")
        lost = self.ws.table(lost.select(F.col("rid").alias(key), F.when(F.col("all"), F.lit("")).otherwise(F.col("kept")).alias(kept)), f"lost_{len(self.hits)}")
        keys = small(lost.select(key))
        whole = documents.withColumn(key, row_key(self.id, self.text))
        new = {self.text: F.col(kept)} | ({length: F.length(kept).cast(documents.schema[length].dataType)} if length else {})
        cut = whole.join(keys, key, "left_semi").join(lost, key).select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns))
        return whole.join(keys, key, "left_anti").select(documents.columns).unionByName(cut)
