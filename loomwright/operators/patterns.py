"""Many fixed strings at once: which of thousands of patterns occur in each text, and how often."""

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns that one pass over the texts looks for, and their characters: what is broadcast and held by a task.
BLOCK, CHARS = 100_000, 4_000_000


@lru_cache(maxsize=2)
def _automaton(patterns: tuple[str, ...]):
    out = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        out.add_word(p, i)
    out.make_automaton()
    return out


def _blocks(patterns: DataFrame, column: str, block: int):
    part, size = [], 0
    for (p,) in patterns.select(column).where(F.length(column) > 0).distinct().toLocalIterator():
        if part and (len(part) == block or size + len(p) > CHARS):
            yield part
            part, size = [], 0
        part.append(p)
        size += len(p)
    if part:
        yield part


def occurrences(texts: DataFrame, patterns: DataFrame, id: str, text: str = "text", pattern: str = "pattern", block: int = BLOCK) -> DataFrame:
    """id, pattern, n: how often each pattern occurs in each text that has it, overlaps included, character by character.

    Texts are read once for each block of patterns, whatever their number, by an automaton of all of them (Aho-Corasick); nothing is shuffled.
    Null texts, null and empty patterns match nothing; repeated patterns count once; repeated rows have results each.
    """
    rows = texts.select(F.col(id), F.col(text).cast("string").alias("_text")).where("_text IS NOT NULL")
    kind = rows.schema[id].dataType.simpleString()
    out = texts.sparkSession.createDataFrame([], f"`{id}` {kind}, pattern string, n long")
    for part in _blocks(patterns, pattern, block):
        shared = texts.sparkSession.sparkContext.broadcast(tuple(part))

        def run(batches, shared=shared):
            known, of = shared.value, _automaton(shared.value)
            for batch in batches:
                at, found, times = [], [], []
                for i, x in enumerate(batch.column(1).to_pylist()):
                    counts: dict[int, int] = {}
                    for _, k in of.iter(x):
                        counts[k] = counts.get(k, 0) + 1
                    at += [i] * len(counts)
                    found += [known[k] for k in counts]
                    times += counts.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(times, pa.int64())], names=[id, "pattern", "n"])

        out = out.unionByName(rows.mapInArrow(run, f"`{id}` {kind}, pattern string, n long"))
    return out
