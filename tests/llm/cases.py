"""Small tables with the awkward cases, and brute-force forms of the operators."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, words: int = 60) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def messy(spark, extra: bool = True):
    """Documents with nulls, empty and very long texts, ties, copies, near copies, repeated rows, and clashing columns."""
    rng = random.Random(3)
    base, shared = prose(rng, 200, 5000), prose(rng, 60, 5000)
    near = base.split()
    near[100] = "other"
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, " ".join(near), "en", "b", 2), (4, None, None, None, None), (5, "", "en", "a", 0),
        (6, " \t\n ", "en", None, 4), (7, "one", "en", "a", 3), (8, "two words", "en", "b", 9), (9, prose(rng, 40) + " " + shared, "en", "c", 9),
        (10, shared + "\n\n" + prose(rng, 30, 5000), "fr", "c", 9), (11, "x " * 120, "en", "a", 9), (12, prose(rng, 30_000, 9000), "en", "a", 9),
        (None, prose(rng, 80), "en", "a", 9), (None, base, "en", "a", 9), (13, "same row here", "en", "a", 5), (13, "same row here", "en", "a", 5),
        (14, "Ünïcode 🙂 tëxt\vwith\fodd spaces\r\n" * 12, "de", "d", 8), (1, prose(rng, 50, 400), "en", "a", 8),
    ]
    if not extra:
        return spark.createDataFrame(rows, DDL)
    clash = ("fp", "h", "n", "rid", "key", "shard", "y", "score", "hits", "toxicity", "leaks", "component_id", "word", "pair", "ref", "host")
    return spark.createDataFrame([(*r, *range(len(clash))) for r in rows], DDL + "".join(f", {c} long" for c in clash))


def empty(spark):
    return spark.createDataFrame([], DDL)
