"""Greedy decoding as expressions: a text's own transitions as the model, with repeated pairs blocked."""

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "<s>", "</s>"


def _names(words: Column) -> Column:
    """What may come next, in the order in which ties are decided: both marks, then the words as they first occur."""
    return F.concat(F.array(F.lit(START), F.lit(END)), F.array_distinct(words))


def greedy(words: Column, longest: int) -> Column:
    """Tokens from START on, each the one that most often follows the last one in `words` (an array); of equals the first.

    No pair of neighbours comes twice; a row whose continuations are all blocked ends. At most `longest` tokens, without the marks."""
    pairs = F.transform(F.arrays_zip(F.concat(F.array(F.lit(START)), words).alias("a"), F.concat(words, F.array(F.lit(END))).alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    seen = F.struct(_names(words).alias("names"), pairs.alias("pairs"))  # made once a row

    def step(state, _):
        last = F.element_at(state["out"], -1)
        used = F.transform(F.filter(state["used"], lambda p: p["a"] == last), lambda p: p["b"])
        free = F.filter(state["of"]["names"], lambda n: ~F.array_contains(used, n))
        after = F.transform(F.filter(state["of"]["pairs"], lambda p: p["a"] == last), lambda p: p["b"])
        times = lambda n: F.size(F.filter(after, lambda x: x == n))
        best = F.array_max(F.transform(free, lambda n, i: F.struct(times(n).alias("times"), (-i).alias("first"), n.alias("n"))))["n"]
        token = F.coalesce(best, F.lit(END))
        moved = F.struct(state["of"].alias("of"), F.concat(state["out"], F.array(token)).alias("out"), F.concat(state["used"], F.array(F.struct(last.alias("a"), token.alias("b")))).alias("used"))
        return F.when(last == END, state).otherwise(moved)

    none = F.array().cast("array<struct<a: string, b: string>>")
    start = F.struct(seen.alias("of"), F.array(F.lit(START)).alias("out"), none.alias("used"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(longest)), start, step, lambda s: s["out"])
    return F.filter(out, lambda x: ~x.isin(START, END))
