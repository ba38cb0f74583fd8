"""Array functions of features and vectors, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space; none if there are fewer tokens. (sequence(1, 0) would count down.)

    `tokens` may be an expression: it is bound to a variable, else each n-gram would compute it anew."""
    if n == 1:
        return tokens
    run = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat_ws(" ", *(F.get(t, i + k) for k in range(n))))
    return F.get(F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= n, run(t)).otherwise(F.array().cast("array<string>"))), F.lit(0))


def truncated(ids: Column, longest: int, last: int) -> Column:
    """Ids cut to `longest`; only when cut, the last place holds `last`."""
    return F.when(F.size(ids) > longest, F.concat(F.slice(ids, 1, longest - 1), F.array(F.lit(last)))).otherwise(ids)


def ended(ids: Column, longest: int, last: int) -> Column:
    """Ids cut to `longest`, the last place always overwritten by `last`; empty stays empty."""
    n = F.least(F.size(ids), F.lit(longest))
    return F.when(n > 0, F.concat(F.slice(ids, F.lit(1), n - 1), F.array(F.lit(last)))).otherwise(ids)


def padded(ids: Column, size: Column | int, pad: int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(size - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, size: Column | int) -> Column:
    return padded(F.transform(ids, lambda _: F.lit(1)), size, 0)


def shifted_right(ids: Column, start: int) -> Column:
    """Teacher forcing's input: the start id, then all ids but the last."""
    return F.when(F.size(ids) > 0, F.concat(F.array(F.lit(start)), F.slice(ids, F.lit(1), F.size(ids) - 1))).otherwise(F.array(F.lit(start)))


def shifted_left(ids: Column) -> Column:
    """The labels of decoder inputs: all ids but the first."""
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalized(v: Column, least: float = 1e-12) -> Column:
    length = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x.cast("double") / length)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(normalized(a), normalized(b))


def argmax(v: Column) -> Column:
    """Position (from 0) of the first largest value."""
    return F.array_position(v, F.array_max(v)) - 1


def top_band(v: Column, first: int, last: int) -> Column:
    """Positions (from 0) of the values of rank `first` to `last` from the top; ties keep their order."""
    ranked = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, first, last - first + 1), lambda s: s["i"])


def pooled_index(ids: Column, pad: int) -> Column:
    """Where (from 0) a sequence's score is read: its last id before padding. Without padding it is the last; a sequence
    that starts with padding reads its last place, as an index of -1 does."""
    p = F.array_position(ids, F.lit(pad))
    return F.when(p == 0, F.size(ids) - 1).otherwise(F.pmod(p - 2, F.size(ids))).cast("int")
