"""URL filters: lists of hosts and paths, and a character model of what the lists accept and reject.

A rule is a host and the beginning of a path; it fits the host and its subdomains, and the longest that fits decides. URLs
that rules decide are the examples of two Markov models of bytes, one of accepted and one of rejected URLs. A model's order
varies: contexts of up to ORDER bytes that occur `least` times or more are kept, and a
byte's chance is interpolated (Witten and Bell) from the longest kept context down to the uniform chance. Other URLs go by the
difference of both log-likelihoods a byte, against a threshold that is calibrated on a part of the examples, which the models do not see.

Counts are over all examples: summed by task, then by n-gram. A model's CONTEXTS most frequent contexts are broadcast; with each it has
those that end it, which are as frequent and come first. So a byte's chance is begun from these. Where a model has more contexts, the rest is
looked up by joins, once for each distinct window that needs it, and the CONTEXTS most frequent of such windows are broadcast as well.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import has_columns, map_columns
from ._workspace import Workspace

ORDER, LEAST, CONTEXTS = 4, 2, 16_384
#: One in HELD examples calibrates; differences are told apart by 1 / GRID, up to EDGE of these.
HELD, GRID, EDGE = 5, 100, 1000
#: Symbols besides bytes, of which a key holds nine bits each, below the number of the context's symbols.
_END, _START, _BITS, _LEVEL = 256, 257, 9, 50
_PLACE = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
PARSED = "page_id long, host string, path string, rule string, ruling string, held boolean"


def place(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without `://`."""
    before, mark, rest = (url or "").partition("://")
    host, path = _PLACE.match(rest).groups()
    return host.translate(_LOWER), path


class Rules:
    """Rules by host: `rules` maps 'host/path' to its verdict. Rules of equal length fit in the order of their text."""

    def __init__(self, rules: dict[str, str]):
        self.of: dict[str, list[tuple[str, str, str]]] = {}
        for rule in sorted(rules, key=lambda x: (-len(x), x)):
            host, slash, path = rule.partition("/")
            self.of.setdefault(host, []).append((slash + path, rule, rules[rule]))

    def fitting(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its verdict."""
        found, at = [], 0
        while True:
            found += [(-len(rule), rule, verdict) for start, rule, verdict in self.of.get(host[at:], ()) if path.startswith(start)]
            at = host.find(".", at) + 1
            if not at:
                return min(found)[1:] if found else (None, None)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A key for each symbol of the texts, their ends included, with the ORDER symbols before it; and the texts' numbers of symbols."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    flat = np.full(int(sizes.sum()) + ORDER * len(texts), _START, np.int64)
    first = np.cumsum(sizes + ORDER) - sizes
    at = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    flat[at] = np.frombuffer(b"".join(x + b"\0" for x in texts), np.uint8)
    flat[first + sizes - 1] = _END
    key = flat[at]
    for back in range(1, ORDER + 1):
        key |= flat[at - back] << (_BITS * back)
    return key, sizes


def _shorter(key: np.ndarray, order: int) -> np.ndarray:
    """The key with `order` symbols before its own."""
    return (key & ((1 << (_BITS * (order + 1))) - 1)) | (order << _LEVEL)


def _context(gram: np.ndarray) -> np.ndarray:
    level = gram >> _LEVEL
    return ((gram & ((1 << _LEVEL) - 1)) >> _BITS) | (level << _LEVEL)


class Markov:
    """Counts of kept contexts and of what followed them, as sorted arrays."""

    def __init__(self, contexts: np.ndarray, n: np.ndarray, kinds: np.ndarray, grams: np.ndarray, times: np.ndarray):
        by, of = np.argsort(contexts), np.argsort(grams)
        self.contexts, self.n, self.kinds, self.grams, self.times = contexts[by], n[by], kinds[by], grams[of], times[of]

    def begun(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chance of each window's last symbol after those before it, and the order from which on no context is here."""
        p, depth = np.full(len(key), 1 / 257), np.zeros(len(key), np.int64)
        for order in range(ORDER + 1):
            gram = _shorter(key, order)
            n, kinds, times = self._of(self.contexts, _context(gram), self.n), self._of(self.contexts, _context(gram), self.kinds), self._of(self.grams, gram, self.times)
            p = np.where(n > 0, (times + kinds * p) / np.maximum(n + kinds, 1), p)
            depth[n > 0] = order + 1
        return p, depth

    @staticmethod
    def _of(known: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], 0)


def gains(texts: list[bytes], accepted: Markov, rejected: Markov) -> tuple[np.ndarray, ...]:
    """The texts' windows, their log-likelihoods as accepted ones less those as rejected ones, whether both models have their
    contexts of all orders here, and the texts' numbers of windows."""
    key, sizes = windows(texts)
    distinct, inverse = np.unique(key, return_inverse=True)
    (a, a_depth), (b, b_depth) = accepted.begun(distinct), rejected.begun(distinct)
    return key, (np.log(a) - np.log(b))[inverse], (np.minimum(a_depth, b_depth) > ORDER)[inverse], sizes


def differences(texts: list[bytes], accepted: Markov, rejected: Markov) -> np.ndarray:
    """The log-likelihood of each text as an accepted one less that as a rejected one, a symbol."""
    if not texts:
        return np.empty(0)
    _, gain, _, sizes = gains(texts, accepted, rejected)
    return np.add.reduceat(gain, np.cumsum(sizes) - sizes) / sizes


def _bin(difference: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(difference * GRID), -EDGE, EDGE).astype(np.int64)


def threshold(accepted: np.ndarray, rejected: np.ndarray) -> int:
    """The bin from which on a URL is accepted, by the numbers of accepted and rejected examples in bins -EDGE to EDGE: the one
    with the greatest sum of both classes' parts that are told right, of equals the one nearest to 0, then the lower. 0 if a
    class is empty."""
    a, b = int(accepted.sum()), int(rejected.sum())
    if not a or not b:
        return 0
    above = np.append(accepted[::-1].cumsum()[::-1], 0)
    below = np.append(0, rejected.cumsum())
    right = [int(x) * b + int(y) * a for x, y in zip(above, below)]
    return min(range(-EDGE, EDGE + 2), key=lambda t: (-right[t + EDGE], abs(t), t))


def _text(host: str, path: str) -> bytes:
    return (host + path).encode()


def held_out(text: bytes) -> bool:
    return int(hashlib.md5(text).hexdigest()[:8], 16) % HELD == 0


class UrlFilter:
    """Rules, and the models of what they accept and reject in `pages`.

    A rule's verdict is `allow` or `block`. Null URLs and those without `://` have an empty host and path, which no rule fits; very long
    ones are scored whole; repeated rows count each as examples and have one verdict. Without examples of a class its model is uniform,
    and without any at all every URL is accepted; an empty table gives an empty result. Columns besides id and url
    are not read, whatever their names.
    """

    def __init__(self, spark: SparkSession, pages: DataFrame, rules: dict[str, str], url: str = "url", id: str = "page_id", least: int = LEAST, contexts: int = CONTEXTS):
        self.ws = Workspace(spark, "urls")
        lists = spark.sparkContext.broadcast(Rules(rules))

        def start():
            known = lists.value

            def step(columns):
                out = []
                for i, x in zip(*columns):
                    host, path = place(None if x is None else x.decode())
                    out.append((i, host, path, *known.fitting(host, path), held_out(_text(host, path))))
                return list(zip(*out)) or [[]] * 6

            return step

        rows = has_columns(pages, page_id=(id, "long"), url=(url, "string"))
        self.parsed = self.ws.table(map_columns(rows, start, PARSED), "parsed")
        examples = self.parsed.where("ruling IS NOT NULL")
        counted = self._counted(examples.where("NOT held"))
        level = F.shiftright("gram", _LEVEL)
        context = F.shiftright(F.col("gram").bitwiseAND((1 << _LEVEL) - 1), _BITS).bitwiseOR(F.shiftleft(level, _LEVEL))
        self.grams = counted.select("ruling", context.alias("context"), "gram", "n")
        kept = self.grams.groupBy("ruling", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= least)
        self.kept = self.ws.table(kept, "contexts")
        self.accepted, self.rejected = (self._model(x, contexts) for x in ("allow", "block"))
        self.models, self.gains = spark.sparkContext.broadcast((self.accepted, self.rejected)), None
        if self.kept.groupBy("ruling").count().where(F.col("count") > contexts).count():
            self._look_up(contexts)
        bins = self.differences(examples.where("held"), "held").groupBy("bin", "ruling").agg(F.count("*").alias("n")).collect()  # 2 * (2 * EDGE + 1) rows at most
        sides = {x: np.zeros(2 * EDGE + 1, np.int64) for x in ("allow", "block")}
        for r in bins:
            sides[r["ruling"]][r["bin"] + EDGE] += r["n"]
        self.threshold = threshold(sides["allow"], sides["block"])

    def _counted(self, examples: DataFrame) -> DataFrame:
        """ruling, gram, n: how often each context's symbol occurs."""

        def start():
            def step(columns):
                rulings, texts = np.array(columns[0], object), [_text(h.decode(), p.decode()) for h, p in zip(*columns[1:])]
                out: list[list] = [[], [], []]
                for ruling in set(columns[0]):
                    key, _ = windows([texts[i] for i in np.flatnonzero(rulings == ruling)])
                    for order in range(ORDER + 1):
                        grams, n = np.unique(_shorter(key, order), return_counts=True)
                        out[0] += [ruling.decode()] * len(grams)
                        out[1] += grams.tolist()
                        out[2] += n.tolist()
                return out

            return step

        grams = map_columns(examples.select("ruling", "host", "path"), start, "ruling string, gram long, n long", rows=8192)
        return self.ws.table(grams.groupBy("ruling", "gram").agg(F.sum("n").alias("n")), "grams")

    def _model(self, ruling: str, contexts: int) -> Markov:
        own = F.col("ruling") == ruling
        kept = self.kept.where(own).select("context", "total", "kinds").orderBy(F.desc("total"), "context").limit(contexts)
        found = self.grams.where(own).join(F.broadcast(kept), "context").select("gram", "n").toArrow()  # 257 a context at most
        of = kept.toArrow()
        number = lambda table, name: table.column(name).to_numpy()
        return Markov(number(of, "context"), number(of, "total"), number(of, "kinds"), number(found, "gram"), number(found, "n"))

    def _look_up(self, contexts: int) -> None:
        """`gains`: key, times, gain of the distinct windows of all pages whose contexts the broadcast models have not all."""
        models = self.models

        def open_keys():
            def step(columns):
                key, _, known, _ = gains([_text(h.decode(), p.decode()) for h, p in zip(*columns)], *models.value)
                return list(np.unique(key[~known], return_counts=True))

            return step

        def begun():
            def step(columns):
                key = np.array(columns[0], np.int64)
                return [*columns, *(m.begun(key)[0] for m in models.value)]

            return step

        def asked():
            def step(columns):
                key, out = np.array(columns[0], np.int64), [[], [], [], [], []]
                for ruling, model in zip(("allow", "block"), models.value):
                    depth = model.begun(key)[1]
                    for order in range(ORDER + 1):
                        k = key[depth <= order]
                        gram = _shorter(k, order)
                        for held, x in zip(out, (k.tolist(), [ruling] * len(k), [order] * len(k), _context(gram).tolist(), gram.tolist())):
                            held += x
                return out

            return step

        keys = map_columns(self.parsed.select("host", "path"), open_keys, "key long, times long", rows=8192)
        keys = self.ws.table(keys.groupBy("key").agg(F.sum("times").alias("times")), "keys")
        asks = map_columns(keys.select("key"), asked, "key long, ruling string, level int, context long, gram long", rows=8192)
        met = asks.join(self.kept, ["ruling", "context"]).join(self.grams.select("ruling", "gram", "n"), ["ruling", "gram"], "left")
        met = met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ruling", "level", "total", "kinds", F.coalesce("n", F.lit(0)).alias("n")))).alias("met"))  # 2 * (ORDER + 1) a key at most
        out = map_columns(keys, begun, "key long, times long, allow double, block double", rows=8192).join(met, "key", "left")
        further = lambda p, x: (x["n"] + x["kinds"] * p) / (x["total"] + x["kinds"])
        chance = lambda side: F.coalesce(F.aggregate(F.filter("met", lambda x: x["ruling"] == side), F.col(side), further), F.col(side))
        self.gains = self.ws.table(out.select("key", "times", (F.log(chance("allow")) - F.log(chance("block"))).alias("gain")), "gains")
        often = self.gains.orderBy(F.desc("times"), "key").limit(contexts).orderBy("key").toArrow()
        self.often = self.ws.spark.sparkContext.broadcast((often.column("key").to_numpy(), often.column("gain").to_numpy()))

    def _joined(self, parsed: DataFrame, name: str) -> DataFrame:
        """As `differences`, where windows are looked up in `gains`."""
        models, often, fields = self.models, self.often, [f"{f.name} {f.dataType.simpleString()}" for f in parsed.schema]

        def start():
            keys, values = often.value

            def step(columns):
                key, gain, known, sizes = gains([_text(h.decode(), p.decode()) for h, p in zip(columns[1], columns[2])], *models.value)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                here = ~known & (keys[at] == key)
                gain = np.where(here, values[at], np.where(known, gain, 0.0))
                first = np.cumsum(sizes) - sizes
                far = np.flatnonzero(~known & ~here)
                cut = np.searchsorted(far, np.append(first, sizes.sum()))
                rest = key[far]
                plain = [[x.decode() if isinstance(x, bytes) else x for x in c] for c in columns]
                return [*plain, np.add.reduceat(gain, first), sizes, [rest[a:b] for a, b in zip(cut, cut[1:])]]

            return step

        rows = map_columns(parsed, start, ", ".join([*fields, "sum_here double", "symbols long", "far array<long>"]), rows=8192)
        rows = self.ws.table(rows.withColumn("row", F.monotonically_increasing_id()), name)
        each = rows.select("row", F.posexplode("far").alias("at", "key")).join(self.gains.select("key", "gain"), "key")
        met = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "gain"))).alias("met"))
        far = rows.where(F.size("far") > 0).join(met, "row").withColumn("sum_here", F.aggregate("met", F.col("sum_here"), lambda s, x: s + x["gain"])).drop("met")
        out = rows.where(F.size("far") == 0).unionByName(far).withColumn("difference", F.col("sum_here") / F.col("symbols"))
        bin_ = F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.floor(F.col("difference") * GRID))).cast("long")
        return out.select(*parsed.columns, "difference", bin_.alias("bin"))

    def differences(self, parsed: DataFrame, name: str = "rows") -> DataFrame:
        """`parsed` with `difference` (log-likelihoods a symbol), and its `bin`."""
        if self.gains is not None:
            return self._joined(parsed, name)
        models, names = self.models, [f"{f.name} {f.dataType.simpleString()}" for f in parsed.schema]

        def start():
            def step(columns):
                d = differences([_text(h.decode(), p.decode()) for h, p in zip(columns[1], columns[2])], *models.value)
                plain = [[x.decode() if isinstance(x, bytes) else x for x in c] for c in columns]
                return [*plain, d.tolist(), _bin(d).tolist()]

            return step

        return map_columns(parsed, start, ", ".join([*names, "difference double", "bin long"]), rows=8192)

    def judged(self) -> DataFrame:
        """page_id, host, path, rule, difference, verdict: one row a row of pages."""
        own = F.when(F.col("bin") >= self.threshold, "allow").otherwise("block")
        return self.differences(self.parsed).select("page_id", "host", "path", "rule", "difference", F.coalesce("ruling", own).alias("verdict"))
