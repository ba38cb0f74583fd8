import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import collocations, lexical, queries, urls

from .cases import empty, messy

DOCS = "doc_id long, text string, lang string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# collocations ----------------------------------------------------------------------------------------------------------
def brute_collocations(rows, least, top, cover=80, longest=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        often = {p: a for p, a in counts.items() if a >= least}
        covered = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered[p[i : i + k]], a)
        for p, a in often.items():
            if len(p) > 1 and not (p in covered and 100 * covered[p] >= cover * a):
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows(seed=5, texts=120):
    rng = random.Random(seed)
    words = [*(f"w{i}" for i in range(12)), "Ü", "İx", "A", "a", "日本"]
    ends = [".", ",", ";", ":", "!", "?", "\n", "\r\n", "\v", "\f", " ", "\t ", "  "]
    rows = []
    for _ in range(texts):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", rng.choice(ends)]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    copied = "Once upon a time there was a copied line, of words that stand together. " * 3
    return rows + [(copied, "en")] * 40 + [(None, "en"), ("", "en"), ("\n\n . ", "de"), ("solo", "fr"), ("x y " * 4000, "en")]


@pytest.mark.parametrize("options", [{}, {"bits": 8, "chunk": 200, "hot": 3, "salts": 2}, {"bits": 20, "hot": 0, "salts": 1, "memory": "64MB"}])
def test_collocations_match_brute_force(spark, options):
    rows = phrase_rows()
    frame = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], DOCS).repartition(5)
    for name in ("phrase", "f", "h", "m", "piece", "n", "rank", "part", "cut"):
        frame = frame.withColumn(name, F.lit(0))
    for least, top in ((5, 2000), (2, 7)):
        got = sorted(map(tuple, collocations.collocations(spark, frame, least=least, top=top, **options).collect()))
        assert got == brute_collocations(rows, least, top) and got


def test_shorter_and_longer_phrases(spark):
    rows = phrase_rows(9, 40)
    frame = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], DOCS)
    for longest in (2, 3):
        got = collocations.collocations(spark, frame, least=4, longest=longest).collect()
        assert sorted(map(tuple, got)) == brute_collocations(rows, 4, 2000, longest=longest)


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts whose product with the factor passes 64 bits are scored exactly."""
    big = 7_000_000_000_000_003
    levels = [spark.createDataFrame(x, "lang string, phrase string, f long") for x in ([("en", "a", big), ("en", "b", big + 10**12)], [("en", "a b", big - 5)])]
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a, **k: (levels, spark.createDataFrame([("en", 3 * big)], "lang string, n long")))
    row = collocations.collocations(spark, messy(spark), longest=2).first()
    assert row.score == 2000000 * (big - 5) // (2 * big + 10**12) and row.a == big - 5 and row.n == 3 * big


def test_collocations_of_awkward_and_empty_tables(spark):
    rows = [(r.text, r.lang) for r in messy(spark).collect()]
    got = collocations.collocations(spark, messy(spark), least=2).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 2, 2000)
    assert collocations.collocations(spark, empty(spark)).collect() == []


# search ----------------------------------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top=20):
    terms = [TERM.findall(lowered(t)) for _, t in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for w, c in df.items()}
    out = []
    for item, text in items:
        asked, found = TERM.findall(lowered(text)), []
        for (doc, _), t in zip(docs, terms):
            if t:
                tf, m = Counter(t), 100 - 25 + 25 * len(t) * n // total
                score = sum(weight[w] * (1000000000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in asked if w in tf)
                if score > 0:
                    found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def search_tables():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "The", "of", "Ünï", "日本", "x1", "İ", *(f"t{rng.randrange(90)}" for _ in range(9))])
    text = lambda n: "".join(word() + rng.choice([" ", "-", "'", "\n", "_", "\x00", "  "]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 200]))) for i in range(300)]
    docs += [(1000 + i, docs[7][1] + " same copy") for i in range(60)] + [(5, docs[5][1]), (None, "t1 t2 t3 lone"), (None, None), (400, "- - -"), (401, text(20_000))]
    items = [(i, text(rng.choice([1, 3, 12, 40]))) for i in range(25)] + [(99, None), (98, " -- "), (97, "unheard"), (96, "same copy copy"), (None, "lone"), (3, "lone t1")]
    return docs, items


@pytest.mark.parametrize("docs_a_block", [4096, 7])
def test_search_matches_brute_force(spark, docs_a_block):
    docs, items = search_tables()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for name in ("term", "block", "ids", "score", "item_id", "rank"):
        frame = frame.withColumn(name, F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).repartition(2)
    index = lexical.LexicalIndex(spark, frame, docs=docs_a_block, size=50_000)
    for top, block in ((20, 512), (3, 4)):
        got = index.search(asked, top=top, block=block).collect()
        assert sorted(map(tuple, got), key=repr) == brute_search(docs, items, top)
    index.drop()


def test_bounds_hold(spark):
    """The bytes bound the exact shares from both sides, for all lengths and numbers of occurrences."""
    rng = np.random.default_rng(2)
    tf = np.unique(np.concatenate((np.arange(1, 300), rng.integers(1, 10**7, 2000))))
    for m in (75, 76, 100, 431, 10_000, 10**7, 10**9):
        exact = lexical.shares(tf, np.int64(m))
        impact = -(-exact // lexical.STEP)
        assert impact.max() <= 255 and (impact * lexical.STEP >= exact).all() and ((np.maximum(impact - 1, 0)) * lexical.STEP <= exact).all()


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    assert lexical.searched(spark, empty(spark), items).collect() == []
    assert lexical.searched(spark, docs, items.limit(0)).collect() == []
    assert lexical.searched(spark, spark.createDataFrame([(1, None), (2, "--")], "doc_id long, text string"), items).collect() == []
    assert [tuple(r)[:3] for r in lexical.searched(spark, docs, items).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]


# urls ------------------------------------------------------------------------------------------------------------------
def brute_models(pages, rules):
    """Verdicts by dictionaries of contexts, one symbol at a time."""
    rows = []
    for i, url in pages:
        m = re.match(r"([^/?#]*)([^?#]*)", (url or "").partition("://")[2], re.DOTALL)
        host, path = lowered(m[1]), m[2]
        fits = [(-len(r), r) for r in rules if (h := r.partition("/"))[0] == host or host.endswith("." + h[0]) if path.startswith(h[1] + h[2])]
        rule = min(fits)[1] if fits else None
        rows.append((i, host, path, rule, rules.get(rule)))
    symbols = lambda host, path: [257] * 4 + list((host + path).encode()) + [256]
    counts = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    for _, host, path, _, ruling in rows:
        if ruling and not urls.held_out((host + path).encode()):
            s = symbols(host, path)
            for j in range(4, len(s)):
                for k in range(5):
                    counts[ruling][tuple(s[j - k : j])][s[j]] += 1

    def score(host, path):
        s, total = symbols(host, path), 0.0
        for j in range(4, len(s)):
            for side, sign in (("allow", 1), ("block", -1)):
                p = 1 / 257
                for k in range(5):
                    c = counts[side].get(tuple(s[j - k : j]))
                    if c and sum(c.values()) >= 2:
                        p = (c[s[j]] + len(c) * p) / (sum(c.values()) + len(c))
                total += sign * math.log(p)
        return max(-1000, min(1000, math.floor(total / (len(s) - 4) * 100)))

    scored = [(*r, score(r[1], r[2])) for r in rows]
    held = [(b, ruling) for _, host, path, _, ruling, b in scored if ruling and urls.held_out((host + path).encode())]
    a, b = (sum(x == side for _, x in held) for side in ("allow", "block"))
    told = lambda t: sum(x == "allow" and y >= t for y, x in held) * b + sum(x == "block" and y < t for y, x in held) * a
    t = min(range(-1000, 1002), key=lambda t: (-told(t), abs(t), t)) if a and b else 0
    return sorted(((i, host, path, rule, ruling or ("allow" if b >= t else "block")) for i, host, path, rule, ruling, b in scored), key=repr)


def url_rows():
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("abcde-") for _ in range(rng.randrange(1, 8)))
    rows = []
    for i in range(260):
        host = ".".join(name() for _ in range(rng.randrange(1, 3))) + rng.choice([".example.net", ".example.com", ".x.org", ".NET", ".fr", ""])
        path = rng.choice(["", "/", "/en/", "/de/", "/fr/", "/en", "/EN/"]) + rng.choice(["", name(), f"{rng.randrange(99)}.html", "ü/日本"])
        rows.append((i, f"{rng.choice(['http', 'https'])}://{host}{path}{rng.choice(['', '?q=1/2#x', '#top', '?'])}"))
    odd = [(900, None), (901, ""), (902, "no scheme/net/"), (903, "://"), (904, "http://net"), (905, "http://net/"), (906, "HTTP://A.Example.NET/en/X"), (907, "x://anet/"), (908, "http://example.com/de/?u=://org/fr/"), (909, "a\n://b\nc.net/\n?"), (910, "http://org/fr/" + "long" * 20_000), (None, "http://q.org/fr/1"), (3, rows[3][1]), (3, rows[3][1])]
    return rows + odd


def test_urls_match_brute_force(spark):
    rows = url_rows()
    frame = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    for x in ("host", "path", "rule", "ruling", "gram", "n", "bin", "difference"):
        frame = frame.withColumn(x, F.lit(1))
    for rules in (queries.URL_RULES, {"net/": "block"}, {"net/": "allow"}, {}):
        got = urls.UrlFilter(spark, frame, rules).judged().drop("difference")
        assert sorted(map(tuple, got.collect()), key=repr) == brute_models(rows, rules)


def test_longest_rule_wins():
    rules = urls.Rules(queries.URL_RULES)
    assert rules.fitting("a.example.net", "/en/x") == ("example.net/en/", "allow") and rules.fitting("a.example.net", "/enx") == ("net/", "block")
    assert rules.fitting("net", "") == (None, None) and rules.fitting("xnet", "/") == (None, None) and rules.fitting("b.org", "/fr/") == ("org/fr/", "allow")


def test_fewer_contexts_still_tell_classes(spark):
    rng = random.Random(3)
    made = lambda letters, end: f"http://{''.join(rng.choice(letters) for _ in range(12))}.{end}"
    rows = [(i, made("abcdef", "org/fr/" if i % 3 else "com/")) if i % 2 else (i, made("uvwxyz", "net/" if i % 3 else "com/")) for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for contexts in (urls.CONTEXTS, 20):
        got = urls.UrlFilter(spark, pages, queries.URL_RULES, contexts=contexts).judged().where("rule IS NULL").collect()
        right = [(r.verdict == "allow") == bool(r.page_id % 2) for r in got]
        assert len(right) == 300 and sum(right) > 285


def test_urls_of_an_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.UrlFilter(spark, none, queries.URL_RULES).judged().collect() == []
