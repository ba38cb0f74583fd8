"""Queries without SQL, held against plain Python."""

import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from loomwright.functions.porter import stem
from loomwright.plans import catalog


def test_porter_rouge(spark, sf):
    def tokens(text):
        return [stem(w) for w in re.sub(r"[!-/:-@\[-`{-~]", " ", text).lower().split()]

    got = {r.pair_id: (r.rouge1_p, r.rouge1_r, r.rouge1_f) for r in entry.queries()["porter_rouge"](spark, sf).collect()}
    pairs = catalog.article_pairs(spark, sf).collect()
    assert got.keys() == {r.pair_id for r in pairs}
    for r in pairs:
        h, ref = Counter(tokens(r.output)), Counter(tokens(r.input))
        both = sum((h & ref).values())
        p, recall = (both / n if n else 0.0 for n in (sum(h.values()), sum(ref.values())))
        f = 2 * p * recall / (p + recall) if p and recall else 0.0
        assert got[r.pair_id] == pytest.approx((p, recall, f), abs=1e-6)


def test_greedy_decoding(spark, sf):
    def decoded(words):
        names = ["<s>", "</s>", *dict.fromkeys(words)]
        follows = Counter(zip(["<s>", *words], [*words, "</s>"]))
        out, used = ["<s>"], set()
        while len(out) <= 12 and out[-1] != "</s>":
            free = [n for n in names if (out[-1], n) not in used]
            best = max(free, key=lambda n: follows[out[-1], n]) if free else "</s>"
            used.add((out[-1], best))
            out.append(best)
        return " ".join(n for n in out if n not in ("<s>", "</s>"))

    got = {r.id: r.output for r in entry.queries()["greedy_decoding"](spark, sf).collect()}
    assert got == {r.item_id: decoded(r.text.split()) for r in catalog.table(spark, sf, "benchmark").collect()}
