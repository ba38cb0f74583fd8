import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwright.llm import chat, rules, tokens

from .cases import empty, messy

TURNS = "conv_id long, turn long, role string, text string"


# chat ------------------------------------------------------------------------------------------------------------------
def test_round_trip_of_control_strings(spark):
    rng = random.Random(4)
    bits = ["### ", "###", "\\", "</turn>", "<+>", "\n", " ", "Assistant: ", "### User: ", "\n</turn>\n", "\n<+>\n", "x", "é🙂", ""]
    roles = ["user", "assistant", "system", "User", "tool:x\n", "", None]
    rows = []
    for c in range(80):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(roles), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])))
    got = chat.parsed(chat.formatted(spark.createDataFrame(rows, TURNS).repartition(3))).collect()
    for r in got:
        want = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, role, text in want]
        assert list(r.loss) == [text for _, role, text in want if role == "assistant"]


def test_mask_covers_the_output(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b🙂"), (1, 2, "assistant", "c"), (1, 3, "user", "### x")]
    r = chat.formatted(spark.createDataFrame(rows, TURNS)).first()
    assert r.formatted == "### User: a\n</turn>\n### Assistant: b🙂\n<+>\nc\n</turn>\n### User: \\### x\n</turn>\n"
    assert sum(m.chars for m in r["mask"]) == len(r.formatted)
    assert sum(m.chars for m in r["mask"] if m.loss) == 3


def test_ties_nulls_and_empty_conversations(spark):
    rows = [(None, None, "user", "n"), (None, 0, "user", "m"), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "user", "a")]
    got = {r.conv_id: [x.text for x in r.turns] for r in chat.parsed(chat.formatted(spark.createDataFrame(rows, TURNS))).collect()}
    assert got == {None: ["n", "m"], 2: ["a", "a", "b"]}
    assert chat.formatted(spark.createDataFrame([], TURNS)).collect() == []


def test_very_long_conversations_and_texts(spark):
    """Linear: 10,000 turns and a text of a million characters are read back in seconds."""
    rows = [(1, t, "assistant" if t % 3 else "user", f"turn {t} ### \ufeff é🙂") for t in range(10_000)]
    rows += [(2, 0, "user", "w " * 500_000), (2, 1, "assistant", "\ufeff### 🙂 " * 100_000 + "é")]
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    for name in ("formatted", "mask", "row", "t", "starts", "blocks"):
        frame = frame.withColumn(name, F.lit(0))
    began = time.monotonic()
    got = {r.conv_id: r for r in chat.parsed(chat.formatted(frame)).collect()}
    assert time.monotonic() - began < 60
    for c in (1, 2):
        assert [x.text for x in got[c].turns] == [r[3] for r in rows if r[0] == c]
        assert list(got[c].loss) == [r[3] for r in rows if r[0] == c and r[2] == "assistant"]


def test_no_python_in_the_plan(spark):
    plan = chat.parsed(chat.formatted(spark.createDataFrame([(1, 0, "user", "a")], TURNS)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# rules -----------------------------------------------------------------------------------------------------------------
def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_counts_match_brute_force(spark):
    got = rules.judged(messy(spark)).collect()
    want = [(r.doc_id, *brute_counts(r.text)) for r in messy(spark).collect()]
    assert sorted(map(repr, [(r.doc_id, *(r[c] for c in rules.COUNTS)) for r in got])) == sorted(map(repr, want))


def test_hosts_are_shrunk_and_rejected(spark):
    good, bad = "word%d " * 60 % tuple(range(60)), "x"
    rows = [(i, good if i % 10 else bad, "good") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "bad") for i in range(200)] + [(2000, bad, "tiny"), (3000, good, None)]
    out = rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    rate = {r.host: r.host_rate for r in out.select("host", "host_rate").distinct().collect()}
    raw = {"good": 0.1, "bad": 0.9, "tiny": 1.0, None: 0.0}
    m, v = np.mean(list(raw.values())), np.var(list(raw.values()))
    weight = max(m * (1 - m) / v - 1, 1.0)
    n = {"good": 200, "bad": 200, "tiny": 1, None: 1}
    for h in raw:
        assert rate[h] == pytest.approx((raw[h] * n[h] + weight * m) / (n[h] + weight))
    kept = {r.host: r.c for r in out.groupBy("host").agg(F.count_if("kept").alias("c")).collect()}
    assert kept == {"good": 180, "bad": 0, "tiny": 0, None: 1}


def test_rules_of_one_host_and_of_none(spark):
    rows = [(1, "a " * 60, "h"), (2, " ".join(f"w{i}" for i in range(60)), "h")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: (True, False), 2: (False, True)}
    assert rules.judged(empty(spark)).collect() == []


# tokens ----------------------------------------------------------------------------------------------------------------
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_long_texts_count_as_at_once():
    t = tokens._loaded(VOCABULARY)
    rng = random.Random(8)
    bits = ["hello", " ", "  ", "\n", "\n\n", "'re", "'", "é", "日本", "123", "!!", "<|endoftext|>", "<|endof", "a" * 90, " " * 200, "x" * 700, "🙂"]
    for _ in range(60):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(900)))
        for chunk, overlap in ((300, 100), (1000, 150)):
            assert tokens.count_long(t, s, chunk, overlap) == len(t.encode(s, add_special_tokens=False).ids)


def test_counts_of_awkward_texts(spark):
    t = tokens._loaded(VOCABULARY)
    docs = messy(spark)
    got = tokens.token_counts(docs, VOCABULARY, whole_chars=5_000, overlap=200).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert tokens.token_counts(empty(spark), VOCABULARY).collect() == []


def test_pieces_vocabulary(spark):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    t = tokens._loaded(path)
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(messy(spark).where("doc_id IN (3, 4, 14)"), path).collect()}
    assert got[4] == 0 and got[3] == len(t.encode(messy(spark).where("doc_id = 3").first().text))
