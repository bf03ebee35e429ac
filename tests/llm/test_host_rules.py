"""Host rules against plain counting."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.llm import host_rules

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string"
GOOD = " ".join(f"word{i}" for i in range(60))


def brute(text):
    text = text or ""
    words = SPLIT.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "a a a a", "a b c\na b c\n\na b c ", "x y z x y z q", "é½ ##$ <b>\n<b>\r\n<b>\r", "one two", "a b a b a b", "   x",
    "\n".join(["same line here"] * 5), GOOD, GOOD + " " + GOOD, "w " * 400_000 + "end " + GOOD,
]


def test_measures_equal_plain_counting(frame):
    docs = frame([(i, t, "h") for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in host_rules.measured(docs, ["doc_id"]).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_base_rules_and_a_host_of_bad_pages(frame):
    rows = []
    for h in range(40):
        for i in range(25):
            bad = h == 7 and i < 22 or h != 7 and i == 0
            rows.append((100 * h + i, "too short" if bad else GOOD, f"h{h}"))
    rows += [(9001, "too short", "small"), (9002, GOOD, "small"), (9003, GOOD, None), (9004, None, None), (9003, GOOD, None)]
    docs = frame(rows, SCHEMA)
    got = host_rules.judge(docs, ["doc_id", "source"], "source").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50)
        assert r.kept == (not r.base_failed and r.source != "h7"), r


def test_prior_by_moments():
    n, f = [30, 50, 20, 100], [3, 25, 1, 40]
    rows, p = sum(n), sum(f) / sum(n)
    pq, s = p * (1 - p), sum(a * (b / a - p) ** 2 for a, b in zip(n, f))
    spread = (s - pq * 3) / (pq * (rows - sum(a * a for a in n) / rows - 3))
    mean, strength = host_rules.prior(4, rows, sum(a * a for a in n), sum(f), sum(b * b / a for a, b in zip(n, f)))
    assert mean == pytest.approx(p) and strength == pytest.approx(1 / spread - 1)
    assert host_rules.prior(3, 30, 300, 15, 7.5)[1] == float("inf")
    assert host_rules.prior(1, 30, 900, 29, 29 * 29 / 30)[1] == float("inf")


def test_alike_hosts_are_kept_even_if_most_fail(frame):
    docs = frame([(i, GOOD if i % 3 == 0 else "short", f"h{i % 4}") for i in range(48)], SCHEMA)
    assert all(r.kept == (r.doc_id % 3 == 0) for r in host_rules.judge(docs, ["doc_id"], "source").collect())


def test_empty_table_and_clashing_names(frame):
    assert host_rules.judge(frame([], SCHEMA), ["doc_id"], "source").collect() == []
    docs = frame([(1, GOOD, "h")], SCHEMA).withColumnsRenamed({"text": "host", "doc_id": "n_words"}).withColumn("kept", F.lit(5)).withColumn("gone", F.lit(6))
    out = host_rules.judge(docs, ["n_words", "kept", "gone", "host"], "source", "host")
    assert len(set(out.columns)) == len(out.columns)
    row = out.first()
    assert (row["n_words"], row["kept"], row["gone"], row["_n_words"], row["_kept"], row["host"]) == (1, 5, 6, 60, True, GOOD)
