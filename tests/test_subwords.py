"""Learnt pieces against merging one pair at a time."""

import random
from collections import Counter

import numpy as np
import pytest

from wordloom.operators import subwords as sw


def brute(counts, merges, at_least=2):
    pieces = sorted({c for w in counts for c in sw.MARK + w})
    words = {w: [pieces.index(c) for c in sw.MARK + w] for w in counts}
    chosen = []
    for _ in range(merges):
        pairs = Counter()
        for w, s in words.items():
            for pair in zip(s, s[1:]):
                pairs[pair] += counts[w]
        best = min((p for p in pairs if pairs[p] >= at_least), key=lambda p: (-pairs[p], max(p), p), default=None)
        if best is None:
            break
        for w, s in words.items():
            out, i = [], 0
            while i < len(s):
                if tuple(s[i : i + 2]) == best:
                    out.append(len(pieces))
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            words[w] = out
        chosen.append(best)
        pieces.append(pieces[best[0]] + pieces[best[1]])
    return pieces, chosen, words


@pytest.mark.parametrize("seed, merges", [(1, 25), (2, 60), (3, 400)])
def test_merges_equal_one_at_a_time(spark, seed, merges, monkeypatch):
    monkeypatch.setattr(sw, "ROUNDS", 3)
    draw = random.Random(seed)
    counts = {"".join(draw.choices("aaabcdé", k=draw.randint(1, 9))): draw.randint(1, 40) for _ in range(60)}
    df = spark.createDataFrame([*counts.items(), ("", 9)], "word string, cnt long").repartition(4)
    got = sw.learn_subwords(df, merges)
    pieces, chosen, words = brute(counts, merges)
    assert got.merges == chosen and got.pieces == pieces
    assert {r.word: list(r.symbols) for r in got.words.collect()} == words
    expected = Counter()
    for w, s in words.items():
        for i in s:
            expected[pieces[i]] += counts[w]
    assert {r.word: r.cnt for r in got.counts().collect()} == dict(expected)
    assert all("".join(r.pieces) == sw.MARK + r.word for r in got.split().collect())


def test_runs_of_one_symbol():
    flat, ends, changed = sw.merge_pairs(np.array([7, 7, 7, 7, 7, 1, 7, 7, 7]), np.array([0, 5, 7, 9]), [(7, 7, 9)])
    assert flat.tolist() == [9, 9, 7, 1, 7, 9] and ends.tolist() == [0, 3, 5, 6] and changed.tolist() == [True, False, True]


def test_no_words(spark):
    got = sw.learn_subwords(spark.createDataFrame([], "word string, cnt long"), 5)
    assert got.merges == [] and got.counts().collect() == []
