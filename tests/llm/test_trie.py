"""The trie of conversations against sets of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wordloom.llm import turn_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for prefix, convs in nodes.items():
        inside = [p for p in nodes if p[: len(prefix)] == prefix]
        kids = lambda q: sum(len(p) == len(q) + 1 and p[:-1] == q for p in nodes)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(prefix))
        out.append((
            min(convs), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(convs), kids(prefix), sum(kids(p) == 0 for p in inside),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in inside if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def nodes(frame, rows, limit):
    df = turn_trie.graft(turn_trie.conversations(frame(rows, SCHEMA)), F.col("conv_id") - F.col("conv_id") % 100, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int"), 6)
    return sorted((tuple(r)[:-1] for r in turn_trie.trie(df, limit).collect()), key=str)


def conversations(seed):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(12), 100, *range(103, 110), 205, 207, 311]:
        for turn in range(draw.choice([0, 1, 2, 4, 9])):
            rows.append((conv, turn, draw.choice(["user", None]), draw.choice(["a", "bé", "", None])))
    rows += [(conv, turn, "user", "same" * turn) for conv in (1200, 1300, 1400, 1501, 1502) for turn in range(12)]
    rows += [(1300, None, "system", "first"), (1400, 12, "user", "on"), (1400, 12, "user", "on"), (None, 0, "user", "no conversation")]
    return rows


@pytest.mark.parametrize("limit", [1, 2, 5, 256])
def test_nodes_equal_brute_force(frame, limit):
    rows = conversations(limit)
    assert nodes(frame, rows, limit) == brute(rows)


def test_copies_and_a_long_common_beginning_take_few_rounds(frame, monkeypatch):
    rows = [(100 * c, t, "user", f"t{t}") for c in range(30) for t in range(40)] + [(100 * c, 40, "user", f"own {c % 10}") for c in range(30)]
    rounds = []
    burst = turn_trie._burst
    monkeypatch.setattr(turn_trie, "_burst", lambda *a: rounds.append(1) or burst(*a))
    assert nodes(frame, rows, 2) == brute(rows)
    assert len(rounds) <= 3


def test_an_empty_table_has_no_nodes_and_turnless_conversations_end_at_the_root(frame):
    assert nodes(frame, [], 4) == []
    # crc32 of "101" leaves all of its turns to a conversation that is not there
    lone = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(lone, 0, "user", "gone")]
    assert nodes(frame, rows, 4) == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_a_long_turn_and_clashing_columns(frame):
    rows = [(c, t, "user", "é" * 300_000 if t == 1 else "x") for c in (200, 300) for t in range(3)]
    df = frame(rows, SCHEMA).withColumn("head", F.lit(1)).withColumn("path", F.lit("p")).withColumn("n", F.lit(None).cast("int"))
    got = turn_trie.trie(turn_trie.conversations(df), 1)
    assert {(r.depth, r.n_convs, r.saved_tokens) for r in got.collect()} == {(0, 2, 300_002), (1, 2, 300_002), (2, 2, 300_001), (3, 2, 1)}
    texts = {r.turn_key: len(r.text) for r in turn_trie.turn_texts(df).collect()}
    assert sorted(texts[r.turn_key] for r in got.filter("depth > 0").collect()) == [1, 1, 300_000]
