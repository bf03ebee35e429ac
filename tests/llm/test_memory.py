"""What texts take while their words are hashed."""

import tracemalloc

import numpy as np

from wordloom.llm import lsh_forest
from wordloom.llm.common import RollingHash, shingle_sets
from wordloom.session import materialize


def test_hashing_holds_a_slice_of_the_texts():
    draw = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 10**6, 150)).encode() for _ in range(5000)]  # 6 MB
    whole = [" ".join(f"w{x}" for x in draw.integers(0, 10**6, 600_000)).encode()]  # one of 5 MB
    alone = [shingle_sets([t], 5, RollingHash())[0] for t in texts[:50]]
    tracemalloc.start()
    sets = shingle_sets(texts, 5, RollingHash())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(s.nbytes for s in sets) + 40e6
    assert all((a == b).all() for a, b in zip(alone, sets))
    assert len(shingle_sets(whole, 5, RollingHash())[0]) == 600_000 - 4


def test_a_signature_holds_a_piece_of_the_hashes():
    draw = np.random.default_rng(9)
    shingles, seeds = (draw.integers(0, 2**63, n).astype(np.uint64) for n in (1 << 16, lsh_forest.TREES * 5))
    tracemalloc.start()
    found = lsh_forest.signature(shingles, seeds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
    assert (found == np.min([lsh_forest.signature(x, seeds) for x in np.split(shingles, 64)], axis=0)).all()


def test_sets_to_compare_are_cut_once_and_behind_the_join(spark, monkeypatch):
    plans = {}

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, label)

    monkeypatch.setattr(lsh_forest, "materialize", kept)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "something else"), (4, None)], "doc_id bigint, text string")
    found = {r.doc_id: r.group_id for r in lsh_forest.groups(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    assert plans["links"].count("ArrowEvalPython") == 1
    assert plans["links"].index("ArrowEvalPython") < plans["links"].index("Join Inner")
