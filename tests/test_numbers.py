import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordloom.functions import numeric as nm
from wordloom.operators import metrics as mt
from wordloom.operators import quantiles as qt
from wordloom.operators import statistics as st
from wordloom.operators import vectors as vc
from wordloom.schemas import COUNTS, METRICS

X = [-4.0, -1.5, -0.3, 0.0, 0.2, 1.0, 3.7, None]
EXPECTED = {
    "sigmoid": lambda x: 1 / (1 + math.exp(-x)),
    "tanh": math.tanh,
    "relu": lambda x: max(x, 0.0),
    "leakyrelu": lambda x: max(x, 0.01 * x),
    "gelu": lambda x: x * NormalDist().cdf(x),
    "swish": lambda x: x / (1 + math.exp(-x)),
}


@pytest.mark.parametrize("name", list(EXPECTED))
def test_activations(column, name):
    values = X
    got = column(nm.ACTIVATIONS[name], values, "double")
    assert got == pytest.approx([None if x is None else EXPECTED[name](x) for x in values], abs=1e-12)


def test_beta(column):
    assert column(lambda c: nm.sigmoid(c, 2.0), [1.0], "double")[0] == pytest.approx(1 / (1 + math.exp(-2)))
    assert column(lambda c: nm.swish(c, 2.0), [1.5], "double")[0] == pytest.approx(1.5 / (1 + math.exp(-3)))


@pytest.mark.parametrize("rows_per_range", [10**6, 20])
def test_gradient(spark, rows_per_range):
    rng = np.random.default_rng(3)
    x = np.sort(rng.random(150) * 8 - 4)
    y = np.tanh(x)
    rows = [("s", float(a), float(b)) for a, b in zip(x, y)] + [("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 3.0, 8.0)]
    rows += [(None, 1.0, 1.0), (None, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    got = {(r.k, r.x): r.dydx for r in nm.gradient(df, ["k"], "x", "y", rows_per_range=rows_per_range).collect()}
    assert [got[("s", float(a))] for a in x] == pytest.approx(list(np.gradient(y, x)), abs=1e-9)
    assert got[("one", 1.0)] is None and got[("two", 1.0)] == got[("two", 3.0)] == 3.0
    assert got[(None, 1.0)] == got[(None, 2.0)] == 2.0


def test_linspace(spark):
    got = [r.x for r in nm.linspace(spark, -4, 4, 1000).orderBy("i").collect()]
    assert got == pytest.approx(list(np.linspace(-4, 4, 1000)), abs=1e-12)


def test_layers(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 0.5, 2000), [-1.0, 1.0, 1.0001, -2.0]])
    df = spark.createDataFrame([(1, float(v)) for v in values], "layer int, x double")
    counts, _ = np.histogram(values, 30, range=(-1, 1))
    got = {r.bin: r.n for r in st.layer_histogram(df, "layer", "x").collect()}
    assert [got.get(i, 0) for i in range(30)] == list(counts)
    row = st.layer_moments(df, "layer", "x").first()
    assert (row.mean, row["std"]) == pytest.approx((values.mean(), values.std()))


# -- statistics ------------------------------------------------------------------------

FREQS = [50, 20, 20, 7, 3, 3, 2, 2, 2, 2, 1, 1, 1]


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([(f"w{i:02d}", n) for i, n in enumerate(FREQS)], COUNTS).repartition(4)


def test_describe(counts, spark):
    want = pd.Series(FREQS).describe()
    row = st.describe(counts, "cnt").first()
    assert [row[i] for i in range(8)] == pytest.approx(list(want))
    assert st.describe(counts.limit(0), "cnt").first()["count"] == 0
    assert st.describe(counts.limit(1), "cnt").first()["std"] is None
    big = spark.range(1000).select((F.col("id") * 587_685).alias("v"))
    row = st.describe(big, "v").first()
    assert [row[i] for i in range(8)] == pytest.approx(list(pd.Series(range(1000)).mul(587_685).describe()))


def test_ranks_and_cutoffs(counts):
    assert {r["rank"]: r.word for r in st.words_at_ranks(counts, [0, 4, 12, 99]).collect()} == {0: "w00", 4: "w04", 12: "w12"}
    rows = {r.size: r for r in st.cutoffs(counts, [1, 3, 13]).collect()}
    assert (rows[3].word, rows[3].cnt) == ("w02", 20)
    assert rows[3].coverage == pytest.approx(90 / sum(FREQS)) and rows[13].coverage == pytest.approx(1)
    top = st.common_frequencies(counts, 2).collect()
    assert [(r.cnt, r.n_words) for r in top] == [(2, 4), (1, 3)] and top[0].share == pytest.approx(4 / 13)


def test_lengths(spark):
    df = spark.createDataFrame([(i, [0] * n) for i, n in enumerate([2, 2, 5, 11, 20])], "record_id long, ids array<int>")
    sizes = st.lengths(df)
    assert {r.length: r.share for r in st.length_shares(sizes).collect()} == {2: 0.4, 5: 0.2, 11: 0.2, 20: 0.2}
    assert {r.length for r in st.length_shares(sizes, [2, 3]).collect()} == {2}
    assert {r.n_context: r.share for r in st.retention(sizes, [1, 5, 50]).collect()} == {1: 0.6, 5: 0.4, 50: 0.0}


def test_keep_curves(counts):
    rows = st.keep_curves(counts, points=10).filter("t > 0.005").orderBy("i").collect()
    x = np.linspace(1, 50, 10)
    f = x / sum(FREQS)
    assert [r.x for r in rows] == pytest.approx(list(x))
    assert [r.keep_prob for r in rows] == pytest.approx(list((np.sqrt(f / 0.01) + 1) * 0.01 / f))


def test_loss_log(spark):
    rows = [("r", "val" if i % 4 == 0 else "train", e, i, float(i + e)) for e in (0, 1) for i in range(60)]
    log = spark.createDataFrame(rows, METRICS)
    got = {(r.epoch, r.step): r.mean_loss for r in mt.logged_running_loss(log, rows_per_range=10).collect()}
    assert got == {(0, 24): 12.0, (0, 49): 24.5, (1, 24): 13.0, (1, 49): 25.5}
    per_epoch = {r.epoch: (r.train, r.val) for r in mt.epoch_losses(log).collect()}
    assert per_epoch[0] == (pytest.approx(30.0), 28.0)
    rates = [r.rate for r in mt.learning_rates(spark, 50).orderBy("epoch").collect()]
    assert rates[0] == 0.025 and rates[-1] == pytest.approx(0.025 / 50) and len(rates) == 50


# -- vectors ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(5).normal(size=(12, 4)).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark, matrix):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(matrix)], "id int, vector array<float>")


def test_clip_norm(vectors, matrix):
    got = {r.id: r.v for r in vectors.select("id", vc.clip_norm("vector").alias("v")).collect()}
    for i, row in enumerate(matrix.astype(float)):
        assert got[i] == pytest.approx(list(row * min(1, 1 / np.linalg.norm(row))))


def test_analogy(vectors, matrix):
    m = matrix.astype(float)
    query = m[1] - m[2] + m[3]
    scores = m @ query / np.linalg.norm(m, axis=1) / np.linalg.norm(query)
    order = [i for i in np.argsort(-scores) if i not in (1, 2, 3)][:5]
    rows = vc.analogy(vectors, 1, 2, 3, 5).collect()
    assert [r.id for r in rows] == order and rows[0].similarity == pytest.approx(scores[order[0]])
    with pytest.raises(Exception, match="has no vector"):
        vc.analogy(vectors, 1, 99, 3, 5).collect()


@pytest.mark.parametrize("way, block_bytes", [("arrow", 1 << 26), ("arrow", 60), ("join", 0)])
def test_context_means(spark, vectors, matrix, way, block_bytes):
    rows = [(1, 0, [0, 1, 1, 5]), (1, 1, [3, 99]), (2, 0, [77, -1]), (2, 1, [])]
    ex = spark.createDataFrame(rows, "record_id long, start int, context array<int>").repartition(2)
    got = {(r.record_id, r.start): r["mean"] for r in vc.context_means(ex, vectors, way=way, block_bytes=block_bytes).collect()}
    assert set(got) == {(1, 0), (1, 1)}
    assert got[1, 0] == pytest.approx(list(matrix[[0, 1, 1, 5]].astype(float).mean(axis=0)))
    assert got[1, 1] == pytest.approx(list(matrix[3].astype(float)))


@pytest.mark.parametrize("way", ["auto", "join"])
def test_look_up_vectors(spark, vectors, matrix, way):
    rows = spark.createDataFrame([(i, 3 if i % 3 else i % 20) for i in range(60)], "k int, id int")
    got = {r.k: r.vector for r in vc.look_up_vectors(rows, vectors, way=way).collect()}
    assert got == {i: [float(v) for v in matrix[j]] for i, j in ((r.k, r.id) for r in rows.collect()) if j < 12} | {
        i: None for i in range(60) if i % 3 == 0 and i % 20 >= 12
    }
    kept = vc.look_up_vectors(rows, vectors, way=way, keep_missing=False)
    assert kept.count() == sum(v is not None for v in got.values())


@pytest.mark.parametrize("fits", ["used", "none"])
def test_look_up_in_a_large_table_joins_the_used_vectors(spark, matrix, monkeypatch, fits):
    many = spark.createDataFrame([(i, [float(v) for v in matrix[i % 12] + i]) for i in range(3000)], "id int, vector array<float>")
    rows = spark.createDataFrame([(i, None if i == 5 else i % 40 * 90) for i in range(400)], "k int, id int")
    monkeypatch.setattr(vc, "MAX_BROADCAST_BYTES", 34 * (16 + 4 * 8) if fits == "used" else 34 * (16 + 4 * 8) - 1)
    expected = {i: [float(v) for v in (matrix[j % 12] + j).astype(np.float32)] if j < 3000 and i != 5 else None for i, j in ((i, i % 40 * 90) for i in range(400))}
    found = vc.look_up_vectors(rows, many)
    got = {r.k: r.vector for r in found.collect()}
    assert {k: v and pytest.approx(v) for k, v in expected.items()} == got and found.columns == ["k", "id", "vector"]
    assert ("Union" in found._jdf.queryExecution().optimizedPlan().toString()) == (fits == "none")
    assert vc.look_up_vectors(rows, many, keep_missing=False).count() == sum(v is not None for v in expected.values())


def test_scores_match_brute_force(spark, vectors, matrix):
    rng = np.random.default_rng(9)
    out, bias = rng.normal(size=(12, 4)), rng.normal(size=12)
    output = spark.createDataFrame(
        [(i, [float(v) for v in out[i]], float(bias[i])) for i in range(12)], "id int, vector array<double>, bias double"
    )
    rows = [(i, [int(v) for v in rng.integers(0, 12, 1 + i % 4)], int(rng.integers(0, 12))) for i in range(300)]
    ex = spark.createDataFrame(rows, "record_id long, context array<int>, center int").repartition(3)
    expected = {}
    for i, context, center in rows:
        logits = matrix[context].astype(float).mean(axis=0) @ out.T + bias
        expected[i] = np.log(np.exp(logits).sum()) - logits[center]
    scored = vc.score_examples(ex, vectors, output)
    assert {r.record_id: r.loss for r in scored.collect()} == pytest.approx(expected)
    for block_bytes in (90, 250):
        blocks = vc.score_examples(ex, vectors, output, block_bytes=block_bytes)
        assert {r.record_id: r.loss for r in blocks.collect()} == pytest.approx(expected, abs=1e-9)
    assert vc.mean_loss(scored).first().loss == pytest.approx(np.mean(list(expected.values())))
    halves = [[v for k, v in expected.items() if k < 100], [v for k, v in expected.items() if k >= 100]]
    by_batch = vc.mean_loss(scored.withColumn("b", F.col("record_id") < 100), "b").first().loss
    assert by_batch == pytest.approx(np.mean([np.mean(h) for h in halves]))


@pytest.mark.parametrize("block_bytes", [1 << 26, 100])
def test_criteria_over_negatives(spark, vectors, matrix, block_bytes):
    rng = np.random.default_rng(11)
    out, bias, prob = rng.normal(size=(12, 4)), rng.normal(size=12), rng.dirichlet(np.ones(12))
    output = spark.createDataFrame([(i, out[i].tolist(), float(bias[i])) for i in range(12)], "id int, vector array<double>, bias double")
    drawn_from = spark.createDataFrame([(i, float(prob[i])) for i in range(12)], "id int, prob double")
    rows = [(i, rng.integers(0, 12, 1 + i % 4).tolist(), int(rng.integers(0, 12)), rng.integers(0, 12, i % 6).tolist()) for i in range(80)]
    odd = [(80, [], 3, [1]), (81, [99], 3, [1]), (82, [4], 99, [1]), (83, [99, 4], 5, [77, 2])]
    ex = spark.createDataFrame(rows + odd, "record_id long, context array<int>, center int, negatives array<int>").repartition(3)
    negative, sampled, full = {80: None, 81: None, 82: None}, {80: None, 81: None, 82: None}, {80: None, 81: None, 82: None}
    for i, context, center, others in [*rows, (83, [4], 5, [2])]:
        x = matrix[context].astype(float).mean(axis=0) @ out.T + bias
        negative[i] = np.log1p(np.exp(-x[center])) + sum(np.log1p(np.exp(x[j])) for j in others)
        y = x - np.log(max(len(others) if i < 80 else 2, 1) * prob)
        sampled[i] = np.log(np.exp(y[[center, *others]]).sum()) - y[center]
        full[i] = np.log(np.exp(x).sum()) - x[center]
    for name, expected in (("negative", negative), ("sampled", sampled), ("softmax", full)):
        got = vc.score_examples(ex, vectors, output, name, drawn_from, block_bytes)
        assert got.columns == ["record_id", "center", "loss"]
        got = {r.record_id: r.loss for r in got.collect()}
        assert {k for k, v in got.items() if v is None} == {80, 81, 82} and set(got) == set(expected)
        assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in expected.items() if v is not None}, abs=1e-9)
    with pytest.raises(ValueError, match="criterion"):
        vc.score_examples(ex, vectors, criterion="other")


def test_discriminant_axes(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(90, 5)) @ rng.normal(size=(5, 5)) + 50
    label = np.arange(90) % 4
    x[:, 0] += label
    x[:, 2] -= label * label
    rows = [(i, row.tolist(), int(k)) for i, (row, k) in enumerate(zip(x, label))]
    rows += [(900, None, 1), (901, x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "id int, vector array<double>, label int").repartition(4)
    found = vc.discriminant_axes(df, "label", 9)
    mean = x.mean(axis=0)
    between = sum((label == k).sum() * np.outer(m, m) for k in range(4) for m in [x[label == k].mean(axis=0) - mean])
    within = sum((z := x[label == k] - x[label == k].mean(axis=0)).T @ z for k in range(4))
    assert found.within == pytest.approx(within, abs=1e-8) and found.between == pytest.approx(between, abs=1e-8)
    assert found.axes.shape == (5, 3) and found.n == 90
    assert between @ found.axes == pytest.approx(within @ found.axes * found.values, abs=1e-7)
    assert found.axes.T @ within @ found.axes == pytest.approx(np.eye(3), abs=1e-9)
    expected = np.sort(np.linalg.eigvals(np.linalg.solve(within, between)).real)[::-1][:3]
    assert found.values == pytest.approx(expected)
    placed = {r.id: r.placed for r in vc.place(df, found.mean, found.axes).collect()}
    assert placed[7] == pytest.approx(((x[7] - mean) @ found.axes).tolist()) and placed[900] is None
    flat = df.withColumn("vector", F.transform("vector", lambda v: v * 0))
    assert vc.discriminant_axes(flat, "label", 2).axes.shape[1] == 0
    assert vc.discriminant_axes(df.limit(0), "label", 2).n == 0


def test_principal_axes(vectors, matrix):
    model = vc.principal_axes(vectors, 2)
    centred = matrix.astype(float) - matrix.astype(float).mean(axis=0)
    _, _, axes = np.linalg.svd(centred)
    assert np.abs(model.pc.toArray().T) == pytest.approx(np.abs(axes[:2]), abs=1e-6)
    got = {r.id: r.projected for r in vc.project(vectors, model).collect()}
    assert np.abs(got[3]) == pytest.approx(np.abs(matrix[3].astype(float) @ axes[:2].T), abs=1e-6)


def test_training(spark, tmp_path):
    rows = [(["king", "rules", "the", "land"],), (["queen", "rules", "the", "land"],), (["a", "dog", "barks"],)] * 20
    df = spark.createDataFrame(rows, "tokens array<string>")
    model = vc.train_with_checkpoints(df, str(tmp_path / "m"), epochs=4, every=2, dimension=5, seed=1)
    assert {p.name for p in (tmp_path / "m").iterdir()} == {"checkpoint_2", "checkpoint_4", "model"}
    table = spark.createDataFrame([(3, "king"), (4, "absent")], "id int, word string")
    found = vc.vectors_of(model, table).collect()
    assert [(r.id, r.word, len(r.vector)) for r in found] == [(3, "king", 5)]
    assert vc.vectors_of(model).count() == 8
    assert vc.checkpoint_name(5, 50) == "checkpoint_05"


# -- quantiles -------------------------------------------------------------------------


def test_quantiles_equal_the_sorted_values(spark):
    draw = np.random.default_rng(21)
    mixed = [*(draw.normal(size=200) * 10.0 ** draw.integers(-300, 300, 200)).tolist(), -0.0, 0.0, 0.0, 5e-324, -5e-324, 1e308, float("inf"), float("-inf")]
    tables = {
        "double": [mixed, [*mixed, float("nan"), float("nan")], [-0.0, 0.0], [1.5] * 9, [float("nan")]],
        "float": [[float(np.float32(x)) for x in draw.normal(size=50)]],
        "bigint": [draw.integers(-(2**63), 2**63 - 1, 101).tolist(), [-(2**63), 2**63 - 1], [7] * 5, draw.integers(0, 90, 300).tolist()],
        "int": [draw.integers(-5, 5, 64).tolist()],
    }
    shares = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]
    for kind, lists in tables.items():
        for values in lists:
            df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {kind}").repartition(3)
            ranks = sorted({0, len(values) // 3, len(values) - 1})
            in_order = sorted(values, key=lambda v: (math.isnan(v), v))
            assert list(map(str, qt.select_ranks(df, "v", ranks))) == [str(in_order[r] + 0) for r in ranks]
            want = df.agg(F.percentile(F.col("v"), [float(s) for s in shares])).first()[0]
            assert qt.quantiles(df, "v", shares) == pytest.approx(want, rel=1e-12, nan_ok=True)


def test_weighted_quantiles_and_none(spark):
    df = spark.createDataFrame([(3, 2), (9, 1), (3, 1), (1, 4), (8, 0), (None, 50), (7, None)], "v int, n int")
    whole = sorted([3, 3, 9, 3, 1, 1, 1, 1])
    assert qt.select_ranks(df, "v", list(range(8)), "n") == whole
    assert qt.quantiles(df, "v", [0.3, 0.9], "n") == pytest.approx(list(np.quantile(whole, [0.3, 0.9])))
    assert qt.quantiles(df.limit(0), "v", [0.5]) == [None]
    with pytest.raises(IndexError):
        qt.select_ranks(df, "v", [8], "n")


def test_error_function():
    x = np.concatenate([np.linspace(-8, 8, 20_001), [0.0, 1e-12, -1e-300, math.inf, -math.inf]])
    want = np.array([math.erf(v) for v in x])
    assert np.abs(nm.erf(x) - want).max() < 1e-15
    assert np.isnan(nm.erf(np.array([math.nan])))[0]
