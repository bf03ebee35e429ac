import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import hashing as hs
from wordloom.operators import encoding as en
from wordloom.operators import examples as ex
from wordloom.operators import joins
from wordloom.operators import ranking as rk
from wordloom.operators import sampling as sp
from wordloom.operators import vocabulary as vb
from wordloom.schemas import COUNTS


def py_digest(seed, *parts):
    return hashlib.md5(":".join([str(seed), *map(str, parts)]).encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most of the rows."""
    rows = [("hot", i, float((i * 37) % 101)) for i in range(3000)] + [(f"g{i % 5}", i, float(i)) for i in range(200)]
    return spark.createDataFrame(rows, "g string, x long, y double").repartition(6)


# -- uniforms --------------------------------------------------------------------------


def test_uniform_is_uniform_and_equal_in_numpy(spark):
    df = spark.range(200).select(hs.record_state(7, "id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(199))).alias("p"))
    rows = df.select("s", "p", hs.uniform(F.col("s"), F.col("p")).alias("u")).toPandas()
    u = rows.u.to_numpy()
    assert np.array_equal(u, hs.uniform_np(rows.s.to_numpy(), rows.p.to_numpy()))
    assert u.min() >= 0 and u.max() < 1
    ordered = np.sort(u)
    ks = np.abs(ordered - (np.arange(len(u)) + 0.5) / len(u)).max()
    assert ks < 1.63 / math.sqrt(len(u))  # 1 % level
    grid = u.reshape(200, 200)
    assert abs(np.corrcoef(grid[:, :-1].ravel(), grid[:, 1:].ravel())[0, 1]) < 0.02
    assert abs(np.corrcoef(grid[:-1].ravel(), grid[1:].ravel())[0, 1]) < 0.02


# -- ranking ---------------------------------------------------------------------------


@pytest.mark.parametrize("rows_per_range", [10**6, 50])
def test_ranked_windows_equal_plain_windows(skewed, rows_per_range):
    numbered = rk.row_numbers(skewed, ["g"], "x", rows_per_range=rows_per_range)
    mean = rk.running_mean(skewed, ["g"], "x", "y", rows_per_range=rows_per_range)
    near = rk.neighbours(skewed, ["g"], "x", ["x", "y"], rows_per_range)
    plain = skewed.toPandas().sort_values(["g", "x"])
    groups = plain.groupby("g")
    expected = {
        (r.g, r.x): (n, m, p, q)
        for r, n, m, p, q in zip(
            plain.itertuples(), groups.cumcount(), groups.y.expanding().mean(), groups.x.shift(1), groups.x.shift(-1)
        )
    }
    assert {(r.g, r.x): r.position for r in numbered.collect()} == {k: v[0] for k, v in expected.items()}
    got = {(r.g, r.x): r.running_mean for r in mean.collect()}
    assert got == pytest.approx({k: v[1] for k, v in expected.items()})
    none = lambda v: None if v is None or v != v else int(v)
    sides = {(r.g, r.x): (r.previous and r.previous.x, r.next and r.next.x) for r in near.collect()}
    assert sides == {k: (none(v[2]), none(v[3])) for k, v in expected.items()}


def test_hot_group_is_cut_into_pieces(skewed):
    pieces = rk.with_ranges(skewed, "x", 100).groupBy("g", "_range").count()
    assert pieces.agg(F.max("count")).first()[0] <= 200


def test_hash_order(spark):
    df = spark.range(500).withColumnRenamed("id", "record_id").repartition(5)
    expected = sorted(range(500), key=lambda i: py_digest(9, i))
    placed = rk.shuffled_positions(df, "record_id", 9).orderBy("position").collect()
    assert [r.record_id for r in placed] == expected and [r.position for r in placed] == list(range(500))
    for k in (0, 1, 250, 500, 501):
        cut = spark.range(1).select(rk.hash_cut(df, "record_id", 9, k)).first()[0]
        assert cut == (py_digest(9, expected[k - 1]) if 1 <= k <= 500 else None)


# -- splits and mixes ------------------------------------------------------------------


def test_split(spark):
    df = spark.range(997).withColumnRenamed("id", "record_id")
    parts = {r.record_id: r.split for r in sp.split_records(df.repartition(7)).collect()}
    assert Counter(parts.values()) == {"train": 747, "val": 151, "test": 99}
    order = sorted(range(997), key=lambda i: py_digest(1337, i))
    assert {parts[i] for i in order[:747]} == {"train"} and {parts[i] for i in order[-99:]} == {"test"}
    assert parts == {r.record_id: r.split for r in sp.split_records(df.repartition(2)).collect()}
    loose = Counter(r.split for r in sp.split_records(df, exact=False).collect())
    assert abs(loose["train"] - 747) < 60 and sum(loose.values()) == 997
    few = spark.range(2).withColumnRenamed("id", "record_id")
    assert Counter(r.split for r in sp.split_records(few).collect()) == {"train": 1, "val": 1}


def test_exact_split_does_not_shuffle_the_data(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS record_id", "text")
    plan = sp.split_records(df)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main


def test_interleave(spark):
    a = spark.range(30).withColumnRenamed("id", "record_id")
    b = spark.range(7).withColumnRenamed("id", "record_id")
    once = sp.interleave({"a": a, "b": b})
    assert Counter((r.source, r.copy_no) for r in once.collect()) == {("a", 0): 30, ("b", 0): 7}
    mixed = sp.interleave({"a": a, "b": b, "none": a.limit(0)}, {"a": 0.5, "b": 0.5, "none": 0.0})
    rows = Counter((r.source, r.record_id) for r in mixed.collect())
    assert sum(n for (s, _), n in rows.items() if s == "b") == 30
    assert {n for (s, _), n in rows.items() if s == "a"} == {1}
    assert {n for (s, _), n in rows.items() if s == "b"} == {4, 5}
    assert mixed.select("source", "record_id", "copy_no").distinct().count() == 60
    assert sp.interleave({"a": a, "b": b}, {"a": 0.5, "b": 0.5}, ordered=True).count() == 60


def test_interleave_many_copies(spark, monkeypatch):
    a = spark.range(100).withColumnRenamed("id", "record_id")
    b = spark.range(3).withColumnRenamed("id", "record_id")
    weights = {"a": 0.5, "b": 0.5}
    plain = sp.interleave({"a": a, "b": b}, weights).collect()
    monkeypatch.setattr(sp, "COPIES_PER_BLOCK", 10)
    blocks = sp.interleave({"a": a, "b": b}, weights).collect()
    assert Counter(plain) == Counter(blocks) and len(blocks) == 200


def test_weights_shuffle_and_batches(spark):
    sizes = spark.createDataFrame([("a", 30), ("b", 10)], "source string, n long")
    assert {r.source: r.weight for r in sp.proportional_weights(sizes).collect()} == {"a": 0.75, "b": 0.25}
    df = spark.range(130).withColumnRenamed("id", "record_id")
    first, second = ([r.record_id for r in sp.shuffle_records(df, e).collect()] for e in (0, 1))
    assert first != second and sorted(first) == sorted(second) == list(range(130))
    assert first == sorted(range(130), key=lambda i: py_digest("1337:0", i))
    numbers = Counter(r.batch_no for r in sp.batches(df, 64).collect())
    assert numbers == {0: 64, 1: 64, 2: 2}
    grouped = sp.collate(df.withColumn("v", F.col("record_id") * 2), 64, ["v"]).collect()
    assert sorted(r.v for row in grouped for r in row.records) == [2 * i for i in range(130)]
    assert all(r.v == 2 * r.record_id for row in grouped for r in row.records)


# -- words -----------------------------------------------------------------------------


def test_keep_weight_falls_with_frequency(spark):
    v = vb.Vocabulary(spark.createDataFrame([("salt", 900), ("oak", 60), ("fern", 40)], COUNTS))
    w = {r.word: r.keep_prob for r in sp.keep_weights(v).collect()}
    assert w["salt"] < w["oak"] < w["fern"]
    f = 900 / 1000
    assert w["salt"] == pytest.approx((math.sqrt(f / 1e-4) + 1) * 1e-4 / f)


RECORD = ["<S>", "salt", "from", "nine", "mills", "<UNK>", ",", "salt", "by", "ship", ".", "</S>"]


@pytest.fixture(scope="module")
def heavy(spark):
    """A word that is nearly all of the corpus, and the words of the record."""
    rows = [(w, 2) for w in RECORD if w not in ("salt", "<UNK>")] + [("salt", 800_000)]
    return vb.Vocabulary(spark.createDataFrame(rows, COUNTS), min_freq=0)


@pytest.mark.parametrize("way", ["arrow", "join"])
def test_very_frequent_word_is_dropped(spark, heavy, way):
    ids = {r.word: r.id for r in heavy.encodable.collect()}
    record = [(1, [ids[w] for w in RECORD]), (2, []), (3, [ids["salt"]] * 3)]
    df = spark.createDataFrame(record, "record_id long, ids array<int>")
    thin = {r.record_id: r.ids for r in sp.subsample_ids(df, heavy, way=way).collect()}
    assert ids["salt"] not in thin[1] and len(thin[1]) < len(RECORD)
    kept = [i for i in record[0][1] if i != ids["salt"]]
    assert thin[1] == kept  # nothing else is dropped, and the order stays
    assert thin[2] == [] and thin[3] == []


def test_both_ways_of_thinning_agree(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id * 100 + turn AS record_id", "text")
    v = vb.Vocabulary(vb.word_counts(vb.tokenize_corpus(df)), size=500, special_tokens=["<S>", "</S>"])
    enc = en.Encoder(v).encode(df).select("record_id", "ids").cache()
    arrow = sorted((r.record_id, tuple(r.ids)) for r in sp.subsample_ids(enc, v, way="arrow").collect())
    monkeypatch.setattr(joins, "broadcast_fits", lambda *a: False)
    join = sorted((r.record_id, tuple(r.ids)) for r in sp.subsample_ids(enc, v, way="join").collect())
    assert arrow == join and sum(len(i) for _, i in arrow) < enc.agg(F.sum(F.size("ids"))).first()[0]


def test_negatives(spark):
    counts = spark.createDataFrame([(f"w{i}", 1000 // (i + 1)) for i in range(50)], COUNTS)
    v = vb.Vocabulary(counts, min_freq=1)
    table = sp.negative_distribution(v).orderBy("id").collect()
    total = sum((1000 // (i + 1)) ** 0.75 for i in range(50))
    assert table[0].prob == pytest.approx(1000**0.75 / total)
    assert table[0].low == 0 and table[-1].high == pytest.approx(1)
    assert all(a.high == pytest.approx(b.low) for a, b in zip(table, table[1:]))
    examples = spark.createDataFrame(
        [(i, 0, [1, 2, 3 + i % 4], 5 + i % 7) for i in range(4000)], "record_id long, start int, context array<int>, center int"
    )
    drawn = sp.draw_negatives(examples, sp.negative_distribution(v), k=5).collect()
    assert len(drawn) == 4000
    for r in drawn:
        assert len(set(r.negatives)) == 5 and not set(r.negatives) & {*r.context, r.center}
    seen = Counter(i for r in drawn for i in r.negatives)
    assert seen[4] > seen[20] > seen[48] > 0
    again = sp.draw_negatives(examples.repartition(3), sp.negative_distribution(v), k=5).collect()
    assert sorted(drawn) == sorted(again)
    few = vb.Vocabulary(counts.filter("cnt >= 200"), min_freq=1)
    short = sp.draw_negatives(examples.limit(3), sp.negative_distribution(few), k=5).collect()
    assert all(set(r.negatives) == {1, 2, 3, 4, 5} - {*r.context, r.center} for r in short)


# -- examples --------------------------------------------------------------------------


def windows_of(spark, seq, n):
    df = spark.createDataFrame([(1, seq)], "record_id long, ids array<int>")
    return [r.window for r in ex.context_windows(df, n).orderBy("start").collect()]


def test_windows(spark):
    squares = [k * k for k in range(13)]
    for n in (1, 2, 6):
        assert windows_of(spark, squares, n) == [squares[i : i + 2 * n + 1] for i in range(13 - 2 * n)]
    assert windows_of(spark, squares, 7) == windows_of(spark, [], 1) == windows_of(spark, [4, 9], 1) == []


def test_center(spark):
    df = spark.createDataFrame([(1, list(range(10, 15)))], "record_id long, ids array<int>")
    row = ex.split_center(ex.context_windows(df, 2), 2).first()
    assert (row.context, row.center) == ([10, 11, 13, 14], 12)


def test_cbow_counts_the_windows_of_whole_records(spark):
    df = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate([0, 8, 9, 30, 300])], "record_id long, ids array<int>")
    got = Counter(r.record_id for r in ex.cbow_examples(df, None, subsample=False).collect())
    assert got == {2: 1, 3: 22, 4: 292}
    cut = Counter(r.record_id for r in ex.cbow_examples(df, None, subsample=False, max_sequence_len=256).collect())
    assert cut == {2: 1, 3: 22, 4: 248}


def test_truncation_may_follow_thinning(spark, heavy):
    ids = {r.word: r.id for r in heavy.encodable.collect()}
    df = spark.createDataFrame([(1, [ids["salt"]] * 300 + [ids["ship"]] * 20)], "record_id long, ids array<int>")
    first = ex.prepare_sequences(df, heavy, max_sequence_len=256, truncate_first=True).first().ids
    whole = ex.prepare_sequences(df, heavy, max_sequence_len=256, truncate_first=False).first().ids
    assert ids["ship"] not in first and whole.count(ids["ship"]) == 20


def test_skipgram(spark):
    df = spark.createDataFrame([(i, list(range(20))) for i in range(40)], "record_id long, ids array<int>")
    windows = ex.skipgram_windows(df)
    reach = {}
    for r in windows.collect():
        reach.setdefault(r.record_id, set()).add(r.reach)
        span = list(range(r.start, r.start + 2 * r.reach + 1))
        assert r.center == span.pop(r.reach) and r.context == span
    assert all(len(s) == 1 for s in reach.values()) and set.union(*reach.values()) == {1, 2, 3, 4}
    pairs = ex.skipgram_pairs(windows.withColumn("negatives", F.array(F.lit(99), F.lit(98)))).collect()
    assert {p.label for p in pairs if p.target >= 98} == {0} and {p.label for p in pairs if p.target < 98} == {1}
    assert all(abs(p.target - p.center) <= 4 for p in pairs if p.label)


def test_examples_move_no_data(spark, heavy, tmp_path):
    path = str(tmp_path / "enc")
    spark.createDataFrame([("a:0", [0, 1, 2] * 10)], "record_id string, ids array<int>").write.parquet(path)
    stored = spark.read.parquet(path)
    plan = ex.cbow_examples(stored, heavy)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    mixed = sp.interleave({"a": stored, "b": stored}, {"a": 0.3, "b": 0.7})
    assert mixed.count() == 3 and mixed.filter("record_id = 'a:0'").count() == 3


def test_windows_of_one_long_record(spark):
    df = spark.range(1).select(F.col("id").alias("record_id"), F.sequence(F.lit(0), F.lit(299_999)).alias("ids"))
    assert ex.context_windows(df, 4).agg(F.count("*"), F.max("window")[0]).first()[:] == (299_992, 299_991)
