import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom import streaming
from wordloom.functions import text as tx
from wordloom.operators import reshape as rs
from wordloom.operators import vocabulary as vb
from wordloom.operators.encoding import Encoder
from wordloom.plans import build_vocab, clean_data, train
from wordloom.plans.recipes import RECIPES
from wordloom.schemas import METRICS
from wordloom.session import local_table, measured_bytes, shared_dir, spread
from wordloom.sources import corpora, run_logs

TEXTS = ["One here. Two there! ", "", "Dr. Who? “Ça va” he said.\nNew line", "x", None]


@pytest.fixture
def raw(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for name, corpus in corpora.MANAGED.items():
        df.write.parquet(str(tmp_path / "raw" / corpus.prefix / "train"))
    return tmp_path


# -- reshaping -------------------------------------------------------------------------


@pytest.mark.parametrize("value, dtype, expected", [
    ("rain,  then sun", "string", ["rain,  then sun"]),
    (["rain,  then sun"], "array<string>", ["rain,  then sun"]),
    ([["up"], [], ["down", "left"]], "array<array<string>>", ["up", "down", "left"]),
    (b"\x00\xff", "binary", [b"\x00\xff"]),
    ([[b"\x01"], [b"", b"\x02"]], "array<array<binary>>", [b"\x01", b"", b"\x02"]),
    (-4, "int", [-4]),
    ([12, -7, 12], "array<int>", [12, -7, 12]),
    ([[[1], []], [[2, 3]]], "array<array<array<int>>>", [1, 2, 3]),
    ([["a"], None, ["b", None]], "array<array<string>>", ["a", None, "b", None]),
    ([[[1], None], None], "array<array<array<int>>>", [1, None, None]),
    ([], "array<int>", []),
])
def test_flatten(spark, value, dtype, expected):
    df = spark.createDataFrame([(1, value)], f"k int, v {dtype}")
    got = [bytes(r.v) if isinstance(r.v, bytearray) else r.v for r in rs.flatten_column(df, "v").orderBy("item_no").collect()]
    assert got == expected


def test_map_records(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "c")], "record_id long, text string")
    many = rs.map_records(df, lambda c: F.filter(F.split(c, " "), lambda w: w != ""), position="n").collect()
    assert [(r.record_id, r.n, r.text) for r in many] == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]
    nested = rs.map_records(df, lambda c: F.array(F.split(c, " "), F.array(F.lit("z"))))
    assert Counter(r.text for r in nested.collect()) == {"a": 1, "b": 1, "z": 3, "": 1, "c": 1}
    assert [r.text for r in rs.map_records(df, F.upper).collect()] == ["A B", "", "C"]


def test_masks_and_lengths(spark):
    df = spark.createDataFrame([([1, 2, 3], [True, False, True])], "v array<int>, m array<boolean>")
    row = df.select(rs.mask_items("v", "m"), rs.truncate("v", 2), rs.truncate("v", 0), rs.long_enough("v", 1), rs.long_enough("v", 2)).first()
    assert list(row) == [[1, 3], [1, 2], [1, 2, 3], True, False]


# -- corpora ---------------------------------------------------------------------------


def test_registry_and_reading(spark, raw):
    assert list(corpora.MANAGED) == ["bookcorpus", "commoncrawl", "wikipedia"]
    df = corpora.read_corpus(spark, str(raw / "raw"), "wikipedia", split="train")
    assert df.columns == ["record_id", "text"] and df.count() == 5 and df.select("record_id").distinct().count() == 5
    named = corpora.Corpus(path="c4/realnewslike/train", record_id="doc_id", where="doc_id > 2")
    found = corpora.read_corpus(spark, str(raw / "raw"), named)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {r.record_id for r in found.collect()} == {3, 4} and "GreaterThan(doc_id,2)" in plan


def test_other_formats(spark, tmp_path):
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    (tmp_path / "j.json").write_text('{"id": 5, "body": "x", "other": 1}\n')
    text = corpora.read_corpus(spark, str(tmp_path), corpora.Corpus(path="t.txt", format="text"))
    assert sorted(r.text for r in text.collect()) == ["one", "two"]
    js = corpora.Corpus(path="j.json", format="json", key="body", record_id="id")
    assert [tuple(r) for r in corpora.read_corpus(spark, str(tmp_path), js).collect()] == [(5, "x")]


def test_prepare(spark, raw, tmp_path):
    df = corpora.read_corpus(spark, str(raw / "raw"), corpora.Corpus(path="bookcorpus/train", record_id="doc_id"))
    out = str(tmp_path / "clean")
    seen = corpora.prepare(df, out)
    saved = corpora.load_prepared(spark, out)
    assert seen == {"before": 5, "after": saved.count()}
    got = {(r.record_id, r.sent_no): r.text for r in saved.collect()}
    assert got == {(0, 0): "one here.", (0, 1): "two there!", (2, 0): "dr.", (2, 1): "who?", (2, 2): "“ca va” he said.", (2, 3): "new line", (3, 0): "x"}
    with pytest.raises(FileExistsError):
        corpora.prepare(df, out)
    with pytest.raises(FileNotFoundError):
        corpora.load_prepared(spark, str(tmp_path / "absent"))
    with pytest.raises(FileNotFoundError):
        corpora.load_prepared(spark, str(tmp_path), "wikipedia")
    twice = corpora.table_step(lambda t: t.unionByName(t))
    shards = str(tmp_path / "shards")
    many = spark.range(200).select(F.col("id").alias("record_id"), F.lit("a b").alias("text"))
    assert corpora.prepare(many, shards, [tx.normalize, twice], shards=4) == {"before": 200, "after": 400}
    assert corpora.load_prepared(spark, shards).select(F.input_file_name()).distinct().count() == 4


def test_recipes(spark):
    df = spark.createDataFrame(
        [(1, "I ca n't , he said . \u0007So ?\nReferences \nmore")], "record_id long, text string"
    )
    done = {}
    for name, steps in RECIPES.items():
        rows = corpora.apply_steps(df, steps)
        done[name] = [r.text for r in rows.orderBy(rows.columns[1] if "sent_no" in rows.columns else "record_id").collect()]
    assert done["bookcorpus"] == ["i can't, he said . so? references more"]
    assert done["commoncrawl"] == ["i ca n't , he said .", "so ?", "references  more"]
    assert done["wikipedia"] == ["i ca n't , he said .", "so ?"]


def test_jobs(spark, raw, tmp_path):
    root, out, vocabs = (str(tmp_path / d) for d in ("raw", "out", "vocab"))
    for name in corpora.MANAGED:
        seen = clean_data.main(["-d", name, "-s", "train", "--root", root, "--out", out])
        assert seen["before"] == 5
        path = build_vocab.main(["-d", name, "--data", out, "--out", vocabs])
        assert vb.Vocabulary.load(spark, path).table.count() >= 1
    merged = vb.merge_saved(spark, f"{vocabs}/*_vocab", special_tokens=["<S>", "</S>"], min_freq=1)
    assert [r.word for r in merged.special_table.orderBy("id").collect()] == ["<UNK>", "<S>", "</S>"]
    model = train.main([
        "--data", f"{out}/bookcorpus", f"{out}/c4/realnewslike", "--vocab", f"{vocabs}/*_vocab", "--out", str(tmp_path / "model"),
        "--min_freq", "1", "--dimension", "4",
    ])
    stored = [spark.read.parquet(f"{model}/encoded/{s}") for s in ("train", "val", "test")]
    total = sum(corpora.load_prepared(spark, f"{out}/{c}").count() for c in ("bookcorpus", "c4/realnewslike"))
    assert sum(s.count() for s in stored) == total
    assert len(spark.read.parquet(f"{model}/vectors").first().vector) == 4


def test_ngram_passes(spark):
    rows = [(i, "new york city is big. new york city is far") for i in range(3)] + [(9, "once")]
    df = spark.createDataFrame(rows, "record_id long, text string")
    found = {r.word: r.cnt for r in build_vocab.count_passes(df).collect()}
    assert found["new"] == 6 and found["new york"] == 6 and found["new york city"] == 6 and found["is big"] == 3
    assert "once" not in found and "big ." not in found and "big . new" not in found
    small = {r.word for r in build_vocab.count_passes(df, size=4, store_tokens=False).collect()}
    # the list holds the unknown token and three words: city, is, new
    assert {w for w in small if " " in w} == {"city is"}


# -- logs ------------------------------------------------------------------------------


def test_metrics(spark, tmp_path):
    rows = [("r1", p, e, i, float(e * 10 + i)) for p in ("train", "val") for e in (0, 1) for i in range(50)] + [("r1", "val", 2, None, 7.0)]
    log = spark.createDataFrame(rows, METRICS)
    path = str(tmp_path / "metrics")
    run_logs.append_metrics(run_logs.logged_steps(log), path)
    run_logs.append_metrics(log.limit(0), path)
    saved = run_logs.read_metrics(spark, path)
    assert Counter(r.step for r in saved.collect()) == {24: 4, 49: 4, None: 1}
    run_logs.write_loss_history(log, str(tmp_path / "loss"))
    lines = [json.loads(x) for f in (tmp_path / "loss").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"run": "r1", "train": [24.5, 34.5], "val": [24.5, 34.5, 7.0]}]


# -- session ---------------------------------------------------------------------------


def test_session_helpers(spark, sf):
    assert shared_dir(spark, "a") != shared_dir(spark, "a")
    assert shared_dir(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))
    one = spark.read.parquet(f"{sf}/documents.parquet")
    wide = spread(one, "doc_id")
    assert wide.rdd.getNumPartitions() == 16 and spread(wide, "doc_id") is wide
    small = local_table(spark, [(1, "ab"), (2, None)], "a int, b string")
    assert [tuple(r) for r in small.collect()] == [(1, "ab"), (2, None)]
    assert measured_bytes(small) == 2 * 16 + 2
    assert "LocalTableScan" in small._jdf.queryExecution().executedPlan().toString()


# -- streams ---------------------------------------------------------------------------


@pytest.fixture
def arriving(spark, tmp_path):
    folder = tmp_path / "in"
    for i, text in enumerate(["a b a", "b c.", "a"]):
        spark.createDataFrame([(i, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    return streaming.read_stream(spark, str(folder), schema, "text", "doc_id"), folder


def test_stream_counts(spark, arriving, tmp_path):
    stream, folder = arriving
    path, check = str(tmp_path / "counts"), str(tmp_path / "check")
    streaming.collect_counts(stream, path, check).awaitTermination()
    expected = {"a": 3, "b": 2, "c": 1, ".": 1}
    assert {r.word: r.cnt for r in streaming.collected_counts(spark, path).collect()} == expected
    # a second run sees only what is new
    spark.createDataFrame([(7, "c")], "doc_id long, text string").write.mode("append").parquet(str(folder))
    streaming.collect_counts(stream, path, check).awaitTermination()
    assert {r.word: r.cnt for r in streaming.collected_counts(spark, path).collect()} == {**expected, "c": 2}
    streaming.compact_counts(spark, path, str(tmp_path / "compact"))
    assert {r.word: r.cnt for r in streaming.collected_counts(spark, str(tmp_path / "compact")).collect()} == {**expected, "c": 2}


def test_stream_state(spark, arriving, tmp_path):
    stream, _ = arriving
    query = (
        streaming.running_counts(stream).writeStream.format("memory").queryName("running").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {r.word: r.cnt for r in spark.table("running").collect()} == {"a": 3, "b": 2, "c": 1, ".": 1}


def test_stream_clean_and_encode(spark, arriving, tmp_path):
    stream, _ = arriving
    path = str(tmp_path / "clean")
    cleaned = streaming.clean_stream(stream, RECIPES["commoncrawl"])
    streaming.append_stream(cleaned, path, str(tmp_path / "c1")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(path).collect()) == ["a", "a b a", "b c."]
    vocab = vb.Vocabulary(spark.createDataFrame([("a", 5), ("b", 4)], "word string, cnt long"), special_tokens=["<S>", "</S>"])
    encoder = Encoder(vocab)
    streaming.append_stream(streaming.encode_stream(stream, encoder), str(tmp_path / "ids"), str(tmp_path / "c2")).awaitTermination()
    got = {r.record_id: r.ids for r in spark.read.parquet(str(tmp_path / "ids")).collect()}
    assert got == {0: [1, 3, 4, 3, 2], 1: [1, 4, 0, 0, 2], 2: [1, 3, 2]}


# -- ids of records without one --------------------------------------------------------


def test_content_ids_do_not_depend_on_the_layout(spark, tmp_path):
    texts = [f"text {i % 40}" for i in range(90)] + [None, None, "", "only once"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = []
    for name, files in (("a", 1), ("b", 6)):
        df.repartition(files).sortWithinPartitions(F.rand(files)).write.parquet(str(tmp_path / name))
        rows = corpora.read_corpus(spark, str(tmp_path), corpora.Corpus(path=name)).collect()
        assert len({r.record_id for r in rows}) == len(rows) == len(texts)
        found.append(sorted(((r.record_id, r.text) for r in rows), key=str))
    assert found[0] == found[1]
    stored = corpora.read_corpus(spark, str(tmp_path), corpora.Corpus(path="b"), ids="storage")
    assert sorted(stored.collect(), key=str) == sorted(stored.collect(), key=str)
    assert len({r.record_id for r in stored.collect()}) == len(texts)
    with pytest.raises(ValueError, match="content or storage"):
        corpora.read_corpus(spark, str(tmp_path), corpora.Corpus(path="b"), ids="row")


def test_running_counts_go_on_from_their_checkpoint(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    streaming.use_disk_state(spark)
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    arrive, counts, check = (str(tmp_path / x) for x in ("arrive", "counts", "check"))
    try:
        texts = ["one two two", "three one", "two", "four four one"]
        for i in (0, 2):
            spark.createDataFrame(list(enumerate(texts))[i : i + 2], schema).write.mode("append").parquet(arrive)
            stream = streaming.read_stream(spark, arrive, schema, "text", "doc_id")
            streaming.keep_running_counts(stream, counts, check).awaitTermination()
        expected = {"one": 3, "two": 3, "three": 1, "four": 2}
        assert {r.word: r["cnt"] for r in streaming.running_total(spark, counts).collect()} == expected
        assert {r.word for r in spark.read.parquet(f"{counts}/batch_id=1").collect()} == {"one", "two", "four"}  # what changed
        folded = str(tmp_path / "folded")
        assert streaming.compact_running(spark, counts, folded, 0) == 1
        assert {r.word: r["cnt"] for r in streaming.running_total(spark, folded).collect()} == expected
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
