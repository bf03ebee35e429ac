import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import encoding as en
from wordloom.operators import examples as ex
from wordloom.operators import joins
from wordloom.operators import vocabulary as vb
from wordloom.schemas import COUNTS

OPTIONS = {"special_tokens": ["<S>", "</S>"], "min_freq": 2}
ROWS = [(1, "The cat, the dog."), (2, ""), (3, "zebra CAT"), (4, None), (5, "rare the")]


@pytest.fixture(scope="module")
def vocab(spark):
    return vb.Vocabulary(
        spark.createDataFrame([("the", 9), ("cat", 5), (",", 4), ("dog", 3), ("rare", 1)], COUNTS), **OPTIONS
    )


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, "record_id long, text string").repartition(3)


EXPECTED = {
    1: (["<S>", "the", "cat", ",", "the", "dog", "<UNK>", "</S>"], [1, 3, 4, 5, 3, 6, 0, 2]),
    2: (["<S>", "</S>"], [1, 2]),
    3: (["<S>", "<UNK>", "cat", "</S>"], [1, 0, 4, 2]),
    4: (["<S>", "</S>"], [1, 2]),
    5: (["<S>", "<UNK>", "the", "</S>"], [1, 0, 3, 2]),
}


@pytest.mark.parametrize("way", ["arrow", "join", "salted"])
def test_encode(corpus, vocab, way, monkeypatch):
    if way == "salted":
        monkeypatch.setattr(joins, "broadcast_fits", lambda *a: False)
        way = "join"
    rows = en.Encoder(vocab).encode(corpus, way=way).collect()
    assert {r.record_id: (r.tokens, r.ids) for r in rows} == EXPECTED
    assert all(r.attention_mask == [1] * len(r.ids) for r in rows) and len(rows) == 5


@pytest.mark.parametrize("way", ["arrow", "join"])
def test_ids_alone(corpus, vocab, way):
    rows = en.Encoder(vocab).encode(corpus, way=way, with_tokens=False)
    assert rows.columns == ["record_id", "ids", "attention_mask"]
    assert {r.record_id: r.ids for r in rows.collect()} == {k: ids for k, (_, ids) in EXPECTED.items()}


def test_a_vocabulary_in_many_blocks_gives_the_same_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id AS record_id", "text")  # repeated ids
    v = vb.Vocabulary(vb.word_counts(vb.tokenize_corpus(docs)), size=3000, special_tokens=["<S>", "</S>"])
    one, many = en.Encoder(v), en.Encoder(v, block_bytes=1_500)
    assert len(one._ship()[0]) == 1 and len(many._ship()[0]) > 4
    rows = [sorted(map(str, e.encode(docs.repartition(3)).collect())) for e in (one, many)]
    assert rows[0] == rows[1] and "Exchange" not in many.encode(docs)._jdf.queryExecution().executedPlan().toString()
    thin = [sorted(map(str, e.encode(docs.repartition(3), thinning=en.Thinning()).collect())) for e in (one, many)]
    assert thin[0] == thin[1] != rows[0]
    ids = one.encode(docs, with_tokens=False).withColumn("kept", F.lit(1))
    words = [sorted(map(str, en.decode(ids.repartition(3), v, block_bytes=b).collect())) for b in (1 << 26, 1_500)]
    assert words[0] == words[1]
    assert sorted(r.tokens for r in one.encode(docs).collect()) == sorted(r.tokens for r in en.decode(ids, v).collect())


def test_thinning_while_encoding_equals_thinning_afterwards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS record_id", "text")
    counts = vb.word_counts(vb.tokenize_corpus(docs))
    counts = counts.union(spark.createDataFrame([("<S>", 900), ("</S>", 5)], "word string, cnt long")).cache()
    v = vb.Vocabulary(counts, size=800, special_tokens=["<S>", "</S>"])
    encoder = en.Encoder(v)
    for n, longest in ((0, 0), (6, 0), (6, 40)):
        apart = ex.prepare_sequences(encoder.encode(docs), v, n, longest)
        thinning = en.Thinning(shortest=2 * n + 1, longest=longest)
        at_once = encoder.encode(docs, thinning=thinning)
        assert at_once.columns == ["record_id", "ids"]
        assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, apart.collect()))
        assert at_once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_text_can_stay(corpus, vocab):
    rows = en.Encoder(vocab).encode(corpus, keep_text=True)
    assert rows.columns == ["record_id", "text", "ids", "tokens", "attention_mask"]
    assert {r.record_id: r.text for r in rows.collect()} == {r.record_id: r.text for r in corpus.collect()}


def test_small_vocabulary_moves_no_data(corpus, vocab, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS record_id", "text")
    plan = en.Encoder(vocab).encode(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_encoder_needs_specials(spark, vocab):
    with pytest.raises(ValueError):
        en.Encoder(vb.Vocabulary(vocab.counts))
    with pytest.raises(ValueError):
        en.Encoder(vb.Vocabulary(vocab.counts, unk_token=None, special_tokens=["<S>", "</S>"]))


@pytest.mark.parametrize("way", ["arrow", "join"])
def test_pairs(spark, vocab, way):
    df = spark.createDataFrame([(1, "the cat", ""), (2, "dog", "the, x")], "k int, a string, b string")
    rows = {r.k: r for r in en.Encoder(vocab).encode_pair(df, "a", "b", way).collect()}
    assert rows[1].tokens == ["<S>", "the", "cat", "</S>", "<S>", "</S>"] and rows[1].type_ids == [0, 0, 0, 0, 1, 1]
    assert rows[2].ids == [1, 6, 2, 1, 3, 5, 0, 2] and rows[2].attention_mask == [1] * 8


def test_decode(spark, vocab):
    df = spark.createDataFrame([(1, [1, 4, 0, 2]), (2, []), (3, [99, -1])], "record_id long, ids array<int>")
    rows = {r.record_id: r.tokens for r in en.decode(df, vocab).collect()}
    assert rows == {1: ["<S>", "cat", "<UNK>", "</S>"], 2: [], 3: ["<UNK>", "rare"]}


def test_own_splitter(corpus, vocab):
    encoder = en.Encoder(vocab, splitter=lambda c: F.split(c, " "), normalizer=tx.lowercase)
    rows = {r.record_id: r.tokens for r in encoder.encode(corpus).collect()}
    assert rows[1] == ["<S>", "the", "<UNK>", "the", "<UNK>", "</S>"]


def test_agrees_with_tokenizer_library(spark, vocab, corpus):
    hf = pytest.importorskip("tokenizers")
    words = {r.word: r.id for r in vocab.encodable.collect()}
    tok = hf.Tokenizer(hf.models.WordLevel(vocab=words, unk_token="<UNK>"))
    n = hf.normalizers
    tok.normalizer = n.Sequence([n.NFKD(), n.StripAccents(), n.Lowercase(), n.Replace(hf.Regex(r"[\s]"), " ")])
    tok.pre_tokenizer = hf.pre_tokenizers.Sequence([hf.pre_tokenizers.Whitespace(), hf.pre_tokenizers.Punctuation()])
    tok.post_processor = hf.processors.TemplateProcessing(
        single="<S> $0 </S>", pair="<S> $A <S> </S> $B:1 </S>:1", special_tokens=[("<S>", 1), ("</S>", 2)]
    )
    got = {r.record_id: (r.ids, r.tokens, r.attention_mask) for r in en.Encoder(vocab).encode(corpus).collect()}
    for key, text in ROWS:
        if text is not None:
            out = tok.encode(text)
            assert got[key] == (out.ids, out.tokens, out.attention_mask)


def test_repeated_ids_are_records_of_their_own(spark, vocab):
    df = spark.createDataFrame([(1, "the cat"), (1, "dog")], "record_id long, text string")
    for block_bytes in (1 << 26, 10):
        encoded = en.Encoder(vocab, block_bytes=block_bytes).encode(df)
        assert encoded.count() == 2 == en.decode(encoded, vocab, block_bytes=block_bytes).count()
    with pytest.raises(Exception, match="unique ids"):
        en.Encoder(vocab).encode(df, way="join").collect()


def test_decoding_without_an_unknown_token(spark, vocab):
    v = vb.Vocabulary(vocab.counts, unk_token=None)
    ids = spark.createDataFrame([([0, -1],)], "ids array<int>")
    assert en.decode(ids, v).first().tokens == [v[0], v[-1]]
    with pytest.raises(Exception, match="no word has the id"):
        en.decode(spark.createDataFrame([([0, 99],)], "ids array<int>"), v).collect()


def test_the_join_way_moves_records_and_no_items(spark, corpus, vocab):
    found = en.Encoder(vocab).encode(corpus, way="join")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(record_id") == 1
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning(record_id")
