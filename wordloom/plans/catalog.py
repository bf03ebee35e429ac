"""Every operator as a query over the tables of a data folder.

Arrays are returned as joined text and doubles rounded, so that results compare across
engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom import streaming
from wordloom.functions import text as tx
from wordloom.functions.numeric import gelu, gradient, leaky_relu, relu, sigmoid, swish, tanh
from wordloom.operators import examples as ex
from wordloom.operators import metrics as mt
from wordloom.operators import reshape as rs
from wordloom.operators import sampling as sp
from wordloom.operators import statistics as st
from wordloom.operators import subwords as sw
from wordloom.operators import training as tn
from wordloom.operators import vectors as vc
from wordloom.operators import vocabulary as vb
from wordloom.operators.encoding import Encoder, Thinning, conversation_pairs, decode
from wordloom.operators.ranking import row_numbers, shuffled_positions
from wordloom.plans import build_vocab, clean_data, train
from wordloom.plans.recipes import RECIPES
from wordloom.schemas import END_TOKEN, START_TOKEN
from wordloom.session import local_table, materialize, shared_dir, spread
from wordloom.sources import corpora, run_logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# small enough that the size limit cuts the vocabulary of the small tables
SIZE = 5000
SPECIALS = [START_TOKEN, END_TOKEN]
PIECE_MERGES = 48
N = 4


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- inputs ----------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, where: str | None = None) -> DataFrame:
    corpus = corpora.Corpus(path="documents.parquet", record_id="doc_id", where=where)
    return spread(corpora.read_corpus(spark, sf, corpus), "record_id")


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return spread(rs.select_key(table(spark, sf, "benchmark"), record_id="item_id"), "record_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as a corpus."""
    t = table(spark, sf, "conversations")
    return spread(t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"), "text"), "record_id")


def registry() -> dict[str, corpora.Corpus]:
    """The managed names over the documents; each language, known or not, is in one of them."""
    chosen = {"bookcorpus": "lang = 'en'", "commoncrawl": "lang IS NULL OR lang NOT IN ('en', 'fr')", "wikipedia": "lang = 'fr'"}
    return {
        name: corpora.Corpus(path="documents.parquet", record_id="doc_id", where=where, recipe=name)
        for name, where in chosen.items()
    }


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return vb.word_counts(vb.tokenize_corpus(documents(spark, sf)))


def stored_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts as a table, for queries whose parts each need them."""
    return materialize(counts(spark, sf), "counts")


def vocabulary(spark: SparkSession, sf: str, stored: bool = True) -> vb.Vocabulary:
    found = stored_counts(spark, sf) if stored else counts(spark, sf)
    return vb.Vocabulary(found, size=SIZE, special_tokens=SPECIALS)


def encoded(spark: SparkSession, sf: str, vocab: vb.Vocabulary, way: str = "arrow") -> DataFrame:
    return Encoder(vocab).encode(documents(spark, sf), way=way)


def sequences(spark: SparkSession, sf: str, vocab: vb.Vocabulary) -> DataFrame:
    """Encoded documents without the text of their tokens."""
    return Encoder(vocab).encode(documents(spark, sf), with_tokens=False)


def other_words(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of the conversations: a second corpus to look up."""
    return vb.word_counts(vb.tokenize_corpus(turns(spark, sf))).select("word")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def components(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select(
        "id", "label", F.posexplode("vector").alias("pos", "v")
    ).select("id", "label", "pos", F.col("v").cast("double").alias("x"))


def losses(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a loss log: type is the run, day the epoch, id the step."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("run"),
        F.when(F.col("user_id") % 4 == 0, "val").otherwise("train").alias("phase"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("epoch"),
        F.col("event_id").cast("int").alias("step"),
        F.col("value").alias("loss"),
    )


def joined(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), " ")


def rounded(df: DataFrame, *columns: str, places: int = 6, nudge: float = 0.0) -> DataFrame:
    """Round columns; a nudge settles values that lie exactly between two results."""
    return df.withColumns({c: F.round(F.col(c) + nudge if nudge else F.col(c), places) for c in columns})


# -- sources and sinks -----------------------------------------------------------------


@query
def load_corpus(spark, sf):
    return corpora.read_corpus(spark, sf, corpora.Corpus(path="documents.parquet", record_id="doc_id"))


@query
def corpus_registry(spark, sf):
    parts = [
        corpora.n_records(corpora.read_corpus(spark, sf, c)).withColumn("corpus", F.lit(name))
        for name, c in registry().items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def prepare_corpus(spark, sf):
    out = shared_dir(spark, "prepared")
    steps = [tx.normalize, partial(tx.split_sentences, kind="plain")]
    corpora.prepare(documents(spark, sf), out, steps)
    return corpora.load_prepared(spark, out).select("record_id", "sent_no", "text")


@query
def save_shards(spark, sf):
    out = shared_dir(spark, "shards")
    corpora.prepare(documents(spark, sf), out, [tx.normalize], shards=32)
    saved = corpora.load_prepared(spark, out).withColumn("file", F.input_file_name())
    return saved.agg(F.countDistinct("file").alias("n_files"), F.count("*").alias("n_records"))


@query
def refuse_overwrite(spark, sf):
    """A corpus is prepared once; the second time is refused and leaves what there is."""
    path, refused = shared_dir(spark, "once"), 0
    for step in (tx.normalize, tx.lowercase):
        try:
            corpora.prepare(documents(spark, sf), path, [step])
        except FileExistsError:
            refused += 1
    kept = corpora.load_prepared(spark, path).agg(F.count("*").alias("n_records"), F.sum(F.length("text")).alias("n_chars"))
    return kept.withColumn("refused", F.lit(refused))


@query
def vocabulary_items(spark, sf):
    """One word or one id at a time, as from a dictionary."""
    vocab = vocabulary(spark, sf)
    asked = ["<S>", "the", "de", "no such word", 0, 1, 7, SIZE - 1, SIZE + 5, -1]
    rows = [(str(item), str(vocab[item])) for item in asked]
    return local_table(spark, rows, "item string, found string")


@query
def count_records(spark, sf):
    steps = [tx.normalize, partial(tx.split_sentences, kind="plain")]
    seen = corpora.prepare(documents(spark, sf), shared_dir(spark, "counted"), steps)
    return local_table(spark, list(seen.items()), "stage string, n_records bigint")


@query
def save_load_vocabulary(spark, sf):
    path = shared_dir(spark, "vocab")
    vocabulary(spark, sf, stored=False).save(path)
    return vb.Vocabulary.load(spark, path).table


@query
def merge_vocabularies(spark, sf):
    root = shared_dir(spark, "vocabs")
    for name, corpus in (("documents", documents), ("turns", turns), ("benchmark", benchmark)):
        found = vb.word_counts(vb.tokenize_corpus(corpus(spark, sf)))
        vb.Vocabulary(found, size=SIZE).save(f"{root}/{name}_vocab")
    merged = vb.merge_saved(
        spark, f"{root}/*_vocab", above=1, size=SIZE, min_freq=5, special_tokens=SPECIALS
    )
    return merged.table


@query
def log_metrics(spark, sf):
    path = shared_dir(spark, "metrics")
    run_logs.append_metrics(run_logs.logged_steps(losses(spark, sf)), path)
    return run_logs.read_metrics(spark, path)


@query
def loss_history(spark, sf):
    path = shared_dir(spark, "history")
    run_logs.write_loss_history(losses(spark, sf), path)
    schema = "run string, train array<double>, val array<double>"
    history = spark.read.schema(schema).json(path)
    lists = history.select("run", F.explode(F.create_map(F.lit("train"), "train", F.lit("val"), "val")).alias("phase", "l"))
    items = lists.select("run", "phase", F.posexplode("l").alias("epoch_no", "loss"))
    return rounded(items, "loss", places=9, nudge=1e-11)


@query
def model_checkpoints(spark, sf):
    path = shared_dir(spark, "model")
    vocab = vocabulary(spark, sf)
    stored = materialize(encoded(spark, sf, vocab), "encoded")
    vc.train_with_checkpoints(stored, path, epochs=2, every=1, dimension=8)
    rows = []
    for name in (vc.checkpoint_name(1, 2), vc.checkpoint_name(2, 2), "model"):
        saved = vc.Word2VecModel.load(f"{path}/{name}").getVectors()
        rows.append(saved.agg(F.count("*").alias("n_vectors")).withColumn("saved", F.lit(name)))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def clean_data_job(spark, sf):
    out = shared_dir(spark, "clean")
    everything = {"bookcorpus": corpora.Corpus(path="documents.parquet", record_id="doc_id", recipe="bookcorpus")}
    clean_data.main(["-d", "bookcorpus", "--root", sf, "--out", out], everything)
    return corpora.load_prepared(spark, out, everything["bookcorpus"]).select("record_id", "text")


@query
def build_vocab_job(spark, sf):
    out = shared_dir(spark, "built")
    everything = {"commoncrawl": corpora.Corpus(path="documents.parquet", record_id="doc_id")}
    source = shared_dir(spark, "source")
    corpora.prepare(documents(spark, sf), source, [tx.normalize])
    path = build_vocab.main(["-d", "commoncrawl", "-i", source, "--out", out], everything)
    return vb.Vocabulary.load(spark, path).table


# -- projection, filters, reshaping ----------------------------------------------------


@query
def map_records(spark, sf):
    words = rs.map_records(turns(spark, sf), tx.parse_words, "text", "pos")
    return words.select("record_id", "pos", "text")


@query
def flatten_nested(spark, sf):
    lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    flat = rs.flatten_column(documents(spark, sf).select("record_id", lines.alias("item")), "item")
    return flat.groupBy("record_id").agg(
        F.count("*").alias("n_items"),
        F.max("item_no").alias("last"),
        F.sum(F.length("item") * F.col("item_no")).alias("weighed"),
    )


@query
def drop_hapax(spark, sf):
    return rs.drop_rare(counts(spark, sf))


@query
def infrequent_words(spark, sf):
    return vocabulary(spark, sf, stored=False).infrequent


@query
def fitting_records(spark, sf):
    enc = sequences(spark, sf, vocabulary(spark, sf)).filter(rs.long_enough("ids", N))
    return enc.select("record_id", F.size("ids").alias("n_ids"), joined(rs.truncate("ids", 256)).alias("ids"))


@query
def member_bigrams(spark, sf):
    members = vocabulary(spark, sf).table.select("word")
    return rs.member_ngrams(vb.tokenize_corpus(turns(spark, sf)), members, 2)


@query
def member_trigrams(spark, sf):
    members = vocabulary(spark, sf).table.select("word")
    return rs.member_ngrams(vb.tokenize_corpus(turns(spark, sf)), members, 3)


@query
def mask_tokens(spark, sf):
    tokens = vb.tokenize_corpus(documents(spark, sf))
    masked = tokens.withColumn("mask", F.transform("tokens", lambda w: F.length(w) > 3))
    return masked.select("record_id", joined(rs.mask_items("tokens", "mask")).alias("tokens"))


# -- text ------------------------------------------------------------------------------


def with_controls(spark, sf) -> DataFrame:
    """Documents with control and format characters between their lines."""
    marks = {0: "\u0007", 1: "\u200b\t", 2: "\u2028\r", 3: "\u00a0"}
    mark = F.lit(marks[0])
    for rest, value in marks.items():
        mark = F.when(F.col("record_id") % 4 == rest, value).otherwise(mark)
    return documents(spark, sf).select(
        "record_id", F.concat(mark, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), mark))).alias("text")
    )


@query
def prenormalize(spark, sf):
    return with_controls(spark, sf).select("record_id", tx.prenormalize("text").alias("text"))


@query
def decompose(spark, sf):
    return documents(spark, sf).select("record_id", F.length(tx.nfkd("text")).alias("n_chars"))


@query
def strip_accents(spark, sf):
    parted = documents(spark, sf).withColumn("parted", tx.nfkd("text"))
    return parted.select("record_id", tx.strip_accents("parted").alias("text"))


@query
def lowercase(spark, sf):
    return documents(spark, sf).select("record_id", tx.lowercase("text").alias("text"))


@query
def drop_control(spark, sf):
    return with_controls(spark, sf).select("record_id", tx.drop_control("text").alias("text"))


@query
def blank_whitespace(spark, sf):
    return with_controls(spark, sf).select("record_id", tx.blank_whitespace("text").alias("text"))


@query
def normalize_text(spark, sf):
    return documents(spark, sf).select("record_id", tx.normalize("text").alias("text"))


@query
def split_sentences(spark, sf):
    found = rs.map_records(documents(spark, sf), tx.parse_sentences, "text", "sent_no")
    return found.select("record_id", "sent_no", F.regexp_replace("text", " +", " ").alias("text"))


@query
def split_sentences_plain(spark, sf):
    plain = partial(tx.split_sentences, kind="plain")
    found = rs.map_records(documents(spark, sf), partial(tx.parse_sentences, splitter=plain), "text", "sent_no")
    return found.select("record_id", "sent_no", "text")


def sentence_model():
    """Stands for a model that a user loads once per task."""
    end = re.compile(r"(?<=[.!?])\s+(?=\S)")
    return lambda text: [s for s in (part.strip(" ") for part in end.split(text)) if s]


@query
def split_sentences_model(spark, sf):
    model = tx.from_python(sentence_model, "array<string>")
    normal = documents(spark, sf).withColumn("text", tx.normalize("text"))
    found = rs.map_records(normal, model, "text", "sent_no")
    return found.select("record_id", "sent_no", "text")


@query
def split_words(spark, sf):
    return vb.tokenize_corpus(documents(spark, sf)).select("record_id", tx.join_words("tokens").alias("words"))


def articles(spark, sf) -> DataFrame:
    """Documents with closing sections, each kind in some of them."""
    tail = F.concat(F.lit(" \nFirst\nExternal links \n"), F.col("text"))
    heads = ["See also", "Notes", "FootNotes", "References", "Further reading", "Works Cited"]
    text = F.col("text")
    for i, head in enumerate(heads):
        gap = "\r\n" if i % 2 else " \n"
        text = F.when(F.col("record_id") % 7 == i, F.concat("text", F.lit(f"\n{head}{gap}"), tail)).otherwise(text)
    return documents(spark, sf).select("record_id", text.alias("text"))


@query
def article_bodies(spark, sf):
    return articles(spark, sf).select("record_id", tx.article_body("text").alias("text"))


def tokenized_books(spark, sf) -> DataFrame:
    """Documents with spaced punctuation and split contractions."""
    spaced = F.regexp_replace("text", r"([.,!?;:%])", " $1 ")
    tail = F.lit(" `` he ca n't say ( now ) '' , it 's 5 % of $ 7 -- wan na ? ")
    return documents(spark, sf).select("record_id", F.concat(spaced, tail).alias("text"))


@query
def detokenize(spark, sf):
    return tokenized_books(spark, sf).select("record_id", tx.detokenize("text").alias("text"))


@query
def recipe_bookcorpus(spark, sf):
    return corpora.apply_steps(tokenized_books(spark, sf), RECIPES["bookcorpus"]).select("record_id", "text")


@query
def recipe_commoncrawl(spark, sf):
    done = corpora.apply_steps(documents(spark, sf), RECIPES["commoncrawl"])
    return done.select("record_id", "sent_no", F.length(F.regexp_replace("text", " +", " ")).alias("n_chars"))


@query
def recipe_wikipedia(spark, sf):
    done = corpora.apply_steps(articles(spark, sf), RECIPES["wikipedia"])
    return done.select("record_id", "sent_no", F.regexp_replace("text", " +", " ").alias("text"))


# -- lookups ---------------------------------------------------------------------------


@query
def lookup_ids(spark, sf):
    return vocabulary(spark, sf).word_to_id(other_words(spark, sf))


@query
def missing_words(spark, sf):
    return vocabulary(spark, sf).missing(other_words(spark, sf))


@query
def contained_words(spark, sf):
    return vocabulary(spark, sf).contains(other_words(spark, sf))


@query
def lookup_weights(spark, sf):
    weights = sp.keep_weights(vocabulary(spark, sf)).select("word", "keep_prob")
    found = other_words(spark, sf).join(weights, "word", "left")
    return rounded(found.withColumn("keep_prob", F.coalesce("keep_prob", F.lit(1.0))), "keep_prob")


@query
def delete_words(spark, sf):
    return vocabulary(spark, sf).delete(".", "the", "de").table


@query
def look_up_vectors(spark, sf):
    rows = sequences(spark, sf, vocabulary(spark, sf)).select("record_id", F.posexplode("ids").alias("pos", "id"))
    found = vc.look_up_vectors(rows, vectors(spark, sf))
    return found.groupBy("record_id").agg(
        F.count("*").alias("n_rows"), F.count("vector").alias("n_found"),
        F.round(F.sum(F.col("vector")[0].cast("double")), 6).alias("sum_first"),
    )


# -- vocabulary ------------------------------------------------------------------------


@query
def word_count(spark, sf):
    return counts(spark, sf)


@query
def word_count_rollup(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    tokens = docs.select("lang", tx.parse_words("text").alias("tokens"))
    return vb.word_counts_rollup(tokens, "lang")


@query
def ngram_passes(spark, sf):
    found = build_vocab.count_passes(documents(spark, sf), size=SIZE)
    return found.withColumn("n", build_vocab.ngram_order("word"))


@query
def vocabulary_table(spark, sf):
    return vocabulary(spark, sf, stored=False).table


@query
def update_vocabulary(spark, sf):
    more = vb.word_counts(vb.tokenize_corpus(turns(spark, sf)))
    return vocabulary(spark, sf, stored=False).update(more).table


@query
def id_to_word(spark, sf):
    asked = vectors(spark, sf).select((F.col("id") * 13 - 40).alias("id"))
    return vocabulary(spark, sf).id_to_word(asked)


@query
def word_frequency(spark, sf):
    return vocabulary(spark, sf).word_frequency(other_words(spark, sf))


@query
def encodable_words(spark, sf):
    return vocabulary(spark, sf, stored=False).encodable


@query
def vocabulary_summary(spark, sf):
    vocab = vocabulary(spark, sf)
    heads = vocab.special_table.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"]), " ")
    )
    return vocab.length().select(
        "length",
        vb.total_count(vocab.counts).scalar().alias("total"),
        vocab.infrequent.agg(F.count("*")).scalar().alias("n_infrequent"),
        heads.scalar().alias("specials"),
    )


@query
def count_frequencies(spark, sf):
    return vb.count_frequencies(counts(spark, sf))


# -- encoding --------------------------------------------------------------------------


def shown(enc: DataFrame) -> DataFrame:
    return enc.select(
        "record_id",
        joined("ids").alias("ids"),
        joined("tokens").alias("tokens"),
        F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("attended"),
    )


@query
def encode_documents(spark, sf):
    return shown(encoded(spark, sf, vocabulary(spark, sf), "arrow"))


@query
def encode_documents_join(spark, sf):
    return shown(encoded(spark, sf, vocabulary(spark, sf), "join"))


@query
def encode_pairs(spark, sf):
    pairs = conversation_pairs(table(spark, sf, "conversations"))
    enc = Encoder(vocabulary(spark, sf)).encode_pair(pairs, "first", "second")
    return enc.select("conv_id", "turn", joined("ids").alias("ids"), joined("type_ids").alias("type_ids"))


@query
def decode_ids(spark, sf):
    vocab = vocabulary(spark, sf)
    return decode(sequences(spark, sf, vocab), vocab).select("record_id", joined("tokens").alias("tokens"))


# -- splits, mixes, samples ------------------------------------------------------------


@query
def split_exact(spark, sf):
    return sp.split_records(documents(spark, sf)).select("record_id", "split")


@query
def split_by_share(spark, sf):
    return sp.split_records(documents(spark, sf), exact=False).select("record_id", "split")


@query
def proportional_weights(spark, sf):
    sizes = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return rounded(sp.proportional_weights(sizes), "weight")


@query
def interleave(spark, sf):
    sources = {"documents": documents(spark, sf), "turns": turns(spark, sf), "benchmark": benchmark(spark, sf)}
    mixed = sp.interleave(sources, {"documents": 0.5, "turns": 0.3, "benchmark": 0.2})
    return mixed.select("source", "record_id", "copy_no")


@query
def interleave_order(spark, sf):
    sources = {"documents": documents(spark, sf), "turns": turns(spark, sf), "benchmark": benchmark(spark, sf)}
    mixed = sp.interleave(sources, {"documents": 0.5, "turns": 0.3, "benchmark": 0.2}, ordered=False)
    return sp.mixed_positions(mixed).select("source", "record_id", "copy_no", "position")


@query
def train_job(spark, sf):
    """The loss table of a short training over two corpora: what is logged, and that the loss falls and is finite."""
    out = shared_dir(spark, "trained")
    mix = {"documents": documents(spark, sf), "turns": turns(spark, sf)}
    mix = {name: df.withColumn("record_id", F.col("record_id").cast("string")) for name, df in mix.items()}
    options = tn.Training(dimension=16, epochs=2, learning_rate=0.05, checkpoint_every=1, examples_per_task=1 << 14)
    train.train(mix, vocabulary(spark, sf), out, options)
    whole = run_logs.read_metrics(spark, f"{out}/metrics").filter("step IS NULL")
    first, last = F.min_by("loss", "epoch"), F.max_by("loss", "epoch")
    per_phase = whole.groupBy("phase").agg(F.count("*").alias("n_epochs"), (last < first).alias("falls"))
    sizes = [spark.read.parquet(f"{out}/encoded/{x}").select(F.lit(x).alias("phase"), F.size("ids").alias("n")) for x in ("train", "val")]
    sizes = sizes[0].unionByName(sizes[1]).groupBy("phase").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_ids"))
    return per_phase.join(sizes, "phase")


@query
def shuffle_order(spark, sf):
    docs = documents(spark, sf).select("record_id")
    return shuffled_positions(docs, "record_id", "1337:0")


@query
def record_batches(spark, sf):
    return sp.batches(documents(spark, sf).select("record_id"), 64)


@query
def collate_batches(spark, sf):
    sizes = documents(spark, sf).select("record_id", F.length("text").alias("n_chars"))
    grouped = sp.collate(sizes, 64, ["n_chars"])
    return grouped.select(
        "batch_no",
        F.size("records").alias("n_records"),
        joined(F.transform("records", lambda r: r["n_chars"])).alias("sizes"),
    )


def batch_totals(batch: pa.Table) -> pa.Table:
    """Stands for a user's collate function: one batch in, any rows out."""
    return pa.table(
        {
            "batch_no": batch["batch_no"].slice(0, 1),
            "n_records": pa.array([batch.num_rows], pa.int64()),
            "n_chars": pa.array([pc.sum(batch["n_chars"]).as_py()], pa.int64()),
        }
    )


@query
def collate_function(spark, sf):
    sizes = documents(spark, sf).select("record_id", F.length("text").alias("n_chars"))
    return sp.map_batches(sizes, 64, batch_totals, "batch_no bigint, n_records bigint, n_chars bigint")


@query
def keep_weights(spark, sf):
    return rounded(sp.keep_weights(vocabulary(spark, sf)), "keep_prob")


@query
def subsample_words(spark, sf):
    thin = Encoder(vocabulary(spark, sf)).encode(documents(spark, sf), thinning=Thinning())
    return thin.select("record_id", joined("ids").alias("ids"))


@query
def subsample_tokens(spark, sf):
    rows = rs.unnest(vb.tokenize_corpus(documents(spark, sf)), F.col("tokens"), "token", "pos", ["record_id"])
    thin = sp.subsample_tokens(rows, sp.keep_weights(vocabulary(spark, sf)), SIZE)
    return thin.groupBy("record_id").agg(
        F.count("*").alias("n_kept"), F.sum("pos").alias("sum_pos"), F.sum(F.length("token")).alias("n_chars")
    )


@query
def negative_distribution(spark, sf):
    return rounded(sp.negative_distribution(vocabulary(spark, sf)), "prob", "low", "high", places=9)


@query
def draw_negatives(spark, sf):
    vocab = vocabulary(spark, sf)
    windows = ex.skipgram_windows(ex.thinned_sequences(documents(spark, sf), Encoder(vocab)))
    drawn = sp.draw_negatives(windows, sp.negative_distribution(vocab))
    return drawn.select("record_id", "start", "center", joined("negatives").alias("negatives"))


# -- training examples -----------------------------------------------------------------


@query
def context_windows(spark, sf):
    enc = sequences(spark, sf, vocabulary(spark, sf))
    windows = ex.context_windows(ex.prepare_sequences(enc, None, N), N)
    return windows.select("record_id", "start", joined("window").alias("ids"))


@query
def cbow_examples(spark, sf):
    found = ex.cbow_from_texts(documents(spark, sf), Encoder(vocabulary(spark, sf)))
    return found.select("record_id", "start", joined("context").alias("context"), "center")


@query
def skipgram_pairs(spark, sf):
    windows = ex.skipgram_windows(ex.thinned_sequences(documents(spark, sf), Encoder(vocabulary(spark, sf))))
    return ex.skipgram_pairs(windows).groupBy("record_id", "center").agg(
        F.count("*").alias("n_pairs"), F.sum("target").alias("sum_targets"), F.sum("label").alias("n_positive")
    )


@query
def skipgram_examples(spark, sf):
    """Positives and negatives in one labelled result."""
    vocab = vocabulary(spark, sf)
    windows = ex.skipgram_windows(ex.thinned_sequences(documents(spark, sf), Encoder(vocab)))
    drawn = sp.draw_negatives(windows, sp.negative_distribution(vocab))
    return ex.skipgram_pairs(drawn).groupBy("record_id", "center").agg(
        F.count("*").alias("n_pairs"), F.sum("target").alias("sum_targets"), F.sum("label").alias("n_positive")
    )


# -- ranks, windows, logs --------------------------------------------------------------


@query
def words_at_ranks(spark, sf):
    return st.words_at_ranks(counts(spark, sf), [0, 10, 100, 1000, 4000, 8000])


@query
def step_numbers(spark, sf):
    log = losses(spark, sf).select("run", "epoch", F.col("step").alias("id"), "loss")
    return row_numbers(log, ["run", "epoch"], "id", name="step", rows_per_range=2000).select("run", "epoch", "id", "step")


@query
def running_loss(spark, sf):
    return rounded(mt.logged_running_loss(losses(spark, sf)), "mean_loss", places=9, nudge=1e-11)


@query
def epoch_losses(spark, sf):
    return rounded(mt.epoch_losses(losses(spark, sf)), "train", "val", places=9, nudge=1e-11)


@query
def learning_rates(spark, sf):
    log = losses(spark, sf)
    epochs = log.agg(F.max("epoch") + 1).first()[0]
    rates = mt.learning_rates(spark, epochs)
    steps = log.groupBy("epoch").agg(F.count("*").alias("n_steps"))
    return rounded(steps.join(rates, "epoch"), "rate")


# -- statistics ------------------------------------------------------------------------


def described(df: DataFrame) -> DataFrame:
    return rounded(df, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def describe_counts(spark, sf):
    return described(st.describe(rs.drop_rare(counts(spark, sf)), "cnt"))


@query
def describe_frequencies(spark, sf):
    return described(st.describe(vb.count_frequencies(rs.drop_rare(counts(spark, sf))), "n_words"))


@query
def common_frequencies(spark, sf):
    return rounded(st.common_frequencies(rs.drop_rare(counts(spark, sf))), "share")


@query
def vocabulary_cutoffs(spark, sf):
    return rounded(st.cutoffs(counts(spark, sf), [100, 1000, 5000, 10_000]), "coverage")


def sizes(spark, sf) -> DataFrame:
    return st.lengths(sequences(spark, sf, vocabulary(spark, sf)))


@query
def describe_lengths(spark, sf):
    return described(st.describe(sizes(spark, sf), "length"))


@query
def length_histogram(spark, sf):
    return st.histogram(sizes(spark, sf), "length", "n_records").orderBy("length")


@query
def describe_length_histogram(spark, sf):
    return described(st.describe(st.histogram(sizes(spark, sf), "length", "n_records"), "n_records"))


@query
def length_shares(spark, sf):
    return rounded(st.length_shares(materialize(sizes(spark, sf), "sizes")), "share")


@query
def context_retention(spark, sf):
    return rounded(st.retention(sizes(spark, sf), [1, 2, 3, 4, 5, 10, 20, 50]), "share")


@query
def keep_curves(spark, sf):
    return rounded(st.keep_curves(counts(spark, sf)), "t", "x", "keep_prob")


# -- numbers ---------------------------------------------------------------------------


@query
def activations(spark, sf):
    x = components(spark, sf)
    done = x.select(
        "id",
        "pos",
        sigmoid("x").alias("sigmoid"),
        sigmoid("x", 2.0).alias("sigmoid2"),
        tanh("x").alias("tanh"),
        relu("x").alias("relu"),
        leaky_relu("x").alias("leakyrelu"),
        swish("x").alias("swish"),
    )
    return rounded(done, "sigmoid", "sigmoid2", "tanh", "relu", "leakyrelu", "swish")


@query
def gelu_activation(spark, sf):
    return rounded(components(spark, sf).select("id", "pos", gelu("x").alias("gelu")), "gelu")


@query
def series_gradient(spark, sf):
    log = losses(spark, sf).select("run", "step", "loss")
    return rounded(gradient(log, ["run"], "step", "loss", "slope").select("run", "step", "slope"), "slope", nudge=1e-9)


@query
def activation_gradient(spark, sf):
    curve = components(spark, sf).groupBy("label", "x").agg(F.count("*").alias("n")).withColumn("y", swish("x"))
    slopes = gradient(curve, ["label"], "x", "y", "slope")
    return slopes.groupBy("label").agg(F.count("slope").alias("n"), F.round(F.avg("slope"), 5).alias("mean_slope"))


@query
def layer_moments(spark, sf):
    return rounded(st.layer_moments(components(spark, sf), "label", "x"), "mean", "std")


@query
def layer_histogram(spark, sf):
    return st.layer_histogram(components(spark, sf), "label", "x")


# -- vectors ---------------------------------------------------------------------------


@query
def train_vectors(spark, sf):
    vocab = vocabulary(spark, sf)
    stored = materialize(encoded(spark, sf, vocab), "encoded")
    trained = vc.vectors_of(vc.train_vectors(stored, dimension=16), vocab.table)
    return trained.select("id", "word", F.size("vector").alias("dimension"))


@query
def clip_norms(spark, sf):
    wide = vectors(spark, sf).select("id", F.transform("vector", lambda v: v.cast("double") * (F.col("id") % 3)).alias("vector"))
    clipped = wide.select("id", vc.clip_norm("vector").alias("vector"))
    return rounded(clipped.select("id", F.posexplode("vector").alias("pos", "x")), "x")


def small_examples(spark, sf) -> DataFrame:
    """Examples of whole documents whose ids fall onto the stored vectors."""
    vocab = vocabulary(spark, sf)
    n = table(spark, sf, "embeddings").count()
    found = ex.cbow_examples(sequences(spark, sf, vocab), vocab, subsample=False)
    return found.select(
        "record_id",
        "start",
        F.transform("context", lambda i: (i % n).cast("int")).alias("context"),
        (F.col("center") % n).cast("int").alias("center"),
    )


def turn_examples(spark, sf) -> DataFrame:
    """Examples of whole conversation turns whose ids fall onto the stored vectors."""
    vocab = vocabulary(spark, sf)
    n = table(spark, sf, "embeddings").count()
    split = vb.tokenize_corpus(turns(spark, sf)).withColumnRenamed("tokens", "words")
    enc = Encoder(vocab).encode_words(split, with_tokens=False)
    found = ex.cbow_examples(enc, vocab, subsample=False)
    return found.select(
        "record_id", "start", F.transform("context", lambda i: i % n).alias("context"), (F.col("center") % n).alias("center")
    )


@query
def context_means(spark, sf):
    means = vc.context_means(turn_examples(spark, sf), vectors(spark, sf))
    return means.select("record_id", "start", F.round(F.col("mean")[0], 6).alias("first"), F.round(F.col("mean")[63], 6).alias("last"))


@query
def score_examples(spark, sf):
    scored = vc.score_examples(small_examples(spark, sf), vectors(spark, sf).select("id", "vector"))
    placed = scored.withColumn("batch", F.floor(F.col("record_id") / 64))
    return rounded(vc.mean_loss(placed, "batch"), "loss")


def scored_turns(spark, sf, criterion: str) -> DataFrame:
    """Losses of turns, against five negatives that follow from the example, drawn as if by ``prob``."""
    found = vectors(spark, sf).select("id", "vector").withColumn("bias", (F.col("id") % 3) / 10)
    n = found.count()
    strength = F.col("id") % 7 + 1
    total = found.agg(F.sum(strength)).first()[0]
    drawn = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda j: ((F.col("center") * 7 + F.col("start") * 3 + j * 13) % n).cast("int"))
    placed = turn_examples(spark, sf).withColumn("negatives", drawn)
    prob = found.select("id", (strength / total).alias("prob"))
    scored = vc.score_examples(placed, found.drop("bias"), found, criterion, prob)
    return scored.groupBy("record_id").agg(F.count("*").alias("n_examples"), F.round(F.avg("loss"), 6).alias("loss"))


@query
def score_softmax(spark, sf):
    return scored_turns(spark, sf, "softmax")


@query
def score_negative_sampling(spark, sf):
    return scored_turns(spark, sf, "negative")


@query
def score_sampled_softmax(spark, sf):
    return scored_turns(spark, sf, "sampled")


@query
def analogy(spark, sf):
    return rounded(vc.analogy(vectors(spark, sf), 1, 2, 3), "similarity")


@query
def principal_axes(spark, sf):
    found = vectors(spark, sf)
    placed = vc.project(found, vc.principal_axes(found, 2))
    return placed.select("id", F.round(F.abs(F.col("projected")[0]), 4).alias("axis1"))


@query
def discriminant_axes(spark, sf):
    """Each axis with its equation checked on the rows, and the scatter that SQL can tell as well."""
    found = vc.discriminant_axes(vectors(spark, sf), "label", 64)
    checked = vc.eigen_residuals(vectors(spark, sf), "label", found.axes, found.values)
    return checked.select(
        (F.col("axis") + 1).alias("axis"), (F.col("residual") < 1e-6).alias("holds"), F.lit(found.n).cast("bigint").alias("n"),
        F.lit(round(float(np.trace(found.between)), 6)).alias("between"), F.lit(round(float(np.trace(found.within)), 6)).alias("within"),
    )


@query
def principal_equations(spark, sf):
    """The two principal axes: the equation of each, checked on the rows. Scatter around the one mean is that between rows as
    labels of their own; within them there is none, so the axes' own multiples stand in."""
    found = vectors(spark, sf)
    model = vc.principal_axes(found, 2)
    axes = model.pc.toArray()
    dense = found.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    n = dense.count()
    long = vc.place(dense, np.zeros(len(axes)), axes).select("placed", F.posexplode("vector").alias("pos", "x"))
    long = long.select("pos", "x", F.posexplode("placed").alias("axis", "p"))
    times = long.groupBy("axis", "pos").agg(((F.sum(F.col("x") * F.col("p")) - F.sum("x") * F.sum("p") / n) / (n - 1)).alias("y"))
    weights = F.lit(axes.T.tolist())[F.col("axis")][F.col("pos")]
    value = F.sum(F.col("y") * weights)
    checked = times.withColumn("a", weights).groupBy("axis").agg(
        value.alias("value"), F.sum(F.col("y") * F.col("y")).alias("square"), F.sum(F.col("a") * F.col("a")).alias("norm")
    )
    # |C a - value a|^2 = |C a|^2 - value^2 for a unit axis
    rest = F.sqrt(F.abs(F.col("square") - F.col("value") ** 2)) / F.col("value")
    return checked.select((F.col("axis") + 1).alias("axis"), ((rest < 1e-6) & (F.abs(F.col("norm") - 1) < 1e-9)).alias("holds"))


@query
def subword_counts(spark, sf):
    """Counts of the pieces that 48 merges leave of the words."""
    return sw.learn_subwords(stored_counts(spark, sf), PIECE_MERGES).counts()


# -- streams ---------------------------------------------------------------------------

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def arriving(spark, sf) -> DataFrame:
    # the table may be one file; spread it as a folder of many files would be
    stream = streaming.table_stream(spark, f"{sf}/documents.parquet", DOCUMENTS, "text", "doc_id")
    return stream.repartition(2 * spark.sparkContext.defaultParallelism, "record_id")


@query
def stream_vocabulary(spark, sf):
    path, check = shared_dir(spark, "stream-counts"), shared_dir(spark, "stream-check")
    streaming.collect_counts(arriving(spark, sf), path, check).awaitTermination()
    total = streaming.collected_counts(spark, path)
    return vb.Vocabulary(total, size=SIZE, special_tokens=SPECIALS).table


@query
def stream_running(spark, sf):
    """The vocabulary of a stream that stops after half of the documents and goes on from its checkpoint, read after the
    first half was folded."""
    folder, path, check, out = (shared_dir(spark, f"running-{x}") for x in ("in", "counts", "check", "folded"))
    streaming.use_disk_state(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    first = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) < 2**31
    for half in (first, ~first):
        docs.filter(half).write.mode("append").parquet(folder)
        stream = streaming.read_stream(spark, folder, docs.schema, "text", "doc_id")
        streaming.keep_running_counts(stream, path, check).awaitTermination()
    streaming.compact_running(spark, path, out, 0)
    return vb.Vocabulary(streaming.running_total(spark, out), size=SIZE, special_tokens=SPECIALS).table


@query
def stream_clean(spark, sf):
    path, check = shared_dir(spark, "stream-clean"), shared_dir(spark, "stream-check")
    cleaned = streaming.clean_stream(arriving(spark, sf), [tx.normalize, partial(tx.split_sentences, kind="plain")])
    streaming.append_stream(cleaned, path, check).awaitTermination()
    return spark.read.parquet(path).select("record_id", "sent_no", "text")


@query
def stream_encode(spark, sf):
    path, check = shared_dir(spark, "stream-ids"), shared_dir(spark, "stream-check")
    enc = streaming.encode_stream(arriving(spark, sf), Encoder(vocabulary(spark, sf)))
    streaming.append_stream(enc, path, check).awaitTermination()
    return shown(spark.read.parquet(path))
