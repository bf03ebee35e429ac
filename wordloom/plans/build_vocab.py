"""Job: count words, 2-grams and 3-grams of a cleaned corpus and save its vocabulary.

    spark-submit -m wordloom.plans.build_vocab -d wikipedia --data s3a://clean --out s3a://vocab
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.reshape import drop_rare
from wordloom.operators.vocabulary import (
    Vocabulary,
    merge_counts,
    ngram_counts,
    tokenize_corpus,
    word_counts,
)
from wordloom.schemas import VOCAB_MIN_FREQ, VOCAB_SIZE
from wordloom.session import materialize, spark_session, spread
from wordloom.sources.corpora import MANAGED, Corpus, load_prepared


def ngram_order(word: Column | str) -> Column:
    """1 for a word, 2 for a pair, and so on; words themselves hold no space."""
    return F.size(F.split(word, " "))


def count_passes(
    corpus: DataFrame,
    orders: Sequence[int] = (1, 2, 3),
    size: int = VOCAB_SIZE,
    min_freq: int = VOCAB_MIN_FREQ,
    above: int = 1,
    store_tokens: bool = True,
) -> DataFrame:
    """Counts of words and n-grams that occur more than ``above`` times.

    Each pass builds n-grams only from the table of the vocabulary so far, with its size
    limit, infrequent words included. A pass depends on the one before, so its counts are
    written in between, and so are the tokens that all passes share.
    """
    # a long document has many sentences: spread by both
    keys = [k for k in ("record_id", "sent_no") if k in corpus.columns]
    tokens = tokenize_corpus(spread(corpus, *keys))
    if store_tokens:
        tokens = materialize(tokens, "tokens")
    counts: DataFrame | None = None
    for n in orders:
        if n == 1:
            found = word_counts(tokens)
        else:
            members = Vocabulary(counts, size, min_freq).table.select("word")
            found = ngram_counts(tokens, members, n)
        found = drop_rare(found, above)
        counts = found if counts is None else merge_counts([counts, found])
        counts = materialize(counts.select("word", "cnt"), f"counts-{n}")
    return counts


def build(corpus: DataFrame, path: str, **options) -> Vocabulary:
    counts = count_passes(corpus, **options)
    chosen = {k: v for k, v in options.items() if k in ("size", "min_freq")}
    vocabulary = Vocabulary(counts, **chosen)
    vocabulary.save(path)
    return Vocabulary.load(corpus.sparkSession, path)


def main(argv: Sequence[str] | None = None, registry: Mapping[str, Corpus] = MANAGED) -> str:
    parser = argparse.ArgumentParser(description="Build the vocabulary of a cleaned corpus.")
    parser.add_argument("-d", "--dataset", required=True, choices=sorted(registry))
    parser.add_argument("-n", "--name", help="subset, if not the registered one")
    parser.add_argument("-k", "--key", default="text", help="text column")
    parser.add_argument("-i", "--data_dir", help="folder of the cleaned corpus, if not the registered one")
    parser.add_argument("--data", help="folder of the cleaned corpora")
    parser.add_argument("--out", required=True, help="folder for vocabularies")
    args = parser.parse_args(argv)
    if not (args.data or args.data_dir):
        parser.error("give --data or --data_dir")
    corpus = registry[args.dataset]
    if args.name:
        corpus = Corpus(**{**corpus.__dict__, "subset": args.name})
    spark = spark_session("build_vocab")
    found = load_prepared(spark, args.data_dir) if args.data_dir else load_prepared(spark, args.data, corpus)
    path = f"{args.out}/{corpus.prefix.replace('/', '_')}_vocab"
    build(found.withColumnRenamed(args.key, "text"), path)
    return path


if __name__ == "__main__":
    main()
