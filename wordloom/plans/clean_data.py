"""Job: clean a registered corpus and split it into sentences.

    spark-submit -m wordloom.plans.clean_data -d wikipedia --root s3a://raw --out s3a://clean
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from wordloom.plans.recipes import RECIPES
from wordloom.session import spark_session
from wordloom.sources.corpora import MANAGED, Corpus, prepare, read_corpus


def clean(
    spark: SparkSession,
    root: str,
    out: str,
    corpus: Corpus,
    split: str | None = None,
    key: str | None = None,
    shards: int | None = None,
) -> dict[str, int]:
    raw = read_corpus(spark, root, corpus, split, key)
    return prepare(raw, f"{out}/{corpus.prefix}", RECIPES[corpus.recipe], shards)


def main(argv: Sequence[str] | None = None, registry: Mapping[str, Corpus] = MANAGED) -> dict[str, int]:
    parser = argparse.ArgumentParser(description="Clean a corpus and split it into sentences.")
    parser.add_argument("-d", "--dataset", required=True, choices=sorted(registry))
    parser.add_argument("-n", "--name", help="subset, if not the registered one")
    parser.add_argument("-s", "--split", help="folder of the split below the corpus")
    parser.add_argument("-k", "--key", help="text column")
    parser.add_argument("--root", required=True, help="folder of the raw corpora")
    parser.add_argument("--out", required=True, help="folder for the cleaned corpora")
    parser.add_argument("--shards", type=int, help="exact number of files")
    args = parser.parse_args(argv)
    corpus = registry[args.dataset]
    if args.name:
        corpus = Corpus(**{**corpus.__dict__, "subset": args.name})
    counts = clean(spark_session("clean_data"), args.root, args.out, corpus, args.split, args.key, args.shards)
    print(f"{args.dataset}: {counts['before']} records before, {counts['after']} after")
    return counts


if __name__ == "__main__":
    main()
