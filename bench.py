"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local session (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from wordloom.operators.encoding import Encoder  # noqa: E402
from wordloom.operators.vocabulary import Vocabulary, tokenize_corpus  # noqa: E402
from wordloom.plans.catalog import QUERIES, documents, vocabulary  # noqa: E402
from wordloom.session import shared_dir, spark_session  # noqa: E402

HEADLINE = [
    "normalize_text",
    "split_sentences",
    "split_words",
    "recipe_wikipedia",
    "recipe_bookcorpus",
    "word_count",
    "vocabulary_table",
    "ngram_passes",
    "encode_documents",
    "encode_documents_join",
    "split_exact",
    "interleave",
    "subsample_words",
    "context_windows",
    "cbow_examples",
    "skipgram_pairs",
    "draw_negatives",
    "describe_lengths",
    "vocabulary_cutoffs",
    "running_loss",
    "series_gradient",
    "layer_histogram",
    "context_means",
    "analogy",
    "stream_vocabulary",
    "decode_ids",
    "score_softmax",
    "subword_counts",
    "discriminant_axes",
    "stream_running",
]


def run(df) -> None:
    """Compute every row and column, and keep none."""
    df.write.format("noop").mode("overwrite").save()


def encoding_only(spark, sf: str) -> float:
    """Seconds to encode the documents with a saved vocabulary that is shipped already."""
    vocabulary(spark, sf, stored=False).save(path := shared_dir(spark, "bench-vocab"))
    encoder = Encoder(Vocabulary.load(spark, path))
    encoded = encoder.encode(documents(spark, sf))
    begin = time.perf_counter()
    run(encoded)
    return time.perf_counter() - begin


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = spark_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    run(QUERIES["word_count"](spark, sf))  # start the workers and warm the code up
    seconds = {}
    for name in chosen:
        begin = time.perf_counter()
        run(QUERIES[name](spark, sf))
        seconds[name] = round(time.perf_counter() - begin, 3)
    tokens = tokenize_corpus(documents(spark, sf)).selectExpr("sum(size(tokens)) AS n", "count(*) AS r").first()
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf).name,
        "cpus": int(cpus),
        "tokens": tokens.n,
        "records": tokens.r,
    }
    result["encode_tokens_per_sec"] = round(tokens.n / encoding_only(spark, sf))
    if "word_count" in seconds:
        result["count_tokens_per_sec"] = round(tokens.n / seconds["word_count"])
    print(json.dumps(result))


if __name__ == "__main__":
    main()
