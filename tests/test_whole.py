"""Whole jobs: no record, token or draw is left out for its place or for a counter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import sampling as sp
from wordloom.operators import vectors as vc
from wordloom.plans import catalog


def test_examples_reach_the_end_of_a_document(spark, sf):
    lengths = [r.n for r in catalog.sequences(spark, sf, catalog.vocabulary(spark, sf)).select(F.size("ids").alias("n")).collect()]
    assert max(lengths) > 300
    assert catalog.small_examples(spark, sf).count() == sum(max(n - 8, 0) for n in lengths)
    drawn = catalog.QUERIES["draw_negatives"](spark, sf)
    assert drawn.agg(F.max("start")).first()[0] >= 256


def test_negatives_follow_the_distribution_without_what_is_excluded(spark):
    # one word holds nearly all the mass and is excluded: the rest must still be drawn by their shares
    shares = np.array([0.9999, 0.00005, 0.00003, 0.00002])
    rows = [(i, float(p), float(h)) for i, (p, h) in enumerate(zip(shares, np.cumsum(shares)))]
    table = spark.createDataFrame(rows, "id int, prob double, high double")
    examples = spark.range(6000).selectExpr("id AS record_id", "0 AS start", "array(0, 0, 99) AS context", "77 AS center")
    drawn = [r.negatives for r in sp.draw_negatives(examples, table, k=1).collect()]
    assert [sum(d == [i] for d in drawn) / 6000 for i in range(4)] == pytest.approx([0, 0.5, 0.3, 0.2], abs=0.03)
    assert all(sorted(r.negatives) == [1, 2, 3] for r in sp.draw_negatives(examples.limit(9), table, k=5).collect())
    assert all(r.negatives == [] for r in sp.draw_negatives(examples.limit(9), table.filter("id = 0"), k=2).collect())
    assert all(r.negatives == [] for r in sp.draw_negatives(examples.limit(9), table.limit(0), k=2).collect())


@pytest.mark.parametrize("way", ["auto", "join"])
def test_look_up_can_keep_ids_without_a_vector(spark, way):
    vectors = spark.createDataFrame([(1, [0.5])], "id int, vector array<float>")
    rows = spark.createDataFrame([(0, 1), (1, 7), (2, 1), (3, None)], "k int, id int")
    got = {r.k: r.vector for r in vc.look_up_vectors(rows, vectors, way=way).collect()}
    assert got == {0: [0.5], 1: None, 2: [0.5], 3: None}


def test_registry_has_a_corpus_for_every_language(spark, tmp_path):
    langs = ["en", "fr", "de", "es", "it", "ru", None]
    docs = spark.createDataFrame([(i, "text", lang) for i, lang in enumerate(langs)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.corpus: r.n_records for r in catalog.QUERIES["corpus_registry"](spark, str(tmp_path)).collect()}
    assert got == {"bookcorpus": 1, "wikipedia": 1, "commoncrawl": 5}
