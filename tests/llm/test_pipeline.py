"""The pipeline's stages: what each keeps and returns."""

import corpus_pipeline
from pyspark.sql import functions as F

from wordloom.llm import queries


def test_stages(spark, sf):
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = {"read": docs.count()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        sizes[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == first.columns
    assert sizes["read"] >= sizes["language_id"] >= sizes["jaccard_join"] == sizes["suffix_dedup"] and sizes["byte_bpe"] == sizes["mix"] > 0


def test_stages_leave_columns_of_any_name_alone(spark):
    """Each stage on a table whose extra columns are named like those that the stages add."""
    good = "The river rose after the long rain and the old mill stood under water for nine days while the village waited. "
    rows = [(i, f"{good} House {i} and field {i * 7} were lost. " * (1 + i % 3), "en", f"s{i % 2}", 1) for i in range(12)]
    rows += [(50, None, "en", "s0", 0), (51, "", None, None, 0)]
    extra = {"ids": 1, "decoded": 2, "copy": 3, "share": 4, "predicted": 5, "score": 6, "lang_pred": 7, "row": 8, "kept": 9, "size": 10, "times": 11}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({k: F.lit(v) for k, v in extra.items()})
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, "")
            if name == "byte_bpe":
                assert set(docs.columns) < set(out.columns) and "_ids" in out.columns
            else:
                assert out.columns == docs.columns
            kept = out.collect()
            assert (len(kept) > 0) == (table is docs), name
            assert all(r[k] == v for r in kept for k, v in extra.items()), name


def test_queries_are_named_by_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
