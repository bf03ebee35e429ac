"""Whole jobs: cases that a cut would lose."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordloom.llm import language, licenses


def _found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    return {i: sorted((r.licence, r.n_lines, r.line) for r in rows if r.doc_id == i) for i in range(len(texts))}


def test_licences_wrapped_embedded_and_of_many_lines(spark):
    wrapped = "Intro words.\n# Licensed under the Apache License,\n# Version 2.0.\nMore words."
    embedded = "Copyright 2020 Foo. Released under the MIT License."
    bodies = {name: "Copyright Foo\n\n" + "\n".join(text.replace(". ", ".\n").split("\n")) + "\n\nand then other words" for name, text in licenses.TEXTS if name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")}
    inside = "many other words " * 50 + bodies["MIT"].replace("\n", " ") + " and more words" * 50
    got = _found(spark, [wrapped, embedded, f"{embedded}\n{embedded}", "the terms of the software and of the license", *bodies.values(), inside])
    assert got[0] == [("Apache-2.0", 1, "# Licensed under the Apache License,\n# Version 2.0.")]
    assert got[1] == [("MIT", 1, embedded)] and got[2] == [("MIT", 2, embedded)] and got[3] == []
    for i, (name, body) in enumerate(bodies.items(), 4):
        [(licence, n, line)] = got[i]
        assert (licence, n) == (name, 1) and line in body and line.count("\n") >= 2
    assert [x[0] for x in got[4 + len(bodies)]] == ["MIT"]


@pytest.mark.parametrize("per_language", [language.PER_LANGUAGE, 30])  # all documents teach, or a part as in large tables
def test_planted_foreign_text_and_noise_go(spark, sf, monkeypatch, per_language):
    monkeypatch.setattr(language, "train", functools.partial(language.train, per_language=per_language))
    draw = np.random.default_rng(0)
    planted = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz   "), 400)) for _ in range(4)]
    planted += ["В начале сотворил Бог небо и землю, земля же была безвидна и пуста", "Vaka vanha Väinämöinen itse tuon sanoiksi virkki mieleni minun tekevi"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    bad = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(planted)], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.union(bad), sf)
    got, want = ({r.doc_id for r in x.select("doc_id").collect()} for x in (kept, docs.filter(F.col("text").rlike(r"\p{L}"))))
    assert got == want


def test_a_text_of_one_letter_has_a_language(spark):
    taught = spark.createDataFrame([("a cat and a dog", "en"), ("天地玄黄宇宙洪荒", "zh")], "text string, lang string")
    model = language.train(taught)
    assert [model.predict(t) for t in ("A.", "玄", "!", None)] == [("en", 1.0), ("zh", 1.0), ("und", 0.0), ("und", 0.0)]
    assert model.predict("Ж")[0] != language.UNKNOWN
