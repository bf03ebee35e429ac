import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as tx

PARAGRAPH = "Rain fell all night. The river rose."
SAMPLES = [
    "",
    " ",
    PARAGRAPH,
    "don't foo_bar €£$ a—b 3.14",
    "Ærø ﬁne ½ ① K Å Ⅷ ⅷ ǅ ß ẞ İstanbul ŒŸ…",
    "ΟΔΟΣ Σ ὈΔΥΣΣΕΎΣ",
    "tab\tnew\nline\r    \u0085\u000b\u000c​‍﻿­!",
    "漢字かな交じり文 データ。テスト！",
    "हिन्दी पाठ नमस्ते १२३",
    "مرحبا بالعالم، كيف حالك؟",
    "emoji 👩‍👩‍👧 🇩🇪 x́y ✓✔ ☃",
    "a\u0000b\u0007c\u001fd",
    "___ __init__ a.b-c/d\\e `~|^+=<>$",
    "é è ê ñ ü ö ç É",
]


def fuzz(n):
    rng = random.Random(7)
    pool = [
        *range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x300, 0x340), *range(0x370, 0x400), *range(0x400, 0x460),
        *range(0x5D0, 0x5EB), *range(0x620, 0x650), *range(0x905, 0x940), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070),
        *range(0x20A0, 0x20C0), *range(0x2100, 0x2190), *range(0x2460, 0x24FF), *range(0x3041, 0x3096), *range(0x4E00, 0x4E40),
        *range(0xAC00, 0xAC20), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x1F600, 0x1F640), 9, 10, 13,
    ]
    return ["".join(chr(rng.choice(pool)) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def hf():
    return pytest.importorskip("tokenizers")


def hf_normalizer(hf):
    n = hf.normalizers
    control = hf.Regex(r"[\p{Other}&&[^\n\t\r]]")
    return n.Sequence([n.NFKD(), n.StripAccents(), n.Lowercase(), n.Replace(control, ""), n.Replace(hf.Regex(r"[\s]"), " ")])


def test_normalize_agrees_with_tokenizer_library(column, hf):
    texts = SAMPLES + fuzz(400)
    expected = [hf_normalizer(hf).normalize_str(t) for t in texts]
    assert column(tx.normalize, texts) == expected


def test_prenormalize_agrees_with_tokenizer_library(column, hf):
    texts = SAMPLES + fuzz(200)
    rule = hf.normalizers.Replace(hf.Regex(r"[\p{Other}&&[^\n\t\r]]"), "\n")
    assert column(tx.prenormalize, texts) == [rule.normalize_str(t) for t in texts]


def test_words_agree_with_tokenizer_library(column, hf):
    texts = SAMPLES + fuzz(400)
    split = hf.pre_tokenizers.Sequence([hf.pre_tokenizers.Whitespace(), hf.pre_tokenizers.Punctuation()])
    norm = hf_normalizer(hf)
    expected = [[w for w, _ in split.pre_tokenize_str(norm.normalize_str(t))] for t in texts]
    assert column(tx.parse_words, texts) == expected


def test_steps_of_normalize(column):
    assert column(tx.nfkd, SAMPLES) == [unicodedata.normalize("NFKD", t) for t in SAMPLES]
    assert column(tx.strip_accents, ["éx", "plain"]) == ["ex", "plain"]
    assert column(tx.lowercase, ["ΟΔΟΣ", "ÀB"]) == ["οδοσ", "àb"]
    assert column(tx.drop_control, ["a\u0007\tb\n​c\r"]) == ["a\tb\nc\r"]
    assert column(tx.blank_whitespace, ["a\t \n  b"]) == ["a     b"]
    assert column(tx.prenormalize, ["a\u0007\tb\n​c\r"]) == ["a\n\tb\n\nc\r"]
    assert column(tx.normalize, [None]) == [None]


def test_ascii_rows_skip_python(spark):
    df = spark.createDataFrame([("plain",)], "v string")
    plan = df.select(tx.lowercase("v"), tx.drop_control("v"), tx.split_words("v"))._jdf.queryExecution().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("kind", ["rules", "plain"])
def test_sentences(column, kind):
    assert column(lambda c: tx.split_sentences(c, kind), [PARAGRAPH]) == [["Rain fell all night.", "The river rose."]]
    parsed = column(lambda c: tx.parse_sentences(c, splitter=lambda x: tx.split_sentences(x, kind)), [PARAGRAPH])
    assert parsed == [["rain fell all night.", "the river rose."]]
    assert column(lambda c: tx.split_sentences(c, kind), ["", "  ", "no end"]) == [[], [], ["no end"]]
    with pytest.raises(ValueError):
        tx.split_sentences(F.col("v"), "other")


def test_sentence_rules(column):
    text = "dr. j. smith sent 3. items. he said, \"i can't.\" i left... then we go! ok? yes"
    expected = ["dr.", "j. smith sent 3. items.", "he said, \"i can't.\"", "i left... then we go!", "ok?", "yes"]
    assert column(tx.split_sentences, [text]) == [expected]
    joined = column(lambda c: tx.split_sentences(c, abbreviations=["dr"]), [text])
    assert joined == [["dr. j. smith sent 3. items.", *expected[2:]]]
    with pytest.raises(ValueError):
        tx.split_sentences(F.col("v"), abbreviations=["a|b"])


def test_words(column):
    assert column(tx.parse_words, [PARAGRAPH]) == [
        ["rain", "fell", "all", "night", ".", "the", "river", "rose", "."]
    ]
    assert column(tx.split_words, ["don't foo_bar €£$ a—b 3.14"]) == [
        ["don", "'", "t", "foo", "_", "bar", "€£", "$", "a", "—", "b", "3", ".", "14"]
    ]


def test_ngrams(column):
    words = [["a", "b", "c"], ["a"], []]
    assert column(lambda c: tx.word_ngrams(c, 2), words, "array<string>") == [[["a", "b"], ["b", "c"]], [], []]
    assert column(lambda c: tx.word_ngrams(c, 3), words, "array<string>") == [[["a", "b", "c"]], [], []]


def test_article_body(column):
    articles = [
        "Two rivers meet.\nSee also \nthe lake\nGallery \nview 7",
        "Two rivers meet.\nReferences\n\nmap of 1880",
        "Two rivers meet.\nBibliography\r\nmap of 1880\nExternal links \n",
    ]
    assert column(tx.article_body, articles) == ["Two rivers meet.\n"] * 3
    # headings apply in order and are not anchored
    assert column(tx.article_body, ["a\nFootNotes \nb", "a\nNotes b", "a\nReferences \nb"]) == ["a\nFoot", "a\nNotes b", "a\n"]


def test_detokenize(column):
    pairs = {
        "Rain fell all night . The river rose .": PARAGRAPH.replace("night. The", "night . The"),
        PARAGRAPH: PARAGRAPH,
        "Rain fell all night. The river rose .": PARAGRAPH,
        "he ca n't say `` hi '' ( now ) , it 's 5 % .": "he can't say \"hi\" (now), it's 5%.",
        "  spaces \t\n collapse  ": "spaces collapse",
        "I can not , you 'll wan na go -- yes ?": "I cannot, you'll wanna go--yes?",
        "a ... b": "a...b",
        "d 'ye gim me Gon na got ta LEM ME more 'n wan na can not toucan not": (
            "d'ye gimme Gonna gotta LEMME more'n wanna cannot toucan not"
        ),
        "'t is 't was": "'tis 'twas",
        "pay $ 5 ; now": "pay $5; now",
        "-LRB- x -RRB-": "-LRB- x -RRB-",
        "": "",
    }
    assert column(tx.detokenize, list(pairs)) == list(pairs.values())
    assert column(lambda c: tx.detokenize(c, convert_brackets=True), ["-LRB- x -RRB-"]) == ["(x)"]


def test_python_splitter(column):
    def load():
        return lambda text: text.split(",")

    assert column(tx.from_python(load, "array<string>"), ["a,b", "c"]) == [["a", "b"], ["c"]]


# -- words of plain texts in one step --------------------------------------------------

PLAIN = ["", " ", "a", "!", "!!a!b  c!", "Don't_stop\tnow\r\n(3.14%)", PARAGRAPH, "Größe, ÇA VA? Łódź ł ŧ æß", "~" * 9, "x" * 9, " \n "]


def test_words_in_one_step_equal_normalising_then_splitting(column):
    texts = [None, *PLAIN, *SAMPLES, *fuzz(300), *("".join(random.Random(i).choices("aZ9 .'ß\n\t", k=40)) for i in range(200))]
    expected = column(lambda c: tx.split_words(tx.normalize(c)), texts)
    assert column(tx.parse_words, texts) == expected
    assert expected[:3] == [None, [], []]


@pytest.mark.parametrize("size", [1, 3, 7, 1024])
def test_plain_texts_are_cut_across_pieces(column, monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(tx, "CUT_BYTES", size)
    plain = [t for t in PLAIN if "Ł" not in t]
    texts = ["é Ελλάδα", *plain, None, "“quoted”", *plain]
    done = [r for piece in tx._parse_plain.func(iter([pa.array(texts), pa.array(texts)[2:5]])) for r in piece.to_pylist()]
    assert [r["folded"] for r in done[: len(texts)]] == [t if t and "“" in t else "e Ελλαδα" if t and "é" in t else None for t in texts]
    expected = column(lambda c: tx.split_words(tx.normalize(c)), plain)
    assert [r["words"] for r in done[: len(texts)]] == [None, *expected, None, None, *expected]
    assert done[len(texts) :] == done[2:5]


def test_texts_go_to_python_once_for_their_words(spark):
    df = spark.range(3).selectExpr("id", "CAST(id AS STRING) AS text").repartition(2)
    plan = df.select(tx.parse_words("text").alias("w"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "_parse_plain" in plan and "_fold" not in plan
