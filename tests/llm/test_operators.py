"""The operators of the subpackage beside brute force on small tables that hold the odd cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import bpe, fagin, language, licenses, lsh_forest, mixing, preferences, repeats, sharding, sketches

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, hash string"
WORDS = [f"wort{i}" for i in range(40)]


def _text(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in draw.integers(0, len(WORDS), n))


PASSAGE = _text(99, 30)
LONG = _text(5, 3000)


def rows():
    texts = [None, "", " ", "one", "one", "naïve ß 漢字 " * 12, PASSAGE, _text(1, 60) + " " + PASSAGE, PASSAGE + "\n" + _text(2, 60), LONG, LONG, LONG + " end",
             "a" * 350, _text(3, 100), _text(3, 100) + " tail", "12 34 !", None]
    out = [(i * 3, t, "de", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 1, "k", None) for i, t in enumerate(texts)]
    return out + [(None, _text(3, 100), None, "s1", 7, 1, "k", "h"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def sets(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


# -- sharding --------------------------------------------------------------------------


def _minimax(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(spark, docs, shards):
    got = sharding.shard_texts(docs, shards, ["doc_id"]).collect()
    assert len(got) == len(rows()) and {r.law for r in got} == {"bytes"}
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r["shard"]].append(r)
        by_text[r.text_crc32].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values()) and set(by_shard) <= set(range(shards))
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by_shard.values())
    whole = F.coalesce("text", F.lit(""))
    groups = docs.groupBy(F.xxhash64(whole).alias("key")).agg(F.sum(F.octet_length(whole) + 1).alias("size"))
    sizes = [r["size"] for r in groups.orderBy("key").collect()]
    assert sharding.smallest_capacity(groups, shards)[0] == _minimax(sizes, shards)
    assert max(sum(r["size"] for r in part) for part in by_shard.values()) <= _minimax(sizes, shards)


def test_sharding_of_nothing(nothing):
    assert sharding.shard_texts(nothing, 8, ["doc_id"]).count() == 0


# -- mixing ----------------------------------------------------------------------------


def test_fill():
    assert mixing.fill([10, 10], [1, 1], 3) == [10.0, 10.0]
    assert mixing.fill([1, 99], [1, 1], 3) == [3.0, 97.0]
    assert mixing.fill([0, 5], [1, 2], 3) == [0.0, 5.0]


def test_mix(spark, docs, nothing):
    got = mixing.mix(docs, ["doc_id", "source", "size"]).collect()
    assert len(got) == len(rows())
    total = sum(r["_size"] for r in got)
    assert total == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows())
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - total) < 1e-6
    assert all(r.taken <= 3 * r["_size"] for r in got)
    for source, target in targets.items():
        part = [r for r in got if r.source == source]
        assert target <= 3 * part[0].source_size + 1e-9
        assert abs(sum(r.taken for r in part) - target) <= 1 + len(part) / 2  # words of the rows at the threshold are rounded
        assert all(0 <= r.taken - r["_size"] * (r.taken // max(r["_size"], 1)) <= r["_size"] for r in part)
    again = mixing.mix(docs.repartition(5), ["doc_id", "source", "size"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(nothing, ["doc_id"]).count() == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_mix_meets_its_targets(spark, scale):
    got = mixing.mix(spark.read.parquet(f"/root/testdata/{scale}/documents.parquet"), ["source"])
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.02 * r.target, r


def test_thresholds_nest(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 > 0, "x").alias("source"))
    taken = {}
    for weight in (1, 2, 4):
        got = mixing.mix(many, ["doc_id", "source"], weights=lambda names, w=weight: [10, w]).collect()
        part = [r for r in got if r.source is None]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 3
        taken[weight] = {r.doc_id: r.times for r in part}
    assert all(taken[1][i] <= taken[2][i] <= taken[4][i] for i in taken[1])


# -- top k -----------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(fagin, "BLOCK", 40)
    monkeypatch.setattr(fagin, "QUERIES", 2)
    draw = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in np.round(draw.normal(size=6), 1)]) for i in range(150)]
    vectors += [(200, None), (250, [1.0, None]), (300, [float("nan")] * 6), (350, [0.0] * 6), (None, [0.5] * 6), (400, vectors[0][1])]
    got = fagin.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), 5).collect()
    fine = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v in vectors if v and None not in v and np.isfinite(v).all()]
    want = []
    for i, v in fine:
        if i is not None and i % 50 == 0:
            best = sorted(((int(v @ w), j) for j, w in fine if j != i), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:5]
            want += [(i, n + 1, j, s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_nothing(spark):
    assert fagin.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), 5).count() == 0


# -- fingerprints ----------------------------------------------------------------------


def test_fingerprints(docs, nothing):
    got = sketches.compare_with_edit(docs).collect()
    order = sorted(rows(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(order)
    for a, b in zip(order[:-2], order[1:-1]):
        text, after = a[1] or "", b[1] or ""
        if b[0] is None:
            continue
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = known[a[0]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, value in ((edited, r.near_edited), (after, r.near_next)):
            x, y = sets(text), sets(other)
            true = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(true - value) < (0.2 if len(x | y) > sketches.K else 1e-9)
    assert sketches.compare_with_edit(nothing).count() == 0


def test_sketches_merge(spark):
    parts = spark.createDataFrame([(1, _text(7, 500)), (1, _text(8, 400)), (2, "a b"), (2, None)], "g int, text string")
    got = {r.g: r.fingerprint for r in sketches.merge(sketches.fingerprints(parts), ["g"]).collect()}
    one, two = (sketches.bottom([_text(s, n).encode()])[0] for s, n in ((7, 500), (8, 400)))
    assert got[1] == sketches.as_text(sketches.merged(one, two)) and len(got[2]) == 16
    assert abs(sketches.distinct(one) / 496 - 1) < 0.3 and sketches.containment(one, sketches.merged(one, two)) > 0.7


# -- language --------------------------------------------------------------------------


def test_language(spark, docs, nothing):
    said = [("en", "the house and the garden were quiet this evening"), ("de", "das haus und der garten waren heute abend still"), ("fr", "la maison et le jardin étaient calmes ce soir")]
    many = spark.createDataFrame([(n, t) for n, t in said] * 4 + [(None, "zzz"), ("en", None)], "lang string, text string")
    model = language.train(many)
    asked = spark.createDataFrame([(n, t) for n, t in said] + [(None, None), (None, "12 !"), (None, "")], "want string, text string")
    for r in language.predict(asked, model).collect():
        assert r.lang_pred == (r.want or "und") and 0 <= r.score <= 1
    assert {r.lang_pred for r in language.predict(asked, language.train(nothing)).collect()} == {"und"}
    assert language.predict(nothing, model).count() == 0


# -- repeats ---------------------------------------------------------------------------


def cut_plainly(table, length):
    """Rows of the digest, counted, by a set of all strings so far."""
    seen, want = set(), Counter()
    for doc_id, text in table:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = 1
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        want[(doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return want


@pytest.mark.parametrize("block, partitions, length", [(4096, "37", 60), (2, "3", 60), (1, "23", 100)])
def test_repeats_in_few_and_many_tasks(spark, block, partitions, length, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", block)
    draw = random.Random(block)
    parts = ["".join(draw.choices("abcdefgh ", k=draw.randint(20, 160))) for _ in range(25)] + ["ab" * 90, "z" * 150]
    table = [(i, "".join(draw.choices(parts, k=draw.randint(0, 6)))) for i in range(90)]
    table += [(100 + i, table[i % 7][1]) for i in range(20)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(5)
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(docs, length).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == cut_plainly(table, length)


@pytest.mark.parametrize("length", [100, 21])
def test_repeats(docs, length, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest(docs, length).collect())
    want = cut_plainly([r[:2] for r in sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))], length)
    assert got == want


def test_repeats_keep_columns(docs, nothing):
    cut = repeats.cut_documents(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert repeats.digest(nothing).count() == 0 and repeats.cut_documents(nothing).count() == 0


def test_numerals_are_no_letters(spark):
    taught = spark.createDataFrame([("the old mill by the river", "en"), ("die alte Mühle am Fluss", "de")] * 3, "text string, lang string")
    asked = spark.createDataFrame([(t,) for t in ("²", "½ ①", "Ⅷ 12_", "", None, "ⅷ?", "a²", "京")], "text string").withColumn("score", F.lit("mine"))
    got = {r.text: r for r in language.predict(asked, language.train(taught)).collect()}
    assert {t for t, r in got.items() if r.lang_pred == "und"} == {"²", "½ ①", "Ⅷ 12_", "", None, "ⅷ?"}
    assert all(r.score == "mine" and 0 <= r["_score"] <= 1 for r in got.values())


# -- preferences -----------------------------------------------------------------------


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", None), (4, None, None, "x"), (None, 1, "user", "q")]
    got = {r.pair_id: r for r in preferences.neighbours(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {0, 2} and got[0].n_common == 1 and got[0].prompt == "<|user|>\nhi\n<|end|>\n"
    for text, spans, want in ((got[0].chosen, got[0].chosen_mask, ["yes"]), (got[0].rejected, got[0].rejected_mask, ["no"])):
        assert [text[slice(*map(int, s.split("-")))] for s in spans.split(",")] == want
    assert got[2].n_common == 0 and got[2].rejected == "" and got[2].chosen_mask == ""
    assert preferences.neighbours(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def render(turns):
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def spans(turns):
    """Where the assistant's texts lie in what ``render`` makes, told by looking for them."""
    out, at = [], 0
    for role, text in turns:
        begin = at + len(f"<|{role}|>\n")
        if role == "assistant":
            out.append(f"{begin}-{begin + len(text)}")
        at += len(render([(role, text)]))
    return ",".join(out)


def test_answers_of_another_conversation_are_rejected(spark):
    draw = random.Random(8)
    rows = [
        (c, t if draw.random() < 0.9 else None, draw.choice(["user", "assistant", "assistant", None]), draw.choice(["yes", "né", "", None, "x" * 300_000]) if c == 4 else draw.choice(["a", "b", None]))
        for c in (0, 1, 2, 3, 4, 5, 7, 9, 12) for t in range(draw.randint(1, 7))
    ]
    rows += [(20, 0, "user", "no answer"), (21, 0, "assistant", "alone"), (None, 0, "assistant", "nobody"), (30, 0, "assistant", "same"), (31, 0, "assistant", "same")]
    whole = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            whole[c].append((t is not None, t or 0, role or "", text or ""))
    answered = {}
    for c, turns in whole.items():
        turns = [x[2:] for x in sorted(turns)]
        last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=None)
        if last is not None:
            answered[c] = turns[: last + 1]
    want = {}
    for c, a in answered.items():
        other = c ^ 1 if c ^ 1 in answered else None
        b = a[:-1] + (answered[other][-1:] if other is not None else [])
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want[c] = (other, n, render(a[:n]), render(a[n:]), render(b[n:]), spans(a[n:]), spans(b[n:]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit(1)).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in preferences.answer_pairs(df).collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 3
    assert preferences.answer_pairs(df.limit(0)).count() == 0


# -- byte-level BPE --------------------------------------------------------------------


def test_bpe(docs, nothing):
    import public_tokenizers as vocabularies
    import tiktoken

    path = vocabularies.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.decode(bpe.encode(docs, path, vocabularies.PATTERN), path).collect():
        assert list(r.ids) == own.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(nothing, path, vocabularies.PATTERN).count() == 0


# -- similarity join -------------------------------------------------------------------


def test_join(spark, nothing):
    base = [_text(s, 80).split() for s in range(4)]
    texts = [(i, " ".join(b)) for i, b in enumerate(base)]
    texts += [(10 + 10 * i + j, " ".join(b[:-1] + [f"n{j}"])) for i, b in enumerate(base) for j in range(4)]
    texts += [(100, texts[0][1]), (101, None), (102, ""), (103, "x y"), (104, "x y"), (None, texts[1][1])]
    members = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in lsh_forest.groups(members).collect() if r.doc_id is not None}
    known = {i: sets(t) for i, t in texts if i is not None and sets(t)}
    first = {}
    for i in sorted(known):
        first.setdefault(known[i], i)
    for i, s in known.items():
        links = [o for o in first if o != s and len(o & s) >= 0.8 * len(o | s)]
        assert (got[i].class_id, got[i].n_links) == (first[s], len(links))
        assert all(got[first[o]].group_id == got[i].group_id for o in links)
    assert got[101].group_id == 101 and got[102].group_id == 102
    assert lsh_forest.groups(nothing).count() == 0 and lsh_forest.one_per_group(members).count() == 4 + 1 + 2
    assert 1 - (1 - 0.8 ** lsh_forest.depth_for(0.8)) ** lsh_forest.TREES >= lsh_forest.RECALL


@pytest.mark.parametrize("block", [3, 2048])
def test_links_of_a_large_cluster(spark, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", block)
    words = _text(7, 120).split()
    texts = [(i, " ".join(words[:i] + [f"n{i}"] + words[i + 1 :])) for i in range(0, 60, 5)] + [(1, _text(8, 50)), (None, _text(9, 50))]
    members, found = lsh_forest.similar(spark.createDataFrame(texts, "doc_id long, text string"), every=True)
    names = {r.node: r.doc_id for r in members.collect()}
    got = sorted((*sorted((names[r.u], names[r.v])), round(r.jaccard, 9)) for r in found.collect())
    known = [(i, sets(t)) for i, t in texts if i is not None]
    want = [(i, j, len(a & b) / len(a | b)) for i, a in known for j, b in known if i < j]
    assert got == sorted((i, j, round(x, 9)) for i, j, x in want if x >= 0.8) and len(got) > 50
    out = lsh_forest.groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    degree = Counter(x for i, j, _ in got for x in (i, j))
    assert {r.doc_id: r.n_links for r in out if r.doc_id is not None} == {i: degree[i] for i, _ in known}


# -- licences --------------------------------------------------------------------------


def test_licenses(spark, nothing):
    texts = [(1, "Hi.\nReleased under the MIT License.\nReleased under the MIT License."), (2, "the mit was released"), (3, None), (4, ""), (5, "licensed UNDER the Apache License, version 2.0")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id"]).collect()}
    assert set(got) == {1, 5} and (got[1].licence, got[1].score, got[1].n_lines) == ("MIT", 1.0, 2) and got[5].licence == "Apache-2.0"
    assert licenses.scan(nothing, ["doc_id"]).count() == 0
