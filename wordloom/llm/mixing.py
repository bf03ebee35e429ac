"""Mix sources to target weights with hash thresholds.

A source's target is its weight's share of all tokens, at most ``most`` times its size; what
that leaves over goes to the other sources by weight. A source gives whole repeats of all its
rows, and the rest of its target comes from the rows whose hash lies below a threshold. The
threshold is found from histograms: tokens by source and leading bits of the hash, then the
same inside the one bucket where the target falls, and so on down to one hash. Rows are never
sorted, and a smaller target takes a subset of what a larger one takes.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a row
of size 0 is taken 0 words; equal rows share a hash and a decision; an empty table gives no rows.
The driver holds one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.llm.common import free_name
from wordloom.operators.joins import lookup
from wordloom.session import local_table, materialize

SHIFTS = (52, 40, 28, 16, 4, 0)
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column = "text") -> Column:
    """Number of runs of bytes other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fill(sizes: list[int], weights: list[float], most: int) -> list[float]:
    """Targets by weight that share the sum of sizes, none above ``most`` times its size."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ -= over
    return targets


def _thresholds(rows: DataFrame, rest: dict[str, float]) -> dict[str, tuple[int, float, int]]:
    """For each source the last hash that it takes, how many words of that hash, and how many there are. ``rows``: skey, hash, size."""
    out: dict[str, tuple[int, float, int]] = {}
    state = {k: (0, 0.0) for k in rest}  # prefix, tokens below it
    for level, shift in enumerate(SHIFTS):
        if not state:
            break
        table = local_table(rows.sparkSession, [(k, p, b, rest[k]) for k, (p, b) in state.items()], "s string, prefix bigint, below double, rest double")
        part = lookup(rows, table.limit(len(state)), "skey", "s", len(state), how="inner")
        if level:
            part = part.filter(F.shiftright("hash", SHIFTS[level - 1]) == F.col("prefix"))
        buckets = part.groupBy("skey", F.shiftright("hash", shift).alias("bucket"), "below", "rest").agg(
            F.sum("size").alias("size"), F.min("hash").alias("lo"), F.max("hash").alias("hi")
        )
        run = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        crossing = buckets.withColumn("upto", F.col("below") + F.sum("size").over(run)).filter("upto >= rest")
        first = crossing.groupBy("skey").agg(F.min(F.struct("bucket", "upto", "size", "lo", "hi", "rest")).alias("x")).collect()
        state = {}
        for r in first:
            x = r.x
            if x.lo != x.hi:
                state[r.skey] = (x.bucket, float(x.upto - x.size))
            else:
                out[r.skey] = (x.hi, x.rest - (x.upto - x.size), int(x.size))
    return out


def mix(docs: DataFrame, keep: list[str], weights=None, source: str = "source", text: str = "text", seed: int = 0, most: int = 3, identity: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with size, source_size, target, taken and times of every row.

    ``taken`` are words: the row at the threshold gives only those that its source still needs, so that a source of few and long
    texts meets its target too. ``times`` are whole texts, for those who take no parts.

    ``weights`` maps the ordered source names (null as None) to numbers; by default 1, 2, 3, repeating.
    """
    skey = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("~"))
    rows = docs.select(
        F.struct(*keep).alias("kept"), skey.alias("skey"), words(text).alias("size"),
        F.xxhash64(F.lit(seed), *identity, text).alias("hash"),
    )
    rows = materialize(rows, "mix-sizes")
    found = rows.groupBy("skey").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: r.skey)  # "s…" comes before "~", so null is last
    names = [None if r.skey == "~" else r.skey[1:] for r in found]
    weigh = weights or (lambda sources: [1 + i % 3 for i in range(len(sources))])
    sizes = [r["size"] for r in found]
    targets = fill(sizes, weigh(names), most)
    whole = [min(int(t // s), most) if s else 0 for t, s in zip(targets, sizes)]
    rest = {r.skey: t - w * s for r, t, w, s in zip(found, targets, whole, sizes) if s and t - w * s > 0 and w < most}
    cut = _thresholds(rows.select("skey", "hash", "size"), rest)
    table = local_table(
        docs.sparkSession,
        [(r.skey, s, t, w, *cut.get(r.skey, (None, None, None))) for r, s, t, w in zip(found, sizes, targets, whole)],
        "s string, source_size bigint, target double, whole int, cut bigint, need double, cut_size bigint",
    )
    joined = lookup(rows, table.limit(max(len(found), 1)), "skey", "s", max(len(found), 1))
    # rows at the last hash share what is still needed; as whole rows they are taken if that comes nearer
    at_cut = F.col("hash") == F.col("cut")
    share = F.when(F.col("hash") < F.col("cut"), 1.0).when(at_cut & (F.col("cut_size") > 0), F.col("need") / F.col("cut_size"))
    share = F.coalesce(share, F.lit(0.0))
    times = F.col("whole") + (share >= 0.5).cast("int")
    words_taken = F.col("size") * F.col("whole") + F.least(F.round(F.col("size") * share).cast("bigint"), F.col("size"))
    size, ssize, target, taken, n = free_name(docs.select(*keep), "size", "source_size", "target", "taken", "times")
    return joined.select(
        *[F.col("kept")[c].alias(c) for c in keep], F.col("size").alias(size), F.col("source_size").alias(ssize),
        F.col("target").alias(target), words_taken.alias(taken), times.alias(n),
    )
