"""Format pairs of conversations as preference examples.

Two conversations are compared turn by turn. Their longest common prefix of turns is the
prompt and rendered once; what follows in each is a completion, with the spans that count
for a loss: the texts of the assistant's turns, as code point ranges ``start-end`` of the completion.

Defined cases: a null role or text counts as empty; turns are ordered by number, null first, and
equal numbers by role and text; repeated turns stay; rows without a conversation id belong to no
conversation; a missing partner is an empty conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def _rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))))


def _spans(turns: Column) -> Column:
    around = len(OPEN) + len(AFTER_ROLE)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + around + F.length(turn["role"])
        end = begin + F.length(turn["text"])
        span = F.concat(state["spans"], F.when(state["spans"] != "", F.lit(",")).otherwise(F.lit("")), begin.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(turn["role"] == "assistant", span).otherwise(state["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def _said(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _turn() -> Column:
    return F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def formatted(both: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask of the conversations ``a`` (preferred) and ``b``,
    arrays of (role, text)."""
    shorter = F.least(F.size("a"), F.size("b"))
    differs = F.transform(F.slice("a", F.lit(1), shorter), lambda t, i: F.when(t != F.get("b", i), 1).otherwise(0))
    first = F.array_position(differs, 1)
    common = F.when(first > 0, first - 1).otherwise(shorter).cast("int")
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1)))
    out = both.withColumn("n_common", common)
    out = out.select(*keys, "n_common", F.slice("a", F.lit(1), F.col("n_common")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return out.select(
        *keys, F.col("n_common").cast("bigint").alias("n_common"), _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("a")).alias("chosen"), _rendered(F.col("b")).alias("rejected"),
        _spans(F.col("a")).alias("chosen_mask"), _spans(F.col("b")).alias("rejected_mask"),
    )


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``turns`` has conv_id, turn, role and text; ``pair`` names the pair of a row's conversation and
    ``chosen`` says whether it is the preferred one. A conversation's turns meet in one row, as its rendering does.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select(pair.alias("pair_id"), chosen.alias("good"), _turn().alias("t"))
    both = rows.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("good"), F.col("t")))).alias("a"),
        F.array_sort(F.collect_list(F.when(~F.col("good"), F.col("t")))).alias("b"),
    )
    return formatted(both.select("pair_id", _said(F.col("a")).alias("a"), _said(F.col("b")).alias("b")), ["pair_id"])


def answer_pairs(turns: DataFrame) -> DataFrame:
    """A pair for each conversation with an answer: conv_id, other_id and the columns of :func:`formatted`.

    The last turn of the assistant is the answer. The conversation up to it is preferred to the same conversation with the answer of
    ``other_id`` in its place, the conversation whose id differs in the last bit. Without another answer the rejected
    conversation stops before it. Conversations without an answer are nobody's pair.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), _turn().alias("t"))
    whole = rows.groupBy("conv_id").agg(_said(F.array_sort(F.collect_list("t"))).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    last = F.size("turns") - F.array_position(F.reverse(roles), "assistant").cast("int") + 1
    whole = whole.filter(F.array_contains(roles, "assistant")).withColumn("last", last)
    pair = F.struct("conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("a"), F.element_at("turns", F.col("last")).alias("answer"))
    # the two of a pair meet in one row and leave it as two
    met = whole.groupBy(F.shiftright("conv_id", 1).alias("pair_id")).agg(F.collect_list(pair).alias("both"))  # two at most
    one = met.select(F.explode("both").alias("own"), "both")
    others = F.filter("both", lambda x: x["conv_id"] != F.col("own")["conv_id"])
    start = F.slice(F.col("own")["a"], F.lit(1), F.size(F.col("own")["a"]) - 1)
    found = one.select(
        F.col("own")["conv_id"].alias("conv_id"), F.get(others, 0)["conv_id"].alias("other_id"), F.col("own")["a"].alias("a"),
        F.concat(start, F.transform(others, lambda x: x["answer"])).alias("b"),
    )
    return formatted(found, ["conv_id", "other_id"])


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations with adjacent ids: the even one preferred to the odd one after it."""
    conv = F.col("conv_id").cast("bigint")
    return preference_pairs(turns, F.shiftright(conv, 1), F.pmod(conv, F.lit(2)) == 0)
