"""Quality rules whose failures are judged host by host.

Each text is measured and held against rules. The failures of a rule are counted by host, and a host's rate of
failure is shrunk towards all hosts' by a beta prior that the hosts themselves determine: of its moments the mean is the share of
all rows that fail, and the spread is what the hosts' rates differ by beyond what chance alone gives rows so few. A host
whose shrunk rate exceeds a limit under any rule is rejected, and the verdict is joined back to its rows.
A host of two bad pages is thus not condemned by them, where hosts are alike no host is, and a large host is judged by its own rows.

Defined cases: a null or empty text has no words and fails the rule on their number; rows without a host are judged alone and
teach nothing; equal rows count as often as they are there; an empty table gives no rows. Columns kept may have any name.
Whether words are equal is told by 64 bits of them, whether lines are by the lines. The driver holds a row per rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import BASE, SPACE, RollingHash, bounded_batches, free_name, splitmix, word_hashes
from wordloom.operators.joins import attach
from wordloom.session import materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MAX_RATE = 0.5  # shrunk rate of failure above which a host is rejected
WINDOW = 3  # words

# fixed values: the characters that count as symbols
SYMBOLS = b"#*$%&|<>"

Rule = Callable[[Callable[[str], Column]], Column]
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda c: c("n_words") < 50,
    "repeated_words": lambda c: 100 * c("n_repeat_words") > 50 * c("n_words"),
}
HOST_RULES: dict[str, Rule] = {
    **BASE_RULES,
    "symbols": lambda c: 10 * c("n_symbols") > c("n_words"),
    "word_length": lambda c: (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words")),
    "repeated_lines": lambda c: 10 * c("n_dup_lines") > c("n_words"),
}

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
# of bytes: 1 where a character starts that is no white space
IN_WORD = np.ones(256, bool)
IN_WORD[0x80:0xC0] = False
IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more. ``words``: their hashes in order."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(BASE) + words[k : k + n]
    rolled = splitmix(rolled)
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= again
    return int(np.count_nonzero(covered))


def measure(data: bytes, roll: RollingHash) -> tuple[int, int, int, int, int]:
    """The MEASURES of a text in UTF-8."""
    points = np.frombuffer(data, np.uint8)
    _, words = word_hashes(data, roll)
    seen: set[bytes] = set()
    repeated = 0
    if b"\n" in data:
        for line in data.split(b"\n"):
            if line in seen:
                repeated += 1
            elif line and SPACE.sub(b"", line):
                seen.add(line)
    return len(words), int(IN_WORD[points].sum()), int(IS_SYMBOL[points].sum()), repeated, repeated_words(words)


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the MEASURES of ``text``, under the names of the latter that are free."""
    bounded_batches(docs.sparkSession)
    names = free_name(docs.select(*keep), *MEASURES)
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(n, T.LongType(), False) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash()
        for batch in batches:
            found = [measure((t.as_py() or "").encode(), roll) for t in batch.column(len(keep))]
            columns = list(zip(*found)) if found else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, pa.int64()) for c in columns]], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def prior(hosts: int, rows: int, squares: float, failed: int, shares: float) -> tuple[float, float]:
    """Mean and strength (rows that it is worth) of the beta prior by moments. Sums over hosts of: one, rows n, n squared,
    failures f, f squared / n. Hosts that differ by no more than chance give an infinite strength."""
    mean = failed / rows
    pq = mean * (1 - mean)
    spare = rows - squares / rows - (hosts - 1)
    if hosts < 2 or pq <= 0 or spare <= 0:
        return mean, float("inf")
    between = (shares - failed * failed / rows - pq * (hosts - 1)) / (pq * spare)
    return mean, (1 / between - 1 if 0 < between < 1 else float("inf") if between <= 0 else 0.0)


def verdicts(rows: DataFrame, host: str, rules: dict[str, Column], max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host: host, n_rows, per rule its failures (failed_…) and shrunk rate (rate_…), and rejected."""
    failed = [F.sum(F.coalesce(rule, F.lit(False)).cast("bigint")).alias(f"failed_{name}") for name, rule in rules.items()]
    hosts = rows.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_rows"), *failed)
    hosts = materialize(hosts, "host-failures")
    n = F.col("n_rows")
    sums = [F.count("*").alias("hosts"), F.sum("n_rows").alias("rows"), F.sum(n.cast("double") * n).alias("squares")]
    for name in rules:
        f = F.col(f"failed_{name}")
        sums += [F.sum(f).alias(f"f_{name}"), F.sum(f.cast("double") * f / n).alias(f"s_{name}")]
    total = hosts.agg(*sums).first()
    rates, over = [], F.lit(False)
    for name in rules:
        mean, strength = prior(total["hosts"], total["rows"], total["squares"], total[f"f_{name}"], total[f"s_{name}"]) if total["hosts"] else (0.0, 0.0)
        f = F.col(f"failed_{name}")
        rate = F.lit(mean) if strength == float("inf") else (f + strength * mean) / (n + strength)
        # where hosts do not differ the common rate tells nothing about one
        over = over | (F.lit(False) if strength == float("inf") else rate > max_rate)
        rates.append(rate.alias(f"rate_{name}"))
    return hosts.select("*", *rates, over.alias("rejected"))


def judge(docs: DataFrame, keep: list[str], host: str, text: str = "text", base=None, rules=None, max_rate: float = MAX_RATE) -> DataFrame:
    """``keep`` columns, the MEASURES, base_failed, and kept: neither failed by a base rule nor of a rejected host."""
    base, rules = BASE_RULES if base is None else base, HOST_RULES if rules is None else rules
    place, body = free_name(docs, "host", "body")
    source = docs.select(*keep, F.col(host).alias(place), F.col(text).alias(body))
    names = dict(zip(MEASURES, free_name(source.drop(body), *MEASURES)))
    failed, verdict = free_name(docs.select(*keep), "base_failed", "kept")
    rows = materialize(measured(source, [*keep, place], body), "measures")
    column = lambda name: F.col(names[name])
    found = verdicts(rows, place, {name: rule(column) for name, rule in rules.items()}, max_rate)
    gone, bad = free_name(rows, "gone", "bad")
    rejected = found.filter("rejected").select(F.col("host").alias(gone), F.lit(True).alias(bad))
    rows = attach(rows.withColumn(failed, _any(base, column)), rejected, place, gone)
    return rows.withColumn(verdict, ~F.col(failed) & F.col(bad).isNull()).drop(bad, place)


def _any(rules: dict[str, Rule], column: Callable[[str], Column]) -> Column:
    out = F.lit(False)
    for rule in rules.values():
        out = out | F.coalesce(rule(column), F.lit(False))
    return out
