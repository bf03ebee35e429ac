"""Text functions over string columns.

Everything is a built-in expression except compatibility decomposition, which Spark
lacks; that one runs on Arrow batches and receives only rows holding non-ASCII text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: classes of characters, as regular expressions
CONTROL = r"[\p{C}&&[^\n\t\r]]"
UNICODE_SPACE = r"(?U)\s"
PUNCTUATION = r"\p{P}!-/:-@\[-`{-~"
WORD_CHARS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{IsAlphabetic}\p{IsJoin_Control}"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# small letters that have no decomposition and keep their form when a text is normalised
PLAIN_LETTERS = "ßæðøþđħıĸłŋœŧ"

# fixed values: headings that open the closing sections of an encyclopedia article, in order
WIKI_HEADINGS = [
    "Gallery",
    "See [Aa]lso",
    "Notes and [Rr]eferences",
    "Notes",
    "Endnotes",
    "Foot[Nn]otes",
    "Works [Cc]ited",
    "References",
    "Sources",
    "Citations",
    "Bibliography",
    "Further [Rr]eading",
    "External [Ll]inks",
]

TextFunction = Callable[[Column], Column]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- normalisation ---------------------------------------------------------------------


def prenormalize(c: Column | str) -> Column:
    """Turn every control or unassigned character, except tab and line ends, into a line end."""
    return F.regexp_replace(_col(c), CONTROL, "\n")


def is_ascii(c: Column | str) -> Column:
    return _col(c).rlike(r"\A[\x00-\x7F]*\z")


@F.arrow_udf(T.StringType())
def _decompose(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, form="NFKD")


@F.arrow_udf(T.StringType())
def _fold(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_normalize(text, form="NFKD"), pattern=r"\p{M}+", replacement="")


def _non_ascii_only(fn: TextFunction, c: Column) -> Column:
    # a null input lets the Arrow function pass over a row; a `when` around the call would not
    return F.coalesce(fn(F.when(~is_ascii(c), c)), c)


def nfkd(c: Column | str) -> Column:
    """Compatibility decomposition."""
    return _non_ascii_only(_decompose, _col(c))


def strip_accents(c: Column | str) -> Column:
    """Remove combining marks."""
    return F.regexp_replace(_col(c), r"\p{M}", "")


def fold_accents(c: Column | str) -> Column:
    """Decompose, then remove combining marks, in one pass."""
    return _non_ascii_only(_fold, _col(c))


def lowercase(c: Column | str) -> Column:
    """Lower-case character by character: a capital sigma becomes the medial form everywhere."""
    return F.lower(F.replace(_col(c), F.lit("Σ"), F.lit("σ")))


def drop_control(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), CONTROL, "")


def blank_whitespace(c: Column | str) -> Column:
    """Each whitespace character becomes one space; runs keep their length."""
    return F.regexp_replace(_col(c), UNICODE_SPACE, " ")


def normalize(c: Column | str) -> Column:
    """Decompose, strip accents, lower-case, drop controls, blank whitespace."""

    return _normalize_folded(fold_accents(c))


def _normalize_folded(c: Column) -> Column:
    def cleaned(x: Column) -> Column:
        # printable ASCII characters, tabs and line ends hold no other control character or white space
        simple = x.rlike(r"\A[\t\n\r\x20-\x7E]*\z")
        return F.when(simple, F.regexp_replace(F.lower(x), r"[\t\n\r]", " ")).otherwise(blank_whitespace(drop_control(lowercase(x))))

    return F.transform(F.array(c), cleaned)[0]  # computes the text once


# -- splitting -------------------------------------------------------------------------


def split_words(c: Column | str) -> Column:
    """Words, single punctuation characters, and runs of other symbols, in order."""
    pattern = f"[{PUNCTUATION}]|[{WORD_CHARS}]+|[^\\s\\p{{Z}}{PUNCTUATION}{WORD_CHARS}]+"
    listed = "".join(f"\\{mark}" for mark in ASCII_PUNCTUATION)  # one by one they are looked up, ranges are compared with

    def words(x: Column) -> Column:
        # of characters between space and ~ and those of words all are spaces, punctuation or parts of words, and spaces can split them
        spaced = F.split(F.regexp_replace(x, f"[{listed}]", " $0 "), " ")
        simple = x.rlike(rf"\A[\x20-\x7E{WORD_CHARS}]*\z")
        return F.when(simple, F.array_remove(spaced, "")).otherwise(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))

    return F.transform(F.array(_col(c)), words)[0]  # computes the text once


# A break needs whitespace behind it and text after it. Kinds of break, in order:
# after ? or !; after a closing quote or bracket; after a full stop that ends neither an
# ellipsis nor an initial nor a number; after any single full stop before a non-letter.
SENTENCE_BREAKS = {
    "rules": (
        r"""(?:(?<=[?!])"""
        r"""|(?<=[?!.]["')\]])"""
        r"""|(?<=[.])(?<!\.\.)(?<!(?:^|[\s("'])[a-z]\.)(?<![0-9]\.)"""
        r"""|(?<=\.)(?<!\.\.)(?=\s+[^a-z]))"""
        r"""\s+(?=\S)"""
    ),
    "plain": r"(?<=[.!?])\s+(?=\S)",
}


def split_sentences(c: Column | str, kind: str = "rules", abbreviations: Sequence[str] = ()) -> Column:
    """Sentences of a text, trimmed, without empty ones.

    ``abbreviations`` (lower case, without the final stop, at most 20 characters) add words
    that never end a sentence.
    """
    if kind not in SENTENCE_BREAKS:
        raise ValueError(f"kind must be one of {sorted(SENTENCE_BREAKS)}")
    pattern = SENTENCE_BREAKS[kind]
    if abbreviations:
        for word in abbreviations:
            if not word.replace(".", "").isalnum() or len(word) > 20:
                raise ValueError(f"not an abbreviation: {word!r}")
        listed = "|".join(word.replace(".", r"\.") for word in abbreviations)
        pattern = rf"(?<!\b(?:{listed})\.)" + pattern
    parts = F.transform(F.split(_col(c), pattern), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def parse_sentences(
    c: Column | str, normalizer: TextFunction = normalize, splitter: TextFunction = split_sentences
) -> Column:
    return splitter(normalizer(_col(c)))


def parse_words(c: Column | str, normalizer: TextFunction = normalize, splitter: TextFunction = split_words) -> Column:
    if (normalizer, splitter) != (normalize, split_words):
        return splitter(normalizer(_col(c)))
    # the usual pair takes the texts that are plain once their accents are folded in one step, the rest as any pair does
    parsed = _parse_plain(_col(c))
    return F.coalesce(parsed["words"], split_words(_normalize_folded(parsed["folded"])))


SPACE, LETTER, MARK = range(3)
CUT_BYTES = 1024 * 1024  # of text that is cut at one time, about
_kinds = np.full(256, LETTER, np.uint8)
_kinds[[ord(x) for x in "\t\n\r "]] = SPACE
_kinds[[ord(x) for x in ASCII_PUNCTUATION]] = MARK
_small = np.arange(256, dtype=np.uint8)
_small[65:91] += 32


PARSED = T.StructType([T.StructField("folded", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])


@F.arrow_udf(PARSED)
def _parse_plain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The words of texts of printable ASCII characters, tabs, line ends and PLAIN_LETTERS; the other texts with their accents folded.
    A worker holds what is made of one piece of a batch."""
    for batch in batches:
        rows = max(1, len(batch) * CUT_BYTES // max(batch.nbytes, 1))
        yield from (_parse_piece(batch.slice(low, rows)) for low in range(0, len(batch), rows))


def _parse_piece(text: pa.Array) -> pa.Array:
    text = text.cast(pa.string())
    ascii_only = pc.fill_null(pc.string_is_ascii(text), True)
    if not pc.all(ascii_only).as_py():
        others = pc.utf8_normalize(text.filter(pc.invert(ascii_only)), form="NFKD")
        text = pc.replace_with_mask(text, pc.invert(ascii_only), pc.replace_substring_regex(others, pattern=r"\p{M}+", replacement=""))
    plain = pc.fill_null(pc.match_substring_regex(text, rf"\A[\t\n\r\x20-\x7E{PLAIN_LETTERS}]*\z"), False).to_numpy(zero_copy_only=False)
    rows = np.arange(len(text))
    offsets, words = _cut_plain(text.take(pa.array(rows, mask=~plain)))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words, mask=pa.array(~plain))
    return pa.StructArray.from_arrays([text.take(pa.array(rows, mask=plain)), lists], names=["folded", "words"])


def _cut_plain(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words of plain texts, and the place of each text's first one among them; null texts have none."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    held = text.drop_null()  # their bytes lie side by side
    data = np.zeros(0, np.uint8)
    if ends[-1]:
        at = np.frombuffer(held.buffers()[1], np.int32)[held.offset]
        data = np.frombuffer(held.buffers()[2], np.uint8)[at : at + ends[-1]]
    first, kept, starts, last, done = [], [], [], SPACE, 0
    for low in range(0, len(data), CUT_BYTES):
        part = data[low : low + CUT_BYTES]
        kind = _kinds[part]
        before = np.concatenate([np.array([last], np.uint8), kind[:-1]])
        opens = ends[np.searchsorted(ends, low) : np.searchsorted(ends, low + len(part))] - low
        before[opens] = SPACE
        last = kind[-1]
        stays = kind != SPACE
        begins = stays & ((kind == MARK) | (before != LETTER))
        first.append(np.flatnonzero(begins) + low)
        kept.append(_small[part[stays]])
        starts.append(np.flatnonzero(begins[stays]).astype(np.int32) + np.int32(done))
        done += len(kept[-1])
    places = np.concatenate([*starts, [done]]).astype(np.int32)
    letters = np.concatenate([np.zeros(0, np.uint8), *kept])
    words = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(letters))
    return np.searchsorted(np.concatenate([np.zeros(0, np.int64), *first]), ends), words


def word_ngrams(words: Column | str, n: int) -> Column:
    """All contiguous runs of ``n`` items as an array of arrays."""
    w = _col(words)
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.slice(w, i, n))


def join_words(words: Column | str) -> Column:
    return F.concat_ws(" ", _col(words))


# -- corpus-specific cleaning ----------------------------------------------------------


def article_body(c: Column | str, headings: Sequence[str] = tuple(WIKI_HEADINGS)) -> Column:
    """Cut an article at each heading line, one heading after the other.

    A heading counts where one whitespace character and a line end follow it; headings are
    not anchored to the start of a line.
    """
    body = _col(c)
    for heading in headings:
        body = F.regexp_replace(body, rf"(?sU){heading}\s\n.*\z", "")
    return body


# fixed values: split contractions that join without an apostrophe between the parts
JOINED_PAIRS = [
    ("can", "not"),
    ("d", "'ye"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("more", "'n"),
    ("wan", "na"),
]

# the space inside any of these pairs
PAIR_GAP = r"(?i)\s(?:" + "|".join(rf"(?<=\b{a}\s)(?={b}\b)" for a, b in JOINED_PAIRS) + ")"

# fixed values: spacing rules, applied in order to a text padded with one space on each side
DETOKENIZE_PADDED = [
    (r"(?i) ('t)\s(is|was)\b", " $1$2"),
    (PAIR_GAP, ""),
    (r"([^' ])\s('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1$2 "),
    (r"([^' ])\s('[sS]|'[mM]|'[dD]|') ", "$1$2 "),
    (r"(\S)\s('')", "$1$2"),
    (r"('')\s([.,:)\]>};%])", "$1$2"),
    (r"''", '"'),
]

# fixed values: spacing rules, applied in order after the padding is gone
DETOKENIZE_TRIMMED = [
    (r" -- ", "--"),
    (r"([\[({<])\s", "$1"),
    (r"\s([\])}>])", "$1"),
    (r"([\])}>])\s([:;,.])", "$1$2"),
    (r"([^'])\s'\s", "$1' "),
    (r"\s([?!])", "$1"),
    (r"""([^.])\s(\.)([\])}>"']*)\s*$""", "$1$2$3"),
    (r"([#$])\s", "$1"),
    (r"\s([;%])", "$1"),
    (r"\s\.\.\.\s", "..."),
    (r"\s([:,])", "$1"),
    (r"([ (\[{<])\s``", "$1``"),
    (r"(``)\s", "$1"),
    (r"``", '"'),
]

# fixed values: bracket names used by tree-annotated text
BRACKET_NAMES = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def detokenize(c: Column | str, convert_brackets: bool = False) -> Column:
    """Undo Treebank tokenisation of a text whose tokens are separated by whitespace."""
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " ")), F.lit(" "))
    for pattern, replacement in DETOKENIZE_PADDED:
        text = F.regexp_replace(text, pattern, replacement)
    text = F.trim(text)
    if convert_brackets:
        for name, bracket in BRACKET_NAMES.items():
            text = F.replace(text, F.lit(name), F.lit(bracket))
    for pattern, replacement in DETOKENIZE_TRIMMED:
        text = F.regexp_replace(text, pattern, replacement)
    return F.trim(text)


# -- user functions --------------------------------------------------------------------


def from_python(fn: Callable[[], Callable[[str], object]], return_type: str) -> TextFunction:
    """Wrap a Python text function or model.

    ``fn`` is a factory: it runs once per task and returns the function for one text, so a
    model loads once, not per row. Rows travel in Arrow batches.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    def apply(batches):
        one = fn()
        for batch in batches:
            yield batch.map(lambda text: None if text is None else one(text))

    from collections.abc import Iterator

    import pandas as pd

    apply.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(apply, return_type)
