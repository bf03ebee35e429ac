"""Cleaning chains per kind of corpus."""

from __future__ import annotations

from wordloom.functions.text import article_body, detokenize, normalize, parse_sentences, prenormalize

RECIPES = {
    # tokenised book sentences: undo the tokenisation; already one sentence per record
    "bookcorpus": [detokenize, normalize],
    # web text: normalise and split into sentences
    "commoncrawl": [parse_sentences],
    # articles: controls to line ends, cut the closing sections, then as above
    "wikipedia": [prenormalize, article_body, parse_sentences],
}
