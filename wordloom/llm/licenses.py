"""Find licences: lines and passages of a text compared with templates by Dice's coefficient.

A line is lower-cased, everything but letters and digits becomes one space, and its distinct
pairs of neighbouring words are compared with a template's. Sizes bound the coefficient, so a
template is compared only where the two sizes allow the threshold. Templates are a parameter, a
short list of literals that does not grow with the corpus. All built-in expressions.

Passages run across the ends of lines: the whole text, and at each place where a bigram of a
template occurs the words from there on, as many as the template has, without those behind the
last bigram that they share. A text with less than the needed part of a template's bigrams has none
of its passages, and a place is tried only if enough of them follow in reach. Of passages that
overlap, the one with the greatest product of score and shared bigrams stays. A passage is reported with
all the lines it touches, but not if it lies in one line that is reported already.

Defined cases: a null or empty text has no lines; a line with one word has that word as its only
bigram; of templates with equal scores the first by name wins; a repeated line is reported once per text,
with its count, and so is a repeated passage; repeated rows are reported each, for themselves; a
template of one word is compared with lines only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import free_name

# fixed values: usual one-line notices
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# headers and texts of several lines; of the longest texts (Apache, GPL) the opening, which a copy of the text begins with
_AS_IS = """IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS ' + _AS_IS
TEXTS = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this
document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."""),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not,
see <https://www.gnu.org/licenses/>."""),
    ("GPL-3.0", """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is
permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License
is a free, copyleft license for software and other kinds of works."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]


def _bigrams(words: list[str]) -> list[str]:
    return sorted(set(map(" ".join, zip(words, words[1:])))) if len(words) > 1 else words


def _words(line: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Distinct bigrams of a list of words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.transform(F.arrays_zip(F.slice(words, 1, n).alias("x"), F.slice(words, 2, n).alias("y")), lambda p: F.concat_ws(" ", p["x"], p["y"]))
    return F.when(F.size(words) < 2, words).otherwise(F.array_distinct(pairs))


def _template_words(template: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", template.lower()).split()


# exploding a list of one keeps the planner from copying the expression to each of its uses
def _once(c: Column) -> Column:
    return F.explode_outer(F.array(c))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _best(grams: Column, known: dict[str, list[str]], ratio: float) -> Column:
    """(score, licence) of the template nearest to distinct bigrams; -1 where the sizes allow none."""
    n, entries = F.size(grams), []
    for name, of in known.items():
        m = len(of)
        dice = 2.0 * F.size(F.array_intersect(grams, F.array(*map(F.lit, of)))) / (n + m)
        score = F.when((n >= m * ratio) & (n <= m / ratio), dice).otherwise(F.lit(-1.0))
        entries.append(F.struct(score.alias("score"), F.lit(name).alias("licence")))
    return F.aggregate(F.array(*entries), entries[0], lambda x, y: F.when(y["score"] > x["score"], y).otherwise(x))


def scan(docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """``keep`` columns with licence, score, line and n_lines for each distinct line, and each distinct
    passage that is not within such a line, that matches a template."""
    chosen = templates or TEMPLATES
    texts = sorted(chosen.items()) + ([] if templates else TEXTS)
    rows = docs.filter(F.length(text) > 0).select(F.struct(*keep).alias("kept"), F.split(text, r"\n").alias("lines"))
    found = _lines(rows, chosen, threshold)
    if any(len(_template_words(v)) > 1 for _, v in texts):
        found = found.unionByName(_passages(rows, texts, chosen, threshold))
    own = ("licence", "score", "line", "n_lines")
    names = free_name(docs.select(*keep), *own)
    return found.select(*[F.col("kept")[c].alias(c) for c in keep], *[F.col(c).alias(n) for c, n in zip(own, names)])


def _lines(rows: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    known = {k: _bigrams(_template_words(v)) for k, v in sorted(templates.items())}
    sizes = [len(v) for v in known.values()]
    ratio = threshold / (2 - threshold)  # the least that the smaller may be of the larger
    rows = rows.select("kept", "lines", F.explode(F.array_distinct("lines")).alias("line"))
    # a line has at least as many words as bigrams; those far too short or long need no bigrams
    n_words = F.regexp_count("line", F.lit(r"[\p{L}\p{N}]+"))
    rows = rows.filter(n_words >= int(min(sizes) * ratio))
    rows = rows.select("*", _once(_words(F.col("line"))).alias("words"))
    rows = rows.select("kept", "lines", "line", _once(_pairs(F.col("words"))).alias("grams")).withColumn("n", F.size("grams"))
    found = rows.filter((F.col("n") >= min(sizes) * ratio) & (F.col("n") <= max(sizes) / ratio))
    found = found.select("kept", "lines", "line", _once(_best(F.col("grams"), known, ratio)).alias("top")).filter(F.col("top")["score"] >= threshold)
    times = F.size(F.filter("lines", lambda x: x == F.col("line"))).cast("bigint")
    return found.select("kept", F.col("top")["licence"].alias("licence"), F.col("top")["score"].alias("score"), "line", times.alias("n_lines"))


def _passages(rows: DataFrame, texts: list[tuple[str, str]], templates: dict[str, str], threshold: float) -> DataFrame:
    ratio = threshold / (2 - threshold)
    literals, every, least = [], set(), None
    for name, template in texts:
        words = _template_words(template)
        if len(words) < 2:
            continue
        grams = _bigrams(words)
        need = math.ceil(len(grams) * ratio - 1e-9)
        every, least = every | set(grams), min(least or need, need)
        parts = {"licence": F.lit(name), "grams": F.split(F.lit("|".join(grams)), r"\|"), "m": F.lit(len(grams)), "need": F.lit(need), "reach": F.lit(len(words) - 1)}
        literals.append(F.struct(*[c.alias(k) for k, c in parts.items()]))

    line_no = F.transform("lines", lambda line, i: F.transform(_words(line), lambda w: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.select("kept", "lines", _once(F.flatten(line_no)).alias("words")).filter(F.size("words") > least)
    n = F.size("words") - 1
    both = F.arrays_zip(F.slice(F.col("words")["w"], 1, n).alias("x"), F.slice(F.col("words")["w"], 2, n).alias("y"))
    rows = rows.select("kept", "lines", "words", _once(F.transform(both, lambda p: F.concat_ws(" ", p["x"], p["y"]))).alias("pairs"))
    # most texts share few bigrams with any template and end here
    rows = rows.select("*", _once(F.array_intersect("pairs", F.split(F.lit("|".join(sorted(every))), r"\|"))).alias("some"))
    rows = rows.filter(F.size("some") >= least)
    near = F.filter(F.array(*literals), lambda t: F.size(F.array_intersect(F.col("some"), t["grams"])) >= t["need"])
    rows = rows.select("kept", "lines", "words", "pairs", _once(near).alias("near")).filter(F.size("near") > 0)

    def passage(t: Column, first: Column, last: Column) -> Column:
        def scored(part: Column) -> Column:
            shared = F.size(F.array_intersect(part, t["grams"]))
            score = 2.0 * shared / (F.size(F.array_distinct(part)) + t["m"])
            return F.struct(first.alias("first"), last.alias("last"), t["licence"].alias("licence"), score.alias("score"), (score * shared).alias("weight"))

        return _let(F.slice("pairs", first, last - first + 1), scored)

    def matches(t: Column) -> Column:
        def around(hits: Column) -> Column:
            # the needed number of hits, counted from the j-th, lies within reach of it
            starts = F.filter(hits, lambda h, j: F.coalesce(F.get(hits, j + t["need"] - 1) < h + t["reach"], F.lit(False)))
            windows = F.transform(starts, lambda h: passage(t, h, F.array_max(F.filter(hits, lambda x: x < h + t["reach"]))))
            size = F.size("pairs")
            whole = F.when((size >= t["need"]) & (size * ratio <= t["m"]), F.array(passage(t, F.lit(1), size)))
            return F.when(whole.isNull(), windows).otherwise(F.concat(windows, whole))

        hits = F.filter(F.sequence(F.lit(1), F.size("pairs")), lambda i: F.array_contains(t["grams"], F.element_at("pairs", i)))
        return F.filter(_let(hits, around), lambda w: w["score"] >= threshold)

    rows = rows.select("kept", "lines", "words", _once(F.array_sort(F.flatten(F.transform("near", matches)))).alias("wins")).filter(F.size("wins") > 0)

    def choose(kept: Column, w: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        apart = F.coalesce(last["last"] < w["first"], F.lit(True))
        without = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(apart, F.concat(kept, F.array(w))).when(w["weight"] > last["weight"], F.concat(without, F.array(w))).otherwise(kept)

    rows = rows.select("kept", "lines", "words", _once(F.aggregate("wins", F.slice("wins", 1, 0), choose)).alias("wins"))

    def shown(w: Column) -> Column:
        first, last = F.element_at("words", w["first"])["i"], F.element_at("words", w["last"] + 1)["i"]
        line = F.array_join(F.slice("lines", first + 1, last - first + 1), "\n")
        return F.struct(w["licence"].alias("licence"), w["score"].alias("score"), line.alias("line"), (first == last).alias("one"))

    rows = rows.select("kept", _once(F.transform("wins", shown)).alias("wins"))
    rows = rows.select("kept", "wins", F.explode(F.array_distinct("wins")).alias("win"))
    known = {k: _bigrams(_template_words(v)) for k, v in sorted(templates.items())}
    rows = rows.select("*", _once(_pairs(_words(F.col("win")["line"]))).alias("grams")).select("*", _once(_best(F.col("grams"), known, ratio)["score"]).alias("alone"))
    rows = rows.filter(~F.col("win")["one"] | (F.col("alone") < threshold))
    times = F.size(F.filter("wins", lambda x: x == F.col("win"))).cast("bigint")
    return rows.select("kept", *[F.col("win")[c].alias(c) for c in ("licence", "score", "line")], times.alias("n_lines"))
