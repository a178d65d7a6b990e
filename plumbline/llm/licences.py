"""Licence scan: normalised lines and paragraphs compared to licence templates by Dice's coefficient over word bigrams.

Text is lower-cased (A-Z) and everything but a-z and 0-9 becomes one space. A unit of text is a line, a paragraph of more
than one line (paragraphs end at lines without text), or a run of consecutive pieces, where a piece ends at a line end or at
white space after one of . ! ? : ; - so licences of several paragraphs and sentences inside a line are units as well. With a
bigrams in a unit and b in a template the coefficient is at most 2*min(a, b)/(a + b); so only templates with a size in reach
of the threshold are candidates, and runs only as long as their words are in reach of the template's words, too.

A text with a unit that matches a template holds at least the least size in reach of the template's bigrams. So texts and
templates are paired by that first, and units are formed in those pairs only. Only DataFrame functions are used, in one pass;
what is shuffled are the matches.

Defined results: null and empty texts match nothing; a unit may match several templates; n_units is the number of matching
lines and paragraphs, or that of matching runs that do not overlap if it is greater; repeated rows add to n_units; an empty
table gives an empty table; other columns do not matter."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import small_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Notices and permission texts of common licences.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}
THRESHOLD = 0.8


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def reach(size: int, threshold: float) -> range:
    """Sizes a with 2*min(a, size)/(a + size) >= threshold."""
    low = math.ceil(size * threshold / (2 - threshold) - 1e-9)
    return range(max(1, low), math.floor(size * (2 - threshold) / threshold + 1e-9) + 1)


def template_table(spark: SparkSession, templates: dict[str, str], threshold: float) -> DataFrame:
    """(licence, template, low, high, longest): bigrams, the sizes in reach, and the most words of a run."""
    rows = [(name, bigrams, sizes[0], sizes[-1], reach(len(template_words(text)), threshold)[-1])
            for name, text in templates.items() if (bigrams := template_bigrams(text))
            for sizes in [reach(len(bigrams), threshold)]]
    return small_table(spark, rows, "licence string, template array<string>, low int, high int, longest int")


def units(text: Column) -> Column:
    """Lines of a text, and paragraphs of two lines or more."""
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.instr(F.trim(p), "\n") > 0)
    return F.concat(F.split(text, "\n"), paragraphs)


def normal_words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")


def bigrams(w: Column) -> Column:
    """Pairs of neighbours of two words or more, with repeats."""
    n = F.size(w)
    return F.zip_with(F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """explode(array(x)) keeps a costly x from being computed again in every filter and join key that uses it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _score(pairs: Column) -> Column:
    """Coefficient of a unit's pairs and the template; null if the sizes are out of reach."""
    def of(own: Column) -> Column:
        size = F.size(own)
        common = F.size(F.array_intersect(own, F.col("template")))
        return F.when((size >= F.col("low")) & (size <= F.col("high")), 2 * common / (size + F.size("template")))

    return F.transform(F.array(F.array_distinct(pairs)), of)[0]


def _unit_scores(threshold: float) -> Column:
    """Scores of the matching lines and paragraphs."""
    words = F.filter(F.transform(units(F.col("text")), normal_words), lambda w: F.size(w) >= 2)
    return F.filter(F.transform(words, lambda w: _score(bigrams(w))), lambda s: s >= threshold)


def _with_runs(rows: DataFrame, threshold: float) -> DataFrame:
    """The rows with the matching runs of pieces, (end, start, score) by end; a run's places are its words."""
    pieces = F.filter(F.transform(F.split("text", r"\n|(?<=[.!?:;])[ \t\r]+"), normal_words), lambda w: w[0] != "")
    cut = _once(rows, "pieces", pieces)
    ends = F.aggregate("pieces", F.array(F.lit(0)), lambda at, w: F.concat(at, F.array(F.element_at(at, -1) + F.size(w))))
    cut = _once(_once(cut, "at", ends), "pairs", bigrams(F.flatten("pieces")))

    def fits(start: Column):
        return lambda end: (end > start + F.col("low")) & (end <= start + F.col("longest"))

    def run(start: Column):
        return lambda end: F.struct(end.alias("end"), start.alias("start"), _score(
            F.slice("pairs", start + 1, end - start - 1)).alias("score"))

    # a piece has a word at least, so the ends within `longest` words are among the next `longest` ends
    runs = F.flatten(F.transform("at", lambda start, i: F.transform(
        F.filter(F.slice("at", i + 2, F.col("longest")), fits(start)), run(start))))
    return _once(cut, "found", F.array_sort(F.filter(runs, lambda r: r["score"] >= threshold)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, score, n_units): best coefficient and number of matching units per document and template."""
    known = sorted({b for t in templates.values() for b in template_bigrams(t)})
    least = min((reach(len(b), threshold)[0] for t in templates.values() if (b := template_bigrams(t))), default=1)
    words = _once(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), "w", normal_words(F.col("text")))
    shared = F.array_intersect(bigrams(F.col("w")), F.array(*[F.lit(b) for b in known]).cast("array<string>"))
    hit = _once(words.where(F.size("w") >= 2), "hits", shared).where(F.size("hits") >= least).select("doc_id", "text", "hits")
    table = template_table(docs.sparkSession, templates, threshold)
    rows = hit.join(F.broadcast(table), F.size(F.array_intersect("hits", "template")) >= F.col("low"))
    found = _once(_with_runs(rows, threshold), "scores", _unit_scores(threshold)).select("doc_id", "licence", "scores", "found")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    apart = F.aggregate("found", zero, lambda s, r: F.when(r["start"] >= s["end"], F.struct(
        r["end"].alias("end"), (s["n"] + 1).alias("n"))).otherwise(s))["n"]
    best = F.array_max(F.concat("scores", F.transform("found", lambda r: r["score"])))
    return found.where((F.size("scores") > 0) | (F.size("found") > 0)).groupBy("doc_id", "licence").agg(
        F.max(best).alias("score"), F.greatest(F.sum(F.size("scores")), F.sum(apart)).alias("n_units"))
