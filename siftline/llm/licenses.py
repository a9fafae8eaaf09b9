"""License scans: lines, headers and licence files against templates, then inheritance down the directories.

A line and a template are sparse vectors of terms, weighed by how often a term
occurs times its inverse document frequency. Frequencies are counted over all
files for every term, whether a template holds it or not, so prose around a
template's terms costs likeness by how rare it is. A file's own license is that
of its best line, at ``threshold`` or more, or that of its leading comments or,
if it is a licence file by name, its whole text: each is one vector, compared
with usual headers and with full texts, at ``TEXT_THRESHOLD`` or more. An SPDX
tag there names its license outright. The best score counts. A directory's
license is the best among its licence files, and a file without its own
inherits that of the nearest directory above it that has one.

All of it is columns and joins. Vocabulary and weights of the templates are
bounded and travel as literals. A line that would stay below the threshold even
if its other words were in every file is left out at once; the others are
weighed once each, however many files hold them. The joins on directories
carry no text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import packed, store, unpacked
from siftline.operators.lookup import fits_broadcast, lookup_join

THRESHOLD = 0.6
TERM = "[a-z0-9]+(?:[.][0-9]+)*"
#: More than scores lose by rounding.
ROUNDING = 1e-5

# Usual one-line statements of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistributed under the 2-clause BSD License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Usual headers of source files; full texts lie beside this module.
_GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "{0}General Public License as published by the Free Software Foundation, either version {1} of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
    "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU "
    "{0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
HEADERS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
    "the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Copyright The Authors. All rights reserved. Use of this source code is governed by a BSD-style "
    "license that can be found in the LICENSE file.",
    "GPL-2.0": _GPL_HEADER.format("", 2),
    "GPL-3.0": _GPL_HEADER.format("", 3),
    "LGPL-3.0": _GPL_HEADER.format("Lesser ", 3),
    "MIT": "Copyright. Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
FULL_TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Long texts share common words, so their cosines are greater than those of lines.
TEXT_THRESHOLD = 0.8
# Comments and blanks from the start of a text, piece by piece.
COMMENTS = r"""\G(\s++|(?:#|//|--|;|%|<\?)[^\n]*+|/\*(?s:.*?)\*/|<!--(?s:.*?)-->|\"{3}(?s:.*?)\"{3})"""
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.-]+?)(?:-only|-or-later|[+])?(?![A-Za-z0-9.+-])"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` for ``body``: evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def template_terms(templates: dict[str, str] = TEMPLATES) -> dict[str, Counter]:
    return {name: Counter(re.findall(TERM, text.lower())) for name, text in templates.items()}


def document_frequencies(files: DataFrame) -> tuple[int, DataFrame]:
    """Number of files, and ``term, holding``, stored: how many of them hold each term."""
    held = F.array_distinct(terms(F.coalesce("text", F.lit(""))))
    # '' is no term: it counts the files.
    rows = files.select(F.explode(F.array_append(held, F.lit(""))).alias("term"))
    counts = store(rows.groupBy("term").agg(F.count("*").alias("holding")), "frequencies")
    n_files = counts.where("term = ''").first()
    return (n_files["holding"] if n_files else 0), counts.where("term <> ''")


def inverse_frequency(n_files: int, holding: int) -> float:
    return math.log((1 + n_files) / (1 + holding)) + 1


class Likeness:
    """Cosines with the templates, as columns over a line's terms."""

    def __init__(self, weights: dict[str, float], vectors: dict[str, Counter]) -> None:
        self.names = sorted(vectors)
        lengths = {n: math.sqrt(sum((c * weights[t]) ** 2 for t, c in vectors[n].items())) for n in self.names}
        # For every term: its weight, and what one occurrence adds to the product with each template.
        self.terms = sorted(weights)
        added = {t: [weights[t] ** 2 * vectors[n][t] / lengths[n] for n in self.names] for t in self.terms}
        self.squares = F.create_map(*[x for t in added for x in (F.lit(t), F.lit(weights[t] ** 2))])
        self.adds = F.create_map(*[x for t, v in added.items() for x in (F.lit(t), self._literal(v))])

    @staticmethod
    def _literal(values: list[float]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    def known(self, found: Column) -> Column:
        return F.filter(found, lambda t: t.isin(*self.terms))

    def others(self, found: Column) -> Column:
        return F.filter(found, lambda t: ~t.isin(*self.terms))

    def _dots(self, known: Column) -> Column:
        return F.aggregate(
            known,
            self._literal([0.0] * len(self.names)),
            lambda total, t: F.zip_with(total, self.adds[t], lambda a, b: a + b),
        )

    def _length(self, known: Column, others: Column) -> Column:
        """Length of a vector of known terms and ``others``, the sum of the squares of its other terms."""
        return F.sqrt(
            F.aggregate(
                F.array_distinct(known),
                others.cast("double"),
                lambda total, t: total + F.pow(F.size(F.filter(known, lambda x: x == t)), F.lit(2.0)) * self.squares[t],
            )
        )

    def at_most(self, known: Column, n_others: Column) -> Column:
        """No template's cosine is greater: no term weighs less than 1, nor is a count's square less than the count."""
        return F.array_max(self._dots(known)) / self._length(known, n_others)

    def best(self, known: Column, others: Column) -> Column:
        """``struct(score, license)``; of equal scores the first name counts."""
        return _let(
            self._length(known, others),
            lambda length: _let(
                F.transform(self._dots(known), lambda d: F.round(d / length, 6)),
                lambda scores: _let(
                    F.array_max(scores),
                    lambda top: F.struct(
                        top.alias("score"),
                        F.get(F.array(*map(F.lit, self.names)), (F.array_position(scores, top) - 1).cast("int")).alias("license"),
                    ),
                ),
            ),
        )


def possible_lines(text: Column, likeness: Likeness, threshold: float) -> Column:
    """Terms, joined by blanks, of the lines that may reach ``threshold``; each once."""

    def possible(line: Column) -> Column:
        return _let(
            terms(line),
            lambda found: _let(
                likeness.known(found),
                lambda known: F.when(
                    (F.size(known) > 0)
                    & (likeness.at_most(known, F.size(found) - F.size(known)) >= threshold - ROUNDING),
                    F.array_join(found, " "),
                ),
            ),
        )

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.array_distinct(F.filter(F.transform(lines, possible), lambda line: line.isNotNull()))


def scored_lines(lines: DataFrame, frequencies: DataFrame, n_files: int, likeness: Likeness) -> DataFrame:
    """``line`` to ``line, best``: every term weighed by its own frequency."""
    lines = store(lines.distinct(), "lines")
    others = store(
        lines.select("line", F.explode(likeness.others(F.split("line", " "))).alias("term"))
        .groupBy("line", "term").agg(F.count("*").alias("n")),
        "others",
    )
    # All terms of the corpus may be too many to repeat per salt; those of these lines are few.
    needed = store(frequencies.join(others.select("term").distinct(), "term"), "needed")
    weight = F.log(F.lit(float(1 + n_files)) / (F.col("holding") + 1)) + 1
    squares = (
        lookup_join(others, needed, key="term", spread="line")
        .groupBy("line").agg(F.sum(F.pow(F.col("n") * weight, F.lit(2.0))).alias("squares"))
    )
    known = likeness.known(F.split("line", " "))
    best = _let(known, lambda k: likeness.best(k, F.coalesce("squares", F.lit(0.0))))
    return lines.join(squares, "line", "left").select("line", best.alias("best"))


def longer_texts(path: Column, text: Column) -> Column:
    """``array(struct(key, terms, tag))``: leading comments, and the whole text of a licence file."""

    def entry(part: Column) -> Column:
        joined = F.array_join(terms(part), " ")
        tag = F.nullif(F.regexp_extract(part, SPDX, 1), F.lit(""))
        return F.when(joined != "", F.struct(F.sha2(joined, 256).alias("key"), joined.alias("terms"), tag.alias("tag")))

    comments = F.array_join(F.regexp_extract_all(text, F.lit(COMMENTS)), "\n")
    whole = F.when(F.regexp_extract(path, "([^/]*)$", 1).rlike(LICENCE_FILE), text)
    return F.filter(F.array(entry(comments), entry(whole)), lambda e: e.isNotNull())


def scored_texts(
    texts: DataFrame, frequencies: DataFrame, n_files: int, weights: dict[str, float], vectors: list[tuple[str, Counter]]
) -> DataFrame:
    """``key, terms`` to ``key, best``; equal texts are weighed once."""
    spark = texts.sparkSession
    lengths = [math.sqrt(sum((c * weights[t]) ** 2 for t, c in v.items())) for _, v in vectors]
    rows = [(t, [w * v[t] / length for (_, v), length in zip(vectors, lengths)]) for t, w in sorted(weights.items())]
    added = F.broadcast(spark.createDataFrame(rows, "term string, added array<double>"))
    counts = store(
        texts.groupBy("key").agg(F.first("terms").alias("terms"))
        .select("key", F.explode(F.split("terms", " ")).alias("term"))
        .groupBy("key", "term").agg(F.count("*").alias("n")),
        "text_terms",
    )
    needed = store(frequencies.join(counts.select("term").distinct(), "term"), "text_needed")
    weight = F.log(F.lit(float(1 + n_files)) / (F.col("holding") + 1)) + 1
    weighed = lookup_join(counts, needed, key="term", spread="key").withColumn("w", F.col("n") * weight)
    sums = weighed.join(added, "term", "left").groupBy("key").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"),
        *[F.sum(F.col("w") * F.coalesce(F.col("added")[i], F.lit(0.0))).alias(f"d{i}") for i in range(len(vectors))],
    )
    # Of equal scores the first template counts.
    scores = F.array(*[F.struct(F.round(F.col(f"d{i}") / F.col("length"), 6).alias("score"), F.lit(-i).alias("i")) for i in range(len(vectors))])
    best = F.array_max(scores)
    names = F.array(*[F.lit(n) for n, _ in vectors])
    return sums.select("key", best.alias("top")).select(
        "key", F.struct(F.col("top.score").alias("score"), F.get(names, -F.col("top.i")).alias("license")).alias("best")
    )


def scan_files(
    files: DataFrame, threshold: float, templates: dict[str, str], text_threshold: float = TEXT_THRESHOLD
) -> DataFrame:
    """``path, text`` to ``path, own_license, own_score``; nulls below the thresholds."""
    vectors = template_terms(templates)
    vocabulary = sorted(set().union(*vectors.values()))
    longer = sorted([*template_terms(HEADERS).items(), *template_terms(FULL_TEXTS).items()], key=lambda v: v[0])
    longer_vocabulary = sorted(set().union(*(v for _, v in longer)))
    n_files, frequencies = document_frequencies(files)
    known = sorted({*vocabulary, *longer_vocabulary})
    holding = {r["term"]: r["holding"] for r in frequencies.where(F.col("term").isin(known)).collect()}
    weights = {t: inverse_frequency(n_files, holding.get(t, 0)) for t in known}
    likeness = Likeness({t: weights[t] for t in vocabulary}, vectors)
    columns = [c for c in files.columns if c != "text"]
    scanned = store(
        packed(files, "path", "text")
        .withColumn("lines", possible_lines(F.col("text"), likeness, threshold))
        .withColumn("texts", longer_texts(F.col("path"), F.col("text")))
        .withColumn("_id", F.monotonically_increasing_id()).drop("text"),
        "scanned",
    )
    found = scanned.select("_id", F.explode("lines").alias("line"))
    scored = scored_lines(found.select("line"), frequencies, n_files, likeness)
    enough = store(scored.where(F.col("best.score") >= threshold), "scored")
    texts = scanned.select("_id", F.explode("texts").alias("t")).select("_id", "t.*")
    alike = scored_texts(texts, frequencies, n_files, {t: weights[t] for t in longer_vocabulary}, longer)
    like = store(alike.where(F.col("best.score") >= text_threshold), "scored_texts")
    tags = texts.where(F.col("tag").isin(sorted({*templates, *(n for n, _ in longer)})))
    own = store(
        lookup_join(found, enough, key="line", spread="_id").select("_id", "best")
        .unionByName(lookup_join(texts.select("_id", "key"), like, key="key", spread="_id").select("_id", "best"))
        .unionByName(tags.select("_id", F.struct(F.lit(1.0).alias("score"), F.col("tag").alias("license")).alias("best")))
        .groupBy("_id").agg(F.max("best").alias("best")),
        "own",
    )
    small = F.broadcast(own) if fits_broadcast(own) else own
    return scanned.join(small, "_id", "left").select(
        *unpacked(columns, ("path",)),
        F.col("best.license").alias("own_license"),
        F.col("best.score").alias("own_score"),
    )


def _parent(path: Column) -> Column:
    """Directory of a path, '' for the root; null path has null."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def _levels(directory: Column) -> Column:
    """A directory and all above it: ``array(struct(depth, directory))``, the root at depth 0."""
    parts = F.split(directory, "/")
    n = F.when(directory == "", 0).otherwise(F.size(parts))
    return F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("directory")),
    )


def inherited(scanned: DataFrame) -> DataFrame:
    """Scanned files with ``license`` and ``license_from`` (the path it comes from, or a directory).

    Directories are few against files, so ancestors are joined per directory,
    and files only look up their own.
    """
    files = scanned.withColumn("directory", _parent(F.col("path")))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    # Of equal scores the first license by name counts, so that reruns agree.
    best = (
        files.where(F.col("own_license").isNotNull() & name.rlike(LICENCE_FILE))
        .groupBy("directory", "own_license").agg(F.max("own_score").alias("s"))
        .groupBy("directory").agg(F.min_by("own_license", F.struct(-F.col("s"), "own_license")).alias("license"))
        .withColumnRenamed("directory", "above")
    )
    directories = files.where("directory IS NOT NULL").groupBy("directory").agg(F.count("*").alias("n"))
    nearest = (
        directories.select("directory", F.explode(_levels(F.col("directory"))).alias("l"))
        .select("directory", "l.depth", F.col("l.directory").alias("above"))
        .join(best, "above")
        .groupBy("directory")
        .agg(
            F.max_by("license", "depth").alias("above_license"),
            F.max_by("above", "depth").alias("above_directory"),
        )
    )
    joined = lookup_join(files, store(nearest, "directories"), "left", key="directory", spread="path")
    return joined.withColumn("license", F.coalesce("own_license", "above_license")).withColumn(
        "license_from",
        F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("above_directory")),
    ).drop("directory", "above_license", "above_directory")


def scan_licenses(
    files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES
) -> DataFrame:
    """``path, text`` and other columns to the others, ``path``, ``own_license``, ``own_score``, ``license``, ``license_from``.

    Null text holds no license; a null path inherits nothing; repeated paths
    are files of their own. An empty table gives no rows. The texts are read
    twice (frequencies, then lines and longer texts); only counts of terms, lines
    that may name a license, leading comments and licence files are shuffled.
    """
    names = {"own_license", "own_score", "license", "license_from", "best", "directory", "above_license", "above_directory"}
    kept = [c for c in files.columns if c not in names]
    return inherited(store(scan_files(files.select(kept), threshold, templates), "licenses"))
