"""License scan [native DataFrame functions].

A document is compared with licence templates unit by unit: its lines, its
paragraphs (split at blank lines), the sentences of its paragraphs (which end at
. ! or ? before white space and run on over line ends, so that a notice inside
prose or wrapped over lines is one) and its whole text, each distinct unit once.
Normalising lower-cases and turns every run of ASCII characters other than
letters, digits and line ends into one space.  Two word sequences are compared by the
Dice coefficient over their word bigrams, counted with repeats:

    dice = 2 * common bigrams / (bigrams of the unit + bigrams of the template)

A unit of a bigrams can reach dice >= t with a template of b bigrams only if
t / (2 - t) * b <= a <= (2 - t) / t * b.  This bound prunes nearly all pairs
before any bigram is made, and a unit that has no bigram of any template is
compared with none.  Everything happens within the row: no shuffle.

Edge cases: a null or empty text has one empty unit and no match.  Units of
one word have no bigram and match nothing.  Ties go to the higher dice, then
the smaller licence id.  Repeated rows and shared or null doc_ids give a row
each; an empty table gives none.  Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import let

THRESHOLD = 0.8

# Licence notices and short licence texts.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, '
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


# Runs of ASCII characters other than letters, digits and line ends.
_BETWEEN = "[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _normal(text: Column) -> Column:
    """The normalised lines of a text, empty ones too."""
    return F.transform(F.split(F.lower(F.regexp_replace(text, _BETWEEN, " ")), "\n"), lambda x: F.trim(x))


#: Stands where a sentence ends while a text is normalised.
_STOP = "\u2029"


def _sentences(text: Column) -> Column:
    """The normalised sentences of a text's paragraphs."""
    marked = F.regexp_replace(text, "[.!?]+([\\x20\\x09-\\x0D])", _STOP + "$1")
    paragraphs = F.split(F.array_join(_normal(marked), "\n"), "\n\n+")
    return F.flatten(F.transform(paragraphs, lambda p: F.transform(F.split(F.replace(p, F.lit("\n"), F.lit(" ")), _STOP), lambda s: F.trim(s))))


def _bigrams(unit: Column) -> Column:
    """A 64-bit hash of every bigram of a normalised unit."""
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(w[i], w[i + 1]))
    return let(F.split(unit, " "), lambda w: F.when(F.size(w) < 2, F.array().cast("array<bigint>")).otherwise(pairs(w)))


def _whole(lines: Column) -> Column:
    return F.array_join(F.array_remove(lines, ""), " ")


def _units(lines: Column, sentences: Column) -> Column:
    """Distinct units of normalised lines: the lines, the paragraphs where a
    blank line parts some, the whole; and the sentences."""
    paragraphs = lambda joined: F.when(F.instr(joined, "\n\n") > 0, F.transform(F.split(joined, "\n\n+"), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" ")))))
    return F.array_distinct(F.concat(lines, F.coalesce(let(F.array_join(lines, "\n"), paragraphs), F.array().cast("array<string>")), sentences, F.array(_whole(lines))))


def _spaces(unit: Column) -> Column:
    """Spaces of a normalised unit: its words less one, that is its bigrams."""
    return F.char_length(unit) - F.char_length(F.replace(unit, F.lit(" "), F.lit("")))


def _templates(spark, templates: dict[str, str], threshold: float) -> tuple[Column, list[int]]:
    """The templates as one constant array, smallest id first: id, bigrams,
    sizes that can match, distinct bigrams and how often each occurs; and all
    their bigrams."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    row = spark.range(1).select(*[_bigrams(_whole(_normal(F.lit(t)))).alias(k) for k, t in templates.items()]).first()
    known = [(k, len(row[k]), sorted(set(row[k])), row[k]) for k in sorted(templates) if row[k]]
    constant = F.array(
        *[
            F.struct(
                F.lit(k).alias("license_id"),
                F.lit(n).alias("n"),
                F.lit(math.ceil(low * n - 1e-9)).alias("least"),
                F.lit(math.floor(high * n + 1e-9)).alias("most"),
                F.array(*map(F.lit, grams)).alias("grams"),
                F.array(*[F.lit(every.count(g)) for g in grams]).alias("counts"),
                F.lit(max(every.count(g) for g in grams)).alias("repeat"),
            )
            for k, n, grams, every in known
        ]
    )
    return constant, sorted({g for _, _, grams, _ in known for g in grams})


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_units, n_matches (unit and template pairs of dice >=
    threshold), license_id and dice of the best match (null without one),
    matches (unit, license_id, dice) of every matching pair."""
    known, grams = _templates(docs.sparkSession, TEMPLATES if templates is None else templates, threshold)
    every = F.array(*map(F.lit, grams)).cast("array<bigint>")

    def compare(unit: Column, ours: Column, t: Column) -> Column:
        """A struct if the unit matches the template, else null."""
        both = F.size(ours) + t["n"]
        # Few pairs share enough distinct bigrams to be counted with repeats.
        may = 2 * t["repeat"] * F.size(F.array_intersect(t["grams"], ours)) >= threshold * both
        common = F.aggregate(
            F.arrays_zip(t["grams"].alias("g"), t["counts"].alias("c")),
            F.lit(0),
            lambda n, x: n + F.least(x["c"], F.size(F.filter(ours, lambda y: y == x["g"]))),
        )
        found = lambda dice: F.when(dice >= threshold, F.struct(unit.alias("unit"), t["license_id"].alias("license_id"), dice.alias("dice")))
        return F.when(may, let(2.0 * common / both, found))

    def of_unit(unit: Column) -> Column:
        fitting = lambda a: F.filter(known, lambda t: (a >= t["least"]) & (a <= t["most"]))
        none = F.array().cast("array<struct<unit:string,license_id:string,dice:double>>")
        pairs = lambda ours: F.transform(fitting(F.size(ours)), lambda t: compare(unit, ours, t))
        return let(_bigrams(unit), lambda ours: F.when(F.arrays_overlap(every, ours), pairs(ours)).otherwise(none))

    fits = lambda unit: let(_spaces(unit), lambda a: F.exists(known, lambda t: (a >= t["least"]) & (a <= t["most"])))
    text = F.coalesce(F.col("text"), F.lit(""))
    units = docs.select("doc_id", let(_normal(text), lambda lines: _units(lines, _sentences(text))).alias("units"))
    matched = units.select("doc_id", F.size("units").cast("bigint").alias("n_units"), F.array_compact(F.flatten(F.transform(F.filter("units", fits), of_unit))).alias("matches"))
    best = F.get(F.array_sort(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("less"), m["license_id"].alias("license_id")))), F.lit(0))
    return matched.select(
        "doc_id",
        "n_units",
        F.size("matches").cast("bigint").alias("n_matches"),
        best["license_id"].alias("license_id"),
        (-best["less"]).alias("dice"),
        "matches",
    )
