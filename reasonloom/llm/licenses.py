"""Licence notices in texts, by the Dice coefficient over word bigrams.

A text is cut into units: its lines, its sentences with line breaks read as blanks, its paragraphs,
and the whole. So a notice is found on a line of its own, inside a paragraph and wrapped over lines,
and a licence by its whole text or by the sentence that tells it from all others.
Units and templates are normalised to words in lower case. A unit is compared with the templates
of like size only: at a coefficient of t, sizes differ at most by a factor of t / (2 - t). A unit
belongs to the template of the highest coefficient, ties to the first name; so of versions whose
notices differ in a word, that word decides. A licence whose text is part of another's (`WITHIN`) is
not reported beside it.

Two exact prunings come first. A unit that reaches t shares so many bigrams with its template that
one of a few chosen bigrams of the template is among them; a text without any of their longer
words is passed over, and so is such a unit. There is no join and no Python, and the templates are
literals of the plan.

Defined results: null and empty texts have no notice; repeated rows and rows of one id are one;
null ids are kept as an id; an empty table gives no row; other columns are ignored; a very long text
is one row, whose units a task holds.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wordings of licences and of the notices that they ask for.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including '
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:"
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial "
    'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
    "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
    "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
ISC_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
    "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
    "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission."
)
BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
BSD_2 = f"{BSD_HEAD} {BSD_REST}"
BSD_3 = f"{BSD_HEAD} {BSD_THIRD} {BSD_REST}"
GNU = (
    "you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the "
    "Free Software {} either version {} of the License, or (at your option) any later version."
)
TEMPLATES = (
    ("agpl-3.0", f"This program is free software: {GNU.format('Affero General', 'Foundation,', '3')}"),
    ("agpl-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2-clause", "Released under the 2-Clause BSD License."),
    ("bsd-3-clause", "Released under the 3-Clause BSD License."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-2-clause", BSD_2),
    ("bsd-3-clause", BSD_3),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("gpl-2.0", f"This program is free software; {GNU.format('General', 'Foundation;', '2')}"),
    ("gpl-2.0", "This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", f"This program is free software: {GNU.format('General', 'Foundation,', '3')}"),
    ("gpl-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc", ISC_GRANT),
    ("isc", f"{ISC_GRANT} {ISC_REST}"),
    ("lgpl-2.1", f"This library is free software; {GNU.format('Lesser General', 'Foundation;', '2.1')}"),
    ("lgpl-2.1", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    ("lgpl-3.0", f"This library is free software: {GNU.format('Lesser General', 'Foundation,', '3')}"),
    ("lgpl-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("mit", MIT_GRANT),
    ("mit", f"{MIT_GRANT} {MIT_REST}"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


# A licence, and the one whose text holds all of its own.
WITHIN = (("bsd-2-clause", "bsd-3-clause"),)


@dataclass(frozen=True)
class LicenseConfig:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    threshold: float = 0.8


def bigrams_of(text: str) -> list[str]:
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def signature_words(cfg: LicenseConfig) -> list[str]:
    """Words of which a text with a notice holds one at least.

    A unit at the threshold t shares t / (2 - t) of a template's b bigrams or more, so it misses
    fewer than one more than the rest, and among any so many there is a shared one.
    """
    chosen = set()
    for _, text in cfg.templates:
        pairs = bigrams_of(text)
        shared = math.ceil(cfg.threshold * len(pairs) / (2 - cfg.threshold) - 1e-9)
        rare = sorted(pairs, key=lambda p: (-max(map(len, p.split())), p))
        for pair in rare[: len(pairs) - shared + 1]:
            chosen.add(max(pair.split(), key=len))
    return sorted(chosen)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def units_of(text: Column) -> Column:
    sentence_ends = F.regexp_replace(F.translate(text, "\n", " "), r"([.!?:])[ \t]+", "$1\n")
    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    lists = (F.split(text, "\n"), F.split(sentence_ends, "\n"), paragraphs, F.array(text))
    return F.array_distinct(F.concat(*lists))


def _pairs(words: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(words) - 2)
    pairs = F.transform(at, lambda i: F.concat(words[i], F.lit(" "), words[i + 1]))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def _template_literals(cfg: LicenseConfig) -> Column:
    return F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, bigrams_of(text))).alias("pairs"))
            for name, text in cfg.templates
        )
    )


def scan(docs: DataFrame, cfg: LicenseConfig | None = None) -> DataFrame:
    """doc_id, license_id, dice: the best unit of each licence found in a document."""
    cfg = cfg or LicenseConfig()
    t = cfg.threshold
    signature = F.array(*map(F.lit, signature_words(cfg)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    likely = rows.filter(F.arrays_overlap(words_of(F.col("text")), signature))
    units = likely.select("doc_id", F.explode(units_of(F.col("text"))).alias("unit"))
    # words and bigrams are held by one-row generators: later filters do not compute them again
    worded = units.select("doc_id", F.inline(F.array(F.struct(words_of(F.col("unit")).alias("words")))))
    sizes = [len(bigrams_of(text)) for _, text in cfg.templates]
    most = int(max(sizes) * (2 - t) / t) + 1
    worded = worded.filter(F.size("words") >= 2).filter(F.arrays_overlap("words", signature))
    paired = worded.select("doc_id", F.inline(F.array(F.struct(_pairs(F.col("words")).alias("pairs")))))
    paired = paired.filter(F.size("pairs") <= most)

    def compare(template: Column) -> Column:
        a, b = F.size("pairs"), F.size(template["pairs"])
        alike = (a * (2 - t) >= b * t - 1e-9) & (b * (2 - t) >= a * t - 1e-9)
        shared = F.size(F.array_intersect(F.col("pairs"), template["pairs"]))
        dice = F.when(alike, 2.0 * shared / (a + b)).otherwise(0.0)
        return F.struct((-dice).alias("minus"), template["name"].alias("name"))

    best = F.array_min(F.transform(_template_literals(cfg), compare))
    found = paired.select("doc_id", F.inline(F.array(best))).filter(F.col("minus") <= -t)
    licences = found.groupBy("doc_id", F.col("name").alias("license_id")).agg(
        F.round(F.max(-F.col("minus")), 6).alias("dice")
    )
    # at most one entry a licence in a list
    of_doc = licences.groupBy("doc_id").agg(F.collect_list(F.struct("license_id", "dice")).alias("all"))
    names = F.col("all.license_id")

    def alone(entry: Column) -> Column:
        return ~reduce(
            Column.__or__,
            ((entry["license_id"] == part) & F.array_contains(names, whole) for part, whole in WITHIN),
        )

    return of_doc.select("doc_id", F.inline(F.filter("all", alone)))


def oracle_sql(cfg: LicenseConfig | None = None) -> str:
    """The same result in DuckDB's SQL, comparing every unit with every template."""
    cfg = cfg or LicenseConfig()
    values = ", ".join(
        "('{}', '{}')".format(name, text.replace("'", "''")) for name, text in cfg.templates
    )
    within = ", ".join(f"('{part}', '{whole}')" for part, whole in WITHIN)
    pairs = (
        "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    )
    words = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH units AS (
  SELECT DISTINCT doc_id, unnest(list_concat(
    string_split(text, chr(10)),
    string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)),
    string_split_regex(text, '\\n[ \\t\\r]*\\n'), [text]
  )) AS unit FROM documents
), worded AS (SELECT doc_id, {words.format("unit")} AS w FROM units),
paired AS (SELECT doc_id, {pairs} AS p FROM worded WHERE len(w) >= 2),
templates AS (
  SELECT license_id, {pairs} AS p FROM (
    SELECT license_id, {words.format("text")} AS w FROM (VALUES {values}) v(license_id, text)
  )
), scored AS (
  SELECT doc_id, license_id, 2.0 * len(list_intersect(u.p, t.p)) / (len(u.p) + len(t.p)) AS dice,
    u.p AS p
  FROM paired u JOIN templates t ON len(u.p) * {2 - cfg.threshold} >= len(t.p) * {cfg.threshold} - 1e-9
    AND len(t.p) * {2 - cfg.threshold} >= len(u.p) * {cfg.threshold} - 1e-9
), best AS (
  SELECT doc_id, p, min(struct_pack(minus := -dice, name := license_id)) AS b
  FROM scored WHERE dice >= {cfg.threshold} GROUP BY doc_id, p
)
SELECT doc_id, license_id, dice FROM (
  SELECT doc_id, b.name AS license_id, round(max(-b.minus), 6) AS dice,
    list(b.name) OVER (PARTITION BY doc_id) AS names FROM best GROUP BY doc_id, b.name
) WHERE NOT EXISTS (
  SELECT 1 FROM (VALUES {within}) w(part, whole) WHERE part = license_id AND list_contains(names, whole))
"""
