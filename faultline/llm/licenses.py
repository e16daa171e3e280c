"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies. DataFrame functions only.

A template of n shingles is looked for in windows of n + step - 1 shingles at every multiple of step = n // 4, so it lies whole in one. A
window that holds at least 0.8 of its shingles has a similarity of at least 0.8 / 1.45 to it, and with 32 bands of 2 rows is retrieved with
a probability above 0.9999 (``retrieval_chance``). Two exact tests come first and lose nothing: a text must hold a word without which no
template reaches the threshold, and a window must hold enough shingles of any template. All work is within rows: no shuffle, no group.
"""

from __future__ import annotations

from dataclasses import dataclass
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import spans as sp
from .shared import text_of

SHINGLE = 5
CONTAINMENT = 0.8
BANDS, ROWS = 32, 2

# FIXED VALUES: notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "All-rights-reserved": "All rights reserved.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                         'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                         "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
                      "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                      "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
                      "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                      "copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                      "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-version": "either version 2 of the License, or (at your option) any later version.",
    "LGPL-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                      "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                      "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                      "in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
                    "this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
               "You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public "
               "domain worldwide. This software is distributed without any warranty.",
}


def word_list(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def words_of(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(words: Column, size: int) -> Column:
    """64-bit names of all runs of ``size`` words, in order."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(size))))) \
        .otherwise(F.array().cast("array<bigint>"))


def band_keys(names: Column) -> Column:
    """One key per band: a hash of ROWS minima of the names under seeded hashes."""
    least = lambda seed: F.array_min(F.transform(names, lambda h: F.xxhash64(h, seed)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[least(b * ROWS + r) for r in range(ROWS)]))


def retrieval_chance(similarity: float) -> float:
    return 1 - (1 - similarity ** ROWS) ** BANDS


@dataclass
class Template:
    name: str
    size: int  # words in a shingle: five, or all words of a shorter notice
    names: list[int]
    keys: list[int]
    gate: list[str]

    @property
    def step(self) -> int:
        return max(1, len(self.names) // 4)

    @property
    def window(self) -> int:
        return len(self.names) + self.step - 1

    @property
    def need(self) -> int:
        return -(-len(self.names) * 8 // 10)


def gate_words(words: list[str], size: int) -> list[str]:
    """Words of which a text must have one to hold 0.8 of the shingles: they stand in more than 0.2 of them."""
    runs = [set(words[i:i + size]) for i in range(len(words) - size + 1)]
    chosen: list[str] = []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(bool(r & set(chosen)) for r in runs) * 5 > len(runs):
            break
        chosen.append(w)
    return chosen


def compile_templates(spark: SparkSession, templates: dict[str, str]) -> list[Template]:
    """Names and band keys by the same expressions that texts go through; one row of a fixed number of columns."""
    sizes = {k: min(SHINGLE, len(word_list(t))) for k, t in templates.items() if word_list(t)}
    names = {k: F.array_distinct(shingles(words_of(F.lit(templates[k])), n)) for k, n in sizes.items()}
    row = spark.range(1).select(*[F.struct(c.alias("names"), band_keys(c).alias("keys")).alias(k) for k, c in names.items()]).first()
    return [Template(k, n, row[k]["names"], row[k]["keys"], gate_words(word_list(templates[k]), n)) for k, n in sizes.items()]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


MATCH = "struct<license:string,start_word:int,end_word:int,containment:double>"


def _in_window(t: Template, at: Column, window: Column, keys: Column) -> Column:
    """The template's match in a window, or null: retrieved by a band, then verified exactly."""
    mine = _longs(t.names)
    places = F.filter(F.transform(window, lambda h, i: F.when(F.array_contains(mine, h), i)), lambda i: i.isNotNull())
    share = F.size(F.array_intersect(mine, window)) / F.lit(float(len(t.names)))
    found = F.struct(F.lit(t.name).alias("license"), (at + F.array_min(places)).alias("start_word"),
                     (at + F.array_max(places) + t.size).alias("end_word"), share.alias("containment")).cast(MATCH)
    return F.when(F.arrays_overlap(keys, _longs(t.keys)) & (share >= CONTAINMENT), found)


def license_matches(text: Column, templates: list[Template]) -> Column:
    """The matches of all windows, as an array; of a window's text only words count."""
    def in_windows(names: Column, length: int, same: list[Template]):
        return lambda at: sp.let(F.slice(names, at + 1, F.lit(length)), lambda w: sp.let(
            band_keys(w), lambda keys: F.array(*[_in_window(t, at, w, keys) for t in same])))

    def of_size(names: Column, group: list[Template]) -> Column:
        known = _longs(sorted({h for t in group for h in t.names}))

        def with_hits(hit: Column) -> Column:
            parts = []
            for step, length in sorted({(t.step, t.window) for t in group}):
                same = [t for t in group if (t.step, t.window) == (step, length)]
                need = min(t.need for t in same)
                starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(names) - 1, F.lit(0)), F.lit(step)),
                                  lambda at: F.size(F.filter(F.slice(hit, at + 1, F.lit(length)), lambda x: x)) >= need)
                parts.append(F.filter(F.flatten(F.transform(starts, in_windows(names, length, same))), lambda m: m.isNotNull()))
            return F.concat(*parts)

        return sp.let(F.transform(names, lambda h: F.array_contains(known, h)), with_hits)

    def of_words(words: Column) -> Column:
        groups = [[t for t in templates if t.size == n] for n in sorted({t.size for t in templates})]
        return F.concat(*[sp.let(shingles(words, g[0].size), by_group(g)) for g in groups])

    def by_group(group: list[Template]):
        return lambda names: of_size(names, group)

    low, gate = F.lower(text), None
    for w in sorted({w for t in templates for w in t.gate}):
        gate = low.contains(w) if gate is None else gate | low.contains(w)
    return F.when(gate, sp.let(words_of(text), of_words)).otherwise(F.array().cast(f"array<{MATCH}>"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, start_word, end_word, containment, windows: one row per row of ``docs`` and license that it holds.

    Place and containment are those of the best window (the first of equals), words counted from 0; windows is how many reach the
    threshold. Null and empty texts hold no license; repeated rows repeat their result, null ids stay null, other columns are ignored,
    and an empty table gives no rows. Templates without words are left out.
    """
    compiled = compile_templates(docs.sparkSession, templates)
    found = docs.select("doc_id", license_matches(text_of(), compiled).alias("all"))
    each = found.filter(F.size("all") > 0).select("doc_id", "all", F.explode(F.array_distinct(F.transform("all", lambda m: m["license"]))).alias("license"))
    mine = F.filter("all", lambda m: m["license"] == F.col("license"))
    best = F.element_at(F.array_sort(F.transform(mine, lambda m: F.struct((-m["containment"]).alias("order"), m["start_word"].alias("start_word"),
                                                                         m["end_word"].alias("end_word")))), 1)
    return each.select("doc_id", "license", best.alias("best"), F.size(mine).cast("bigint").alias("windows")).select(
        "doc_id", "license", F.col("best.start_word"), F.col("best.end_word"), (-F.col("best.order")).alias("containment"), "windows")
