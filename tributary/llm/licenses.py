"""License scans: fuzzy search for short notices.

A notice of m characters found with at most k edits, cut into k + 1 pieces, has
one piece untouched. The pieces of all notices are exact seeds of one automaton;
only around its hits does the ``regex`` library's bounded-error matching look for
the notice, verify the edits and report the span. An edit touches at most three of a
notice's trigrams, so places that lack more of them are passed over before that.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tributary.llm.common import batches, load, map_texts

#: One edit is allowed for so many characters of a notice.
CHARACTERS_AN_EDIT = 12
#: Length of the grams by which places are passed over.
GRAM = 3

NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "licensed under the GNU General Public License v3.0"),
    ("GPL-3.0", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
)


def folded(text: str) -> str:
    """Lower case, as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


@functools.lru_cache(maxsize=4)
def machine(notices: tuple[tuple[str, str], ...] = NOTICES, characters_an_edit: int = CHARACTERS_AN_EDIT):
    seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
    rules = []
    for i, (_, notice) in enumerate(notices):
        low = folded(notice)
        edits = len(low) // characters_an_edit
        cuts = [len(low) * j // (edits + 1) for j in range(edits + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            seeds[low[a:b]].append((i, a))
        grams = [low[j : j + GRAM] for j in range(len(low) - GRAM + 1)]
        rules.append((len(low), edits, grams, len(grams) - GRAM * edits, regex.compile(rf"(?b)(?:{regex.escape(low)}){{e<={edits}}}")))
    out = ahocorasick.Automaton()
    for seed, owners in seeds.items():
        out.add_word(seed, (len(seed), tuple(owners)))
    out.make_automaton()
    return out, rules


def best(pattern: regex.Pattern, low: str, start: int, end: int) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
    """The match with the fewest edits in a range, then those on either side of it."""
    todo = [(start, end)]
    while todo:
        a, b = todo.pop()
        if a < b and (m := pattern.search(low, a, b)):
            yield m.start(), m.end(), m.fuzzy_counts
            todo += [(a, m.start()), (m.end(), b)]


def find(text: str, notices: tuple[tuple[str, str], ...] = NOTICES, characters_an_edit: int = CHARACTERS_AN_EDIT) -> list[tuple[str, int, int, int, int, int, int]]:
    """(license, start, end, edits, substitutions, insertions, deletions), sorted by place.

    Of overlapping finds the one with fewer edits stays; of equals, the longer, the earlier, the notice that is listed first.
    """
    automaton, rules = machine(notices, characters_an_edit)
    low = folded(text)
    near: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for last, (size, owners) in automaton.iter(low):
        for i, offset in owners:
            length, edits = rules[i][:2]
            at = last - size + 1 - offset
            near[i].append((max(0, at - edits), min(len(low), at + length + edits)))
    found = []
    for i, windows in near.items():
        windows.sort()
        merged = [windows[0]]
        for a, b in windows[1:]:
            if a < merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        grams, least, pattern = rules[i][2:]
        for a, b in merged:
            have = {low[j : j + GRAM] for j in range(a, b - GRAM + 1)}
            if sum(g in have for g in grams) < least:
                continue
            found += [(sum(counts), a - b, a, i, b, counts) for a, b, counts in best(pattern, low, a, b)]
    return settle(found, notices)


def settle(found, notices):
    kept: list[tuple[str, int, int, int, int, int, int]] = []
    for edits, _, start, i, end, counts in sorted(found):
        if all(end <= k[1] or start >= k[2] for k in kept):
            kept.append((notices[i][0], start, end, edits, *counts))
    return sorted(kept, key=lambda k: k[1:3])


def scan(df: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, characters_an_edit: int = CHARACTERS_AN_EDIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each notice found: id, license, ``[start, end)`` in characters, edits and their kinds.

    Null and empty texts give no rows, a null id stays null, repeated rows give
    their findings again, an empty table gives an empty one. Other columns are left
    out; one that has the id column's name gets a leading ``_``. Case is ignored, and
    where folding a letter would change the text's length the letter stays as it is.
    Texts are searched whole.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text and (got := find(text, notices, characters_an_edit)):
                    rows += [row] * len(got)
                    found += got
            parts = list(zip(*found, strict=True)) or [[]] * 7
            columns = [pa.array(parts[0], pa.string()), *(pa.array(p, pa.int32()) for p in parts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=["id", "license", "start", "end", "edits", "substitutions", "insertions", "deletions"])

    return map_texts(df, run, "license string, start int, end int, edits int, substitutions int, insertions int, deletions int", id_column, text_column)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return scan(load(spark, sf_dir, "documents"))
