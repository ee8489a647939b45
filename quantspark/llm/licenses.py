"""License scans by conditional compression.

A notice may stand anywhere in a text that holds a cue of license wording: on one line, wrapped over many, or inside
a longer line. Candidate blocks are the stretches of words that share enough words with a template, cut to where the
template's words lie best. Each candidate is compressed alone and once more with the template as zstandard raw
dictionary: the more of it the template already says, the fewer bytes remain. Candidates are ranked by the bytes that
the template saves, and confirmed in that order by exact wording differences: one that repeats enough words of its
template is reported unless better ones rest on the same words.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wording of license notices by name. One name may have several wordings.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "Licensed under the BSD License."),
    ("BSD", "Released under the BSD License."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is licensed under a Creative Commons CC0 1.0 Universal License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

WORDS = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*", re.UNICODE)
TAIL = re.compile(r"[^\w\s]*")
#: A line break and what precedes the first word of the next line, such as comment signs.
BREAK = re.compile(r"\n\W*")
#: Least share of the bytes that the template must save, least share of equal words.
MIN_REDUCTION, MIN_EQUAL = 0.25, 0.8
#: What a word between words of the template costs an alignment, where an equal word gains 1 and a missing one costs 1,
#: and the least score for each word of the template: 0.8 equal words spread over three times its length.
EXTRA, MIN_SCORE = 0.2, 0.16
#: The same where an alignment is to stay close together: a far word of the template never makes a block longer then.
CLOSE = 1.0
#: No alignment of that score is longer than (1 - MIN_SCORE) / EXTRA + 1 = 5.2 templates, so that it lies in some
#: window of 7 template lengths that starts at a multiple of one.
WINDOW = 7
#: Share of a template's words that another one's wording says too, from which the two could be taken for each other.
ALIKE = 0.6
#: Differing words in a row that must all be equal; of longer runs, such as a clause, MIN_EQUAL.
EXACT_RUN = 4
#: Words of its own that a license needs beside an overlapping one.
OWN = 2
FOUND_TYPE = "array<struct<license:string, start:int, end:int, reduction:double, equal_words:int, block_words:int, template_words:int>>"


@dataclass(frozen=True)
class Template:
    name: str
    compressor: object
    words: list[str]
    ids: np.ndarray
    #: Place of each vocabulary word in counts, -1 where the template lacks it, and how often the template has it.
    place: np.ndarray
    counts: np.ndarray
    #: Runs of places that tell it from look-alikes, words of which one must be said, and words that tell look-alikes.
    telling: tuple[tuple[int, ...], ...]
    anchors: frozenset[str]
    rivals: tuple[frozenset[str], ...]


@lru_cache(maxsize=1)
def _templates() -> tuple:
    """(plain compressor, vocabulary of all templates, templates)."""
    import zstandard as z

    plain = z.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)
    vocabulary: dict[str, int] = {}
    worded = [(name, wording, WORDS.findall(wording.lower())) for name, wording in TEMPLATES]
    for _, _, words in worded:
        for word in words:
            vocabulary.setdefault(word, len(vocabulary))
    templates = []
    for name, wording, words in worded:
        raw = " ".join(wording.lower().split()).encode()
        data = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        ids = np.array([vocabulary[w] for w in words])
        distinct, counts = np.unique(ids, return_counts=True)
        place = np.full(len(vocabulary), -1)
        place[distinct] = np.arange(len(distinct))
        told = [_differences(words, other) for rival, _, other in worded if rival != name]
        runs = {run for alike, mine, _ in told if alike for run in mine} | {(k,) for k, word in enumerate(words) if re.search(r"\d[.]\d", word)}
        rivals = tuple({theirs for alike, _, theirs in told if alike and theirs})
        compressor = z.ZstdCompressor(level=19, dict_data=data, write_content_size=False, write_checksum=False)
        templates.append(Template(name, compressor, words, ids, place, counts, tuple(sorted(runs)), anchors(words), rivals))
    return plain, vocabulary, tuple(templates)


def anchors(words: list[str]) -> frozenset[str]:
    """Words of which a notice must say one: those of licensing, or where there are none the longest word."""
    return frozenset(w for w in words if "licens" in w) or frozenset([max(words, key=len)])


def _differences(words: list[str], other: list[str]) -> tuple[bool, list[tuple[int, ...]], frozenset[str]]:
    """(whether a wording could be taken for words, runs of places of words that it lacks, words that it has instead)."""
    same = difflib.SequenceMatcher(None, words, other, autojunk=False).get_matching_blocks()
    alike = sum(b.size for b in same) >= ALIKE * len(words)
    runs, own, i, j = [], set(), 0, 0
    for b in same:
        if b.a > i:
            runs.append(tuple(range(i, b.a)))
        own |= set(other[j : b.b])
        i, j = b.a + b.size, b.b + b.size
    return alike, runs, frozenset(own - set(words))


#: A text that may hold a notice: each needs one of its template's anchors.
CUE_SQL = "(?i)" + "|".join(sorted({"licens" if "licens" in a else re.escape(a) for _, w in TEMPLATES for a in anchors(WORDS.findall(w.lower()))}))
CUE = re.compile(CUE_SQL)


def _stretches(t: Template, at: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of n words that share enough words with the template, repetitions counted, to
    confirm it. at and ids are the places and numbers of the words that any template has."""
    m, k = len(t.ids), len(t.counts)
    place = t.place[ids]
    here = place >= 0
    if np.count_nonzero(here) < MIN_EQUAL * m:
        return []
    bins = -(-n // m)
    filled = np.bincount(at[here] // m * k + place[here], minlength=bins * k).reshape(bins, k)
    sums = np.concatenate([np.zeros((1, k), np.int64), np.cumsum(filled, axis=0)])
    first = np.arange(bins)
    window = sums[np.minimum(first + WINDOW, bins)] - sums[first]
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(np.minimum(window, t.counts).sum(axis=1) >= MIN_EQUAL * m).tolist():
        start, end = i * m, min((i + WINDOW) * m, n)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _align(template: np.ndarray, words: np.ndarray, extra: float) -> np.ndarray:
    """The best score of the whole template against words that end at each place; the start is free."""
    fall = extra * np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1)
    for word in template:
        after = row - 1
        np.maximum(after[1:], np.where(words == word, row[:-1] + 1, -np.inf), out=after[1:])
        row = np.maximum.accumulate(after + fall) - fall
    return row[1:]


def _spans(t: Template, words: np.ndarray, extra: float) -> list[tuple[int, int]]:
    """(start, end) of the best alignments, none over another, of the template in a stretch of words."""
    score = _align(t.ids, words, extra)
    least = MIN_SCORE * len(t.ids) - 1e-9
    padded = np.concatenate([[-np.inf], score, [-np.inf]])
    peaks = np.flatnonzero((score >= least) & (score > padded[:-2]) & (score >= padded[2:]))
    out: list[tuple[int, int]] = []
    for end in peaks[np.argsort(-score[peaks], kind="stable")].tolist():
        i = bisect_right(out, (end, len(words)))
        if i and out[i - 1][1] > end:
            continue
        low = max(out[i - 1][1] if i else 0, end + 1 - WINDOW * len(t.ids))
        back = _align(t.ids[::-1], words[low : end + 1][::-1], extra)
        if back.max() >= least:
            out.insert(i, (end - int(back.argmax()), end + 1))
    return out


@lru_cache(maxsize=4096)
def size_reduction(i: int, block: str) -> tuple[int, float]:
    """(bytes that template i saves as raw dictionary, their share of what the block takes without it)."""
    plain, _, templates = _templates()
    raw = block.encode("utf-8", "surrogatepass")
    alone = len(plain.compress(raw))
    saved = alone - len(templates[i].compressor.compress(raw))
    return saved, saved / alone


@lru_cache(maxsize=4096)
def same_words(i: int, block: str) -> tuple[int, tuple[int, ...]]:
    """(words of the block, places of those that template i says, in order)."""
    words = WORDS.findall(block)
    blocks = difflib.SequenceMatcher(None, _templates()[2][i].words, words, autojunk=False).get_matching_blocks()
    return len(words), tuple(p for b in blocks for p in range(b.b, b.b + b.size))


@lru_cache(maxsize=4096)
def names_it(i: int, block: str) -> bool:
    """Whether the block says what tells template i from its look-alikes, and nothing that tells one of them instead.

    Every short run of telling words is said whole, of a longer one most words, and one of the anchors; and no gap between
    the template's words is filled with words that only a look-alike has.
    """
    t, words = _templates()[2][i], WORDS.findall(block)
    blocks = difflib.SequenceMatcher(None, t.words, words, autojunk=False).get_matching_blocks()
    said = {p for b in blocks for p in range(b.a, b.a + b.size)}
    if not any(t.words[p] in t.anchors for p in said):
        return False
    for run in t.telling:
        if len(said.intersection(run)) < len(run) * (1 if len(run) <= EXACT_RUN else MIN_EQUAL):
            return False
    ends = [(b.b, b.b + b.size) for b in blocks if b.size]
    for (_, stop), (start, _) in zip(ends, ends[1:], strict=False):
        gap = words[stop:start]
        if gap and any(sum(w in rival for w in gap) >= MIN_EQUAL * len(gap) for rival in t.rivals):
            return False
    return True


def find_licenses(text: str | None) -> list[tuple]:
    """Every confirmed license of a text, by place; null and empty texts have none."""
    if not text or not CUE.search(text):
        return []
    _, vocabulary, templates = _templates()
    places = [m.span() for m in WORDS.finditer(text)]
    ids = np.array([vocabulary.get(text[a:b].lower(), -1) for a, b in places], np.int64)
    at = np.flatnonzero(ids >= 0)
    known = ids[at]
    candidates = []
    for i, t in enumerate(templates):
        for low, high in _stretches(t, at, known, len(ids)):
            # A stray word of the template far off may stretch the better alignment beyond what its bytes confirm.
            for start, end in sorted({*_spans(t, ids[low:high], EXTRA), *_spans(t, ids[low:high], CLOSE)}):
                first, last = low + start, low + end
                # A block ends with the punctuation of its last word.
                stop = TAIL.match(text, places[last - 1][1]).end()
                block = " ".join(BREAK.sub(" ", text[places[first][0] : stop]).lower().split())
                saved, reduction = size_reduction(i, block)
                if reduction >= MIN_REDUCTION and names_it(i, block):
                    candidates.append((-saved, -reduction, i, first, last, stop, block))
    rows: list[tuple] = []
    taken: dict[str, set[int]] = {}
    used: set[int] = set()
    for _, less, i, first, last, stop, block in sorted(candidates):
        t = templates[i]
        n_words, equal = same_words(i, block)
        said = {first + p for p in equal}
        inside = taken.setdefault(t.name, set())
        if len(said) < MIN_EQUAL * len(t.words) or not inside.isdisjoint(range(first, last)) or len(said - used) < min(OWN, len(said)):
            continue
        inside.update(range(first, last))
        used |= said
        rows.append((t.name, places[first][0], stop, -less, len(said), n_words, len(t.words)))
    return sorted(rows, key=lambda r: (r[1], r[2], r[0]))


def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([find_licenses(x) for x in batch], dtype=object)


def with_licenses(docs: DataFrame, text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """docs with the confirmed licenses of each text. Texts without a cue never reach Python."""
    found = F.pandas_udf(_scan, FOUND_TYPE)(F.when(F.col(text_col).rlike(CUE_SQL), F.col(text_col)))
    return docs.withColumn(out_col, found)


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per confirmed license: doc_id, license, start, end (code points, end exclusive), reduction, equal_words,
    block_words, template_words. Null and empty texts have none; null ids keep theirs; repeated rows give
    repeated results, an empty table none. Texts and lines of any length are scanned whole."""
    rows = with_licenses(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", F.explode("licenses").alias("found")).select("doc_id", "found.*")
