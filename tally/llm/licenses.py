"""License scans by conditional compression.

Candidate blocks are the stretches of a text around cue words. Cues come from the templates:
of each one more word than a match may lack, so that every match holds a cue of its own
template. A block reaches to both sides as many words as the longest match can have, over
lines and comment signs of any width, and overlapping blocks are one. Long blocks are gone
through in windows of bounded size that overlap by the longest match, so that the work grows
with the text. What stands in a window
is compressed (in lower case) alone and with each template as a raw zstandard dictionary;
templates are ranked by how much smaller they make it. All are tried in that order until one is
confirmed by the exact differences in wording: a template matches if at most ``tolerance`` of
its words are missing from the block in order. A short notice in long prose may save nothing,
so that savings give the order only; templates of whose words too many are nowhere in the
block need no comparison. Matching words far from the rest of a match count as missing. What stands before and after a match is scanned again, so
that several notices in one block are all found.

Null and empty texts and texts without cues give no rows, others one row per notice.
Whole texts are scanned; of a very long one only blocks are split into words. Repeated rows give repeated results; null ids are kept as null;
other input columns are ignored; an empty table gives an empty result. Templates that save
equally much go by name. Placeholders in angle brackets stand for any words.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import text_ranges

TOLERANCE = 0.1  # share of a template's words that may be missing
WINDOW = 4  # longest matches that a window holds
LEGAL = re.compile(r"(?i)licen[cs]|copyright|warrant|redistribut|spdx|permission")  # words of this kind are the first choice as cues
# Wordings of public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "all-rights-reserved": "Copyright <year> <owner>. All rights reserved.",
}
_WORD = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*").finditer
_HOLE = re.compile(r"<[^<>]*>")


def words(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words with their places."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD(text)]


def reach(text: str, at: int, n: int, backward: bool) -> int:
    """Place of the ``n``-th word before or after ``at`` (or the text's end)."""
    size = 16 * n
    while True:
        a, b = (max(0, at - size), at) if backward else (at, min(len(text), at + size))
        found = words(text[a:b])
        if len(found) > n or (a == 0 if backward else b == len(text)):  # the outermost word may be cut
            break
        size *= 2
    if len(found) <= n:
        return a if backward else b
    return a + found[-n][1] if backward else a + found[n - 1][2]


def blocks(text: str, cue: re.Pattern, n: int) -> list[tuple[int, int]]:
    """Spans of ``n`` words to both sides of every cue, overlapping ones joined."""
    out: list[list[int]] = []
    for m in cue.finditer(text):
        if out and m.end() <= out[-1][2]:  # far inside: only the right end moves
            out[-1][3] = m.end()
            continue
        if out:
            out[-1][1] = reach(text, out[-1][3], n, False)
        a = reach(text, m.start(), n, True)
        if out and a <= out[-1][1]:
            out[-1][3] = m.end()
        else:
            out.append([a, m.end(), 0, m.end()])
        out[-1][2] = m.end() + n  # n words are more than n characters
    if out:
        out[-1][1] = reach(text, out[-1][3], n, False)
    return [(a, b) for a, b, *_ in out]


def aligned(want: list[str], found: list[tuple[str, int, int]], least: float, most: float) -> tuple[int, int, int, int] | None:
    """Words missing and added, first and last matching word, of the matching blocks that stay within both limits.

    Blocks at both ends are dropped, and their words count as missing, if the words between
    would be too many; of the ways to do so, one with the fewest missing and then added words.
    """
    match = difflib.SequenceMatcher(None, want, [w for w, _, _ in found], autojunk=False)
    same = [(j, n) for _, j, n in match.get_matching_blocks() if n]
    best = None
    for x in range(len(same)):
        hits = 0
        for y in range(x, len(same)):
            hits += same[y][1]
            first, last = same[x][0], sum(same[y])
            got = len(want) - hits, last - first - hits, first, last
            if got[1] > most:
                break
            if got[0] <= least and (best is None or got < best):
                best = got
    return best


def stretches(want: list[str], found: list[tuple[str, int, int]], size: int, least: float) -> Iterator[int]:
    """Places where a match can begin: one of the template's first words, and enough of its words among the next ``size``."""
    there = np.array([w for w, _, _ in found], object)
    ends = np.minimum(np.arange(len(there)) + size, len(there))
    hits = np.zeros(len(there), np.int64)
    for w, n in Counter(want).items():
        upto = np.concatenate([[0], np.cumsum(there == w)])
        hits += np.minimum(n, upto[ends] - upto[:-1])
    begins = set(want[: int(least) + 1])
    for at in np.flatnonzero(hits >= len(want) - least).tolist():
        if there[at] in begins:
            yield at


class Scanner:
    """Templates as dictionaries of the compressor, and their words."""

    def __init__(self, templates: dict[str, str], tolerance: float):
        self.tolerance = tolerance
        self.alone = zstandard.ZstdCompressor(level=9)
        templates = {k: t for k, t in templates.items() if words(_HOLE.sub(" ", t))}
        self.given = {k: zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(_HOLE.sub("", t).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in sorted(templates.items())}
        self.words = {k: [w for w, _, _ in words(_HOLE.sub(" ", t))] for k, t in templates.items()}
        self.holes = {k for k, t in templates.items() if _HOLE.search(t)}
        self.longest = max((len(w) + int(self.most(k)) for k, w in self.words.items()), default=0) + 1
        self.cue = re.compile(cues(self.words, tolerance))

    def most(self, name: str) -> float:
        """Words that may stand between those of a match."""
        return 2 * self.tolerance * len(self.words[name]) + 8 * (name in self.holes)

    def savings(self, block: str) -> list[tuple[str, int]]:
        """Templates by the bytes they save, most first."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(raw))
        return sorted(((k, size - len(c.compress(raw))) for k, c in self.given.items()), key=lambda x: -x[1])

    def differences(self, name: str, found: list[tuple[str, int, int]]) -> tuple[int, int, int, int, str] | None:
        """Words missing and added, first and last matching word, and the wording that differs; None if it does not match."""
        want = self.words[name]
        if sum((Counter(want) - Counter(w for w, _, _ in found)).values()) > self.tolerance * len(want):
            return None
        most = self.most(name)
        best = aligned(want, found, self.tolerance * len(want), most)
        if best is None:  # stray words may have drawn the alignment away: one stretch after the other
            size = len(want) + int(most)  # no match is longer
            for at in stretches(want, found, size, self.tolerance * len(want)):
                got = aligned(want, found[at:at + size], self.tolerance * len(want), most)
                if got and (best is None or got[0] + got[1] < best[0] + best[1]):
                    best = (*got[:2], got[2] + at, got[3] + at)
                if best and (not sum(best[:2]) or at >= best[3]):
                    break
        if best is None:
            return None
        missing, added, first, last = best
        there = [w for w, _, _ in found[first:last]]
        text = "; ".join(f"{' '.join(want[i1:i2])} -> {' '.join(there[j1:j2])}" for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, want, there, autojunk=False).get_opcodes() if op != "equal")
        return missing, added, first, last, text

    def window(self, text: str, found: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, tuple]]:
        """First and last word and result of every notice among the words ``found``."""
        todo = [(0, len(found))]
        while todo:
            a, b = todo.pop()
            if a == b or not self.cue.search(text, found[a][1], found[b - 1][2]):
                continue
            some = found[a:b]
            for name, saved in self.savings(text[some[0][1]: some[-1][2]]):
                got = self.differences(name, some)
                if got:
                    missing, added, first, last, wording = got
                    yield a + first, a + last, (found[a + first][1], found[a + last - 1][2], name, saved, missing, added, wording)
                    todo += [(a, a + first), (a + last, b)]
                    break

    def scan(self, text: str) -> list[tuple]:
        """``(start, end, license, saved bytes, words missing, words added, differences)`` of every notice."""
        out = []
        for a, b in blocks(text, self.cue, self.longest) if self.words else ():
            found = [(w, a + x, a + y) for w, x, y in words(text[a:b])]
            at, size = 0, WINDOW * self.longest
            while at < len(found):
                whole = at + size >= len(found)
                certain = len(found) if whole else at + size - self.longest  # later beginnings belong to the next window
                last = certain
                for x, y, row in self.window(text, found[at: at + size]):
                    if at + x < certain:
                        out.append(row)
                        last = max(last, at + y)
                at = last
        return sorted(out)


def cues(templates: dict[str, list[str]], tolerance: float) -> str:
    """A pattern of words of which every match holds one: of each template one more than may be missing.

    Legal words come first, then long ones.
    """
    out: set[str] = set()
    for want in templates.values():
        order = sorted(set(want), key=lambda w: (LEGAL.search(w) is None, -len(w), w))
        out.update(order[: int(tolerance * len(want)) + 1])
    return "(?i)" + "|".join(re.escape(w) for w in sorted(out))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, start, stop, license, saved_bytes, n_missing, n_added, wording`` of every notice in every row's text."""
    templates = TEMPLATES if templates is None else templates
    if not any(words(_HOLE.sub(" ", t)) for t in templates.values()):
        raise ValueError("templates need words")
    pattern = Scanner(templates, tolerance).cue.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, tolerance)
        for batch in batches:
            for a, b in text_ranges(batch.column(1)):
                rows = [(key, *x) for key, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True) for x in scanner.scan(text)]
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "stop", "license", "saved_bytes", "n_missing", "n_added", "wording"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).filter(F.col("text").rlike(pattern))
    return rows.mapInArrow(run, "doc_id long, start int, stop int, license string, saved_bytes int, n_missing int, n_added int, wording string")
