"""License scans by conditional compression.

A candidate block is what stands around a cue, over line ends and comment marks. Its words are cut into
windows about twice as long as the wordings of a size; each window is compressed by zstandard alone and
with each of these wordings as a raw-content dictionary. Wordings are ranked by the bytes they save, as a
share of their own, and the best of each window are confirmed by the exact differences between their
words and the window's, at every place. Of places that overlap the one with most words in common, less
three for each difference, stays.
"""

from __future__ import annotations

import re
from bisect import bisect
from dataclasses import dataclass
from itertools import accumulate, islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.texts import map_rows

# Fixed values: (SPDX id, wording) of notices as authors write them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)
CUES = ("licens", "licenc", "permission is hereby", "redistribution and use", "public license", "creative commons", "public domain", "terms of the", "permission to use", "software is provided", "redistributions of source")
#: Share of a wording's words that may be missing, changed or broken up by others, in hundredths.
MOST_DIFFERENT = 10
#: Wordings of a window that are confirmed: so many, and all that save as much as this share of the best.
FEW, GOOD = 5, 0.5

#: Words that open a line of a comment; marks without letters or digits are no words.
MARKS = frozenset(("rem", "dnl", "c"))

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_GAP = rf"[\W_]++(?:(?:{'|'.join(sorted(MARKS))})\b[\W_]*+)?"
_CUE = re.compile("|".join(_GAP.join(c.split()) for c in CUES), re.I)
_RARE = tuple({c.split()[0]: 1 for c in CUES})
#: Words of a block on either side of a cue: twice the longest wording, as there may be marks between.
REACH = 2 * max(len(_WORD.findall(w)) for _, w in TEMPLATES)


@dataclass(frozen=True)
class Match:
    license: str
    start: int  # code points within the block
    end: int
    saved: float  # bytes that the dictionary saved, as a share of the wording
    different: int  # words


class LicenseMatcher:
    """Confirmed license wordings of blocks; repeated blocks are looked up."""

    def __init__(self, templates=TEMPLATES, most: int = 20_000):
        self.most, self.known = most, {}
        self.plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.each = []
        for name, wording in templates:
            words = [m[0] for m in _WORD.finditer(wording.lower())]
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=3, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False)
            self.each.append((name, packer, words))
        sizes: dict[int, list[int]] = {}
        for k, (_, _, words) in enumerate(self.each):
            sizes.setdefault(len(words).bit_length(), []).append(k)
        self.groups = list(sizes.values())

    def ranked(self, words: list[str], group: list[int]) -> list[tuple[float, int]]:
        """(bytes saved as a share of the wording's, number of the wording), best first; ties by the order of wordings."""
        raw = " ".join(words).encode("utf-8", "replace")
        alone = len(self.plain.compress(raw))
        saved = [((alone - len(self.each[k][1].compress(raw))) / len(" ".join(self.each[k][2])), k) for k in group]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def winners(self, words: list[str], group: list[int]) -> list[tuple[float, int]]:
        order = self.ranked(words, group)
        return [x for i, x in enumerate(order) if i < FEW or x[0] >= GOOD * order[0][0]]

    def windows(self, have: list[str], group: list[int]):
        """(first word, words) of windows that overlap so far that every place of a wording lies in one."""
        longest = max(len(self.each[k][2]) for k in group)
        longest += MOST_DIFFERENT * longest // 100
        for at in range(0, max(1, len(have) - longest), longest):
            yield at, have[at : at + 2 * longest]

    def confirm(self, have: list[str], k: int) -> list[tuple[int, int, int]]:
        """(different words, first, end) of every place of the words where the template's are near enough.

        Places may overlap. Exact: a place has ``max(wording, place) - common`` different words, where
        common is the longest common subsequence, and starts and ends with a word of the wording.
        """
        wanted = self.each[k][2]
        n, most = len(wanted), MOST_DIFFERENT * len(wanted) // 100
        first, known = set(wanted[: most + 1]), set(wanted)
        before = list(accumulate((w in known for w in have), initial=0))
        out = []
        for i, w in enumerate(have):
            end = min(i + n + most, len(have))
            if w not in first or before[end] - before[i] < n - most:
                continue
            best, row = None, [0] * (n + 1)
            for size, x in enumerate(have[i:end], 1):
                old, row = row, [0]
                for j, y in enumerate(wanted):
                    row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
                different = max(n, size) - row[n]
                if row[n] > old[n] and different <= most and (best is None or different < best[0]):
                    best = (different, i, i + size)
            if best:
                out.append(best)
        return out

    def match(self, block: str) -> list[Match]:
        """Confirmed matches that don't overlap, by place."""
        if block not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            spots = [m for m in _WORD.finditer(block) if not is_mark(block, m)]
            have = [m[0].lower() for m in spots]
            places: dict[tuple, float] = {}
            for group in self.groups:
                for at, part in self.windows(have, group):
                    for saved, k in self.winners(part, group):
                        for d, a, b in self.confirm(part, k):
                            key = (at + a, at + b, k, d)
                            places[key] = max(saved, places.get(key, saved))
            found: list[tuple] = []  # (first, end, match), by place
            worth = lambda x: (4 * x[0][3] - len(self.each[x[0][2]][2]), x[0][3], -x[1], x[0])
            for (a, b, k, d), saved in sorted(places.items(), key=worth):
                at = bisect(found, a, key=lambda x: x[0])
                if (at == 0 or found[at - 1][1] <= a) and (at == len(found) or b <= found[at][0]):
                    found.insert(at, (a, b, Match(self.each[k][0], spots[a].start(), spots[b - 1].end(), saved, d)))
            self.known[block] = [x[2] for x in found]
        return self.known[block]


def is_mark(text: str, word: re.Match) -> bool:
    """Whether a word is a comment mark at the start of its line."""
    return word[0].lower() in MARKS and not text[text.rfind("\n", 0, word.start()) + 1 : word.start()].strip()


def start_before(text: str, at: int, words: int) -> int:
    """The start of the word that stands so many words before a place, or of the text."""
    size = 16 * words
    while size < at:
        found = list(_WORD.finditer(text, at - size, at))
        if len(found) > words:  # the first may be cut
            return found[-words].start()
        size *= 2
    found = list(_WORD.finditer(text, 0, at))
    return found[-words].start() if len(found) > words else 0


def blocks(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """The number of lines where a cue begins, and (start, text) of the blocks around the cues.

    A block goes REACH words to both sides of a cue, over line ends; those that meet are one.
    """
    low = text.lower() if text else ""
    if not any(c in low for c in _RARE):
        return 0, []
    lines, line_end, spans = 0, -1, []
    for cue in _CUE.finditer(text):
        if cue.start() > line_end:
            lines += 1
            line_end = text.find("\n", cue.start())
            line_end = len(text) if line_end < 0 else line_end
        if spans and cue.start() <= spans[-1][1] + REACH:  # so many characters hold no more words
            spans[-1][1] = cue.end()
        else:
            spans.append([cue.start(), cue.end()])
    out: list[list[int]] = []
    for first, last in spans:
        a, b = start_before(text, first, REACH), last
        for word in islice(_WORD.finditer(text, last), REACH + 1):  # the first may be the cue's rest
            b = word.end()
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return lines, [(a, text[a:b]) for a, b in out]


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_blocks (lines where a cue begins), n_licenses, licenses (id:start:end, comma-joined) and n_different of each row.

    Null and empty texts have no blocks. Offsets are code points, ends exclusive. A null doc_id
    stays null; repeated rows get equal results; an empty table gives an empty result. Of wordings
    that tie the first listed counts. Whole texts are read, other columns are not.
    """

    def make():
        matcher = LicenseMatcher()

        def step(batch: pa.RecordBatch) -> dict:
            out = {"doc_id": batch.column("doc_id"), "n_blocks": [], "n_licenses": [], "licenses": [], "n_different": []}
            for x in batch.column("text").to_pylist():
                n, around = blocks(x)
                found = [(m, at) for at, block in around for m in matcher.match(block)]
                out["n_blocks"].append(n)
                out["n_licenses"].append(len(found))
                out["licenses"].append(",".join(f"{m.license}:{at + m.start}:{at + m.end}" for m, at in found))
                out["n_different"].append(sum(m.different for m, _ in found))
            return out

        return step

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_rows(rows, "doc_id long, n_blocks long, n_licenses long, licenses string, n_different long", make)
