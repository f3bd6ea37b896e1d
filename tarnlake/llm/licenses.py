"""License notices by conditional compression.

Candidate blocks are the stretches of a text, lines joined, in which enough of a notice's words stand close
together: as many as any confirmed wording has, so that no match is lost, wherever it stands in a line and on
however many lines. Each block is compressed alone and with every notice as raw dictionary, and the notices are
ranked by the bytes that they save. Those that make it smaller are confirmed by exact wording
differences, word by word. The words of the notice that makes its wording smaller by most bytes are
taken, and the next one is looked for among the others, so that a text has as many notices as it holds.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import add_columns, resident

#: Fixed wording of short notices: license and notice.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
)
#: One line tags of the same licenses.
NOTICES += tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in NOTICES))
#: Fixed cues, in lower case, of lines that mention licensing. They are counted, no more.
CUES = ("licen", "copyright", "public domain", "creative commons", "cc by", "cc0", "spdx", "permission is hereby")
#: A notice must make its wording smaller by this share; other words may differ up to this share of the notice.
MIN_REDUCTION, MAX_DIFFERENT = 0.15, 0.34
#: A word that at most so many licenses share may tell licenses apart.
MOST_SHARED = 3
LEVEL = 19
RESULT = "n_blocks bigint, licenses array<string>, lines array<bigint>, reductions array<double>, differences array<string>"
WORD = re.compile(r"[\w.+-]*\w")
#: What is cut from both ends of a line before lines are joined: blanks and comment marks.
MARKS = " \t\r\f\v#*/;%!|<>-=~:\\\"'`"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Notices:
    def __init__(self, notices: tuple[tuple[str, str], ...]):
        self.notices = [(name, words_of(text)) for name, text in notices]
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False}
        self.alone = zstandard.ZstdCompressor(**options)
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for _, text in notices]
        used: dict[str, set[str]] = {}
        for name, words in self.notices:
            for w in words if len(words) > 2 else ():
                used.setdefault(w, set()).add(name)
        # words that not all licenses' notices share, and every number, tell licenses apart
        most = min(max((len(s) for s in used.values()), default=0) // 3, MOST_SHARED)
        self.telling = {w for w, names in used.items() if len(names) <= most or any(map(str.isdigit, w))}
        # a notice of a word or two must be there as it is
        self.required = [self.telling.intersection(words) if len(words) > 2 else set(words) for _, words in self.notices]
        self.most = [int(max(1, MAX_DIFFERENT * len(words))) if len(words) > 2 else 0 for _, words in self.notices]
        self.distinct = [set(words) for _, words in self.notices]
        self.reach = [len(words) + self.most[k] for k, (_, words) in enumerate(self.notices)]
        self.cue_words = [cue.split() for cue in CUES]
        self.cue = re.compile("|".join(map(re.escape, CUES)))

    def possible(self, low: str) -> list[int]:
        """The notices of which a lower-case text may have the wording: the needed words occur in it at all."""
        out = []
        for k, required in enumerate(self.required):
            if all(w in low for w in required):
                absent, most = 0, self.most[k]
                for w in self.distinct[k]:
                    absent += w not in low
                    if absent > most:
                        break
                else:
                    out.append(k)
        return out

    def blocks(self, words: list[str], possible: list[int]) -> list[tuple[int, int]]:
        """Begin and end of the candidate blocks: where all words that a notice may not miss stand close enough together.

        A block reaches as far around such a word as any wording that has it, so its size follows the notice's.
        """
        wanted = set().union(*(self.distinct[k] for k in possible))
        where: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                where.setdefault(w, []).append(i)
        spans = set()
        for k in possible:
            # a wording has every required word, and one at least of any words that are more than may be missing
            rare = sorted(self.required[k] or self.distinct[k], key=lambda w: (len(where.get(w, ())), w))
            rare = rare[:1] if self.required[k] else rare[: self.most[k] + 1]
            need, reach = len(self.distinct[k]) - self.most[k], self.reach[k]
            for i in sorted({i for w in rare for i in where.get(w, ())}):
                begin, end = max(0, i - reach + 1), min(len(words), i + reach)
                near = self.distinct[k].intersection(words[begin:end])
                if len(near) >= need and self.required[k] <= near:
                    spans.add((begin, end))
        return sorted(spans)

    def ranked(self, block: str) -> list[int]:
        """The notices that make a block smaller, by the bytes they save."""
        raw = block.encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(raw))
        saved = [size - len(given.compress(raw)) for given in self.given]
        return [k for k in sorted(range(len(saved)), key=lambda k: (-saved[k], k)) if saved[k] > 0]

    def reduction(self, k: int, block: str) -> tuple[int, float]:
        """The bytes by which notice k makes a block smaller, and their share."""
        raw = block.encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(raw))
        saved = size - len(self.given[k].compress(raw))
        return saved, saved / size

    def places(self, k: int, words: list[str | None]) -> list[tuple[int, int, str]]:
        """Where words have the wording of notice k: first and last word, and the words that differ (-missing +added).

        The whole notice is aligned with any stretch of words. No telling word may be missing, nor a
        telling word or number stand between; what stands before or after is no difference. Of places
        that overlap the one with fewest differences counts, then the longest.
        """
        notice = self.notices[k][1]
        if not self.required[k].issubset(words):
            return []
        most, end = self.most[k], len(notice)
        # by how many words of the notice are passed: differences, minus the first word met (1: none yet), missing and added words
        fresh = {0: (0, 1, (), ())}
        for i, x in enumerate(notice[:most]):
            if x in self.telling:
                break
            fresh[i + 1] = (i + 1, 1, tuple(notice[: i + 1]), ())
        found, before, inside = [], fresh, set(notice)
        for j, w in enumerate(words):
            if before is fresh and w not in inside:
                continue
            now = dict(fresh)
            barred = w is None or w in self.telling or any(map(str.isdigit, w))  # None: a word taken
            for i in range(1, end + 1):
                ways = [now[i]] if i in now else []
                if w == notice[i - 1] and i - 1 in before:
                    n, first, less, more = before[i - 1]
                    ways.append((n, -j if first == 1 else first, less, more))
                if i in before and not barred and before[i][0] < most and before[i][1] != 1:
                    n, first, less, more = before[i]
                    ways.append((n + 1, first, less, (*more, w)))
                if i - 1 in now and notice[i - 1] not in self.telling and now[i - 1][0] < most:
                    n, first, less, more = now[i - 1]
                    ways.append((n + 1, first, (*less, notice[i - 1]), more))
                if ways:
                    now[i] = min(ways)
            if end in now and now[end][1] != 1:
                n, first, less, more = now[end]
                found.append((n, -first - j, -first, j, " ".join([*("-" + x for x in less), *("+" + x for x in more)])))
            before = now if any(first != 1 for _, first, _, _ in now.values()) else fresh
        out, taken = [], bytearray(len(words))
        for *_, i, j, told in sorted(found):
            if not any(taken[i : j + 1]):
                taken[i : j + 1] = b"\1" * (j + 1 - i)
                out.append((i, j, told))
        return out

    def confirmed(self, text: str, possible: list[int]) -> list[tuple[str, int, float, str]]:
        """(license, place, reduction, differences) of each notice of a lower-case text, in order.

        The notice that makes its wording smaller by most bytes comes first, of equals the first of the
        list, and its words are taken; notices that had some of them look again at the words left around.
        """
        met = list(WORD.finditer(text))
        words: list[str | None] = [m.group() for m in met]
        heap: list[tuple] = []
        seen: set[tuple[int, int, int]] = set()

        def look(k: int, begin: int, end: int) -> None:
            for i, j, told in self.places(k, words[begin:end]):
                i, j = i + begin, j + begin
                if (k, i, j) in seen:
                    continue
                seen.add((k, i, j))
                saved, share = self.reduction(k, text[met[i].start() : met[j].end()])
                if share >= MIN_REDUCTION:
                    heapq.heappush(heap, (-saved, told.count(" ") + bool(told), k, i, j, share, told))

        ranking: dict[str, list[int]] = {}
        for begin, end in self.blocks(words, possible):
            block = text[met[begin].start() : met[end - 1].end()]
            if block not in ranking:
                ranking[block] = self.ranked(block)
            for k in ranking[block]:
                look(k, begin, end)
        out = []
        while heap:
            *_, k, i, j, share, told = heapq.heappop(heap)
            if None in words[i : j + 1]:
                look(k, max(0, i - self.reach[k]), j + 1 + self.reach[k])
            else:
                out.append((i, self.notices[k][0], met[i].start(), share, told))
                words[i : j + 1] = [None] * (j + 1 - i)
        return [x[1:] for x in sorted(out)]

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, float, str]]]:
        """How many lines mention licensing, and (license, line, reduction, differences) of each confirmed notice.

        Lines are joined without their comment marks; a notice or cue stands on the line on which it begins.
        """
        if not text:
            return 0, []
        low = text.lower()
        possible = self.possible(low)
        cued = any(all(map(low.__contains__, words)) for words in self.cue_words)
        if not possible and not cued:
            return 0, []
        lines, starts, joined, at = [], [], [], 0
        for line, part in enumerate(low.split("\n")):
            if part := part.strip(MARKS):
                lines.append(line)
                starts.append(at)
                joined.append(part)
                at += len(part) + 1
        whole = " ".join(joined)
        line_of = lambda place: lines[bisect_right(starts, place) - 1]
        found = [(name, line_of(place), share, told) for name, place, share, told in self.confirmed(whole, possible)] if possible else []
        return len({line_of(m.start()) for m in self.cue.finditer(whole)} | {line for _, line, _, _ in found}), found


def notices(of: tuple[tuple[str, str], ...]) -> Notices:
    return resident("licenses", of, lambda: Notices(of))


def scan_licenses(df: DataFrame, text_col: str = "text", of: tuple[tuple[str, str], ...] = NOTICES, carry_text: bool = True) -> DataFrame:
    """df with n_blocks (lines that mention licensing) and, for each confirmed notice in order, licenses, lines, reductions, differences.

    NULL and empty texts have none. Every row is scanned whole, however long, repeated rows too; columns
    named like a result are replaced. Of notices that fit the same words equally well the one that saves
    most bytes counts, then the first of the list.
    """
    of = tuple(tuple(x) for x in of)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        known = notices(of)
        got = [known.scan(t) for t in batch.column(0).to_pylist()]
        column = lambda k, kind: pa.array([[f[k] for f in found] for _, found in got], pa.list_(kind))
        return [pa.array([n for n, _ in got], pa.int64()), column(0, pa.string()), column(1, pa.int64()), column(2, pa.float64()), column(3, pa.string())]

    return add_columns(df, run, RESULT, [text_col], carry=carry_text)
