"""License scans with a generalised suffix automaton of licence words.

All templates (licence texts and notices, and short phrases) go word by word into one suffix automaton. A text is streamed
through it: at each word the automaton knows the longest run of words, ending here, that stands in any template (matching
statistics). Runs that end here and cannot go on are matches; long matches that follow each other in the text and in one
template are chained into spans, each with the share of the template that it covers; a tag that names a licence by its public
identifier is a span of its own. Templates of one licence, a text, a notice or a line, have one label in the result, the licence's.

Two words that stand next to each other in no template end every run, so only stretches of pairs known to some template
are streamed; the rest of a text costs an array lookup per word. Results are those of streaming every word.

Defined results: null, empty and wordless texts have no words, places or labels and score 0; texts are scanned whole,
whatever their length; rows that share a doc_id are texts of their own, repeated rows too; of spans with equal shares the
first in the text comes first; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import lower_words

# Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# The opening or notice of public licences, by label.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "0bsd-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-3-clause-part": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "as-is-disclaimer": "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "wtfpl-text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "cc0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-line": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mit-line-2": "This project is licensed under the terms of the MIT license.",
    "apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "gpl-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it.",
    "lgpl-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "mpl-2.0-text": "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "rights-reserved-line": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher.",
}

# Identifiers of the public list of licences, as tags in source files name them.
SPDX = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0
CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0
EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ICU ISC LGPL-2.0-only LGPL-2.1 LGPL-2.1-only
LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0
PHP-3.01 PostgreSQL Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
""".split()
TAG = "SPDX-License-Identifier: "
#: Bytes of templates from a table: the automaton is in every task.
MOST_TEMPLATE_BYTES = 16_000_000


def licence_of(template: str) -> str:
    """The licence that a template belongs to: its name without what the template is of it."""
    return re.sub(r"-(text|line|notice|part|disclaimer)(-\d+)?$", "", template)


def templates_of(rows: DataFrame) -> dict[str, str]:
    """Templates from a table (licence, text) of licence texts and notices, several of a licence if it likes."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    if size > MOST_TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; {MOST_TEMPLATE_BYTES} at most")
    found = rows.where("licence is not null and text is not null").select("licence", "text").orderBy("licence", "text").collect()
    return {f"{r.licence}-text-{k}": r.text for k, r in enumerate(found)}


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, numbered as they are added."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, last word) where a state's longest run is a beginning
        self.below: list[list[int]] = [[]]  # states whose suffix link leads here

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, at: int, word: int, found: int) -> int:
        """The state of exactly the runs that come from at by word: found, or a copy that takes them over."""
        if self.length[found] == self.length[at] + 1:
            return found
        copy = self._state(self.length[at] + 1, dict(self.next[found]), self.link[found])
        self.link[found] = copy
        while at >= 0 and self.next[at].get(word) == found:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, sequence: int, words: list[int]) -> None:
        last = 0
        for k, word in enumerate(words):
            if word in self.next[last]:
                last = self._split(last, word, self.next[last][word])
            else:
                new, at = self._state(self.length[last] + 1, {}, 0), last
                while at >= 0 and word not in self.next[at]:
                    self.next[at][word] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._split(at, word, self.next[at][word])
                last = new
            self.ends[last].append((sequence, k))

    def finish(self) -> None:
        """Turns the suffix links round. Memory stays linear in the words that were added."""
        self.below = [[] for _ in self.next]
        for s in range(1, len(self.next)):
            self.below[self.link[s]].append(s)

    def occurrences(self, state: int) -> Iterator[tuple[int, int]]:
        """(sequence, last word) of each place of a state's runs: those of the states that end with it."""
        waiting = [state]
        while waiting:
            at = waiting.pop()
            yield from self.ends[at]
            waiting += self.below[at]

    def step(self, state: int, run: int, word: int) -> tuple[int, int]:
        """State and length of the longest known run after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            run = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, run + 1)


@dataclass(frozen=True)
class Span:
    """Words first to last of a text, chained from matches with one template; covered: words of the template in them."""

    label: str
    first: int
    last: int
    covered: int
    share: float


class LicenseScanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, tags: list[str] = SPDX, min_match: int = 3, max_gap: int = 12, min_share: float = 0.6):
        self.min_match, self.max_gap, self.min_share = min_match, max_gap, min_share
        self.labels, self.sizes, self.vocabulary = [*templates], [], {}
        self.automaton = SuffixAutomaton()
        sequences = [lower_words(t) for t in templates.values()]
        self.sizes = [len(s) for s in sequences]
        extra = [lower_words(p) for p in [*phrases, *(TAG + t for t in tags)]]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in s] for s in [*sequences, *extra]]
        for k, words in enumerate(coded):
            self.automaton.add(k, words)
        self.automaton.finish()
        #: a * (n + 1) + b, ascending, of each b that follows a in a template; n stands for words of no template.
        n = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * (n + 1) + b for words in coded for a, b in zip(words, words[1:], strict=False)], np.int64))
        #: Whether a pair can be one, by the low bits of its number: nearly all others end here.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.pairs & (len(self.maybe) - 1)] = True
        # phrases that end where a state's run ends: (label, words, whether it is a tag), found at the state itself or at its suffix links
        own: dict[int, list[tuple[str, int, bool]]] = {}
        named = [*((label, False) for label in phrases.values()), *((t.lower(), True) for t in tags)]
        for (label, is_tag), words in zip(named, coded[len(sequences) :], strict=True):
            state = 0
            for word in words:
                state = self.automaton.next[state][word]
            own.setdefault(state, []).append((label, len(words), is_tag))
        self.own = own
        #: The first state with a phrase of its own among a state and its suffix links, 0 without.
        self.nearest = [0] * len(self.automaton.next)
        for s in sorted(range(1, len(self.nearest)), key=self.automaton.length.__getitem__):
            self.nearest[s] = s if s in own else self.nearest[self.automaton.link[s]]

    def phrases_at(self, state: int) -> Iterator[tuple[str, int, bool]]:
        """(label, words, whether it is a tag) of each phrase that a state's runs end with."""
        while state := self.nearest[state]:
            yield from self.own[state]
            state = self.automaton.link[state]

    def follows(self, codes: np.ndarray) -> np.ndarray:
        """Whether each word follows the one before it in some template."""
        pairs = codes[:-1].astype(np.int64) * (len(self.vocabulary) + 1) + codes[1:]
        out = self.maybe[pairs & (len(self.maybe) - 1)]
        at = np.flatnonzero(out)
        found = np.minimum(np.searchsorted(self.pairs, pairs[at]), max(0, len(self.pairs) - 1))
        out[at] = self.pairs[found] == pairs[at] if len(self.pairs) else False
        return out

    def codes(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words with an unknown word after each text, and the start of each text in them."""
        unknown, parts = len(self.vocabulary), []
        for words in texts:
            parts += words
            parts.append(b"")
        codes = np.fromiter(map(self.vocabulary.get, parts, repeat(unknown)), np.int32, len(parts))
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        return codes, np.cumsum(sizes) - sizes

    def scan(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[str, int]], list[Span]]]:
        """Per text: places of phrases (label, first word), and spans of templates and tags."""
        places: list[list[tuple[str, int]]] = [[] for _ in texts]
        tags: list[dict[int, Span]] = [{} for _ in texts]
        matches: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not texts:
            return []
        codes, starts = self.codes(texts)
        linked = self.follows(codes)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], linked, [False]]).astype(np.int8)))
        owner = np.searchsorted(starts, edges[::2], "right") - 1
        step, phrases_at = self.automaton.step, self.phrases_at
        for text, first, stop in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            base, state, run = int(starts[text]), 0, 0
            words = codes[first : stop + 1].tolist()
            for k, word in enumerate(words):
                before = state, run
                state, run = step(state, run, word)
                if run <= before[1] and before[1] >= self.min_match:
                    self._match(matches[text], *before, first + k - 1 - base)
                for label, size, is_tag in phrases_at(state):
                    if run >= size:
                        at = first + k + 1 - size - base
                        if is_tag:  # a longer identifier at the same place comes later and stays
                            tags[text][at] = Span(label, at, at + size - 1, size, 1.0)
                        else:
                            places[text].append((label, at))
            if run >= self.min_match:
                self._match(matches[text], state, run, stop - base)
        return [(p, sorted([*t.values(), *self.chain(m)], key=lambda s: (-s.share, s.first, s.label))) for p, t, m in zip(places, tags, matches, strict=True)]

    def _match(self, out: list, state: int, run: int, last: int) -> None:
        """(template, first word in it, first word in the text, words) for every place of the run in a template."""
        for template, end in self.automaton.occurrences(state):
            if template < len(self.labels):
                out.append((template, end - run + 1, last - run + 1, run))

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[Span]:
        """Per template the chains of matches that go on in both text and template within max_gap words; of overlapping
        parts each template word counts once. Chains of min_share of the template are spans, best first; of spans over the same
        words the best covered stay."""
        spans, by = [], {}
        for template, there, here, words in matches:
            by.setdefault(template, []).append((here, there, words))
        for template, found in by.items():
            found.sort()
            best: list[tuple[int, int]] = []  # covered words, and index of the match before
            for k, (here, there, words) in enumerate(found):
                score, back = words, -1
                for j in range(k - 1, -1, -1):
                    h, t, w = found[j]
                    if here - h > self.max_gap + 4 * self.sizes[template]:
                        break
                    if h < here and t < there and here - (h + w) <= self.max_gap and there - (t + w) <= self.max_gap:
                        gained = words - max(0, t + w - there, h + w - here)
                        if gained > 0 and best[j][0] + gained > score:
                            score, back = best[j][0] + gained, j
                best.append((score, back))
            taken: set[int] = set()
            for k in sorted(range(len(found)), key=lambda k: (-best[k][0], k)):
                if best[k][0] < self.min_share * self.sizes[template]:
                    break
                at, path = k, []
                while at >= 0 and at not in taken:
                    path.append(at)
                    at = best[at][1]
                if at >= 0:  # the chain's beginning belongs to a better one
                    continue
                taken |= {*path}
                covered = min(best[k][0], self.sizes[template])
                spans.append(Span(self.labels[template], found[path[-1]][0], found[k][0] + found[k][2] - 1, covered, covered / self.sizes[template]))
        return sorted(self.best_of(spans), key=lambda s: (-s.share, s.first, s.label))

    @staticmethod
    def best_of(spans: list[Span]) -> list[Span]:
        """The spans of which no better covered one holds half or more: licences that differ in a word are told apart."""
        spans = sorted(spans, key=lambda s: s.first)
        firsts, longest = [s.first for s in spans], max((s.last - s.first for s in spans), default=0)
        kept = []
        for s in spans:
            near = spans[bisect.bisect_left(firsts, s.first - longest) : bisect.bisect_right(firsts, s.last)]
            if not any(b.share > s.share and 2 * (min(b.last, s.last) - max(b.first, s.first) + 1) >= s.last - s.first + 1 for b in near):
                kept.append(s)
        return kept


RESULT = [
    ("doc_id", pa.int64(), "long"), ("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"),
    ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])), "array<struct<label:string,first:long,last:long,share:double>>"),
]


def scan(docs: DataFrame, **options) -> DataFrame:
    """Per document (doc_id, text): n_words, places of phrases (n_base, first_word, last_word, base_labels), labels (the licences of
    spans too), score (share of the best covered template; 0.5 at least where a phrase stands), and the spans themselves.

    One pass over the texts in batches; nothing is shuffled, and the automaton is as large as the templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(**options)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                texts, out = [lower_words(t) for t in rows.column(1).to_pylist()], []
                for doc_id, words, (places, spans) in zip(rows.column(0).to_pylist(), texts, scanner.scan(texts), strict=True):
                    base = {label for label, _ in places}
                    where = [k for _, k in places]
                    score = max([0.5 if places else 0.0, *(s.share for s in spans)])
                    out.append((
                        doc_id, len(words), len(places), min(where, default=None), max(where, default=None), ",".join(sorted(base)),
                        ",".join(sorted(base | {licence_of(s.label) for s in spans})), score, [{"label": s.label, "first": s.first, "last": s.last, "share": s.share} for s in spans],
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(zip(*out, strict=True), RESULT, strict=True)], [n for n, _, _ in RESULT])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in RESULT))
