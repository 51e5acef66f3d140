"""Operator 3: licence scan by a trained paragraph classifier.

A paragraph is a run of non-blank lines. Its features are hashed n-grams of one to three words, kept only if
the training notices have them, and a multinomial logistic regression weighs them for each
licence family and for "unknown". Training paragraphs are varied copies of public notices
(words dropped, cropped, put inside running text) and, as unknown, lines of a hashed sample
(of about SAMPLE documents LINES parts of lines each, drawn by their hash; lines are cut
into parts of LINE_WORDS words) and sentences that merely use the same words. A temperature
fitted on a held-out part calibrates the probabilities; a paragraph whose best family stays
below MIN_PROBABILITY is unknown. A prediction counts only if the paragraph also holds a
stretch that aligns with one of the family's notices, word after word.

What is classified are the least groups of neighbouring lines of a paragraph, single lines
among them, that hold enough word pairs of a notice; a prediction counts in no others, so
none is lost. In a group, grown as below, a stretch of at most twice the notice's words that holds enough
of its pairs must align with it in order: what the best local alignment (a point a word,
half a point less for each word left out or put in) scores must be above MIN_SHARE of the
notice's words. A group that is one grows by neighbouring lines that go on with the notice,
and groups of one family that share a line, or that only blank lines part, become one. Short notices are too short to share
pairs with the long ones, and so are templates of their own; ``Model.scan`` gives licences
alone, ``Model.notices`` those and short notices.

Cases: null and empty texts have no paragraphs; repeated rows are scanned each; sample
lines that hold a notice are not used as unknown; extra columns stay, but those named like a
result are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm.common import append_columns, table

#: Short public notices of each licence family.
NOTICES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the BSD 2-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "bsl": (
        "Use of this software is governed by the Business Source License 1.1 included in the LICENSE file.",
        "SPDX-License-Identifier: BUSL-1.1",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0 for non-commercial use only.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under GPLv3.",
        "Licensed under GPLv2.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU LGPL version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "reserved": (
        "All rights reserved. No part of this publication may be reproduced without written permission of the publisher.",
        "Copyright the authors. All rights reserved.",
    ),
}
#: Sentences that use the notices' words without being one.
LOOKALIKES = (
    "The driver's license was renewed last week.",
    "The software is released next month in two versions.",
    "Permission to enter the building was granted by the owner.",
    "The public was free to use the source of the river.",
    "Licensed plumbers work in this area under the new rules.",
    "A copy of the file is on the general list, version 3.",
    "The company holds a licence to sell fish under the law.",
    "Apache helicopters and the MIT campus were on the news.",
    "This work is under way and may be used later.",
    "The bar lost its license for the second time.",
)
#: Notices that stand alone and grant nothing.
SHORT_NOTICES = {"reserved": ("All rights reserved.",)}
UNKNOWN = "unknown"
SAMPLE = 400
LINES = 40
LINE_WORDS = 300
VARIANTS = 40
STEPS = 200
MIN_PROBABILITY = 0.6
#: Share of a notice's word pairs that the paragraph must have.
MIN_SHARE = 0.6

_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> set[int]:
    return {xxhash.xxh32_intdigest(" ".join(words[k : k + n])) for n in (1, 2, 3) for k in range(len(words) - n + 1)}


def pairs(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], strict=False)) or {tuple(words)}


#: Word pairs of each notice.
TEMPLATES = {family: [pairs(words_of(n)) for n in notices] for family, notices in NOTICES.items()}

SHORT_TEMPLATES = {family: [pairs(words_of(n)) for n in notices] for family, notices in SHORT_NOTICES.items()}


def by_pair(*tables: dict[str, list[set]]) -> dict[tuple[str, ...], list[tuple[str, frozenset]]]:
    """The templates that have a word pair, with their families."""
    having: dict[tuple[str, ...], list[tuple[str, frozenset]]] = {}
    for table_ in tables:
        for family, templates in table_.items():
            for template in map(frozenset, templates):
                for pair in template:
                    having.setdefault(pair, []).append((family, template))
    return having


#: The words of each notice, by its pairs.
ORDER = {frozenset(pairs(words_of(n))): words_of(n) for table_ in (NOTICES, SHORT_NOTICES) for notices in table_.values() for n in notices}

LICENCES = by_pair(TEMPLATES)
ALL_NOTICES = by_pair(TEMPLATES, SHORT_TEMPLATES)


def template_share(words: list[str], families: list[str]) -> float:
    """The largest share of a notice of these families that the words hold."""
    own = pairs(words) if words else set()
    return max(len(t & own) / len(t) for f in families for t in TEMPLATES[f])


def is_background(words: list[str]) -> bool:
    return bool(words) and template_share(words, list(TEMPLATES)) < MIN_SHARE / 2


def least_groups(lines: list[list[str]], having: dict) -> list[tuple[int, int, str, frozenset]]:
    """(first line, last line, family, template): groups with MIN_SHARE of a template's pairs of which no part has it."""
    met: dict[tuple[str, frozenset], list[tuple[int, int, tuple[str, ...]]]] = {}
    word, at = "", 0
    for k, words in enumerate(lines):
        for nxt in words:
            for owner in having.get((word, nxt), ()):
                met.setdefault(owner, []).append((at, k, (word, nxt)))
            word, at = nxt, k
    groups = []
    for (family, template), found in met.items():
        count: dict[tuple[str, ...], int] = {}
        left, start_of = 0, {}
        for _, last, pair in found:
            count[pair] = count.get(pair, 0) + 1
            while len(count) / len(template) >= MIN_SHARE:
                start_of[last], _, gone = found[left]
                count[gone] -= 1
                if not count[gone]:
                    del count[gone]
                left += 1
        # starts and ends grow together: the latest start of each end, the first end of each start
        end_of: dict[int, int] = {}
        for last, first in start_of.items():
            end_of.setdefault(first, last)
        groups += [(first, last, family, template) for first, last in end_of.items()]
    return groups


def alignment(words: list[str], notice: list[str]) -> float:
    """Score of the best local alignment: a point a word that agrees, half a point less for each left out of or put into the notice."""
    best, above = 0.0, [0.0] * (len(notice) + 1)
    for word in words:
        row = [0.0]
        for k, wanted in enumerate(notice):
            score = max(0.0, above[k + 1] - 0.5, row[k] - 0.5)
            row.append(max(score, above[k] + 1) if word == wanted else score)
        best, above = max(best, *row), row
    return best


def in_order(words: list[str], template: frozenset) -> bool:
    """True if a stretch of at most twice the notice's words holds MIN_SHARE of its pairs and aligns with it."""
    notice = ORDER[template]
    if len(notice) < 2:
        return notice[0] in words
    found = [(k, pair) for k, pair in enumerate(zip(words, words[1:], strict=False)) if pair in template]
    count: dict[tuple[str, ...], int] = {}
    left = 0
    for k, pair in found:
        count[pair] = count.get(pair, 0) + 1
        while k - found[left][0] >= 2 * len(notice) or count[found[left][1]] > 1:
            gone = found[left][1]
            count[gone] -= 1
            if not count[gone]:
                del count[gone]
            left += 1
        if len(count) / len(template) >= MIN_SHARE and alignment(words[found[left][0] : k + 2], notice) > MIN_SHARE * len(notice):
            return True
    return False


def grown(lines: list[list[str]], i: int, j: int, template: frozenset) -> tuple[int, int]:
    """The group with neighbouring lines at least half of whose pairs are the template's, one of them new."""
    words = [w for line in lines[i : j + 1] for w in line]
    have = pairs(words) & template
    for step in (-1, 1):
        k = i if step < 0 else j
        while 0 <= (k := k + step) < len(lines):
            line = lines[k]
            if not line:
                continue
            more = pairs([*line, words[0]] if step < 0 else [words[-1], *line])
            if not (more & template) - have or 2 * len(more & template) < len(more):
                break
            have |= more & template
            words = [*line, *words] if step < 0 else [*words, *line]
            i, j = min(i, k), max(j, k)
    return i, j


@dataclass
class Model:
    families: list[str]
    place: dict[int, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, words: list[str]) -> tuple[str, float, float]:
        """Best family, its calibrated probability and that of UNKNOWN."""
        at = [self.place[g] for g in grams(words) if g in self.place]
        score = (self.weights[at].sum(0) + self.bias) / self.temperature
        p = np.exp(score - score.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.families[best], float(p[best]), float(p[self.families.index(UNKNOWN)])

    def classify(self, line: str) -> tuple[str, float]:
        """Family and calibrated probability; UNKNOWN below the threshold or without a template that agrees."""
        words = words_of(line)
        family, p, unknown = self.predict(words)
        if family == UNKNOWN or p < MIN_PROBABILITY or not any(in_order(words, frozenset(t)) for t in TEMPLATES[family]):
            return UNKNOWN, unknown
        return family, p

    def paragraph(self, lines: list[list[str]], having: dict) -> list[tuple[str, int, int, float]]:
        """Confirmed (family, first line, last line, probability) of a paragraph's words by line."""
        seen: dict[tuple[int, int], tuple[str, float, float]] = {}
        hits = []
        for i, j, family, template in least_groups(lines, having):
            if (i, j) not in seen:
                seen[i, j] = self.predict([w for line in lines[i : j + 1] for w in line])
            best, p, _ = seen[i, j]
            if best == family and p >= MIN_PROBABILITY:
                first, last = grown(lines, i, j, template)
                if in_order([w for line in lines[first : last + 1] for w in line], template):
                    hits.append((family, first, last, p))
        joined: list[tuple[str, int, int, float]] = []
        for family, i, j, p in sorted(hits):
            if joined and joined[-1][0] == family and i <= joined[-1][2]:
                _, first, last, q = joined.pop()
                i, j, p = first, max(j, last), max(p, q)
            joined.append((family, i, j, p))
        kept: list[tuple[str, int, int, float]] = []
        for hit in sorted(joined, key=lambda h: (-h[3], h[1], h[0])):
            if all(hit[2] < k[1] or hit[1] > k[2] for k in kept):
                kept.append(hit)
        return sorted(kept, key=lambda h: h[1])

    def _scan(self, text: str, having: dict) -> tuple[list[tuple[str, int, int, float]], int]:
        found: list[tuple[str, int, int, float]] = []
        at, paragraphs = 0, 0
        ends: list[tuple[int, int]] = []
        lines: list[list[str]] = []
        # the number of the paragraph that the last span ends, if it goes to its last line
        closes = -1
        for line in [*text.split("\n"), ""]:
            if line and not line.isspace():
                ends.append((at, at + len(line)))
                lines.append(words_of(line))
            elif lines:
                paragraphs += 1
                for family, i, j, p in self.paragraph(lines, having):
                    start, end = ends[i][0], ends[j][1]
                    if closes == paragraphs - 1 and i == 0 and found[-1][0] == family:
                        _, start, _, q = found.pop()
                        p = max(p, q)
                    found.append((family, start, end, p))
                    closes = paragraphs if j == len(lines) - 1 else -1
                ends, lines = [], []
            at += len(line) + 1
        return found, paragraphs

    def scan(self, text: str) -> tuple[list[tuple[str, int, int, float]], int]:
        """Confirmed licences (family, start, end, probability) by lines, and the number of paragraphs."""
        return self._scan(text, LICENCES)

    def notices(self, text: str) -> tuple[list[tuple[str, int, int, float]], int]:
        """Licences and short notices, else like ``scan``."""
        return self._scan(text, ALL_NOTICES)


def training_rows(background: list[str], rng: random.Random) -> list[tuple[list[str], str]]:
    noise = [w for line in background for w in words_of(line)] or ["word"]
    rows = []
    for family, notices in NOTICES.items():
        for notice in notices:
            words = words_of(notice)
            rows.append((words, family))
            for _ in range(VARIANTS):
                kept = [w for w in words if rng.random() > 0.08] or words
                if len(kept) > 12 and rng.random() < 0.5:
                    start = rng.randrange(len(kept) - 9)
                    kept = kept[start : start + rng.randrange(9, len(kept) - start + 1)]
                lead = [rng.choice(noise) for _ in range(rng.choice((0, 0, 3, 12)))]
                rows.append((lead + kept + [rng.choice(noise) for _ in range(rng.choice((0, 0, 3, 12)))], family))
    for text in LOOKALIKES:
        rows += [(words_of(text) + [rng.choice(noise) for _ in range(rng.choice((0, 4)))], UNKNOWN) for _ in range(VARIANTS)]
    return rows + [(words, UNKNOWN) for words in map(words_of, background) if is_background(words)]


def fit(background: list[str], seed: int = 3) -> Model:
    rng = random.Random(seed)
    rows = training_rows(background, rng)
    rng.shuffle(rows)
    families = [*NOTICES, UNKNOWN]
    known = sorted(set().union(*(grams(words_of(n)) for notices in (*NOTICES.values(), LOOKALIKES) for n in notices)))
    place = {g: k for k, g in enumerate(known)}
    x = [[place[g] for g in grams(words) if g in place] for words, _ in rows]
    y = np.array([families.index(f) for _, f in rows])
    held = len(rows) // 5
    flat = np.array([c for r in x[held:] for c in r])
    row = np.repeat(np.arange(len(rows) - held), [len(r) for r in x[held:]])
    n, k = len(rows) - held, len(families)
    w, b = np.zeros((len(known), k)), np.zeros(k)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, STEPS + 1):
        score = np.stack([np.bincount(row, w[flat, c], n) for c in range(k)], 1) + b
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y[held:]] -= 1
        p /= n
        slopes = (np.stack([np.bincount(flat, p[row, c], len(known)) for c in range(k)], 1) + 1e-5 * w, p.sum(0))
        for at, (part, slope) in enumerate(zip((w, b), slopes, strict=True)):
            first, second = moments[2 * at], moments[2 * at + 1]
            first[:] = 0.9 * first + 0.1 * slope
            second[:] = 0.999 * second + 0.001 * slope**2
            part -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    logits = np.array([w[r].sum(0) + b for r in x[:held]])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(held), y[:held]]).mean())

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0), key=loss)
    return Model(families, place, w, b, temperature)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model with the lines of about ``sample`` documents as background."""
    usable = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    n = usable.count()
    scale = 1 << 30
    drawn = usable.where(F.pmod(F.xxhash64(F.lit("license"), F.col(id_col)), F.lit(scale)) < int(min(1.0, sample / max(1, n)) * scale))
    lines = append_columns(drawn.select(F.col(text_col).alias("text")), ["text"], "lines array<string>", lambda: lambda texts: [[some_lines(t) for t in texts]])
    return fit([line for own in sorted(r.lines for r in lines.select("lines").collect()) for line in own])


def some_lines(text: str) -> list[str]:
    """Up to LINES of the text's lines, in parts of LINE_WORDS words, drawn by their hash."""
    parts = set()
    for line in text.split("\n"):
        words = line.split()
        parts.update(" ".join(words[k : k + LINE_WORDS]) for k in range(0, len(words), LINE_WORDS))
    return sorted(parts, key=lambda part: xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass")))[:LINES]


def scan(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with n_paragraphs and licenses: family, start, end (code points, end exclusive), probability."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(texts):
            got = [shared.value.notices(t or "") for t in texts]
            names = ("family", "start", "end", "probability")
            return [[n for _, n in got], [[dict(zip(names, s, strict=True)) for s in spans] for spans, _ in got]]

        return step

    return append_columns(df, [text_col], "n_paragraphs long, licenses array<struct<family:string,start:int,end:int,probability:double>>", make)


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its paragraphs, how many are licence notices, their families and spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    one = lambda s: F.concat_ws(":", s["family"], s["start"].cast("string"), s["end"].cast("string"))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licenses").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["family"]))), ",").alias("families"),
        F.array_join(F.transform("licenses", one), ",").alias("spans"),
    )
