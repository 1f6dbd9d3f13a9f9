"""Licence scan: a trained paragraph classifier whose predictions templates confirm.

A paragraph is a line; lines of more than ``WINDOW`` words are read in windows that overlap by half.
Features are the paragraph's words and word pairs, hashed to ``BUCKETS`` rows; only those of the
templates have weights. A multinomial logistic regression, made sparse by soft thresholding, is
trained in numpy on damaged copies of the templates (cut, with words dropped, replaced and added)
and on paragraphs of the corpus as the class ``unknown``. The least probability at which a family
is reported is calibrated on copies held back. A prediction stands if enough of the paragraph's
word pairs are in one of its family's templates, or the other way round.

At most ``max_rows`` documents, chosen by a hash of their text, give the windows that train
``unknown``, of each the ``MAX_WINDOWS`` with the least hash in its whole text; windows that agree with a template are left out of them. Null and empty texts have
no paragraphs. Of families with equal probability the first in the table is predicted. A very long text or line is read in windows
like any other. Rows that repeat are answered each; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language_id import softmax

# Notices of public licences, by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 public domain dedication",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
}
FAMILIES = [*TEMPLATES, "unknown"]
BUCKETS = 1 << 16
WINDOW = 60
#: Most documents whose windows train the class ``unknown``, and most windows of each.
MAX_ROWS, MAX_WINDOWS = 1000, 8
#: Words of more bytes train as the hash that they are scored by.
LONG_WORD = 40
COPIES = 150
PRECISION = 0.995
#: Least share of word pairs that a paragraph and a template have in common, of the fewer of the two.
AGREE = 0.6
WORD_BYTES = common.byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def split(text: str) -> list[str]:
    raw = common.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = common.words(raw, np.array([0, len(raw)]), WORD_BYTES)
    raw = raw.tobytes()
    return [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())]


def _rows(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, and of each word with the next."""
    after = np.append(hashed[1:], np.uint64(0))
    return (hashed >> np.uint64(48)).astype(np.int64), (common.mix(hashed * np.uint64(3) + after) >> np.uint64(48)).astype(np.int64)


def _features(words: list[str]) -> np.ndarray:
    hashed = np.array([common.hash_of(w.encode()) for w in words], np.uint64)
    if not len(hashed):
        return np.zeros(0, np.int64)
    one, two = _rows(hashed)
    return np.concatenate([one, two[:-1]])


def _pairs(words: list[str]) -> set:
    return set(zip(words, words[1:])) or set(words)


_TEMPLATE_PAIRS = {k: [_pairs(split(t)) for t in texts] for k, texts in TEMPLATES.items()}


def agrees(words: list[str], family: str, least: float = AGREE) -> bool:
    """Whether a paragraph and a template of the family share enough; three pairs at least, or all of a shorter one."""
    own = _pairs(words)
    return any(len(own & t) >= max(least * min(len(own), len(t)), min(3, len(t))) for t in _TEMPLATE_PAIRS[family])


@dataclass
class Model:
    weights: np.ndarray  # a row for each family, a column for each bucket
    bias: np.ndarray
    threshold: float = 0.5

    def __post_init__(self):
        self.used = self.weights.any(0)

    def probabilities(self, one: np.ndarray, two: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row for each paragraph: ``of`` is each word's paragraph, the last pair of one is left out."""
        last = np.append(of[1:] != of[:-1], True)
        out = np.tile(self.bias, (len(sizes), 1))
        for rows, ok in ((one, None), (two, ~last)):
            at = np.flatnonzero(self.used[rows] if ok is None else self.used[rows] & ok)
            for k in range(len(FAMILIES)):
                out[:, k] += np.bincount(of[at], self.weights[k][rows[at]], len(sizes)) / np.sqrt(sizes)
        return softmax(out)


def train(unknown: list[list[str]], seed: int = 3, copies: int = COPIES, epochs: int = 30, rate: float = 0.5, sparse: float = 2e-5) -> Model:
    rng = np.random.default_rng(seed)
    filler = [w for p in unknown for w in p][:20_000] or ["lorem", "ipsum", "dolor"]
    vocabulary = np.zeros(BUCKETS, bool)
    samples: list[tuple[int, list[str]]] = []
    for y, texts in enumerate(TEMPLATES.values()):
        for text in texts:
            words = split(text)
            vocabulary[_features(words)] = True
            samples.append((y, words))
            for _ in range(copies // len(texts)):
                copy = [w if rng.random() > 0.04 else filler[rng.integers(len(filler))] for w in words if rng.random() > 0.05]
                if len(copy) > 16 and rng.random() < 0.5:
                    start = rng.integers(0, len(copy) - 12)
                    copy = copy[start : start + rng.integers(12, len(copy) + 1)]
                pad = rng.integers(0, 6, 2) if rng.random() < 0.4 else (0, 0)
                samples.append((y, [*(filler[rng.integers(len(filler))] for _ in range(pad[0])), *copy, *(filler[rng.integers(len(filler))] for _ in range(pad[1]))]))
    nothing = len(FAMILIES) - 1
    samples += [(nothing, p[:WINDOW]) for p in unknown if p]
    samples += [(nothing, [filler[rng.integers(len(filler))] for _ in range(rng.integers(1, 30))]) for _ in range(200)]
    order = rng.permutation(len(samples))
    rows = [(f := _features(samples[i][1]))[vocabulary[f]] for i in order]
    y = np.array([samples[i][0] for i in order])
    scale = np.array([1 / np.sqrt(max(1, len(samples[i][1]))) for i in order])
    held = len(order) // 5
    used = np.flatnonzero(vocabulary)
    column = np.zeros(BUCKETS, np.int64)
    column[used] = np.arange(len(used))
    x = np.zeros((len(rows), len(used)), np.float32)
    for k, f in enumerate(rows):
        np.add.at(x[k], column[f], scale[k])
    w, b = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    for epoch in range(epochs):
        now = rate / (1 + 0.1 * epoch)
        for k in np.array_split(rng.permutation(np.arange(held, len(rows))), max(1, (len(rows) - held) // 32)):
            g = softmax(x[k] @ w + b)
            g[np.arange(len(k)), y[k]] -= 1
            w -= now * (x[k].T @ g) / len(k) * 8
            b -= now * g.sum(0) / len(k)
            w = np.sign(w) * np.maximum(np.abs(w) - now * sparse * 8, 0)  # soft threshold
    weights = np.zeros((len(FAMILIES), BUCKETS), np.float32)
    weights[:, used] = w.T
    model = Model(weights, b)
    p = softmax(x[:held] @ w + b)
    best, score = p.argmax(1), p.max(1)
    named = np.flatnonzero(best != nothing)
    ordered = named[np.argsort(-score[named])]
    exact = np.cumsum((best == y[:held])[ordered]) / np.arange(1, len(ordered) + 1)
    good = np.flatnonzero(exact >= PRECISION)
    model.threshold = float(max(0.5, score[ordered[good[-1]]])) if len(good) else 0.9
    return model


def scan(data: np.ndarray, offsets: np.ndarray, model: Model):
    """Of each document: its number of paragraphs, and (family, probability, first byte, end byte) of the licensed ones."""
    for i, j in common.blocks(offsets):
        low, ends_at = common.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = common.words(low, ends_at, WORD_BYTES)
        lines = np.unique(np.concatenate([ends_at[:-1], np.flatnonzero(low == 10)]))
        line = np.searchsorted(lines, starts, "right")
        fresh = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        found: list[list] = [[] for _ in range(j - i)]
        counts = np.searchsorted(fresh, first[1:]) - np.searchsorted(fresh, first[:-1])
        if len(starts):
            stops = np.append(fresh[1:], len(starts))
            one, two = _rows(common.word_hash(low, starts, ends))
            # Windows (first and end word) of each line; every second one of a long line begins at half a window.
            heads, tails = [fresh[stops - fresh <= WINDOW]], [stops[stops - fresh <= WINDOW]]
            for a, b in zip(*(x[stops - fresh > WINDOW].tolist() for x in (fresh, stops))):
                begin = np.arange(a, b - WINDOW // 2, WINDOW // 2)
                heads.append(begin)
                tails.append(np.minimum(begin + WINDOW, b))
            heads, tails = np.concatenate(heads), np.concatenate(tails)
            # Without a word pair of a template no family can be confirmed.
            pair = np.concatenate([[0], np.cumsum(model.used[two])])
            some = pair[tails] > pair[heads]
            heads, tails = heads[some], tails[some]
            for k in range(0, len(heads), 20_000):  # bounded scratch space
                a, b = heads[k : k + 20_000], tails[k : k + 20_000]
                n = b - a
                of = np.repeat(np.arange(len(a)), n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + a[of]
                p = model.probabilities(one[at], two[at], of, n)
                best, score = p.argmax(1), p.max(1)
                for q in np.flatnonzero((best < len(FAMILIES) - 1) & (score >= model.threshold)).tolist():
                    words = [low[s:e].tobytes().decode(errors="replace") for s, e in zip(starts[a[q] : b[q]].tolist(), ends[a[q] : b[q]].tolist())]
                    if agrees(words, FAMILIES[best[q]]):
                        doc = int(np.searchsorted(first, a[q], "right")) - 1
                        found[doc].append((FAMILIES[best[q]], float(score[q]), int(starts[a[q]] - ends_at[doc]), int(ends[b[q] - 1] - ends_at[doc])))
        yield from zip(counts.tolist(), found)


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    texts = common.own_columns(docs, "text").where("text is not null")
    total = texts.count()
    share = min(1.0, max_rows / max(1, total))
    some = texts.where(F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def mapped(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                windows = {}
                for line in text.split("\n"):
                    words = [w if len(w.encode()) <= LONG_WORD else f"{common.hash_of(w.encode()):016x}" for w in split(line)]
                    for k in range(0, len(words), WINDOW):
                        windows[" ".join(words[k : k + WINDOW])] = None
                rows += sorted(windows, key=lambda x: (common.hash_of(x.encode()), x))[:MAX_WINDOWS]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["window"])

    # About max_rows * MAX_WINDOWS rows of WINDOW words.
    windows = sorted(r.window.split(" ") for r in some.mapInArrow(common.tidy(mapped), "window string").toLocalIterator())
    return train([p for p in windows if not any(agrees(p, k, 0.3) for k in TEMPLATES)])


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_paragraphs, found): family, probability and byte span of each licensed paragraph."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("family", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))

    def mapped(batches):
        for batch in batches:
            got = list(scan(*common.utf8(batch.column("text")), sent.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([[dict(zip(("family", "score", "start", "stop"), x)) for x in f] for _, f in got], kind)], ["doc_id", "n_paragraphs", "found"])

    return common.own_columns(docs, "doc_id", "text").mapInArrow(common.tidy(mapped), "doc_id bigint, n_paragraphs bigint, found array<struct<family:string,score:double,start:int,stop:int>>")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find(docs, fit(docs))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",")
    return found.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licensed"), families.alias("licences"), F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"))
