"""Licence scan: a trained paragraph classifier whose predictions a template comparison confirms.

Paragraphs are what blank lines part; the words of a paragraph are read on over its line breaks and comment marks, so hard-wrapped
notices are seen whole. They are read in windows of ``WINDOW`` words, ``STRIDE`` apart, so that a notice inside a long
paragraph is not diluted. A multinomial logistic regression on hashed word 1-, 2- and 3-grams gives each window a licence family or
the unknown class; its probabilities are calibrated by a temperature fitted on samples that the weights were not fitted on. Neighbouring windows of a paragraph in which the licence families together have probability ``MIN_PROBABILITY`` or
more are a prediction. The families that reach ``MIN_FAMILY`` in it are compared with their templates: the one that holds the most
of the word pairs of a template is reported, and confirmed if that share is ``MIN_SIMILARITY`` or more, then the others which are
confirmed elsewhere in it. A row reaches from the first to the last word of the pairs that it shares with its best template (over
the whole prediction, where it shares none).

The samples are labelled rows (text, family): a table of them is an argument of ``scan``, bounded by ``MAX_PER_FAMILY``; by default
they are made of the templates below (short notices, sentences of licence texts and names, some in our own wording) with words
dropped, exchanged and added around them; the unknown class of invented prose, shuffled templates and sentences that only mention
licences. Texts of families that have no template are unknown: they give no row.

Defined results
* null, empty or blank text: no rows; null ``doc_id``: scanned like any other; repeated rows: each reports its paragraphs;
* ties between families: the more probable, then the first by name; between templates: the longer, then the first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm import linear, textvec
from clausewright.session import require

DIMS = 1 << 16
WINDOW, STRIDE = 16, 8
SCALE, SMOOTH = 60.0, 48.0
MIN_PROBABILITY, MIN_FAMILY, MIN_SIMILARITY = 0.5, 0.1, 0.5
UNKNOWN = "unknown"
#: Rows of each family that are taken from a labelled table, at most.
MAX_PER_FAMILY = 2000
#: A line break with a line after it that holds no letter or digit (comment marks may stand there).
_BLANK_LINE = re.compile(r"\n[^\w\n]*\n")
TEMPLATES: dict[str, list[str]] = {
    "agpl-3.0": ["AGPL version 3", "GNU Affero General Public License version 3", "under the terms of the GNU Affero General Public License as published", "Licensed under the AGPL, version 3 or later.", "This server is free software under AGPL-3.0, the Affero GPL.", "users who interact with it over a network may receive its source, as the Affero License asks"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License, Version 2.0, January 2004", "you may not use this file except in compliance with the License", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS", "See the License for the specific language governing permissions and limitations", "The project is made available under version 2.0 of the Apache License.", "Apache Software License 2.0 applies to this code", "Apache-2.0 licensed; a copy is at www.apache.org/licenses/LICENSE-2.0", "licensed under the Apache 2 licence", "under the Apache License, Version 2.0"],
    "bsd-2-clause": ["Licensed under the simplified BSD License (two clauses).", "2-Clause BSD License", "BSD-2-Clause, also known as the FreeBSD licence", "Redistributions must keep the above copyright notice and these two conditions"],
    "bsd-3-clause": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "Neither the name of the author nor the names of its contributors may be used to endorse products", "Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "the revised BSD license with its three clauses", "modified BSD License"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "This work is under CC BY 4.0.", "You may share and adapt it if you give appropriate credit, CC-BY-4.0.", "text available under the Creative Commons Attribution licence"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "licensed under Creative Commons BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International License", "Content is available under Creative Commons BY-NC 4.0.", "CC-BY-NC 4.0: noncommercial use only, with attribution", "the licensor permits sharing and adapting for NonCommercial purposes under Attribution-NonCommercial", "under the CC BY-NC 4.0 licence"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under CC BY-SA 4.0.", "CC-BY-SA: share alike under the same licence", "shared under Attribution-ShareAlike terms of Creative Commons"],
    "cc0-1.0": ["CC0 1.0 Universal public domain dedication", "To the extent possible under law, all copyright and related rights have been waived", "released into the public domain under CC0", "Creative Commons Zero, no rights reserved"],
    "epl-2.0": ["Eclipse Public License v. 2.0", "made available under the terms of the Eclipse Public License 2.0", "EPL-2.0 applies to this program and its accompanying materials", "the accompanying materials are under the Eclipse Public License, version 2"],
    "gpl-2.0": ["GPL version 2", "GNU General Public License, version 2", "GNU General Public License version 2", "it under the terms of version 2 of the GNU General Public License", "Licensed under the GPLv2.", "GPL-2.0-only: the GNU GPL in its second version", "either version 2 of the License, or (at your option) any later version"],
    "gpl-3.0": ["GNU General Public License, version 3", "GPL version 3", "GNU General Public License version 3", "it under the terms of the GNU General Public License as published by the Free Software Foundation", "either version 3 of the License, or (at your option) any later version", "You should have received a copy of the GNU General Public License along with this program", "Licensed under the GPL version 3.", "GNU GPL v3 or later", "GPL-3.0: the third version of the General Public License of GNU", "licensed under GNU General Public License, version 3"],
    "isc": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose", "Licensed under the terms of the ISC licence.", "the ISC license of the Internet Systems Consortium"],
    "lgpl-2.1": ["LGPL version 2.1", "GNU Lesser General Public License version 2.1", "it under the terms of the GNU Lesser General Public License as published", "Licensed under the LGPL 2.1 or later.", "this library is free software under the Lesser GPL"],
    "mit": ["under the MIT License", "MIT License", "The MIT License (MIT)", "deal in the Software without restriction, including without limitation the rights to use, copy", "to whom the Software is furnished to do so, subject to the following conditions", "This project is available under the terms of the MIT license.", "MIT licensed", "provided under the MIT licence, see the file LICENSE", "published under the MIT License"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License", "You can obtain one at mozilla.org/MPL/2.0", "Covered by the MPL, v. 2.0.", "the MPL 2.0 governs this file"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "The Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "dedicated to the public domain by the Unlicense, see unlicense.org"],
}
_DECOYS = """All rights reserved. | You need a driving license to drive a car in the city. | The restaurant lost its liquor license last year. |
The public library opened a new version of its catalogue. | She studied at MIT and works in a general hospital. | The software was free and the terms were clear. |
Poetic license is the freedom of the writer. | Copyright by the author. All rights are reserved. | Permission was granted by the general manager. | The gnu is a large animal of the open plain. |
Version 2.0 of the report was released under pressure. | Work under the new terms began in May. | This work is hard and the general public knows it. | Version 3 was released in the spring. |
The Mozilla browser and the Apache helicopter have nothing in common. | A creative attribution of the noncommercial kind. | You may not use the lift in case of fire. | Terms and conditions apply. |
The fishing license is valid for one year. | Contact us for a commercial license. | He was released under the care of his doctor. | Published under the name of his wife. | See the file for the terms of the contract. |
The network interacts with its users. | It may be used, copied and sold like any other good. | The Eclipse of the sun was total. | The public domain of the city lies open to all. | He gave credit to the author. |
Lesser animals are free to move. | The board consists of three clauses and two conditions. | The foundation published a copy of the program along with this letter. | No rights were reserved at the restaurant. | Shared alike by all of them.""".replace("\n", " ").split(" | ")
_SYLLABLES = "the an on th er in ed ti ha re nd es en at ou ing ion ly ble ea is or st nt le de la un que para los der die und ein ich sch au eau tion ment".split()
FAMILIES = [*sorted(TEMPLATES), UNKNOWN]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("paragraph", "start", "end")], T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType())])


def _prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def _spoilt(rng: random.Random, template: str) -> str:
    """A template with words dropped or in capitals now and then, and prose around it."""
    words = template.split()
    if rng.random() < 0.5:
        words = [w for w in words if rng.random() > 0.08] or words
    if rng.random() < 0.2:
        words = [w.upper() for w in words]
    room = rng.choice([0, rng.randint(0, max(0, WINDOW - len(words))), max(0, WINDOW - len(words))])
    before = rng.randint(0, room)
    words = [*_prose(rng, before), *words, *_prose(rng, room - before)]
    at = rng.randint(0, max(0, len(words) - WINDOW))  # what a window sees of it
    return " ".join(words[at : at + WINDOW])


def samples(n: int = 200, seed: int = 3, templates: dict[str, list[str]] = TEMPLATES) -> tuple[list[str], np.ndarray]:
    """n texts of each family and 8 n of the unknown class."""
    rng = random.Random(seed)
    texts, labels = [], []
    for k, family in enumerate(FAMILIES[:-1]):
        texts += [_spoilt(rng, rng.choice(templates[family])) for _ in range(n)]
        labels += [k] * n
    pool = [w for t in TEMPLATES.values() for x in t for w in x.split()]
    for _ in range(8 * n):
        kind = rng.random()
        if kind < 0.1:
            words = [w for w in _prose(rng, rng.randint(1, 3)) for _ in range(rng.randint(4, WINDOW // 2))]
        elif kind < 0.6:
            words = _prose(rng, rng.randint(1, rng.choice([3, WINDOW])))
        elif kind < 0.96:
            words = [*_prose(rng, rng.choice([0, 4, 8])), *rng.choice(_DECOYS).split(), *_prose(rng, rng.choice([0, 4, 8]))]
        else:
            words = [rng.choice(pool) for _ in range(rng.randint(1, 12))]
        texts.append(" ".join(words))
        labels.append(len(FAMILIES) - 1)
    return texts, np.array(labels)


def bounded(table: DataFrame, per_family: int = MAX_PER_FAMILY) -> tuple[list[str], np.ndarray]:
    """At most ``per_family`` rows of each family of a labelled table (text, family), chosen by a hash; families without a template,
    null among them, are unknown."""
    rows = require(table, {"text": T.StringType(), "family": T.StringType()}).where("text IS NOT NULL")
    family = F.when(F.col("family").isin(*TEMPLATES), F.col("family")).otherwise(UNKNOWN)
    rank = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("text"), "text"))
    rows = rows.select("text", family.alias("family")).withColumn("rank", rank).where(F.col("rank") <= per_family).orderBy("family", "rank").collect()
    return [r["text"] for r in rows], np.array([FAMILIES.index(r["family"]) for r in rows], int)


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights.astype(np.float32), bias, temperature

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _grams(hashes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n of 1 to 3: the first word of each n-gram inside one owner, and the n-gram's bucket."""
    at = np.arange(len(hashes))
    for n in (1, 2, 3):
        if len(hashes) >= n:
            h, _ = textvec.word_ngrams(hashes, owner, n)
            first = at[: len(hashes) - n + 1][owner[: len(hashes) - n + 1] == owner[n - 1 :]]
            yield n, first, (h % np.uint64(DIMS)).astype(np.int64)


def _rows(texts: list[str]) -> linear.Rows:
    hashes, owner, _, _ = textvec.words(texts)
    parts = list(_grams(hashes, owner))
    return linear.Rows.counted(np.concatenate([b for _, _, b in parts]), np.concatenate([owner[f] for _, f, _ in parts]), len(texts), DIMS, SCALE, SMOOTH)


def train(n: int = 200, seed: int = 3, steps: int = 120, more: tuple[list[str], np.ndarray] | None = None, templates: dict[str, list[str]] = TEMPLATES) -> Model:
    """Weights from four fifths of the samples (and of ``more`` labelled rows), temperature from the rest."""
    texts, labels = samples(n, seed, templates)
    if more is not None and len(more[0]):
        texts, labels = texts + more[0], np.concatenate((labels, more[1]))
    rows = _rows(texts)
    held = np.random.default_rng(seed).random(len(texts)) < 0.2
    fitted = np.flatnonzero(~held)
    weight = np.where(labels == len(FAMILIES) - 1, 0.5, 1.0)
    w, b = linear.fit(rows.some(fitted), labels[fitted], len(FAMILIES), DIMS, steps=steps, rate=0.15, l2=1e-7, weight=weight[fitted])
    return Model(w, b, linear.temperature((rows.dot(w) + b)[held], labels[held]))


def _pairs(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], strict=False)) or {tuple(words)}


_TEMPLATE_GRAMS = {f: [_pairs(re.findall(r"\w+", t.lower())) for t in ts] for f, ts in TEMPLATES.items()}


def similarity(text: str, family: str) -> tuple[float, int, int]:
    """The largest share of a template's word pairs that the text holds, and from where to where these pairs lie in it."""
    found = [(m[0].lower(), *m.span()) for m in re.finditer(r"\w+", text)]
    if len(found) == 1:
        pairs = [((found[0][0],), found[0][1], found[0][2])]
    else:
        pairs = [((a, b), s, e) for (a, s, _), (b, _, e) in zip(found, found[1:], strict=False)]
    grams = {p for p, _, _ in pairs}
    shares = [len(grams & t) / len(t) for t in _TEMPLATE_GRAMS[family]]
    best = max(range(len(shares)), key=lambda k: (shares[k], len(_TEMPLATE_GRAMS[family][k]), -k))
    places: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for p, s, e in pairs:
        if p in _TEMPLATE_GRAMS[family][best]:
            places.setdefault(p, []).append((s, e))
    if not places:
        return 0.0, 0, len(text)
    once = sorted(x[0][0] for x in places.values() if len(x) == 1) or sorted(s for x in places.values() for s, _ in x)
    middle = once[len(once) // 2]  # of a pair that occurs several times the place nearest to the others counts
    near = [min(x, key=lambda at: abs(at[0] - middle)) for x in places.values()]
    return shares[best], min(s for s, _ in near), max(e for _, e in near)


def windows(hashes: np.ndarray, owner: np.ndarray, line: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word + 1, paragraph, probabilities of the families) of each window. ``line``: the paragraph of each word in its text."""
    fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])))
    paragraph = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    length = np.diff(np.append(begin, len(hashes)))
    windows = np.maximum(1, -(-(length - WINDOW) // STRIDE) + 1)
    of = np.repeat(np.arange(len(begin)), windows)
    low = begin[of] + STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows))
    high = np.minimum(low + WINDOW, (begin + length)[of])
    logits, count = np.zeros((len(of), len(FAMILIES)), np.float64), np.zeros(len(of))
    for n, first, bucket in _grams(hashes, paragraph):
        sums = np.zeros((len(bucket) + 1, len(FAMILIES)), np.float32 if len(bucket) < 1 << 12 else np.float64)
        np.cumsum(model.weights[bucket], axis=0, out=sums[1:])
        i, j = np.searchsorted(first, low), np.searchsorted(first, np.maximum(high - n + 1, low))
        logits += sums[j] - sums[i]
        count += j - i
    logits = SCALE * logits / (count + SMOOTH)[:, None] + model.bias
    return low, high, of, model.probabilities(logits)


def classify(texts: list[str], model: Model) -> list[tuple[int, int, int, int, str, float, float]]:
    """(text, paragraph, start, end, family, probability, similarity) of each notice in a run of predicted windows."""
    hashes, owner, starts, ends = textvec.words(texts)
    if not len(hashes):
        return []
    breaks = [np.array([m.end() - 1 for m in _BLANK_LINE.finditer(t)], int) for t in texts]  # the paragraphs of each text
    line = np.concatenate([np.searchsorted(b, starts[owner == i]) for i, b in enumerate(breaks)]) if len(texts) > 1 else np.searchsorted(breaks[0], starts)
    low, high, of, p = windows(hashes, owner, line, model)
    hit = np.flatnonzero(1 - p[:, -1] >= MIN_PROBABILITY)
    out, k = [], 0
    while k < len(hit):
        m = k + 1
        while m < len(hit) and hit[m] == hit[m - 1] + 1 and of[hit[m]] == of[hit[k]]:
            m += 1
        first, last = low[hit[k]], high[hit[m - 1]] - 1
        text, start, end = int(owner[first]), int(starts[first]), int(ends[last])
        likely = p[hit[k:m], :-1].max(axis=0)
        told = []
        for f in np.flatnonzero((likely >= MIN_FAMILY) | (likely == likely.max())).tolist():
            share, s, e = similarity(texts[text][start:end], FAMILIES[f])
            told.append((-share, -float(likely[f]), FAMILIES[f], s, e))
        taken: list[tuple[int, int]] = []
        for share, q, family, s, e in sorted(told):
            if not taken or (-share >= MIN_SIMILARITY and all(e <= x or y <= s for x, y in taken)):
                taken.append((s, e))
                out.append((text, int(line[first]), start + s, start + e, family, -q, -share))
        k = m
    return out


def scan(docs: DataFrame, model: Model | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """One row for each paragraph, or part of one, that the classifier assigns to a family. ``labelled``: more samples (text, family)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(more=None if labelled is None else bounded(labelled)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textvec.sliced(batches):
            ids, rows = batch.column(0).to_pylist(), []
            for first, texts in textvec.groups(batch.column(1).to_pylist()):
                rows += [(ids[first + i], line, s, e, f, round(p, 6), round(x, 6), x >= MIN_SIMILARITY) for i, line, s, e, f, p, x in classify(texts, shared.value)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SCHEMA.names)

    return require(docs, {"doc_id": T.LongType(), "text": T.StringType()}).mapInArrow(run, SCHEMA)
