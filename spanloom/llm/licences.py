"""Licence notices found by a trained paragraph classifier.

A multinomial logistic regression over sparse word n-grams (one to three words) is trained on the driver from
the templates below, varied by rule, against paragraphs of a bounded sample of the table. Its probabilities
are calibrated by a temperature on templates that were held out whole, wording and all; the least probability
for a family is the one that keeps 99 % of the held-out notices that were classified rightly. A predicted family
is confirmed by comparing the words with the family's templates; a notice that is too uncertain or that no
template confirms is of the class ``unknown``.

Paragraphs end at blank lines; comment marks at the ends of their lines are taken off and the lines joined, so a
notice is found however it is wrapped. A paragraph is read in overlapping windows and line by line, all windows
of a batch as one sparse product, and every window counts: a paragraph has a row for each of its notices, those
of one family that are closer than a window being one.

Defined results: null and empty texts have no notices; a notice that occurs in several paragraphs or rows is
reported for each; of accounts of the same words the most like its template is taken, of equals the surer, then
the first; an empty table gives an empty result, and the classifier then has no negative examples but its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drawn, sliced, texts_of

WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
#: Marks that comments have at the ends of their lines.
MARKS = re.compile(r"^[ \t>]*(?://+!?|/\*+!?|\*+/?|#+|--+|;+|%+|<!--|\"\"\"|'''|(?:rem|dnl)\b)?[ \t]*|[ \t]*(?:\*+/|-->|#+|\*+)?[ \t\r]*$", re.IGNORECASE)
#: Windows that are scored together.
AT_ONCE = 20_000
WINDOW, STRIDE = 32, 20
#: Words of the shortest template.
SHORTEST = 3
NONE, UNKNOWN = "none", "unknown"

# Customary wordings of notices by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The MIT License (MIT)",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is available under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Distributed under the GPLv3 license.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "Distributed under the GPLv2 license.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the LGPL license.",
    ],
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Distributed under the AGPLv3 license.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD license.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
    "Proprietary": [
        "All rights reserved. No part of this publication may be reproduced or distributed without prior written permission of the publisher.",
        "Copyright. All rights reserved.",
        "All rights reserved.",
    ],
    UNKNOWN: [
        "Use of this file is subject to the terms of the licence agreement.",
        "Licensed under the terms of a custom licence; see the accompanying file.",
        "This material is licensed under its own terms and conditions.",
        "Released under a license of its own.",
    ],
}
# Sentences with words of notices that are none.
OTHERWISE = [
    "He renewed his driver license last week at the office.",
    "Researchers at MIT published a new version of the study.",
    "The public library opened under a new general manager.",
    "The actor took creative license with the story.",
    "They granted the city permission to build the road.",
    "The Apache helicopter landed near the source of the river.",
    "This is the work of many people and it is not finished.",
    "The version of the song that was released in May is free.",
    # what stands beside notices of several families and names none
    "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability",
    "but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability",
]


@dataclass(frozen=True)
class Settings:
    """The sample bounds what the driver reads of the table: ``sample_rows`` texts of ``sample_chars`` characters."""

    sample_rows: int = 300
    sample_chars: int = 4000
    negatives: int = 900
    variants: int = 12
    features: int = 3000
    steps: int = 150
    rate: float = 20.0
    penalty: float = 1e-5
    least_similarity: float = 0.6
    seed: int = 11


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def paragraphs(text: str) -> list[list[str]]:
    """The lines of each paragraph without comment marks; lines without a word stand between paragraphs."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if len(line) < 400:
            line = MARKS.sub("", line)
        if WORD.search(line):
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def _grams(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@dataclass(frozen=True)
class Model:
    classes: tuple[str, ...]
    known: dict[str, int]  # words that are part of a feature
    features: dict[tuple[int, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    templates: dict[str, list[frozenset]]
    least_similarity: float

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For n-grams of one, two and three words: their packed word numbers in order, and their features."""
        out = []
        for n in (1, 2, 3):
            own = sorted((sum(w << (20 * i) for i, w in enumerate(g)), f) for g, f in self.features.items() if len(g) == n)
            out.append((np.array([k for k, _ in own] or [-1], np.int64), np.array([f for _, f in own] or [-1], np.int64)))
        return out

    def entries(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, feature), each once and in order, of windows over the numbers of words (-1 for words of no feature)."""
        found = []
        for n, (keys, features) in enumerate(self.tables, 1):
            if len(ids) < n:
                continue
            parts = [ids[i : len(ids) - n + 1 + i] for i in range(n)]
            packed = sum(p << (20 * i) for i, p in enumerate(parts))
            at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
            places = np.flatnonzero((np.min(parts, 0) >= 0) & (keys[at] == packed))
            own = features[at[places]]
            a, b = np.searchsorted(places, starts), np.searchsorted(places, np.maximum(starts, ends - n + 1))
            many = np.maximum(b - a, 0)
            of = np.repeat(np.arange(len(starts)), many)
            found.append(of * len(self.features) + own[np.repeat(a - (np.cumsum(many) - many), many) + np.arange(len(of))])
        return np.divmod(np.unique(np.concatenate([np.empty(0, np.int64), *found])), max(len(self.features), 1))

    def probabilities(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of the classes of each window: one sparse product for them all."""
        of, features = self.entries(ids, starts, ends)
        z = np.zeros((len(starts), len(self.classes)))
        if len(of):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            z[of[first]] = np.add.reduceat(self.weights[features], first, axis=0)
        z = (self.bias + z / np.sqrt(np.maximum(1, 3 * (ends - starts) - 3))[:, None]) / self.temperature
        return _softmax(z)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))

    def _predicted(self, words: list[str]) -> tuple[str, float]:
        p = self.probabilities(self.numbers(words), np.array([0]), np.array([len(words)]))[0]
        top = int(p.argmax())
        return self.classes[top], float(p[top])

    def _confirmed(self, window: list[str], family: str, p: float) -> list[tuple[float, float, str, int, int]]:
        """Similarity, probability, family and stretch of each confirmed notice of a window that isn't ``none``.

        The window's own family is confirmed by the whole window. Any other family needs a stretch that is like
        one of its templates and is classified as that family by itself.
        """
        pairs = list(zip(window, window[1:], strict=False))
        held = set(pairs)
        found = []
        for other, own in self.templates.items():
            similarity, t = max(((len(held & t) / len(t), t) for t in own), key=lambda x: x[0], default=(0.0, frozenset()))
            if similarity < self.least_similarity:
                continue
            if other == family and p >= self.least:
                a, b, _ = _stretch(pairs, t)
                found.append((similarity, p, family, a, b))
                continue
            for a, b, alike in (_stretch(pairs, t) for t in own):
                if alike >= self.least_similarity:
                    kind, q = self._predicted(window[a:b])
                    if kind == other and q >= self.least:
                        found.append((alike, q, other, a, b))
        return found

    def notices(self, paragraph: str) -> list[tuple[str, float, float, bool]]:
        """Class, probability, similarity to the best template and whether that confirms it, for each notice in order."""
        return next((found for _, _, found in self.read([paragraph])), [])

    def read(self, texts: list[str]) -> Iterator[tuple[int, int, list[tuple[str, float, float, bool]]]]:
        """(text, paragraph, its notices) for each paragraph that has any."""
        words: list[str] = []
        owner: list[tuple[int, int, int, int]] = []
        starts, ends, of = [], [], []
        for t, text in enumerate(texts):
            for n, lines in enumerate(paragraphs(text)):
                begin = len(words)
                for line in lines:
                    at = len(words)
                    words += words_of(line)
                    if len(lines) > 1 and SHORTEST <= len(words) - at <= WINDOW:
                        starts.append(at)
                        ends.append(len(words))
                        of.append(len(owner))
                for at in range(begin, max(begin + 1, len(words) - (WINDOW - STRIDE)), STRIDE):
                    starts.append(at)
                    ends.append(min(at + WINDOW, len(words)))
                    of.append(len(owner))
                owner.append((t, n, begin, len(words)))
        ids, a, b = self.numbers(words), np.array(starts, np.int64), np.array(ends, np.int64)
        none = self.classes.index(NONE)
        seen: dict[int, list[tuple[int, int, str, float]]] = {}
        for at in range(0, len(a), AT_ONCE):
            p = self.probabilities(ids, a[at : at + AT_ONCE], b[at : at + AT_ONCE])
            top = p.argmax(1)
            for i in np.flatnonzero(top != none):
                k = owner[of[at + i]]
                seen.setdefault(of[at + i], []).append((starts[at + i] - k[2], ends[at + i] - k[2], self.classes[top[i]], float(p[i, top[i]])))
        for k in sorted(seen):
            t, n, begin, end = owner[k]
            found = self._settled(words[begin:end], sorted(seen[k]))
            if found:
                yield t, n, found

    def _settled(self, words: list[str], windows: list[tuple[int, int, str, float]]) -> list[tuple[str, float, float, bool]]:
        """A paragraph's notices from its windows that aren't ``none``.

        Accounts of the same words are one notice, and so are those of one family that are closer than a window.
        What a confirmed notice leaves of a window is judged by itself.
        """
        found = [(s, q, f, at + a, at + b) for at, end, family, p in windows for s, q, f, a, b in self._confirmed(words[at:end], family, p)]
        taken: list[tuple[float, float, str, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[0], -x[1], x[3])):
            if not any(x[3] < t[4] and t[3] < x[4] for t in taken):
                taken.append(x)
        out = _merged(taken)
        rest = []
        for begin, end, family, p in windows:
            cuts = sorted((max(t[3], begin), min(t[4], end)) for t in taken if t[3] < end and begin < t[4])
            parts = zip([begin, *(b for _, b in cuts)], [*(a for a, _ in cuts), end], strict=True)
            for a, b in parts if cuts else ((begin, end),):
                # no notice is of fewer words than the shortest template
                if cuts and b - a < SHORTEST:
                    continue
                kind, q = self._predicted(words[a:b]) if cuts else (family, p)
                if kind != NONE and not any(t[2] == kind and a - t[4] < WINDOW and t[3] - b < WINDOW for t in taken):
                    pairs = {*zip(words[a:b], words[a + 1 : b], strict=False)}
                    rest.append((max((len(pairs & t) / len(t) for t in self.templates.get(kind, ())), default=0.0), q, UNKNOWN, a, b))
        out += _merged(sorted(rest, key=lambda x: (-x[1], x[3])))
        return [(f, p, s, f != UNKNOWN) for s, p, f, _, _ in sorted(out, key=lambda x: (x[3], x[2]))]

    def judge(self, paragraph: str) -> tuple[str, float, float, bool] | None:
        """The surest of a text's notices, a confirmed one if there is any; None without a notice."""
        return max((x for _, _, found in self.read([paragraph]) for x in found), key=lambda x: (x[3], x[1]), default=None)


def _stretch(pairs: list[tuple[str, str]], template: frozenset) -> tuple[int, int, float]:
    """First and last word of the stretch most like a template, some words more than it at most, and the likeness."""
    best = (0, 0, 0.0)
    for i in (i for i, x in enumerate(pairs) if x in template):
        seen: set[tuple[str, str]] = set()
        for j in range(i, min(len(pairs), i + len(template) * 5 // 4 + 2)):
            if pairs[j] in template and pairs[j] not in seen:
                seen.add(pairs[j])
                if len(seen) / len(template) > best[2] or (len(seen) / len(template) == best[2] and j + 2 - i < best[1] - best[0]):
                    best = (i, j + 2, len(seen) / len(template))
    return best


def _merged(found: list[tuple[float, float, str, int, int]]) -> list[tuple[float, float, str, int, int]]:
    """The best first: one for each group of a family whose members are closer than a window to the next."""
    out: list[tuple[float, float, str, int, int]] = []
    by_place = sorted(range(len(found)), key=lambda i: (found[i][2], found[i][3]))
    group: list[int] = []
    end = 0
    for i in by_place:
        if group and (found[i][2] != found[group[0]][2] or found[i][3] - end >= WINDOW):
            out.append(found[min(group)])
            group = []
        end = max(end, found[i][4]) if group else found[i][4]
        group.append(i)
    return out + ([found[min(group)]] if group else [])


def _varied(template: str, rng: np.random.Generator, filler: list[str]) -> list[str]:
    """A template's words with some dropped, and others of the table around them."""
    words = words_of(template)
    kept = [w for w in words if len(words) < 4 or rng.random() > 0.08]
    before, after = (rng.integers(0, 13) * (rng.random() < 0.6) for _ in range(2))
    pick = lambda n: [filler[i] for i in rng.integers(0, len(filler), n)] if filler else []
    return pick(int(before)) + (kept or words) + pick(int(after))


def _examples(blocks: list[list[str]], settings: Settings) -> tuple[list[list[str]], list[str], list[bool]]:
    """(words, class, whether it is held out) of each example; of a family's templates the second of several is held out whole."""
    rng = np.random.default_rng(settings.seed)
    filler = [w for p in blocks[:200] for w in p][:5000]
    out: list[tuple[list[str], str, bool]] = []
    for family, own in TEMPLATES.items():
        for n, t in enumerate(own):
            held = len(own) > 2 and n == 1
            out.append((words_of(t), family, held))
            out += [(_varied(t, rng, filler), family, held) for _ in range(settings.variants)]
    for t in OTHERWISE:
        out += [(words_of(t), NONE, False), (_varied(t, rng, filler), NONE, False)]
    out += [(p, NONE, n % 5 == 4) for n, p in enumerate(blocks)]
    return tuple(map(list, zip(*out, strict=True)))


def train(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> Model:
    """A model for a table, from the templates and a bounded sample of its paragraphs.

    The temperature and the least probability are set with the held-out templates; the weights are then fitted on all.
    """
    rows = drawn(docs, settings.sample_rows).select(F.substring(F.coalesce(F.col(text), F.lit("")), 1, settings.sample_chars).alias("t")).collect()
    templates = {family: [frozenset(zip(w, w[1:], strict=False)) for w in map(words_of, own)] for family, own in TEMPLATES.items() if family != UNKNOWN}
    every = [t for own in templates.values() for t in own]
    blocks: list[list[str]] = []
    # lines and windows of paragraphs, as both are read
    for r in rows:
        for lines in paragraphs(r.t):
            whole = words_of("\n".join(lines))
            for words in [*(words_of(x)[:WINDOW] for x in lines[:8]), whole[:WINDOW], whole[STRIDE : STRIDE + WINDOW]]:
                pairs = set(zip(words, words[1:], strict=False))
                # the sample may hold notices; they are no negatives
                if words and len(blocks) < settings.negatives and max(len(pairs & t) / len(t) for t in every) < 0.3:
                    blocks.append(words)

    texts, labels, held = _examples(blocks, settings)
    held = np.array(held)
    classes = (*TEMPLATES, NONE)
    counts: dict[tuple[str, ...], int] = {}
    for words, label in zip(texts, labels, strict=True):
        if label != NONE:
            for g in set(_grams(words)):
                counts[g] = counts.get(g, 0) + 1
    chosen = sorted((g for g, n in counts.items() if n >= 3), key=lambda g: (-counts[g], g))[: settings.features]
    known = {w: i for i, w in enumerate(sorted({w for g in chosen for w in g}))}
    features = {tuple(known[w] for w in g): i for i, g in enumerate(chosen)}
    draft = Model(classes, known, features, np.zeros((len(features), len(classes))), np.zeros(len(classes)), 1.0, 0.0, templates, settings.least_similarity)
    ends = np.cumsum([len(t) for t in texts])
    of, found = draft.entries(draft.numbers([w for t in texts for w in t]), ends - [len(t) for t in texts], ends)
    x = np.zeros((len(texts), len(features)), np.float32)
    x[of, found] = 1 / np.sqrt([max(1, 3 * len(t) - 3) for t in texts])[of]
    y = np.array([classes.index(c) for c in labels])

    weights, bias = _descend(x[~held], y[~held], len(classes), settings)
    z = x[held] @ weights + bias
    temperature = min((0.25 * 1.25**i for i in range(14)), key=lambda t: _loss(z / t, y[held]))
    p = _softmax(z / temperature)
    right = (p.argmax(1) == y[held]) & (y[held] != classes.index(NONE))
    least = float(np.quantile(p.max(1)[right], 0.01)) if right.any() else 0.5
    weights, bias = _descend(x, y, len(classes), settings)
    return Model(classes, known, features, weights, bias, float(temperature), least, templates, settings.least_similarity)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(_softmax(z)[np.arange(len(y)), y] + 1e-12).mean())


def _descend(x: np.ndarray, y: np.ndarray, classes: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch gradient descent with momentum on the penalised cross-entropy."""
    weights, bias = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    push, lean = np.zeros_like(weights), np.zeros_like(bias)
    target = np.eye(classes, dtype=np.float32)[y]
    for _ in range(settings.steps):
        gap = (_softmax(x @ weights + bias) - target) / len(y)
        push = 0.9 * push + x.T @ gap + settings.penalty * weights
        lean = 0.9 * lean + gap.sum(0)
        weights = weights - settings.rate * push
        bias = bias - settings.rate * 0.1 * lean
    return weights, bias


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per notice: key, ``paragraph`` (from 0), ``family``, ``probability``, ``similarity``, ``confirmed``, ``notice``
    (the paragraph's lines joined)."""
    source = docs.select(F.col(key), F.col(text).alias("__text"))
    names = [key, "paragraph", "family", "probability", "similarity", "confirmed", "notice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 250):
            texts = texts_of(batch.column("__text"))
            found = [(row, n, *x, " ".join(paragraphs(texts[row])[n])) for row, n, own in model.read(texts) for x in own]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
            columns = [pa.array([f[i + 1] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([f[0] for f in found], pa.int32())), *columns], names)

    schema = f"`{key}` {dict(source.dtypes)[key]}, paragraph long, family string, probability double, similarity double, confirmed boolean, notice string"
    return source.mapInArrow(run, schema)
