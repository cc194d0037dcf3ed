"""Licence scan: a trained classifier of paragraphs names the licence family of
every run of words, or says that it is none, and a comparison with the family's
templates confirms what it finds.

Features are words and pairs of neighbouring words of the templates; weights are
those of a multinomial logistic regression, fitted by FTRL on templates,
altered copies of them, and paragraphs of a bounded sample of the documents,
which make up the unknown class. A temperature and the least probability of a
licence are calibrated on held-back runs. A prediction counts only if enough
word pairs of one of the family's templates stand in the run.

A run is a paragraph, or, of one longer than ``RUN`` words, ``RUN`` words in
steps of ``STEP``; whole texts are scanned.

Defined cases: a null or empty text has no run and no licence; null ids are
carried; repeated rows are scanned one by one; on an empty table the templates
alone train the model. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweave.llm.batches import Step, map_batches, utf8
from storyweave.llm.decontaminate import words_of
from storyweave.llm.langid import calibrated, ftrl, softmax

RUN, STEP = 64, 48
UNKNOWN = "unknown"
SIMILAR = 0.6

#: Usual statements of licences, by family. Fixed values.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPL, version 2 or later.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Released into the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced or transmitted in any form without prior written permission.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Sentences that speak of licences or use their words without being one. Fixed values.
OTHERS = (
    "He lost his driving license after the third speeding ticket of the year.",
    "The version of the report that the public saw was released under pressure.",
    "The university granted permission for the work without any conditions.",
    "Her free software talk was about the general problems of source control.",
    "The apache helicopter was seen over the city in the morning.",
    "Copies of the notice were distributed to any person in the building.",
)


def runs_of(text: bytes | None) -> list[tuple[int, list[bytes]]]:
    """(paragraph, words) of every run of a text."""
    out = []
    for number, paragraph in enumerate((text or b"").split(b"\n")):
        words = words_of(paragraph)
        for at in range(0, max(len(words) - (RUN - STEP), 1), STEP) if len(words) > RUN else (0,):
            if words:
                out.append((number, words[at : at + RUN]))
    return out


class Vocabulary:
    """Numbers of the templates' words and of their neighbouring pairs."""

    def __init__(self) -> None:
        texts = [words_of(t.encode()) for family in TEMPLATES.values() for t in family]
        self.words = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
        n = len(self.words) + 1
        self.pairs = np.zeros((n, n), np.int32)
        found = sorted({(self.words[a], self.words[b]) for t in texts for a, b in zip(t, t[1:], strict=False)})
        for k, (a, b) in enumerate(found):
            self.pairs[a, b] = n + k
        self.size = n + len(found)
        self.templates = {f: [(t, self._pairs(words_of(t.encode()))) for t in family] for f, family in TEMPLATES.items()}

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.words.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def _pairs(self, words: list[bytes]) -> frozenset[int]:
        ids = self.ids(words)
        found = self.pairs[ids[:-1], ids[1:]]
        return frozenset(found[found > 0].tolist())

    def row(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids(words)
        both = np.concatenate((ids, self.pairs[ids[:-1], ids[1:]]))
        features, found = np.unique(both[both > 0], return_counts=True)
        return features, found / np.sqrt(max(len(words), 1))

    def closest(self, words: list[bytes], family: str) -> tuple[float, str]:
        """The template of which most pairs stand in the run, and that share."""
        here = self._pairs(words)
        return max((len(here & pairs) / max(min(len(pairs), max(len(words) - 1, 1)), 1), template) for template, pairs in self.templates[family])


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the first is the unknown class
    weights: np.ndarray
    temperature: float
    least: float


def _altered(words: list[bytes], draw: np.random.Generator, filler: list[bytes]) -> list[bytes]:
    """A copy with some words lost, some replaced, and other words around it."""
    kept = [w if draw.random() > 0.05 else filler[draw.integers(len(filler))] for w in words if draw.random() > 0.05]
    before, after = draw.integers(0, 12, 2)
    pick = lambda n: [filler[k] for k in draw.integers(0, len(filler), n)]
    return pick(before) + kept + pick(after)


def fit(docs: DataFrame, max_documents: int = 1500, copies: int = 40) -> Model:
    """``max_documents`` bounds, about, the documents whose paragraphs train the
    unknown class; they are chosen by a hash of the text. Paragraphs that match
    a template count as its family."""
    n = docs.count()
    share = min(1.0, max_documents / max(n, 1))
    taken = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("text").dropDuplicates()

    def make() -> Step:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [b" ".join(words) for text in utf8(batch.column("text")) for _, words in runs_of(text)[:: max(1, len(runs_of(text)) // 32)]]
            return pa.record_batch([pa.array(found, pa.binary())], names=["run"])

        return step

    background = sorted({bytes(r[0]) for r in map_batches(taken, make, "run binary").collect()})
    vocabulary, draw = Vocabulary(), np.random.default_rng(7)
    families = (UNKNOWN, *TEMPLATES)
    plain = [run.split() for run in background] + [words_of(t.encode()) for t in OTHERS]
    filler = sorted({w for run in plain for w in run[:20]})[:20_000] or [b"a"]
    examples: list[tuple[list[bytes], int]] = []
    for words in plain:
        similar, family = max((vocabulary.closest(words, f)[0], f) for f in TEMPLATES)
        examples.append((words, families.index(family) if similar >= SIMILAR and len(words) > 3 else 0))
    for k, family in enumerate(TEMPLATES, 1):
        for template in TEMPLATES[family]:
            words = words_of(template.encode())
            examples += [(words, k)] * 3 + [(_altered(words, draw, filler), k) for _ in range(copies)]
    order = draw.permutation(len(examples))
    rows = [vocabulary.row(examples[k][0]) for k in order]
    labels = np.array([examples[k][1] for k in order])
    held = np.arange(len(rows)) % 5 == 4
    kept = np.flatnonzero(~held)
    weights = ftrl([rows[k] for k in kept], labels[kept], len(families), alpha=1.0, rounds=6, dimensions=vocabulary.size)
    logits = np.array([x @ weights[f] + weights[-1] for f, x in (rows[k] for k in np.flatnonzero(held))])
    temperature = calibrated(logits, labels[held])
    p = softmax(logits / temperature)
    # the least probability that lets one in a thousand unknown runs pass, at least even odds
    unknown = np.sort(p[labels[held] == 0, 1:].max(axis=1)) if (labels[held] == 0).any() else np.zeros(1)
    least = float(np.clip(unknown[-1 - len(unknown) // 1000], 0.5, 0.9))
    return Model(families, weights, temperature, least)


HIT = "struct<paragraph:int,family:string,probability:double,template:string,similarity:double>"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_runs and hits: the confirmed licences of every document."""

    def make() -> Step:
        vocabulary = Vocabulary()
        words_w = model.weights[:-1]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hits = [], []
            for text in utf8(batch.column("text")):
                runs = runs_of(text)
                counts.append(len(runs))
                hits.append(_hits(runs, vocabulary, words_w, model))
            kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("template", pa.string()), ("similarity", pa.float64())]))
            return pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hits, kind)], names=["doc_id", "n_runs", "hits"])

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, f"doc_id long, n_runs long, hits array<{HIT}>")


def _hits(runs: list[tuple[int, list[bytes]]], vocabulary: Vocabulary, weights: np.ndarray, model: Model) -> list[dict]:
    if not runs:
        return []
    sizes = np.array([len(w) for _, w in runs])
    ids = vocabulary.ids([w for _, words in runs for w in words])
    starts = np.cumsum(sizes) - sizes
    pairs = vocabulary.pairs[ids, np.append(ids[1:], 0)]
    pairs[starts[1:] - 1] = 0  # a pair lies within a run
    # the sums over a run of its words' and pairs' weights
    summed = np.add.reduceat(np.where(ids[:, None] > 0, weights[ids], 0) + np.where(pairs[:, None] > 0, weights[pairs], 0), starts, axis=0)
    p = softmax((summed / np.sqrt(sizes)[:, None] + model.weights[-1]) / model.temperature)
    out = []
    for at in np.flatnonzero(p[:, 1:].max(axis=1) >= model.least).tolist():
        family = int(p[at, 1:].argmax()) + 1
        similar, template = vocabulary.closest(runs[at][1], model.families[family])
        if similar >= SIMILAR:
            out.append({"paragraph": runs[at][0], "family": model.families[family], "probability": float(p[at, family]), "template": template, "similarity": similar})
    return out


def digest(scanned: DataFrame) -> DataFrame:
    families = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["family"])))
    return scanned.select(
        "doc_id", "n_runs", F.size("hits").cast("long").alias("n_hits"), F.array_join(families, ",").alias("families"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["probability"])), F.lit(0.0)).alias("probability"),
    )
