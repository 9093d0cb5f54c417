"""License scans: MinHash bands over overlapping word windows retrieve templates, exact shingle
containment verifies them.

A template of n words belongs to the class c, the power of two from n on (8 at least). A text is
seen through windows of 2c words at every c/2 words, so any run of 3c/2 words lies whole in one.
From a template at the scan's containment in such a window follows a least Jaccard similarity j;
bands of one value collide with chance j each, so MISS fixes the number of bands of a class, for any
containment. Windows without any shingle of a class's templates cannot collide and are passed over.

The built-in templates are short notices and openings, and whole texts, named with a final "-text".
"""

from __future__ import annotations

import math
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import WORDS, _MULTIPLIERS, chunks, shingle_sequence, word_hashes

CONTAINMENT = 0.8
#: Chance that a window at the threshold collides in no band, at most.
MISS = 1e-6
#: Templates that are sent to the tasks at one time; more are taken in blocks, each against all rows.
BLOCK = 10_000

#: Folder of whole licence texts, read by the driver only.
TEXTS = Path(__file__).parent / "licence_texts"

#: Public notices and the opening of public licence texts.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def bands(length_class: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands that keep the chance of a miss below ``miss`` for the shortest template of a class."""
    shortest = length_class // 2 + 1 if length_class > 8 else 1
    own = max(1, shortest - WORDS + 1)
    shared = math.ceil(containment * own)
    j = shared / (2 * length_class - WORDS + 1 + own - shared)
    return math.ceil(math.log(miss) / math.log(1 - j))


@cache
def multipliers(n: int) -> np.ndarray:
    """n different odd factors of hash functions; the first are those of the signatures."""
    more = np.random.default_rng(12).integers(1, 1 << 63, max(n - len(_MULTIPLIERS), 0), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.concatenate([_MULTIPLIERS, more])[:n]


def built_in() -> list[tuple[str, str]]:
    """The notices and openings, and the whole texts."""
    return [*TEMPLATES.items(), *((f"{p.stem}-text", p.read_text()) for p in sorted(TEXTS.glob("*.txt")))]


class Templates:
    def __init__(self, rows: list[tuple[str, str | None]], containment: float = CONTAINMENT):
        self.classes: dict[int, list[tuple[str, np.ndarray]]] = {}
        for name, text in sorted((n, t) for n, t in rows if t):
            words, _ = word_hashes([text.lower().encode("utf-8", "surrogatepass")])
            if len(words):
                length = max(8, 1 << (len(words) - 1).bit_length())
                self.classes.setdefault(length, []).append((name, np.unique(shingle_sequence(words))))
        self.containment = containment
        self.shingles = {c: np.unique(np.concatenate([s for _, s in held])) for c, held in self.classes.items()}
        self.functions = {c: multipliers(bands(c, containment)) for c in self.classes}
        self.tokens = {c: np.stack([self._least(s, c) for _, s in held]) for c, held in self.classes.items()}

    def _least(self, shingles: np.ndarray, length_class: int) -> np.ndarray:
        """MinHash tokens of a set, in parts of its shingles so that memory stays bounded."""
        out = np.full(len(self.functions[length_class]), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for a in range(0, len(shingles), 4096):
                np.minimum(out, (shingles[a : a + 4096, None] * self.functions[length_class]).min(0), out=out)
        return out

    def find(self, shingles: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, containment, first shingle, last shingle) of each occurrence in one text's shingle sequence."""
        if not len(shingles):
            return []
        found = []
        for length, held in self.classes.items():
            known = self.shingles[length]
            hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, shingles), len(known) - 1)] == shingles)
            if not len(hits):
                continue
            step, width = length // 2, 2 * length - WORDS + 1
            starts = np.unique(np.concatenate([np.maximum(hits // step - k, 0) for k in range(-(-width // step) + 1)])) * step
            spans: dict[str, list[tuple[int, int, float]]] = {}
            for a in starts[starts < len(shingles)]:
                window = shingles[a : a + width]
                token = self._least(window, length)
                for t in np.flatnonzero((self.tokens[length] == token).any(1)):
                    name, own = held[t]
                    at = np.flatnonzero(np.isin(window, own))
                    share = len(np.unique(window[at])) / len(own)
                    if share >= self.containment:
                        spans.setdefault(name, []).append((int(a + at[0]), int(a + at[-1]), share))
            for name, got in spans.items():
                own = next(o for n, o in held if n == name)
                got.sort()
                merged = [got[0]]
                for x, y, share in got[1:]:
                    if x > merged[-1][1]:
                        merged.append((x, y, share))
                    else:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], y), max(merged[-1][2], share))
                for first, last, share in merged:
                    found += [(name, *o) for o in self._apart(shingles, own, first, last) or [(share, first, last)]]
        return sorted(found, key=lambda f: (f[2], f[0]))

    def _apart(self, shingles: np.ndarray, own: np.ndarray, first: int, last: int) -> list[tuple[float, int, int]]:
        """Occurrences next to each other in one span: parted where more is between them than one may lack."""
        at = first + np.flatnonzero(np.isin(shingles[first : last + 1], own))
        gap = (1 - self.containment) * len(own) + WORDS
        parts = np.split(at, np.flatnonzero(np.diff(at) > gap) + 1)
        shares = [(len(np.unique(shingles[p])) / len(own), int(p[0]), int(p[-1])) for p in parts]
        return [s for s in shares if s[0] >= self.containment]


def scan(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", containment: float = CONTAINMENT) -> DataFrame:
    """One row per occurrence: key, template_id, containment, first_word, last_word (0-based, the last included).

    templates has (template_id, text); None takes the built-in ones. Null or blank texts, texts
    and templates without words match nothing. Repeated rows give repeated results. Empty tables:
    empty result. Only the key and ``text`` of docs are read.
    """
    if templates is None:
        blocks = [built_in()]
    else:
        named = templates.select(F.col("template_id").cast("string").alias("n"), "text").where("text is not null")
        n = max(1, -(-named.count() // BLOCK))
        blocks = [[(r["n"], r["text"]) for r in named.where(F.pmod(F.xxhash64("n"), F.lit(n)) == b).collect()] for b in range(n)]
    rows = docs.select(F.col(key).alias("_id"), "text")
    out = None
    for block in blocks:

        def run(batches, block=block):
            held = Templates(block, containment)
            for p in batches:
                got = []
                for first, _, blobs in chunks(p["text"].tolist()):
                    words, firsts = word_hashes(blobs)
                    for i, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
                        for name, share, x, y in held.find(shingle_sequence(words[a:b])):
                            got.append((p["_id"].iloc[first + i], name, share, x, min(y + WORDS - 1, int(b - a) - 1)))
                yield pd.DataFrame(got, columns=["_id", "template_id", "containment", "first_word", "last_word"])

        part = rows.mapInPandas(run, f"_id {dict(rows.dtypes)['_id']}, template_id string, containment double, first_word long, last_word long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("_id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
