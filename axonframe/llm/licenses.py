"""License notices in texts, by MinHash over overlapping windows.

Templates and texts are word sequences (letters and digits, lower case) and sets of
five-word shingles. For each template size in shingles, texts are cut into windows of that
size and a quarter more that overlap by the size, so that every passage of the size lies
whole in one. A window that holds four fifths of a template's shingles has a Jaccard
similarity of at least 0.53 with it (0.4 for the sizes below four, where a quarter is one
whole shingle); with one hash a band and 24 bands the two share a band with a probability
above 0.99999. What the bands retrieve is verified by exact containment of the template's
shingles, and reported with the span that holds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, text_of

# Public license notices, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["has waived all copyright and related or neighboring rights to this work"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited."],
}
#: Notices with fewer than five words, and SPDX lines.
SHORT: dict[str, list[str]] = {
    "All-rights-reserved": ["All rights reserved."],
    **{
        name: [f"SPDX-License-Identifier: {i}" for i in ids.split()]
        for name, ids in {
            "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3.0", "GPL-2.0": "GPL-2.0", "LGPL": "LGPL-2.0 LGPL-2.1 LGPL-3.0", "AGPL-3.0": "AGPL-3.0",
            "BSD": "BSD-2-Clause BSD-3-Clause", "MPL-2.0": "MPL-2.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0",
            "CC0-1.0": "CC0-1.0", "ISC": "ISC", "Unlicense": "Unlicense",
        }.items()
    },
}
ALL = {name: TEMPLATES.get(name, []) + SHORT.get(name, []) for name in {**TEMPLATES, **SHORT}}
SHINGLE, BANDS, CONTAINMENT = 5, 24, 0.8

_WORD = re.compile(r"[^\W_]+")
#: Kinds of bytes: letters and digits make words; bytes above ASCII count as letters.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, as far as a text needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]))
        return self.up, self.down


_POWERS = Powers()


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of a text's bytes."""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.concatenate([[False], _INSIDE[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _POWERS.upto(len(b) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[b] + np.uint64(1)) * up[: len(b)])])
        return start, end, _mixed((sums[end] - sums[start]) * down[start], 1)


def shingles_of(words: np.ndarray) -> np.ndarray:
    """Hashes of five-word shingles; fewer words: one shingle of all."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < SHINGLE:
            return _mixed(np.array([(words * _POWERS.upto(8)[0][1 : len(words) + 1]).sum()], dtype=np.uint64), 2)
        n = len(words) - SHINGLE + 1
        total = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            total += words[k : k + n] * _POWERS.upto(8)[0][k + 1]
        return _mixed(total, 3)


def windows_of(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, fewer than five, as ``shingles_of`` a text of them."""
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total += words[i : i + n] * _POWERS.upto(8)[0][i + 1]
        return _mixed(total, 2)


#: Odd factors: band h orders shingles by their hash times the h-th, modulo 2^64.
_FACTORS = _mixed(np.arange(BANDS, dtype=np.uint64), 100) | np.uint64(1)


class Scanner:
    """Templates by size, with their minhashes."""

    def __init__(self, templates: dict[str, list[str]]):
        self.templates: list[tuple[str, np.ndarray]] = []
        #: By template: the window of its size and the stride of such windows.
        self.window: list[tuple[int, int]] = []
        #: Of fewer than five words: names by the hash of all words, by their number.
        self.short: dict[int, dict[int, list[str]]] = {}
        for name, texts in templates.items():
            for text in texts:
                words = words_of(text.encode())[2]
                if not len(words):
                    raise ValueError(f"a template of {name} has no words")
                if len(words) < SHINGLE:
                    self.short.setdefault(len(words), {}).setdefault(int(shingles_of(words)[0]), []).append(name)
                    continue
                size = len(words) - SHINGLE + 1
                stride = max(1, size // 4)
                self.templates.append((name, np.unique(shingles_of(words))))
                self.window.append((size + stride, stride))
        #: By band: the templates' minima, and a table of the leading 16 bits that occur.
        self.minima = np.array([[(own * f).min() for _, own in self.templates] for f in _FACTORS], dtype=np.uint64)
        self.leading = np.zeros((BANDS, 1 << 16), dtype=bool)
        for h in range(BANDS):
            self.leading[h, self.minima[h] >> np.uint64(48)] = True

    def candidates(self, shingles: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, end shingle) of windows that share a band. A window
        shares one only where a shingle has a template's minimum: there it is formed."""
        out: set[tuple[int, int, int]] = set()
        for h in range(BANDS):
            ordered = shingles * _FACTORS[h]
            for p in np.flatnonzero(self.leading[h][ordered >> np.uint64(48)]):
                for t in np.flatnonzero(self.minima[h] == ordered[p]):
                    window, stride = self.window[t]
                    last = p // stride * stride
                    for first in range(max(0, last - (window - 1) // stride * stride), last + 1, stride):
                        end = min(first + window, len(ordered))
                        if first <= p < end and ordered[first:end].min() == ordered[p]:
                            out.add((int(t), int(first), int(end)))
        return out

    def __call__(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """For each text (license, start, end, containment) of its notices, in characters;
        of notices of one license that overlap, the one with the most shingles."""
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
        start, end, words = words_of(b"\n".join(raws))
        owner = np.searchsorted(begins, start, side="right") - 1
        found: list[list] = [[] for _ in texts]
        for k, names in self.short.items():
            whole = windows_of(words, k)
            for p in np.flatnonzero(np.isin(whole, np.array(list(names), dtype=np.uint64))):
                if (d := owner[p]) == owner[p + k - 1]:
                    found[d] += [(0, name, int(start[p] - begins[d]), int(end[p + k - 1] - begins[d]), 1.0) for name in names[int(whole[p])]]
        shingles = shingles_of(words) if len(words) >= SHINGLE else words[:0]
        across = np.flatnonzero(owner[: len(shingles)] != owner[SHINGLE - 1 :][: len(shingles)])
        shingles[across] = _mixed(across.astype(np.uint64), 4)  # of two texts: like no other
        for t, a, b in self.candidates(shingles) if self.templates else ():
            name, own = self.templates[t]
            held = a + np.flatnonzero(np.isin(shingles[a:b], own))
            for d in np.unique(owner[held]):  # a window may reach into the next text
                mine = held[owner[held] == d]
                share = len(np.unique(shingles[mine])) / len(own)
                if share >= CONTAINMENT:
                    found[d].append((len(mine), name, int(start[mine[0]] - begins[d]), int(end[mine[-1] + SHINGLE - 1] - begins[d]), share))
        out = []
        for text, raw, hits in zip(texts, raws, found):
            kept: list[tuple[str, int, int, float]] = []
            for _, name, a, b, share in sorted(hits, key=lambda x: (-x[0], -x[4], x[1], x[2])):
                if not any(k[0] == name and a < k[2] and k[1] < b for k in kept):
                    kept.append((name, a, b, share))
            if kept and not text.isascii():
                kept = [(n, *(len(raw[:x].decode("utf-8", "surrogatepass")) for x in (a, b)), s) for n, a, b, s in kept]
            out.append(sorted(kept, key=lambda k: (k[1], k[0])))
        return out


def _scanned(templates: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(templates)
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                texts = list(map(text_of, batch.column(1).slice(at, 256).to_pylist()))
                rows += [(doc, *hit) for doc, hits in zip(ids[at : at + 256], scan(texts)) for hit in hits]
            doc, name, start, end, share = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(name, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(share, pa.float64())],
                ["doc_id", "license", "start", "end", "containment"],
            )

    return run


def notices(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each license notice in ``docs`` (doc_id, text): doc_id, license, start,
    end (characters), containment (share of the template's shingles held, at least 0.8).

    Null or empty text: no notices. Null doc_id: kept as null. Repeated rows: their notices
    once for each. Notices of one license that overlap: the one that holds the most
    shingles; ties to the earlier. ``templates`` of fewer than five words are found word for
    word (default: TEMPLATES, which has none; ALL has them too). Very long texts: read whole. Empty table: no rows. Other
    columns: ignored. It is one map over the scan: no shuffle."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(released(_scanned(templates or TEMPLATES)), "doc_id long, license string, start long, end long, containment double")
