"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates and texts are read as streams of five-word shingles. Windows of a few
shingles slide over both, one shingle at a time. A window's signature holds the
minima of several hash functions; two minima make a band. Windows of a template
are filed under their bands, and each window of a text looks its own ones up.

The windows are short against the template, so that a template of which 80 % of
the shingles are in a text leaves whole windows there: with n shingles, edits
that spoil a fifth of them cannot break up all runs of n / 4 to n / 2 shingles.
An unbroken window has the same minima as the template's own and is found for
certain. A window with Jaccard similarity s to one of the template's is found
with probability 1 - (1 - s^2)^4 (0.98 at 0.8), and a template has many.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.llm.common import Numbers, packed, pieces, ragged, small_batches, unpacked

SHINGLE = 5  # words
MIN_CONTAINMENT = 0.8  # of a template's shingles
HASHES, ROWS = 8, 2  # minima of a signature, and of a band
SIEVE_BITS = 20
NUMBERED_AT_MOST = 150_000  # distinct words that a task remembers

WORDS = re.compile(r"\w+")

#: Notices as the licenses publish them, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    (
        "CC0-1.0",
        "the person who associated CC0 with this work has waived all copyright and related or neighboring rights to "
        "this work",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


class Template(NamedTuple):
    license: str
    shingles: frozenset[int]
    window: int  #: shingles of its windows
    offsets: dict[int, list[int]]  #: where each shingle stands in it


def window_of(n: int) -> int:
    """Shingles of the windows for a template of ``n`` shingles."""
    return 1 if n < 5 else 2 if n < 10 else 4 if n < 20 else 8


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def shingled(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of five words; of the stream's last four words, nothing."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Matcher:
    """The templates' bands, and the search for them in texts."""

    def __init__(self, templates: tuple[tuple[str, str], ...]) -> None:
        rng = np.random.default_rng(17)
        self.flip = rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
        self.turn = rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.numbers, self.hashes = Numbers(), np.zeros(0, np.uint64)
        self.templates: list[Template] = []
        self.files: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for name, text in templates:
            stream, _ = self._hashed([WORDS.findall(text.lower())])
            shingles = shingled(stream)
            if not len(shingles):
                raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
            window = window_of(len(shingles))
            for band, keys in enumerate(self._bands(shingles)[window]):
                for offset, key in enumerate(keys.tolist()):
                    self.files[window, band][key].append((len(self.templates), offset))
            offsets: dict[int, list[int]] = defaultdict(list)
            for offset, shingle in enumerate(shingles.tolist()):
                offsets[shingle].append(offset)
            self.templates.append(Template(name, frozenset(offsets), window, dict(offsets)))
        self.longest = max((len(t.shingles) for t in self.templates), default=0)
        self.sieves = {}
        for place, keys in self.files.items():
            self.sieves[place] = np.zeros(1 << SIEVE_BITS, bool)
            self.sieves[place][np.fromiter(keys, np.uint64) >> np.uint64(64 - SIEVE_BITS)] = True

    def _hashed(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > NUMBERED_AT_MOST:
            self.numbers, self.hashes = Numbers(), np.zeros(0, np.uint64)
        ids, sizes = ragged([list(map(self.numbers.__getitem__, words)) for words in texts])
        fresh = np.array([word_hash(w) for w in self.numbers.take()], np.uint64)
        self.hashes = np.concatenate([self.hashes, fresh])
        return self.hashes[ids], sizes

    def _bands(self, shingles: np.ndarray) -> dict[int, list[np.ndarray]]:
        """Band keys of the windows that begin at each shingle, by the windows' length."""
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        minima = [(short ^ flip) * turn for flip, turn in zip(self.flip, self.turn, strict=True)]
        out, width = {}, 1
        while True:
            keys = []
            for row in range(0, HASHES, ROWS):
                key = np.zeros(len(minima[0]), np.uint64)
                for m in minima[row : row + ROWS]:
                    key = (key ^ m) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                keys.append(key * np.uint64(0x9E3779B97F4A7C15))
            out[width] = keys
            if width == 8 or len(minima[0]) <= width:
                return out
            minima = [np.minimum(m[:-width], m[width:]) for m in minima]
            width *= 2

    def search(self, texts: list[list[str]]) -> list[list[tuple[str, int, int, float]]]:
        """Per text its matches: license, first word, end word, containment; by place."""
        stream, sizes = self._hashed(texts)
        shingles = shingled(stream)
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        begins = np.cumsum(sizes) - sizes
        if len(shingles):
            for width, keys in self._bands(shingles).items():
                for band, values in enumerate(keys):
                    filed = self.files.get((width, band))
                    if filed:
                        passed = np.flatnonzero(self.sieves[width, band][values >> np.uint64(64 - SIEVE_BITS)])
                        for place, key in zip(passed.tolist(), values[passed].tolist(), strict=True):
                            for template, offset in filed.get(key, ()):
                                text = int(np.searchsorted(begins, place, side="right")) - 1
                                found[text, template].add(place - int(begins[text]) - offset)
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        for (text, template), starts in found.items():
            own = shingles[begins[text] : max(begins[text], begins[text] + sizes[text] - SHINGLE + 1)]
            out[text] += self._verify(self.templates[template], own, sorted(starts))
        return [_longest(rows) for rows in out]

    def _verify(self, template: Template, own: np.ndarray, starts: list[int]) -> list[tuple[str, int, int, float]]:
        """Matches around supposed starts of the template in a text's shingles.

        A window begins after the match before it. A match ends with the
        shingles that stand about where this start puts them: what is beyond
        belongs to another copy.
        """
        n = len(template.shingles)
        slack, done, out = n // 4, 0, []
        for start in starts:
            low, high = max(done, start - slack), min(len(own), start + n + slack)
            if high - low < MIN_CONTAINMENT * n:
                continue
            places = [i for i, s in enumerate(own[low:high].tolist(), low) if s in template.shingles]
            share = len({int(own[i]) for i in places}) / n
            if share >= MIN_CONTAINMENT:
                here = [i for i in places if any(abs(i - at - start) <= slack for at in template.offsets[int(own[i])])]
                if here:
                    one = places[places.index(here[0]) : places.index(here[-1]) + 1]
                    part = len({int(own[i]) for i in one}) / n
                    if part >= MIN_CONTAINMENT:
                        places, share = one, part
                out.append((template.license, places[0], places[-1] + SHINGLE, share))
                done = places[-1] + 1
        return out


def _longest(rows: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Matches that do not lie inside a longer one, or in an equal span that is contained better or sorts first."""
    kept: list[tuple[str, int, int, float]] = []
    for row in sorted(set(rows), key=lambda r: (r[1] - r[2], -r[3], r[0])):
        if not any(k[1] <= row[1] and row[2] <= k[2] for k in kept):
            kept.append(row)
    return sorted(kept, key=lambda r: (r[1], r[2], r[0]))


def scan_licenses(
    docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES
) -> DataFrame:
    """``docs`` with ``licenses``: an array of (license, start, end, containment), by place.

    Whole texts. ``start`` and ``end`` (exclusive) count words, which are runs
    of letters, digits and underscores, compared without case. A match holds at
    least 80 % of a template's five-word shingles; of matches inside each other
    the longest is given. Null and empty texts have none; equal texts have equal
    ones; nothing is shuffled. Texts of any length are read whole, all copies of
    a notice in them are given; no rows, no result. Of matches that tie the
    first template's is given. A column ``licenses`` is replaced. The templates go
    to the tasks with the function: keep them to some thousands.
    """
    names = ["license", "start", "end", "containment"]
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(templates)
        for batch in batches:
            out = []
            for part in pieces(pd.DataFrame({"text": batch.fillna("")})):
                hits = matcher.search([WORDS.findall(t.lower()) for t in part["text"]])
                out += [[dict(zip(names, hit, strict=True)) for hit in row] for row in hits]
            yield pd.Series(out, dtype=object)

    kind = "array<struct<license:string,start:bigint,end:bigint,containment:double>>"
    scanned = F.pandas_udf(scan, kind).asNondeterministic()
    body: Column = F.col(f"row.`{text}`").cast("string")
    return unpacked(packed(docs).withColumn("found", scanned(body)), licenses=F.col("found"))


def license_rows(docs: DataFrame) -> DataFrame:
    """One row per document and match."""
    found = scan_licenses(docs.select("doc_id", "text")).where(F.size("licenses") > 0)
    rows = found.select("doc_id", F.explode("licenses").alias("m"))
    return rows.select(
        "doc_id", "m.license", F.col("m.start").alias("start_word"), F.col("m.end").alias("end_word"),
        F.round("m.containment", 6).alias("containment"),
    )
