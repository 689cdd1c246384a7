"""License notices in documents: MinHash bands over windows retrieve templates, exact containment verifies them.

A text's five-word shingles are cut into overlapping windows: for templates of
up to n shingles (with room for insertions) windows of 2c shingles in steps of c,
c >= 1.25 n, so that some window holds a whole notice. Every MinHash value is a
band of its own (one row per band): a window that holds four fifths of a template
of n shingles is at least 0.8 n / (2 c + 0.2 n), over 0.15, similar to it, and
misses all of the 64 bands with probability below 3e-5; for a verbatim notice it
is below 1e-5. Retrieved templates are verified by the exact share of their
shingles in the window.

Templates are a stated set of bounded size that every task holds; each needs five
words. They are whole license texts (``license_texts/``), the headers that go with
them and short notices. Texts share passages, so a hit whose places are nearly all
held by better hits of other templates is none: a text of BSD-3-Clause holds all of
BSD-2-Clause, and is not reported as that. Null and short texts hold no notice. Repeated documents are separate rows.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tradeloom.llm.common import small_batches
from tradeloom.llm.words import SHINGLE, WordHashes, hashed, mixed, rolled, words

BANDS = 64
CONTAINED = 0.8
ROOM = 1.25
#: Slots of the table that rules most values out before the exact look-up.
SLOTS = 1 << 22
#: Shingles hashed at once; a multiple of every window step below it.
PIECE = 1 << 16

# Notices by which works state their license.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain"),
)

# Headers of files under licenses whose texts are in ``license_texts``.
GNU = (
    "This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT "
    "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
)
GNU_NAMES = (
    ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"),
    ("LGPL-2.0", "GNU Library General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
)
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    *((name, GNU.format(work=work, name=text, version=version)) for name, text, version in GNU_NAMES for work in ("program", "library")),
)
# What works call their license; each name makes the notices of ``notices``.
NAMES = (
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("Unlicense", "Unlicense License"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache 2.0 License"), ("Apache-2.0", "Apache-2.0 License"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "2-Clause BSD License"), ("BSD-2-Clause", "Simplified BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "3-Clause BSD License"), ("BSD-3-Clause", "New BSD License"), ("BSD-3-Clause", "Modified BSD License"),
    *((f"{short}-{v}.0", form.format(v=v)) for short, long, v in (("GPL", "GNU General Public License", 2), ("GPL", "GNU General Public License", 3), ("AGPL", "GNU Affero General Public License", 3), ("LGPL", "GNU Lesser General Public License", 3))
      for form in (long + ", version {v}", long + " v{v}", long + " v{v}.0", "GNU " + short + " version {v}", "GNU " + short + " v{v}", short + " version {v}", short + " v{v}", short + "v{v} License", short + "-{v}.0 License")),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"), ("LGPL-2.1", "GNU LGPL version 2.1"), ("LGPL-2.1", "LGPL v2.1"), ("LGPL-2.1", "LGPL-2.1 License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "MPL 2.0"), ("MPL-1.1", "Mozilla Public License, version 1.1"),
    ("GFDL-1.3", "GNU Free Documentation License, version 1.3"), ("GFDL-1.2", "GNU Free Documentation License, version 1.2"),
    ("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "CC0 1.0 Universal"),
    *((f"CC-{code}-{v}", f"CC {code} {v}") for code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("4.0", "3.0")),
    *((f"CC-{code}-{v}", f"Creative Commons {long} {v} {kind} License") for code, long in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ) for v, kind in (("4.0", "International"), ("3.0", "Unported"))),
)
VERBS = ("licensed", "released", "distributed", "available", "published", "provided")
TEXTS = Path(__file__).parent / "license_texts"


def notices(name: str, called: str) -> list[tuple[str, str]]:
    """Short notices of at least five words with what a license is called, and its SPDX line."""
    forms = [f"{verb} under {the}{called}" for verb in VERBS for the in ("the ", "", "a ")] + [f"under the terms of the {called}", f"SPDX-License-Identifier: {name}"]
    return [(name, f) for f in forms if len(words(f)) >= SHINGLE]


def all_templates() -> tuple[tuple[str, str], ...]:
    """Notices, headers, notices by name, and whole texts; of templates with the same words, the first."""
    whole = [(path.stem, path.read_text()) for path in sorted(TEXTS.glob("*.txt"))]
    out: dict[tuple[str, ...], tuple[str, str]] = {}
    for name, text in [*NOTICES, *HEADERS, *(n for called in NAMES for n in notices(*called)), *whole]:
        out.setdefault(tuple(words(text)), (name, text))
    return tuple(out.values())


TEMPLATES = all_templates()


class Library:
    """Templates with their shingles, and their MinHash values by window size."""

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        table = WordHashes()
        self.names = [name for name, _ in templates]
        self.shingles, self.steps = [], []
        for name, text in templates:
            tokens = words(text)
            if len(tokens) < SHINGLE:
                raise ValueError(f"the template {name} has fewer than {SHINGLE} words")
            s = np.unique(rolled(hashed(tokens, table), SHINGLE))
            self.shingles.append(s)
            self.steps.append(1 << int(np.ceil(np.log2(max(2, ROOM * len(s))))))
        seeds = mixed(np.arange(1, 2 * BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.factors, self.shifts = (seeds[:BANDS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[BANDS:] >> np.uint64(32)).astype(np.uint32)
        self.levels: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.slots: dict[int, np.ndarray] = {}
        for step in sorted(set(self.steps)):
            own = [t for t, s in enumerate(self.steps) if s == step]
            self.slots[step], self.levels[step] = np.zeros(SLOTS, bool), []
            low = low_bits(np.concatenate([self.shingles[t] for t in own]))
            begins = np.concatenate([[0], np.cumsum([len(self.shingles[t]) for t in own])[:-1]])
            for band in range(BANDS):
                least = np.minimum.reduceat(self.values(low, band), begins)
                order = np.argsort(least, kind="stable")
                self.levels[step].append((least[order], np.array(own)[order]))
                self.slots[step][least & np.uint32(SLOTS - 1)] = True

    def values(self, x: np.ndarray, band: int) -> np.ndarray:
        v = x * self.factors[band] + self.shifts[band]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        return v

    def retrieved(self, shingles: np.ndarray) -> set[tuple[int, int]]:
        """(first shingle of a window, template) of every window that shares a band with a template."""
        out: set[tuple[int, int]] = set()
        last = max(self.levels, default=0)
        low = low_bits(shingles)
        for a in range(0, len(low), PIECE):
            # A piece ends one window step into the next, so that no window is cut.
            x = low[a : a + PIECE + last]
            for band in range(BANDS):
                v, step = self.values(x, band), 1
                while step < last:
                    if len(v) % 2:
                        v = np.append(v, np.uint32(0xFFFFFFFF))
                    v, step = np.minimum(v[0::2], v[1::2]), step * 2
                    if step in self.levels:
                        window = np.minimum(v[:-1], v[1:]) if len(v) > 1 else v
                        hit = np.flatnonzero(self.slots[step][window & np.uint32(SLOTS - 1)])
                        if len(hit):
                            known, templates = self.levels[step][band]
                            lo, hi = np.searchsorted(known, window[hit], "left"), np.searchsorted(known, window[hit], "right")
                            real = lo < hi
                            for h, p, q in zip(hit[real].tolist(), lo[real].tolist(), hi[real].tolist()):
                                out.update((a + h * step, int(t)) for t in templates[p:q])
        return out

    def verified(self, shingles: np.ndarray, starts: np.ndarray, found: set[tuple[int, int]]) -> set[tuple[int, int, int, int, float]]:
        """(document, template, first shingle, last shingle, share) of retrieved pairs that hold; ``starts``: each document's first shingle."""
        out = set()
        for at, t in found:
            window = shingles[at : at + 2 * self.steps[t]]
            place = at + np.flatnonzero(np.isin(window, self.shingles[t]))
            owner = np.searchsorted(starts, place, "right") - 1
            for doc in np.unique(owner).tolist():
                mine = place[owner == doc]
                share = len(np.unique(shingles[mine])) / len(self.shingles[t])
                if share >= CONTAINED:
                    first = int(starts[doc])
                    out.add((doc, t, int(mine[0]) - first, int(mine[-1]) - first, share))
        return out


    def best(self, hits: list[tuple[int, int, int, int, float]], shingles: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """``hits`` without those whose places better hits of other templates hold; better: more shingles found than missing."""
        owner: dict[int, int] = {}
        out = []
        for hit in sorted(hits, key=lambda h: (-(2 * h[4] - 1) * len(self.shingles[h[1]]), h[1], h[0], h[2])):
            doc, t, first, last, _ = hit
            at = int(starts[doc])
            place = (at + first + np.flatnonzero(np.isin(shingles[at + first : at + last + 1], self.shingles[t]))).tolist()
            if sum(owner.get(p, t) != t for p in place) < CONTAINED * len(place):
                out.append(hit)
                owner.update((p, t) for p in place if p not in owner)
        return sorted(out)


def low_bits(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, template, first_word, last_word, containment): every place of a notice in ``docs`` (doc_id, text).

    Overlapping windows that see the same notice whole give one row; one that sees only part of a place that another
    sees more of is left out.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "license", "template", "first_word", "last_word", "containment"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, library = WordHashes(), Library(templates)
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            each = [rolled(h, SHINGLE) if len(h := hashed(words(t), table)) >= SHINGLE else h[:0] for t in texts]
            starts = np.concatenate([[0], np.cumsum([len(s) for s in each])])
            held = [i for i, s in enumerate(each) if len(s)]
            if not held:
                continue
            shingles = np.concatenate([each[i] for i in held])
            hits = widest(library.verified(shingles, starts[held], library.retrieved(shingles)))
            rows = [(ids[held[d]], library.names[t], t, first, last + SHINGLE - 1, share) for d, t, first, last, share in library.best(hits, shingles, starts[held])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, template int, first_word long, last_word long, containment double")


def widest(hits: set[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Hits without those whose place lies inside another's for the same document and template."""
    out: list[tuple[int, int, int, int, float]] = []
    for hit in sorted(hits, key=lambda h: (h[0], h[1], h[2], -h[3])):
        if out and out[-1][:2] == hit[:2] and hit[3] <= out[-1][3]:
            continue
        out.append(hit)
    return out
