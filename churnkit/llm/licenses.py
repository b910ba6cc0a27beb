"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are grouped by length class. For a class of templates of up to m words, every text is cut into
windows of 2 m words that start every m / 2 words or sooner, so each whole occurrence of a template
lies in some window. Each of BANDS hash
functions gives a window's smallest shingle hash (one row per band); a window that agrees with a
template in any band is retrieved. At Jaccard similarity s a template is missed with probability
(1 - s)^BANDS: at 0.2, the least an occurrence of CONTAINED can have, below 1 in 10^4. Templates of fewer
than TINY shingles would fall below that and are looked up shingle by shingle. Windows start at each text's
first shingle and hold nothing of other texts. In fact a retrieved
window must hold one of the template's own shingles, so false retrievals are rare too. Retrieved
pairs are verified exactly: the share of the template's distinct shingles that the window holds must
reach CONTAINED. Every disjoint occurrence is returned.

Templates are small (their number and lengths are parameters of the caller), texts are scanned
whole inside Spark tasks, and nothing is shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnkit.llm.tables import as_bytes, extended
from churnkit.llm.wordhash import byte_class, chunks, gram_hashes, mix64, word_hashes, word_spans

#: words of a shingle, least containment, bands (hash functions), step of the finest minima in words, shingles of the least banded template
SHINGLE, CONTAINED, BANDS, STEP, TINY = 5, 0.8, 48, 2, 3

#: words are runs of letters, digits and everything beyond ASCII
WORDS = byte_class(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

#: fixed values: public license notices, by name
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
           "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
           "and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                        "Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
                         "Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_SEEDS = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _shingles(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, shingles per text, word starts, word ends, words per text) of a batch."""
    data, starts, ends, counts = word_spans(raw, WORDS)
    grams, per_text = gram_hashes(word_hashes(data, starts, ends), counts, SHINGLE)
    return grams, per_text, starts, ends, counts


def _occurrences(at: np.ndarray, ids: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(distinct shingles, first, last place) of the disjoint occurrences in one window: the shortest stretch with
    most distinct shingles, then what is left of it and right of it."""
    most = len(np.unique(ids))
    if not most or most < least:
        return []
    seen: dict[int, int] = {}
    x, short = 0, (1 << 62, 0, 0)
    for y, t in enumerate(ids.tolist()):
        seen[t] = seen.get(t, 0) + 1
        while seen[int(ids[x])] > 1:
            seen[int(ids[x])] -= 1
            x += 1
        if len(seen) == most:
            short = min(short, (int(at[y] - at[x]), int(at[x]), int(at[y])))
    _, first, last = short
    left, right = at <= first - SHINGLE, at >= last + SHINGLE
    return _occurrences(at[left], ids[left], least) + [(most, first, last)] + _occurrences(at[right], ids[right], least)


class Templates:
    """Shingle sets of the templates, by length class, with the smallest hash of each band."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        raw = [texts[n].encode("utf-8") for n in self.names]
        grams, per_text, *_ = _shingles(raw)
        at = np.cumsum(per_text) - per_text
        self.sets = [np.unique(grams[a:a + n]) for a, n in zip(at.tolist(), per_text.tolist(), strict=True)]
        self.classes: dict[int, list[int]] = {}
        tiny = [(int(g), i) for i, s in enumerate(self.sets) if len(s) < TINY for g in s]
        self.tiny = np.array(sorted({g for g, _ in tiny}), dtype=np.uint64)
        self.tiny_of = [[i for h, i in tiny if h == g] for g in self.tiny.tolist()]
        for i, s in enumerate(self.sets):
            if len(s) >= TINY:
                self.classes.setdefault(max(4, 1 << (int(per_text[i]) - 1).bit_length()), []).append(i)
        # per class and band: sorted smallest hashes, and the template of each
        self.least = {}
        for size, own in self.classes.items():
            for b in range(BANDS):
                low = np.array([(self.sets[i] * _SEEDS[b]).min() for i in own], dtype=np.uint64)
                order = np.argsort(low)
                self.least[size, b] = low[order], np.array(own)[order]

    def retrieve(self, grams: np.ndarray, per_text: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(text, first shingle of a window in it, shingles of the window, template) of the windows that agree with a template in a band."""
        found: set[tuple[int, int, int, int]] = set()
        if not len(grams):
            return found
        first = np.cumsum(per_text) - per_text
        if len(self.tiny):
            at = np.minimum(np.searchsorted(self.tiny, grams), len(self.tiny) - 1)
            for g in np.flatnonzero(self.tiny[at] == grams).tolist():
                d = int(np.searchsorted(first, g, side="right")) - 1
                local = g - int(first[d])
                found.update((d, max(0, local - 4), 8, t) for t in self.tiny_of[int(at[g])])
        if not self.classes:
            return found
        # texts are laid out from whole blocks on, with as much room after each as the longest window takes
        unit = max(max(1, size // 2 // STEP) * STEP for size in self.classes)
        room = -(-(per_text + 2 * max(self.classes)) // unit) * unit
        begin = np.cumsum(room) - room
        place = np.repeat(begin - first, per_text) + np.arange(len(grams))
        laid = np.full(int(room.sum()), np.iinfo(np.uint64).max, dtype=np.uint64)
        cut = np.arange(0, len(laid), STEP)
        for b in range(BANDS):
            laid[place] = grams * _SEEDS[b]
            fine = np.minimum.reduceat(laid, cut)
            for size in sorted(self.classes):
                # minima of blocks of size / 2, and windows of four of them
                block = max(1, size // 2 // STEP)
                low = np.minimum.reduceat(fine, np.arange(0, len(fine), block)) if block > 1 else fine
                wide = low.copy()
                for k in (1, 2, 3):
                    wide[:len(low) - k] = np.minimum(wide[:len(low) - k], low[k:]) if len(low) > k else wide[:0]
                keys, which = self.least[size, b]
                at = np.searchsorted(keys, wide)
                at[at == len(keys)] = 0
                for w in np.flatnonzero(keys[at] == wide).tolist():
                    d = int(np.searchsorted(begin, w * block * STEP, side="right")) - 1
                    local = w * block * STEP - int(begin[d])
                    if local < per_text[d]:
                        found.update((d, local, 2 * size, t) for t in which[keys == wide[w]].tolist())
        return found

    def scan(self, raw: list[bytes]) -> list[list[tuple[str, int, int, float]]]:
        """For each text: (template, start byte, end byte, containment) of every disjoint occurrence, the best ones first taken."""
        grams, per_text, starts, ends, words = _shingles(raw)
        met: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        first_gram, first_word = np.cumsum(per_text) - per_text, np.cumsum(words) - words
        offset = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]]) if raw else []
        for d, a, width, t in self.retrieve(grams, per_text):
            own = grams[first_gram[d] + a:first_gram[d] + min(a + width, int(per_text[d]))]
            at = np.flatnonzero(np.isin(own, self.sets[t]))
            met.setdefault((d, t), set()).update(_occurrences(at + a, own[at], CONTAINED * len(self.sets[t])))
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in raw]
        for (d, t), stretches in met.items():
            taken: list[tuple[int, int]] = []
            for n, x, y in sorted(stretches, key=lambda s: (-s[0], s[2] - s[1], s[1])):
                k = bisect.bisect(taken, (x, y))
                if (k and taken[k - 1][1] + SHINGLE > x) or (k < len(taken) and y + SHINGLE > taken[k][0]):
                    continue
                taken.insert(k, (x, y))
                w0, w1 = int(first_word[d]) + x, int(first_word[d]) + min(y + SHINGLE, int(words[d])) - 1
                out[d].append((self.names[t], int(starts[w0] - offset[d]), int(ends[w1] - offset[d]), n / len(self.sets[t])))
        return [sorted(o) for o in out]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """`docs` plus licenses: array<struct<license, start, end, contained>>, by name of the license.

    For each template whose distinct SHINGLE-word shingles a window of the text holds to CONTAINED or more:
    the span (code points, end exclusive) from its first to its last shingle and the share held, for every
    disjoint occurrence. Words are lower-cased runs of letters, digits and characters beyond ASCII; a template of
    fewer than SHINGLE words is one shingle and is found only in texts that consist of it. Null and
    empty texts have none. A column named licenses is replaced; all other columns and rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))
    rows, kept, schema = extended(docs, "licenses array<struct<license:string,start:int,end:int,contained:double>>")
    at = kept.index(text)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("contained", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, out = as_bytes(batch.column(at)), []
            for i, j in chunks(raw, 1_000_000):
                for r, found in zip(raw[i:j], shared.value.scan(raw[i:j]), strict=True):
                    out.append([{"license": n, "start": len(r[:a].decode("utf-8", "replace")), "end": len(r[:z].decode("utf-8", "replace")), "contained": c} for n, a, z, c in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=kind)], names=[*kept, "licenses"])

    return rows.mapInArrow(run, schema)
