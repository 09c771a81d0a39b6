"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies.

Texts are runs of five lower-case words (letters, digits and underscores). Templates are put
into classes by their number of shingles; class L holds those with more than L / 2 and up to
L. Texts are cut into blocks of L shingles, and two neighbouring blocks are a window, so that
an occurrence of a template lies in some window whole. A band is one MinHash value. The number
of bands of a class is the least at which a window that holds the least share of its
templates meets them with the target probability, whatever else the window holds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundspark.llm.texts import WordHashes, mixed, pieces, shingle_hashes, word_hashes

#: Notices as their licenses word them.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
CONTAINMENT = 0.8
PROBABILITY = 0.9999
#: Templates are sent to every task: so many characters at most.
MAX_TEMPLATE_CHARS = 16_000_000
_WORD = re.compile(r"\w+")
_SEED = 20_240_611


def shingles(text: str, known: WordHashes) -> np.ndarray:
    return shingle_hashes(word_hashes(_WORD.findall(text.lower()), known))


def size_class(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def bands_needed(sizes: Sequence[int], block: int, containment: float, probability: float) -> int:
    """Bands of one value each, for the template that is hardest to meet in a window of two blocks."""
    most = 0
    for n in sizes:
        held = math.ceil(containment * n - 1e-9)
        jaccard = held / (2 * block + n - held)
        most = max(most, math.ceil(math.log(1 - probability) / math.log(1 - jaccard)))
    return most


class Templates:
    """Templates by class, with their MinHash values and exact shingle sets."""

    def __init__(self, rows: Sequence[tuple[str, str]], containment: float, probability: float):
        known = WordHashes()
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []
        self.classes: dict[int, list[int]] = {}
        for name, text in rows:
            found = np.unique(shingles(text or "", known))
            if len(found):
                self.classes.setdefault(size_class(len(found)), []).append(len(self.sets))
                self.names.append(name)
                self.sets.append(found)
        self.containment = containment
        self.bands = {
            block: bands_needed([len(self.sets[t]) for t in members], block, containment, probability)
            for block, members in self.classes.items()
        }
        draw = np.random.default_rng(_SEED)
        n = max(self.bands.values(), default=0)
        self.flip = draw.integers(0, 1 << 32, n, dtype=np.uint32)
        self.scale = draw.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def values(self, hashes: np.ndarray, band: int) -> np.ndarray:
        return (hashes ^ self.flip[band]) * self.scale[band]


def _short(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(32)).astype(np.uint32)


def candidates(texts: list[np.ndarray], templates: Templates) -> Iterator[tuple[int, int, int, int]]:
    """(text, template, first, end): windows of shingles that meet a template in some band."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return
    hashes = _short(np.concatenate(texts))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    blocks = {}
    for block in templates.classes:
        count = -(-sizes // block)
        owner = np.repeat(np.arange(len(texts)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        last = np.r_[owner[1:] != owner[:-1], True]
        blocks[block] = (begins[owner] + number * block, owner, number, last)
    met: dict[int, set[tuple[int, int]]] = {block: set() for block in templates.classes}
    for band in range(len(templates.flip)):
        values = templates.values(hashes, band)
        for block, members in templates.classes.items():
            if band >= templates.bands[block]:
                continue
            starts, _, _, last = blocks[block]
            lows = np.minimum.reduceat(values, starts) if block > 1 else values
            following = np.r_[lows[1:], lows[-1:]]
            window = np.where(last, lows, np.minimum(lows, following))
            own = {t: templates.values(_short(templates.sets[t]), band).min() for t in members}
            hot = np.zeros(1 << 16, dtype=bool)
            hot[[int(v) >> 16 for v in own.values()]] = True
            likely = np.flatnonzero(hot[window >> np.uint32(16)])
            for t, value in own.items():
                met[block].update((int(w), t) for w in likely[window[likely] == value])
    for block, pairs in met.items():
        _, owner, number, _ = blocks[block]
        for w, t in sorted(pairs):
            first = int(number[w]) * block
            yield int(owner[w]), t, first, min(first + 2 * block, int(sizes[owner[w]]))


def verified(texts: list[np.ndarray], templates: Templates) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, template, containment, first, end) of windows that hold enough of a template, exactly.

    The span is that of the template's shingles. Spans of one template that overlap are one
    match with the higher containment.
    """
    found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for text, t, first, end in candidates(texts, templates):
        wanted = templates.sets[t]
        at = np.minimum(np.searchsorted(wanted, texts[text][first:end]), len(wanted) - 1)
        hit = wanted[at] == texts[text][first:end]
        share = len(np.unique(at[hit])) / len(wanted)
        if share >= templates.containment:
            places = np.flatnonzero(hit)
            found.setdefault((text, t), []).append((first + int(places[0]), first + int(places[-1]) + 1, share))
    for (text, t), spans in sorted(found.items()):
        first, end, share = min(spans)
        for a, b, s in sorted(spans)[1:]:
            if a < end:
                end, share = max(end, b), max(share, s)
            else:
                yield text, t, share, first, end
                first, end, share = a, b, s
        yield text, t, share, first, end


MATCHES = "doc_id bigint, license string, template int, containment double, first_word bigint, n_words bigint"


def scan(
    docs: DataFrame,
    templates: DataFrame,
    containment: float = CONTAINMENT,
    probability: float = PROBABILITY,
) -> DataFrame:
    """One row per match of a template (``license``, ``text``) in ``docs`` (``doc_id``, ``text``).

    ``template`` is the row of the template in order of license and text, ``first_word`` where
    its shingles begin. Matches of different templates may overlap. Texts of fewer than five
    words are a single shingle; NULL texts and templates without words match nothing, a NULL
    doc_id is kept, and repeated rows each have their matches. Other columns are ignored.
    """
    size = templates.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if size > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates of {size} characters are too many to send to every task")
    rows = [(r.license, r.text) for r in templates.select("license", "text").orderBy("license", "text").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(Templates(rows, containment, probability))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = WordHashes(), shared.value
        for part, texts in pieces(batches):
            keys = part.column("doc_id").to_pylist()
            hashed = [shingles(t, known) for t in texts]
            lengths = [len(_WORD.findall(t)) if 0 < len(h) < 2 else len(h) + 4 for t, h in zip(texts, hashed)]
            out = [
                (keys[d], held.names[t], t, share, first, min(end - first + 4, lengths[d]))
                for d, t, share, first, end in verified(hashed, held)
            ]
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "license", "template", "containment", "first_word", "n_words"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, MATCHES)
