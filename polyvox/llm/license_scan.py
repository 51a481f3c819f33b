"""License scans: exact set-similarity search of template texts in blocks of documents.

Base phrases are counted word by word. Beyond them, every document is cut into
overlapping blocks of words, and a block matches a template when it contains at
least `threshold` of the template's distinct words. Words of templates are ordered by
the number of documents that hold them, rarest first, and a block's words of these in the same order (others match
nothing). A block is looked at only if it holds one of a template's prefix words. It goes if it has too few words (length filter), if its
own prefix, which is all but its last words, has none of the template (prefix filter), or as soon as the places of a shared word in both
orders leave too few words behind it (positional filter). The templates are configuration, and their size is checked.

Of labels of one family that name versions (gpl-2.0, gpl-3.0) the best contained one counts where blocks overlap, and of equally
contained ones a template whose words include the other's. A short notice must hold all words of its label that it has: without its
number or letters it tells no version.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, slices
from .license_texts import TEXTS

#: Fixed phrases and labels of query op5.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Opening sentences of common licenses, by label.
OPENINGS = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: All templates: opening sentences, whole texts, and the notices that name a license.
TEMPLATES = (*OPENINGS, *TEXTS)
#: Largest templates, all together, that are shipped with every task.
MAX_TEMPLATE_BYTES = 8_000_000

THRESHOLD = 0.8
#: Templates of fewer words are short: a share of them says little about the few that tell versions apart.
SHORT = 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then runs of characters other than ASCII non-alphanumerics; bytes.lower touches ASCII only."""
    return WORD.findall((text or b"").lower())


def find_phrases(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> tuple[int, int | None, int | None, set[str]]:
    """Number of places, smallest and largest start, labels."""
    heads = {p[0] for p, _ in phrases}
    starts, labels, count = [], set(), 0
    for at, word in enumerate(words):
        if word in heads:
            for phrase, label in phrases:
                if words[at : at + len(phrase)] == phrase:
                    count += 1
                    starts.append(at)
                    labels.add(label)
    return count, min(starts, default=None), max(starts, default=None), labels


@dataclass(frozen=True)
class Template:
    """A template's distinct words as ranks in the global order, with their places in it, and what a block must hold of them."""

    label: str
    places: dict[int, int]
    need: int
    step: int
    must: frozenset[int]

    @property
    def family(self) -> str | None:
        """What labels that name versions share; None for a label that names none."""
        return self.label.split("-")[0] if any(c.isdigit() for c in self.label) else None


class Templates:
    """Templates with their words in one global order, and the words that open a look at a block.

    A template of L words is held against blocks of 2 L words, one every L words: any L words of a document are in one of them.
    `removed` counts the blocks that each filter has removed.
    """

    def __init__(self, templates, order: dict[bytes, int], threshold: float):
        texts = [(label, words_of(text.encode())) for label, text in templates]
        if sum(len(w) for _, words in texts for w in words) > MAX_TEMPLATE_BYTES:
            raise ValueError(f"the templates exceed {MAX_TEMPLATE_BYTES} bytes")
        vocabulary = sorted({w for _, words in texts for w in words}, key=lambda w: (order.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.items: list[Template] = []
        self.prefix: dict[bytes, list[int]] = {}
        self.removed: Counter[str] = Counter()
        for label, words in texts:
            tokens = sorted({self.rank[w] for w in words})
            if not tokens:
                raise ValueError(f"template {label!r} has no words")
            need = math.ceil(threshold * len(tokens) - 1e-9)
            for token in tokens[: len(tokens) - need + 1]:
                self.prefix.setdefault(vocabulary[token], []).append(len(self.items))
            told = set(words_of(label.encode())) & set(words) if len(words) < SHORT else ()
            self.items.append(Template(label, {r: i for i, r in enumerate(tokens)}, need, len(words), frozenset(self.rank[w] for w in told)))

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Label -> best containment of all blocks that meet the threshold and aren't those of another version."""
        if self.prefix.keys().isdisjoint(words):
            return {}
        asked: set[tuple[int, int]] = set()
        for at, word in enumerate(words):
            for number in self.prefix.get(word, ()):
                step = self.items[number].step
                last = max(0, -(-(len(words) - step) // step) - 1)  # the last block starts here, however much it has
                asked.update((number, block) for block in (min(at // step, last), min(max(0, at // step - 1), last)))
        ranks = [self.rank.get(w, -1) for w in words]
        hits = []
        for number, block in asked:
            item = self.items[number]
            start = block * item.step
            shared = self._shared(item, ranks[start : start + 2 * item.step])
            if shared:
                hits.append((start, start + 2 * item.step, shared / len(item.places), item))
        found: dict[str, float] = {}
        for _, _, share, item in _undisputed(hits):
            found[item.label] = max(found.get(item.label, 0.0), share)
        return found

    def _shared(self, item: Template, part: list[int]) -> int:
        """How many of the template's words a block has; 0 where that is too few."""
        block = sorted({r for r in part if r >= 0})
        if len(block) < item.need:
            self.removed["length"] += 1
            return 0
        if item.places.keys().isdisjoint(block[: len(block) - item.need + 1]):
            self.removed["prefix"] += 1
            return 0
        shared = 0
        for at, token in enumerate(block):
            place = item.places.get(token)
            if place is None:
                continue
            if shared + min(len(block) - at, len(item.places) - place) < item.need:
                self.removed["position"] += 1
                return 0
            shared += 1
        return shared if shared >= item.need and item.must.issubset(block) else 0


def _undisputed(hits: list[tuple[int, int, float, Template]]) -> Iterator[tuple[int, int, float, Template]]:
    """Hits without an overlapping one of the family under another label that has a larger share, or the same with more words."""
    families: dict[str, list] = {}
    for hit in sorted(hits, key=lambda h: h[:2]):
        if hit[3].family is None:
            yield hit
        else:
            families.setdefault(hit[3].family, []).append(hit)
    for family in families.values():
        widest = max(stop - start for start, stop, _, _ in family)
        starts = [hit[0] for hit in family]
        for hit in family:
            start, stop, share, item = hit
            near = family[bisect_right(starts, start - widest) : bisect_left(starts, stop)]
            if not any(
                other.label != item.label and end > start and (best > share or (best == share and item.places.keys() < other.places.keys()))
                for _, end, best, other in near
            ):
                yield hit


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each word of a small vocabulary occurs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches, "text"):
            for text in column_bytes(batch, "text"):
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.binary()), pa.array([*seen.values()], pa.int64())], names=["word", "n"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    A null text is empty. Rows with null or repeated ids are scanned like any
    other and keep their id. labels holds the base labels and those of matching
    templates; score is 1 with a base phrase, else the best containment, else 0.
    An empty table gives an empty result; other columns are not read.
    """
    vocabulary = frozenset(w for _, text in templates for w in words_of(text.encode()))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = document_frequencies(rows, vocabulary)
    table = Templates(templates, order, threshold)
    split = [(words_of(p.encode()), label) for p, label in phrases]
    heads = frozenset(p[0] for p, _ in split)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for text in column_bytes(batch, "text"):
                words = words_of(text)
                places = (0, None, None, set()) if heads.isdisjoint(words) else find_phrases(words, split)
                found = table.matches(words)
                joined = [",".join(sorted(x)) for x in (places[3], places[3] | found.keys())]
                score = 1.0 if places[0] else max(found.values(), default=0.0)
                for column, value in zip(out, (len(words), *places[:3], *joined, score), strict=True):
                    column.append(value)
            types = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return rows.mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
