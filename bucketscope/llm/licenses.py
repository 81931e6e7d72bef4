"""License scans: an exact set-similarity join of text blocks with license templates (operator 3).

A template's words are ordered by how many documents have them, rarest first, over the whole corpus. A block that holds
the needed share of a template must hold one of the first words in that order (prefix filter), must have enough words
(length filter), and must still be able to reach the share from the place where the two first meet (positional filter).
What passes is verified. A text is cut into blocks that overlap by half, with sizes such that every run of words as long
as a template lies within one block of the template's class.

The templates are a parameter of bounded size, so they are broadcast and the join is one pass over the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bucketscope.llm.common import in_python

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8
#: Run lengths of the block classes, in words; a block is twice as long.
CLASSES = (16, 48, 160)
#: Words of all templates together.
MAX_TEMPLATE_WORDS = 100_000

# The phrases that the scan must find word by word, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening passages of public licenses, and customary notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words: runs of digits, letters a-z and characters beyond ASCII."""
    return (text or b"").translate(_WORD_BYTES).split()


class Template(NamedTuple):
    label: str
    order: list[bytes]  # distinct words, rarest in the corpus first
    words: frozenset[bytes]
    needed: int
    run: int  # class


class Match(NamedTuple):
    template: int
    start: int
    size: int
    containment: float


class Index:
    """Templates by the words of their prefixes, for each block class."""

    def __init__(self, templates: Sequence[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        self.templates: list[Template] = []
        self.prefix: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        vocabulary = sorted({w for _, t in templates for w in words_of(t.encode())}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        for label, text in templates:
            words = words_of(text.encode())
            if not words:
                raise ValueError(f"a template of {label} has no words")
            order = sorted(set(words), key=self.rank.__getitem__)
            # the least count whose share reaches the threshold, free of rounding
            needed = next(n for n in range(1, len(order) + 1) if n >= threshold * len(order) - 1e-9)
            run = next((c for c in CLASSES if c >= len(words)), len(words))
            self.templates.append(Template(label, order, frozenset(order), needed, run))
            for place, word in enumerate(order[: len(order) - needed + 1]):
                self.prefix.setdefault(run, {}).setdefault(word, []).append((len(self.templates) - 1, place))
        self.heads = frozenset(w for words in self.prefix.values() for w in words)

    def matches(self, words: list[bytes]) -> list[Match]:
        """Every block of a text that holds the needed share of a template."""
        if self.heads.isdisjoint(words):
            return []
        found = []
        hits = [(i, w) for i, w in enumerate(words) if w in self.heads]
        for run, prefix in self.prefix.items():
            blocks: dict[int, set[tuple[int, int]]] = {}
            last = max(0, -(-len(words) // run) - 2)  # the last block reaches the end
            for i, word in hits:
                for entry in prefix.get(word, ()):
                    for block in {min(i // run, last), min(max(i // run - 1, 0), last)}:
                        blocks.setdefault(block, set()).add(entry)
            for block, entries in sorted(blocks.items()):
                start = block * run
                own = set(words[start : start + 2 * run])
                ranks = sorted(self.rank[w] for w in own if w in self.rank)
                first: dict[int, int] = {}
                for template, place in entries:
                    first[template] = min(place, first.get(template, place))
                for template, place in sorted(first.items()):
                    t = self.templates[template]
                    meets = self.rank[t.order[place]]
                    able = min(len(t.order) - place, sum(r >= meets for r in ranks))
                    if len(own) < t.needed or able < t.needed:
                        continue
                    shared = len(own & t.words)
                    if shared >= t.needed:
                        size = min(2 * run, len(words) - start)
                        found.append(Match(template, start, size, shared / len(t.order)))
        return found


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> dict[str, list[int]]:
    """Start words of every place of each phrase that occurs."""
    out: dict[str, list[int]] = {}
    if not words:
        return out
    line = b" " + b" ".join(words) + b" "
    for phrase in phrases:
        wanted = b" " + b" ".join(words_of(phrase.encode())) + b" "
        at, counted, word = line.find(wanted), 0, 0
        while at >= 0:
            word += line.count(b" ", counted, at)
            counted = at
            out.setdefault(phrase, []).append(word)
            at = line.find(wanted, at + 1)
    return out


def word_frequency(docs: DataFrame, words: set[bytes], text_column: str = "text") -> dict[bytes, int]:
    """How many documents hold each of the given words; counted by the tasks, one row per word and task comes back."""
    # the words of the templates
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(shared.value.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"]
        )

    rows = in_python(docs).select(text_column).mapInArrow(run, "word binary, n long")
    return {bytes(r[0]): r[1] for r in rows.groupBy("word").agg(F.sum("n")).collect()}


def _index(docs: DataFrame, templates: Sequence[tuple[str, str]], threshold: float, text_column: str) -> Index:
    words = [w for _, t in templates for w in words_of(t.encode())]
    if len(words) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words together")
    return Index(templates, word_frequency(docs, set(words), text_column), threshold)


def matching_blocks(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, label, template, first_word, n_words, containment`` of every block that meets the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(_index(docs, templates, threshold, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = [(i, m) for i, t in enumerate(batch.column(1).cast(pa.binary())) for m in index.matches(words_of(t.as_py()))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([i for i, _ in found], pa.int64())),
                    pa.array([index.templates[m.template].label for _, m in found], pa.string()),
                    pa.array([m.template for _, m in found], pa.int32()),
                    pa.array([m.start for _, m in found], pa.int64()),
                    pa.array([m.size for _, m in found], pa.int64()),
                    pa.array([m.containment for _, m in found], pa.float64()),
                ],
                ["doc_id", "label", "template", "first_word", "n_words", "containment"],
            )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, label string, template int, first_word long, n_words long, containment double"
    return in_python(rows).mapInArrow(run, schema)


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts all places of the fixed phrases, ``first_word`` and ``last_word`` are their smallest and largest
    start. ``labels`` adds those of matching templates. ``score`` is 1 where a phrase was found, else the largest
    containment of a matching template, else 0. A null text is empty: no words, no labels. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_index(docs, templates, threshold, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                words = words_of(text.as_py())
                places = phrase_places(words, PHRASES)
                starts = [at for found in places.values() for at in found]
                base = {PHRASES[p] for p in places}
                found = index.matches(words)
                labels = base | {index.templates[m.template].label for m in found}
                best = 1.0 if base else max((m.containment for m in found), default=0.0)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return in_python(rows).mapInArrow(run, schema)
