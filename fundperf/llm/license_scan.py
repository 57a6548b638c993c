"""License scan over a positional index of rare words.

Every template (a notice, as its licence prints it) is indexed under its KEYS words of highest inverse
document frequency, counted over all files, with their places in the template. A file's key words look up
postings; each says where in the file the template would have to begin. Places on which enough different key
words agree, within SLACK words, are candidates. A candidate counts if the file has most of the template's
words where they belong, and the template's mandatory phrases within the span.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, table, text_slices, texts_of

KEYS = 4
#: Different key words that must agree on a place.
AGREE = 2
SLACK = 3
#: Share of a template's words that must stand where they belong.
ACCEPT = 0.7

# The phrases and labels that are counted as they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices in the words of the licences; label, notice, mandatory phrases.
NOTICES = [
    ("mit-reference", "Released under the MIT License", ["mit license"]),
    (
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction",
        ["permission is hereby granted", "free of charge", "without restriction"],
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    (
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
        ["apache license", "in compliance with the license"],
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ["general public license", "version 2"]),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
        ["free software", "general public license"],
    ),
    (
        "lgpl-notice",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation",
        ["lesser general public license"],
    ),
    (
        "agpl-notice",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation",
        ["affero general public license"],
    ),
    (
        "bsd-notice",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
        ["source and binary forms", "following conditions"],
    ),
    (
        "isc-notice",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee", "appear in all copies"],
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ["mozilla public license", "2 0"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ["unencumbered software", "public domain"],
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc0-1.0", "Licensed under CC0 1.0 Universal", ["cc0 1 0"]),
]

#: Bytes to word bytes: letters in lower case, digits and all bytes beyond ASCII; the rest separates.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    places, at = [], -1
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + len(phrase)] == phrase:
                places.append(at)
    except ValueError:
        return places


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[list[bytes]]

    @classmethod
    def of(cls, label: str, notice: str, phrases: list[str]) -> Template:
        return cls(label, words_of(notice.encode()), [words_of(p.encode()) for p in phrases])


def templates() -> list[Template]:
    return [Template.of(*notice) for notice in NOTICES]


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Files in all, and for each word of the (fixed) vocabulary the files that have it."""
    schema = arrow_schema("word binary, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in text_slices(batches):
            found[b""] += part.num_rows
            for text in texts_of(part):
                found.update(vocabulary.intersection(words_of(text)))
        yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=schema)

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, entries: list[Template], files: int, counts: dict[bytes, int]):
        self.entries = entries
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for t, entry in enumerate(entries):
            weight = {w: math.log((files + 1) / (counts.get(w, 0) + 1)) for w in entry.words}
            keys = sorted(weight, key=lambda w: (-weight[w], w))[:KEYS]
            self.needed.append(min(AGREE, len(keys)))
            for place, word in enumerate(entry.words):
                if word in keys:
                    self.postings[word].append((t, place))
        self.keys = set(self.postings)

    def begins(self, words: list[bytes]) -> dict[int, list[int]]:
        """For each template the places in the file that enough key words agree on."""
        if not self.keys.intersection(words):
            return {}
        votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for at, word in enumerate(words):
            for t, place in self.postings.get(word, ()):
                votes[t].append((at - place, word))
        out = {}
        for t, cast in votes.items():
            cast.sort()
            low, places, inside = 0, [], Counter()
            for begin, word in cast:
                inside[word] += 1
                while cast[low][0] < begin - SLACK:
                    inside[cast[low][1]] -= 1
                    inside += Counter()
                    low += 1
                if len(inside) >= self.needed[t] and (not places or begin > places[-1]):
                    places.append(begin)
            if places:
                out[t] = places
        return out

    def matches(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of the templates that the file holds, and the best share of a template in place."""
        labels, best = set(), 0.0
        for t, places in self.begins(words).items():
            entry = self.entries[t]
            for begin in places:
                low, high = max(0, begin - SLACK), begin + len(entry.words) + SLACK
                span = words[low : max(low, high)]
                held = sum(
                    word in words[max(0, begin + i - SLACK) : max(0, begin + i + SLACK + 1)]
                    for i, word in enumerate(entry.words)
                )
                share = held / len(entry.words)
                best = max(best, share)
                if share >= ACCEPT and all(phrase_places(span, p) for p in entry.phrases):
                    labels.add(entry.label)
        return labels, best


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Null and empty texts have no words, no places, empty labels and score 0. Repeated rows stay rows, null
    doc_ids stay null; other columns aren't read; an empty table gives an empty result.
    """
    entries = templates()
    index = Index(entries, *frequencies(docs, {w for e in entries for w in e.words}))
    phrases = [(words_of(p.encode()), label) for p, label in PHRASES.items()]
    kind = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double"
    )
    schema = arrow_schema(kind)
    triggers = {phrase[-1] for phrase, _ in phrases} | index.keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = []
            for text in texts_of(part):
                words = words_of(text)
                places, base, more, score = [], set(), set(), 0.0
                if triggers.intersection(words):
                    for phrase, label in phrases:
                        if own := phrase_places(words, phrase):
                            places += own
                            base.add(label)
                    more, score = index.matches(words)
                ends = (min(places), max(places)) if places else (None, None)
                rows.append((len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | more)), score))
            columns = (pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))
            yield pa.record_batch([part["doc_id"].cast(pa.int64()), *columns], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
