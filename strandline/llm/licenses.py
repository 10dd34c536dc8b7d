"""License scan: phrases, and an exact set-containment join of text blocks with notice templates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.text import alnum_words, map_rows
from strandline.session import cut

THRESHOLD = 0.8
#: Characters of phrases and templates that a task holds at once; more are matched in several passes over the rows.
PASS_CHARS = 1_000_000
#: Phrases whose words in a row give a label (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices whose words, in any order, give a label when a block holds enough of them (fixed values): label, notice, the words
#: without which it is another license's notice, and those with which it is.
TEMPLATES = (
    ("mit", "Released under the terms of the MIT License", "released mit license", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "sublicense", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "granted charge obtaining documentation files", "organization"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "fee appear", ""),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "anyone alter freely", ""),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software", "organization accompanying", ""),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache 2", ""),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache compliance obtain", ""),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "file except compliance obtain", "mozilla"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary forms", ""),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither endorse promote", ""),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu general version 3", "lesser library affero"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", "gnu general version 2", "lesser library affero 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general redistribute", "lesser library affero"),
    ("lgpl", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser redistribute", "affero"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License", "lesser gnu", "affero"),
    ("agpl", "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero redistribute", ""),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla mpl", ""),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla", ""),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0", "eclipse", ""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution", "sharealike noncommercial noderivatives noderivs alike commercial derivatives"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike", "noncommercial commercial"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial", "sharealike noderivatives noderivs alike derivatives"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "creative commons attribution noncommercial sharealike", ""),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "creative commons attribution noderivatives", "noncommercial commercial"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived neighboring", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered", ""),
)


class Join:
    """Finds every template of whose words a block holds at least the threshold, with all its telling words and none of another's.

    Words stand in one global order, rarest first.  If a block shares a least overlap with a template, then the
    first shared word is in the prefixes of both (prefix filter); it leaves room for the overlap after its places
    (positional filter); and the block has at least that many words of any template (length filter).
    """

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        order = lambda w: (frequency.get(w, 0), w)
        words_of = lambda text: frozenset(alnum_words(text))
        # A template may be just a label and a text.
        given = [(t[0], *map(words_of, (*t[1:], "", "")[:3])) for t in templates]
        given = [t for t in given if t[1]]
        self.sets, self.telling = [t[:2] for t in given], [t[2:] for t in given]
        self.least = [max(1, math.ceil(threshold * len(words) - 1e-9)) for _, words in self.sets]
        self.rank = {w: i for i, w in enumerate(sorted(frozenset().union(*(s for _, s in self.sets)), key=order))}
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, words) in enumerate(self.sets):
            for i, w in enumerate(sorted(words, key=order)[: len(words) - self.least[t] + 1]):
                self.prefix.setdefault(w, []).append((t, i))
        self.vocabulary, self.starts, self.smallest = frozenset(self.rank), frozenset(self.prefix), min(self.least, default=1)

    def matches(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """Labels and containments for the words of one block."""
        if self.starts.isdisjoint(words):
            return
        known = self.vocabulary.intersection(words)
        if len(known) < self.smallest:
            return
        done = set()
        for j, w in enumerate(sorted(known, key=self.rank.__getitem__)[: len(known) - self.smallest + 1]):
            for t, i in self.prefix.get(w, ()):
                label, own = self.sets[t]
                if t not in done and len(known) >= self.least[t] and min(len(own) - i, len(known) - j) >= self.least[t]:
                    done.add(t)
                    both, (needed, other) = len(own & known), self.telling[t]
                    if both >= self.least[t] and needed <= known and other.isdisjoint(words):
                        yield label, both / len(own)


def paragraphs(text: str | None) -> Iterator[list[bytes]]:
    """The words of each run of lines that have words; a line without any (blank, or only marks) ends it.

    A notice wrapped over lines, with or without comment marks, stands in one such block, and so does each line.
    """
    words: list[bytes] = []
    for line in (text or "").split("\n"):
        own = alnum_words(line)
        if own:
            words += own
        elif words:
            yield words
            words = []
    if words:
        yield words


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many blocks of the whole corpus each word of the vocabulary stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for words in paragraphs(text):
                    found.update(vocabulary.intersection(words))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n bigint")
    # As many rows as the templates have words.
    return {bytes(r.word): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _passes(phrases: dict[str, str], templates, most: int) -> list[tuple[dict[str, str], list]]:
    """Phrases and templates in parts of at most ``most`` characters, or of one that is longer."""
    parts, held = [({}, [])], 0
    for kind, entry, n in [(0, p, len(p[0])) for p in phrases.items()] + [(1, t, sum(map(len, t[1:]))) for t in templates]:
        if held and held + n > most:
            parts.append(({}, []))
            held = 0
        held += n
        if kind:
            parts[-1][1].append(entry)
        else:
            parts[-1][0][entry[0]] = entry[1]
    return parts


def _scan(rows: DataFrame, phrases: dict[str, str], templates, threshold: float) -> DataFrame:
    """One pass: ``doc_id, text`` and what earlier passes have found, with what these phrases and templates add to it."""
    vocabulary = frozenset(w for t in templates for part in t[1:] for w in alnum_words(part))
    join = Join(templates, word_frequencies(rows, vocabulary), threshold)
    needles = [(b" " + b" ".join(alnum_words(p)) + b" ", label) for p, label in phrases.items()]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    split = lambda told: set(filter(None, (told or "").split(",")))

    def make():
        def function(doc_id, text, n_base=0, first=None, last=None, told_base="", told="", score=0.0, *_):
            words, labels, base, best = [], split(told), split(told_base), score
            for own in paragraphs(text):
                words += own
                for label, share in join.matches(own):
                    labels.add(label)
                    best = max(best, share)
            line = b" " + b" ".join(words) + b" "
            places = []
            for needle, label in needles:
                before = place = 0
                at = line.find(needle)
                while at >= 0:
                    place += line.count(b" ", before, at)
                    before = at
                    places.append(place)
                    base.add(label)
                    at = line.find(needle, at + 1)
            ends = [*places, *(x for x in (first, last) if x is not None)]
            return (
                doc_id, text, n_base + len(places), min(ends, default=None), max(ends, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | labels)), 1.0 if base else best, len(words),
            )

        return function

    return map_rows(rows, make, f"doc_id {id_type}, text string, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_words bigint")


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
    templates: tuple[tuple[str, ...], ...] = TEMPLATES, threshold: float = THRESHOLD, most: int = PASS_CHARS,
) -> DataFrame:
    """License labels of each row's whole text.

    Returns ``doc_id, n_words, n_base`` (places where a phrase's words stand in a row), ``first_word, last_word`` (its
    smallest and largest start, else null), ``base_labels, labels`` (sorted, comma-joined; labels add those of templates
    of whose distinct words some block, a run of lines between lines without words, holds ``threshold`` or more, all its
    telling words among them and none that tells another license) and ``score`` (1 with a phrase, else the largest such
    share, else 0).  A template is a label and a text, or these with its telling words and those of others.

    A null text is empty; a null id stays null; an empty table gives an empty frame; repeated rows give repeated results;
    other columns are ignored; the time is in proportion to the text.  Phrases and templates of over ``most`` characters
    take a pass over the rows for each part of that size, so no task holds more of them.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = _passes(phrases, templates, most)
    for i, (some_phrases, some_templates) in enumerate(parts):
        rows = _scan(rows, some_phrases, some_templates, threshold)
        if i + 1 < len(parts):
            rows = cut(rows)
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
