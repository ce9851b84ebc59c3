"""License scans: base phrases, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Set
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ALNUM, column, prepare, raw_texts

#: Phrases of the base rule and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices as they stand in files, with their labels.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction"
    ),
    "mit-line": "Released under the MIT License",
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted"
    ),
    "all-rights-reserved": "All rights reserved",
    "apache-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    ),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version."
    ),
    "agpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "bsd-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission"
    ),
    "as-is": (
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software."
    ),
    "boost": "Distributed under the Boost Software License, Version 1.0",
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
    ),
    "cc0": (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and "
        "related or neighboring rights to this work"
    ),
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document",
}
THRESHOLD = 0.8
#: Words of a window over line ends, as a multiple of the template's words.
REACH = 2


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(ALNUM).split()


def base_places(raw: bytes) -> tuple[list[int], set[str]]:
    """Word numbers where a phrase begins, and the labels found."""
    line = raw.translate(ALNUM)
    if not any(rare in line for rare in (b"license", b"cc")):
        return [], set()
    line = b" " + b" ".join(line.split()) + b" "
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        at, before, n = line.find(sought), 0, 0
        while at >= 0:
            n += line.count(b" ", before, at)
            places.append(n)
            labels.add(label)
            before, at = at, line.find(sought, at + 1)
    return places, labels


class TemplateJoin:
    """Exact join of blocks with templates by containment: |block & template| >= t * |template|.

    Tokens of a template stand from the globally rarest to the most frequent. A block that reaches
    the threshold has one of a template's first ``|T| - need + 1`` tokens (prefix filter), has at
    least ``need`` distinct tokens (length filter), and its first match at place i leaves
    ``|T| - i`` tokens, which must reach ``need`` (positional filter). What passes is counted.
    """

    def __init__(self, frequency: dict[bytes, int], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD):
        self.prefix: dict[bytes, list[tuple[str, int]]] = {}
        self.tokens: dict[str, list[bytes]] = {}
        self.need: dict[str, int] = {}
        self.reach: dict[str, int] = {}
        for name, text in templates.items():
            words = words_of(text.encode())
            self.reach[name] = REACH * len(words)
            tokens = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
            self.tokens[name] = tokens
            self.need[name] = need = ceil(threshold * len(tokens) - 1e-9)
            for place, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix.setdefault(token, []).append((name, place))
        self.least = min(self.need.values(), default=0)

    def block(self, raw: bytes) -> list[tuple[str, float]]:
        """Templates that one block contains, with the containment."""
        words = words_of(raw)
        if len(words) < self.least or self.prefix.keys().isdisjoint(words):
            return []
        block, first, out = set(words), {}, []
        for token in block & self.prefix.keys():
            for name, place in self.prefix[token]:
                first[name] = min(place, first.get(name, place))
        for name, place in first.items():
            tokens, need = self.tokens[name], self.need[name]
            if len(block) >= need and len(tokens) - place >= need:
                common = sum(t in block for t in tokens[place:])
                if common >= need:
                    out.append((name, common / len(tokens)))
        return out

    def windows(self, name: str, words: list[tuple[int, bytes]], taken: Set[int]) -> list[tuple[int, int, float]]:
        """(first line, last line, containment) of disjoint runs of ``words``, within ``reach`` and outside ``taken`` lines.

        From the first run that meets the threshold, the one of most tokens within another ``reach``
        is taken, and the search goes on behind it.
        """
        tokens, need, reach = set(self.tokens[name]), max(self.need[name], 1), self.reach[name]
        hits = [(place, line, w) for place, (line, w) in enumerate(words) if w in tokens]
        out: list[tuple[int, int, float]] = []
        counts: Counter[bytes] = Counter()
        lo = at = most = left = right = limit = 0
        while at < len(hits) or most:
            if most and (at == len(hits) or hits[at][1] in taken or hits[at][0] > limit):
                kept = Counter(w for *_, w in hits[left : right + 1])
                while kept[hits[left][2]] > 1:
                    kept[hits[left][2]] -= 1
                    left += 1
                out.append((hits[left][1], hits[right][1], most / len(tokens)))
                lo = at = right + 1
                most = 0
                counts.clear()
                continue
            place, line, w = hits[at]
            at += 1
            if line in taken:
                lo = at
                counts.clear()
                continue
            counts[w] += 1
            while hits[lo][0] <= place - reach:
                gone = hits[lo][2]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
                lo += 1
            if len(counts) >= need and len(counts) > most:
                limit = limit if most else place + reach
                most, left, right = len(counts), lo, at - 1
        return out

    def peak(self, name: str, words: list[tuple[int, bytes]]) -> tuple[int, int, float]:
        """(first line, last line, containment) of the run within ``reach`` that has the most tokens."""
        tokens, reach = set(self.tokens[name]), self.reach[name]
        hits = [(place, line, w) for place, (line, w) in enumerate(words) if w in tokens]
        counts: Counter[bytes] = Counter()
        lo, best = 0, (0, 0, 0)
        for place, line, w in hits:
            counts[w] += 1
            while hits[lo][0] <= place - reach:
                gone = hits[lo][2]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
                lo += 1
            if len(counts) > best[2]:
                best = (hits[lo][1], line, len(counts))
        return best[0], best[1], best[2] / len(tokens)

    def text(self, raw: bytes) -> list[tuple[int, int, str, float]]:
        """(first line, lines, template, containment) of a text's blocks, which are lines and windows over line ends.

        A window counts where it overlaps no line that meets its template's threshold, or has more
        of the template than all such lines of the text; the one of most tokens is always among them.
        """
        present = set(words_of(raw))
        if self.prefix.keys().isdisjoint(present):
            return []
        names = [n for n, tokens in self.tokens.items() if sum(t in present for t in tokens) >= max(self.need[n], 1)]
        if not names:
            return []
        lines = raw.split(b"\n")
        out = [(i, 1, name, share) for i, line in enumerate(lines) for name, share in self.block(line)]
        if len(lines) == 1:
            return out
        words = [(i, w) for i, line in enumerate(lines) for w in words_of(line)]
        for name in names:
            alone = {i: share for i, _, other, share in out if other == name}
            found = set(self.windows(name, words, alone.keys()))
            if alone and (best := max(alone.values())) < 1:
                found |= {x for x in self.windows(name, words, set()) if x[2] > best}
            top = self.peak(name, words)
            if top[2] > max([*alone.values(), *(x[2] for x in found)], default=0) and top[2] * len(self.tokens[name]) >= self.need[name]:
                found.add(top)
            out += [(a, z - a + 1, name, share) for a, z, share in sorted(found)]
        return out


def token_frequencies(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """In how many texts each template token stands, over all of ``docs``."""
    prepare(docs.sparkSession)
    sought = frozenset(w for text in templates.values() for w in words_of(text.encode()))

    def count(batches):
        found = dict.fromkeys(sought, 0)
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                for w in sought.intersection(words_of(raw)):
                    found[w] += 1
        yield pa.RecordBatch.from_pydict(
            {"token": pa.array([w.decode() for w in found]), "n": pa.array(list(found.values()), pa.int64())}
        )

    rows = docs.select(column(text_col)).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"].encode(): r["n"] for r in rows.collect()}


_FIELDS = [
    ("n_words", pa.int64(), "long"),
    ("n_base", pa.int64(), "long"),
    ("first_word", pa.int64(), "long"),
    ("last_word", pa.int64(), "long"),
    ("base_labels", pa.string(), "string"),
    ("labels", pa.string(), "string"),
    ("score", pa.float64(), "double"),
]
_BLOCK = pa.list_(pa.struct([("line", pa.int32()), ("lines", pa.int32()), ("template", pa.string()), ("containment", pa.float64())]))


def license_scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequency: dict[bytes, int] | None = None,
) -> DataFrame:
    """License phrases and text blocks, a row for each row of ``docs``.

    ``n_words, n_base, first_word, last_word, base_labels`` come from the base phrases; ``blocks``
    (first line, lines, template, containment) are the lines, and the windows over line ends of up to
    ``REACH`` times a template's words, that contain at least ``threshold`` of the template's distinct
    words; ``labels`` are the base labels and those templates' names, ``score`` the largest
    containment (1 if a base phrase stands, 0 if nothing does). Longer paragraphs are no blocks of
    their own, as they gather a template's words from unrelated sentences. Null and empty texts have no words, no places (null first and last),
    empty labels and score 0. Repeated rows are scanned apiece; an empty table gives an empty one;
    other columns are not read.
    """
    prepare(docs.sparkSession)
    join = TemplateJoin(token_frequencies(docs, templates, text_col) if frequency is None else frequency, templates, threshold)

    @F.arrow_udf("struct<" + ",".join(f"{n}:{s}" for n, _, s in _FIELDS) + ",blocks:array<struct<line:int,lines:int,template:string,containment:double>>>")
    def scan(text: pa.Array) -> pa.Array:
        rows = []
        for raw in raw_texts(text):
            places, base = base_places(raw)
            blocks = join.text(raw)
            names = sorted(base | {name for *_, name, _ in blocks})
            score = 1.0 if places else max((share for *_, share in blocks), default=0.0)
            rows.append(
                (
                    len(words_of(raw)),
                    len(places),
                    min(places, default=None),
                    max(places, default=None),
                    ",".join(sorted(base)),
                    ",".join(names),
                    score,
                    [{"line": i, "lines": n, "template": name, "containment": share} for i, n, name, share in blocks],
                )
            )
        columns = list(zip(*rows)) if rows else [[]] * (len(_FIELDS) + 1)
        kinds = [*((n, t) for n, t, _ in _FIELDS), ("blocks", _BLOCK)]
        return pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, kinds)], names=[n for n, _ in kinds])

    scanned = docs.select(column(id_col).alias(id_col), scan.asNondeterministic()(column(text_col)).alias("r_"))
    return scanned.select(column(id_col), *(F.col(f"r_.{n}").alias(n) for n, *_ in _FIELDS), F.col("r_.blocks").alias("blocks"))
