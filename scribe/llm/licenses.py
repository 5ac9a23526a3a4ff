"""License scans by a positional rare-token index, beside three base phrases.

Templates of licences and their notices are cut into words; the index holds, for the rarest words of each template, where
they stand. How rare a word is comes from the corpus: a first pass counts in how many documents each word of the
templates stands (a count for each template word, no more). A document's words are looked up, rarest first; each hit votes
for a template at a relative position (place in the document less place in the template); votes within SLACK words of one
another are joined. A template whose votes reach LEAST_SHARE of its words' weight is confirmed if its mandatory phrases
stand where the template has them, give or take SLACK words.

Defined cases: null and empty texts have no words and no labels; very long texts are read whole; rows repeated are scanned
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribe.llm.common import arrow_map, table

#: The base phrases and their labels.
BASE = {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}

#: Label, text, phrases that must stand in it.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache license version 2 0", "in compliance with the license"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ["apache license version 2"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "either version 3"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "either version 2"]),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", ["lesser general public license", "either version 2 1"]),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3", ["gnu lesser general public license version 3"]),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license version 3"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ["redistribution and use in source and binary forms", "neither the name"]),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0", ["boost software license version 1 0"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["provided as is without any express or implied warranty"]),
    ("cc0-1", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0", ["cc0 1 0"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international"]),
]

#: Rarest words of a template that are indexed; words that places may shift; least share of a template's weight.
RARE_WORDS, SLACK, LEAST_SHARE = 16, 4, 0.6

#: Bytes that part words become spaces, A-Z become a-z.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


VOCABULARY = frozenset(w for _, t, _ in TEMPLATES for w in words_of(t))


class Index(NamedTuple):
    postings: dict[bytes, list[tuple[int, int]]]  # word -> (template, place)
    idf: dict[bytes, float]
    weight: list[float]  # of each template's indexed places
    phrases: list[list[tuple[bytes, int]]]  # mandatory phrases and their places


def build_index(counts: dict[bytes, int], total: int) -> Index:
    """counts: in how many of total documents each template word stands."""
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) for w in VOCABULARY}
    postings, weight, phrases = defaultdict(list), [], []
    for k, (_, text, wanted) in enumerate(TEMPLATES):
        words = words_of(text)
        rare = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:RARE_WORDS]
        for i in rare:
            postings[words[i]].append((k, i))
        weight.append(sum(max(idf[words[i]], 0.01) for i in rare))
        joined = b" " + b" ".join(words) + b" "
        phrases.append([(p.encode(), joined[: joined.index(b" " + p.encode() + b" ")].count(b" ")) for p in wanted])
    return Index(dict(postings), idf, weight, phrases)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in BASE.items():
        padded = b" " + phrase + b" "
        at, counted, place = joined.find(padded), 0, 0
        while at >= 0:
            place += joined.count(b" ", counted, at)
            counted = at
            found.append((place, label))
            at = joined.find(padded, at + 1)
    return found


def stands(words: list[bytes], phrase: bytes, near: int) -> bool:
    parts = phrase.split()
    return any(words[i : i + len(parts)] == parts for i in range(max(0, near - SLACK), near + SLACK + 1))


def template_hits(words: list[bytes], index: Index) -> list[tuple[str, float]]:
    """(label, share of the template's weight) of each confirmed template."""
    rare = index.postings.keys() & set(words)
    if not rare:
        return []
    votes: dict[int, list[tuple[int, int, float]]] = defaultdict(list)  # template -> (relative place, place, weight)
    for i, w in enumerate(words):
        if w in rare:
            for k, place in index.postings[w]:
                votes[k].append((i - place, place, max(index.idf[w], 0.01)))
    out = []
    for k, cast in votes.items():
        if sum({place: w for _, place, w in cast}.values()) < LEAST_SHARE * index.weight[k]:
            continue
        cast.sort()
        best, lo = 0.0, 0
        seen: dict[int, int] = defaultdict(int)
        held = 0.0
        for hi, (rel, place, w) in enumerate(cast):
            held += w if not seen[place] else 0.0
            seen[place] += 1
            while cast[lo][0] < rel - SLACK:
                _, gone, weight = cast[lo]
                seen[gone] -= 1
                held -= weight if not seen[gone] else 0.0
                lo += 1
            share = held / index.weight[k]
            last = hi + 1 == len(cast) or cast[hi + 1][0] != rel
            if last and share >= LEAST_SHARE and share > best and all(stands(words, p, cast[lo][0] + place) or stands(words, p, rel + place) for p, place in index.phrases[k]):
                best = share
        if best:
            out.append((TEMPLATES[k][0], min(1.0, best)))
    return out


class Found(NamedTuple):
    n_words: int
    base: list[tuple[int, str]]
    hits: list[tuple[str, float]]


def scan(text: str | None, index: Index) -> Found:
    words = words_of(text)
    return Found(len(words), base_places(words), template_hits(words, index))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each template word stands, over all documents; and how many there are."""

    def rows(texts: list) -> dict:
        counts: dict[bytes, int] = defaultdict(int)
        for t in texts:
            for w in VOCABULARY.intersection(words_of(t)):
                counts[w] += 1
        counts[b""] = len(texts)
        return {"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}

    sums = arrow_map(docs.select(F.col(text_col).alias("text")), "word binary, n long", rows, "text").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in sums}
    return counts, counts.pop(b"", 0)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_words, base array<struct<word, label>>, found array<struct<label, score>>."""
    index = build_index(*document_frequencies(docs, text_col))
    cast = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the templates

    def rows(ids: list, texts: list) -> dict:
        got = [scan(t, cast.value) for t in texts]
        base = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        found = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))
        return {
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array([g.n_words for g in got], pa.int64()),
            "base": pa.array([[{"word": i, "label": x} for i, x in g.base] for g in got], base),
            "found": pa.array([[{"label": x, "score": s} for x, s in g.hits] for g in got], found),
        }

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(own, "doc_id long, n_words long, base array<struct<word:long,label:string>>, found array<struct<label:string,score:double>>", rows, "doc_id", "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_licenses(table(spark, sf_dir, "documents"))
    labels = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",")
    base, found = F.col("base.label"), F.col("found.label")
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("found.score")), F.lit(0.0)))
    return got.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"), labels(base).alias("base_labels"), labels(base, found).alias("labels"), score.alias("score"))
