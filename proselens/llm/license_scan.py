"""Licence passages in texts by diagonal voting.

Templates are word sequences with a label. The hash of every rolling run of k words of a text is joined with the positions
at which templates hold that run. A match votes for a diagonal: the word of the text at which the template would begin.
Votes are aggregated by diagonal, neighbouring diagonals (words put in or left out) are merged, and the spans of diagonals
with enough votes are verified word by word, as the longest common subsequence with the template. Of passages found at one
place, such as those of related licences, the one that fits best stays; phrases all stay.

Words: ASCII letters lower-cased, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.

Rows: null and empty texts have no words and no labels. Equal texts get equal results, whatever their number and ids. Ids may
be null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .shared import in_slices, short_batches, small, stage

#: Words in a run: of templates shorter than LONG_RUN, SHORT_RUN.
SHORT_RUN, LONG_RUN = 2, 4
#: Diagonals at most so many words apart are one alignment.
SLACK = 6
#: A span is a find if at least this share of the template's words is there, in order.
LEAST_SCORE = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # every word must be there

    def words(self) -> np.ndarray:
        return next(words.word_hashes([self.text.encode()], words.NOT_ALNUM))

    def run(self) -> int:
        return SHORT_RUN if len(self.words()) < LONG_RUN else LONG_RUN


#: Phrases and labels of the contract.
BASE = [Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True)]

#: Passages of common licences, as their texts have them.
LICENSES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    Template("mit", "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("agpl", "You should have received a copy of the GNU Affero General Public License along with this program"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    Template("boost", "Distributed under the Boost Software License, Version 1.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    Template("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
]


def _runs(ks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
            found = list(words.word_hashes(raw, words.NOT_ALNUM))
            for k in ks:
                grams = [words.grams(x, k).view(np.int64) for x in found]
                bounds = pa.array(np.cumsum([0, *map(len, grams)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_hash"), pa.array(np.full(len(grams), k, np.int32)), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(grams) if grams else np.empty(0, np.int64)))],
                    names=["text_hash", "k", "runs"],
                )

    return run


def template_positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """k, run, template, place, length, votes_needed: where each template holds each of its runs. As large as the templates."""
    rows = []
    for t, template in enumerate(templates):
        own, k = template.words(), template.run()
        runs = words.grams(own, k).view(np.int64).tolist()
        needed = len(runs) if template.exact else max(1, math.ceil(len(runs) * 0.3))
        rows += [(k, run, t, place, len(own), needed) for place, run in enumerate(runs)]
    names = ("k", "run", "template", "place", "length", "needed")
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=list(names)))


def alignments(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """text_hash, template, first, last: spans of words in which a template may stand. Equal texts vote once, however many rows hold them."""
    spark = docs.sparkSession
    positions = template_positions(spark, templates)  # Spark broadcasts it if its size is below the session's limit
    runs = docs.select("text_hash", "text").mapInArrow(_runs(sorted({t.run() for t in templates})), "text_hash long, k int, runs array<long>")
    placed = runs.select("text_hash", "k", F.posexplode("runs").alias("at", "run"))
    key = ["text_hash", "template"]
    cast = placed.join(positions, ["k", "run"]).select(*key, (F.col("at") - F.col("place")).alias("diagonal"), "at", "k", "length", "needed").distinct()
    by_diagonal = cast.groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("low"), F.max(F.col("at") + F.col("k") - 1).alias("high"), F.first("length").alias("length"), F.first("needed").alias("needed"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    exact = F.element_at(F.array(*[F.lit(t.exact) for t in templates]), F.col("template") + 1)
    begins = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > SLACK) | exact, F.lit(True)).cast("int")
    merged = by_diagonal.withColumn("begins", begins).withColumn("island", F.sum("begins").over(along))
    spans = merged.groupBy(*key, "island").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("from"), F.max("diagonal").alias("to"), F.first("length").alias("length"), F.first("needed").alias("needed"))
    enough = spans.where("votes >= needed")
    first = F.greatest(F.least("low", "from"), F.lit(0))
    return enough.select(*key, first.alias("first"), F.greatest("high", F.col("to") + F.col("length") - 1).alias("last"))


def _aligned(template: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Places in ``span`` of the words of a longest common subsequence with ``template``, rising."""
    table = np.zeros((len(template) + 1, len(span) + 1), np.int32)
    for i in range(len(template) - 1, -1, -1):
        same = table[i + 1, 1:] + (template[i] == span)
        table[i, :-1] = np.maximum.accumulate(np.maximum(same, table[i + 1, :-1])[::-1])[::-1]
    i = j = 0
    found = []
    while i < len(template) and j < len(span):
        if template[i] == span[j]:
            found.append(j)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return np.array(found, np.int64)


def _closest(finds: list[dict]) -> list[dict]:
    """Without finds of passages (not phrases) that lie for the most part where another passage fits better."""
    kept = []
    for f in sorted(finds, key=lambda f: (-f["fit"], f["first"], f["template"])):
        length = f["last"] - f["first"] + 1
        if f["fit"] == np.inf or not any(g["fit"] > f["fit"] and 2 * (min(f["last"], g["last"]) - max(f["first"], g["first"]) + 1) > length for g in kept if g["fit"] < np.inf):
            kept.append(f)
    return sorted(kept, key=lambda f: (f["first"], f["last"], f["template"]))


def _verify(templates: list[Template]):
    """Words of each text, and its spans held against their templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [t.words() for t in templates]
        for batch in in_slices(batches):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            n_words, finds = [], []
            for text, spans in zip(words.word_hashes(texts, words.NOT_ALNUM), batch.column("spans").to_pylist(), strict=True):
                n_words.append(len(text))
                found = []
                for s in spans or []:
                    template, part = own[s["template"]], text[s["first"] : s["last"] + 1]
                    if templates[s["template"]].exact:
                        if len(part) == len(template) and (part == template).all():
                            found.append({"template": s["template"], "first": s["first"], "last": s["last"], "score": 1.0, "fit": np.inf})
                        continue
                    at = _aligned(template, part)
                    if len(at) >= LEAST_SCORE * len(template):
                        fit = len(at) / (len(template) + int(at[-1] - at[0]) + 1 - len(at))  # shared words of all words of both
                        found.append({"template": s["template"], "first": s["first"] + int(at[0]), "last": s["first"] + int(at[-1]), "score": len(at) / len(template), "fit": fit})
                finds.append([{k: v for k, v in f.items() if k != "fit"} for f in _closest(found)])
            kind = pa.list_(pa.struct([("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(finds, kind)], names=["doc_id", "n_words", "finds"])

    return run


def scan(docs: DataFrame, templates: list[Template] = BASE + LICENSES) -> DataFrame:
    """doc_id, n_words, finds: verified spans (template number, first and last word, score), for every document."""
    texts = short_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    spans = alignments(texts, templates).groupBy("text_hash").agg(F.sort_array(F.collect_set(F.struct("template", "first", "last"))).alias("spans"))
    joined = texts.join(small(stage(spans, "spans")), "text_hash", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_verify(templates), "doc_id long, n_words long, finds array<struct<template:int,first:long,last:long,score:double>>")


def result(docs: DataFrame, base: list[Template] = BASE, more: list[Template] = LICENSES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (of the base finds), base_labels, labels, score."""
    templates = base + more
    label = F.array(*[F.lit(t.label) for t in templates])
    of_base = F.filter("finds", lambda f: f["template"] < len(base))
    name = lambda finds: F.array_join(F.array_sort(F.array_distinct(F.transform(finds, lambda f: F.element_at(label, f["template"] + 1)))), ",")
    starts = F.transform(of_base, lambda f: f["first"])
    return scan(docs, templates).select(
        "doc_id",
        "n_words",
        F.size(of_base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        name(of_base).alias("base_labels"),
        name(F.col("finds")).alias("labels"),
        F.coalesce(F.array_max(F.transform("finds", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )
