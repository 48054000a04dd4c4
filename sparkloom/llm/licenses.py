"""License scans by diagonal voting of rolling word k-grams against template positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import KEY, TEXT, keyed, map_batches, real_id

K_WORDS = 4
#: Diagonals this near each other vote together: so many words may be added or lost inside a template.
NEAR = 3
MIN_COVERED = 0.6
#: All bytes but a-z, 0-9 and those of other scripts separate words (texts are lower-cased before).
SEPARATORS = K.bytes_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public license notices, and sentences of license bodies, with their labels.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "released under the MIT License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
)


def _words(texts: pa.Array):
    """Word hashes and their offsets by text; matching and windows are those of lower-cased words."""
    data, offsets = K.utf8(texts)
    _, _, by_text, hashes = K.word_hashes(K.LOWER[data], offsets, SEPARATORS)
    return hashes, by_text


def _grams(hashes: np.ndarray, by_text: np.ndarray, k: int):
    """Hashes of all k-grams, their text and first word, and offsets by text. No k-gram crosses texts."""
    counts = np.maximum(np.diff(by_text) - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = K.ranges(counts)
    start = at + by_text[text]
    return K.hash_ranges(hashes, start, start + k, K.MULTS[3]), text, at, np.append(0, np.cumsum(counts))


def _base(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Places of the phrases in each text."""
    hashes, by_text = _words(batch.column(2))
    n = batch.num_rows
    found, labels = [], [set() for _ in range(n)]
    for phrase, label in PHRASES.items():
        wanted, _ = _words(pa.array([phrase]))
        k = len(wanted)
        at = np.flatnonzero(hashes[: max(0, len(hashes) - k + 1)] == wanted[0])
        for j in range(1, k):
            at = at[hashes[at + j] == wanted[j]]
        text = np.searchsorted(by_text, at, "right") - 1
        inside = at + k <= by_text[text + 1]
        at, text = at[inside], text[inside]
        found.append((text, at - by_text[text]))
        for t in np.unique(text).tolist():
            labels[t].add(label)
    text, at = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    count = np.bincount(text, minlength=n)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(first, text, at)
    np.maximum.at(last, text, at)
    none = count == 0
    return pa.RecordBatch.from_pydict({
        "key": batch.column(0), "doc": batch.column(1), "n_words": pa.array(np.diff(by_text)), "n_base": pa.array(count),
        "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none), "found": pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
    })


def template_grams(spark: SparkSession, k: int = K_WORDS) -> DataFrame:
    """(gram, template, at): the fixed templates' k-grams; a few hundred rows."""
    hashes, by_text = _words(pa.array([t for _, t in TEMPLATES]))
    grams, text, at, _ = _grams(hashes, by_text, k)
    rows = list(zip(grams.view(np.int64).tolist(), text.tolist(), at.tolist(), strict=True))
    return spark.createDataFrame(rows, "gram long, template int, at int")


def _rolled(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    hashes, by_text = _words(batch.column(1))
    grams, _, _, offsets = _grams(hashes, by_text, k)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams.view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "grams"])


def license_spans(texts: DataFrame, k: int = K_WORDS) -> DataFrame:
    """(key, template, start, end, score) of ``keyed`` rows: verified spans in words.

    All k-grams meet the template positions in an equi-join whose broadcast side is the fixed set of
    templates. Votes are summed by text, template and diagonal (the offset between the two positions)
    before any shuffle; runs of diagonals up to NEAR apart are merged into a band. A band is verified
    word by word: the score is the share of the template's words that stand in the text at the band's
    offsets, as parts of k-grams that are equal there; a span is kept from MIN_COVERED on. A template
    with an edited word loses that word, and the words between it and an end or edit less than k away.
    Null, empty and short texts have none, nor has an empty table; repeated rows share a key and its spans.
    """
    spark = texts.sparkSession
    rolled = map_batches(texts.select(KEY, TEXT), lambda b: _rolled(b, k), "key long, grams array<long>")
    hits = rolled.select("key", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(template_grams(spark, k)), "gram")
    votes = hits.groupBy("key", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("at").alias("met"))
    near = Window.partitionBy("key", "template").orderBy("diagonal")
    votes = votes.withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near), F.lit(NEAR + 1)) > NEAR).cast("int"))
    votes = votes.withColumn("band", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    bands = votes.groupBy("key", "template", "band").agg(F.min("low").alias("start"), (F.max("high") + k).alias("end"), F.flatten(F.collect_list("met")).alias("met"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.col("met"), lambda at: F.sequence(at, at + k - 1)))))
    sizes = [len(_words(pa.array([t]))[0]) for _, t in TEMPLATES]
    bands = bands.withColumn("score", covered / F.element_at(F.array(*map(F.lit, sizes)), F.col("template") + 1))
    return bands.where(F.col("score") >= MIN_COVERED).select("key", "template", "start", "end", "score")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K_WORDS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    The base is every place where a phrase's words stand one after the other; the method adds the
    labels of verified template spans. The score is 1 where a phrase stands, else the best span's. Null
    and empty texts have no words, places or labels, and score 0. Null ids stay null; repeated rows are
    scanned alike; extra columns are ignored; an empty table gives an empty result.
    """
    texts = keyed(docs, id_col, text_col)
    base = map_batches(texts, _base, "key long, doc long, n_words long, n_base long, first_word long, last_word long, found array<string>")
    label = F.element_at(F.array(*[F.lit(x) for x, _ in TEMPLATES]), F.col("template") + 1)
    spans = license_spans(texts, k).groupBy("key").agg(F.collect_set(label).alias("more"), F.max("score").alias("best"))
    both = base.join(spans, "key", "left")
    shown = lambda c: F.concat_ws(",", F.array_sort(c))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return both.select(
        real_id("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", shown("found").alias("base_labels"),
        shown(F.array_union("found", more)).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


