"""License scan: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

Every sentence of a text that can state a licence (it holds one of a few stems) becomes a sparse
TF-IDF vector; the cosine to each template decides. Document frequencies are counted over all such
sentences of all texts. A file without a statement of its own takes the licence of the nearest
directory above it that has a licence file; that is settled once per directory, by joining the
directory's ancestor paths to the directories with licences, and then joined to the files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailsift.llm.common import stored

# Usual statements of each licence.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "The author has dedicated this work to the public domain under CC0 1.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
STEMS = r"(?i)licen[cs]|copyright|rights reserved|spdx|public domain|permission is|redistribut|source code form"
LEAST_COSINE = 0.6
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(sentence: str) -> list[str]:
    return _TERM.findall(sentence.lower())


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms(text)})
_INDEX = {t: i for i, t in enumerate(VOCABULARY)}


def sentences(text: Column) -> Column:
    """The sentences that can state a licence: cut at line breaks and after sentence marks."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n|(?<=[.;!?])[\x20\x09]+"), lambda s: s.rlike(STEMS))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, total = np.zeros(len(VOCABULARY) + 1, np.int64), 0
    for batch in batches:
        for row in batch.column(0):
            for sentence in row.as_py():
                total += 1
                for t in set(terms(sentence)):
                    if t in _INDEX:
                        seen[_INDEX[t]] += 1
    seen[-1] = total
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["term", "n"])


def inverse_frequencies(found: DataFrame) -> np.ndarray:
    """For each term of the templates; the last entry is for any other term."""
    counts = np.zeros(len(VOCABULARY) + 1)
    rows = found.select("sentences").mapInArrow(_count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # a row per term of the templates
        counts[r["term"]] = r["n"]
    for _, text in TEMPLATES:
        counts[[*{_INDEX[t] for t in terms(text)}, -1]] += 1
    idf = np.log((1 + counts[-1]) / (1 + counts)) + 1
    idf[-1] = np.log(1 + counts[-1]) + 1
    return idf


def cosines(batch: list[str], idf: np.ndarray) -> np.ndarray:
    """Of each sentence to each template."""
    def sparse(text: str) -> dict[int, float]:
        out: dict[int, float] = {}
        other = 0
        for t in terms(text):
            i = _INDEX.get(t)
            if i is None:
                other += 1
            else:
                out[i] = out.get(i, 0.0) + idf[i]
        norm = sum(v * v for v in out.values()) + other * idf[-1] ** 2
        return {i: v / norm**0.5 for i, v in out.items()} if norm else {}

    marks = np.zeros((len(VOCABULARY), len(TEMPLATES)))
    for j, (_, text) in enumerate(TEMPLATES):
        for i, v in sparse(text).items():
            marks[i, j] = v
    result = np.zeros((len(batch), len(TEMPLATES)))
    for r, text in enumerate(batch):
        own = sparse(text)
        if own:
            result[r] = np.fromiter(own.values(), float) @ marks[list(own)]
    return result


def _match(idf: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            flat = [s for own in lists for s in own]
            scores = cosines(flat, idf) if flat else np.zeros((0, len(TEMPLATES)))
            names, best, at = [], [], 0
            for own in lists:
                part = scores[at : at + len(own)]
                at += len(own)
                top = part.max() if len(own) else 0.0
                hit = top >= least
                # Ties go to the template that stands first.
                names.append(TEMPLATES[int(np.argmax(part.max(axis=0) >= top - 1e-12))][0] if hit else None)
                best.append(round(float(top), 6) if hit else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(best, pa.float64())],
                names=[*batch.schema.names[:-1], "own_license", "score"])

    return run


def scan_licenses(files: DataFrame, is_license_file: Column | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """``doc_id path license score origin from_dir``, a row per row of ``files`` (``doc_id, path, text``).

    ``origin`` is ``own`` (a statement in the text), ``inherited`` (from the nearest directory at or
    above the file's with a licence file: ``from_dir``) or ``none``. Which files count as licence
    files is by name unless ``is_license_file`` says so. Of several statements the best match counts,
    of several licence files of a directory the best, ties by licence name. Null texts state nothing;
    a null path inherits nothing. Other columns are ignored.
    """
    marks = F.col("path").rlike(FILE_NAMES) if is_license_file is None else is_license_file
    found = stored(files.select(
        F.col("doc_id").cast("long"), F.col("path").cast("string"), F.coalesce(marks, F.lit(False)).alias("is_file"),
        sentences(F.col("text")).alias("sentences")), "license-sentences")
    idf = inverse_frequencies(found)
    own = stored(
        found.mapInArrow(_match(idf, least), "doc_id long, path string, is_file boolean, own_license string, score double")
        .withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "license-matches")
    licensed = stored(
        own.where("is_file and own_license is not null and path is not null").groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own_license").alias("license"))).alias("x"))
        .select(F.col("dir").alias("from_dir"), "x.license"), "licensed-directories")
    # Ancestors of each directory, itself first in depth; the empty name is the root.
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = own.where("path is not null").select("dir").distinct().withColumn("parts", parts).select(
        "dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.struct(
            n.alias("depth"), F.array_join(F.slice("parts", F.lit(1), n), "/").alias("name")))).alias("a"))
    nearest = stored(
        above.join(licensed, F.col("a.name") == F.col("from_dir")).groupBy("dir")
        .agg(F.max(F.struct("a.depth", "license", "from_dir")).alias("x")).select("dir", "x.license", "x.from_dir"), "nearest-license")
    rows = own.join(nearest, "dir", "left")
    has_own, inherits = F.col("own_license").isNotNull(), F.col("license").isNotNull() & F.col("path").isNotNull()
    return rows.select(
        "doc_id", "path", F.when(has_own, F.col("own_license")).when(inherits, F.col("license")).alias("license"), "score",
        F.when(has_own, "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(~has_own & inherits, F.col("from_dir")).alias("from_dir"))
