"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain
from pathlib import Path
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.common import free_name, slices, small_batches, written

#: Notices of licences as they commonly stand in files (fixed values). An SPDX line of each identifier is added by rule.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "BSD-2-Clause": ("Use of this source code is governed by the BSD 2-Clause License.",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Distributed under the zlib License."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",),
    "PostgreSQL": ("Released under the PostgreSQL License.",),
    "WTFPL": ("This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-ND-4.0": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide. CC0 1.0 Universal.",),
}
#: Full texts of licences, a file each, named by identifier.
TEXTS = Path(__file__).parent / "license_texts"
#: Section 13 of the Affero licence, in which it differs from the General Public License besides its name.
AFFERO_13 = "Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."
#: Cosine from which a passage is a licence notice, and a whole text a licence file.
NOTICE, FILE = 0.8, 0.75
#: Directories that inherit up to which they are broadcast (a few hundred bytes each), and parts of each beyond it.
BROADCAST_FOLDERS, SALTS = 100_000, 32
#: Letters and digits make terms, of other bytes those beyond ASCII; a-z stand for A-Z; line feeds stay.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() or c == 10 else 32 for c in (b + 32 if 65 <= b <= 90 else b for b in range(256)))


def lines_of(text: str | None) -> list[list[bytes]]:
    """Terms of each line of a text."""
    return [x.split() for x in (text or "").encode().translate(_TABLE).split(b"\n")]


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def notices() -> list[tuple[str, str]]:
    """(licence, text) of all notices."""
    out = [(name, text) for name, texts in TEMPLATES.items() for text in texts]
    for name in TEMPLATES:
        kinds = ("-only", "-or-later") if "GPL-" in name else ("",)
        out += [(name, f"SPDX-License-Identifier: {name}{kind}") for kind in kinds]
    return out


def full_texts() -> list[tuple[str, str]]:
    """(licence, whole text) of licence files."""
    out = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    gpl = dict(out)["GPL-3.0"]
    affero = gpl.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public").replace("Use with the GNU Affero Affero General Public License.", AFFERO_13)
    return [*out, ("AGPL-3.0", affero)]


def vectors_of(texts: list[str], idf: dict[bytes, float]) -> dict[bytes, list[tuple[int, float]]]:
    """For each term the templates that have it, with its share of their vector of length 1."""
    postings: dict[bytes, list[tuple[int, float]]] = {}
    for k, text in enumerate(texts):
        own = {t: c * idf[t] for t, c in Counter(terms(text)).items()}
        norm = math.sqrt(sum(w * w for w in own.values()))
        for t, w in own.items():
            postings.setdefault(t, []).append((k, w / norm))
    return postings


class Scorer(NamedTuple):
    """Weights of terms from the corpus and vectors of templates, in plain types: idf of the templates' terms, weight of other terms, postings and licences of notices and of files, terms of a passage of lines at most."""

    idf: dict
    rest: float
    notice_postings: dict
    notice_names: list
    file_postings: dict
    file_names: list
    longest: int

    @classmethod
    def of(cls, n: int, df: dict[bytes, int]) -> Scorer:
        """From the number of texts and how many have each term of the templates."""
        short, long = notices(), full_texts()
        every = short + long
        idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, text in every for t in terms(text)}
        return cls(idf, math.log(1 + n) + 1, vectors_of([x for _, x in short], idf), [k for k, _ in short], vectors_of([x for _, x in every], idf), [k for k, _ in every], 2 * max(len(terms(x)) for _, x in short))

    def bound(self, found: list[bytes]) -> float:
        """At least the square of a passage's greatest cosine to a notice: the weight that notices' terms have in it; 0 without any."""
        known = self.notice_postings.keys() & found
        if not known:
            return 0.0
        counts = [(found.count(t), self.idf[t]) for t in known]
        weight = sum((c * w) ** 2 for c, w in counts)
        return weight / (weight + (len(found) - sum(c for c, _ in counts)) * self.rest**2)

    def may_be_file(self, lines: list[list[bytes]]) -> bool:
        """Whether the terms of file templates weigh enough in a text for its cosine to reach FILE."""
        count = sum(map(len, lines))
        known = Counter(t for t in chain.from_iterable(lines) if t in self.file_postings) if count else None
        if not known:
            return False
        weight = sum((c * self.idf[t]) ** 2 for t, c in known.items())
        return weight >= FILE * FILE * (weight + (count - known.total()) * self.rest**2)

    def best(self, counts: Counter, files: bool = False) -> tuple[float, str | None]:
        """The greatest cosine of a passage's terms to a notice (or to a notice or full text) and its licence; the earlier template of equals. Terms of no such template count as the rarest."""
        postings, names = (self.file_postings, self.file_names) if files else (self.notice_postings, self.notice_names)
        own = {t: c * (self.idf[t] if t in postings else self.rest) for t, c in counts.items()}
        sums: dict[int, float] = {}
        for t in postings.keys() & own.keys():
            for k, v in postings[t]:
                sums[k] = sums.get(k, 0.0) + own[t] * v
        if not sums:
            return 0.0, None
        k = min(sums, key=lambda k: (-round(sums[k], 12), k))
        return min(1.0, sums[k] / math.sqrt(sum(w * w for w in own.values()))), names[k]

    def passage(self, lines: list[tuple[int, list[bytes], float]], least: float) -> tuple[float, str | None, int | None]:
        """The best run of two lines or more with a cosine over `least`, its licence and first line, from (line, terms, bound).

        Runs hold `longest` terms at most. A run's squared cosine is at most the sum of its lines' bounds, so only runs with enough of them are scored.
        """
        top, name, at = least, None, None
        sizes = [0, *accumulate(len(found) for _, found, _ in lines)]
        sums = [0.0, *accumulate(bound for *_, bound in lines)]
        end = 0
        for i, (line, found, bound) in enumerate(lines):
            # a run from here ends before `end`, which only moves on; without bound enough up to there none is scored
            end = max(end, i + 1)
            while end < len(lines) and sizes[end + 1] - sizes[i] <= self.longest:
                end += 1
            if not bound or sums[end] - sums[i] + 1e-9 <= top * top:
                continue
            run, total = list(found), bound
            for j in range(i + 1, end):
                _, more, own = lines[j]
                run += more
                total += own
                if own and total > top * top:
                    cosine, licence = self.best(Counter(run))
                    if round(cosine, 9) > round(top, 9):
                        top, name, at = cosine, licence, line
        return top, name, at


def corpus_weights(docs: DataFrame, text: str = "text") -> Scorer:
    """A scorer with document frequencies of the templates' terms over all texts that are not empty. The result is as large as the templates' vocabulary."""

    vocabulary = frozenset(t for _, x in notices() + full_texts() for t in terms(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for x in part.column("text").to_pylist():
                    if x:
                        n += 1
                        found.update(vocabulary.intersection(terms(x)))
        found[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    with small_batches(docs.sparkSession):
        rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r.term): r.n for r in rows}
    return Scorer.of(df.pop(b"", 0), df)


def scan_texts(docs: DataFrame, scorer: Scorer, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all if None) with notice (licence of the best line, if its cosine is NOTICE or more), cosine, notice_line and file_license.

    Each line of the whole text with a term of the notices is a passage, whatever the corpus's size and the term's frequency, and
    so are runs of lines (a wrapped notice; comment marks are no terms) that reach NOTICE and beat each line: notice_line is the first
    of them. The text as a whole is held against notices and full licence texts: if that reaches FILE, the row is a licence file.
    Only passages that can't beat the best are left out.
    Null and empty texts have none (cosine 0). Of equally good lines the first counts. Taken names get leading underscores.
    Run it under small_batches: whole Arrow batches are in a worker's memory.
    """
    src = docs.select(*(docs.columns if keep is None else keep), docs[text].alias(inner := free_name(docs, "text__")))
    fields = [("notice", T.StringType()), ("cosine", T.DoubleType()), ("notice_line", T.IntegerType()), ("file_license", T.StringType())]
    schema = T.StructType([*src.drop(inner).schema.fields, *[T.StructField(free_name(src, c), kind) for c, kind in fields]])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(scorer))  # plain types, as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*shared.value)
        for batch in batches:
            for part in slices(batch, inner):
                out: list[tuple] = []
                for x in part.column(inner).to_pylist():
                    top, name, at, whole = 0.0, None, None, None
                    lines = lines_of(x)
                    bounds = list(map(own.bound, lines))
                    for i, found in enumerate(lines):
                        if bounds[i] > top * top:
                            cosine, licence = own.best(Counter(found))
                            if cosine > top:
                                top, name, at = cosine, licence, i
                    if sum(bounds) > NOTICE * NOTICE:
                        full = [p for p in zip(range(len(lines)), lines, bounds, strict=True) if p[1]]
                        cosine, licence, start = own.passage(full, max(top, NOTICE))
                        if start is not None:
                            top, name, at = cosine, licence, start
                    if own.may_be_file(lines):
                        cosine, licence = own.best(Counter(chain.from_iterable(lines)), files=True)
                        whole = licence if cosine >= FILE else None
                    hit = top >= NOTICE
                    out.append((name if hit else None, round(top, 9), at if hit else None, whole))
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                arrays = [part.column(i) for i, c in enumerate(part.schema.names) if c != inner]
                kinds = (pa.string(), pa.float64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    return src.mapInArrow(run, schema)


def inherit(files: DataFrame, path: str = "path", own: str = "file_license") -> DataFrame:
    """files with inherited and inherited_from: the licence of the nearest directory above (its own first) that has a licence file.

    A directory with licence files of several kinds passes the one that comes first by name. Paths are joined by directory, once
    for each distinct directory and not for each file; files is written once first. A null path inherits nothing.
    """
    folder, licence, origin = (free_name(files, c) for c in ("folder__", "inherited", "inherited_from"))
    with small_batches(files.sparkSession):
        rows = written(files.withColumn(folder, F.regexp_replace(path, "/?[^/]*$", "")), "files")
    givers = rows.where(F.col(own).isNotNull() & F.col(path).isNotNull()).groupBy(F.col(folder).alias("up")).agg(F.min(own).alias(licence))
    parts = F.split("dir", "/")
    dirs = rows.where(F.col(path).isNotNull()).groupBy(F.col(folder).alias("dir")).agg(F.count("*").alias("n"))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("up"))
    nearest = above.join(givers, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", licence)).alias("best"))
    passed = nearest.select(F.col("dir").alias(folder), F.col(f"best.{licence}").alias(licence), F.col("best.up").alias(origin))
    passed = written(passed, "passed")
    if passed.count() <= BROADCAST_FOLDERS:
        return rows.join(F.broadcast(passed), folder, "left").drop(folder)
    # a directory with very many files is spread over SALTS tasks
    salt = free_name(rows, "salt__")
    salted = passed.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(path), F.lit(SALTS)).cast("int")).join(salted, [folder, salt], "left").drop(folder, salt)
