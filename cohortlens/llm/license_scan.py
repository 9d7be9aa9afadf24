"""License scan: sparse TF-IDF cosine of notices to templates, then inheritance along folders."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import slices, stored, table
from cohortlens.llm.quality_rules import STOP_WORDS
from cohortlens.session import lookup_side

#: Usual notices of each licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
_GNU = (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"),
        ("AGPL", "GNU Affero General Public License"))
_GNU_DATES = (("GPL-2.0", "2, June 1991"), ("GPL-3.0", "3, 29 June 2007"), ("LGPL-2.1", "2.1, February 1999"),
              ("LGPL-3.0", "3, 29 June 2007"), ("AGPL-3.0", "3, 19 November 2007"))
_SPDX = ("Apache-2.0 Apache-1.1 MIT MIT-0 ISC Zlib BSL-1.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD MPL-1.1 MPL-2.0 "
         "EPL-1.0 EPL-2.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 "
         "CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 Unlicense WTFPL").split()
#: Titles, usual headers, SPDX lines and longer passages; compared with windows of their own length.
PASSAGES = (
    *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX),
    *((name, f"SPDX-License-Identifier: {name}{form}") for name, _ in (*_GNU_DATES, ("GPL-1.0", ""))
      for form in ("", "-only", "-or-later")),
    *((name, f"{dict(_GNU)[name.split('-')[0]]} Version {date}") for name, date in _GNU_DATES),
    *((f"{short}-{number}", f"you can redistribute it and/or modify it under the terms of the {title} as published by the "
       f"Free Software Foundation; {form}")
      for short, title in _GNU for number, word in (("2.0", "2"), ("2.1", "2.1"), ("3.0", "3"))
      if (short, number) in {(n.split("-")[0], n.split("-")[1]) for n, _ in _GNU_DATES}
      for form in (f"either version {word} of the License, or (at your option) any later version",
                   f"version {word} of the License")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, "
     "worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative "
     "Works of, publicly display, publicly perform, sublicense, and distribute the Work"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "The MIT License (MIT) Copyright (c)"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all "
     "of his or her rights to the work worldwide under copyright law"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
     "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
)
THRESHOLD = 0.8
#: Words that other texts hold often; they seed a window only where rarer ones do not suffice.
COMMON = frozenset(STOP_WORDS) | {"only", "nd"}
#: A file of such a name states the licence of its folder as a whole.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def tokens_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


class TemplateIndex:
    """Unit vectors of the templates; idf is taken over the templates, and a token of none of them
    weighs as one that a single template would hold."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        counts = [Counter(tokens_of(text)) for _, text in templates]
        times = Counter(t for c in counts for t in c)
        self.idf = {t: 1 + math.log((1 + len(counts)) / (1 + n)) for t, n in times.items()}
        self.other = 1 + math.log((1 + len(counts)) / 2)
        self.rows, anchors = [], set()
        for k, ((name, _), c) in enumerate(zip(templates, counts)):
            weights = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.rows += [(k, name, t, w / norm) for t, w in sorted(weights.items())]
            # a text with none of these reaches less than the threshold, whatever else it holds
            rest = 1.0
            for t in sorted(weights, key=lambda t: (-len(t), t)):
                if rest < threshold ** 2 - 1e-9:
                    break
                anchors.add(t)
                rest -= (weights[t] / norm) ** 2
        self.anchors = sorted(anchors)
        self.threshold = threshold
        self.names = [name for name, _ in templates]
        #: By token, the templates that hold it with its weight there; as bytes, for whole texts.
        self.holders: dict[bytes, list[tuple[int, float]]] = {}
        self.weights: list[dict[str, float]] = [{} for _ in templates]
        for k, _, t, w in self.rows:
            self.holders.setdefault(t.encode(), []).append((k, w))
            self.weights[k][t] = w
        #: By token of a template, where windows of the template start before it.
        self.seeds: dict[int, dict[str, list[int]]] = {}
        self.lengths = [sum(c.values()) for c in counts]
        #: Lines and pairs of them are compared with short notices already.
        self.breaks = [2 if t in TEMPLATES else 0 for t in templates]
        for k, ((_, text), c) in enumerate(zip(templates, counts)):
            words = tokens_of(text)
            rest, norm = 1.0, sum((n * self.idf[t]) ** 2 for t, n in c.items())
            # rare words before short and common ones; without any of them no window reaches the threshold
            for t in sorted(c, key=lambda t: (t in COMMON, len(t) < 3 or t.isdigit(), times[t], -len(t), t)):
                if rest < threshold ** 2 - 1e-9:
                    break
                self.seeds.setdefault(k, {})[t] = [at for at, word in enumerate(words) if word == t]
                rest -= (c[t] * self.idf[t]) ** 2 / norm

    def pattern(self) -> str:
        return f"(^|[^a-z0-9])({'|'.join(self.anchors)})([^a-z0-9]|$)"

    def possible(self, held: set[bytes]) -> list[int]:
        """Templates that a text with these tokens can reach: the root of a template's squared
        weights within a text bounds its cosine."""
        mass: dict[int, float] = {}
        for token in held & self.holders.keys():
            for k, w in self.holders[token]:
                mass[k] = mass.get(k, 0.0) + w * w
        return sorted(k for k, m in mass.items() if m >= self.threshold ** 2 - 1e-9)

    def best(self, tokens: list[str], templates: list[int], best: tuple[float, str] | None) -> tuple[float, str] | None:
        """(minus the rounded score, name) of the best of these templates that reaches the threshold, or
        `best` if that is better; the smallest name among equals."""
        held = set(tokens)
        near = [k for k in templates if sum(w * w for t, w in self.weights[k].items() if t in held) >= self.threshold ** 2 - 1e-9]
        if near:
            counts = Counter(tokens)
            weighed = {t: n * self.idf.get(t, self.other) for t, n in counts.items()}
            norm = math.sqrt(sum(w * w for w in weighed.values()))
            for k in near:
                score = sum(weighed[t] * w for t, w in self.weights[k].items() if t in weighed) / norm
                if score >= self.threshold - 1e-9:
                    found = (-round(score, 6), self.names[k])
                    best = found if best is None else min(best, found)
        return best


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# tokens are runs of letters and digits of ASCII; all else parts them
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def pieces(text: str) -> list[list[str]]:
    """Tokens of the sentences and lines of a whole text."""
    lines = re.split("[\r\n]+", re.sub(r"([.!?;])[ \t]+", "\\1\n", text.translate(_LOWER)))
    return [re.findall("[a-z0-9]+", line) for line in lines if line]


def stated_license(raw: bytes, index: TemplateIndex, passages: TemplateIndex) -> tuple[float, str] | None:
    """(minus the score, licence) of the best notice in a whole text.

    Each sentence or line, alone and with the one after it, is compared with `index`. Where none of
    these reaches the threshold, windows of words are compared with `passages`: each seed word of a
    template in the text lays one window of the template's length where the template would lie.
    """
    held = set(raw.translate(_FOLD).split())
    short, long_ = index.possible(held), passages.possible(held)
    if not short and not long_:
        return None  # few texts get past this
    parts = pieces(raw.decode())
    best = None
    for k, tokens in enumerate(parts):
        best = index.best(tokens, short, best) if short and tokens else best
        if short and k + 1 < len(parts):
            best = index.best(tokens + parts[k + 1], short, best)
    if best or not long_:
        return best
    words = [t for tokens in parts for t in tokens]
    piece = [k for k, tokens in enumerate(parts) for _ in tokens]
    places: dict[str, list[int]] = {}
    for i, word in enumerate(words):
        places.setdefault(word, []).append(i)
    for k in long_:
        length = passages.lengths[k]
        starts = {max(0, i - at) for seed, offsets in passages.seeds[k].items() for i in places.get(seed, ()) for at in offsets}
        for start in sorted(starts):
            stop = min(start + length, len(words))
            if piece[stop - 1] - piece[start] >= passages.breaks[k]:
                best = passages.best(words[start:stop], [k], best)
    return best


def own_licenses(files: DataFrame, index: TemplateIndex, passages: TemplateIndex) -> DataFrame:
    """(id, path, stated, license, score) of every row of (id, path, stated, text): the licence that
    the whole text states, null where none; worked out row by row, nothing is shuffled."""
    kind = files.schema["id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [stated_license(t, index, passages) if t else None for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([f and f[1] for f in found], pa.string()),
                 pa.array([None if f is None else -f[0] for f in found], pa.float64())],
                names=["id", "path", "stated", "license", "score"])

    return files.select("id", "path", "stated", F.col("text").cast("binary").alias("text")).mapInArrow(
        judge, f"id {kind}, path string, stated boolean, license string, score double")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, id_col: str, path: Column, text: str = "text", states_folder: Column | None = None,
         index: TemplateIndex | None = None, passages: TemplateIndex | None = None) -> DataFrame:
    """(id, path, own_license, own_score, license, origin, folder) of every row of `files`.

    A file has the licence that a notice in its whole text states (origin `own`): a line, a sentence
    or two of them against `index`, and in texts where none of these does, windows of words against
    `passages`, by default PASSAGES, and TEMPLATES over three lines or more. Otherwise it has that of
    the nearest folder above it, its own first, for which a licence file in the folder states one
    (`inherited`, with that folder); otherwise none (`none`). Files named like LICENSE or COPYING,
    or those that `states_folder` selects, are licence files; of several in one folder the smallest
    path counts. Null text has no notice, null path no folder. Repeated rows are judged alike.
    """
    index = index or TemplateIndex()
    passages = passages or TemplateIndex(TEMPLATES + PASSAGES)
    stated = F.rlike(F.col("path"), F.lit(LICENSE_FILE)) if states_folder is None else states_folder
    rows = files.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), F.col(text).alias("text"),
                        F.coalesce(stated, F.lit(False)).alias("stated"))
    named = stored(own_licenses(rows, index, passages).withColumn("dir", folder_of(F.col("path"))))
    licensed = stored(named.where("stated and license is not null and path is not null").groupBy("dir").agg(
        F.min(F.struct("path", "license")).alias("b")).select(F.col("dir").alias("folder"), F.col("b.license").alias("given")))
    # every distinct folder meets its ancestors; the deepest that states a licence gives it
    folders = named.where("path is not null and license is null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = folders.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select(
        "dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("folder"))
    nearest = above.join(lookup_side(licensed), "folder").groupBy("dir").agg(
        F.max(F.struct("depth", "folder", "given")).alias("b")).select(
        "dir", F.col("b.folder").alias("folder"), F.col("b.given").alias("given"))
    joined = named.join(stored(nearest), "dir", "left")
    inherits = F.col("license").isNull() & F.col("given").isNotNull()
    return joined.select(
        "id", "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"),
        F.coalesce("license", "given").alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("folder")).alias("folder"))


def document_path() -> Column:
    """Documents as files: source / thousands / two hundreds / id."""
    doc = F.col("doc_id")
    return F.concat_ws("/", "source", F.floor(doc / 1000).cast("string"), F.floor(doc / 200).cast("string"),
                       F.concat(doc.cast("string"), F.lit(".txt")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in `document_path`; each that states a licence itself is a licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return scan(docs, "doc_id", document_path(), states_folder=F.lit(True)).withColumnRenamed("id", "doc_id")


def tree_path() -> Column:
    """Documents as files of a tree whose inner folders hold files too: source / five thousands /
    five hundreds / hundreds / id, of which every fifth document of a source stops at one of the
    three folders above."""
    doc = F.col("doc_id")
    turn = F.floor(doc / 20) % 15
    steps = [F.when(turn >= k, F.floor(doc / size).cast("string")) for k, size in enumerate((5000, 500, 100), 1)]
    return F.concat_ws("/", "source", *steps, F.concat(doc.cast("string"), F.lit(".txt")))


def tree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in `tree_path`; each that states a licence itself is a licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return scan(docs, "doc_id", tree_path(), states_folder=F.lit(True)).withColumnRenamed("id", "doc_id")


def _oracle(path: str) -> str:
    index = TemplateIndex()
    idf = ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in sorted(index.idf.items()))
    rows = ", ".join(f"({k}, '{name}', '{t}', {w!r}::DOUBLE)" for k, name, t, w in index.rows)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH idf(token, idf) AS (VALUES {idf}), template(k, name, token, weight) AS (VALUES {rows}),
docs AS (SELECT doc_id, {path} AS path, {lower} AS t FROM documents),
pieces AS (SELECT doc_id, list_filter(regexp_split_to_array(
    regexp_replace(t, '([.!?;])[ \\t]+', '\\1' || chr(10), 'g'), '[\\r\\n]+'), lambda s: s <> '') AS p FROM docs),
units AS (SELECT doc_id, i, u FROM (
    SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS u FROM pieces UNION ALL
    SELECT doc_id, len(p) + i, p[i + 1] || ' ' || p[i + 2] FROM pieces, range(1000000) r(i) WHERE i + 1 < len(p))),
tokens AS (SELECT doc_id, i, unnest(list_filter(regexp_split_to_array(u, '[^a-z0-9]+'), lambda s: s <> '')) AS token
  FROM units WHERE regexp_matches(u, '{index.pattern()}')),
weighed AS (SELECT doc_id, i, token, count(*) * coalesce(any_value(idf), {index.other!r}) AS w
  FROM tokens LEFT JOIN idf USING (token) GROUP BY ALL),
norms AS (SELECT doc_id, i, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
scored AS (SELECT doc_id, i, k, name, sum(w * weight) / any_value(norm) AS score
  FROM weighed JOIN template USING (token) JOIN norms USING (doc_id, i) GROUP BY ALL),
own AS (SELECT doc_id, name AS license, score FROM (
    SELECT doc_id, name, round(score, 6) AS score,
      row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, name) AS nth
    FROM scored WHERE score >= {THRESHOLD} - 1e-9) WHERE nth = 1),
named AS (SELECT d.*, license, score, regexp_replace(path, '/?[^/]*$', '') AS dir FROM docs d LEFT JOIN own USING (doc_id)),
licensed AS (SELECT dir AS folder, arg_min(license, path) AS given FROM named WHERE license IS NOT NULL GROUP BY 1),
nearest AS (SELECT doc_id, arg_max(folder, length(folder)) AS folder, arg_max(given, length(folder)) AS given
  FROM named JOIN licensed ON license IS NULL AND (dir = folder OR starts_with(dir, folder || '/')) GROUP BY 1)
SELECT doc_id, path, license AS own_license, score AS own_score, coalesce(license, given) AS license,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, folder
FROM named LEFT JOIN nearest USING (doc_id)"""


ORACLE = _oracle("source || '/' || (doc_id // 1000) || '/' || (doc_id // 200) || '/' || doc_id || '.txt'")
_TURN = "(doc_id // 20) % 15"
TREE_ORACLE = _oracle(
    f"concat_ws('/', source, CASE WHEN {_TURN} >= 1 THEN (doc_id // 5000)::VARCHAR END, "
    f"CASE WHEN {_TURN} >= 2 THEN (doc_id // 500)::VARCHAR END, "
    f"CASE WHEN {_TURN} >= 3 THEN (doc_id // 100)::VARCHAR END, doc_id || '.txt')")
