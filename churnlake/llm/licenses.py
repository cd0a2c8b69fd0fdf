"""Licence scan: TF-IDF cosine of licence headers to templates, then inheritance down directories (DataFrame functions only).

A text is cut into lines and sentences. Those with a licence cue are headers; each is compared, as a sparse
TF-IDF vector, with every template, inside its row: the templates are a fixed short list, so
their weights are a literal map and no row moves. The best header decides a document's own licence.

A document that mostly consists of its headers, or is named like a licence file, is the licence file of its directory.
Documents without a licence of their own take that of the nearest directory above them that has a licence
file. This is found by joining paths: first once per distinct directory, over its ancestors, then once per document.

Defined cases: NULL and empty texts have no header; a NULL path has no directory and inherits nothing; several licence files
in one directory: greatest similarity, then the licence name that sorts first; repeated rows give repeated rows; an
empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.llm.tables import bound

#: Notices, titles and usual lines of public licences, fixed values. A title without a version names the family.
NOTICES = (
    ("AGPL-3.0", "GNU Affero General Public License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "You may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("GPL", "GNU General Public License"),
    ("GPL", "it under the terms of the GNU General Public License as published by"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version."),
    ("ISC", "ISC License"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL", "GNU Lesser General Public License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "zlib License"),
)
#: Names that stand as an identifier line: SPDX-License-Identifier and the name.
IDENTIFIERS = ("AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
               "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
               "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES = NOTICES + tuple((re.sub("-(only|or-later)$", "", n), f"SPDX-License-Identifier: {n}") for n in IDENTIFIERS)
CUE = r"(?i)licen[sc]e|spdx|permission is hereby|permission to use|redistribution and use|public domain"
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?"
LICENCE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
SIMILAR = 0.75
FILE_SHARE = 0.3


def template_terms() -> dict[str, list[float]]:
    """For each term of the templates: its weight in every normalised template vector."""
    counts = [Counter(re.findall(TOKEN, text.lower())) for _, text in TEMPLATES]
    weights = [{t: n * term_idf(t) for t, n in c.items()} for c in counts]
    norms = [math.sqrt(sum(w * w for w in ws.values())) for ws in weights]
    terms = sorted(set().union(*counts))
    return {t: [ws.get(t, 0.0) / norm for ws, norm in zip(weights, norms)] for t in terms}


def term_idf(term: str | None) -> float:
    """Inverse document frequency over the templates; of a term that none has, for None."""
    n = sum(term in re.findall(TOKEN, text.lower()) for _, text in TEMPLATES)
    return math.log((1 + len(TEMPLATES)) / (1 + n)) + 1


def segments(text: Column) -> Column:
    """Lines, and the sentences of a line."""
    return F.split(F.regexp_replace(text, r"([.;!?])[ \t]+", "$1\n"), "\n", -1)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _best_template(segment: Column) -> Column:
    """(similarity, template index, words) of the template nearest to a segment; ties go to the first template."""
    table, n = template_terms(), len(TEMPLATES)
    # literal arrays, each folded from one string
    names = F.split(F.lit(" ".join(table)), " ")
    idfs = F.split(F.lit(" ".join(repr(term_idf(t)) for t in table)), " ").cast("array<double>")
    rows = F.split(F.lit(" ".join(repr(w) for ws in table.values() for w in ws)), " ").cast("array<double>")

    def score(terms):
        distinct = F.array_distinct(terms)
        nth = lambda t: F.array_position(names, t).cast("int")
        weight = lambda t: F.size(F.filter(terms, lambda x: x == t)) * F.coalesce(
            F.get(idfs, nth(t) - 1), F.lit(term_idf(None)))
        norm = F.sqrt(F.aggregate(distinct, F.lit(0.0), lambda total, t: total + bound(weight(t), lambda w: w * w)))
        known = F.filter(distinct, lambda t: nth(t) > 0)
        none = F.split(F.lit(" ".join(["0.0"] * n)), " ").cast("array<double>")
        dots = F.aggregate(known, none, lambda total, t: bound(F.struct(weight(t).alias("w"), nth(t).alias("i")), lambda x: F.zip_with(
            total, F.slice(rows, (x["i"] - 1) * n + 1, n), lambda a, b: a + x["w"] * b)))
        ranked = lambda length: F.transform(dots, lambda d, i: F.struct(
            F.round(d / length, 6).alias("similarity"), (-i).alias("first"), i.alias("template")))
        return F.when(F.size(terms) > 0, F.array_max(bound(norm, ranked)))

    return bound(_terms(segment), score)


def headers(df: DataFrame, text_col: str = "text", name: str = "_licence") -> DataFrame:
    """``df`` with a struct ``name``: licence and similarity of the best header, and the share of words in matching headers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cued = F.when(text.rlike(CUE), F.filter(segments(text), lambda s: s.rlike(CUE)))
    scored = F.transform(cued, lambda s: F.struct(_best_template(s).alias("best"), F.size(_terms(s)).alias("words")))
    matching = F.filter(F.col(f"{name}_all"), lambda h: h["best"]["similarity"] >= SIMILAR)
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    words = F.size(F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    top = F.array_max(F.transform(F.col(f"{name}_m"), lambda h: h["best"]))
    return (df.withColumn(f"{name}_all", scored).withColumn(f"{name}_m", matching)
            .withColumn(name, F.when(F.size(f"{name}_m") > 0, F.struct(
                F.get(names, top["template"]).alias("licence"), top["similarity"].alias("similarity"),
                (F.aggregate(F.col(f"{name}_m"), F.lit(0), lambda n, h: n + h["words"]) / words).alias("share"))))
            .drop(f"{name}_all", f"{name}_m"))


def parent_dir(path: Column) -> Column:
    """The path without its last part; NULL at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", ""))


def scan(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, licence, similarity, origin, origin_dir): origin is header, file, inherited or none."""
    rows = headers(df.select(F.col(id_col), F.col(path_col).alias("_path"), F.col(text_col).alias("_text")), "_text").select(
        id_col, F.col("_path").alias("path"), parent_dir(F.col("_path")).alias("dir"),
        "_licence.licence", "_licence.similarity",
        (F.col("_licence").isNotNull() & ((F.col("_licence.share") >= FILE_SHARE) | F.col("_path").rlike(LICENCE_NAME))
         ).alias("is_file"))
    files = rows.filter(F.col("is_file") & F.col("dir").isNotNull()).groupBy("dir").agg(
        F.min_by("licence", F.struct(-F.col("similarity"), "licence")).alias("file_licence"),
        F.max("similarity").alias("file_similarity"))
    dirs = rows.filter(F.col("licence").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/", -1)
    above = dirs.select("dir", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
            n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))).alias("a")).select("dir", "a.*")
    nearest = above.join(files.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(
        F.max_by(F.struct("above", "file_licence", "file_similarity"), "depth").alias("from"))
    own = F.col("licence").isNotNull()
    return rows.join(nearest, "dir", "left").select(
        id_col, "path", F.coalesce("licence", "from.file_licence").alias("licence"),
        F.coalesce("similarity", "from.file_similarity").alias("similarity"),
        F.when(F.col("is_file"), "file").when(own, "header").when(F.col("from").isNotNull(), "inherited")
        .otherwise("none").alias("origin"),
        F.when(own, F.col("dir")).otherwise(F.col("from.above")).alias("origin_dir"))
