"""Licence scan: TF-IDF cosine of headers and licence files to templates, nearest-ancestor inheritance.

DataFrame and SQL functions only.

Method
  * Segments of a file are its lines; a file with a licence file's name is a
    segment as a whole too.  Terms are lower-case words that may hold dots and
    hyphens.  A term's inverse document frequency, ln((N+1)/(df+1)) + 1, counts
    the lines of all files; a term that no template has weighs like an unseen
    one, so a line's other words lower its cosine.
  * With ``windows`` the terms of the whole text, across line breaks, are
    segments too: for each template every run of as many terms as it has, so a
    notice inside a long line, in a text of one line or wrapped over lines is
    compared without the words around it.  A window is compared with its own
    template.  After "SPDX-License-Identifier" the identifier is looked up as
    it is (score 1; of an expression the first).  Without ``windows`` a notice
    that shares its line with many other words is not found.
  * Each segment is compared with every template as a sparse vector inside its
    row, without a shuffle.  Only segments with a key term are: a template's
    key terms are its heaviest ones, so many that the norm of the rest is below
    ``THRESHOLD`` of the whole; by Cauchy-Schwarz a segment without any of them
    cannot reach the threshold, so the filter loses nothing.
  * A folder has the licence of its best licence file.  Distinct folders are
    joined with their ancestors' paths, and the deepest licensed ancestor (the
    folder itself first) wins; files without a licence of their own take their
    folder's.

The templates are configuration: their terms (a few hundred) and weights are
literals of the plan; document frequencies are only collected for them.

Defined cases: null, empty and blank texts have no licence of their own and
inherit; a null path has no folder, hence nothing to inherit.  Equal scores tie by
licence name, folders' licence files by score, then licence, then path.
Repeated rows are judged each.  Without lines every frequency is 0.  Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcat.llm.runtime import written

THRESHOLD = 0.6
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_NAMES = r"^(?:licen[cs]e|copying|notice)(?:\.(?:txt|md))?$"

# Notices and opening sentences of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

# Identifiers after "SPDX-License-Identifier", looked up by ``windows``.
SPDX = {"apache-2.0": "Apache-2.0", "bsd-3-clause": "BSD-3-Clause", "cc-by-4.0": "CC-BY-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0",
        "cc-by-sa-4.0": "CC-BY-SA-4.0", "gpl-3.0": "GPL-3.0", "gpl-3.0-only": "GPL-3.0", "gpl-3.0-or-later": "GPL-3.0", "mit": "MIT", "mpl-2.0": "MPL-2.0"}


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}', 0)"


def _template_terms(templates) -> list[tuple[str, dict[str, int]]]:
    out = []
    for name, text in templates:
        tf: dict[str, int] = {}
        for t in re.findall(TERM, text.translate({c: c + 32 for c in range(65, 91)})):
            tf[t] = tf.get(t, 0) + 1
        out.append((name, tf))
    return out


def _strings(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """(lines of all files, lines that hold each term of the vocabulary)."""
    lines = "filter(split(text, '\\n'), x -> length(trim(x)) > 0)"
    held = f"flatten(transform({lines}, x -> array_intersect({_terms('x')}, {_strings(vocabulary)})))"
    n = files.agg(F.sum(F.expr(f"size({lines})"))).first()[0] or 0
    rows = files.select(F.explode(F.expr(held)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()  # one row per template term
    return max(0, n), {r["term"]: r["df"] for r in rows}


def _weight_map(weights: dict[str, float]) -> str:
    return "map(" + ", ".join(f"'{t}', {w!r}D" for t, w in sorted(weights.items())) + ")"


def _cosine(tf: dict[str, int], idf: dict[str, float]) -> str:
    """SQL for the cosine of a segment's vector ``q`` (array of term t, weight w) to a template."""
    norm = "sqrt(aggregate(q, 0D, (a, x) -> a + x.w * x.w))"
    own = {t: n * idf[t] for t, n in tf.items()}
    length = math.sqrt(sum(w * w for w in own.values()))
    unit = _weight_map({t: w / length for t, w in own.items()})
    return f"round(aggregate(q, 0D, (a, x) -> a + x.w * coalesce({unit}[x.t], 0D)) / {norm}, 6)"


def _cosines(templates, idf: dict[str, float]) -> str:
    """SQL for the array of (score, licence) of a segment's vector ``q``."""
    return "array(" + ", ".join(f"struct({_cosine(tf, idf)} as score, '{name}' as licence)" for name, tf in templates) + ")"


def _window_scores(templates, idf: dict[str, float], threshold: float, weight: str) -> str:
    """SQL for the array of (score, licence) of the best window of each template over the terms ``words``, and of SPDX identifiers."""
    out = []
    for name, tf in templates:
        size = sum(tf.values())
        keys = ", ".join(f"'{t}'" for t in key_terms([(name, tf)], idf, threshold))
        at = f"filter(sequence(1, size(words)), i -> get(words, i - 1) in ({keys}))"
        # the starts of every window that holds a key term, each once; a shorter text is one window
        first, last = f"greatest(1, p - {size - 1}, coalesce(get(k, j - 1), 0) + 1)", f"least(p, greatest(1, size(words) - {size - 1}))"
        starts = f"flatten(flatten(transform(array({at}), k -> transform(k, (p, j) -> if({first} > {last}, array(), sequence({first}, {last}))))))"
        # one window at a time, so that a long text's windows are never held together
        vector = f"transform(array(slice(words, i, {size})), s -> transform(array_distinct(s), t -> struct(t as t, {weight} as w)))"
        out.append(f"struct(array_max(transform({starts}, i -> get(transform({vector}, q -> {_cosine(tf, idf)}), 0))) as score, '{name}' as licence)")
    names = {name for name, _ in templates}
    spdx = ", ".join(f"'{k}', '{v}'" for k, v in SPDX.items() if v in names)
    found = f"array({', '.join(out)})"
    if spdx:
        at = "filter(sequence(1, size(words)), i -> get(words, i - 1) = 'spdx-license-identifier')"
        found = f"concat({found}, filter(transform({at}, i -> struct(1D as score, map({spdx})[get(words, i)] as licence)), c -> c.licence is not null))"
    return found


def key_terms(templates, idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which every segment that reaches the threshold with some template holds one."""
    keys = set()
    for _, tf in templates:
        w = sorted(((n * idf[t], t) for t, n in tf.items()), reverse=True)
        total = sum(x * x for x, _ in w)
        rest = total
        for x, t in w:
            if math.sqrt(max(rest, 0) / total) < threshold - 1e-6:
                break
            keys.add(t)
            rest -= x * x
    return sorted(keys)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^((?:[^/]*/)*)[^/]*$", 1)


_BEST_FIRST = ("case when a.score > b.score or (a.score = b.score and a.licence < b.licence) then -1 "
               "when a.score = b.score and a.licence = b.licence then 0 else 1 end")


def own_licences(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """Per file: file_id, path, is_licence_file, own (score, licence of the best segment, or null)."""
    files = files.select("file_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    temps = _template_terms(templates)
    vocabulary = sorted({t for _, tf in temps for t in tf})
    n, df = document_frequencies(files, vocabulary)
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    unseen = math.log(n + 1) + 1
    keys = _strings(key_terms(temps, idf, threshold))
    name = F.regexp_extract(F.lower("path"), r"([^/]*)$", 1)
    lines = "split(text, '\\n')"
    weight = f"size(filter(s, u -> u = t)) * coalesce({_weight_map(idf)}[t], {unseen!r}D)"
    found = files.withColumn("is_licence_file", F.coalesce(name.rlike(LICENCE_NAMES), F.lit(False))) \
        .withColumn("segments", F.expr(f"if(is_licence_file, concat({lines}, array(text)), {lines})")) \
        .withColumn("near", F.expr(f"filter(transform(segments, x -> {_terms('x')}), s -> arrays_overlap(s, {keys}))")) \
        .withColumn("vectors", F.expr(f"transform(near, s -> transform(array_distinct(s), t -> struct(t as t, {weight} as w)))")) \
        .withColumn("scored", F.expr(f"filter(flatten(transform(vectors, q -> {_cosines(temps, idf)})), c -> c.score >= {threshold!r}D)"))
    if windows:
        held = f"arrays_overlap(words, {_strings([*key_terms(temps, idf, threshold), 'spdx-license-identifier'])})"
        found = found.withColumn("words", F.expr(_terms("text"))) \
            .withColumn("inside", F.expr(f"if({held}, filter({_window_scores(temps, idf, threshold, weight)}, c -> c.score >= {threshold!r}D), null)")) \
            .withColumn("scored", F.expr("concat(scored, coalesce(inside, array()))"))
    return found.select("file_id", "path", "is_licence_file", F.expr(f"try_element_at(array_sort(scored, (a, b) -> {_BEST_FIRST}), 1)").alias("own"))


def folder_licences(own: DataFrame) -> DataFrame:
    """Per folder of a file that has a licensed ancestor folder: folder, licence_folder, licence (of the deepest)."""
    licensed = own.where("is_licence_file and own is not null and path is not null").groupBy(_folder(F.col("path")).alias("licence_folder")).agg(
        F.min(F.struct((-F.col("own.score")).alias("s"), F.col("own.licence").alias("licence"), F.col("path").alias("p")))["licence"].alias("folder_licence"))
    folders = own.where("path is not null").select(_folder(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    return folders.withColumn("licence_folder", F.explode(above)).join(licensed, "licence_folder").groupBy("folder").agg(
        F.max(F.struct(F.length("licence_folder").alias("depth"), "licence_folder", "folder_licence")).alias("near")).select(
        "folder", F.col("near.licence_folder").alias("licence_folder"), F.col("near.folder_licence").alias("folder_licence"))


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """Per file (file_id, path, text): file_id, path, own_licence, score, licence, origin, licence_folder.

    ``origin``: licence file, header, inherited or none.
    """
    own = written(own_licences(files, templates, threshold, windows), "licences")
    rows = own.withColumn("folder", _folder(F.col("path"))).join(folder_licences(own), "folder", "left")
    has = F.col("own").isNotNull()
    return rows.select(
        "file_id", "path", F.col("own.licence").alias("own_licence"), F.col("own.score").alias("score"),
        F.coalesce("own.licence", "folder_licence").alias("licence"),
        F.when(has & F.col("is_licence_file"), "licence file").when(has, "header").when(F.col("folder_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("licence_folder")).alias("licence_folder"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / language / folders by the digits of the id.

    Each id that ends in 0 is the licence file of its folder, one more 0 of the folder above.
    """
    top = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("unknown")), F.lit("/"))
    hundred = F.concat(top, F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"))
    ten = F.concat(hundred, F.floor(F.col("doc_id") / 10).cast("string"), F.lit("/"))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("LICENSE"))) \
        .when(F.col("doc_id") % 100 == 0, F.concat(hundred, F.lit("LICENSE"))).when(F.col("doc_id") % 10 == 0, F.concat(ten, F.lit("LICENSE"))) \
        .otherwise(F.concat(ten, F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
