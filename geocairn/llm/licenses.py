"""License scans by sparse TF-IDF cosine and directory inheritance, with built-in functions only."""

from __future__ import annotations

import math
import os
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geocairn.plans.session import materialize

# Headers and openings of licence texts; whole texts lie in TEXT_FOLDER.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
)
#: Whole licence texts, by name; a file may match these as a whole.
TEXT_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
#: Most adjacent lines that a wrapped header is looked for in.
HEADER_LINES = 6
#: Cosine from which a line is a header, and a whole text a licence file.
HEADER = 0.75
FILE = 0.5
_TERM = r"[a-z0-9]+"


def terms(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_TERM})"), F.lit(1))


def weights(templates, frequency: dict[str, int], n_docs: int, least: float = FILE):
    """(idf by term, [(name, text, {term: tf * idf}, norm)], terms without which no cosine reaches ``least``)."""
    vocabulary = sorted({t for _, text in templates for t in terms(text)})
    idf = {t: math.log((1 + n_docs) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary}
    vectors = []
    for name, text in templates:
        vector = {t: terms(text).count(t) * idf[t] for t in set(terms(text))}
        vectors.append((name, text, vector, math.sqrt(sum(w * w for w in vector.values()))))
    common: set[str] = set()
    for t in sorted(vocabulary, key=lambda t: (idf[t], t)):
        more = common | {t}
        # by Cauchy-Schwarz a text with none but these terms stays below the threshold
        if any(sum(v.get(c, 0) ** 2 for c in more) >= (0.99 * least * norm) ** 2 for _, _, v, norm in vectors):
            break
        common = more
    return idf, vectors, [t for t in vocabulary if t not in common]


def whole_texts(folder: str = TEXT_FOLDER) -> tuple[tuple[str, str], ...]:
    """(name, text) of the licence texts beside this module, read on the driver."""
    out = []
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out.append((name.removesuffix(".txt"), f.read()))
    return tuple(out)


def _models(files: DataFrame, *sets):
    """(number of rows, [(idf, vectors, needed terms)]) for sets of templates, with document frequencies over all texts."""
    vocabulary = sorted({t for templates in sets for _, text in templates for t in terms(text)})
    found = F.array_intersect(_terms(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    # the row without a term counts the texts
    counted = files.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("term")).groupBy("term").count()
    counts = {r.term: r["count"] for r in counted.collect()}  # as many as the templates have terms
    n = counts.get("", 0)
    return n, counts, [weights(templates, counts, n) for templates in sets]


def _runs(lines: DataFrame) -> DataFrame:
    """(row, place, unit) of the runs of up to ``HEADER_LINES`` adjacent lines with a flagged one, of (row, i, line, flag).

    Lines are windowed by row, so a text of any number of lines streams by.
    """
    order = Window.partitionBy("row").orderBy("i")
    ahead = {f"line{k}": F.lead("line", k).over(order) for k in range(1, HEADER_LINES)}
    ahead |= {f"flag{k}": F.lead("flag", k).over(order) for k in range(1, HEADER_LINES)}
    lines = lines.withColumns(ahead).withColumnsRenamed({"line": "line0", "flag": "flag0"})
    runs = [F.struct(F.lit(n).alias("n"), F.concat_ws("\n", *(f"line{k}" for k in range(n))).alias("unit"),
                     (F.greatest(F.lit(False), *(F.coalesce(f"flag{k}", F.lit(False)) for k in range(n)))
                      & F.col(f"line{n - 1}").isNotNull()).alias("good")) for n in range(1, HEADER_LINES + 1)]
    return lines.select("row", "i", F.explode(F.array(*runs)).alias("r")).where("r.good").select(
        "row", (F.col("i") * (HEADER_LINES + 1) + F.col("r.n")).alias("place"), F.col("r.unit").alias("unit"))


def _good(units: DataFrame, idf: dict, vectors: list, other: float, at: int) -> DataFrame:
    """(row, place, via, template, score) of ``units`` (row, place, via, unit) that reach their threshold; templates
    are numbered from ``at``. Terms are counted by unit, then all dot products and the norm are summed at once."""
    entries = [(t, idf[t], [vector.get(t, 0.0) / norm * idf[t] for _, _, vector, norm in vectors]) for t in sorted(idf)]
    known = units.sparkSession.createDataFrame(entries, "term string, idf double, weights array<double>")
    tokens = units.select("row", "place", "via", F.explode(_terms(F.col("unit"))).alias("term")).groupBy(
        "row", "place", "via", "term").count()
    tokens = tokens.join(F.broadcast(known), "term", "left")  # the terms of the templates only
    dots = [F.sum(F.col("count") * F.get("weights", F.lit(i))).alias(f"dot{i}") for i in range(len(vectors))]
    sums = tokens.groupBy("row", "place", "via").agg(
        F.sqrt(F.sum(F.pow(F.col("count") * F.coalesce("idf", F.lit(other)), 2))).alias("norm"), *dots)
    scores = F.array(*(F.struct(F.lit(i + at).alias("template"), F.round(F.col(f"dot{i}") / F.col("norm"), 6).alias("score"))
                       for i in range(len(vectors))))
    return sums.select("row", "place", "via", F.explode(scores).alias("s")).select("row", "place", "via", "s.*").where(
        F.col("score") >= F.when(F.col("via") == "header", HEADER).otherwise(FILE))


def own_licenses(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(row, path, license, score, via): the best template of each row of ``files`` (path, text).

    Every run of up to ``HEADER_LINES`` adjacent lines, and the whole text, is a unit; the whole text is compared with the
    licence texts of ``whole_texts`` as well, with a vocabulary of their own. Terms are runs of a-z and 0-9 in lower case. Document
    frequencies of the templates' terms are counted over all texts in one pass; any other term weighs as one that no
    text has. Texts and lines without a term that a match needs (shown by Cauchy-Schwarz, so nothing is lost) are passed
    over before runs are built. ``license`` is NULL where no run of lines reaches HEADER and the text not FILE.
    """
    n, counts, ((idf, vectors, needed), (text_idf, text_vectors, text_needed)) = _models(files, templates, whole_texts())
    pattern = rf"(?<![a-z0-9])(?:{'|'.join(weights(templates, counts, n, HEADER)[2])})(?![a-z0-9])"
    found = files.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("terms", _terms(F.col("text")))
    has = lambda own: F.arrays_overlap("terms", F.array(*map(F.lit, own)))
    found = found.select("path", "text", has(needed).alias("header"), has(text_needed).alias("whole"))
    rows = found.select("path", "header", "whole", F.when(F.col("header") | F.col("whole"), F.col("text")).alias("text"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "units")
    other = math.log(1 + max(1, n)) + 1
    lines = rows.where("header").select("row", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    runs = _runs(lines.withColumn("flag", F.lower("line").rlike(pattern)))
    unit = lambda which, place: rows.where(which).select("row", F.lit(place).alias("place"), F.lit("file").alias("via"), F.col("text").alias("unit"))
    good = _good(runs.withColumn("via", F.lit("header")).unionByName(unit("header", -1)), idf, vectors, other, 0).unionByName(
        _good(unit("whole", -2), text_idf, text_vectors, other, len(vectors)))
    vectors = [*vectors, *text_vectors]
    # a licence file counts before a header in it, then the closest template, then the first
    best = good.groupBy("row").agg(F.max(F.struct((F.col("via") == "file").alias("whole"), "score", (-F.col("template")).alias("t"), "via")).alias("m"))
    names = F.array(*(F.lit(name) for name, *_ in vectors))
    return rows.select("row", "path").join(best, "row", "left").select(
        "row", "path", F.get(names, -F.col("m.t")).alias("license"), F.col("m.score").alias("score"), F.col("m.via").alias("via"))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def license_scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(path, license, score, via, from_path) per row of ``files`` (path, text).

    ``via`` is 'file' or 'header' for a licence of its own. Otherwise the licence file in the nearest
    folder above, or in its own, gives the licence ('inherited'); where a folder has several, the
    closest to its template, then the first path. Folders are resolved once each by joins on their ancestors'
    paths. NULL paths inherit nothing and give nothing; NULL and empty texts have no licence of their
    own; repeated rows are repeated. Other columns are ignored. No rows, no result.
    """
    own = materialize(own_licenses(files.select("path", "text"), templates), "licenses")
    folder = _folder(F.col("path"))
    given = own.where("via = 'file' AND path IS NOT NULL").groupBy(folder.alias("above")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("given"))
    folders = own.where("path IS NOT NULL").select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/", -1)
    above = folders.select("folder", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "above"))
    nearest = above.join(given, "above").groupBy("folder").agg(F.max(F.struct("depth", "given")).alias("m")).select(
        "folder", F.col("m.given.path").alias("from_path"), F.col("m.given.license").alias("inherited"))
    rows = own.withColumn("folder", folder).join(nearest, "folder", "left")
    mine = F.col("license").isNotNull()
    return rows.select("path", F.coalesce("license", "inherited").alias("license"), "score",
                       F.coalesce("via", F.when(F.col("inherited").isNotNull(), "inherited")).alias("via"),
                       F.when(~mine, F.col("from_path")).alias("from_path"))
