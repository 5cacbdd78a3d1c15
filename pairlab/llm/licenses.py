"""License scans with DataFrame functions alone.

1. Every line of a file is a sparse TF-IDF vector over words; its cosine with
   each template says which license the line states.  Weights come from
   document frequencies over all files.  Before any line is exploded, files
   are kept only if they hold a word without which no line can reach the
   threshold (the prefix of each template by weight), so nothing is lost.
2. A file's own license is its best line.  A license file (LICENSE, COPYING)
   speaks for its directory.
3. A file without an own license inherits from the nearest directory above it
   that has one: directories are joined with their ancestors' licenses by
   path, files with their directory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.llm.common import store

SIMILAR = 0.7
# Short notices by which files state a license.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
LICENSE_FILES = ("license", "licence", "copying", "unlicense")


def words_of(text: Column) -> Column:
    """Lower-case runs of letters, digits, dots and hyphens, closing dots left out."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def template_weights(spark: SparkSession, files: DataFrame, templates=TEMPLATES) -> tuple[list[dict], dict[str, float], float]:
    """Unit vectors of the templates, the weights of their words, and that of all other words.

    The document frequencies of the templates' words are counted over all
    files; the vocabulary is as large as the templates are.
    """
    known = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "no int, text string")
    counted = known.select("no", F.explode(words_of(F.col("text"))).alias("word")).groupBy("no", "word").count().collect()
    vocabulary = sorted({r["word"] for r in counted})
    held = F.array_intersect(words_of(F.col("text")), F.array(*[F.lit(w) for w in vocabulary]))
    seen = files.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n_files = files.count()
    seen = {r["word"]: r["n"] for r in seen.collect()}
    idf = {w: math.log((1 + n_files) / (1 + seen.get(w, 0))) + 1 for w in vocabulary}
    vectors = []
    for i, (name, _) in enumerate(templates):
        raw = {r["word"]: r["count"] * idf[r["word"]] for r in counted if r["no"] == i}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vectors.append({"license": name, "weights": {w: v / norm for w, v in raw.items()}})
    return vectors, idf, math.log(1 + n_files) + 1


def needed_words(weights: dict[str, float], similar: float) -> set[str]:
    """The heaviest words of a unit vector such that all others together stay below ``similar``."""
    rest, needed = 1.0, set()
    for word, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if math.sqrt(max(rest, 0.0)) < similar:
            break
        needed.add(word)
        rest -= weight * weight
    return needed


def own_licenses(files: DataFrame, similar: float = SIMILAR, templates=TEMPLATES) -> DataFrame:
    """(file, license, score, line): the best line of every file that states a license.

    ``files`` has file (an id) and text.  Ties go to the license first by
    name, then to the first line.
    """
    spark = files.sparkSession
    vectors, idf, other = template_weights(spark, files, templates)
    needed = sorted(set().union(*[needed_words(v["weights"], similar) for v in vectors]))
    lines = files.where(F.arrays_overlap(words_of(F.col("text")), F.array(*[F.lit(w) for w in needed])))
    lines = lines.select("file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "said"))
    lines = lines.withColumn("words", words_of(F.col("said"))).where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in needed])))
    lines = lines.select("file", "line", F.explode("words").alias("word")).groupBy("file", "line", "word").agg(F.count(F.lit(1)).alias("n"))
    # one row per word of a template; as many as the templates have words
    table = spark.createDataFrame([(i, v["license"], w, x) for i, v in enumerate(vectors) for w, x in v["weights"].items()], "no int, license string, word string, weight double")
    weights = spark.createDataFrame(list(idf.items()), "word string, idf double")
    lines = lines.join(F.broadcast(weights), "word", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(other)))
    norms = lines.groupBy("file", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = lines.join(F.broadcast(table), "word").groupBy("file", "line", "no", "license").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["file", "line"]).select("file", "line", "license", F.round(F.col("dot") / F.col("norm"), 12).alias("score")).where(F.col("score") >= similar)
    best = F.min(F.struct((-F.col("score")).alias("low"), F.col("license"), F.col("line")))
    best = scored.groupBy("file").agg(best.alias("b"))
    return best.select("file", F.col("b.license").alias("license"), (-F.col("b.low")).alias("score"), F.col("b.line").alias("line"))


def parent(path: Column) -> Column:
    """The directory of a path; "" at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, similar: float = SIMILAR, templates=TEMPLATES) -> DataFrame:
    """(file, path, license, basis, score, line, license_dir) of every row of ``files``.

    basis is "own" (a line of the file), "inherited" (the nearest ancestor
    directory with a license file) or "none".  Null texts state nothing; a
    null path has no directory and inherits nothing.  Several license files of
    one directory: the best score counts, ties go to the license first by
    name.  Rows repeated under one id share their best line.  Other columns
    are not read.  An empty table gives no rows.
    """
    rows = files.select(F.col(id_col).alias("file"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    own = store(own_licenses(rows.select("file", F.coalesce("text", F.lit("")).alias("text")), similar, templates), "own")
    named = rows.select("file", "path", parent(F.col("path")).alias("dir"), F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1)).isin(*LICENSE_FILES).alias("speaks"))
    known = named.join(own, named["file"].eqNullSafe(own["file"]), "left").drop(own["file"])
    known = store(known, "known")
    spoken = known.where("speaks and license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("b"))
    spoken = spoken.select(F.col("dir").alias("license_dir"), F.col("b.license").alias("inherited"))
    # every directory once, with all directories above it
    dirs = known.where("license is null and dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))
    )
    nearest = dirs.select("dir", F.posexplode(above).alias("depth", "license_dir")).join(spoken, "license_dir")
    nearest = nearest.groupBy("dir").agg(F.max_by(F.struct("license_dir", "inherited"), "depth").alias("from"))
    out = known.join(nearest, "dir", "left")
    return out.select(
        "file", "path", F.coalesce("license", "from.inherited").alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("basis"),
        "score", "line", F.when(F.col("license").isNull(), F.col("from.license_dir")).alias("license_dir"),
    )
