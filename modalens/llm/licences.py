"""Licence scans in DataFrame functions only.

A file's header is every line of its whole text that mentions a licence, a copyright or an SPDX tag; a licence file
(LICENSE, LICENCE, COPYING, NOTICE) has its whole text as a second one. Headers and templates are sparse TF-IDF vectors
over their lower-cased words, with idf = ln((1 + N) / (1 + df)) + 1 over all headers. Templates are the short notices
and, for licence files, the full texts in `licence_texts`; a full text is only compared where the phrase that tells it
from its siblings occurs (prose shares the common words of any long text). A file has the licence of the template with
the largest cosine over its headers, if that is `least` or more. A file without a licence of its own takes that of the
licence file in the nearest directory above it: each file's ancestor directories are joined to the licensed ones and the
deepest is kept.

Only files with a header reach the term tables, terms are aggregated before they are shuffled, and the templates are a
table of fixed size. Each file meets at most as many licensed directories as its path is deep.

Full texts are there for the licences in BODIES only. The CC BY and CC BY-NC texts differ from CC BY-SA in a few clauses
and are compared with that one, under their own titles. "Proprietary" has no full text.

Defined cases: null or empty texts have no header; a null path has no directory and inherits nothing; equal cosines go
to the licence first in order; of several licence files in one directory the licence first in order counts; rows that
repeat a path are files of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modalens.llm.common import written

#: The notice of each licence, as its publisher words it in short.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: The file of each licence's full text and the phrase (white space free) that a text must have to be compared.
BODIES = {
    "Apache-2.0": ("Apache-2.0", r"apache license,? version 2\.0"),
    "BSD-2-Clause": ("BSD-2-Clause", r"redistributions in binary form must reproduce"),
    "BSD-3-Clause": ("BSD-3-Clause", r"neither the names? of|may not be used to endorse or promote"),
    "CC-BY-4.0": ("CC-BY-SA-4.0", r"(?<!-)\battribution 4\.0 international"),
    "CC-BY-NC-4.0": ("CC-BY-SA-4.0", r"\battribution-noncommercial 4\.0 international"),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0", r"\battribution-sharealike 4\.0 international"),
    "CC0-1.0": ("CC0-1.0", r"cc0 1\.0 universal"),
    "GPL-2.0": ("GPL-2.0", r"gnu general public license version 2, june 1991"),
    "GPL-3.0": ("GPL-3.0", r"gnu general public license version 3, 29 june 2007"),
    "ISC": ("ISC", r"permission to use, copy, modify,? and/?(or)? distribute this software for any purpose"),
    "LGPL-2.1": ("LGPL-2.1", r"gnu lesser general public license version 2\.1, february 1999"),
    "LGPL-3.0": ("LGPL-3.0", r"gnu lesser general public license version 3, 29 june 2007"),
    "MIT": ("MIT", r"permission is hereby granted, free of charge"),
    "MPL-2.0": ("MPL-2.0", r"mozilla public license,? (version|v\.) 2\.0"),
    "Unlicense": ("Unlicense", r"free and unencumbered software released into the public domain"),
}
MARK = r"(?i)licen[sc]e|copyright|all rights reserved|spdx-|public domain"
LICENCE_FILE = r"(?i)^(LICEN[SC]E|COPYING|NOTICE)(\.[a-z]+)?$"
TERM = r"[a-z0-9.-]*[a-z0-9]"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def directory(path: Column) -> Column:
    """The path without its last part and without a closing slash; null for a path without a slash."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def licences(files: DataFrame, least: float = 0.5, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per file: id, path, own_license, score (its cosine), license, license_dir (where an inherited one lies)."""
    spark = files.sparkSession
    base = F.regexp_extract(F.coalesce("path", F.lit("")), "([^/]*)$", 1)
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text")).withColumn("whole", base.rlike(LICENCE_FILE))
    lines = F.array_join(F.filter(F.split("text", "\n"), lambda x: x.rlike(MARK)), "\n")
    flat = F.regexp_replace("text", r"\s+", " ")
    phrases = F.array_compact(F.array(*[F.when(flat.rlike(f"(?i){phrase}"), F.lit(k)) for k, (_, phrase) in BODIES.items()]))
    titles = F.when(F.col("whole"), phrases).otherwise(F.array().cast("array<string>"))

    def header(text: Column) -> Column:
        words = F.array_sort(terms(text))
        return F.struct(F.sha2(F.concat_ws("\n", F.array_join("titles", " "), F.array_join(words, " ")), 256).alias("v"), "titles", words.alias("terms"))

    parts = F.when(F.col("whole"), F.array_distinct(F.array(header(lines), header(F.col("text"))))).otherwise(F.array(header(lines)))
    # files whose headers have the same words share one vector: a hot notice costs a row, whatever the number of its files
    marked = rows.withColumn("titles", titles).select("id", "path", "whole", F.when(F.col("text").rlike(MARK), parts).alias("parts"))
    judged = written(marked.withColumn("u", F.array_join("parts.v", " ")), "headers")
    named = judged.filter("u IS NOT NULL")
    pairs = named.groupBy("u").agg(F.count(F.lit(1)).alias("files"), F.min("parts").alias("parts")).select("u", "files", F.explode("parts").alias("p")).select("u", "files", F.unhex("p.v").alias("v"), "p.titles", "p.terms")
    counted = pairs.groupBy("v").agg(F.sum("files").alias("files"), F.min("titles").alias("titles"), F.min("terms").alias("terms"))
    counted = written(counted, "header-vectors")
    n = spark.createDataFrame([(counted.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0],)], "n long")
    tf = counted.select("v", "files", F.explode("terms").alias("term")).groupBy("v", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("files").alias("files"))
    idf = tf.groupBy("term").agg(F.sum("files").alias("df"))
    idf = written(idf.join(F.broadcast(n)), "idf")  # terms of headers, few beside the texts
    weigh = lambda x: x.withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)))) + 1))
    weighted = written(weigh(tf.select("v", "term", "tf").join(idf, "term")).select("v", "term", "w"), "weights")
    own = weighted.groupBy("v").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len_v"))

    def scored(templates: list[tuple[str, str]], vectors: DataFrame, keys: list[str]) -> DataFrame:
        """Cosines of vectors with the templates that they share a term with."""
        known = spark.createDataFrame(templates, "license string, text string")
        known = known.select("license", F.explode(terms(F.col("text"))).alias("term")).groupBy("license", "term").agg(F.count(F.lit(1)).alias("tf"))
        known = weigh(known.join(idf.select("term", "df"), "term", "left").join(F.broadcast(n))).select("license", "term", F.col("w").alias("wt"))
        lengths = known.groupBy("license").agg(F.sqrt(F.sum(F.col("wt") * F.col("wt"))).alias("len_t"))
        dots = vectors.join(F.broadcast(known), keys).groupBy("v", "license").agg(F.sum(F.col("w") * F.col("wt")).alias("dot"))
        return dots.join(own, "v").join(F.broadcast(lengths), "license").select("v", "license", F.round(F.col("dot") / (F.col("len_v") * F.col("len_t")), 6).alias("score"))

    folder = Path(__file__).with_name("licence_texts")
    bodies = [(k, (folder / f"{name}.txt").read_text("utf-8")) for k, (name, _) in BODIES.items()]
    titled = weighted.join(counted.select("v", F.explode("titles").alias("license")), "v")
    cosines = scored(list(TEMPLATES.items()), weighted, ["term"]).unionByName(scored(bodies, titled, ["license", "term"]))
    best = pairs.select("u", "v").join(cosines, "v").groupBy("u").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    best = written(best.select("u", (-F.col("b.s")).alias("score"), F.col("b.license").alias("found")), "best")

    judged = written(judged.join(best, "u", "left").select("id", "path", "whole", "score", F.when(F.col("score") >= least, F.col("found")).alias("own_license")), "own-licences")
    dirs = judged.filter(F.col("whole") & F.col("own_license").isNotNull()).select(directory(F.col("path")).alias("dir"), "own_license").filter("dir IS NOT NULL")
    dirs = dirs.groupBy("dir").agg(F.min("own_license").alias("dir_license"))
    above = judged.filter("own_license IS NULL AND path LIKE '%/%'").select("path").distinct()
    parts = F.split(directory(F.col("path")), "/")
    above = above.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).select("path", "depth", F.array_join(F.slice(parts, 1, F.col("depth")), "/").alias("dir"))
    near = above.join(dirs, "dir").groupBy("path").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("d")).select("path", "d.dir", "d.dir_license")
    return judged.join(near, "path", "left").select(
        F.col("id").alias(id_col), "path", "own_license", "score", F.coalesce("own_license", "dir_license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("dir")).alias("license_dir"),
    )
