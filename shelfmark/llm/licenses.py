"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

A text is cut into pieces (lines, and sentences within them); pieces that hold an anchor word (licence, copyright, ...) are
candidate notices, wherever in the text they stand. Notices and templates become sparse TF-IDF vectors (raw counts, smooth
idf ln((1 + n) / (1 + df)) + 1 over the templates; a word of no template has df 0). A notice's licence is the template with
the highest cosine, if that reaches ``LEAST``; a file's licence is that of its best notice. A file named like a licence file
(LICENSE, LICENCE, COPYING, NOTICE, with any suffix) speaks for its directory.

Next to the pieces, whole units are compared with the full texts in ``licence_texts`` (and MIT's grant): paragraphs, comment
blocks, and all of a file named like a licence file, with an idf of their own. Pieces inside a unit that reaches ``LEAST`` don't
count, as they are a part of that licence ("All rights reserved." in a BSD file); of the rest the best cosine decides.

Files without a licence of their own inherit from the nearest directory above that has one. Ancestors are enumerated for
distinct directories, not for files, and joined on the path, so a directory with a third of all files costs no more than one
with a single file; files then look up their own directory.

Everything is DataFrame expressions; what is broadcast is the template table, a parameter of fixed size.

Defined cases: a null text has no notice; a null path has no directory and inherits nothing; ties go to the licence id first
in the alphabet; repeated files are reported each; very long texts are looked at whole; an empty table gives an empty result; other
columns aren't looked at.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import documents, text_of
from shelfmark.plans.lineage import cut

LEAST = 0.6
ANCHOR = r"(?i)licen[sc]|copyright|copyleft|rights reserved|public domain"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([._-].*)?$"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Short notices as projects print them in headers, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT license"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright; CC0 1.0 public domain dedication."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved."),
)
#: What a text or unit holds to be compared with the full texts.
BODY_ANCHOR = ANCHOR + r"|permission is hereby|redistribution and use"
_COMMENT = r"[ \t]*(?:#|//|/?\*|--|;|%)"


def bodies() -> list[tuple[str, str]]:
    """Full licence texts by SPDX identifier, and the paragraph by which MIT is known alone."""
    found = [(path.stem, path.read_text()) for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    return found + [(name, text.split("\n\n")[0]) for name, text in found if name == "MIT"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def pieces(text: Column) -> Column:
    """Lines, and sentences within them."""
    return F.split(F.regexp_replace(text, r"([.!?;])[ \t]+", "$1\n"), "\n")


def template_vectors(spark: SparkSession, templates: list[tuple[str, str]] | tuple = TEMPLATES) -> tuple[DataFrame, DataFrame, int]:
    """(term, idf), (term, template, license, weight of unit length), number of templates."""
    array = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for k, (name, text) in enumerate(templates)])
    terms = spark.range(1).select(F.inline(array)).select("template", "license", F.explode(tokens(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    n = len(templates)
    idf = terms.groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1).alias("idf"))
    weighed = terms.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return idf, weighed.join(norms, "template").select("term", "template", "license", (F.col("w") / F.col("norm")).alias("weight")), n


def units(text: Column, whole: Column) -> Column:
    """Paragraphs, blocks of comment lines and block comments, and all of the text if ``whole``."""
    paragraphs = F.split(text, r"\n(?:[^\p{L}\p{N}\n]*\n)+")
    lines = F.split(F.regexp_replace(text, rf"(?m)^(?!{_COMMENT})[^\n]*$", "\0"), "\0")
    blocks = F.regexp_extract_all(text, F.lit(r'(?s)/\*.*?\*/|""".*?"""|<!--.*?-->'), F.lit(0))
    found = F.concat(paragraphs, lines, blocks, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(BODY_ANCHOR)))


def scores(found: DataFrame, idf: DataFrame, vectors: DataFrame, n: int, least: float) -> DataFrame:
    """(id, piece, text) -> (id, piece, license, score) at or over ``least``."""
    unknown = F.log(F.lit(1.0 + n)) + 1
    terms = found.select("id", "piece", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "piece", "term").agg(F.count("*").alias("tf"))
    weighed = terms.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unknown))
    norms = weighed.groupBy("id", "piece").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors), "term").groupBy("id", "piece", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return dots.join(norms, ["id", "piece"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= least).select("id", "piece", "license", "score")


def notices(files: DataFrame, id_col: str, text_col: str = "text", templates=TEMPLATES, least: float = LEAST, path_col: str = "path") -> DataFrame:
    """(id, license, score) of the files with a notice."""
    idf, vectors, n = template_vectors(files.sparkSession, templates)
    named = F.coalesce(F.regexp_extract(path_col, r"([^/]*)$", 1).rlike(LICENSE_FILE), F.lit(False))
    texts = files.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), named.alias("whole"))
    texts = cut(texts.filter(F.col("text").rlike(BODY_ANCHOR)))  # the one scan of all texts
    found = texts.filter(F.col("text").rlike(ANCHOR)).select("id", F.posexplode(pieces(F.col("text"))).alias("piece", "text")).filter(F.col("text").rlike(ANCHOR))
    bodily = texts.select("id", F.posexplode(units(F.col("text"), F.col("whole"))).alias("piece", "text"))
    matched = cut(scores(bodily, *template_vectors(files.sparkSession, bodies()), least))
    words = F.xxhash64(tokens(F.col("text"))).alias("words")
    inside = bodily.join(matched.select("id", "piece").distinct(), ["id", "piece"], "left_semi").select("id", F.explode(pieces(F.col("text"))).alias("text")).select("id", words).distinct()
    found = found.withColumn("words", words).join(inside, ["id", "words"], "left_anti")
    scored = scores(found, idf, vectors, n, least).union(matched)
    best = scored.groupBy("id", "license").agg(F.max("score").alias("score")).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("id", "b.license", (-F.col("b.s")).alias("score"))


def directory(path: str) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), r"/+$", "")


def scan(files: DataFrame, id_col: str, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, path, license, score, basis, from_dir): basis is ``own``, ``inherited`` or null; from_dir is whose licence is inherited."""
    own = cut(notices(files, id_col, text_col, templates, least, path_col))
    slim = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), directory(path_col).alias("dir"), F.regexp_extract(path_col, r"([^/]*)$", 1).rlike(LICENSE_FILE).alias("speaks"))
    known = slim.join(own, "id", "left")
    speak = known.filter("speaks and license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select(
        F.col("dir").alias("from_dir"),
        F.col("b.license").alias("dir_license"),
        (-F.col("b.s")).alias("dir_score"),
    )
    dirs = slim.filter("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))
    above = dirs.select("dir", F.explode(depths).alias("up")).withColumn("from_dir", F.array_join(F.slice(F.split("dir", "/"), 1, F.col("up")), "/"))
    nearest = above.join(speak, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_license", "dir_score"), "up").alias("near"))
    out = known.join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "id",
        "path",
        F.coalesce("license", "near.dir_license").alias("license"),
        F.coalesce("score", "near.dir_score").alias("score"),
        F.when(has, "own").when(F.col("near").isNotNull(), "inherited").alias("basis"),
        F.when(~has, F.col("near.from_dir")).alias("from_dir"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files ``<source>/<lang>/<doc_id / 100>/<doc_id>.txt``. The tables have no paths, so ids make them: every
    tenth document is named like a licence file, and every fiftieth lies in the directory ``<source>`` itself."""
    hundred = F.floor(F.col("doc_id") / 100).cast("string")
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.when(F.col("doc_id") % 50 == 0, F.concat_ws("/", "source", name)).otherwise(F.concat_ws("/", "source", "lang", hundred, name))
    return scan(documents(spark, sf_dir).select("doc_id", "text", path.alias("path")), "doc_id").withColumnRenamed("id", "doc_id")


_SQL_TEMPLATES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS name, source, lang FROM documents),
f AS (SELECT doc_id, text, CASE WHEN doc_id % 50 = 0 THEN concat_ws('/', source, name) ELSE concat_ws('/', source, lang, (doc_id // 100)::VARCHAR, name) END AS path FROM d),
t AS (SELECT * FROM (VALUES {_SQL_TEMPLATES}) t(template, license, text)),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln({1.0 + len(TEMPLATES)} / (1.0 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT template, license, term, tf * idf AS w FROM tt JOIN idf USING (term)),
tv AS (SELECT template, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS weight FROM tw),
p0 AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(text, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10)), 1) AS piece FROM f WHERE regexp_matches(text, '{ANCHOR}')),
pt AS (SELECT doc_id, piece, term, count(*) AS tf FROM (SELECT doc_id, piece, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM p0 WHERE regexp_matches(text, '{ANCHOR}')) GROUP BY ALL),
pw AS (SELECT doc_id, piece, term, tf * coalesce(idf, ln({1.0 + len(TEMPLATES)}) + 1) AS w FROM pt LEFT JOIN idf USING (term)),
pn AS (SELECT doc_id, piece, sqrt(sum(w * w)) AS norm FROM pw GROUP BY ALL),
sc AS (SELECT doc_id, license, round(sum(pw.w * tv.weight) / any_value(norm), 6) AS score FROM pw JOIN tv USING (term) JOIN pn USING (doc_id, piece) GROUP BY doc_id, piece, template, license),
own AS (SELECT doc_id, license, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r FROM sc WHERE score >= {LEAST}) WHERE r = 1),
k AS (SELECT f.doc_id, f.path, regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS dir, regexp_matches(regexp_extract(f.path, '([^/]*)$', 1), '{LICENSE_FILE}') AS speaks, own.license, own.score FROM f LEFT JOIN own USING (doc_id)),
sp AS (SELECT dir AS from_dir, license AS dir_license, score AS dir_score FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) AS r FROM k WHERE speaks AND license IS NOT NULL) WHERE r = 1),
nr AS (SELECT a.dir, from_dir, dir_license, dir_score, row_number() OVER (PARTITION BY a.dir ORDER BY length(from_dir) DESC) AS r FROM (SELECT DISTINCT dir FROM k) a JOIN sp ON a.dir = from_dir OR starts_with(a.dir, from_dir || '/') OR from_dir = '')
SELECT k.doc_id, k.path, coalesce(k.license, dir_license) AS license, coalesce(k.score, dir_score) AS score,
       CASE WHEN k.license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' END AS basis,
       CASE WHEN k.license IS NULL THEN nr.from_dir END AS from_dir
FROM k LEFT JOIN nr ON k.dir = nr.dir AND nr.r = 1
"""
