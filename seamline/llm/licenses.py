"""Licence scans: TF-IDF cosine of notices to templates, then inheritance from the nearest directory.

Only DataFrame functions. Wherever a cue word stands in a text, each template that has such a word is laid over the text
so that the two words meet; the words below it, as many as the template has and whatever lines they are on, are turned
into a sparse TF-IDF vector and compared with the template. A file's own licence is that of its most similar window. A
file without one takes the licence that the licence files of its nearest ancestor directory declare. Directories are
resolved once each, by joins of path prefixes.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.plans.lineage import stored

# Notices by which licences are declared, in natural order.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)
#: Templates are laid over texts at words with one of these; every template has one.
CUES = r"licen[cs]|reserved|permission|permitted|redistribut"
TERM = r"[a-z0-9]+"
LEAST = 0.6
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def cue(word: Column) -> Column:
    """What a cue word and a template's cue word must have in common: five letters; '' for other words."""
    return F.substring(F.regexp_extract(word, CUES, 0), 1, 5)


def template_vectors(spark: SparkSession, templates=TEMPLATES) -> tuple[DataFrame, DataFrame, float]:
    """(cue, template, licence, place, size, weights) per cue word of a template, (cue, idf), and the idf of terms that no template has.

    ``weights`` maps a term to its idf times its share of the template's unit vector, ``idf`` the terms of all templates
    to theirs. Both tables are as small as ``templates``.
    """
    lists = [re.findall(TERM, text.lower()) for _, text in templates]
    found = Counter(term for terms in lists for term in set(terms))
    idf = {term: math.log((1.0 + len(templates)) / (1.0 + n)) + 1 for term, n in found.items()}
    places, cues = [], set()
    for i, ((licence, _), terms) in enumerate(zip(templates, lists)):
        weight = {term: n * idf[term] for term, n in Counter(terms).items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        weights = {term: idf[term] * w / norm for term, w in weight.items()}
        for place, term in enumerate(terms):
            if hit := re.search(CUES, term):
                cues.add(hit[0][:5])
                places.append((hit[0][:5], i, licence, place, len(terms), weights))
    laid = spark.createDataFrame(places, "cue string, template int, licence string, place int, size int, weights map<string,double>")
    return laid, spark.createDataFrame([(c, idf) for c in sorted(cues)], "cue string, idf map<string,double>"), math.log(1.0 + len(templates)) + 1


def own_licences(files: DataFrame, path: str = "path", text: str = "text", least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """(path, own_licence, own_score) of files with words whose cosine to a template is ``least`` or more.

    The most similar window counts; ties go to the first template. Whole texts are scanned, line ends are as blanks;
    only texts with a cue are split into terms, and only the terms round a cue are looked at again. Nothing but one row
    per file is shuffled. Rows that repeat a path are judged as one file.
    """
    laid, idf, unseen = template_vectors(files.sparkSession, templates)
    reach = max(len(re.findall(TERM, t)) for _, t in templates)
    split = files.where(F.col(text).rlike("(?i)" + CUES)).select(F.col(path).alias("path"), words(F.col(text)).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.rlike(CUES), i)), lambda i: i.isNotNull())
    near = lambda i: F.struct(cue(F.get("words", i)).alias("cue"), F.least(i, F.lit(reach)).alias("before"), F.slice("words", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("terms"))
    around = split.select("path", F.explode(F.transform(hits, near)).alias("c")).select("path", "c.*")
    # the templates are a fixed list, so tables made of them may be broadcast
    known = around.join(F.broadcast(idf), "cue").withColumn("idfs", F.transform("terms", lambda w: F.coalesce(F.try_element_at("idf", w), F.lit(unseen)))).drop("idf")
    over = known.join(F.broadcast(laid), "cue").withColumn("start", F.col("before") - F.col("place"))
    first, last = F.greatest(F.col("start"), F.lit(0)), F.least(F.col("start") + F.col("size"), F.size("terms"))
    window = over.select("path", "template", "licence", "weights", F.slice("terms", first + 1, last - first).alias("terms"), F.slice("idfs", first + 1, last - first).alias("idfs"))
    dot = F.aggregate("terms", F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at("weights", w), F.lit(0.0)))
    # the norm when no term repeats; repeats only lengthen it, so what is below ``least`` here stays there
    shortest = F.sqrt(F.aggregate("idfs", F.lit(0.0), lambda a, x: a + x * x))
    likely = window.withColumn("dot", dot).where(F.col("dot") >= F.lit(least) * shortest - 1e-6)
    squares = F.transform("idfs", lambda x, i: x * x * F.size(F.filter("terms", lambda w: w == F.get("terms", i))))
    norm = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))
    scored = likely.select("path", "template", "licence", F.round(F.col("dot") / norm, 6).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("path").agg(F.max(F.struct("score", (-F.col("template")).alias("rank"), "licence")).alias("best"))
    return best.select("path", F.col("best.licence").alias("own_licence"), F.col("best.score").alias("own_score"))


def directory(path: Column) -> Column:
    """The directory of a path, '' for the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def directory_licences(own: DataFrame, licence_file: str = LICENCE_FILE) -> DataFrame:
    """(directory, declared): by the licence files right in it; the most frequent licence, ties by name."""
    votes = own.where(F.col("path").rlike(licence_file)).groupBy(directory(F.col("path")).alias("directory"), "own_licence").count()
    best = votes.groupBy("directory").agg(F.min(F.struct((-F.col("count")).alias("n"), "own_licence")).alias("v"))
    return best.select("directory", F.col("v.own_licence").alias("declared"))


def scan(files: DataFrame, path: str = "path", text: str = "text", least: float = LEAST, templates=TEMPLATES, licence_file: str = LICENCE_FILE) -> DataFrame:
    """All columns of ``files`` but the text, with own_licence, own_score, licence and inherited_from (a directory, or null).

    Null and empty texts have no own licence; a null path counts as a file at the top without a name. Distinct
    directories are few against files; each is joined with all its ancestors once, so that a directory with very many
    files is no hot key. Columns of the new names are replaced.
    """
    new = ("own_licence", "own_score", "licence", "inherited_from", "_path", "_directory")
    kept = [c for c in files.columns if c != text and c.lower() not in new]
    named = files.withColumn("_path", F.coalesce(F.col(path).cast("string"), F.lit("")))
    # few rows: only files with a notice; they give the votes and are joined back
    own = stored(own_licences(named.select("_path", F.col(text).cast("string").alias("_text")), "_path", "_text", least, templates))
    declared = directory_licences(own, licence_file)
    rows = named.select(*kept, "_path").withColumn("_directory", directory(F.col("_path")))
    places = rows.select(F.col("_directory").alias("place")).distinct()
    parts = F.split("place", "/")
    chains = places.select("place", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    above = chains.select("place", "depth", F.array_join(F.slice(F.split("place", "/"), F.lit(1), F.col("depth")), "/").alias("directory")).where("place <> '' OR depth = 0")
    nearest = above.join(declared, "directory").groupBy("place").agg(F.max(F.struct("depth", "directory", "declared")).alias("n"))
    found = rows.join(own, rows["_path"] == own["path"], "left").select(*[rows[c] for c in rows.columns], "own_licence", "own_score")
    known = found.join(nearest, F.col("_directory") == F.col("place"), "left")
    return known.select(
        *kept, "own_licence", "own_score", F.coalesce("own_licence", "n.declared").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("n.directory")).alias("inherited_from")
    )


def document_paths(documents: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents as files of a tree: three levels of directories below the source, each with some licence files."""
    place = F.expr(
        "concat(coalesce(source, ''), CASE WHEN doc_id % 1024 = 0 THEN concat('/LICENSE.', doc_id)"
        " WHEN doc_id % 64 = 0 THEN concat('/a', doc_id div 1024, '/LICENSE.', doc_id)"
        " WHEN doc_id % 8 = 0 THEN concat('/a', doc_id div 1024, '/b', doc_id div 64, '/LICENSE.', doc_id)"
        " ELSE concat('/a', doc_id div 1024, '/b', doc_id div 64, '/c', doc_id div 8, '/', doc_id, '.txt') END)"
    )
    return documents.select("doc_id", place.alias("path"), "text")


def _values() -> str:
    return ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(TEMPLATES))


ORACLE = f"""
WITH t AS (SELECT * FROM (VALUES {_values()}) v(template, licence, text)),
tf AS (SELECT template, licence, term, count(*) AS n FROM (SELECT template, licence, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM t) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + {len(TEMPLATES)})::DOUBLE / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT template, licence, term, n * idf AS weight FROM tf JOIN idf USING (term)),
u AS (SELECT template, licence, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY template)) AS unit FROM w),
f AS (
  SELECT doc_id, text, coalesce(source, '') || CASE WHEN doc_id % 1024 = 0 THEN '/LICENSE.' || doc_id
    WHEN doc_id % 64 = 0 THEN '/a' || (doc_id // 1024) || '/LICENSE.' || doc_id
    WHEN doc_id % 8 = 0 THEN '/a' || (doc_id // 1024) || '/b' || (doc_id // 64) || '/LICENSE.' || doc_id
    ELSE '/a' || (doc_id // 1024) || '/b' || (doc_id // 64) || '/c' || (doc_id // 8) || '/' || doc_id || '.txt' END AS path FROM documents),
tp AS (
  SELECT template, licence, size, unnest(range(size)) AS place, unnest(ws) AS term
  FROM (SELECT template, licence, regexp_extract_all(lower(text), '{TERM}') AS ws, len(regexp_extract_all(lower(text), '{TERM}')) AS size FROM t)),
laid AS (SELECT template, licence, size, place, regexp_extract(term, '{CUES}')[1:5] AS cue FROM tp WHERE regexp_matches(term, '{CUES}')),
fw AS (SELECT row_number() OVER () AS r, path, regexp_extract_all(lower(text), '{TERM}') AS ws FROM f WHERE regexp_matches(text, '(?i){CUES}')),
hit AS (
  SELECT r, path, ws, pos, regexp_extract(term, '{CUES}')[1:5] AS cue
  FROM (SELECT r, path, ws, unnest(range(len(ws))) AS pos, unnest(ws) AS term FROM fw) WHERE regexp_matches(term, '{CUES}')),
win AS (SELECT DISTINCT r, path, template, licence, pos - place AS start, ws[greatest(pos - place, 0) + 1 : least(pos - place + size, len(ws))] AS ws FROM hit JOIN laid USING (cue)),
lt AS (SELECT r, path, template, licence, start, term, count(*) AS n FROM (SELECT r, path, template, licence, start, unnest(ws) AS term FROM win) GROUP BY ALL),
lw AS (SELECT lt.*, n * coalesce(idf, ln(1.0 + {len(TEMPLATES)}) + 1) AS weight FROM lt LEFT JOIN idf USING (term)),
sc AS (SELECT path, template, licence, round(sum(weight * coalesce(unit, 0)) / sqrt(sum(weight * weight)), 6) AS score
       FROM lw LEFT JOIN u USING (template, licence, term) GROUP BY r, path, template, licence, start),
own AS (SELECT path, licence AS own_licence, score AS own_score FROM sc WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, template) = 1),
dl AS (
  SELECT directory, own_licence AS declared FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS directory, own_licence, count(*) AS n FROM own WHERE regexp_matches(path, '{LICENCE_FILE}') GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY n DESC, own_licence) = 1),
p AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS place FROM f),
near AS (SELECT p.path, dl.directory, dl.declared FROM p JOIN dl ON dl.directory = '' OR p.place = dl.directory OR starts_with(p.place, dl.directory || '/')
         QUALIFY row_number() OVER (PARTITION BY p.path ORDER BY length(dl.directory) DESC) = 1)
SELECT p.doc_id, p.path, own_licence, own_score, coalesce(own_licence, declared) AS licence, CASE WHEN own_licence IS NULL THEN directory END AS inherited_from
FROM p LEFT JOIN own USING (path) LEFT JOIN near USING (path)
"""
