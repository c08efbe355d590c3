"""Operator 8, licence scans: sparse TF-IDF cosine to templates, then inheritance
from the nearest ancestor directory. DataFrame functions only.

A file's text is cut into passages (lines, sentences within them, and windows of
neighbouring lines). An SPDX-License-Identifier names a licence outright. Terms are
runs of a-z and 0-9 in lower case; a term's weight is its count times its inverse
document frequency over all files. A file has a licence of its own if a passage
(its headers and notices) has a cosine of at least PASSAGE with a template; it is
a licence file if its name says so and it has a licence, or if its whole text has a
cosine of at least WHOLE. A file without a licence of its own takes that of the
nearest directory, its own or an ancestor, that holds a licence file (the best
match; ties: the smaller path).

Cosines are only taken where they can reach the threshold: a passage that holds
none of a template's anchors, its rarest terms, has a cosine below the threshold
whatever else it holds (Cauchy-Schwarz). Directories are resolved once each, not
once per file.

Edge cases. Null or empty text: no licence of its own, may inherit. Null path: no
directory, never inherits. Repeated rows: each is returned. Ties between
templates: the smaller name. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Notices by which licences are declared, under their SPDX names.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
}
#: Usual file headers, and the passages of licence texts that name them where
#: no title does (licence#what). Texts of the Apache, GPL, AGPL and MPL licences quote their header.
GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by "
       "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
TEXTS = {
    "AGPL-3.0#header": GNU.format("Affero General Public License", "3"),
    "Apache-2.0#header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                         "compliance with the License.",
    "BSD-3-Clause#text": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                         "promote products derived from this software without specific prior written permission.",
    "GPL-2.0#header": GNU.format("General Public License", "2"),
    "GPL-3.0#header": GNU.format("General Public License", "3"),
    "LGPL-2.1#header": GNU.format("Lesser General Public License", "2.1"),
    "LGPL-3.0#header": GNU.format("Lesser General Public License", "3"),
    "LGPL-3.0#title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "MIT#text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
                'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
                "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
                "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0#header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                      "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Neighbouring lines that are read as one passage, for what is wrapped over lines.
WINDOWS = (2, 3, 4, 5, 6)
SPDX_ID = "[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
SPDX = f"SPDX-License-Identifier:[ \\t]*\\(?({SPDX_ID}(?: (?:AND|OR|WITH) {SPDX_ID})*)"
PASSAGE, WHOLE = 0.75, 0.6
LICENCE_NAME = "^(licen[cs]e|copying|notice)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def words(text):
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


class Weights:
    """Template vectors under the corpus' document frequencies."""

    def __init__(self, templates: dict[str, str], files: int, df: dict[str, int]):
        self.names = sorted(templates)
        counts = {n: Counter(terms_of(templates[n])) for n in self.names}
        self.idf = {t: math.log((files + 1) / (df.get(t, 0) + 1)) + 1 for n in self.names for t in counts[n]}
        self.vector = {n: {t: c * self.idf[t] for t, c in counts[n].items()} for n in self.names}
        self.norm = {n: math.sqrt(sum(w * w for w in v.values())) for n, v in self.vector.items()}

    def anchors(self, threshold: float) -> list[str]:
        """Terms of which a text must hold one to have a cosine of ``threshold`` with any template."""
        out = set()
        for n, v in self.vector.items():
            rest = self.norm[n] ** 2
            for t in sorted(v, key=lambda t: (-self.idf[t], -v[t], t)):  # the rarest first
                if rest < (threshold * self.norm[n]) ** 2 * (1 - 1e-9):
                    break
                out.add(t)
                rest -= v[t] ** 2
        return sorted(out)


def matches(base: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(key, whole, licence, score): the best template of each file's passages
    (whole = false) and of its whole text (true), where it reaches the threshold."""
    spark = base.sparkSession
    vocabulary = sorted({t for x in templates.values() for t in terms_of(x)})
    lit = lambda terms: F.array(*map(F.lit, terms))
    # files that hold each term, whatever the term; "" stands for every file
    seen = base.select(F.explode(F.concat(F.array_distinct(words("text")), lit([""]))).alias("term"))
    seen = written(seen.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")
    df = {r["term"]: r["n"] for r in seen.where(F.col("term").isin(*vocabulary, "")).collect()}  # the templates' terms
    files = df.pop("", 0)
    weights = Weights(templates, files, df)

    anchors = lit(weights.anchors(min(PASSAGE, WHOLE)))
    near = base.where(F.arrays_overlap(words("text"), anchors)).select("key", "text")
    cut = F.split(F.regexp_replace("text", "([.!?;])[ \t\n\r\f]+", "$1\n"), "\n")
    lines = F.split("text", "\n")

    def windows(size: int):
        """Every ``size`` neighbouring lines."""
        return F.transform(F.when(F.size(lines) >= size, F.sequence(F.lit(1), F.size(lines) - size + 1)).otherwise(F.array().cast("array<int>")),
                           lambda k: F.struct((k + F.lit(size << 32)).alias("pos"), F.array_join(F.slice(lines, k, size), "\n").alias("passage")))

    passages = near.select("key", F.explode(F.concat(
        F.array(F.struct(F.lit(-1).cast("long").alias("pos"), F.col("text").alias("passage"))),
        F.transform(cut, lambda p, k: F.struct(k.cast("long").alias("pos"), p.alias("passage"))), *map(windows, WINDOWS))).alias("x"))
    passages = passages.select("key", "x.pos", words(F.col("x.passage")).alias("terms")).where(F.arrays_overlap("terms", anchors))

    # repeated rows share a key: their counts are multiples, which no cosine feels
    table = [(t, *(weights.vector[n].get(t, 0.0) for n in weights.names)) for t in vocabulary]
    columns = "term string, " + ", ".join(f"t{k} double" for k in range(len(weights.names)))
    known = F.broadcast(spark.createDataFrame(table, columns))  # the templates' terms
    counted = passages.select("key", "pos", F.explode("terms").alias("term")).groupBy("key", "pos", "term").agg(
        F.count(F.lit(1)).alias("tf")).join(seen, "term").join(known, "term", "left")
    weight = F.col("tf") * (F.log(F.lit(files + 1.0) / (F.col("n") + 1)) + 1)
    sums = counted.groupBy("key", "pos").agg(F.sum(weight * weight).alias("square"), *(
        F.sum(weight * F.coalesce(f"t{k}", F.lit(0.0))).alias(f"d{k}") for k in range(len(weights.names))))
    best = F.array_max(F.array(*(F.struct(
        F.round(F.col(f"d{k}") / F.sqrt("square") / weights.norm[n], 9).alias("score"),
        F.lit(-k).alias("order"), F.lit(n.split("#")[0]).alias("licence")) for k, n in enumerate(weights.names))))
    found = sums.select("key", (F.col("pos") < 0).alias("whole"), best.alias("best"))
    found = found.where(F.col("best.score") >= F.when(F.col("whole"), WHOLE).otherwise(PASSAGE))
    declared = base.where(F.col("text").rlike(SPDX)).select("key", F.lit(False).alias("whole"), F.struct(
        F.lit(1.0).alias("score"), F.lit(1).alias("order"), F.regexp_extract("text", SPDX, 1).alias("licence")).alias("best"))
    return found.unionByName(declared).groupBy("key", "whole").agg(F.max("best").alias("best")).select(
        "key", "whole", "best.licence", "best.score")


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES | TEXTS) -> DataFrame:
    """``files`` (doc_id, path, text) -> (doc_id, path, licence, score, origin,
    from_path): origin is "own" or "inherited"; all null without any licence."""
    base = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("path", "text"))
    found = matches(base, templates)
    per_file = found.groupBy("key").agg(
        F.max(F.when(~F.col("whole"), F.struct("score", "licence"))).alias("header"),
        F.max(F.when(F.col("whole"), F.struct("score", "licence"))).alias("all"))

    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)  # "" for the top
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    rows = base.select("doc_id", "path", "key", directory.alias("dir"), name.rlike(LICENCE_NAME).alias("named"))
    rows = rows.join(per_file, "key", "left").withColumn("own", F.coalesce("header", "all"))

    # directories that hold a licence file, and what every directory inherits
    holds = rows.where(F.col("path").isNotNull() & (F.col("all").isNotNull() | (F.col("named") & F.col("own").isNotNull())))
    holds = holds.withColumn("got", F.coalesce("all", "header")).groupBy(F.col("dir").alias("above")).agg(
        F.min(F.struct((-F.col("got.score")).alias("worst"), F.col("path").alias("from_path"), F.col("got.licence").alias("licence"))).alias("given"))
    dirs = rows.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above"))), F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above"))))).alias("a"))
    inherited = ancestors.select("dir", "a.depth", "a.above").join(holds, "above").groupBy("dir").agg(
        F.max_by("given", "depth").alias("given"))

    out = rows.join(inherited, "dir", "left")
    own = F.col("own").isNotNull()
    return out.select(
        "doc_id", "path",
        F.when(own, F.col("own.licence")).otherwise(F.col("given.licence")).alias("licence"),
        F.round(F.when(own, F.col("own.score")).otherwise(-F.col("given.worst")), 6).alias("score"),
        F.when(own, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"),
        F.when(own, F.col("path")).otherwise(F.col("given.from_path")).alias("from_path"))


def document_paths(docs: DataFrame, per_dir: int = 1000) -> DataFrame:
    """(doc_id, path, text) of documents, which have no path of their own:
    source/(doc_id div per_dir)/doc_id.txt; null id: no path."""
    shelf = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / per_dir).cast("string"),
                     F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", shelf.alias("path"), "text")


def documents_sql(templates: dict[str, str] = TEMPLATES | TEXTS, per_dir: int = 1000) -> str:
    """The same scan of ``documents`` in DuckDB's SQL, without anchors: every passage is
    compared with every template."""
    quoted = lambda x: x.replace("'", "''")
    values = ", ".join(f"({k}, '{n.split('#')[0]}', '{quoted(templates[n])}')" for k, n in enumerate(sorted(templates)))
    low = f"translate(%s, '{UPPER}', '{LOWER}')"
    split = lambda x: f"[w for w in string_split_regex({low % x}, '[^a-z0-9]+') if w <> '']"
    windows = " ".join(f"""
        union all
        select key, {size} * 4294967296 + k as pos, array_to_string(p[k:k + {size - 1}], chr(10)) as passage
        from (select key, p, unnest(range(1, len(p) - {size - 2})) as k from lines)""" for size in WINDOWS)
    return f"""
with tpl(ord, licence, notice) as (values {values}),
tterm as (select ord, licence, unnest({split('notice')}) as term from tpl),
ttf as (select ord, licence, term, count(*)::double as tf from tterm group by all),
base as (select doc_id, coalesce(source, '') || '/' || (doc_id // {per_dir})::varchar || '/' || doc_id::varchar || '.txt' as path,
                coalesce(text, '') as text from documents),
files as (select doc_id, path, text, row_number() over () as key from base),
n as (select count(*)::double as n from files),
df as (select term, count(*)::double as df from (select unnest(list_distinct({split('text')})) as term from files) group by term),
idf as (select term, ln((n + 1) / (df + 1)) + 1 as idf from df, n),
tvec as (select ord, licence, term, tf * coalesce(idf, (select ln(n + 1) + 1 from n)) as w from ttf left join idf using (term)),
tnorm as (select ord, licence, sqrt(sum(w * w)) as norm from tvec group by all),
lines as (select key, string_split(text, chr(10)) as p from files),
cut as (select key, -1 as pos, text as passage from files
        union all
        select key, pos, passage from (
          select key, unnest(p) as passage, unnest(range(len(p))) as pos
          from (select key, string_split(regexp_replace(text, '([.!?;])[ \\t\\n\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)) as p from files)){windows}),
tf as (select key, pos, term, count(*)::double as tf from (select key, pos, unnest({split('passage')}) as term from cut) group by all),
w as (select key, pos, term, tf * idf as w from tf join idf using (term)),
sq as (select key, pos, sum(w * w) as square from w group by all),
dot as (select key, pos, ord, licence, sum(w.w * tvec.w) as dot from w join tvec using (term) group by all),
cosine as (select key, pos < 0 as whole, licence, ord, round(dot / sqrt(square) / norm, 9) as score
           from dot join sq using (key, pos) join tnorm using (ord, licence)
           union all
           select key, false, regexp_extract(text, '{SPDX}', 1), -1, 1.0 from files where regexp_matches(text, '{SPDX}')),
best as (select * from (select *, row_number() over (partition by key, whole order by score desc, ord) as r from cosine
         where score >= case when whole then {WHOLE} else {PASSAGE} end) where r = 1),
own as (select key, path, doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, h.licence as hl, h.score as hs, a.licence as al, a.score as as_
        from files left join (select * from best where not whole) h using (key) left join (select * from best where whole) a using (key)),
given as (select dir as above, al as licence, as_ as score, path as from_path from (
            select *, row_number() over (partition by dir order by as_ desc, path) as r from own where al is not null and path is not null) where r = 1),
dirs as (select distinct dir from own where path is not null),
parts as (select dir, string_split(dir, '/') as p from dirs),
anc as (select dir, 0 as depth, '' as above from parts
        union all select dir, k as depth, array_to_string(p[1:k], '/') as above from (select dir, p, unnest(range(1, len(p) + 1)) as k from parts)),
inh as (select * from (select dir, g.*, row_number() over (partition by dir order by depth desc) as r from anc join given g using (above)) where r = 1)
select own.doc_id, own.path, coalesce(hl, al, inh.licence) as licence, round(coalesce(hs, as_, inh.score), 6) as score,
       case when coalesce(hl, al) is not null then 'own' when inh.licence is not null then 'inherited' end as origin,
       case when coalesce(hl, al) is not null then own.path else inh.from_path end as from_path
from own left join inh using (dir)
"""
