"""Licence scan in DataFrame operations: TF-IDF cosine to templates, then inheritance from directories.

Every line of a text is a possible header or part of a licence file. Its terms (function words left
out) are weighted by count and by idf over all lines of the corpus; terms that no template has share the
idf of a term never seen. A line's licence is the template with the largest cosine, if that reaches
``LEAST``; a file's is its best line's. A directory has the licence that most of its licence files name; a file
without one of its own takes that of its nearest ancestor directory that has one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import materialise

#: Template headers and openings of licence files, by licence. A bounded list: its terms may be broadcast.
TEMPLATES = {
    "MIT": ("Released under the MIT License", "Licensed under the MIT license", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal Public Domain Dedication", "To the extent possible under law, the author has waived all copyright"),
}
STOP = ("a", "an", "and", "any", "as", "at", "be", "by", "can", "for", "has", "hereby", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "use", "with", "you", "your", "are", "following", "all")
LEAST = 0.6
#: A file is a licence file if its name says so or this share of its lines with terms, in percent, match a template.
FILE_NAMES, FILE_SHARE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$", 10
_SEP = r"[^a-z0-9.]+"


def _terms(text: str) -> list[str]:
    return [t for w in re.split(_SEP, text.lower()) if (t := w.strip(".")) and t not in STOP]


def vocabulary() -> list[str]:
    return sorted({t for v in TEMPLATES.values() for x in v for t in _terms(x)})


def _words(line: Column) -> Column:
    trimmed = F.transform(F.split(F.lower(line), _SEP), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.filter(trimmed, lambda w: (w != "") & ~w.isin(*STOP))


def _vectors(spark, df_rows: DataFrame, n_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, idf) of the vocabulary with the idf of unseen terms, and (template, licence, term, weight) of unit length."""
    vocab = spark.createDataFrame([(t,) for t in vocabulary()], "term string")
    idf = vocab.join(df_rows, "term", "left").crossJoin(F.broadcast(n_lines)).select("term", (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"), (F.log(F.col("n") + 1) + 1).alias("unseen"))
    counts = [(k, lic, t, float(ts.count(t))) for k, (lic, x) in enumerate((lic, x) for lic, v in TEMPLATES.items() for x in v) for ts in [_terms(x)] for t in sorted(set(ts))]
    tf = spark.createDataFrame(counts, "template int, licence string, term string, tf double").join(idf, "term")
    norm = tf.groupBy("template").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    return idf, tf.join(norm, "template").select("template", "licence", "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def _able(lines: DataFrame, idf: DataFrame, vocab: Column) -> DataFrame:
    """The lines whose cosine can reach LEAST: it is at most the share of the templates' terms in the line's length, where
    n other terms add at least n times the square of the unseen idf. The idf table is as long as the vocabulary, so it comes as a literal."""
    rows = idf.collect()
    of = F.create_map(*[F.lit(x) for r in rows for x in (r["term"], float(r["idf"]))])
    u = float(rows[0]["unseen"])
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    found = F.transform(F.array_intersect("w", vocab), lambda t: F.struct(count(t).alias("n"), (count(t) * of[t]).alias("x")))
    inside = F.aggregate("found", F.lit(0.0), lambda a, x: a + x["x"] * x["x"])
    others = F.size("w") - F.aggregate("found", F.lit(0), lambda a, x: a + x["n"])
    lines = lines.withColumn("found", found).withColumn("inside", inside).withColumn("others", others)
    return materialise(lines.where(F.col("inside") >= (LEAST - 1e-6) ** 2 * (F.col("inside") + F.col("others") * u * u)).drop("found", "inside", "others"), "able")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(doc_id, path, licence, score, via, from_dir), one row per input row.

    via is direct, inherited or none; score is the cosine of the best line, six decimals, null unless direct; ties go to the
    licence that is first by name. Null and empty texts have no licence of their own; a null path is in no
    directory and inherits nothing; '/' parts the path, and files at the top are in directory ''. Rows that repeat
    id, path and text are each returned. Only three columns are read; an empty table gives no rows.

    Rows are told apart by a hash of path, id and text, so nothing depends on the order of partitions. Lines without
    a template term, whose cosine is 0, and then those too long for their template terms, go before anything is shuffled.
    """
    spark = files.sparkSession
    vocab = F.array(*[F.lit(t) for t in vocabulary()])
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), text.alias("text"), F.xxhash64(F.col(path_col).cast("string"), F.col(id_col), text).alias("row"))
    base = base.select("id", "path", "row", "text", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    lines_of = F.split("text", "\n")
    full = F.when(F.length("text") > 0, F.size(F.filter(lines_of, lambda x: F.trim(x) != ""))).otherwise(0)
    n_lines = materialise(base.agg(F.coalesce(F.sum(full), F.lit(0)).alias("n")), "lines")
    # the number of lines is found below the explosion, which then needs the text no more
    own = base.select("row", "text", full.alias("lines")).select("row", F.posexplode(lines_of).alias("line", "s"), "lines").select("row", "line", "lines", _words(F.col("s")).alias("w")).where(F.arrays_overlap("w", vocab))
    own = materialise(own, "hits")
    df_rows = own.select(F.explode(F.array_intersect("w", vocab)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf, templates = _vectors(spark, materialise(df_rows, "df"), n_lines)
    idf, templates = materialise(idf, "idf"), materialise(templates, "templates")
    own = _able(own, idf, vocab)
    terms = own.distinct().select("row", "line", "lines", F.explode("w").alias("term")).groupBy("row", "line", "lines", "term").agg(F.count("*").alias("tf"))
    weighted = terms.join(F.broadcast(idf), "term", "left")
    unseen = F.broadcast(idf.agg(F.max("unseen").alias("u")))
    weighted = weighted.join(unseen).select("row", "line", "lines", "term", (F.col("tf") * F.coalesce("idf", "u")).alias("x"))
    by_template = weighted.join(F.broadcast(templates), "term", "left")
    # one pass gives both the norm (terms counted once) and the products
    norms = weighted.groupBy("row", "line", "lines").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    dots = by_template.where("template is not null").groupBy("row", "line", "template", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    best = dots.join(norms, ["row", "line"]).select("row", "line", "lines", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= LEAST)
    line_best = best.groupBy("row", "line", "lines").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    direct = line_best.groupBy("row").agg(F.min("b").alias("b"), F.count("*").alias("matched"), F.max("lines").alias("lines"))
    direct = materialise(direct.select("row", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"), (100 * F.col("matched") >= FILE_SHARE * F.col("lines")).alias("mostly")), "direct")
    rows = materialise(base.select("id", "path", "row", "dir", "name").join(direct, "row", "left"), "rows")

    names = rows.where("licence is not null and path is not null").where(F.col("mostly") | F.col("name").rlike(FILE_NAMES))
    votes = names.groupBy("dir", "licence").agg(F.count("*").alias("n"))
    dirs = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "licence")).alias("b")).select(F.col("dir").alias("up"), F.col("b.licence").alias("got"))
    dirs = materialise(dirs, "dirs")
    # directories, not files, look up their ancestors
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))
    wanted = rows.where("path is not null").select("dir").distinct().select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(ups)).alias("up"))
    near = wanted.join(dirs, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("k"), "up", "got")).alias("b"))
    near = materialise(near.select("dir", F.col("b.got").alias("got"), F.col("b.up").alias("from_dir")), "near")
    out = rows.where("path is not null").join(near, "dir", "left").select("id", "path", "licence", "score", "got", "from_dir")
    out = out.unionByName(rows.where("path is null").select("id", "path", "licence", "score", F.lit(None).cast("string").alias("got"), F.lit(None).cast("string").alias("from_dir")))
    via = F.when(F.col("licence").isNotNull(), "direct").when(F.col("got").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("id").alias("doc_id"), "path", F.coalesce("licence", "got").alias("licence"), "score", via.alias("via"), F.when(F.col("licence").isNull(), F.col("from_dir")).alias("from_dir"))


#: Documents have no path: their source, language and 20 ids each stand for directories.
PATH_SQL = "concat(coalesce(source, ''), '/', coalesce(lang, ''), '/', coalesce(cast(doc_id div 20 as string), ''), '/', coalesce(cast(doc_id as string), ''))"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", F.expr(PATH_SQL).alias("path"), "text"))


def _sql() -> str:
    rows = ", ".join(f"({k}, '{lic}', '{t}', {ts.count(t)}.0)" for k, (lic, x) in enumerate((lic, x) for lic, v in TEMPLATES.items() for x in v) for ts in [_terms(x)] for t in sorted(set(ts)))
    stop = ", ".join(f"'{s}'" for s in STOP)
    return f"""
with t0(template, licence, term, tf) as (values {rows}),
vocab as (select distinct term from t0),
base as (select row_number() over () as r, doc_id, coalesce(text, '') as text,
  concat(coalesce(source, ''), '/', coalesce(lang, ''), '/', coalesce((doc_id // 20)::varchar, '')) as dir, coalesce(doc_id::varchar, '') as name from documents),
ln as (select r, k, string_split(text, chr(10))[k] as s, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) as lines
  from (select r, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as k from base)),
nl as (select sum(lines) as n from (select r, any_value(lines) as lines from ln group by r)),
tm as (select r, k, lines, regexp_replace(unnest(string_split_regex(lower(s), '[^a-z0-9.]+')), '^\\.+|\\.+$', '', 'g') as term from ln),
tc as (select r, k, any_value(lines) as lines, term, count(*) as tf from tm where term <> '' and term not in ({stop}) group by r, k, term),
hit as (select distinct r, k from tc semi join vocab using (term)),
df as (select term, count(*) as df from tc semi join vocab using (term) group by term),
idf as (select term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 as idf from vocab left join df using (term), nl),
un as (select ln(n + 1) + 1 as u from nl),
tw as (select template, licence, term, tf * idf / sqrt(sum((tf * idf) ** 2) over (partition by template)) as weight from t0 join idf using (term)),
lx as (select r, k, lines, term, tf * coalesce(idf, u) as x from tc semi join hit using (r, k) left join idf using (term), un),
no as (select r, k, any_value(lines) as lines, sqrt(sum(x ** 2)) as norm from lx group by r, k),
sc as (select r, k, lines, licence, round(sum(x * weight) / any_value(norm), 6) as score from lx join tw using (term) join no using (r, k, lines) group by r, k, lines, template, licence),
lb as (select r, k, lines, min(struct_pack(s := -score, l := licence)) as b from sc where score >= {LEAST} group by r, k, lines),
di as (select r, min(b) as b, 100 * count(*) >= {FILE_SHARE} * max(lines) as mostly from lb group by r),
rw as (select base.r, doc_id, dir, dir || '/' || name as path, b.l as licence, -b.s as score, mostly, name from base left join di using (r)),
vo as (select dir, licence, count(*) as n from rw where licence is not null and mostly group by dir, licence),
dr as (select dir as up, min(struct_pack(n := -n, l := licence)).l as got from vo group by dir),
ne as (select dir, max(struct_pack(k := length(up), up := up, got := got)) as b from (select distinct dir from rw) join dr on dir = up or starts_with(dir, up || '/') or up = '' group by dir)
select doc_id, path, coalesce(licence, b.got) as licence, score, case when licence is not null then 'direct' when b.got is not null then 'inherited' else 'none' end as via,
  case when licence is null then b.up end as from_dir from rw left join ne using (dir)
"""


SQL = _sql()
