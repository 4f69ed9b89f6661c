"""Licences of files: notices in their texts, licence files, and what directories hand down.

Texts are compared with licence templates as sparse TF-IDF vectors over words; document frequencies
come from all texts. A notice is compared over runs of consecutive lines and sentences, so it may be
wrapped anywhere; a run close enough to a template is a header. A whole text close enough to a notice
or to a full licence text (`texts/`) is a licence file, which holds for its directory. A file without
a header takes the licence of the nearest directory above it that has one. Only DataFrame functions run.
"""

from __future__ import annotations

import math
import re
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseframe.llm.shared import keep, text_or_empty

# Usual notices of common licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
            "to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a "
                   "copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the "
                "terms of the GNU General Public License as published by the Free Software Foundation, "
                "either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, "
                     "are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
)
#: Licences whose full text is a template for whole files.
TEXTS = ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "GPL-1.0", "LGPL-3.0", "LGPL-2.1", "LGPL-2.0", "BSD-3-Clause",
         "BSD-2-Clause", "MPL-2.0", "MPL-1.1", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Ends of lines, and of sentences followed by a space.
CUT = r"\n|(?<=[.!?])\x20+"
HEADER, FILE = 0.75, 0.6
#: Words of the longest run of several pieces: twice those of the longest notice.
LONGEST = 2 * max(len(re.findall(TOKEN, text.lower())) for _, text in TEMPLATES)
#: What starts a line of a comment and reads as a word.
MARK = r"(?im)^[^a-z0-9\n]*(?:dnl|rem)\b"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _damped(count: Column) -> Column:
    """Weight of a word by its count in a text, so that 'the' does not make up a long text."""
    return 1 + F.log(count)


def _template_terms(spark) -> DataFrame:
    """number, licence, whole, term, tf: as many rows as the templates have words."""
    folder = resources("caseframe.llm") / "texts"
    rows = [(name, False, text) for name, text in TEMPLATES]
    rows += [(name, True, (folder / f"{name}.txt").read_text("utf-8")) for name in TEXTS]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)],
                                  "number int, licence string, whole boolean, text string")
    return (table.select("number", "licence", "whole", F.explode(tokens(F.col("text"))).alias("term"))
            .groupBy("number", "licence", "whole", "term").agg(_damped(F.count("*")).alias("tf")))


def frequencies(files: DataFrame) -> DataFrame:
    """term and df: the number of texts that hold each word, over all texts."""
    return (files.select(F.explode(F.array_distinct(tokens(text_or_empty()))).alias("term"))
            .groupBy("term").agg(F.count("*").alias("df")))


def _vectors(spark, counts: DataFrame, total: int) -> tuple[DataFrame, list[str], list[str]]:
    """Unit vectors of the templates, and the words one of which a text must have to be near a
    notice, or near a full text.

    The terms of the templates are all that reaches the driver. Without any of a template's heaviest
    words a text comes at most as near as the rest of the template is long (Cauchy-Schwarz). So words
    are taken, those first that weigh much and are in few texts, until the rest is shorter than the
    lower threshold.
    """
    parts = _template_terms(spark).collect()
    terms = sorted({r.term for r in parts})
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    found = {r.term: r.df for r in counts.join(F.broadcast(table), "term").collect()}
    idf = {t: math.log((2 + total) / (1 + found.get(t, 0))) for t in terms}
    needed: dict[bool, set[str]] = {False: set(), True: set()}
    rows = []
    by_number: dict[int, list] = {}
    for r in parts:
        by_number.setdefault(r.number, []).append(r)
    for own in by_number.values():
        weight = {r.term: r.tf * idf[r.term] for r in own}
        length = math.sqrt(sum(x * x for x in weight.values()))
        rest = sorted(weight, key=lambda t: (weight[t] ** 2 / (1 + found.get(t, 0)), t))
        while math.sqrt(sum(weight[t] ** 2 for t in rest)) >= 0.999 * min(HEADER, FILE) * length:
            needed[own[0].whole].add(rest.pop())
        rows += [(r.number, r.licence, r.whole, r.term, idf[r.term], weight[r.term] / length) for r in own]
    table = spark.createDataFrame(
        rows, "number int, licence string, whole boolean, term string, idf double, w double")
    return table, sorted(needed[False]), sorted(needed[True])


def runs(texts: DataFrame, anchors: list[str], known: list[str]) -> DataFrame:
    """key and words of the runs of consecutive pieces of each text (key, text) that hold an anchor.

    Pieces are lines and sentences; those without a word do not count. A run has one piece, or several
    with at most LONGEST words; its first and last piece have a known word, as without them it would
    be nearer to any template. Each run comes from its first piece with an anchor.
    """
    def has(words: list[str]):
        return lambda piece: F.arrays_overlap(piece, F.array(*map(F.lit, words)))

    def reach(at: Column, step: int, most: Column) -> Column:
        """How many pieces on from `at` a run may go; before it, up to another anchor."""
        def onwards(so, k):
            place = at + step * k
            words = so["words"] + F.get("sizes", place)
            open_ = (so["far"] == k - 1) & (words <= LONGEST)
            open_ = open_ & ~F.get("marks", place) if step < 0 else open_
            return F.struct(F.when(open_, words).otherwise(so["words"]).alias("words"),
                            F.when(open_, k).otherwise(so["far"]).alias("far"))
        start = F.struct(F.get("sizes", at).alias("words"), F.lit(0).alias("far"))
        steps = F.filter(F.sequence(F.lit(0), F.least(most, F.lit(LONGEST))), lambda k: k > 0)
        return F.aggregate(steps, start, onwards, lambda so: so["far"])

    cut = texts.select("key", F.filter(F.transform(F.split(F.regexp_replace("text", MARK, ""), CUT), tokens),
                                       lambda p: F.size(p) > 0).alias("pieces"))
    cut = cut.filter(F.size("pieces") > 0).select(
        "*", F.transform("pieces", F.size).alias("sizes"), F.transform("pieces", has(anchors)).alias("marks"))
    last = F.size("pieces") - 1

    def around(at):
        back, on = reach(at, -1, at), reach(at, 1, last - at)
        return F.struct(at.alias("at"), back.alias("back"), F.slice("pieces", at - back + 1, back + on + 1).alias("near"))

    spots = cut.select("key", F.explode(F.transform(
        F.filter(F.sequence(F.lit(0), last), lambda k: F.get("marks", k)), around)).alias("spot"))
    spots = spots.select("key", "spot.*").withColumn("known", F.transform("near", has(known)))

    def ends(a):
        stops = F.filter(F.sequence(F.col("back"), F.size("near") - 1), lambda b: F.get("known", b))
        return F.transform(stops, lambda b: F.flatten(F.slice("near", a + 1, b - a + 1)))

    starts = F.filter(F.sequence(F.lit(0), F.col("back")), lambda a: F.get("known", a))
    each = spots.select("key", "at", F.posexplode(F.flatten(F.transform(starts, ends))).alias("run", "words"),
                        F.get(F.transform("near", F.size), F.col("back")).alias("_least"))
    return each.filter(F.size("words") <= F.greatest(F.col("_least"), F.lit(LONGEST))).select(
        F.struct("key", "at", "run").alias("key"), "words")


def cosines(texts: DataFrame, vectors: DataFrame, counts: DataFrame, total: int, least: float) -> DataFrame:
    """key, licence and score: the nearest template of each text (key, long, words), if near enough.

    Texts that are not long meet no full texts. Ties go to the licence first by name. Words of the
    templates have their weight at hand; those of `counts` are fetched for the other words of the
    texts that are near enough if these words weigh nothing.
    """
    tf = (texts.select("key", "long", F.explode("words").alias("term"))
          .groupBy("key", "long", "term").agg(_damped(F.count("*")).alias("tf")))
    weight = F.broadcast(vectors.select("term", "idf").distinct())
    tf = keep(tf.join(weight, "term", "left").withColumn("x", F.col("tf") * F.col("idf")), "terms")
    square = F.sum(F.col("x") * F.col("x"))
    norm = tf.filter("idf is not null").groupBy("key").agg(square.alias("square"))
    dot = (tf.filter("idf is not null").join(F.broadcast(vectors.drop("idf")), "term").filter("long or not whole")
           .groupBy("key", "number", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot")))
    likely = keep(dot.join(norm, "key").filter(
        F.col("dot") >= (least - 1e-6) * F.sqrt("square")), "likely")
    rest = (tf.filter("idf is null").join(likely.select("key").distinct(), "key", "left_semi")
            .join(counts, "term").withColumn("x", F.col("tf") * F.log((2 + total) / (1 + F.col("df"))))
            .groupBy("key").agg(square.alias("rest")))
    near = likely.join(rest, "key", "left").withColumn("score", F.round(F.try_divide(
        "dot", F.sqrt(F.col("square") + F.coalesce("rest", F.lit(0.0)))), 9)).filter(F.col("score") >= least)
    best = Window.partitionBy("key").orderBy(F.desc("score"), "licence", "number")
    return near.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select(
        "key", "licence", "score")


def ancestors(path: Column) -> Column:
    """The directories of a path, the nearest first; the last is the root, ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)),
                       lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def licences(files: DataFrame) -> DataFrame:
    """path, licence, origin, score and holder of every row of files (path, text).

    origin is `file` for a licence file, `header` for a notice in the text, `inherited` for the
    licence file of the nearest directory above, whose path is the holder, else null with a null
    licence. Of several notices the nearest to its template counts, ties by name; of several
    licence files in a directory likewise, then the path first in order.

    Null and empty texts have no notice but inherit; a null path inherits nothing. Rows that repeat
    a path are each judged by their own text. Other columns are ignored; an empty table gives none.
    """
    spark = files.sparkSession
    slim = files.select(F.col("path").cast("string").alias("path"),
                        F.col("text").cast("string").alias("text"))
    counts, total = keep(frequencies(slim), "frequencies"), slim.count()
    vectors, brief, full = _vectors(spark, counts, total)

    def holds(word: Column) -> Column:
        return F.struct(*(F.arrays_overlap(word, F.array(*map(F.lit, needed))).alias(name)
                          for name, needed in (("brief", brief), ("long", full))))

    flags = F.filter(F.transform(F.array(tokens(F.col("text"))), holds), lambda so: so["brief"] | so["long"])
    hit = keep(slim.select("path", "text", F.inline(flags)).withColumn(
        "key", F.monotonically_increasing_id()), "anchored")
    known = sorted({t for _, text in TEMPLATES for t in re.findall(TOKEN, text.lower())})
    some = runs(hit.filter("brief"), brief, known).withColumn("long", F.lit(False))
    header = cosines(some, vectors, counts, total, HEADER)
    first = Window.partitionBy("doc").orderBy(F.desc("score"), "licence")
    header = header.withColumn("doc", F.col("key.key")).withColumn(
        "_k", F.row_number().over(first)).filter("_k = 1").select(
        F.col("doc").alias("key"), "licence", "score", F.lit("header").alias("origin"))
    texts = hit.select("key", "long", tokens(F.col("text")).alias("words"))
    whole = cosines(texts, vectors, counts, total, FILE).select(
        "key", "licence", "score", F.lit("file").alias("origin"))
    own = whole.union(header.join(whole, "key", "left_anti"))
    stated = keep(hit.select("key", "path", F.xxhash64("text").alias("mark")).join(own, "key"), "stated")

    held = stated.filter("origin = 'file' and path is not null").select(
        F.get(ancestors(F.col("path")), F.lit(0)).alias("dir"), "licence", "score", "path")
    top = Window.partitionBy("dir").orderBy(F.desc("score"), "licence", "path")
    held = held.withColumn("_k", F.row_number().over(top)).filter("_k = 1").drop("_k", "score")
    rows = slim.select("path", F.xxhash64("text").alias("mark"),
                       F.get(ancestors(F.col("path")), F.lit(0)).alias("dir"))
    folders = rows.select("dir").filter("dir is not null").distinct()
    above = folders.select("dir", F.posexplode(
        F.concat(F.array("dir"), F.filter(ancestors(F.col("dir")), lambda d: d != F.col("dir")))).alias(
        "depth", "up"))
    nearest = (above.join(held.toDF("up", "licence", "holder"), "up").groupBy("dir").agg(
        F.min(F.struct("depth", "licence", "holder")).alias("h"))
        .select("dir", F.col("h.licence").alias("passed"), F.col("h.holder").alias("from")))
    mine = stated.groupBy("path", "mark").agg(
        F.first("licence").alias("licence"), F.first("score").alias("score"),
        F.first("origin").alias("origin"))
    same = F.expr("r.path <=> o.path and r.mark = o.mark")
    joined = rows.alias("r").join(mine.alias("o"), same, "left").select(
        "r.path", "r.dir", "o.licence", "o.score", "o.origin").join(nearest, "dir", "left")
    return joined.select(
        "path", F.coalesce("licence", "passed").alias("licence"),
        F.coalesce("origin", F.when(F.col("passed").isNotNull(), "inherited")).alias("origin"), "score",
        F.when(F.col("origin").isNull(), F.col("from")).alias("holder"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: their source is the top directory, blocks of 64 ids the next."""
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    block = F.coalesce(F.expr("cast(doc_id as bigint) div 64").cast("string"), F.lit("-"))
    source = F.regexp_replace(F.coalesce(F.col("source").cast("string"), F.lit("-")), "/", "_")
    return docs.select(F.concat_ws("/", source, block, identity).alias("path"), "text",
                       F.col("doc_id").cast("bigint").alias("doc_id"))
