"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line. Block and template are sets of lower-case words of ASCII letters and digits; a
block matches where it holds at least THRESHOLD of a template's words. The join orders words by their
frequency over all blocks, rarest first, and applies
- the length filter: a block with fewer of the templates' words than the overlap asks for can't match;
- the prefix filter: with o words to share, the first shared word is among the first |T|-o+1 of the
  template and the first |B|-o+1 of the block;
- the positional filter: from a shared word on, either side must have enough words left.
What is left is verified by counting the shared words. Words that no template has can't be shared, so
blocks are cut to the templates' vocabulary first, which changes no result.

Cost: two narrow scans of the text, of which only blocks that pass the length filter reach the join;
the broadcast side is the templates, whose size doesn't depend on the corpus.

Notices that are wrapped over several lines meet no template line by line. ``wrapped`` takes runs of consecutive
lines as blocks too, as many as a template fills at LINE_WORDS words a line and one more, and gives the runs that
hold no shorter one. The query op1_license_scan has the blocks of its SQL, which are single lines.

Defined cases: null and blank texts and lines have no words and match nothing; rows that repeat an id
each give their matches; a null id is kept; each of several templates that a line meets gives a row;
a template whose words are all in another one's is also found there; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import table, written

THRESHOLD = 0.8
#: Words of a template that a line of a wrapped notice holds at least, on the average.
LINE_WORDS = 6

#: Notices as they stand in files, by license.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Proprietary", "All rights reserved"),
]


def split_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", text.lower()) if w))


def needed(size: int, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def blocks(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, block, _w): the lines of all documents that hold words of the vocabulary, and these words."""
    vocab = F.array(*map(F.lit, vocabulary))
    line: Column = F.col("_line")
    return (
        docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "_line"))
        .select("doc_id", "block", F.array_intersect(vocab, F.split(F.lower(line), "[^a-z0-9]+")).alias("_w"))
        .filter(F.size("_w") > 0)
    )


def most_lines(size: int) -> int:
    return math.ceil(size / LINE_WORDS) + 1


def runs(docs: DataFrame, vocabulary: list[str], most: int) -> DataFrame:
    """(_doc, doc_id, block, lines, _w): as blocks(), for runs of 1 to most lines whose first and last line hold such words; _doc tells rows apart."""
    vocab = F.array(*map(F.lit, vocabulary))
    lines = F.transform(F.split("text", "\n"), lambda x: F.array_intersect(vocab, F.split(F.lower(x), "[^a-z0-9]+")))
    return (
        docs.filter("text is not null").select("doc_id", F.monotonically_increasing_id().alias("_doc"), lines.alias("_l"))
        .select("_doc", "doc_id", F.posexplode(F.transform("_l", lambda x, i: F.slice("_l", i + 1, F.lit(most)))).alias("block", "_l"))
        .filter(F.size(F.get("_l", F.lit(0))) > 0)
        .select("_doc", "doc_id", "block", "_l", F.explode(F.sequence(F.lit(1), F.size("_l"))).alias("lines"))
        .filter(F.size(F.get("_l", F.col("lines") - 1)) > 0)
        .select("_doc", "doc_id", "block", "lines", F.array_distinct(F.flatten(F.slice("_l", F.lit(1), F.col("lines")))).alias("_w"))
    )


def wrapped(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, block, lines, license, template, shared, containment): the runs of lines from block on that meet a template and hold no shorter run that does."""
    sets = [split_words(t) for _, t in templates]
    most = max((most_lines(len(s)) for s in sets), default=1)
    found = written(runs(docs.select("doc_id", "text"), sorted({w for s in sets for w in s}), most), "license-runs")
    met = _join(found, templates, threshold, ["_doc", "doc_id", "lines"]).filter(F.col("lines") <= F.ceil(F.col("_size") / LINE_WORDS) + 1)
    first = met.groupBy("_doc", "doc_id", "block", "license", "template").agg(F.min(F.struct("lines", "shared", "containment")).alias("_m"))
    end = F.col("block") + F.col("_m.lines")
    later = F.min(end).over(Window.partitionBy("_doc", "template").orderBy("block").rowsBetween(1, Window.unboundedFollowing))
    return (
        first.withColumn("_later", later).filter(F.col("_later").isNull() | (F.col("_later") > end))
        .select("doc_id", "block", F.col("_m.lines").cast("long").alias("lines"), "license", "template", "_m.shared", "_m.containment")
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, block, license, template, shared, containment): every line and template that meet the threshold."""
    vocabulary = sorted({w for _, t in templates for w in split_words(t)})
    found = written(blocks(docs.select("doc_id", "text"), vocabulary), "license-blocks")
    return _join(found, templates, threshold, ["doc_id"]).select("doc_id", "block", "license", "template", "shared", "containment")


def _join(found: DataFrame, templates: list[tuple[str, str]], threshold: float, keep: list[str]) -> DataFrame:
    """The blocks and templates that meet the threshold."""
    spark = found.sparkSession
    sets = [split_words(t) for _, t in templates]
    vocabulary = sorted({w for s in sets for w in s})
    # The global order: as many rows as the templates have words.
    seen = {r.w: r.n for r in found.select(F.explode("_w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    heads = []
    for k, ((name, _), s) in enumerate(zip(templates, sets, strict=True)):
        o, ranks = needed(len(s), threshold), sorted(order[w] for w in s)
        heads += [(r, k, name, i, len(s), o, ranks) for i, r in enumerate(ranks[: len(s) - o + 1])]
    head = spark.createDataFrame(heads, "_r int, template int, license string, _i int, _size int, _o int, _t array<int>")
    least = min((h[5] for h in heads), default=1)
    rank = F.create_map(*[x for w, r in order.items() for x in (F.lit(w), F.lit(r))])
    ranked = found.filter(F.size("_w") >= least).withColumn("_b", F.sort_array(F.transform("_w", lambda w: F.element_at(rank, w)))).drop("_w")
    posted = ranked.select("*", F.posexplode(F.slice("_b", F.lit(1), F.size("_b") - (least - 1))).alias("_j", "_r"))
    left = F.least(F.col("_size") - F.col("_i"), F.size("_b") - F.col("_j"))
    shared = F.size(F.array_intersect("_b", "_t"))
    return (
        posted.join(F.broadcast(head), "_r")
        .filter((F.size("_b") >= F.col("_o")) & (F.col("_j") <= F.size("_b") - F.col("_o")) & (left >= F.col("_o")))
        # of the prefix words that both have, the first one speaks for the pair
        .filter(F.get(F.array_intersect("_b", "_t"), F.lit(0)) == F.col("_r"))
        .withColumn("shared", shared.cast("long"))
        .filter(F.col("shared") >= F.col("_o"))
        .select(*keep, "_size", F.col("block").cast("long").alias("block"), "license", F.col("template").cast("long").alias("template"), "shared", F.round(F.col("shared") / F.col("_size"), 4).alias("containment"))
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    rows = ", ".join(f"({k}, '{name}', {split_words(t)!r}, {needed(len(split_words(t)))})" for k, (name, t) in enumerate(TEMPLATES))
    return f"""
WITH templates AS (SELECT * FROM (VALUES {rows}) AS t(template, license, words, o)),
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS block, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
blocks AS (SELECT doc_id, block, list_distinct(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS words FROM lines),
pairs AS (SELECT doc_id, block, license, template, len(list_intersect(b.words, t.words)) AS shared, len(t.words) AS size, o FROM blocks b, templates t)
SELECT doc_id, block::BIGINT AS block, license, template::BIGINT AS template, shared::BIGINT AS shared, round(shared / size, 4) AS containment
FROM pairs WHERE shared >= o"""
