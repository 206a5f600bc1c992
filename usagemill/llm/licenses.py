"""License scans: normalised text against templates by the Dice coefficient over word bigrams, without Python.

The lines of a text, and its paragraphs of several lines, are the segments. A segment of a different bigrams can reach
Dice t only with templates of t / (2 - t) * a to (2 - t) / t * a bigrams: templates are spread over the sizes they
admit and joined with segments by equal size, so that a segment is compared with nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Notices of well-known licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
LEAST = 0.8
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), _GAP), lambda x: x != "")


def bigrams(own: Column) -> Column:
    """Different pairs of neighbouring words; a single word is its own pair."""
    pairs = F.zip_with(F.slice(own, F.lit(1), F.size(own) - 1), F.slice(own, F.lit(2), F.size(own) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(own) > 1, F.array_distinct(pairs)).otherwise(own)


def template_table(spark: SparkSession, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(license, template, grams, n): one row for each size of a segment that could reach ``least``."""
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(templates)], "template int, license string, text string")
    own = rows.select("template", "license", bigrams(words(F.col("text"))).alias("grams")).where(F.size("grams") > 0)
    low, high = F.ceil(F.size("grams") * (least / (2 - least)) - 1e-9), F.floor(F.size("grams") * ((2 - least) / least) + 1e-9)
    return own.withColumn("n", F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def matches(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(_id, sig, segment, license, template, dice) of every segment that reaches ``least`` with a template.

    _id and sig are hashes of doc_id (which may be null) and text. Segments are numbered: lines first, then paragraphs of several lines. The list of templates is an argument held by the
    driver, so its table may be broadcast. A null text has no segments.
    """
    text = F.col("text").cast("string")
    known = template_table(docs.sparkSession, templates, least)
    sizes = known.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    # Every different word but the first ends some bigram, so bigrams are at least the different words less one.
    paragraphs = F.filter(F.split(text, r"\r?\n[\x20\t]*\r?\n"), lambda p: p.contains("\n"))
    rows = docs.where(text.isNotNull()).select(F.xxhash64("doc_id").alias("_id"), F.xxhash64(text).alias("sig"), F.posexplode(F.concat(F.split(text, r"\r?\n"), paragraphs)).alias("segment", "line"))
    said = rows.select("_id", "sig", "segment", words(F.col("line")).alias("w")).where(F.size("w") >= (sizes["lo"] or 0))
    said = said.where(F.size(F.array_distinct("w")) - 1 <= (sizes["hi"] or 0))
    cut = said.select("_id", "sig", "segment", bigrams(F.col("w")).alias("own")).withColumn("n", F.size("own"))
    both = cut.join(F.broadcast(known), "n")
    dice = 2.0 * F.size(F.array_intersect("own", "grams")) / (F.size("own") + F.size("grams"))
    return both.select("_id", "sig", "segment", "license", "template", dice.alias("dice")).where(F.col("dice") >= least)


def report(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row for each document: license (the best match; ties: smallest segment, then template), dice, n_segments that match, and all licenses by name.

    Without a match license is null, dice 0 and licenses empty. Repeated rows each get a row.
    """
    best = F.struct((-F.col("dice")).alias("d"), "segment", "template", "license")
    found = matches(docs, templates, least).groupBy("_id", "sig").agg(F.min(best).alias("b"), F.count_distinct("segment").alias("n"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"))
    found = found.select("_id", "sig", F.col("b.license").alias("license"), F.round(-F.col("b.d"), 6).alias("dice"), "n", "licenses")
    ids = docs.select("doc_id", F.xxhash64("doc_id").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("sig"))
    out = ids.join(found, ["_id", "sig"], "left")
    return out.select("doc_id", "license", F.coalesce("dice", F.lit(0.0)).alias("dice"), F.coalesce("n", F.lit(0)).cast("long").alias("n_segments"), F.coalesce("licenses", F.lit("")).alias("licenses"))
