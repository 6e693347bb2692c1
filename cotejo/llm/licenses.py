"""License scan with DataFrame functions only.

Documents and templates are cut into overlapping windows of ``WIDE`` shingles, templates at every
shingle and documents at every ``STEP``-th, and each window has BANDS MinHash values as band keys.
A document window inside a copy of a template of WIDE + STEP - 1 shingles or more equals one of its
windows; for a shorter template of more than SHORT shingles the best window has at least
(SHORT) / (WIDE + 1) in common, so all bands miss it with a chance of (4 / 9) ** 16 = 2e-6.  Templates
of up to SHORT shingles are looked up by windows of one shingle, whose only MinHash is sure to
collide.  Retrieved templates are verified by exact shingle containment in the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.plans.saved import saved

SIZE, WIDE, STEP, BANDS, SHORT = 5, 8, 4, 16, 5
#: The band of windows of one shingle.
ONE = -1
#: Band keys of templates, and retrieved pairs, are broadcast up to so many rows; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

#: Short texts by which works state their licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0-text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-text", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-text", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense-text", "This is free and unencumbered software released into the public domain."),
]


def default_templates(spark: SparkSession) -> DataFrame:
    """(template, text)."""
    return spark.createDataFrame(TEMPLATES, "template string, text string")


def shingles(text: Column) -> Column:
    """Hashes of each SIZE words in a row; words are runs of letters (lower-cased), digits and non-ASCII characters.  Fewer words, or null, have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")

    def of(ws: Column) -> Column:
        starts = F.when(F.size(ws) >= SIZE, F.sequence(F.lit(0), F.size(ws) - SIZE)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(SIZE)]))

    # the words are named once, so they are split once
    return F.element_at(F.transform(F.array(words), of), 1)


def band_key(own: Column, at: Column, band: Column) -> Column:
    """Key of a window at ``at``: its least hash under the band's function; band ONE has the single shingle itself.

    A window at the end is filled up with the last shingle.  Bands hash apart, so keys need no band beside them.
    The band is a row's value, not one of BANDS columns: so many hashes in one row's code are not compiled.
    """
    last = F.size(own) - 1
    least = F.least(*[F.xxhash64(F.get(own, F.least(at + j, last)), band) for j in range(WIDE)])
    return F.coalesce(F.when(band == ONE, F.get(own, at)).otherwise(least), F.lit(0).cast("long"))


def windows(df: DataFrame, kinds: Column) -> DataFrame:
    """df (own) with at and key for every place of own and each band of ``kinds``, which may use at.

    The outer explodes keep Spark from deriving filters on own, for which it would hash all words again.
    """
    place = F.when(F.size("own") > 0, F.sequence(F.lit(0), F.size("own") - 1))
    df = df.select("*", F.explode_outer(place).alias("at"))
    df = df.select("*", F.explode_outer(kinds).alias("band")).where("band IS NOT NULL")
    return df.withColumn("key", band_key(F.col("own"), F.col("at"), F.col("band"))).drop("band")


def scan(docs: DataFrame, templates: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, template, contained) for each document and template with 100 * contained >= percent * shingles.

    contained counts the template's distinct shingles in the whole document.  docs has doc_id and text,
    templates template and text; other columns are not read.  Null or short texts (below SIZE words)
    contain nothing and are contained nowhere; equal templates are each found; rows that share a doc_id
    count as one document and those without doc_id are not scanned.
    """
    one, wide = F.array(F.lit(ONE)), F.sequence(F.lit(0), F.lit(BANDS - 1))
    templates = templates.select("template", F.array_distinct(shingles(F.col("text"))).alias("parts"), shingles(F.col("text")).alias("own")).where("template IS NOT NULL AND size(own) > 0")
    # templates of one name are told apart by their shingles
    templates = templates.withColumn("which", F.xxhash64("parts"))
    keys = windows(templates, F.when(F.size("own") <= SHORT, one).when(F.col("at") <= F.greatest(F.size("own") - WIDE, F.lit(0)), wide))
    keys = keys.select("template", "which", "key").distinct()
    parts = templates.select("template", "which", "parts").distinct()
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    asked = windows(docs.select("doc_id", shingles(F.col("text")).alias("own")), F.when(F.col("at") % STEP == 0, F.concat(one, wide)).otherwise(one)).drop("own", "at")
    found = saved(asked.join(F.broadcast(keys) if small else keys, "key").select("doc_id", "template", "which").distinct())
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # the retrieved pairs meet their documents' whole texts
    found = docs.join(F.broadcast(found) if few else found, "doc_id").select("doc_id", "template", "which", shingles(F.col("text")).alias("own"))
    found = found.join(F.broadcast(parts) if small else parts, ["template", "which"])
    found = found.select("doc_id", "template", "which", F.size("parts").alias("n"), F.explode(F.array_intersect("own", "parts")).alias("part"))
    found = found.groupBy("doc_id", "template", "which", "n").agg(F.count_distinct("part").alias("contained"))
    found = found.where(100 * F.col("contained") >= percent * F.col("n"))
    return found.groupBy("doc_id", "template").agg(F.max("contained").alias("contained"))


def by_document(docs: DataFrame, templates: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, templates) of every row of docs: the sorted names of the templates found in it."""
    found = scan(docs, templates, percent).groupBy("doc_id").agg(F.array_sort(F.collect_set("template")).alias("templates"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("templates", F.array().cast("array<string>")).alias("templates"))
