"""License scans: which documents carry a license notice, whole or nearly so.

All of it is DataFrame functions.  A template is a notice of L words; its shingles are ``SHINGLE``
consecutive words.  Text windows of L + L/4 words overlap so that every stretch of L words lies
whole in one of them.  A window and a template are compared when they agree in one of ``BANDS``
MinHash bands of one row each: a window that holds four fifths of the shingles has a Jaccard
similarity above 0.4 with the template, so at least one of 32 bands agrees with a probability
above 1 - 0.6**32, one miss in ten million.

A band can only agree in a window that holds the template's own minimum shingle of that band.  So
the scan first meets those few shingles (an equi join), and forms windows and signatures only
around the places it finds; no other window could be retrieved.  The containment of what is
retrieved is then counted on the words themselves.

Rules: words as in benchmark decontamination.  A template of fewer words than a shingle has one
shingle, all its words.  Null and empty texts hold nothing.  Repeated rows repeat in the result,
templates without words are left out, a null id stays null.
"""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import shingles_at, sized_broadcast, word_count, words
from .shared import checkpointed

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 32

# fixed values: whole notices and license texts, and the wording of short references to them
_TEXTS = {path.stem: path.read_text("utf-8") for path in sorted((Path(__file__).parent / "notices").glob("*.txt"))}
NOTICES = _TEXTS | {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "lgpl-library": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "lgpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _shingles(array: Column, k: int) -> Column:
    """Distinct shingles of an array of words, as texts; fewer words than a shingle are one."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(array) - k + 1, F.lit(1)))
    texts = F.transform(starts, lambda s: F.array_join(F.slice(array, s, k), " "))
    return F.when(F.size(array) > 0, F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))


def _signature(shingles: Column) -> Column:
    """One minimum per band."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda band: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, band))),
    )


def _templates(df: DataFrame, k: int) -> DataFrame:
    rows = df.select(F.col("name").alias("license"), F.array_remove(words(F.col("text")), "").alias("notice"))
    rows = rows.where(F.size("notice") > 0).dropDuplicates(["license", "notice"])
    rows = rows.select("license", "notice", _shingles(F.col("notice"), k).alias("shingles"))
    step = F.greatest(F.floor(F.size("notice") / 4), F.lit(1)).cast("int")
    rows = rows.select("*", step.alias("step"), (F.size("notice") + step - 1).alias("span"), _signature(F.col("shingles")).alias("bands"))
    # from here on a notice is known by its digest, as a long one would travel with each window
    return rows.withColumn("notice", F.sha2(F.array_join("notice", " "), 256))


def license_hits(documents: DataFrame, templates: DataFrame, k: int = SHINGLE, least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, digest, license, start, containment) of text windows that hold a template.

    ``documents`` needs doc_id and text, ``templates`` needs name and text.
    """
    kinds = checkpointed(_templates(templates, k))
    # the shingles that decide a band, with the number of words they have
    band = F.explode(F.sequence(F.lit(1), F.lit(BANDS)))
    decisive = kinds.select("license", "notice", "shingles", "span", "step", "bands", band.alias("band"))
    decisive = decisive.select(
        "license", "notice", "span", "step",
        F.explode(F.filter("shingles", lambda s: F.xxhash64(s, F.col("band")) == F.element_at("bands", F.col("band")))).alias("anchor"),
    ).distinct()
    decisive = decisive.withColumn("anchor", F.split("anchor", " ")).withColumn("size", F.size("anchor"))
    docs = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), words(F.col("text")).alias("words"))
    placed = docs.select("*", F.posexplode("words").alias("pos", "word"))
    sizes = sorted(r[0] for r in decisive.select("size").distinct().collect())  # at most k numbers
    windows = None
    for size in sizes:
        keys = decisive.where(F.col("size") == size)
        keys = checkpointed(keys.select(shingles_at(F.col("anchor"), F.lit(0), size).alias("token"), "license", "notice", "span", "step"))
        met = placed.withColumn("token", shingles_at(F.col("words"), F.col("pos"), size)).join(sized_broadcast(keys), "token")
        # the windows of the template's grid that hold the anchor
        first = F.greatest(F.ceil((F.col("pos") + size - F.col("span")) / F.col("step")), F.lit(0))
        grid = F.sequence(first, F.greatest(F.floor(F.col("pos") / F.col("step")), first))
        starts = F.explode(F.transform(grid, lambda g: (g * F.col("step")).cast("int")))
        met = met.select("doc_id", "digest", "license", "notice", "span", starts.alias("start"), "words")
        met = met.select("doc_id", "digest", "license", "notice", "start", F.slice("words", F.col("start") + 1, F.col("span")).alias("window"))
        windows = met if windows is None else windows.unionByName(met)
    if windows is None:
        windows = docs.where("false").select("doc_id", "digest", F.lit("").alias("license"), F.lit("").alias("notice"), F.lit(0).alias("start"), F.col("words").alias("window"))
    windows = windows.distinct().withColumn("found", _shingles(F.col("window"), k))
    compared = windows.join(sized_broadcast(kinds.select("license", "notice", "shingles", "bands")), ["license", "notice"])
    agrees = F.exists(F.zip_with(_signature(F.col("found")), F.col("bands"), lambda x, y: x == y), lambda same: same)
    held = F.size(F.array_intersect("shingles", "found")) / F.size("shingles")
    hits = compared.where(agrees).select("doc_id", "digest", "license", "start", held.alias("containment"))
    return hits.where(F.col("containment") >= least)


def license_report(documents: DataFrame, templates: DataFrame, k: int = SHINGLE, least: float = CONTAINMENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_licenses, licenses (sorted, comma-joined), containment (the best, 0 for none)."""
    found = license_hits(documents, templates, k, least).groupBy("doc_id", "digest", "license").agg(F.max("containment").alias("best"))
    # as many names as there are templates
    found = found.groupBy("doc_id", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("license")), ",").alias("names"), F.max("best").alias("best")
    ).toDF("hit_id", "hit_digest", "n", "names", "best")
    rows = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), word_count(F.col("text")).alias("n_words"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["hit_id"]) & (rows["digest"] == found["hit_digest"]), "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_licenses"),
        F.coalesce("names", F.lit("")).alias("licenses"),
        F.coalesce("best", F.lit(0.0)).alias("containment"),
    )


def notices(spark, texts: Mapping[str, str] = NOTICES) -> DataFrame:
    return spark.createDataFrame(list(texts.items()), "name string, text string")
