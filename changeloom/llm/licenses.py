"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingles verify them.

In DataFrame functions only. A window is eight consecutive words (four five-word shingles), taken every four shingles
less one so that windows overlap; template windows are taken at every word. Each of the BANDS bands is one MinHash
value. A window that shares s of its shingles with a template window of the same four (or fewer) collides in a band
with probability J, their Jaccard similarity, and in some band with 1 - (1 - J) ** BANDS: at J = 1/4 0.999, at 1/2 and
above over 0.9999999. Templates of fewer than four shingles have a band of their own, over windows of one shingle at
every word, where J = 1 and none is lost. Retrieved templates are verified on whole texts: the share of the template's
distinct shingles that the document has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, stored
from .decontam import words_of

SHINGLE, WINDOW, STRIDE, BANDS, CONTAINED = 5, 4, 3, 24, 0.8

#: Notices of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _hashes(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds wh, the hashes of the words."""
    return df.select(*keep, F.transform("words", lambda x: F.xxhash64(x)).alias("wh"))


def _bands(df: DataFrame, keep: list[str], stride: int) -> DataFrame:
    """(keep..., band): the band keys of a row's windows, every ``stride`` words, or of its single shingles, or both.

    Bands from BANDS on are those of single shingles: with ``stride`` of them, every shingle has one. Rows that are
    templates (stride 1) have single shingles if they are shorter than a window, else windows.
    """
    n = F.size("wh") - (SHINGLE - 1)
    every = F.sequence(F.lit(0), F.lit(BANDS + stride - 1))
    bands = F.when(n < WINDOW, F.array(F.lit(BANDS))).otherwise(F.sequence(F.lit(0), F.lit(BANDS - 1))) if stride == 1 else every
    at = df.where(F.size("wh") >= SHINGLE).select(*keep, "wh", bands.alias("bs"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(stride))).alias("i"))
    s = at.select(*keep, "bs", *(F.when(F.col("i") + j + (SHINGLE - 1) < F.size("wh"), F.xxhash64(*(F.get("wh", F.col("i") + j + k) for k in range(SHINGLE)))).alias(f"s{j}") for j in range(WINDOW)))
    # a band per generated row keeps the compiled loop small enough for the JIT
    s = s.select(*keep, *(f"s{j}" for j in range(WINDOW)), F.explode("bs").alias("b"))
    least = F.least(*(F.when(F.col(f"s{j}").isNotNull(), F.xxhash64(f"s{j}", "b")) for j in range(WINDOW)))
    single = F.coalesce(*(F.when(F.col("b") == BANDS + j, F.col(f"s{j}")) for j in range(stride)))
    return s.select(*keep, F.when(F.col("b") < BANDS, F.xxhash64("b", least)).otherwise(F.xxhash64(F.lit(BANDS), single)).alias("band"))


def scan_licenses(docs: DataFrame, templates: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_licenses, licenses (sorted, comma-joined), containment (the largest).

    templates: template_id, text. A template matches when the document's whole text has at least ``contained`` of
    its distinct five-word shingles (words as in decontamination). Null or empty texts match nothing and have a
    containment of 0; templates without an id or of fewer than five words are not looked for; repeated rows get
    equal rows; other columns are ignored.
    """
    t = templates.where("template_id is not null").select("template_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    t = stored(t.select("template_id", "words", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: F.array_join(F.slice("words", i + 1, SHINGLE), " "))).alias("exact")), "templates")
    index = stored(_bands(_hashes(t, ["template_id"]), ["template_id"], 1).distinct(), "bands")
    # documents are keyed by id and text, so rows that share an id are judged by their own text
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = _bands(_hashes(d.select("doc_id", "th", words_of(F.col("text")).alias("words")), ["doc_id", "th"]), ["doc_id", "th"], STRIDE)
    found = stored(found.join(sized(index), "band").select("doc_id", "th", "template_id").distinct(), "retrieved")
    per = stored(found.groupBy(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th")).agg(F.collect_set("template_id").alias("ids")), "candidates")
    hit = d.join(sized(per), d.doc_id.eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th"))).dropDuplicates(["doc_id", "th"])
    words = hit.select("doc_id", "th", "ids", words_of(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    own = words.select("doc_id", "th", "ids", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: F.array_join(F.slice("words", i + 1, SHINGLE), " "))).alias("own"))
    own = own.select("doc_id", "th", "own", F.explode("ids").alias("template_id")).join(sized(t.select("template_id", "exact")), "template_id")
    share = F.size(F.array_intersect("own", "exact")) / F.size("exact")
    good = own.select("doc_id", "th", "template_id", share.alias("share")).where(F.col("share") >= contained)
    good = good.groupBy(F.col("doc_id").alias("h_id"), F.col("th").alias("h_th")).agg(F.array_sort(F.collect_set("template_id")).alias("ids"), F.max("share").alias("share"))
    good = stored(good, "matches")
    every = docs.select("doc_id", F.xxhash64("text").alias("th"))
    out = every.join(sized(good), every.doc_id.eqNullSafe(F.col("h_id")) & (F.col("th") == F.col("h_th")), "left")
    return out.select("doc_id", F.coalesce(F.when(F.col("ids").isNotNull(), F.size("ids")), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("licenses"), F.coalesce("share", F.lit(0.0)).alias("containment"))
