"""License scans by diagonal voting.

Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. Every k-word gram
of a document is hashed by rolling over its words (k is 2 for short phrases, LONG_K for templates);
grams join the table of template positions in Spark; matches are counted by (document, template,
diagonal), where the diagonal is the word's position less the template's; neighbouring diagonals,
which an inserted or dropped word sets apart, are merged; and spans are verified: a phrase is found
where all its grams, compared as text, vote for one diagonal; a template's span is aligned word by
word with the template (longest common subsequence), and found where the alignment holds `least` of
the template's words. Of templates whose spans overlap, only the best aligned are found (the GPL and
its kin differ by a word or two).

The template table is fixed with the code (a few hundred rows), so its side of the join is
broadcast. A filter on the same hashes is applied where grams are made, as a join would push its keys
down: the join decides, by hash and text. Documents without such grams pass by all later steps.

Defined results: null text is empty (no words, no labels, score 0); repeated rows are reported each;
null doc_id is reported; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlens.llm.common import STEP, cut, mix, text_buffers, word_hashes

# Fixed phrases of the result's definition: words that stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices as projects place them in their files.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
}
SHORT_K, LONG_K = 2, 5
LEAST = 0.5  # share of a template's words
NEIGHBOURS = 4  # words by which diagonals may differ and still be one place

GAPS = np.zeros(256, bool)
GAPS[0x00:0x30] = GAPS[0x3A:0x61] = GAPS[0x7B:0x80] = True


def _gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k:
        return np.zeros(0, np.uint64)
    s = h[: len(h) - k + 1] * STEP[0]
    for q in range(1, k):
        s = s + h[q : len(h) - k + 1 + q] * STEP[q]
    return mix(s + STEP[30 + k])


def _of(text: str) -> tuple[np.ndarray, list[str]]:
    data, off = text_buffers(pa.array([text]))
    (_, h, _, _), = word_hashes(data, off, GAPS)
    return h, text.split(" ")


def template_rows() -> list[tuple]:
    """(hash, gram, template, label, pos, grams, exact) of every template position."""
    rows = []
    for kind, k, table in ((True, SHORT_K, PHRASES), (False, LONG_K, {v: n for n, v in TEMPLATES.items()})):
        for text, label in table.items():
            h, words = _of(text)
            hashes = _gram_hashes(h, k)
            for i, x in enumerate(hashes.astype(np.int64).tolist()):
                rows.append((x, " ".join(words[i : i + k]), text[:40] if kind else f"notice {label}", label, i, len(hashes), kind))
    return rows


def _grams(wanted: np.ndarray):
    """Rows (doc_id, text) to (doc_id, n_words, hits of (hash, gram, at), from, words): words are those
    from word `from` on that templates' spans can reach; none without a gram of a template."""
    hit = pa.list_(pa.struct([("hash", pa.int64()), ("gram", pa.string()), ("at", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            n_words, hits, begin, reach = [], [], [], []
            for d, h, s, e in word_hashes(data, off, GAPS):
                say = lambda a, b: [data[off[d] + s[j] : off[d] + e[j]].tobytes().lower().decode("utf-8", "replace") for j in range(a, b)]  # noqa: B023, E731
                n_words.append(len(h))
                own, first, last = [], len(h), 0
                for k in (SHORT_K, LONG_K):
                    g = _gram_hashes(h, k)
                    at = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
                    for i in np.flatnonzero(wanted[at] == g).tolist():
                        own.append({"hash": int(g[i].astype(np.int64)), "gram": " ".join(say(i, i + k)), "at": i})
                        if k == LONG_K:
                            first, last = min(first, max(0, i - LONG_K)), max(last, min(len(h), i + 2 * LONG_K))
                hits.append(own)
                begin.append(first)
                reach.append(say(first, last))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, hit), pa.array(begin, pa.int64()), pa.array(reach, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "begin", "words"])

    return run


def aligned(template: list[str], words: list[str]) -> int:
    """The length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(template)) - 1
    open_ = whole  # a bit is clear where the subsequence grows
    for w in words:
        hit = open_ & places.get(w, 0)
        open_ = (open_ + hit | open_ - hit) & whole
    return len(template) - open_.bit_count()


def _verified(template: pa.Array, words: pa.Array) -> pa.Array:
    """The share of a template's words that lie in its alignment with a span's words."""
    wanted = {f"notice {label}": text.split(" ") for label, text in TEMPLATES.items()}
    return pa.array([aligned(wanted[t], w or []) / len(wanted[t]) for t, w in zip(template.to_pylist(), words.to_pylist())], pa.float64())


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark: SparkSession = docs.sparkSession
    rows = template_rows()
    templates = F.broadcast(spark.createDataFrame(rows, "hash long, gram string, template string, label string, pos int, grams int, exact boolean"))
    wanted = np.unique(np.array([r[0] for r in rows], np.int64).astype(np.uint64))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = slim.mapInArrow(_grams(wanted), "doc_id long, n_words long, hits array<struct<hash: long, gram: string, at: long>>, begin long, words array<string>")
    # repeated rows stay apart: a row is its place among its task's rows, written once
    grams = cut(grams.withColumn("row", F.monotonically_increasing_id()), "grams")
    plain = grams.where(F.size("hits") == 0)
    row = ["row", "doc_id", "n_words"]
    hits = grams.where(F.size("hits") > 0)
    voted = hits.select(*row, F.explode("hits").alias("h"))
    voted = voted.join(templates, (F.col("h.hash") == templates["hash"]) & (F.col("h.gram") == templates["gram"]), "left")
    voted = voted.withColumn("diagonal", F.col("h.at") - F.col("pos"))
    what = ["template", "label", "exact", "grams"]
    diagonals = voted.groupBy(*row, *what, "diagonal").agg(F.collect_set("pos").alias("seen"), F.min("h.at").alias("from"), F.max("h.at").alias("to"))  # at most the template's positions
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS)
    placed = diagonals.withColumn("place", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    spans = placed.groupBy(*row, *what, "place").agg(F.min("diagonal").alias("first"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("from").alias("from"), F.max("to").alias("to"))
    phrases = spans.where("exact or template is null").select(*row, "label", "first", F.when(F.col("exact"), F.size("seen") / F.col("grams").cast("double")).alias("share"), F.lit(True).alias("exact"))
    reach = hits.where(F.size("words") > 0).select("row", "begin", "words")
    start = F.greatest(F.col("from") - LONG_K - F.col("begin"), F.lit(0))
    notices = spans.where("not exact").join(reach, "row").withColumn("span", F.slice("words", (start + 1).cast("int"), (F.col("to") + 2 * LONG_K - F.col("begin") - start).cast("int")))
    notices = notices.select(*row, "label", "first", "from", "to", F.arrow_udf(_verified, "double")(F.col("template"), F.col("span")).alias("share"))
    # of notices that overlap, the best aligned
    along = Window.partitionBy("row").orderBy("from", "to", "label")
    beyond = F.max(F.col("to") + LONG_K).over(along.rowsBetween(Window.unboundedPreceding, -1))
    notices = notices.withColumn("island", F.sum(F.coalesce(F.col("from") >= beyond, F.lit(True)).cast("int")).over(along))
    notices = notices.withColumn("best", F.max("share").over(Window.partitionBy("row", "island"))).where("share = best")
    spans = phrases.unionByName(notices.select(*row, "label", "first", "share", F.lit(False).alias("exact")))
    base = F.col("exact") & (F.col("share") == 1)
    found = F.when(F.col("exact"), F.col("share") == 1).otherwise(F.col("share") >= least)
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    judged = spans.groupBy(*row).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(found).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).drop("row")
    none, empty = F.lit(None).cast("long"), F.lit("")
    passed = plain.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), none.alias("first_word"), none.alias("last_word"), empty.alias("base_labels"), empty.alias("labels"), F.lit(0.0).alias("score"))
    return judged.unionByName(passed)
