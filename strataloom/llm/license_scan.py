"""License scans by diagonal voting.

All rolling word k-gram hashes of every document are joined in Spark to the positions that they have in
templates. A match votes for its diagonal (document position minus template position); votes are counted
per document, template and diagonal, neighbouring diagonals are merged, and the spans that they name are
verified word by word. Short phrases are templates of two-word grams that must match whole; longer
notices use grams of four words and must match in a share of their words. Of notices found at the same words under different labels, the one with more of its
words there stays, of equals the one with the greater share.

The joined table holds templates only, at most ``TEMPLATE_WORDS`` words (checked), and is broadcast.

Defined results: a null or empty text has no words and no labels, and scores 0. Repeated rows get the same
findings. Very long texts are read whole. Other columns are never read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm.hashing import batched, grams, word_hashes
from strataloom.llm.text import WORD_BYTES, columns, map_arrow, small_side, utf8_column, words
from strataloom.plans.workspace import Workspace

TEMPLATE_WORDS = 100_000
#: Diagonals this near to one another are one find; inserted or lost words move a diagonal.
NEAR = 3


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    gram: int = 4
    votes: float = 0.3
    share: float = 0.6


# Phrases with their labels, and public license notices.
TEMPLATES = (
    Template("mit", "mit license", True, 2, 1.0, 1.0),
    Template("apache", "apache license", True, 2, 1.0, 1.0),
    Template("gpl", "general public license", True, 2, 1.0, 1.0),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", False, 4, 0.5, 0.8),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
)


def _fold(utf8: bytes) -> bytes:
    return utf8.translate(WORD_BYTES)


def template_grams(templates) -> list[tuple[int, int, int]]:
    """(gram hash, template number, word position)."""
    out, size = [], 0
    for k, t in enumerate(templates):
        h = word_hashes(_fold(t.text.encode()))[0]
        size += len(h)
        out += [(int(g), k, p) for p, g in enumerate(grams(h, t.gram).view(np.int64))]
    if size > TEMPLATE_WORDS:
        raise ValueError(f"templates of {size} words; at most {TEMPLATE_WORDS} are broadcast")
    return out


def _rolling(texts: DataFrame, widths: list[int]) -> DataFrame:
    """(id, key, width, grams): every k-gram hash of every document, by position."""
    import pyarrow as pa

    kind = pa.list_(pa.int64())
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("grams", kind)])

    def run(batches):
        for batch in batches:
            hashes = batched(utf8_column(batch, "text"), _fold)
            for width in widths:
                lists = [grams(h, width).view(np.int64) for h in hashes]
                offsets = np.cumsum([0] + [len(x) for x in lists], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64)))],
                    schema=schema,
                )

    return map_arrow(texts, run, "id long, key long, grams array<long>")


def candidates(texts: DataFrame, templates) -> DataFrame:
    """(id, key, finds): template, first and last diagonal of each merged find."""
    spark = texts.sparkSession
    table = spark.createDataFrame(template_grams(templates), "gram long, template int, place int")
    least = F.create_map(*[F.lit(x) for k, t in enumerate(templates) for x in (k, max(1, int(t.votes * (len(words(t.text.encode())) - t.gram + 1))))])
    hits = (
        _rolling(texts, sorted({t.gram for t in templates}))
        .select("id", "key", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(table), "gram")
        .groupBy("id", "key", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    )
    order = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True)).cast("int")
    merged = (
        hits.withColumn("new", new).withColumn("find", F.sum("new").over(order)).groupBy("id", "key", "template", "find")
        .agg(F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.sum("votes").alias("votes"))
        .where(F.col("votes") >= least[F.col("template")])
    )
    return merged.groupBy("id", "key").agg(F.collect_list(F.struct("template", "first", "last")).alias("finds"))


def verify(text: list[bytes], template: list[bytes], first: int, last: int, gram: int) -> tuple[float, int, int]:
    """Share of template words that stand in runs of at least ``gram`` on these diagonals, and the span of words."""
    covered, start, end = set(), None, None
    for d in range(first, last + 1):
        run = 0
        for p in range(len(template) + 1):
            if p < len(template) and 0 <= d + p < len(text) and text[d + p] == template[p]:
                run += 1
                continue
            if run >= gram:
                covered.update(range(p - run, p))
                a, b = d + p - run, d + p
                start, end = (a, b) if start is None else (min(start, a), max(end, b))
            run = 0
    return len(covered) / len(template), start or 0, end or 0


def outstanding(notices: list[tuple[float, dict]]) -> list[dict]:
    """The finds without those of another label more than half of whose words belong to a find with more words."""
    out: list[dict] = []
    for _, x in sorted(notices, key=lambda n: (-n[0], -n[1]["share"], n[1]["start"], n[1]["label"])):
        inside = lambda y: 2 * (min(x["end"], y["end"]) - max(x["start"], y["start"])) > x["end"] - x["start"]  # noqa: E731, B023
        if not any(y["label"] != x["label"] and inside(y) for y in out):
            out.append(x)
    return out


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, spans (label, base, first word, end word, share), score."""
    import pyarrow as pa

    texts = columns(docs, id=id_col, text=text_col).select(
        F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("key")
    )
    work = Workspace(docs.sparkSession, "license-scan")
    found = work.table(candidates(texts, templates), "candidates")
    n, finds = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("finds")), F.lit(0))).first()
    named = small_side(found.select(F.col("id").alias("__id"), F.col("key").alias("__key"), "finds"), n + finds)
    rows = texts.join(named, texts["id"].eqNullSafe(F.col("__id")) & (texts["key"] == F.col("__key")), "left").select("id", "text", "finds")
    span = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("score", pa.float64())])

    def run(batches):
        known = [words(t.text.encode()) for t in templates]
        for batch in batches:
            counts, spans = [], []
            for text, finds in zip(utf8_column(batch, "text"), batch.column(2).to_pylist()):
                w, out, notices = words(text), [], []
                for f in finds or ():
                    t, template = templates[f["template"]], known[f["template"]]
                    if t.share >= 1:  # a phrase: each diagonal is one place
                        out += [
                            {"label": t.label, "base": t.base, "start": d, "end": d + len(template), "share": 1.0}
                            for d in range(max(f["first"], 0), f["last"] + 1) if w[d : d + len(template)] == template
                        ]
                        continue
                    share, start, end = verify(w, template, f["first"], f["last"], t.gram)
                    if share >= t.share:
                        notices.append((round(share * len(template)), {"label": t.label, "base": t.base, "start": start, "end": end, "share": share}))
                out += outstanding(notices)
                counts.append(len(w))
                spans.append(sorted(out, key=lambda s: (s["start"], s["label"])))
            scores = [max((s["share"] for s in x), default=0.0) for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(scores, pa.float64())], schema=schema)

    return map_arrow(rows, run, "id long, n_words long, spans array<struct<label: string, base: boolean, start: long, end: long, share: double>>, score double")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    join = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), join(base).alias("base_labels"), join(F.col("spans")).alias("labels"), "score",
    )
