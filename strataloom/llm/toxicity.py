"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its words; the document's
probability is their noisy-or with a small leak. Weights are learned from document labels alone, by gradient
descent on the bags' likelihood, and then locate the sentences that offend.

The model is fitted on at most ``SAMPLE_ROWS`` labelled texts and ``SAMPLE_BYTES`` bytes of them, taken in the order of hashes of id and text, so that
neither depends on how the tables are stored; texts of more than a twentieth of the bytes are not learned from. Scoring reads every row and whole text.

Defined results: a null or empty text has no sentences and scores the leak. Rows with a null id are
never learned from and count as held out. Labels that are null are left out; of several
labels of one id or one text the largest holds. With no labelled rows of both kinds all scores are the base rate,
or 0 without any labels. Repeated rows score alike. Very long texts are scored whole. Other columns are never read, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm.text import WORD_BYTES, columns, map_arrow, utf8_column, where_text

#: Bounds of the labelled sample that the model is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 120_000_000
#: A word is a feature from this many sampled texts on, and this many deviations above the base rate.
LEAST_TEXTS, LEAST_DEVIATIONS = 3, 4.0

_ENDS = b".!?\n"
_SENTENCES = bytes(0x0A if b in _ENDS else WORD_BYTES[b] for b in range(256))


def sentences(utf8: bytes | None) -> list[tuple[int, bytes]]:
    """(byte offset, folded words) of each run between sentence ends."""
    out, at = [], 0
    for part in utf8.translate(_SENTENCES).split(b"\n") if utf8 else ():
        if part and not part.isspace():
            out.append((at, part))
        at += len(part) + 1
    return out


class NoisyOr:
    """Sentence weights, bias and leak. ``of`` gives a document's probability and its sentences' scores."""

    def __init__(self, weights: dict[bytes, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak
        self.base = float(np.log1p(np.exp(bias)))

    def of(self, utf8: bytes | None, threshold: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        total, found = self.leak, []
        get = self.weights.get
        for at, part in sentences(utf8):
            z = sum(filter(None, map(get, set(part.split()))))
            if z:
                z += self.bias
                total += float(np.logaddexp(0.0, z))
                p = 1 / (1 + float(np.exp(-z)))
                if p >= threshold:
                    found.append((at, at + len(part), p))
            else:
                total += self.base
        return -float(np.expm1(-total)), found


def fit(bags: list[tuple[int, list[list[bytes]]]], steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> NoisyOr:
    """Learn from (label, sentences as word lists)."""
    y = np.array([label for label, _ in bags], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return NoisyOr({}, -1000.0, 40.0 if share >= 1 else -float(np.log1p(-share)))
    seen, positive = Counter(), Counter()
    for label, bag in bags:
        words = sorted(set().union(*bag)) if bag else []
        seen.update(words)
        if label:
            positive.update(words)
    base = float(y.mean())
    features = [
        w for w, n in seen.items()
        if n >= LEAST_TEXTS and (positive[w] - n * base) / np.sqrt(n * base * (1 - base)) >= LEAST_DEVIATIONS
    ]
    at = {w: k for k, w in enumerate(features)}
    rows, cols, doc = [], [], []
    plain = np.zeros(len(bags))
    for d, (_, bag) in enumerate(bags):
        for words in bag:
            found = [at[w] for w in set(words) if w in at]
            if found:
                rows += [len(doc)] * len(found)
                cols += found
                doc.append(d)
            else:
                plain[d] += 1
    rows, cols, doc = (np.array(v, np.int64) for v in (rows, cols, doc))
    x = np.concatenate((np.ones(len(features)), [-6.0, -4.0]))  # weights, bias, leak before softplus
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, b, leak = x[:-2], x[-2], x[-1]
        z = b + np.bincount(rows, w[cols], len(doc))
        soft = np.logaddexp(0, z)
        total = np.bincount(doc, soft, len(bags)) + plain * np.logaddexp(0, b) + np.logaddexp(0, leak)
        q = np.exp(-total)
        g = np.where(y > 0, -q / np.maximum(1 - q, 1e-9), 1.0) / len(bags)
        gz = g[doc] / (1 + np.exp(-z))
        grad = np.concatenate((
            np.bincount(cols, gz[rows], len(features)) + ridge * w / max(len(features), 1),
            [gz.sum() + (g * plain).sum() / (1 + np.exp(-b)), g.sum() / (1 + np.exp(-leak))],
        ))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return NoisyOr({w: float(x[k]) for w, k in at.items()}, float(x[-2]), float(np.logaddexp(0, x[-1])))


def train(docs: DataFrame, labels: DataFrame, learnable: Column, id_col="doc_id", text_col="text", label_col="toxic") -> NoisyOr:
    """Fit on labelled rows for whose id (as column ``id``) ``learnable`` holds."""
    known = columns(labels, id=id_col, label=label_col).where("id IS NOT NULL AND label IS NOT NULL").where(learnable)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    share = 2 * SAMPLE_ROWS / max(known.count(), 1)
    by_hash = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("i"))
    if share < 1:  # about twice as many as needed, of which the first are taken
        known = known.where(F.xxhash64("id") < int((share - 0.5) * 2.0**64))
    known = known.orderBy(by_hash).limit(SAMPLE_ROWS)
    texts = columns(docs, id=id_col, text=text_col).where("text IS NOT NULL").where(F.octet_length("text") <= SAMPLE_BYTES // 20)
    rows = texts.join(F.broadcast(known), "id").groupBy(F.xxhash64("text").alias("t")).agg(
        F.min(by_hash).alias("at"), F.max("label").alias("label"), F.min(F.encode("text", "UTF-8")).alias("text"))
    rows = rows.orderBy("at", "t").limit(SAMPLE_ROWS)
    size = F.sum(F.octet_length("text")).over(Window.orderBy("at", "t"))  # at most SAMPLE_ROWS rows
    rows = rows.withColumn("size", size).where(F.col("size") <= SAMPLE_BYTES)
    rows = rows.repartitionByRange(16, "at", "t").sortWithinPartitions("at", "t")  # the driver holds one part at a time
    bags, pool = [], {}
    for row in rows.select("label", "text").toLocalIterator():
        bags.append((int(row.label > 0), [[pool.setdefault(w, w) for w in sorted(set(p.split()))] for _, p in sentences(bytes(row.text))]))
    return fit(bags)


def _in_characters(text: bytes | None, found: list[tuple[int, int, float]]):
    at = chars = 0
    for a, b, s in found:
        start = chars + len(text[at:a].decode("utf-8", "replace"))
        at, chars = b, start + len(text[a:b].decode("utf-8", "replace"))
        yield {"start": start, "end": chars, "score": s}


def score(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, score, offending (character spans of sentences with their scores)."""
    import pyarrow as pa

    texts = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("offending", pa.list_(span))])

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            scores, spans = [], []
            for text in utf8_column(batch, "text"):
                p, found = own.of(text, threshold)
                scores.append(p)
                spans.append(list(_in_characters(text, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, schema.field("offending").type)], schema=schema)

    return map_arrow(texts, run, "id long, score double, offending array<struct<start: long, end: long, score: double>>")


def remainder(column: str, by: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows, learned from labelled rows whose remainder by 5 is not 0."""
    return score(docs, train(docs, labels, remainder("id", 5) != 0))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns; decided by row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, remainder("id", 5) != 0, text_col=text_col))

    def chosen():
        own = shared.value
        return lambda texts: [own.of(t)[0] < threshold for t in texts]

    return where_text(docs, text_col, chosen)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(spark, docs, labels).select(
        F.col("id").alias("doc_id"), F.coalesce(remainder("id", 5) == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
