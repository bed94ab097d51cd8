"""Language identification by word-first backoff.

Known words score by their log frequency in each language. An unseen word falls back to its
character n-grams: at each place the longest known n-gram scores, shorter ones are tried when it is
unseen, and single unseen characters score the floor.

The model is fitted on at most about ``SAMPLE_ROWS`` rows and ``SAMPLE_CHARS`` characters for each language, chosen by a hash of the id. Words and n-grams
are counted on the executors; the driver gets those that occur often enough. Prediction reads every row and whole text: the words of many texts are
looked up together, and each text's evidence is a sum over rows of one array.

Defined results: a null text or one without a letter is ``und`` with score 0. Rows without a language
or id are never learned from. Ties go to the language that sorts first. Without any rows to
learn from, every text is ``und``. Repeated rows get the same prediction. Very long words and texts are read whole. Other columns are never
read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.text import columns, map_arrow, small_side
from strataloom.llm.toxicity import remainder
from strataloom.plans.workspace import Workspace

#: Bounds of what the model is fitted on for each language, and counts below which a word or n-gram is unseen.
SAMPLE_ROWS, SAMPLE_CHARS, LEAST_WORD, LEAST_GRAM = 4_000, 40_000_000, 3, 3
LONGEST = 4
#: Unseen words whose evidence is remembered, letters of the longest of them, and numbers in the array that a text's words fill at once.
REMEMBERED, REMEMBERED_LETTERS, AT_ONCE = 100_000, 60, 2_000_000

_WORD = re.compile(r"[^\W\d_]+")


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def char_grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Backoff:
    """Log frequencies by language of words and, for each length, of n-grams."""

    def __init__(self, languages: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray], floor: np.ndarray):
        self.languages, self.floor = languages, floor
        self.words = {w: k for k, w in enumerate(words)}
        self.grams = {g: k + 1 for k, g in enumerate(grams)}
        none = np.empty((0, len(languages)))
        self.of_word = np.array(list(words.values())) if words else none
        self.of_gram = np.array([floor, *grams.values()])  # an unseen character's row is the first
        self.rows = dict(self.words)
        self.held = self.of_word

    def _places(self, word: str) -> list[int]:
        """The row of the longest known n-gram at each place."""
        w, get, out = f"^{word}$", self.grams.get, []
        for i in range(len(w) - 1):
            row = get(w[i : i + 4]) or get(w[i : i + 3]) or get(w[i : i + 2]) or get(w[i]) or 0
            out.append(row)
        return out

    def backoff(self, words: list[str]) -> np.ndarray:
        """Twice the mean over each word's places of their n-grams, as one word's evidence."""
        out = np.zeros((len(words), len(self.languages)))
        step = max(1, AT_ONCE // max(1, len(self.languages)))
        at = 0
        while at < len(words):
            places, sizes = [], []
            while at + len(sizes) < len(words) and len(places) < step:
                more = self._places(words[at + len(sizes)])
                places += more
                sizes.append(len(more))
            if len(sizes) == 1:  # one word may be very long
                total = sum(self.of_gram[places[k : k + step]].sum(0) for k in range(0, len(places), step))[None, :]
            else:
                total = np.add.reduceat(self.of_gram[places], np.cumsum([0, *sizes[:-1]]), axis=0)
            out[at : at + len(sizes)] = total * (2.0 / np.array(sizes))[:, None]
            at += len(sizes)
        return out

    def evidence(self, words: list[list[str]]) -> np.ndarray:
        """The sum over each text's words."""
        if len(self.rows) > len(self.words) + REMEMBERED:
            self.rows, self.held = dict(self.words), self.of_word
        flat = list(chain.from_iterable(words))
        rows = np.array(list(map(self.rows.get, flat, repeat(-1))), np.int64)
        unseen = np.flatnonzero(rows < 0)
        held = self.held
        if len(unseen):
            new = dict.fromkeys(flat[i] for i in unseen.tolist())
            new = sorted(new, key=lambda w: len(w) > REMEMBERED_LETTERS)  # those that are remembered come first
            place = dict(zip(new, range(len(held), len(held) + len(new))))
            held = np.concatenate((held, self.backoff(new)))
            rows[unseen] = [place[flat[i]] for i in unseen.tolist()]
            kept = sum(len(w) <= REMEMBERED_LETTERS for w in new)
            self.rows.update(zip(new[:kept], range(len(self.held), len(self.held) + kept)))
            self.held = held[: len(self.held) + kept]
        ends = np.cumsum([0, *map(len, words)])
        out = np.zeros((len(words), len(self.languages)))
        step = max(1, AT_ONCE // max(1, len(self.languages)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            first, last = np.searchsorted(ends, at, "right") - 1, np.searchsorted(ends, at + len(some), "left")
            starts = np.maximum(ends[first:last] - at, 0)
            full = np.flatnonzero(np.diff(np.append(starts, len(some))) > 0)
            out[first + full] += np.add.reduceat(held[some], starts[full], axis=0)
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [word_list(t) if t else [] for t in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        total = self.evidence(words)
        best = total.argmax(1)
        size = np.array([max(1, len(w)) for w in words])
        p = 1 / np.exp((total - total.max(1, keepdims=True)) / np.maximum(1.0, size**0.5)[:, None]).sum(1)
        return [
            (self.languages[k], x) if w and any(map(str.isalpha, t)) else ("und", 0.0)
            for t, w, k, x in zip(texts, words, best.tolist(), p.tolist())
        ]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def _log_frequencies(counts: dict[str, dict[str, int]], languages: list[str], smooth: float = 0.5) -> dict[str, np.ndarray]:
    size = max(1, len({k for c in counts.values() for k in c}))
    out: dict[str, np.ndarray] = {}
    totals = np.array([sum(counts[x].values()) + smooth * size for x in languages], float)
    for key in {k for c in counts.values() for k in c}:
        out[key] = np.log((np.array([counts[x].get(key, 0) for x in languages]) + smooth) / totals)
    return out


def fit(counted) -> Backoff:
    """From rows (lang, n, gram, count); n is 0 for words, else the length of the n-gram."""
    by: dict[int, dict[str, dict[str, int]]] = {}
    for lang, n, gram, count in counted:
        by.setdefault(n, {}).setdefault(lang, {})[gram] = count
    languages = sorted({x for c in by.values() for x in c})
    full = {n: {x: by[n].get(x, {}) for x in languages} for n in by}
    words = _log_frequencies(full.get(0, {x: {} for x in languages}), languages)
    grams: dict[str, np.ndarray] = {}
    for n in range(1, LONGEST + 1):
        if n in full:
            grams |= _log_frequencies(full[n], languages)
    floor = np.full(len(languages), -16.0)
    return Backoff(languages, words, grams, floor)


def train(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Backoff:
    """Count words and n-grams of the sample on the executors; what comes back is bounded by the sample."""
    import pyarrow as pa

    rows = columns(docs, id=id_col, text=text_col, lang=lang_col).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(learnable)
    work = Workspace(docs.sparkSession, "language-id")
    share = F.least(SAMPLE_ROWS / F.count(F.lit(1)), SAMPLE_CHARS / F.greatest(F.sum(F.length("text")), F.lit(1)))
    per = work.table(rows.groupBy("lang").agg((-(2.0**63) + F.least(share, F.lit(1.0)) * 2.0**64).alias("below")), "languages")
    sample = rows.join(small_side(per, per.count()), "lang").where(F.xxhash64("id").cast("double") <= F.col("below"))
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("count", pa.int64())])

    def run(batches):
        words: dict[str, Counter] = {}
        size = 0

        def flush():
            """N-grams are counted from the distinct words."""
            for lang, times in words.items():
                counts: Counter = Counter()
                for word, n in times.items():
                    counts[0, word] += n
                    for k in range(1, LONGEST + 1):
                        for g in char_grams(word, k):
                            counts[k, g] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), pa.array([k for k, _ in counts], pa.int32()), pa.array([g for _, g in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                    schema=schema,
                )
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = word_list(text)
                size += len(text)
                words.setdefault(lang, Counter()).update(found)
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = map_arrow(sample.select("text", "lang"), run, "lang string, n int, gram string, count long")
    counted = counted.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    counted = counted.where(F.col("count") >= F.when(F.col("n") == 0, LEAST_WORD).otherwise(LEAST_GRAM))
    return fit(map(tuple, counted.toPandas().itertuples(index=False)))


def identify(docs: DataFrame, model: Backoff, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        own = shared.value
        for batch in batches:
            found = own.predict_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], schema=schema)

    return map_arrow(texts, run, "id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, remainder("id", 3) != 1)
    return identify(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(remainder("id", 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score"
    )
