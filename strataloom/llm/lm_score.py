"""Language-model scoring with Brown class-based bigrams.

Token counts are gathered from all training rows. Exchange clustering of the most frequent words on the driver seeds the
classes. Then sweeps over the whole vocabulary move each word of at least ``LEAST`` occurrences to the class that
raises the likelihood of class bigrams most, from its counts before and after each class, gathered from all training
rows by a shuffle. Words below ``LEAST`` and unseen ones belong to classes by hash. A text's probability is the product
of smoothed class transitions and word emissions; transitions are counted with the classes of all words.

Words above a share of 2**-20 of all tokens are at most 2**20 (their counts add up to the total) and are
broadcast. All other words, in whatever number, get their counts and classes by a shuffle join on the word's 64-bit hash. While a
sweep chooses classes, such words stand for their hash class in the contexts of their neighbours.

Defined results: a null or empty text has the end token only. Rows with a null id are never learned from and count as held out. Without training
rows N and V are 0 and all tokens are unseen. Repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.hashing import batched, mix
from strataloom.llm.text import columns, map_arrow, utf8_column
from strataloom.llm.toxicity import remainder
from strataloom.plans.workspace import Workspace

#: Words that seed the classes, classes, sweeps over the seeds; frequency bands of other words until the first whole sweep; rare classes.
CLUSTERED, CLASSES, SWEEPS, BANDS, RARE = 1000, 48, 4, 12, 8
#: Sweeps over the whole vocabulary, and occurrences from which a word takes part.
WHOLE_SWEEPS, LEAST = 2, 3
FREQUENT = 1 << 20
CHUNK = 2_000_000
END = mix(np.array([0x656E64], np.uint64))[0]
#: Classes by hash follow the classes and bands, and the start is last.
_HASHED = CLASSES + BANDS
_START = _HASHED + RARE
_ALL = _START + 1
#: In a row's states, a word that is not broadcast.
_TAIL = 255


def token_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """Hashes of each text's tokens, the end last."""
    return [np.append(h, END) for h in batched(texts, bytes.lower)]


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, n): token counts, added up in chunks before the shuffle."""
    import pyarrow as pa

    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held, size = [], 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], schema=schema)

        for batch in batches:
            for h in token_hashes(utf8_column(batch, "text")):
                held.append(h)
                size += len(h)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return map_arrow(texts.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """Frequent words, sorted by hash: counts and states. Other words have the states from ``hashed`` on; the start is after those."""

    hashes: np.ndarray
    counts: np.ndarray
    states: np.ndarray
    hashed: int

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(frequent?, count, state) of each token."""
        rare = by_hash(h, self.hashed)
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), rare
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == h
        return known, np.where(known, self.counts[at], 0), np.where(known, self.states[at], rare)

    def chain(self, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, states, states before) of the tokens of all texts."""
        h = np.concatenate(hashes)
        states = self.find(h)[2].astype(np.int64)
        before = np.concatenate(([self.hashed + RARE], states[:-1]))
        before[np.flatnonzero(h == END)[:-1] + 1] = self.hashed + RARE
        return h, states, before


def by_hash(h: np.ndarray, first: int) -> np.ndarray:
    return (first + (h & np.uint64(RARE - 1))).astype(np.int32)


def frequent_words(counts: DataFrame, total: int) -> Words:
    rows = counts.where(F.col("n") * FREQUENT > F.lit(total)).toPandas()
    h, n = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    by_count = np.lexsort((h, -n))
    states = np.empty(len(h), np.int32)
    states[by_count[:CLUSTERED]] = np.arange(min(CLUSTERED, len(h)))
    rest = by_count[CLUSTERED:]
    if len(rest):
        bands = np.log2(n[rest].max() / n[rest]).astype(int)
        states[rest] = CLUSTERED + np.minimum(bands, BANDS - 1)
    order = np.argsort(h)
    return Words(h[order], n[order], states[order], CLUSTERED + BANDS)


def count_pairs(texts: DataFrame, words) -> np.ndarray:
    """State bigram counts of all texts; the table has a fixed size."""
    import pyarrow as pa

    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
    size = words.value.hashed + RARE + 1

    def run(batches):
        own, total = words.value, np.zeros(size * size, np.int64)
        for batch in batches:
            hashes = token_hashes(utf8_column(batch, "text"))
            if not hashes:
                continue
            _, states, before = own.chain(hashes)
            u, c = np.unique(before * size + states, return_counts=True)
            total[u] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

    return _pair_table(map_arrow(texts.select("text"), run, "pair long, n long"), size)


def _pair_table(pairs: DataFrame, size: int) -> np.ndarray:
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size, np.int64)
    out[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(size, size)


def count_contexts(texts: DataFrame, words) -> DataFrame:
    """(word, contexts): each word's counts after (c) and before (_ALL + c) each class, as pairs of int32, added up in chunks before the shuffle."""
    import pyarrow as pa

    schema = pa.schema([("word", pa.int64()), ("contexts", pa.binary())])

    def run(batches):
        own, held, size = words.value, [], 0

        def flush():
            h, before, after = (np.concatenate(x) for x in zip(*held))
            u, at = np.unique(h, return_inverse=True)
            followed = after != _START
            keys = np.concatenate((at * (2 * _ALL) + before, (at * (2 * _ALL) + _ALL + after)[followed]))
            keys, n = np.unique(keys, return_counts=True)
            packed = np.column_stack((keys % (2 * _ALL), n)).astype(np.int32)
            ends = np.searchsorted(keys // (2 * _ALL), np.arange(len(u) + 1)) * packed.strides[0]
            contexts = pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)])
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), contexts], schema=schema)

        for batch in batches:
            hashes = token_hashes(utf8_column(batch, "text"))
            if not hashes:
                continue
            h, states, before = own.chain(hashes)
            after = np.append(states[1:], _START)
            after[h == END] = _START
            held.append((h, before, after))
            size += len(h)
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return map_arrow(texts.select("text"), run, "word long, contexts binary")


def best_classes(word: np.ndarray, key: np.ndarray, n: np.ndarray, own: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class that each word raises the likelihood most in. The words' contexts come in order of word (its place in ``own``); words whose
    ``own`` is a class are counted in ``pairs`` there."""
    cells = np.concatenate((pairs[:, :CLASSES], pairs[:CLASSES].T)).astype(float)
    sums = np.stack((pairs.sum(0)[:CLASSES], pairs.sum(1)[:CLASSES])).astype(float)
    gain = np.zeros((len(own), CLASSES))
    for at in range(0, len(own), 1000):
        a, b = np.searchsorted(word, (at, at + 1000))
        w, k, x = word[a:b], key[a:b], n[a:b].astype(float)
        here = np.arange(at, min(at + 1000, len(own)))
        totals = np.stack([np.bincount(w[side] - at, x[side], len(here)) for side in (k < _ALL, k >= _ALL)])
        base, more = cells[k], x[:, None]
        change = _xlogx(base + more) - _xlogx(base)
        inside = np.flatnonzero(own[w] < CLASSES)
        c = own[w[inside]]
        base = base[inside, c]
        change[inside, c] = _xlogx(base) - _xlogx(np.maximum(base - x[inside], 0))
        gain[at : at + 1000] = np.add.reduceat(change, np.searchsorted(w, here), axis=0)
        for side in (0, 1):
            more = totals[side][:, None]
            change = _xlogx(sums[side] + more) - _xlogx(sums[side])
            inside = np.flatnonzero(own[here] < CLASSES)
            c = own[here[inside]]
            base = sums[side][c]
            change[inside, c] = _xlogx(base) - _xlogx(np.maximum(base - totals[side][inside], 0))
            gain[at : at + 1000] -= change
    return np.argmax(gain, axis=1)


def assign(contexts: DataFrame, words, pairs: np.ndarray) -> DataFrame:
    """(word, n, class) of all words, each moved to its best class by its contexts over all rows."""
    import pyarrow as pa

    schema = pa.schema([("word", pa.int64()), ("n", pa.int64()), ("class", pa.int32())])

    def decide(word, contexts):
        flat = np.frombuffer(b"".join(contexts), np.int32).reshape(-1, 2)
        u, at = np.unique(word, return_inverse=True)
        code = np.repeat(at, [len(c) // 8 for c in contexts]) * (2 * _ALL) + flat[:, 0]
        code, at = np.unique(code, return_inverse=True)
        n = np.bincount(at, flat[:, 1]).astype(np.int64)
        w, key = code // (2 * _ALL), code % (2 * _ALL)
        h = u.view(np.uint64)
        count = np.bincount(w[key < _ALL], n[key < _ALL], len(u)).astype(np.int64)
        moved = count >= LEAST
        of = by_hash(h, _HASHED)
        if moved.any():
            taken = moved[w]
            place = np.cumsum(moved) - 1
            of[moved] = best_classes(place[w[taken]], key[taken], n[taken], words.value.find(h[moved])[2], pairs)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(count), pa.array(of)], schema=schema)

    def run(batches):
        """Rows come in order of word; the last word of a batch waits for the next batch."""
        word, held = np.empty(0, np.int64), []
        for batch in batches:
            word = np.concatenate((word, batch.column(0).to_numpy()))
            held += batch.column(1).to_pylist()
            cut = int(np.searchsorted(word, word[-1])) if len(word) else 0
            if cut:
                yield decide(word[:cut], held[:cut])
                word, held = word[cut:], held[cut:]
        if held:
            yield decide(word, held)

    return map_arrow(contexts.repartition("word").sortWithinPartitions("word"), run, "word long, n long, class int")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, movable: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of each state: the first ``movable`` are moved between ``classes``, the others keep one of their own."""
    states = len(pairs)
    of = np.concatenate((np.arange(movable) % classes, classes + np.arange(states - movable)))
    k = classes + states - movable
    member = np.zeros((states, k))
    member[np.arange(states), of] = 1
    left, right = pairs.T @ member, pairs @ member  # from each class into a word; from a word into each class
    n = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            own, stay = of[w], pairs[w, w]
            into, out = left[w].copy(), right[w].copy()
            into[own] -= stay
            out[own] -= stay
            n[own, :] -= out
            n[:, own] -= into
            n[own, own] -= stay
            rows, cols = n.sum(1), n.sum(0)
            a = n[:classes, :]
            gain = (_xlogx(a + out) - _xlogx(a)).sum(1)
            b = n[:, :classes]
            gain += (_xlogx(b + into[:, None]) - _xlogx(b)).sum(0)
            d, i = n[np.arange(classes), np.arange(classes)], np.arange(classes)
            gain += _xlogx(d + out[:classes] + into[:classes] + stay) - _xlogx(d + out[:classes]) - _xlogx(d + into[:classes]) + _xlogx(d)
            gain -= _xlogx(rows[i] + out.sum() + stay) - _xlogx(rows[i]) + _xlogx(cols[i] + into.sum() + stay) - _xlogx(cols[i])
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            of[w] = best
            n[best, :] += out
            n[:, best] += into
            n[best, best] += stay
            if best != own:  # other words' sums into and out of the two classes
                left[:, own] -= pairs[w]
                left[:, best] += pairs[w]
                right[:, own] -= pairs[:, w]
                right[:, best] += pairs[:, w]
        if not moved:
            break
    return of


def classify(work: Workspace, texts: DataFrame) -> tuple[Words, DataFrame, int, int]:
    """The frequent words with their classes, the written (word, n, class) of all words, and the numbers of tokens and distinct tokens."""
    spark = work.spark
    counts = work.table(count_tokens(texts), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    words = frequent_words(counts, total)
    pairs = count_pairs(texts, spark.sparkContext.broadcast(words))
    seeds = exchange(pairs, CLUSTERED, CLASSES, SWEEPS)
    member = np.zeros((len(pairs), _ALL), np.int64)
    member[np.arange(len(pairs)), seeds] = 1
    pairs, words = member.T @ pairs @ member, replace(words, states=seeds[words.states].astype(np.int32), hashed=_HASHED)
    for sweep in range(WHOLE_SWEEPS):
        shared = spark.sparkContext.broadcast(words)
        if sweep:
            pairs = count_pairs(texts, shared)
        classes = work.table(assign(count_contexts(texts, shared), shared, pairs), f"classes-{sweep}")
        rows = classes.where(F.col("n") * FREQUENT > F.lit(total)).select("word", "class").toPandas()
        h = rows["word"].to_numpy(np.int64).view(np.uint64)
        words = replace(words, states=rows["class"].to_numpy(np.int32)[np.argsort(h)])
    return words, classes, total, distinct


def _rows(texts: DataFrame, words) -> DataFrame:
    """Each row's sums over frequent words and its tokens' classes, and the hashes of its other words, whose classes are left open."""
    import pyarrow as pa

    names = [("id", pa.int64()), ("row", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("states", pa.binary()), ("rare", pa.list_(pa.int64()))]
    schema = pa.schema(names)

    def run(batches):
        own = words.value
        for batch in batches:
            hashes = token_hashes(utf8_column(batch, "text"))
            sizes, known_n, logs, states, rare = [], [], [], [], []
            for h in hashes:
                known, count, state = own.find(h)
                sizes.append(len(h))
                known_n.append(int(known.sum()))
                logs.append(float(np.log10(count + 1.0).sum()))
                states.append(np.where(known, state, _TAIL).astype(np.uint8).tobytes())
                rare.append(h[~known].view(np.int64))
            offsets = np.cumsum([0] + [len(x) for x in rare], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(known_n, pa.int64()), pa.array(logs, pa.float64()), pa.array(states, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rare) if rare else np.empty(0, np.int64))),
            ], schema=schema)

    return map_arrow(texts, run, "id long, row long, learn boolean, n_tokens long, n_known long, logs double, states binary, rare array<long>")


def _chain(states: bytes, tail: np.ndarray | None) -> np.ndarray:
    """Classes of a row's tokens. ``tail`` has (place among those left open) * 256 + class of each of them, in any order."""
    out = np.frombuffer(states, np.uint8).astype(np.int64)
    if tail is not None:
        out[out == _TAIL] = np.sort(tail) & 255
    return out


def _chains(batch):
    """Classes of the tokens of each row of a batch that begins with states and tail."""
    tail = batch.column(1)
    values, ends = tail.values.to_numpy(), tail.offsets.to_numpy()
    for i, states in enumerate(batch.column(0).to_pylist()):
        yield _chain(states, values[ends[i] : ends[i + 1]] if ends[i + 1] > ends[i] else None)


def _class_pairs(chains: DataFrame) -> np.ndarray:
    """Class bigram counts of the rows."""
    import pyarrow as pa

    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(_ALL * _ALL, np.int64)
        for batch in batches:
            for c in _chains(batch):
                total += np.bincount(np.append(_START, c[:-1]) * _ALL + c, minlength=_ALL * _ALL)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

    return _pair_table(map_arrow(chains.select("states", "tail"), run, "pair long, n long"), _ALL)


def _logs_of_chains(chains: DataFrame, step: np.ndarray) -> DataFrame:
    """The rows with the sums over their class transitions and emissions (``step``) as ``chain``."""
    import pyarrow as pa

    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("chain", pa.float64())])

    def run(batches):
        for batch in batches:
            chain = [float(step[np.append(_START, c[:-1]), c].sum()) for c in _chains(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(chain, pa.float64())], schema=schema)

    return map_arrow(chains.select("states", "tail", "id", "n_tokens", "n_known", "logs"), run, "id long, n_tokens long, n_known long, logs double, chain double")


def score(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    work = Workspace(spark, "lm-score")
    texts = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    learn = F.coalesce(F.col("id").isNotNull() & learnable, F.lit(False))
    words, classes, total, distinct = classify(work, texts.where(learn))
    keyed = texts.select("id", "text", F.monotonically_increasing_id().alias("row"), learn.alias("learn"))
    rows = work.table(_rows(keyed, spark.sparkContext.broadcast(words)), "rows")
    tail = classes.where(F.col("n") * FREQUENT <= F.lit(total))
    hashed = F.lit(_HASHED) + F.col("word").bitwiseAND(F.lit(RARE - 1)).cast("int")
    found = rows.select("row", F.posexplode("rare").alias("at", "word")).join(tail, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("rare_logs"), F.count("n").alias("rare_known"),
        F.collect_list(F.col("at").cast("long") * 256 + F.coalesce("class", hashed)).alias("tail"),
    )
    chains = work.table(rows.drop("rare").join(found, "row", "left").select(
        "id", "learn", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))).alias("logs"), "states", F.coalesce("tail", F.array().cast("array<long>")).alias("tail"),
    ), "chains")
    pairs = _class_pairs(chains.where("learn"))
    tokens, types = np.zeros(_ALL), np.zeros(_ALL)
    for c, t, v in classes.groupBy("class").agg(F.sum("n"), F.count(F.lit(1))).collect():
        tokens[c], types[c] = t, v
    step = np.log10((pairs + 0.5) / (pairs.sum(1, keepdims=True) + 0.5 * (CLASSES + RARE))) - np.log10(tokens + types + 1)
    out = _logs_of_chains(chains, step).select(
        "id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"), (F.col("logs") + F.col("chain")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder("id", 7) != 2)
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(remainder("id", 7) == 2, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
