"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of a benchmark: runs of ``width`` item words (a shorter item is one
window). Words are numbered, and a pattern is a place in one array of word numbers. For each pattern length a table maps a block of words to the
shift that it allows; a block in no pattern skips almost a whole window, a word in no pattern a whole one. Where the shift is zero, the block's
bucket names the test strings, and the words are compared directly.

Patterns go to the executors in groups of at most ``group_words`` item words (an item of more is a group of its own, cut into pieces that
overlap by a window), each group one scan, so what is broadcast has a fixed bound and any benchmark is searched whole. A worker builds a group's tables once.

Defined results: a null or empty text has no words, no hits and is not contaminated. Windows of an
item with a null id mark words, but only ids that are not null count as items. Rows that repeat
an item id add their windows to the same item. Repeated documents each get a row. Very long texts are searched whole. Other columns are never read, whatever
their names. An empty benchmark marks nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.text import columns, fresh_name, map_arrow, small_side, utf8_column, where_text, words
from strataloom.plans.workspace import Workspace

#: Item words of a group: about 400 bytes each, at most, while a worker builds its tables.
GROUP_WORDS = 250_000
_BITS = 21


class WuManber:
    """Patterns of one length in words. ``held`` has all word numbers, ``places`` where each pattern begins."""

    def __init__(self, held: array, length: int, places: array, owners: list, block: int = 3):
        self.held, self.length, self.places, self.owners = held, length, places, owners
        self.block = b = min(block, length)
        self.skip = length - b + 1
        #: Of each block of words, the shift that it allows or, if that is none, its bucket of pattern numbers.
        self.table: dict[int, int | tuple[int, ...]] = {}
        table, skip = self.table, self.skip
        for number, place in enumerate(places):
            for end in range(b, length):
                key, by = self._key(held, place + end - b), length - end
                known = table.get(key, skip)
                if type(known) is int and by < known:
                    table[key] = by
            key = self._key(held, place + length - b)
            known = table.get(key)
            table[key] = (*known, number) if type(known) is tuple else (number,)

    def _key(self, numbers, at: int) -> int:
        """A block of words as one number."""
        key = 0
        for k in range(at, at + self.block):
            key = key << _BITS | numbers[k]
        return key

    def find(self, text: array) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence in word numbers; 0 is a word of no pattern."""
        length, b, skip, held, places = self.length, self.block, self.skip, self.held, self.places
        get, key_of, end, n = self.table.get, self._key, self.length, len(text)
        while end <= n:
            if not text[end - 1]:  # no pattern reaches over such a word
                end += length
                continue
            found = get(key_of(text, end - b), skip)
            if type(found) is int:
                end += found
                continue
            start = end - length
            here = text[start:end]
            for number in found:
                place = places[number]
                if held[place] == here[0] and held[place : place + length] == here:
                    yield start, number
            end += 1


class Matchers:
    """The tables of a group of items."""

    def __init__(self, items: list[tuple[object, bytes | None]], width: int):
        self.numbers: dict[bytes, int] = {}
        held, seen = array("i"), defaultdict(dict)
        places, owners = defaultdict(lambda: array("i")), defaultdict(list)
        for item, text in items:
            w = [self.numbers.setdefault(x, len(self.numbers) + 1) for x in words(text)]
            at, length = len(held), min(width, len(w))
            held.extend(w)
            for k in range(at, at + len(w) - length + 1 if w else at):
                number = seen[length].setdefault(hash(held[k : k + length].tobytes()), len(places[length]))
                if number < len(places[length]) and held[places[length][number] : places[length][number] + length] == held[k : k + length]:
                    owners[length][number] = {*owners[length][number], item}
                else:  # a new pattern, or one whose hash another has
                    places[length].append(k)
                    owners[length].append((item,))
        if len(self.numbers) >> _BITS:
            raise ValueError("too many distinct words in a group")
        self.each = [WuManber(held, length, places[length], owners[length]) for length in sorted(places)]

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        get = self.numbers.get
        return search(self.each, array("i", [get(w, 0) for w in text]))


_BUILT: list = [None, None]


def matchers(shared, width: int) -> Matchers:
    """The worker's tables of a group, built by its first task of the group."""
    key, items = shared.value
    if _BUILT[0] != (key, width):
        _BUILT[:] = None, None
        _BUILT[:] = (key, width), Matchers(items, width)
    return _BUILT[1]


def search(matchers: list[WuManber], text: array) -> tuple[list[tuple[int, int]], set]:
    """Merged spans of hit words and the owners of what occurs."""
    spans, found = [], set()
    for m in matchers:
        for start, number in m.find(text):
            if (m, number) not in found:
                found.add((m, number))
            if spans and start <= spans[-1][1] and spans[-1][0] <= start:
                spans[-1][1] = max(spans[-1][1], start + m.length)
            else:
                spans.append([start, start + m.length])
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    owners: set = set()
    for m, number in found:
        owners.update(m.owners[number])
    return [(a, b) for a, b in merged], owners


def _scan(docs: DataFrame, shared, width: int) -> DataFrame:
    import pyarrow as pa

    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def run(batches):
        own = matchers(shared, width)
        for batch in batches:
            counts, spans, owners = [], [], []
            for text in utf8_column(batch, "text"):
                w = words(text)
                hit, found = own.search(w)
                counts.append(len(w))
                spans.append(hit)
                owners.append([x for x in found if x is not None])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(owners, schema.field("items").type)],
                schema=schema,
            )

    return map_arrow(docs, run, "id long, row long, n_words long, spans array<array<long>>, items array<string>")


def _groups(benchmark: DataFrame, group_words: int, width: int) -> Iterator[list]:
    """Items in groups of bounded size; the driver holds one group at a time. A long item is cut so that each of its windows is in one piece."""
    group, size = [], 0
    for row in benchmark.select("item", F.encode("text", "UTF-8").alias("text")).toLocalIterator():
        w = words(bytes(row.text)) if row.text is not None else []
        for at in range(0, max(1, len(w) - width + 1), group_words):
            piece = w[at : at + group_words + width - 1]
            if size and size + len(piece) > group_words:
                yield group
                group, size = [], 0
            group.append((row.item, b" ".join(piece)))
            size += 1 + len(piece)
    yield group


def _shared(spark: SparkSession, group: list):
    import uuid

    return spark.sparkContext.broadcast((uuid.uuid4().hex, group))


def _is_contaminated(n_hit: int, n_words: int, share: float) -> bool:
    return n_hit > 0 and n_hit >= share * n_words - 1e-9 * n_words


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = 13, share: float = 0.05, group_words: int = GROUP_WORDS,
) -> DataFrame:
    """One row per document: id, n_words, spans (word ranges hit), items (ids, as text, sorted), n_hit, contaminated."""
    spark = docs.sparkSession
    texts = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text", F.lit(0).cast("long").alias("row"))
    groups = _groups(_items(benchmark, item_col, item_text_col), group_words, width)
    group, following = next(groups), next(groups, None)
    if following is None:
        found = _scan(texts, _shared(spark, group), width)
    else:  # every group scans the same numbered rows; a document's finds meet in one row
        work = Workspace(spark, "decontaminate")
        numbered = work.table(texts.withColumn("row", F.monotonically_increasing_id()), "documents")
        parts, k = [], 0
        while group is not None:
            parts.append(work.table(_scan(numbered, _shared(spark, group), width), f"group-{k}"))
            group, following, k = following, next(groups, None), k + 1
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        found = union.groupBy("id", "row", "n_words").agg(
            F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
        merge = F.aggregate(
            "spans", F.array().cast("array<array<long>>"),
            lambda done, s: F.when((F.size(done) > 0) & (s[0] <= F.element_at(done, -1)[1]), F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], s[1])))
            )).otherwise(F.concat(done, F.array(s))),
        )
        found = found.withColumn("spans", merge)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    out = found.withColumn("n_hit", n_hit).withColumn("items", F.array_sort("items"))
    return out.select("id", "n_words", "spans", "items", "n_hit", ((F.col("n_hit") > 0) & (F.col("n_hit") >= share * F.col("n_words") - 1e-9 * F.col("n_words"))).alias("contaminated"))


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return columns(benchmark, item=item_col, text=item_text_col).select(F.col("item").cast("string").alias("item"), F.col("text").cast("string").alias("text"))


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13,
    share: float = 0.05, group_words: int = GROUP_WORDS,
) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; decided by row."""
    spark = docs.sparkSession
    groups = _groups(_items(benchmark, item_col, item_text_col), group_words, width)
    group = next(groups)
    if next(groups, None) is None:
        shared = _shared(spark, group)

        def chosen():
            own = matchers(shared, width)

            def clean(text: bytes | None) -> bool:
                w = words(text)
                return not _is_contaminated(sum(b - a for a, b in own.search(w)[0]), len(w), share)

            return lambda texts: list(map(clean, texts))

        return where_text(docs, text_col, chosen)
    work, at = Workspace(spark, "keep-clean"), fresh_name(docs, "row")
    numbered = work.table(docs.withColumn(at, F.monotonically_increasing_id()), "documents")
    found = decontaminate(numbered, benchmark, at, text_col, item_col, item_text_col, width, share, group_words)
    gone = work.table(found.where("contaminated").select(F.col("id").alias(at)), "contaminated")
    return numbered.join(small_side(gone, gone.count()), at, "left_anti").select(docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM iw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win), dwin AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)
), occ AS (
  SELECT doc_id, i, dwin.k, item_id FROM dwin JOIN win ON dwin.s = win.s AND dwin.k = win.k
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
