"""Exact deduplication with disk-backed keyed streaming state.

A feed of (id, digest, locator) runs through a streaming aggregation whose state (RocksDB on the executors' disks, snapshots in the shared
folder) never expires. For each digest the state keeps the identifier and content locator of the row that stays, and a count. A locator is the file
and the row in it where the text stands; a table that doesn't come from files is written first.

On hits, that is, digests with more than one row, full bytes are checked: the texts that the state's locators name are read again and compared with the texts of
the hits' rows. (The least and the greatest of all these are the same bytes only if all are; such aggregates collapse groups of copies before
any shuffle.) Groups where they differ, a digest collision, are dealt by text instead. Everything is DataFrame operations.

With ``folder`` the state lasts over calls: rows are then judged against all rows of earlier calls too, whose files must still be there.

Defined results: a null text counts as empty. A null id sorts below all others. Of rows that repeat the same id and text, one stays. Other columns
are never read, whatever their names. Texts of any length are hashed and compared whole. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.text import fold_case, fresh_name, small_side
from strataloom.plans.workspace import Workspace

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves megabytes
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else executors hold every store's memory after the stream's end
}
_LOCATOR = "struct<file: string, row: long>"
_STAYS = f"struct<id: long, locator: {_LOCATOR}>"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _folded(text: Column) -> Column:
    return fold_case(F.coalesce(text.cast("string"), F.lit("")))


def located(docs: DataFrame, label: str = "located") -> tuple[DataFrame, Callable[[DataFrame], Column]]:
    """The documents, written first if they don't stand in files with numbered rows, and what gives a row's locator."""

    def locator(df: DataFrame) -> Column:
        of = df.metadataColumn("_metadata")  # also if a column of its own has that name
        return F.struct(of["file_path"].alias("file"), of["row_index"].alias("row")).cast(_LOCATOR)

    try:
        docs.select(locator(docs)).schema  # noqa: B018 - resolved at once
    except AnalysisException:
        docs = Workspace(docs.sparkSession, label).table(docs, "documents")
    return docs, locator


class DedupState:
    """Digests seen so far. Feeds given to ``advance`` one after another share the same state folder."""

    def __init__(self, spark: SparkSession, folder: str, files_per_batch: int | None = None):
        self.spark, self.folder, self.files_per_batch = spark, folder, files_per_batch

    def advance(self, feed_path: str, schema) -> DataFrame:
        """Read what is new in the feed folder; one row for each digest in it: what stays of all rows seen, and how many they are."""
        options = {"maxFilesPerTrigger": str(self.files_per_batch)} if self.files_per_batch else {}
        written: list[str] = []

        def keep(batch: DataFrame, epoch: int) -> None:  # rewriting an epoch makes a retry harmless
            path = f"{self.folder}/changes/epoch={epoch}"
            batch.write.mode("overwrite").parquet(path)
            written.append(path)

        with _settings(self.spark, _STATE):
            stream = self.spark.readStream.schema(schema).options(**options).option("recursiveFileLookup", "true").parquet(feed_path)
            seen = stream.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("stays"), F.count(F.lit(1)).alias("n"))
            query = (
                seen.writeStream.outputMode("update").foreachBatch(keep)
                .option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            )
            query.awaitTermination()
        layout = f"digest binary, stays {_STAYS}, n long"
        if not written:
            return self.spark.createDataFrame([], layout)
        changed = self.spark.read.schema(layout).parquet(*written)
        # Both only grow, so the greatest is the latest.
        return changed.groupBy("digest").agg(F.max("stays").alias("stays"), F.max("n").alias("n"))


def _retained(docs: DataFrame, hits: DataFrame, locator, text_col: str) -> DataFrame:
    """(digest, text): the contents that the locators of hits name."""
    wanted = hits.select("digest", F.col("stays.locator").alias("at"))
    own = docs.select(locator(docs).alias("at"), _folded(docs[f"`{text_col}`"]).alias("text"))
    n = hits.count()
    found = own.join(small_side(wanted, n, 256), "at").select("digest", "text")
    here = {f.replace("file:///", "file:/") for f in docs.inputFiles()}
    files = [r["file"] for r in wanted.select("at.file").distinct().toLocalIterator()]  # as many as the sources have files
    earlier = [f for f in files if f.replace("file:///", "file:/") not in here]
    if earlier:
        before = docs.sparkSession.read.parquet(*earlier)
        rows = before.select(locator(before).alias("at"), _folded(before[f"`{text_col}`"]).alias("text"))
        found = found.unionByName(rows.join(small_side(wanted, n, 256), "at").select("digest", "text"))
    return found


def _judged(
    docs: DataFrame, locator, id_col: str, text_col: str, digest: Callable[[Column], Column], files_per_batch: int | None, folder: str | None
) -> DataFrame:
    spark = docs.sparkSession
    work = Workspace(spark, "exact-dedup")
    folder = folder or work.at("seen")
    texts = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), _folded(docs[f"`{text_col}`"]).alias("text"), locator(docs).alias("locator"))
    path = f"{folder}/feed/{uuid.uuid4().hex}"
    texts.select("id", digest(F.col("text")).alias("digest"), "locator").write.parquet(path)
    feed = spark.read.schema(f"id long, digest binary, locator {_LOCATOR}").parquet(path)
    verdicts = work.table(DedupState(spark, folder, files_per_batch).advance(f"{folder}/feed", feed.schema).where("n > 1"), "hits")
    n_hits = verdicts.count()

    by_digest = texts.withColumn("digest", digest(F.col("text")))
    members = by_digest.join(small_side(verdicts.select("digest"), n_hits), "digest", "left_semi").select("digest", "text")
    collided = work.table(
        members.unionByName(_retained(docs, verdicts, locator, text_col)).groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
        .where("least <> greatest").select("digest"), "collided",
    )

    result = feed.join(small_side(verdicts, n_hits, 256), "digest", "left").select(
        "id", "locator", "digest",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("stays.id")).alias("stays_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("n"),
        F.coalesce(F.col("stays.locator") == F.col("locator"), F.lit(True)).alias("kept"),
    )
    if collided.isEmpty():
        return result
    return result.join(collided, "digest", "left_anti").unionByName(_by_text(work, spark, folder, by_digest, collided, locator, text_col))


def _by_text(work: Workspace, spark: SparkSession, folder: str, by_digest: DataFrame, collided: DataFrame, locator, text_col: str) -> DataFrame:
    """Rows of digests that different texts share, grouped by the texts themselves; texts of earlier calls are found by their rows in the feed."""
    rows = work.table(by_digest.join(collided, "digest", "left_semi"), "collided-rows")
    fed = spark.read.schema(f"id long, digest binary, locator {_LOCATOR}").option("recursiveFileLookup", "true").parquet(f"{folder}/feed")
    others = fed.join(collided, "digest", "left_semi").join(rows.select("locator"), "locator", "left_anti")
    every = rows
    files = [r["file"] for r in others.select("locator.file").distinct().toLocalIterator()]
    if files:
        before = spark.read.parquet(*files)
        texts = before.select(locator(before).alias("locator"), _folded(before[f"`{text_col}`"]).alias("text"))
        every = rows.unionByName(others.join(texts, "locator").select(rows.columns))
    groups = every.groupBy("text").agg(F.max(F.struct("id", "locator")).alias("stays"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, "text").select(
        "id", "locator", "digest", F.col("stays.id").alias("stays_id"), "n", (F.col("stays.locator") == F.col("locator")).alias("kept")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """One row per document: id, locator, digest, stays_id, n, kept. ``folder``: where the state of earlier calls is and this one's stays."""
    docs, locator = located(docs)
    return _judged(docs, locator, id_col, text_col, digest, files_per_batch, folder)


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns; decided by row, so of rows that repeat an id and a text one stays."""
    docs, locator = located(docs)
    at = fresh_name(docs, "locator")
    judged = _judged(docs, locator, id_col, text_col, sha256, None, folder)
    gone = Workspace(docs.sparkSession, "exact-dedup-rows").table(judged.where("NOT kept").select(F.col("locator").alias(at)), "gone")
    return docs.withColumn(at, locator(docs)).join(small_side(gone, gone.count(), 256), at, "left_anti").drop(at)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select(
        F.col("id").alias("doc_id"), F.col("stays_id").alias("keep_id"), F.col("n").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


#: Of rows that repeat the same id and text, one is kept, whichever it is.
SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
