"""What the text operators share: case folding, words, input columns and checked broadcasts."""

from __future__ import annotations

import ctypes
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of UTF-8 to lower-cased word bytes ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``; all others become spaces.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only. ASCII texts take the fast built-in; others are mapped character by character."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(utf8: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and everything beyond ASCII."""
    return utf8.translate(WORD_BYTES).split() if utf8 else []


def tokens(utf8: bytes | None) -> list[bytes]:
    """Lower-cased runs without ASCII white space (``[^\\x20\\x09-\\x0D]+``)."""
    return utf8.lower().split() if utf8 else []


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the columns asked for, under the operator's own names, so that no other column can clash."""
    return df.select(*[df[f"`{source}`"].alias(own) for own, source in named.items()])


def binary_list(column) -> list[bytes | None]:
    """A string column as bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def utf8_column(batch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as bytes, by its name."""
    return binary_list(batch.column(batch.schema.get_field_index(name)))


#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20


def _trimmed(run, batches):
    """What ``run`` yields; the memory that the task has freed goes back to the system before the worker waits for its next task."""
    try:
        yield from run(batches)
    finally:
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes, a setting of the session that is lowered here if it is above ``BATCH_BYTES``."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(name)).rstrip("bB")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(partial(_trimmed, run), schema)


#: Bytes that a broadcast may hold.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """A broadcast hint if the counted rows, of at most about ``row_bytes`` each, are within the limit; beyond it the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def where_text(docs: DataFrame, text_col: str, chosen) -> DataFrame:
    """Rows, with all their columns, for whose texts ``chosen()`` (made once a task) gives true, of a batch's texts as bytes."""
    import pyarrow as pa

    names = docs.columns
    place = next(k for k, c in enumerate(names) if c == text_col)

    def run(batches):
        choose = chosen()
        for batch in batches:
            kept = choose(binary_list(batch.column(place)))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
