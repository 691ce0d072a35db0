"""Rows packed as structs, and their texts as byte buffers in slices of bounded size."""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 500_000
#: Bytes of an Arrow batch on its way to Python, where the session leaves Spark's default of 64 MB.
BATCH_BYTES = 12_000_000
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark) -> None:
    """Batches by bytes, so that long texts come a few at a time; a session that has chosen its own bound keeps it."""
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def packed(df: DataFrame, added: list[str], text_col: str) -> tuple[DataFrame, list[str], str]:
    """``df`` as one struct column ``_row`` without columns that results will replace; the names in it and its type.

    A struct passes whatever the names of its fields, and the text travels once.
    """
    names = [c for c in df.columns if c not in added]
    if text_col not in names:
        raise ValueError(f"no column {text_col}, or a result would replace it")
    bound_batches(df.sparkSession)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    return rows, names, rows.schema["_row"].dataType.simpleString()


def unpacked(df: DataFrame, names: list[str], added: list[str]) -> DataFrame:
    return df.select(*[F.col(f"_row.`{c}`") for c in names], *added)


def texts_of(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The text column of packed rows; nulls as empty."""
    return pc.fill_null(batch.column("_row").field(text_col), "")


def _trim() -> None:
    """Freed memory of Arrow and of the C library goes back to the system, where the library can do so (glibc)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def released(rows):
    """``rows``, giving freed memory back when a task ends, as workers live on."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            _trim()

    return run


def slices(batches, names, body, limit: int = SLICE_BYTES):
    """For each slice of rows: a dict of columns ``names``, the bytes of the texts as one array, and the start and end of
    each row's bytes. ``body`` names a binary column without nulls, or is a function of the batch. A slice ends with the
    row that reaches ``limit``, so memory follows ``limit`` or the longest text."""
    for batch in batches:
        col = body(batch) if callable(body) else batch.column(body)
        if len(col) == 0:
            continue
        if not pa.types.is_binary(col.type):
            col = col.cast(pa.binary())
        offsets = np.frombuffer(col.buffers()[1], np.int32, count=len(col) + 1, offset=4 * col.offset).astype(np.int64)
        data = col.buffers()[2]
        values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        low = 0
        while low < len(col):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit)))
            high = min(high, len(col))
            yield (
                {n: batch.column(n).slice(low, high - low) for n in names},
                values[offsets[low] : offsets[high]],
                offsets[low:high] - offsets[low],
                offsets[low + 1 : high + 1] - offsets[low],
            )
            low = high
