"""Shared parts of the text operators: tables, text rules, size checks.

Words are runs of bytes other than space and \\t to \\r, so ``bytes.split()`` (which
splits at exactly these) and the Java pattern ``WORD`` agree. Lower-casing touches A-Z
only, as ``bytes.lower()`` does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a measured small side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def small(staged: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a staged table if its measured row count allows, else leave it to shuffle."""
    return F.broadcast(staged) if staged.limit(rows + 1).count() <= rows else staged


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
