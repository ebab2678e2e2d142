"""Window-frame helpers that follow the usual rolling-window conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centred(width: int) -> tuple[int, int]:
    """(before, after) of a centred window: even 4 covers -2..+1, odd 5 covers -2..+2."""
    before = width // 2
    return before, width - 1 - before


def trailing(width: int) -> tuple[int, int]:
    return width - 1, 0


def min_periods(value: Column, seen: Column, minimum: int) -> Column:
    """``value`` only where at least ``minimum`` non-null samples were in the frame."""
    return F.when(seen >= minimum, value)
