"""Bounded samples by hash, the same at every table size.

A row is drawn if the 64-bit hash of its key lies below a threshold, so a rate can be as small
as one in 2^64 and never falls to zero by rounding. What is drawn is bounded in expectation by
the number wanted; it comes to the driver in parallel, and an empty draw from a table that has
rows is an error, never an empty model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST, SPAN = -(1 << 63), 1 << 64


def threshold(wanted: int, rows: int) -> int:
    """The signed 64-bit value below which a hash is drawn with probability ``wanted / rows``, at most 1."""
    return LOWEST + max(1, min(SPAN - 1, wanted * SPAN // max(1, rows)))


def rate(value: int) -> float:
    """The probability that a hash lies below ``value``."""
    return (value - LOWEST) / (SPAN - 1)


def drawn(key: Column, below: int | Column) -> Column:
    """Whether the row of ``key`` is in the sample; the greatest threshold draws every row."""
    below = below if isinstance(below, Column) else F.lit(below)
    return (F.xxhash64(key) < below) | (below == F.lit(LOWEST + SPAN - 1))


def required(got: int, rows: int, what: str) -> None:
    """An empty sample of a table with rows would empty a model: stop instead."""
    if rows and not got:
        raise RuntimeError(f"no row drawn for {what} out of {rows}")


__all__ = ["drawn", "rate", "required", "threshold"]
