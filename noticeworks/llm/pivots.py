"""Pivot distance tables: if the distances of two fingerprints to a pivot differ by more than is allowed, so do they."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PIVOTS = 16

#: Reference fingerprints: multiples of an odd constant, so they are spread.
PIVOT_VALUES = [(0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64) for i in range(PIVOTS)]


def pivot_distances(fp: Column) -> list[Column]:
    """Distances to the pivots, eight to a long."""
    signed = [p - (1 << 64) if p >> 63 else p for p in PIVOT_VALUES]
    packed = []
    for i in range(0, PIVOTS, 8):
        total = F.lit(0).cast("long")
        for p in signed[i : i + 8]:
            total = F.shiftleft(total, 8).bitwiseOR(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"))
        packed.append(total)
    return packed


def near(a: str, b: str, distance: int) -> Column:
    """Pivot coordinates within the distance, then the fingerprints themselves."""
    close = F.lit(True)
    for i in range(PIVOTS):
        at = lambda s, i=i: F.shiftright(F.col(f"{s}.p{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(127).cast("long"))
        close = close & (F.abs(at(a) - at(b)) <= distance)
    return close & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= distance)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """The distances of fingerprints (columns) to the pivots (rows)."""
    return np.stack([np.bitwise_count(fp ^ np.uint64(pivot)).astype(np.int8) for pivot in PIVOT_VALUES])


def near_pairs(fp: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int, table: np.ndarray | None = None) -> np.ndarray:
    """Which of the pairs of places a and b are within ``distance``: pivot by pivot, pairs whose coordinates in the table
    differ by more are discarded, and the fingerprints of those that survive are compared."""
    left = np.arange(len(a))
    for to in pivot_table(fp) if table is None else table:
        left = left[np.abs(to[a[left]] - to[b[left]]) <= distance]
    return left[np.bitwise_count(fp[a[left]] ^ fp[b[left]]) <= distance]
