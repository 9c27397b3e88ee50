"""Rates with their denominators, and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054


def rate(hits: Column, known: Column) -> Column:
    return F.when(known > 0, F.round(hits / known, 4))


def wilson(hits: Column, known: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper end of the score interval; null where nothing is known."""
    p, d = hits / known, 1 + z * z / known
    mid, half = (p + z * z / (2 * known)) / d, F.sqrt(p * (1 - p) / known + z * z / (4 * known * known)) * z / d
    return F.when(known > 0, F.round(F.greatest(F.lit(0.0), mid - half), 4)), F.when(known > 0, F.round(F.least(F.lit(1.0), mid + half), 4))


def wilson_sql(hits: str, known: str, z: float = Z) -> tuple[str, str]:
    p = f"({hits}::DOUBLE / {known})"
    mid = f"(({p} + {z * z} / (2 * {known})) / (1 + {z * z} / {known}))"
    half = f"(sqrt({p} * (1 - {p}) / {known} + {z * z} / (4 * {known} * {known})) * {z} / (1 + {z * z} / {known}))"
    return f"CASE WHEN {known} > 0 THEN round(greatest(0, {mid} - {half}), 4) END", f"CASE WHEN {known} > 0 THEN round(least(1, {mid} + {half}), 4) END"

