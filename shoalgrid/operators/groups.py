"""Cells beside the numbers of their group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(cells: DataFrame, numbers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``cells`` with the columns of ``numbers``, which has a row a group (one row without ``by``). Groups with a null key are groups, too."""
    if not by:
        return cells.crossJoin(F.broadcast(numbers))
    named = numbers.select(*[F.col(b).alias(f"_{b}") for b in by], *[c for c in numbers.columns if c not in by])
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return cells.join(named, same).drop(*[f"_{b}" for b in by])
