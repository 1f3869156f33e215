"""Choosing among models: what a score weighs, and the orders that a leaderboard may have."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights in per cent of metrics that are chosen without weights (fixed values).
DEFAULT_WEIGHTS = {"r2": 35.0, "rmse": 30.0, "wmape": 20.0, "bias": 15.0, "mae": 15.0}
#: Orders of a leaderboard, the best model first: columns with a minus from the largest down.
STRATEGIES = {
    "stability": ("-wins", "-mean_score", "-score", "-r2"),
    "score": ("-score", "-r2", "-wins"),
    "r2": ("-r2", "-score", "-wins"),
    "rmse": ("rmse", "-score"),
    "wmape": ("wmape", "-score"),
    "bias": ("abs_bias", "-score"),
    "mae": ("mae", "-score"),
}


@dataclass(frozen=True)
class ScoreConfig:
    """Weights that sum to 1, the range that each is drawn from, and how many rounds of draws there are."""

    weights: Mapping[str, float]
    ranges: Mapping[str, tuple[float, float]]
    rounds: int
    variation: float


def score_config(
    metrics: Sequence[str] | None = None,
    weights: Mapping[str, float] | None = None,
    ranges: Mapping[str, tuple[float, float]] | None = None,
    rounds: int = 20,
    variation: float = 0.35,
) -> ScoreConfig:
    """The configuration for the chosen ``metrics`` (all, if none), by default weights or those in ``weights`` alone.

    Weights below 0 count as 0 and are scaled to a sum of 1. A weight's range is ``variation`` (a share, or per cent if
    over 1, kept from 5 to 95 %) around it, from 0.01 to 1, unless given. An unknown metric or no weight at all is an error.
    """
    unknown = {*(metrics or ()), *(weights or ()), *(ranges or ())} - set(DEFAULT_WEIGHTS)
    if unknown:
        raise ValueError(f"no metrics: {sorted(unknown)}")
    raw = weights if weights else {m: w for m, w in DEFAULT_WEIGHTS.items() if not metrics or m in metrics}
    raw = {m: max(0.0, float(raw.get(m, 0.0))) for m in DEFAULT_WEIGHTS}
    total = sum(raw.values())
    if not total:
        raise ValueError("no metric has a weight")
    share = min(0.95, max(0.05, variation / 100 if variation > 1 else variation))
    own = {m: w / total for m, w in raw.items() if w}
    around = {m: (max(0.01, w * (1 - share)), min(1.0, w * (1 + share))) for m, w in own.items()}
    return ScoreConfig(own, around | {m: tuple(sorted(r)) for m, r in (ranges or {}).items() if m in own}, max(1, int(rounds)), share)


def ranked(board: DataFrame, strategy: str) -> DataFrame:
    """``board`` (a row per model; the number of models is small) with ``place`` by a strategy, ties in the end by name."""
    rows = board.withColumn("abs_bias", F.abs("bias"))
    order = [F.col(c[1:]).desc() if c[0] == "-" else F.col(c).asc() for c in STRATEGIES[strategy]]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order, "model"))).drop("abs_bias")
