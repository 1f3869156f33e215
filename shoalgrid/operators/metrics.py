"""Accuracy of predicted depths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgrid.functions.geo import iho_order
from shoalgrid.operators.ranks import running_total

DEPTH_BINS = (0, 5, 10, 15, 20, 30, 50, 100)
USES = {"Special Order": "Harbours and channels", "Order 1a/1b": "Coastal charting", "Order 2": "Reconnaissance", "Out of Spec": "Research only"}


def metric_columns(y: str = "y_true", p: str = "y_pred", count: str | None = None) -> list[Column]:
    """n, R2, RMSE, MAE, bias (predicted less true) and wMAPE as aggregates of one pass; ``count``: how many pairs a row stands for."""
    t, e, n = F.col(y), F.col(p) - F.col(y), F.sum(count) if count else F.count("*")
    total = lambda x: F.sum(F.col(count) * x) if count else F.sum(x)
    mean = lambda x: total(x) / n if count else F.avg(x)
    spread = total(t * t) - total(t) * total(t) / (n if count else F.count(t))
    return [
        n.alias("n"),
        F.when(spread > 0, 1 - total(e * e) / spread).alias("r2"),
        F.sqrt(mean(e * e)).alias("rmse"),
        mean(F.abs(e)).alias("mae"),
        mean(e).alias("bias"),
        F.when(total(F.abs(t)) > 0, 100 * total(F.abs(e)) / total(F.abs(t))).alias("wmape"),
    ]


def regression_metrics(pairs: DataFrame, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    return pairs.filter("y_true IS NOT NULL AND y_pred IS NOT NULL").groupBy(*by).agg(*metric_columns(count=count))


def stratified_errors(pairs: DataFrame, by: str = "model", least: int = 5) -> DataFrame:
    """Metrics of each model over all depths (stratum GLOBAL) and by depth bin with ``least`` pairs or more, with the survey order."""
    d = F.abs("y_true")
    name = F.lit(None).cast("string")
    for a, b in zip(DEPTH_BINS, DEPTH_BINS[1:]):
        name = F.when((d >= a) & (d < b), f"{a}-{b}").otherwise(name)
    rows = pairs.filter("y_true IS NOT NULL AND y_pred IS NOT NULL").withColumn("stratum", name).withColumn("_d", d)
    sets = rows.groupingSets([(F.col(by),), (F.col(by), F.col("stratum"))], F.col(by), F.col("stratum"))
    out = sets.agg(*metric_columns(), F.avg("_d").alias("mean_depth"), F.grouping("stratum").alias("_all"))
    out = out.filter((F.col("_all") == 1) | (F.col("stratum").isNotNull() & (F.col("n") >= least)))
    out = out.withColumn("stratum", F.when(F.col("_all") == 1, "GLOBAL").otherwise(F.col("stratum"))).drop("_all")
    return out.withColumn("iho_order", iho_order(F.col("rmse"), F.col("mean_depth")))


def against_observed(observed: DataFrame, first: DataFrame, second: DataFrame | None = None, key: str = "point_id") -> DataFrame:
    """``observed`` with p3_pred and, if given, p4_pred of the same points; points that lack one are left out."""
    out = observed.join(first.select(key, F.col("y_pred").alias("p3_pred")), key)
    return out if second is None else out.join(second.select(key, F.col("y_pred").alias("p4_pred")), key)


def suggested_use(orders: DataFrame) -> DataFrame:
    """``orders`` with the use that suits ``iho_order``, from a fixed table."""
    table = F.create_map(*[F.lit(x) for pair in USES.items() for x in pair])
    return orders.withColumn("suggested_use", table[F.col("iho_order")])


def phase_verdict(metrics: DataFrame, before: str, after: str, tie: float = 0.01) -> DataFrame:
    """Improvement in percent of RMSE and wMAPE from one model's row to another's, and which is better."""
    a = metrics.filter(F.col("model") == before).select(F.col("rmse").alias("r0"), F.col("wmape").alias("w0"))
    b = metrics.filter(F.col("model") == after).select(F.col("rmse").alias("r1"), F.col("wmape").alias("w1"))
    gain = lambda x, y: F.when(F.col(x) != 0, 100 * (F.col(x) - F.col(y)) / F.col(x))
    verdict = F.when(F.abs(F.col("r0") - F.col("r1")) <= tie, "tie").when(F.col("r1") < F.col("r0"), "after").otherwise("before")
    return a.crossJoin(F.broadcast(b)).select(gain("r0", "r1").alias("rmse_gain"), gain("w0", "w1").alias("wmape_gain"), verdict.alias("verdict"))


def feature_correlations(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, pearson) of each feature with the target; 0 without spread."""
    one = rows.agg(*[F.coalesce(F.nanvl(F.corr(f, target), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("pearson")) for f in features])).alias("x")).select("x.*")


def average_ranks(rows: DataFrame, value: str, key: Sequence[str]) -> DataFrame:
    """``key`` columns and the average rank of ``value``: values are counted first, and running totals are by range."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    ranks = running_total(counts, value, "_n", "_upto").select(F.col(value).alias("_v"), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"rank_{value}"))
    return rows.join(ranks, F.col(value) == F.col("_v")).select(*key, f"rank_{value}")


def spearman(rows: DataFrame, features: Sequence[str], target: str, key: Sequence[str]) -> DataFrame:
    """(feature, spearman): Pearson's coefficient of average ranks."""
    ranked = average_ranks(rows, target, key)
    for f in features:
        ranked = ranked.join(average_ranks(rows, f, key), list(key))
    out = feature_correlations(ranked, [f"rank_{f}" for f in features], f"rank_{target}")
    return out.select(F.substring("feature", 6, 1000).alias("feature"), F.col("pearson").alias("spearman"))


def composite_score(board: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Models with ``score``: each metric between its worst (0) and best (1), weighted, times 100; a metric without spread gives 1."""
    over = Window.partitionBy()
    total = sum(weights.values())
    score = F.lit(0.0)
    for m, w in weights.items():
        x = F.abs(m) if m == "bias" else F.col(m)
        low, high = F.min(x).over(over), F.max(x).over(over)
        part = F.when(high == low, 1.0).otherwise((x - low) / (high - low) if m == "r2" else (high - x) / (high - low))
        score = score + F.lit(w / total) * part
    return board.withColumn("score", score * 100)


def winner_stability(board: DataFrame, rounds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Share of rounds that a model wins and its mean score, for weights (round, w_<metric>...) of every round."""
    over = Window.partitionBy("round")
    rows = board.crossJoin(F.broadcast(rounds))
    total = sum((F.col(f"w_{m}") for m in metrics), F.lit(0.0))
    score = F.lit(0.0)
    for m in metrics:
        x = F.abs(m) if m == "bias" else F.col(m)
        low, high = F.min(x).over(over), F.max(x).over(over)
        part = F.when(high == low, 1.0).otherwise((x - low) / (high - low) if m == "r2" else (high - x) / (high - low))
        score = score + F.col(f"w_{m}") / total * part
    scored = rows.withColumn("score", score * 100)
    place = F.row_number().over(Window.partitionBy("round").orderBy(F.round("score", 6).desc(), "model"))
    return scored.withColumn("_p", place).groupBy("model").agg((F.count_if(F.col("_p") == 1) / F.count("*")).alias("wins"), F.avg("score").alias("mean_score"))
