"""Top-k policies. The three tie rules stay three operators: cut, keep the extreme, keep at the cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(score: DataFrame, n: int = 5, keys: list[str] | None = None, worst: bool = False) -> DataFrame:
    """First ``n`` rows of a group, ties cut by entity. Spark limits each map task to ``n`` rows per group."""
    keys = keys or ["period"]
    order = F.col("score").asc() if worst else F.col("score").desc()
    w = W.partitionBy(*keys).orderBy(order, "entity")
    return score.withColumn("row_no", F.row_number().over(w)).filter(F.col("row_no") <= n)


def extreme_with_ties(score: DataFrame, keys: list[str] | None = None, lowest: bool = True) -> DataFrame:
    """Every row at the extreme score of its group."""
    keys = keys or ["period"]
    edge = score.groupBy(*keys).agg((F.min if lowest else F.max)("score").alias("score"))
    return score.join(edge, [*keys, "score"], "left_semi")


def top_n_with_ties(score: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Every row whose score reaches the n-th score of its group; all rows when the group is smaller."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "entity")
    cut = (
        score.select(*keys, "score", "entity")
        .withColumn("_k", F.row_number().over(order))
        .filter(F.col("_k") <= n)
        .groupBy(*keys)
        .agg(F.min("score").alias("_cut"))
    )
    return score.join(cut, keys).filter(F.col("score") >= F.col("_cut")).drop("_cut")


def direction_aware(score: DataFrame, asks: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` best or worst rows per (period, metric), as each ask row says (``worst`` flag)."""
    best = top_n(score, n, ["period", "metric"]).withColumn("worst", F.lit(False))
    poor = top_n(score, n, ["period", "metric"], worst=True).withColumn("worst", F.lit(True))
    return best.unionByName(poor).join(asks, ["period", "metric", "worst"])
