"""Ranks, ties, neighbours in time and deviations over score tables.

Means and ranks are computed on pre-aggregated rows and joined back: a score
has two decimals, so a period has a bounded number of distinct scores however
many entities it ranks, and no task ever sorts a whole period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import durable

DEAD_BAND = 0.01  # fixed value: a deviation below this is called level


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Exact row numbers for groups of any size.

    Rows are range-partitioned by group and order, so a hot group spreads over many
    tasks; each piece is numbered alone and shifted by the sizes of the pieces before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_piece", F.spark_partition_id())
    )
    sizes = placed.groupBy("_piece", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("_piece", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy("_piece", *keys).orderBy(*order)
    return (
        placed.join(shift, ["_piece", *keys])
        .withColumn(name, F.col("_shift") + F.row_number().over(inside))
        .drop("_piece", "_shift")
    )


def score_levels(score: DataFrame, keys: list[str], ascending: bool = False) -> DataFrame:
    """One row per distinct score of a group: how many rows share it, its rank and the group size."""
    levels = score.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("tie_n"))
    w = W.partitionBy(*keys).orderBy(F.col("score").asc() if ascending else F.col("score").desc())
    return levels.select(
        *keys,
        "score",
        "tie_n",
        (F.coalesce(F.sum("tie_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).alias("rnk"),
        F.row_number().over(w).alias("dense_rnk"),
        F.sum("tie_n").over(W.partitionBy(*keys)).alias("group_n"),
    )


TIE_ROWS = 100_000  # a tie of more rows is numbered over range partitions


def rank_table(score: DataFrame, keys: list[str] | None = None, tie_rows: int = TIE_ROWS) -> DataFrame:
    """Every row with ``row_no`` (score desc, entity asc), ``rnk``, ``dense_rnk``, ``tie_n`` and ``group_n``.

    The size of every tie is known from the counts per score. Rows of a tie that one task should not sort are numbered by :func:`numbered`; both ways
    give the same numbers.
    """
    keys = keys or ["period"]
    levels = durable(score_levels(score, keys))
    placed = score.join(levels, [*keys, "score"])
    small, large = placed.filter(F.col("tie_n") <= tie_rows), placed.filter(F.col("tie_n") > tie_rows)
    placed = small.withColumn("_in_tie", F.row_number().over(W.partitionBy(*keys, "score").orderBy("entity")))
    if levels.filter(F.col("tie_n") > tie_rows).limit(1).count():
        placed = placed.unionByName(numbered(large, [*keys, "score"], [F.col("entity")], "_in_tie"))
    return placed.withColumn("row_no", F.col("rnk") + F.col("_in_tie") - 1).drop("_in_tie")


def tie_report(score: DataFrame, show: int = 2) -> DataFrame:
    """Each tied row with the tie size and the first ``show`` other names (entity order).

    Only the first ``show + 1`` names of a tie are kept, whatever its size.
    """
    first = W.partitionBy("period", "score").orderBy("entity")
    names = (
        score.select("period", "score", "entity", F.row_number().over(first).alias("_k"))
        .filter(F.col("_k") <= show + 1)
        .groupBy("period", "score")
        .agg(F.sort_array(F.collect_list("entity")).alias("_names"))
    )
    counts = score.groupBy("period", "score").agg(F.count(F.lit(1)).alias("tie_n")).filter("tie_n > 1")
    others = F.filter(F.col("_names"), lambda e: e != F.col("entity"))
    return (
        score.join(counts, ["period", "score"])
        .join(names, ["period", "score"])
        .select("period", "entity", "score", "tie_n", F.array_join(F.slice(others, 1, show), "/").alias("others"))
    )


def with_neighbours(score: DataFrame) -> DataFrame:
    """Previous and next *observed* period of each entity, the change from the previous one, and where that one stands."""
    w = W.partitionBy("entity").orderBy("period")
    return score.select(
        "*",
        F.lag("period").over(w).alias("prev_period"),
        F.lag("score").over(w).alias("prev_score"),
        F.lead("period").over(w).alias("next_period"),
        (F.col("score") - F.lag("score").over(w)).alias("delta"),
        *([F.lag("source").over(w).alias("prev_source")] if "source" in score.columns else []),
    )


def version_changes(meta: DataFrame) -> DataFrame:
    """Methodology version beside that of the previous period; ``changed`` is NULL-safe.

    The window runs over one row per period, a calendar's length.
    """
    w = W.orderBy("period")
    prev = F.lag("basis_version").over(w)
    return meta.select(
        "period",
        "basis_version",
        prev.alias("prev_version"),
        (prev.isNotNull() & (prev != F.col("basis_version"))).alias("changed"),
    )


def exact_mean(col: str = "score") -> Column:
    """Decimal sum over count: no dependence on row order, enough digits to round from."""
    return F.sum(col) / F.count(F.lit(1))


def with_deviations(metric_score: DataFrame, members: DataFrame, digits: int = 2) -> DataFrame:
    """Deviation of each metric score from the mean of all entities and from the mean of its tier (self included)."""
    placed = metric_score.join(members, "entity")
    overall = placed.groupBy("period", "metric").agg(exact_mean().alias("_all"))
    peers = placed.groupBy("period", "metric", "tier").agg(exact_mean().alias("_peer"))
    return (
        placed.join(overall, ["period", "metric"])
        .join(peers, ["period", "metric", "tier"])
        .withColumn("diff_all", F.round(F.col("score") - F.col("_all"), digits))
        .withColumn("diff_tier", F.round(F.col("score") - F.col("_peer"), digits))
        .withColumn("tier_mean", F.round("_peer", digits))
        .drop("_all", "_peer")
    )


def strength(diff: Column) -> Column:
    return (
        F.when(F.abs(diff) < DEAD_BAND, "level").when(diff > 0, "above").otherwise("below")
    )


def extremes(deviations: DataFrame) -> DataFrame:
    """Strongest and weakest metric of each (period, entity) against its tier; ties go to the first name."""
    best = F.struct((-F.col("diff_tier")).alias("d"), "metric")
    worst = F.struct(F.col("diff_tier").alias("d"), "metric")
    return deviations.groupBy("period", "entity").agg(
        F.min(best)["metric"].alias("strongest"),
        F.min(worst)["metric"].alias("weakest"),
        F.count_if(strength(F.col("diff_tier")) == "above").alias("n_above"),
        F.count_if(strength(F.col("diff_tier")) == "below").alias("n_below"),
    )


def direction(score: DataFrame, by: str = "entity") -> DataFrame:
    """First and last observed score of a range, and which way it went."""
    ends = score.groupBy(by).agg(
        F.min(F.struct("period", "score")).alias("a"), F.max(F.struct("period", "score")).alias("b")
    )
    return ends.select(
        by,
        F.col("a.period").alias("first_period"),
        F.col("b.period").alias("last_period"),
        F.col("a.score").alias("first_score"),
        F.col("b.score").alias("last_score"),
        F.when(F.col("b.score") > F.col("a.score"), "up")
        .when(F.col("b.score") < F.col("a.score"), "down")
        .otherwise("equal")
        .alias("direction"),
    )


def latest_periods(periods: DataFrame, n: int) -> DataFrame:
    """The most recent ``n`` periods of a one-column period frame (a top-n, so the limit is the feature)."""
    return periods.select("period").distinct().orderBy(F.desc("period")).limit(n)


def quarter_islands(periods: DataFrame) -> DataFrame:
    """Runs of consecutive quarters inside a year as labels ``2024Q1~Q4``."""
    q = periods.select("period").distinct().select(
        F.substring("period", 1, 4).alias("year"), F.substring("period", 6, 1).cast("int").alias("q")
    )
    runs = q.withColumn("run", F.col("q") - F.row_number().over(W.partitionBy("year").orderBy("q")))
    span = runs.groupBy("year", "run").agg(F.min("q").alias("a"), F.max("q").alias("b"))
    head = F.concat("year", F.lit("Q"), F.col("a").cast("string"))
    return span.select(
        F.when(F.col("a") == F.col("b"), head)
        .otherwise(F.concat(head, F.lit("~Q"), F.col("b").cast("string")))
        .alias("label"),
        (F.col("b") - F.col("a") + 1).alias("n_periods"),
    )


def year_end(periods: DataFrame) -> DataFrame:
    """For each year: the last observed period of the year before, and how many that year has."""
    ends = periods.select("period").distinct().groupBy(F.substring("period", 1, 4).cast("int").alias("y")).agg(
        F.max("period").alias("year_end"), F.count(F.lit(1)).alias("n_observed")
    )
    years = ends.select(F.col("y").alias("year"))
    return years.join(ends.withColumn("year", F.col("y") + 1), "year").select("year", "year_end", "n_observed")
