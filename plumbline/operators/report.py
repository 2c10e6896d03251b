"""The entity report: every (period, entity) at once, every number as {value, src, how}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.periods import CHUNK_ID
from plumbline.operators import ranking as R


def fact(value: Column, src: Column, how: str) -> Column:
    return F.struct(value.cast("double").alias("value"), src.alias("src"), F.lit(how).alias("how"))


def report_wide(score: DataFrame, metric_score: DataFrame, members: DataFrame) -> DataFrame:
    """One flat row per (period, entity): ranks, tier rank, tier mean, neighbours in time, metric extremes.

    Built from a fixed number of joins over aggregated tables; no query per entity.
    """
    placed = score.join(members, "entity")
    overall = R.rank_table(score).select("period", "entity", "row_no", F.col("group_n").alias("entity_n"), "tie_n")
    inside = R.rank_table(placed, ["period", "tier"]).select(
        "period", "entity", F.col("row_no").alias("tier_row_no"), F.col("group_n").alias("tier_n"))
    tier_mean = placed.groupBy("period", "tier").agg(F.round(R.exact_mean(), 2).alias("tier_mean"))
    moved = R.with_neighbours(score).select("period", "entity", "prev_period", "prev_score", "prev_source", "delta")
    metrics = R.extremes(R.with_deviations(metric_score, members))
    return (
        placed.join(overall, ["period", "entity"]).join(inside, ["period", "entity"]).join(tier_mean, ["period", "tier"])
        .join(moved, ["period", "entity"]).join(metrics, ["period", "entity"], "left")
        .withColumn("diff_tier", F.col("score") - F.col("tier_mean"))
    )


def report_records(score: DataFrame, metric_score: DataFrame, members: DataFrame) -> DataFrame:
    """The nested record. The metric list of one entity and period is bounded by the metric catalog."""
    wide = report_wide(score, metric_score, members)
    deviations = R.with_deviations(metric_score, members)
    lines = deviations.groupBy("period", "entity").agg(F.sort_array(F.collect_list(F.struct(
        "metric", fact(F.col("score"), F.col("source"), "table").alias("score"),
        fact(F.col("diff_all"), F.lit(None).cast("string"), "score - mean of all").alias("diff_all"),
        fact(F.col("diff_tier"), F.lit(None).cast("string"), "score - mean of the tier").alias("diff_tier"),
        R.strength(F.col("diff_tier")).alias("label")))).alias("metrics"))
    none = F.lit(None).cast("string")
    return wide.join(lines, ["period", "entity"], "left").select(
        "period", "entity", "tier",
        fact(F.col("score"), F.col("source"), "table").alias("score"),
        fact(F.col("row_no"), F.col("source"), "row number by score").alias("rank"),
        fact(F.col("entity_n"), none, "count of the period").alias("entity_n"),
        fact(F.col("tier_row_no"), none, "row number in the tier").alias("tier_rank"),
        fact(F.col("tier_mean"), none, "mean of the tier").alias("tier_mean"),
        fact(F.col("prev_score"), F.col("prev_source"), "table").alias("prev_score"),
        fact(F.col("delta"), none, "score - previous score").alias("delta"),
        "strongest", "weakest", "metrics",
    )


NAMED_FACTS = ("score", "rank", "entity_n", "tier_rank", "tier_mean", "prev_score", "delta")


def source_appendix(records: DataFrame) -> DataFrame:
    """(period, entity, label, value, src, how): every number of a report with where it came from."""
    named = [F.struct(F.lit(n).alias("label"), F.col(f"{n}.value").alias("value"), F.col(f"{n}.src").alias("src"), F.col(f"{n}.how").alias("how")) for n in NAMED_FACTS]
    metric = F.transform(F.coalesce("metrics", F.array().cast(dict(records.dtypes)["metrics"])), lambda m: F.struct(
        m["metric"].alias("label"), m["score"]["value"].alias("value"), m["score"]["src"].alias("src"), m["score"]["how"].alias("how")))
    return records.select("period", "entity", F.inline(F.concat(F.array(*named), metric))).filter(F.col("value").isNotNull())


def credibility(records: DataFrame) -> DataFrame:
    """Per report: numbers with a page, numbers derived, whether tier data is there, and the verdict."""
    lines = source_appendix(records)
    per = lines.groupBy("period", "entity").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col("src").rlike(CHUNK_ID), F.lit(False))).alias("sourced"),
        F.bool_or(F.col("label") == "tier_mean").alias("has_tier"),
    )
    return per.withColumn("derived", F.col("n") - F.col("sourced")).withColumn(
        "verdict", F.when(F.col("sourced") == F.col("n"), "fully sourced").when(F.col("sourced") > 0, "partly derived").otherwise("derived"))


def as_json(records: DataFrame) -> DataFrame:
    """One JSON text per report, for the report sink."""
    return records.select("period", "entity", F.to_json(F.struct(*records.columns)).alias("record"))
