"""Summaries of runs, trials and retrieval results.

All of these are hash aggregates with partial sums on the map side; a category that
holds most of the rows reaches its reducer as one row per map task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import WIDE, ratio, wilson


def span_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first).otherwise(F.concat(first, F.lit("~"), last))


def scored_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of a scored run; the mean covers judgeable rows only, the rest is counted apart."""
    judged = ~F.col("unjudgeable")
    full = judged & (F.col("score") >= 1)
    grouped = scored.groupBy(*by) if by else scored.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("route_ok").alias("route_ok"),
        F.count_if(full).alias("full_marks"),
        F.count_if("unjudgeable").alias("unjudgeable"),
        F.count_if(F.col("route_ok") & full).alias("both_ok"),
        F.round(F.avg(F.when(judged, F.col("score"))), 6).alias("mean_score"),
    )


def alarm_rates(scored: DataFrame) -> DataFrame:
    """Alarm rate among wrong and false-alarm rate among right rows, per route and in total.

    A wrong row counts as alarmed by a warning or a trace, a right row by a warning only.
    """
    right = F.col("score") >= 1
    warned = F.col("n_warnings") > 0
    rows = scored.filter(~F.col("unjudgeable")).select(
        right.alias("correct"), "route", F.when(right, warned).otherwise(warned | (F.col("n_trace") > 0)).alias("alarm")
    )
    return (
        rows.rollup("correct", "route")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("alarm").alias("alarms"), F.grouping_id().alias("level"))
        .filter("level < 3")
        .select("correct", F.coalesce("route", F.lit("(all)")).alias("route"), "n", "alarms", (F.col("alarms") / F.col("n")).alias("rate"))
    )


def confusion(run: DataFrame, routes: list[str]) -> DataFrame:
    """Expected by given route; the columns are fixed, so no pass is spent finding them."""
    return run.groupBy("expected_route").pivot("route", routes).count().na.fill(0)


def two_by_two(run: DataFrame, a: Column, b: Column) -> DataFrame:
    """Both / only A / only B / neither with margins."""
    return (
        run.select(a.alias("a"), b.alias("b")).cube("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    )


def alarm_outcomes(run: DataFrame) -> DataFrame:
    """Right / silent / false alarm / voiced, with accuracy and the recall and precision of the alarms."""
    spoke = (F.col("n_warnings") > 0) | F.col("route").isin("refuse", "search_0")
    hit = F.array_contains("sources", F.col("expected_page"))
    counts = run.select(spoke.alias("s"), hit.alias("h")).agg(
        F.count_if(~F.col("s") & F.col("h")).alias("right"),
        F.count_if(~F.col("s") & ~F.col("h")).alias("silent"),
        F.count_if(F.col("s") & F.col("h")).alias("false_alarm"),
        F.count_if(F.col("s") & ~F.col("h")).alias("voiced"),
    )
    c = F.col
    return counts.select(
        "*",
        ratio(c("right"), c("right") + c("silent") + c("false_alarm") + c("voiced")).alias("accuracy"),
        ratio(c("voiced"), c("silent") + c("voiced")).alias("alarm_recall"),
        ratio(c("voiced"), c("voiced") + c("false_alarm")).alias("alarm_precision"),
    )


def stability(trial: DataFrame, item: str = "question_id") -> DataFrame:
    """Repeated trials of an item: always right, always wrong, or swinging."""
    per = trial.groupBy(item).agg(
        F.bool_and("ok").alias("all_ok"), F.bool_or("ok").alias("any_ok"), F.count(F.lit(1)).alias("n")
    )
    label = F.when(F.col("all_ok"), "always_right").when(~F.col("any_ok"), "always_wrong").otherwise("swinging")
    return per.groupBy(label.alias("stability")).agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("trials"))


def contamination(run: DataFrame) -> DataFrame:
    """Returned sources outside the asked period, per category and in total."""
    outside = F.size(F.filter("sources", lambda s: ~s.startswith(F.col("period"))))
    return (
        run.select("category", F.size("sources").alias("k"), outside.alias("out"))
        .rollup("category")
        .agg(F.sum("k").alias("returned"), F.sum("out").alias("outside"), F.count_if(F.col("out") > 0).alias("questions"))
        .select(F.coalesce("category", F.lit("(all)")).alias("category"), "returned", "outside", "questions",
                (F.col("outside") / F.col("returned")).alias("rate"))
    )


def list_sizes(results: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits and result-list sizes per strategy. A query without results counts with size 0.

    results(strategy, query_id, id, rank); expected(query_id, id); queries(query_id).
    """
    marked = results.join(expected.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    per = marked.groupBy("strategy", "query_id").agg(F.count(F.lit(1)).alias("size"), F.max("_hit").alias("hit"))
    total = queries.agg(F.count(F.lit(1)).alias("queries"))
    sums = per.groupBy("strategy").agg(
        F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.sum("size").alias("returned"), F.max("size").alias("max_size")
    )
    return sums.join(F.broadcast(total)).select(  # one row
        "strategy", "queries", "hits", (F.col("returned") / F.col("queries")).alias("avg_size"), "max_size"
    )


def success_rates(trial: DataFrame, by: str) -> DataFrame:
    """Success rate with the Wilson interval and a flag for intervals too wide to read."""
    sums = trial.groupBy(by).agg(F.count_if("ok").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return sums.select(by, "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), (high - low > WIDE).alias("wide"))


def position_gap(trial: DataFrame, item: Column, early: int, late: int) -> DataFrame:
    """Success rate per item at two positions and their difference; NULL where a position was not tried."""
    def rate(p):
        return F.avg(F.when(F.col("position") == p, F.col("ok").cast("int")))
    return trial.groupBy(item.alias("item")).agg(rate(early).alias("early"), rate(late).alias("late")).withColumn(
        "gap", F.col("early") - F.col("late")
    )


def accountability(facts: DataFrame) -> DataFrame:
    """Per section: how many numbers there are, how many reach a page, and the verdict."""
    sums = facts.groupBy("section").agg(
        F.count_if(F.col("value").isNotNull()).alias("got"),
        F.count_if(F.col("value").isNotNull() & (F.col("level") == "page")).alias("to_page"),
        F.count_if("warned").alias("warned"),
    )
    return sums.withColumn(
        "verdict",
        F.when(F.col("got") == 0, "missing").when(F.col("warned") > 0, "warned")
        .when(F.col("to_page") == F.col("got"), "verifiable").otherwise("partly"),
    )


def usage(calls: DataFrame, by: str) -> DataFrame:
    """Calls, tokens and characters of a call log, with a total row."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return (
        calls.select(by, F.when(F.trim("text") == "", 0).otherwise(words).alias("w"), F.length("text").alias("c"))
        .rollup(by)
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("w").alias("tokens"), F.sum("c").alias("chars"))
        .withColumn(by, F.coalesce(by, F.lit("(all)")))
    )


def constrained_weights(wide: DataFrame, metrics: list[str], target: str = "score") -> DataFrame:
    """Least squares with weights that sum to 1 and no intercept.

    One distributed pass sums the cross products of the reduced design (a k x k matrix);
    only those sums reach the driver, which solves a system as large as the metric list.
    A second pass takes the largest residual.
    """
    last, rest = metrics[-1], metrics[:-1]
    d = [F.col(f"`{m}`").cast("double") - F.col(f"`{last}`").cast("double") for m in rest]
    y = F.col(target).cast("double") - F.col(f"`{last}`").cast("double")
    cols = [*d, y]
    k = len(rest)
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    row = wide.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    gram = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], dtype=float)
    a, b, yy, n = gram[:k, :k], gram[:k, k], gram[k, k], row["n"]
    w = np.linalg.solve(a, b)
    rss = max(float(yy - w @ b), 0.0)
    cov = np.linalg.inv(a) * (rss / (n - k))
    se = np.append(np.sqrt(np.diag(cov)), np.sqrt(cov.sum()))
    weights = np.append(w, 1 - w.sum())
    predicted = sum((F.col(f"`{m}`").cast("double") * float(v) for m, v in zip(metrics, weights)), F.lit(0.0))
    worst = wide.agg(F.max(F.abs(F.col(target).cast("double") - predicted)).alias("r")).first()["r"]
    cond = float(np.sqrt(np.linalg.cond(a)))
    rows = [(m, float(v), float(s), int(n), float(worst), cond) for m, v, s in zip(metrics, weights, se)]
    return wide.sparkSession.createDataFrame(
        rows, "metric string, weight double, std_error double, n long, max_residual double, condition double"
    )
