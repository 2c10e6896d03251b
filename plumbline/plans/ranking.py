"""Rank, window, top-k and report plans over the score views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import ranking as R
from plumbline.operators import topk as K
from plumbline.plans.oracle import half_up, oracle
from plumbline.plans.registry import plan
from plumbline.sources import views as V


def dbl(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


@plan("win_rank_view", oracle("ranked", """
    SELECT period, entity, score, row_no, rnk, dense_rnk, entity_n, tie_n FROM ranked"""))
def win_rank_view(t):
    """WIN-1/2/7: the ranking view with all three rank kinds and the group size."""
    return R.rank_table(V.score(t)).select(
        "period", "entity", *dbl("score"), "row_no", "rnk", "dense_rnk", F.col("group_n").alias("entity_n"), "tie_n")


@plan("win_version_changes", oracle("period_meta_d", """
    SELECT period, basis_version, lag(basis_version) OVER (ORDER BY period) AS prev_version,
           coalesce(lag(basis_version) OVER (ORDER BY period) <> basis_version, false) AS changed
    FROM period_meta_d"""))
def win_version_changes(t):
    """WIN-3: basis version against the previous period."""
    return R.version_changes(V.period_meta_d(t))


@plan("win_version_changes_q", oracle("period_meta_q", """
    SELECT period, basis_version, lag(basis_version) OVER (ORDER BY period) AS prev_version,
           coalesce(lag(basis_version) OVER (ORDER BY period) <> basis_version, false) AS changed
    FROM period_meta_q"""))
def win_version_changes_q(t):
    return R.version_changes(V.period_meta_q(t))


@plan("win_tie_report", oracle("ranked", """
    SELECT a.period, a.entity, a.score, a.tie_n,
           array_to_string(list_slice(list_sort(list(b.entity)), 1, 2), '/') AS others
    FROM ranked a JOIN ranked b ON a.period = b.period AND a.h = b.h AND a.entity <> b.entity
    WHERE a.tie_n > 1 GROUP BY 1, 2, 3, 4"""))
def win_tie_report(t):
    """WIN-4: who shares a score, at most two names shown."""
    return R.tie_report(V.score(t)).select("period", "entity", *dbl("score"), "tie_n", "others")


@plan("win_neighbours", oracle("score", """
    SELECT period, entity, score, lag(period) OVER w AS prev_period, lag(score) OVER w AS prev_score,
           lead(period) OVER w AS next_period, (h - lag(h) OVER w) / 100.0 AS delta
    FROM score WINDOW w AS (PARTITION BY entity ORDER BY period)"""))
def win_neighbours(t):
    """WIN-5: previous and next observed period, score change."""
    return R.with_neighbours(V.score(t)).select(
        "period", "entity", *dbl("score"), "prev_period", *dbl("prev_score"), "next_period", *dbl("delta"))


@plan("win_tier_rank", oracle("tier", """
    SELECT period, tier, entity, score_d AS score,
           row_number() OVER (PARTITION BY period, tier ORDER BY h DESC, entity) AS row_no,
           rank() OVER (PARTITION BY period, tier ORDER BY h DESC) AS rnk,
           count(*) OVER (PARTITION BY period, tier) AS tier_n
    FROM (SELECT *, h / 100.0 AS score_d FROM tier)"""))
def win_tier_rank(t):
    """WIN-6: rank within the tier, tier size."""
    placed = V.score(t).join(V.members(t), "entity")
    return R.rank_table(placed, ["period", "tier"]).select(
        "period", "tier", "entity", *dbl("score"), "row_no", "rnk", F.col("group_n").alias("tier_n"))


DEV = f"""
    SELECT *, {half_up('h * n_all - s_all', 'n_all')} AS d_all, {half_up('h * n_tier - s_tier', 'n_tier')} AS d_tier,
           {half_up('s_tier', 'n_tier')} AS mean_tier
    FROM (SELECT m.*, tier, CAST(sum(h) OVER a AS BIGINT) AS s_all, count(*) OVER a AS n_all,
                 CAST(sum(h) OVER b AS BIGINT) AS s_tier, count(*) OVER b AS n_tier
          FROM metric_score m JOIN members USING (entity)
          WINDOW a AS (PARTITION BY period, metric), b AS (PARTITION BY period, metric, tier))"""


@plan("win_deviations", oracle("metric_score members", """
    SELECT period, metric, entity, tier, score, d_all / 100.0 AS diff_all, d_tier / 100.0 AS diff_tier,
           mean_tier / 100.0 AS tier_mean FROM dev""", dev=DEV))
def win_deviations(t):
    """WIN-8: deviation from the overall mean and from the tier mean."""
    return R.with_deviations(V.metric_score(t), V.members(t)).select(
        "period", "metric", "entity", "tier", *dbl("score", "diff_all", "diff_tier", "tier_mean"))


@plan("win_strength", oracle("metric_score members", """
    SELECT period, entity, first(metric ORDER BY d_tier DESC, metric) AS strongest,
           first(metric ORDER BY d_tier, metric) AS weakest,
           count(*) FILTER (d_tier > 0) AS n_above, count(*) FILTER (d_tier < 0) AS n_below
    FROM dev GROUP BY 1, 2""", dev=DEV))
def win_strength(t):
    """WIN-9: strongest and weakest metric with the dead band."""
    return R.extremes(R.with_deviations(V.metric_score(t), V.members(t)))


@plan("win_strength_labels", oracle("metric_score members", """
    SELECT period, metric, entity, CASE WHEN d_tier = 0 THEN 'level' WHEN d_tier > 0 THEN 'above' ELSE 'below' END
           AS label FROM dev""", dev=DEV))
def win_strength_labels(t):
    d = R.with_deviations(V.metric_score(t), V.members(t))
    return d.select("period", "metric", "entity", R.strength(F.col("diff_tier")).alias("label"))


@plan("win_quarter_islands", oracle("", """
    WITH p AS (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders),
         g AS (SELECT y, q, q - row_number() OVER (PARTITION BY y ORDER BY q) AS run FROM p)
    SELECT CASE WHEN min(q) = max(q) THEN concat(y, 'Q', min(q)) ELSE concat(y, 'Q', min(q), '~Q', max(q)) END AS label,
           max(q) - min(q) + 1 AS n_periods FROM g GROUP BY y, run"""))
def win_quarter_islands(t):
    """WIN-10: consecutive quarters of a year as range labels."""
    return R.quarter_islands(t.orders.select(V.period_of(F.col("o_orderdate")).alias("period")))


@plan("win_quarter_islands_large_orders", oracle("", """
    WITH p AS (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders
               WHERE o_totalprice > (SELECT max(o_totalprice) * 0.999 FROM orders)),
         g AS (SELECT y, q, q - row_number() OVER (PARTITION BY y ORDER BY q) AS run FROM p)
    SELECT CASE WHEN min(q) = max(q) THEN concat(y, 'Q', min(q)) ELSE concat(y, 'Q', min(q), '~Q', max(q)) END AS label,
           max(q) - min(q) + 1 AS n_periods FROM g GROUP BY y, run"""))
def win_quarter_islands_large_orders(t):
    """WIN-10 on a period set with gaps: the quarters that hold one of the largest orders."""
    bound = t.orders.agg((F.max("o_totalprice") * 0.999).alias("b"))
    big = t.orders.join(F.broadcast(bound), F.col("o_totalprice") > F.col("b"))  # one row
    return R.quarter_islands(big.select(V.period_of(F.col("o_orderdate")).alias("period")))


@plan("win_latest_periods", oracle("score", """
    SELECT period, count(*) AS n, max(score) AS best FROM score
    WHERE period IN (SELECT DISTINCT period FROM score ORDER BY period DESC LIMIT 3) GROUP BY 1"""))
def win_latest_periods(t):
    """WIN-11: the most recent three periods."""
    s = V.score(t)
    return s.join(R.latest_periods(s, 3), "period", "left_semi").groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").cast("double").alias("best"))


@plan("win_year_end", oracle("score", """
    SELECT a.y AS year, b.year_end, b.n_observed FROM e a JOIN e b ON b.y = a.y - 1""",
    e="""SELECT CAST(period[1:4] AS INT) AS y, max(period) AS year_end, count(DISTINCT period) AS n_observed
         FROM score GROUP BY 1"""))
def win_year_end(t):
    """WIN-13: last observed period of the previous year."""
    return R.year_end(V.score(t))


@plan("win_direction", oracle("score", """
    SELECT entity, min(period) AS first_period, max(period) AS last_period, arg_min(score, period) AS first_score,
           arg_max(score, period) AS last_score,
           CASE WHEN arg_max(h, period) > arg_min(h, period) THEN 'up'
                WHEN arg_max(h, period) < arg_min(h, period) THEN 'down' ELSE 'equal' END AS direction
    FROM score GROUP BY 1"""))
def win_direction(t):
    """WIN-14: first against last observed period."""
    return R.direction(V.score(t)).select("entity", "first_period", "last_period",
                                          *dbl("first_score", "last_score"), "direction")


@plan("top_n_cut", oracle("ranked", "SELECT period, entity, score, row_no FROM ranked WHERE row_no <= 5"))
def top_n_cut(t):
    """TOP-1: first five by rank, ties cut."""
    return K.top_n(V.score(t), 5).select("period", "entity", *dbl("score"), "row_no")


@plan("top_bottom_ties", oracle("score", """
    SELECT period, entity, score FROM (SELECT *, rank() OVER (PARTITION BY period ORDER BY h) AS r FROM score)
    WHERE r = 1"""))
def top_bottom_ties(t):
    """TOP-2: everyone at the minimum."""
    return K.extreme_with_ties(V.score(t)).select("period", "entity", *dbl("score"))


@plan("top_direction_aware", oracle("metric_score", """
    SELECT m.period, m.metric, m.entity, m.score, a.worst, m.row_no FROM (
      SELECT *, false AS worst, row_number() OVER (PARTITION BY period, metric ORDER BY h DESC, entity) AS row_no
      FROM metric_score UNION ALL
      SELECT *, true AS worst, row_number() OVER (PARTITION BY period, metric ORDER BY h, entity) AS row_no
      FROM metric_score) m JOIN asks a ON m.period = a.period AND m.metric = a.metric AND m.worst = a.worst
    WHERE m.row_no <= 5""",
    asks="""SELECT period, metric, sum(n) % 2 = 0 AS worst FROM cells GROUP BY 1, 2"""))
def top_direction_aware(t):
    """TOP-3: best or worst five as the ask says."""
    asks = V.cells(t).groupBy("period", "metric").agg((F.sum("n") % 2 == 0).alias("worst"))
    return K.direction_aware(V.metric_score(t), asks).select(
        "period", "metric", "entity", *dbl("score"), "worst", "row_no")


@plan("top_n_ties_in_tier", oracle("tier", """
    SELECT period, tier, entity, h / 100.0 AS score FROM (
      SELECT *, min(h) FILTER (rn <= 3) OVER (PARTITION BY period, tier) AS cut FROM (
        SELECT *, row_number() OVER (PARTITION BY period, tier ORDER BY h DESC, entity) AS rn FROM tier))
    WHERE h >= cut"""))
def top_n_ties_in_tier(t):
    """TOP-4: top three of each tier with the ties at the cut."""
    placed = V.score(t).join(V.members(t), "entity")
    return K.top_n_with_ties(placed, 3, ["period", "tier"]).select("period", "tier", "entity", *dbl("score"))


@plan("top_sorted_scores", oracle("score", "SELECT period, entity, score FROM score ORDER BY period, h DESC, entity"))
def top_sorted_scores(t):
    """TOP-5: period ascending, score descending."""
    return V.score(t).orderBy("period", F.desc("score"), "entity").select("period", "entity", *dbl("score"))
