"""Ties, tie policies and the range-split numbering."""

from decimal import Decimal

from pyspark.sql import functions as F

from plumbline.operators import aggregate as A
from plumbline.operators import ranking as R
from plumbline.operators import topk as K

SCORES = [("2025Q4", e, Decimal(s)) for e, s in (("a", "4.28"), ("b", "4.27"), ("c", "4.25"), ("d", "4.25"), ("e", "4.23"))]


def frame(spark):
    return spark.createDataFrame(SCORES, "period string, entity string, score decimal(6,2)")


def test_tie_at_the_cut(spark):
    s = frame(spark)
    assert {r.entity for r in K.top_n(s, 3).collect()} == {"a", "b", "c"}
    assert {r.entity for r in K.top_n_with_ties(s, 3, ["period"]).collect()} == {"a", "b", "c", "d"}
    assert {r.entity for r in K.top_n_with_ties(s, 9, ["period"]).collect()} == set("abcde")


def test_rank_kinds(spark):
    got = {r.entity: (r.row_no, r.rnk, r.dense_rnk, r.tie_n, r.group_n) for r in R.rank_table(frame(spark)).collect()}
    assert got == {"a": (1, 1, 1, 1, 5), "b": (2, 2, 2, 1, 5), "c": (3, 3, 3, 2, 5), "d": (4, 3, 3, 2, 5), "e": (5, 5, 4, 1, 5)}


def test_split_numbering_equals_plain_numbering(spark):
    # one period holds nearly all rows and one score most of those
    df = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, "p1").otherwise("p2").alias("period"), F.format_string("e%05d", "id").alias("entity"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(7).cast("decimal(6,2)").alias("score"))
    plain = R.rank_table(df).select("period", "entity", "row_no")
    split = R.rank_table(df, tie_rows=100).select("period", "entity", "row_no")
    assert plain.exceptAll(split).count() == 0 and split.count() == 5000


def test_missing_quarters(spark):
    p = spark.createDataFrame([(x,) for x in ("2023Q3", "2024Q1", "2024Q2", "2024Q3", "2024Q4", "2025Q1", "2025Q3")], "period string")
    labels = sorted(r.label for r in R.quarter_islands(p).collect())
    assert labels == ["2023Q3", "2024Q1~Q4", "2025Q1", "2025Q3"]
    assert {(r.year, r.year_end) for r in R.year_end(p).collect()} == {(2024, "2023Q3"), (2025, "2024Q4")}


def test_weights_are_recovered(spark):
    rows = [(float(i), float((i * 7) % 11), float((i * 3) % 5), 0.5 * i + 0.3 * ((i * 7) % 11) + 0.2 * ((i * 3) % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y double, z double, score double")
    got = {r.metric: round(r.weight, 6) for r in A.constrained_weights(df, ["x", "y", "z"]).collect()}
    assert got == {"x": 0.5, "y": 0.3, "z": 0.2}


def test_wilson(spark):
    df = spark.createDataFrame([("g", i < 8) for i in range(10)], "by string, ok boolean")
    r = A.success_rates(df, "by").first()
    # z = 1.96: centre 0.99208 / 1.38416, half width 1.96 * sqrt(0.025604) / 1.38416
    centre, half = 0.99208 / 1.38416, 1.96 * 0.025604**0.5 / 1.38416
    assert (r.k, r.n, r.low, r.high, r.wide) == (8, 10, round(centre - half, 6), round(centre + half, 6), True)
