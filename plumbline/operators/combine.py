"""Joins and set operations that the reports and retrieval legs share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import let


def both_ways(a: DataFrame, b: DataFrame, left: str = "only_left", right: str = "only_right") -> DataFrame:
    """Multiset difference in both directions with a ``side`` column."""
    return a.exceptAll(b).withColumn("side", F.lit(left)).unionByName(b.exceptAll(a).withColumn("side", F.lit(right)))


def peer_means(metric_score: DataFrame, members: DataFrame) -> DataFrame:
    """Mean of the peers of every entity for every metric, self included."""
    placed = metric_score.join(members, "entity")
    means = placed.groupBy("period", "metric", "tier").agg(
        (F.sum("score") / F.count(F.lit(1))).alias("m"), F.count(F.lit(1)).alias("n_peers")
    )
    return placed.join(means, ["period", "metric", "tier"]).select(
        "period", "metric", "entity", "tier", "score", F.round("m", 3).alias("peer_mean"), "n_peers"
    )


def nearest_preceding(events: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """As-of by position: each mention takes the last ``events`` row of its text that starts before it.

    ``events(key, pos, value)`` and ``mentions(key, pos, name)`` are merged and carried forward in
    one pass per text. If any mention of a text finds none, all of that text's values become NULL.
    """
    merged = events.select(key, "pos", F.col("value"), F.lit(None).cast("string").alias("name")).unionByName(
        mentions.select(key, "pos", F.lit(None).cast("string").alias("value"), "name")
    )
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    carried = merged.withColumn("value", F.last("value", ignorenulls=True).over(w)).filter(F.col("name").isNotNull())
    whole = carried.groupBy(key).agg(F.bool_and(F.col("value").isNotNull()).alias("_whole"))
    return carried.join(whole, key).select(
        key, "name", "pos", F.when(F.col("_whole"), F.col("value")).alias("value")
    )


def explain_differences(rows: DataFrame, missing: str, have: str) -> DataFrame:
    """For each number of ``missing``, the first pair of ``have`` whose difference it is.

    No pairs are formed: the low ends of a difference ``d`` are the numbers that stay in the set
    when the whole set is shifted down by ``d``, one hash intersection per missing number.
    """
    money = "decimal(38,2)"
    nums = F.array_sort(F.array_distinct(F.filter(F.transform(F.col(have), lambda x: x.try_cast(money)), lambda x: x.isNotNull())))

    def pair(m, nums):
        d = m.try_cast(money)  # a number too long for money is no difference of two
        low = F.array_intersect(nums, F.transform(nums, lambda a: (a - d).try_cast(money)))
        return F.struct(m.alias("number"), F.when(d > 0, F.get(low, F.lit(0))).alias("low"))

    ones = rows.withColumn("_d", let(nums, lambda known: F.transform(F.col(missing), lambda m: pair(m, known))))
    plain = lambda x: F.regexp_replace(x.cast("string"), r"\.?0+$", "")
    return ones.withColumn(
        "derived",
        F.transform(
            F.filter("_d", lambda s: s["low"].isNotNull()),
            lambda s: F.concat(
                s["number"], F.lit("="), plain((s["low"] + s["number"].cast(money)).cast(money)),
                F.lit("-"), plain(s["low"]),
            ),
        ),
    ).withColumn("still_missing", F.transform(F.filter("_d", lambda s: s["low"].isNull()), lambda s: s["number"])).drop("_d")


def _lists(*legs: DataFrame) -> list[DataFrame]:
    return [leg.select("query_id", "id", "rank") for leg in legs]


def fill(keyword: DataFrame, vector: DataFrame, k: int = 5) -> DataFrame:
    """Keyword hits first; the vector leg fills the empty slots up to ``k``. Legs: (query_id, id, rank)."""
    keyword, vector = _lists(keyword, vector)
    both = keyword.withColumn("leg", F.lit(0)).unionByName(vector.withColumn("leg", F.lit(1)))
    first = both.groupBy("query_id", "id").agg(F.min(F.struct("leg", "rank")).alias("o"))
    w = W.partitionBy("query_id").orderBy("o.leg", "o.rank")
    return first.select("query_id", "id", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


def intersect(keyword: DataFrame, vector: DataFrame, k: int = 5) -> DataFrame:
    """Ids in both legs, in keyword order, up to ``k``."""
    common = keyword.join(vector.select("query_id", "id"), ["query_id", "id"], "left_semi")
    w = W.partitionBy("query_id").orderBy("rank")
    return common.select("query_id", "id", F.row_number().over(w).alias("n")).filter(F.col("n") <= k).withColumnRenamed("n", "rank")


def union_top(keyword: DataFrame, vector: DataFrame, k: int = 5) -> DataFrame:
    """Both top-k lists, duplicates once: at most 2k ids."""
    keyword, vector = _lists(keyword, vector)
    both = keyword.filter(F.col("rank") <= k).withColumn("leg", F.lit(0)).unionByName(
        vector.filter(F.col("rank") <= k).withColumn("leg", F.lit(1))
    )
    first = both.groupBy("query_id", "id").agg(F.min(F.struct("leg", "rank")).alias("o"))
    w = W.partitionBy("query_id").orderBy("o.leg", "o.rank")
    return first.select("query_id", "id", F.row_number().over(w).alias("rank"))


def keyword_only(keyword: DataFrame, vector: DataFrame, k: int = 5) -> DataFrame:
    return keyword.filter(F.col("rank") <= k)


# Merge strategies by name, all with the same signature.
STRATEGIES = {"keyword": keyword_only, "fill": fill, "intersect": intersect, "union": union_top}


def version_specific(values: DataFrame, group: list[str], version: str, value: str) -> DataFrame:
    """Values that occur in some versions of a group but not in all of them."""
    pairs = values.select(*group, version, value).distinct()
    n_versions = values.groupBy(*group).agg(F.countDistinct(version).alias("n_versions"))
    seen = pairs.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n_seen"))
    return seen.join(n_versions, group).filter(F.col("n_seen") < F.col("n_versions"))
