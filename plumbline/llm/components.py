"""Connected components of a link table by alternating star operations; no component is ever gathered in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable


def connected(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link between different nodes; root is the smallest node of its component.

    Each round moves every node's larger neighbours, then its smaller ones, under the smallest neighbour (large-star, small-star). The rounds
    needed grow with the logarithm of the longest chain. Rounds are cut by checkpoints and end when the links no longer change.
    """
    pairs = links.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).filter("big <> small").distinct()
    pairs = durable(pairs)
    mark = None
    for _ in range(rounds):
        # Large-star: a node's larger neighbours go to the smallest of its neighbours and itself.
        both = pairs.union(pairs.select("small", "big")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.filter("v > u").join(least, "u").select(F.col("v").alias("big"), F.col("m").alias("small")).filter("big <> small").distinct()
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        low = big.groupBy("big").agg(F.min("small").alias("m"))
        pairs = (big.join(low, "big").filter("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
                 .union(low.select("big", F.col("m").alias("small"))).distinct())
        pairs = durable(pairs)
        now = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("big").alias("node"), F.col("small").alias("root")).union(pairs.select("small", "small").distinct().toDF("node", "root"))
