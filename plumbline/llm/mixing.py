"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key -ln(u) / weight, u from a hash of the document, so documents of higher quality tend to come
first and reruns agree. Targets are filled from their source: complete epochs first, then documents in key order while their
prefix sum of sizes stays within the remainder. The document that crosses the remainder gives the words that are still missing.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in order; a source without words has
target 0; equal keys are ordered by doc_id and row, so repeated rows are taken one by one; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import durable, hex_long, prefix_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """A weight from 0.1 to 1: the share of characters that are not ASCII punctuation, squared. 0.1 for texts without characters."""
    n = F.length(text)
    bare = F.length(F.translate(F.col(text), "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", ""))
    share = F.when(n > 0, bare / n).otherwise(F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.1), F.round(share * share, 6)), F.lit(0.1))


def uniform(key: Column, text: Column) -> Column:
    """A number in (0, 1] from md5 of the seed, the key and the text; 52 bits."""
    said = F.concat_ws(":", F.lit(SEED), F.coalesce(key.cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null")))
    return (hex_long(F.md5(said)) + 1) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> target: shares of all words by cycled weights, capped at ``most`` epochs, the excess shared again.

    The repeated sharing ends at the level where the sum is used up. Sources fill up in order of cap / weight, so that level is read off
    running sums. The table has one row per source, an aggregate.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sources.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    w = (w.withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("level", (F.sum("source_size").over(everything) - F.col("full")) / F.col("open")))
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    # Past the first source that stays open the running level only falls, so the largest one counts.
    # No source open means that every cap is used in full (only when the cap is one epoch or nothing has words).
    return w.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "weight", "source_size", "target")


def _plan(documents: DataFrame, key: str, text: str, source: str, weight: Column | None, weights: tuple[int, ...]):
    """The documents with their sampling columns, the thin rows with the words ahead of each, and one row per source."""
    w = quality_weight(text) if weight is None else weight
    drawn = documents.withColumns({
        "_size": word_count(text), "_draw": -F.ln(uniform(F.col(key), F.col(text))) / w, "_row": F.monotonically_increasing_id()})
    thin = durable(drawn.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col("_size").alias("size"),
                                F.col("_draw").alias("sample_key"), F.col("_row").alias("row")))
    sources = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = targets(sources, weights).withColumn("epochs", epochs)
    goals = durable(goals.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    placed = prefix_sums(thin, ["source"], ["sample_key", "key", "row"], "size", "ahead")
    return drawn, placed, goals.withColumnRenamed("source", "_source")


def mix_sources(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """key, source, size, source_size, target, taken, sample_key of every row; ``weight`` is the quality weight of a document, above 0."""
    _, placed, goals = _plan(documents, key, text, source, weight, weights)
    rows = placed.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return rows.select(F.col("key").alias(key), "source", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "sample_key")


# Up to so many sources travel to every task in one small table; more are joined by a shuffle.
FEW_SOURCES = 10_000


def mixed_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each document once per epoch and once more if the fraction reaches it; the columns of ``documents``.

    Whole texts only: the document that crosses the budget of its source is taken whole. The last document taken of each source tells
    the others whether they are in, so texts are not shuffled.
    """
    drawn, placed, goals = _plan(documents, key, text, source, weight, weights)
    reach = F.max(F.when((F.col("ahead") < F.col("rest")) & (F.col("size") > 0), F.struct("sample_key", "key", "row")))
    last = placed.join(goals, F.col("source").eqNullSafe(F.col("_source"))).groupBy("_source", "epochs").agg(reach.alias("_last"))
    last = durable(last)
    last = F.broadcast(last) if last.count() <= FEW_SOURCES else last
    within = F.coalesce(F.struct(F.col("_draw").alias("sample_key"), F.col(key).alias("key"), F.col("_row").alias("row")) <= F.col("_last"), F.lit(False))
    copies = F.when(F.col("_size") > 0, F.col("epochs") + within.cast("long")).otherwise(F.lit(0))
    rows = drawn.join(last, F.col(source).eqNullSafe(F.col("_source"))).withColumn("_copies", copies.cast("int")).filter("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*[drawn[c] for c in documents.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         length(text) AS n, length(translate(text, '!"#$%&''()*+-/:;<=>?@[\]^_`{|}~', '')) AS bare
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE)
         / coalesce(greatest(0.1, round(CASE WHEN n > 0 THEN (bare / n) * (bare / n) ELSE 0 END, 6)), 0.1) AS sample_key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM s
), g AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), t AS (
  SELECT source, source_size, least(cap, coalesce((max(CASE WHEN ratio > level THEN level END) OVER ()) * weight, cap)) AS target FROM g
), r AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY sample_key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - ahead)))::BIGINT AS taken
FROM r
"""
