"""Constraints as violation rows ``(rule, table, key, detail)``; nothing is raised, everything is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.periods import CHUNK_ID
from plumbline.operators.lookup import value_set

MEAN_TOLERANCE = 0.005  # fixed values
BOUND_TOLERANCE = 1e-9


def _rows(df: DataFrame, rule: str, table: str, key: list[str] | Column, detail: Column) -> DataFrame:
    k = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in key]) if isinstance(key, list) else key
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table"), k.alias("key"), detail.cast("string").alias("detail"))


def unique(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """Counts per key are summed on the map side, so a key repeated everywhere is one row per task."""
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _rows(twice, "unique", table, key, F.col("_n"))


def foreign_key(df: DataFrame, table: str, key: list[str], parent: DataFrame) -> DataFrame:
    """Orphans, one row per missing parent key with its number of children."""
    lost = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).join(parent.select(*key).distinct(), key, "left_anti")
    return _rows(lost, "foreign_key", table, key, F.col("_n"))


def not_null(df: DataFrame, table: str, key: list[str], columns: list[str]) -> DataFrame:
    names = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return _rows(df.withColumn("_nulls", names).filter("_nulls <> ''"), "not_null", table, key, F.col("_nulls"))


def check(df: DataFrame, rule: str, table: str, key: list[str], condition: Column, detail: Column) -> DataFrame:
    """Rows where the condition is false. NULL passes, as in a SQL CHECK."""
    return _rows(df.filter(~F.coalesce(condition, F.lit(True))), rule, table, key, detail)


def positive(df: DataFrame, table: str, key: list[str], column: str) -> DataFrame:
    return check(df, "positive", table, key, F.col(column) > 0, F.col(column))


def one_of(df: DataFrame, table: str, key: list[str], column: str, allowed: list[str]) -> DataFrame:
    return check(df, "one_of", table, key, F.col(column).isin(allowed), F.col(column))


def version_parts(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """``basis_version`` is its two counts joined by a plus sign."""
    return check(df, "version_parts", table, key, F.col("basis_version") == F.concat_ws("+", "l1_n", "l2_n"), F.col("basis_version"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attack(cases: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Negative cases: illegal rows must be rejected.

    Each case is (bad rows, violations found). No bad rows at all means that the case itself is broken.
    """
    out = None
    for name, (bad, found) in cases.items():
        counts = bad.agg(F.count(F.lit(1)).alias("n_bad")).join(
            F.broadcast(found.select("key").distinct().agg(F.count(F.lit(1)).alias("n_found"))))  # one row each
        part = counts.select(
            F.lit(name).alias("case"), "n_bad", "n_found",
            F.when(F.col("n_bad") == 0, "broken").when(F.col("n_found") == 0, "gap").otherwise("rejected").alias("outcome"))
        out = part if out is None else out.unionByName(part)
    return out


def row_counts(source: dict[str, DataFrame], loaded: dict[str, DataFrame]) -> DataFrame:
    """Rows in the source against rows in the loaded table."""
    def counts(tables, name):
        return union_all([df.agg(F.count(F.lit(1)).alias(name)).withColumn("table", F.lit(t)) for t, df in tables.items()])
    both = counts(source, "n_source").join(counts(loaded, "n_loaded"), "table", "full_outer")
    return both.withColumn("same", F.col("n_source").eqNullSafe(F.col("n_loaded")))


def pair_checks(lists: DataFrame) -> DataFrame:
    """Name and score lists of a page: equal length, scores not rising, stated mean within tolerance.

    ``lists(key, names array, scores array<decimal>, stated)``; the mean check needs a stated mean.
    """
    scores = F.col("scores")
    mean = F.round(F.aggregate(scores, F.lit(0).cast("decimal(38,4)"), lambda a, x: (a + x).cast("decimal(38,4)")) / F.size(scores), 2)
    problem = (
        F.when(F.size(scores) == 0, "no scores")
        .when(F.size("names") != F.size(scores), "lengths differ")
        .when(F.reverse(F.array_sort(scores)) != scores, "not descending")
        .when(F.col("stated").isNotNull() & (F.abs(mean - F.col("stated")) >= MEAN_TOLERANCE), "mean differs")
        .otherwise("ok")
    )
    return lists.select("key", F.size("names").alias("n_names"), F.size("scores").alias("n_scores"), problem.alias("verdict"))


def cardinality(df: DataFrame, table: str, by: list[str], allowed: list[int]) -> DataFrame:
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return _rows(sizes.filter(~F.col("_n").isin(allowed)), "cardinality", table, by, F.col("_n"))


def same_entities(a: DataFrame, b: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Entities that only one of two tables has."""
    x = a.select(*by).distinct().withColumn("_a", F.lit(True))
    y = b.select(*by).distinct().withColumn("_b", F.lit(True))
    one = x.join(y, by, "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return _rows(one, "same_entities", f"{left}/{right}", by, F.when(F.col("_a").isNull(), f"only {right}").otherwise(f"only {left}"))


def within_components(score: DataFrame, metric_score: DataFrame) -> DataFrame:
    """Headline scores outside the range of their components. A report, not a failure."""
    bounds = metric_score.groupBy("period", "entity").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    return score.join(bounds, ["period", "entity"]).filter(
        (F.col("score") < F.col("low") - BOUND_TOLERANCE) | (F.col("score") > F.col("high") + BOUND_TOLERANCE)
    )


def stated_counts(meta: DataFrame, rows: DataFrame, stated: str = "entity_n") -> DataFrame:
    """A stated count against counted rows; a missing period is not a mismatch."""
    counted = rows.groupBy("period").agg(F.count(F.lit(1)).alias("actual"))
    return meta.select("period", F.col(stated).cast("bigint").alias("stated")).join(counted, "period", "left").withColumn(
        "status", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("stated"), "mismatch").otherwise("ok"))


def text_versions(found: DataFrame, meta: DataFrame) -> DataFrame:
    """Versions read from text against the table: exactly one per period, and equal. ``found(period, version)``."""
    per = found.filter(F.col("version").isNotNull()).groupBy("period").agg(
        F.countDistinct("version").alias("n"), F.min("version").alias("text_version"))
    return meta.select("period", "basis_version").join(per, "period", "left").select(
        "period", "basis_version", "text_version", F.coalesce("n", F.lit(0)).alias("n_versions"),
        F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "conflict")
        .when(F.col("text_version") == F.col("basis_version"), "ok").otherwise("mismatch").alias("status"))


def partition_check(entities: DataFrame, placed: DataFrame) -> DataFrame:
    """Every entity in exactly one tier, none missing, none unknown. Both by (period, entity)."""
    keys = ["period", "entity"]
    per = placed.groupBy(*keys).agg(F.countDistinct("tier").alias("n"))
    known = entities.select(*keys).distinct()
    return union_all([
        _rows(per.filter("n > 1"), "one_tier", "tier", keys, F.col("n")),
        _rows(known.join(per, keys, "left_anti"), "no_tier", "tier", keys, F.lit("missing")),
        _rows(per.join(known, keys, "left_anti"), "unknown_entity", "tier", keys, F.lit("extra")),
    ])


def provenance(df: DataFrame, table: str, key: list[str], pages: DataFrame, kind: str | None = None) -> DataFrame:
    """Sources that are not a known page, or a page of another kind than the table's. ``pages(source, page_kind)``."""
    joined = df.join(pages.select("source", "page_kind"), "source", "left")
    lost = _rows(joined.filter(F.col("page_kind").isNull()), "source_exists", table, key, F.col("source"))
    if kind is None:
        return lost
    return lost.unionByName(_rows(joined.filter(F.col("page_kind") != kind), "source_kind", table, key, F.col("source")))


def index_complete(postings: DataFrame, indexable: DataFrame) -> DataFrame:
    """Indexed against indexable chunk ids, both differences."""
    inside = postings.select("chunk_id").distinct()
    return union_all([
        _rows(indexable.select("chunk_id").join(inside, "chunk_id", "left_anti"), "not_indexed", "chunk", ["chunk_id"], F.lit("")),
        _rows(inside.join(indexable.select("chunk_id"), "chunk_id", "left_anti"), "stale_index", "chunk", ["chunk_id"], F.lit("")),
    ])


def content_drift(indexed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose text no longer has the hash stored with the index. ``indexed(chunk_id, hash)``."""
    now = chunks.select("chunk_id", F.xxhash64("text").alias("now"))
    both = indexed.join(now, "chunk_id", "full_outer")
    state = F.when(F.col("hash").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("hash") != F.col("now"), "changed")
    return both.select("chunk_id", state.alias("state")).filter(F.col("state").isNotNull())


def known_answers(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Each known query must return its id within the list. ``expected(query_id, id)``."""
    got = results.select("query_id", "id", "rank")
    return expected.join(got, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.min("rank").alias("rank")).withColumn("passed", F.col("rank").isNotNull())


def value_status(asks: DataFrame, score: DataFrame, metrics: DataFrame) -> DataFrame:
    """Do the named values exist, and does the combination? ``asks(ask_id, period, entity, metric)``, NULL = not named."""
    def flag(df, col, name):
        return df.select(F.col(col)).distinct().withColumn(name, F.lit(True))
    pair = score.select("period", "entity").distinct().withColumn("_pair", F.lit(True))
    joined = (
        asks.join(flag(score, "period", "_p"), "period", "left").join(flag(score, "entity", "_e"), "entity", "left")
        .join(flag(metrics, "metric", "_m"), "metric", "left").join(pair, ["period", "entity"], "left")
    )
    bad = lambda col, f: F.col(col).isNotNull() & F.col(f).isNull()
    return joined.select(
        "ask_id",
        F.when(bad("entity", "_e"), "unknown entity").when(bad("period", "_p"), "unknown period")
        .when(bad("metric", "_m"), "unknown metric")
        .when(F.col("period").isNotNull() & F.col("entity").isNotNull() & F.col("_pair").isNull(), "no such combination")
        .otherwise("ok").alias("status"))


def plan_violations(plans: DataFrame, tools: dict[str, set[str]], entities: DataFrame, metrics: DataFrame, periods: DataFrame) -> DataFrame:
    """Check stated plans as data: known tool, its required parameters, known values, backward references.

    ``plans(plan_id, steps array<struct<no, tool, periods, entity, metric, looks_at, condition>>)``.
    ``tools`` names the parameters that each tool needs.
    """
    steps = plans.select("plan_id", F.inline("steps"))
    key = ["plan_id", "no"]
    needs = {p: [t for t, req in tools.items() if p in req] for p in ("periods", "entity", "metric", "condition")}
    missing = F.concat_ws(",", *[
        F.when(F.col("tool").isin(ts) & (F.size(F.coalesce("periods", F.array().cast("array<string>"))) == 0 if p == "periods" else F.col(p).isNull()), F.lit(p))
        for p, ts in needs.items() if ts])
    named = steps.select("plan_id", "no", F.explode("periods").alias("period"))
    return union_all([
        check(steps, "known_tool", "plan", key, F.col("tool").isin(list(tools)), F.col("tool")),
        _rows(steps.withColumn("_m", missing).filter("_m <> ''"), "parameters", "plan", key, F.col("_m")),
        _rows(steps.filter(F.col("entity").isNotNull()).join(entities.select("entity").distinct(), "entity", "left_anti"), "known_entity", "plan", key, F.col("entity")),
        _rows(steps.filter(F.col("metric").isNotNull()).join(metrics.select("metric").distinct(), "metric", "left_anti"), "known_metric", "plan", key, F.col("metric")),
        _rows(named.join(periods.select("period").distinct(), "period", "left_anti"), "known_period", "plan", key, F.col("period")),
        check(steps, "looks_back", "plan", key, F.col("looks_at") < F.col("no"), F.col("looks_at")),
    ])


def plain_number(value: Column) -> Column:
    """``1,234`` as ``1234``."""
    return F.regexp_replace(value, r"(?<=\d),(?=\d{3}(?!\d))", "")


def expected_values(expected: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Expected numbers that occur nowhere in the tables, in any column; ``1,234`` and ``1234`` are one value.

    ``expected(case_id, value)``. Table values that no expected value can be are left out before the shuffle.
    """
    asked = expected.withColumn("v", plain_number(F.col("value")))
    have = value_set(tables, asked.select(F.col("v").alias("value")), plain_number).select(F.col("value").alias("v")).distinct()
    return asked.join(have, "v", "left_anti").select("case_id", "value")


def page_like(source: Column) -> Column:
    return source.rlike(f"^{CHUNK_ID}$")
