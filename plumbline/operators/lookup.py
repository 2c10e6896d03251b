"""Lookups of asked (period, entity, metric) rows, always with a status beside the value.

``ok`` / ``no_match`` / ``out_of_coverage`` / ``incomplete`` are kept apart: an absent
row is never shown as a zero or an empty answer.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.periods import CHUNK_ID

VALUE_MARKS = 1 << 20


def in_periods(wanted: Column, period: Column) -> Column:
    """IN-list predicate where an empty or NULL list means no filter."""
    return wanted.isNull() | (F.size(wanted) == 0) | F.array_contains(wanted, period)


def filter_in(df: DataFrame, col: str, values: Iterable[str]) -> DataFrame:
    """``isin`` that keeps everything for an empty list."""
    values = list(values)
    return df.filter(F.col(col).isin(values)) if values else df


def coverage(table: DataFrame, name: str) -> DataFrame:
    """The periods a table holds."""
    return table.select("period").distinct().withColumn(name, F.lit(True))


def availability(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per period, one flag per table."""
    stacked = None
    for name, df in tables.items():
        part = df.select("period").distinct().withColumn("table", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    flags = [F.bool_or(F.col("table") == name).alias(name) for name in tables]
    return stacked.groupBy("period").agg(*flags)


def point_lookup(asks: DataFrame, table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left-join the asked keys to a table and say what happened.

    Incomplete asks (a NULL key) never reach the join. The table is unique on ``keys``.
    """
    covered = coverage(table, "_covered")
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    found = table.select(*keys, *values).withColumn("_hit", F.lit(True))
    status = (
        F.when(~complete, "incomplete")
        .when(F.col("_hit"), "ok")
        .when(F.col("_covered"), "no_match")
        .otherwise("out_of_coverage")
    )
    return (
        asks.join(found, keys, "left").join(covered, "period", "left").withColumn("status", status)
        .drop("_hit", "_covered")
    )


def best_and_worst(metric_score: DataFrame) -> DataFrame:
    """All metrics of each (period, entity) as one line, with the best and worst named."""
    line = F.concat_ws("=", "metric", F.format_string("%.2f", F.col("score").cast("double")))
    pair = F.struct(F.col("score"), F.col("metric"))
    return metric_score.groupBy("period", "entity").agg(
        F.array_join(F.sort_array(F.collect_list(line)), ";").alias("line"),
        F.min(F.struct((-F.col("score")).alias("s"), "metric"))["metric"].alias("best"),
        F.min(pair)["metric"].alias("worst"),
        F.count(F.lit(1)).alias("n_metrics"),
    )


def resolve_prefix(asks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Exact name, else unique prefix, else ambiguous, else missing. ``asks(ask)``; ``catalog(name)``.

    The catalog is unfolded into its prefixes, so the match is an equi-join on the ask.
    """
    prefixes = catalog.select(
        "name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.substring(F.col("name"), F.lit(1), k))).alias("ask")
    )
    wanted = asks.select("ask").distinct()
    hits = prefixes.join(wanted, "ask", "left_semi").groupBy("ask").agg(
        F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.bool_or(F.col("name") == F.col("ask")).alias("exact")
    )
    return wanted.join(hits, "ask", "left").select(
        "ask",
        F.when(F.col("exact"), F.col("ask")).when(F.col("n") == 1, F.col("first")).alias("name"),
        F.when(F.col("exact"), "exact").when(F.col("n") == 1, "prefix").when(F.col("n") > 1, "ambiguous")
        .otherwise("missing").alias("status"),
    )


def substring_periods(chunks: DataFrame, word: str) -> DataFrame:
    """Periods whose text contains a word, as first, last, label and count."""
    hit = chunks.filter(F.contains("text", F.lit(word)))
    return hit.agg(
        F.min("period").alias("first"),
        F.max("period").alias("last"),
        F.countDistinct("period").alias("n_periods"),
        F.count(F.lit(1)).alias("n_chunks"),
    ).select(
        F.lit(word).alias("word"),
        F.when(F.col("first") == F.col("last"), F.col("first"))
        .otherwise(F.concat_ws("~", "first", "last")).alias("span"),
        "n_periods",
        "n_chunks",
    )


def catalogs(**columns: DataFrame) -> DataFrame:
    """Distinct values of several one-column frames as one (kind, name, short) catalog."""
    out = None
    for kind, df in columns.items():
        name = df.columns[0]
        part = df.select(
            F.lit(kind).alias("kind"),
            F.col(name).alias("name"),
            F.regexp_replace(F.col(name), r"^\d+-", "").alias("short"),
        ).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def field_catalog(tables: dict[str, DataFrame], dimensions: set[str]) -> DataFrame:
    """What can be asked, read from the schemas, and how many values stand behind each field.

    Measures are columns that are not dimensions; a table without ``entity`` holds entity-independent fields.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (table, f.name, f.dataType.simpleString(), f.name not in dimensions, "entity" in df.columns)
        for table, df in tables.items()
        for f in df.schema.fields
    ]
    fields = spark.createDataFrame(rows, "table string, field string, type string, is_measure boolean, per_entity boolean")
    counts = None
    for table, df in tables.items():
        sums = df.agg(*[F.count(c).alias(c) for c in df.columns])
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_values")) for c in df.columns])
        part = sums.select(F.lit(table).alias("table"), F.inline(pairs))
        counts = part if counts is None else counts.unionByName(part)
    return fields.join(counts, ["table", "field"])


def field_values(ranked: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Every single value that can be asked for by name: (period, entity, field, value); the fields of a period have the entity ``''``."""
    score = F.format_string("%.2f", F.col("score").cast("double"))
    named = {"rank": F.col("row_no").cast("string"), "score": score, "source": F.col("source"), "entity_n": F.col("group_n").cast("string")}
    pairs = lambda values: F.inline(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in values.items()]))
    out = ranked.select("period", "entity", pairs(named))
    if meta is None:
        return out
    return out.unionByName(meta.select("period", F.lit("").alias("entity"), pairs({c: F.col(c).cast("string") for c in meta.columns if c != "period"})))


def choose_field(asks: DataFrame, ranked: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One output per ask row ``(period, entity, field[, n])``, null where there is none.

    ``field`` is ``rank``, ``score``, ``source`` or ``entity_n`` of an entity, a column of ``meta``, or ``top`` for the first ``n`` entities with their scores.
    """
    columns = [] if meta is None else [c for c in meta.columns if c not in ("period", "entity_n")]
    of_period = F.col("field").isin(*columns) if columns else F.lit(False)
    values = field_values(ranked, meta).withColumnRenamed("entity", "_of")
    keyed = asks.withColumn("_of", F.when(of_period, "").otherwise(F.col("entity")))
    got = keyed.join(values, ["period", "field", "_of"], "left").drop("_of")
    if "n" not in asks.columns:
        return got.select("period", "entity", "field", "value")
    wanted = asks.filter("field = 'top'").select("period", "n").distinct()
    line = F.concat_ws(" ", "entity", F.format_string("%.2f", F.col("score").cast("double")))
    tops = ranked.join(wanted, "period").filter("row_no <= n").groupBy("period", "n").agg(  # n rows
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))), lambda x: x["line"]), ";").alias("_top"))
    both = got.join(tops.withColumn("field", F.lit("top")), ["period", "n", "field"], "left")
    return both.select("period", "entity", "field", "n", F.coalesce("value", "_top").alias("value"))


def written(value: Column, kind: T.DataType) -> Column:
    """A value as one string per cell or array element: numbers without trailing zeros (six decimals), times to the microsecond. An array of strings."""
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.transform(value, lambda x: written(x, kind.elementType)))
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        plain = F.round(value.cast("double"), 6).cast("decimal(38,6)").cast("string")
        return F.array(F.coalesce(F.regexp_replace(plain, r"\.?0+$", ""), value.cast("string")))  # nan and infinity keep their names
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.array(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return F.array(value.cast("string"))


def _named(field: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))


def value_set(tables: dict[str, DataFrame], wanted: DataFrame | None = None, form=lambda value: value) -> DataFrame:
    """Every value of every column of every table as distinct (table, field, value) strings, whatever the schemas are.

    ``form`` is the form in which values are given. ``wanted(value)`` restricts the set to values that may be among them, by marks of bounded size, before
    anything is shuffled.
    """
    marks = None if wanted is None else F.broadcast(wanted.select(F.pmod(F.xxhash64("value"), F.lit(VALUE_MARKS)).alias("_mark")).distinct())
    out = None
    for name, df in tables.items():
        pairs = F.concat(*[F.coalesce(_named(f.name, written(F.col(f.name), f.dataType)), F.array().cast("array<struct<field:string,value:string>>")) for f in df.schema])
        part = df.select(F.lit(name).alias("table"), F.inline(pairs)).withColumn("value", form(F.col("value"))).filter("value is not null")
        if marks is not None:
            part = part.withColumn("_mark", F.pmod(F.xxhash64("value"), F.lit(VALUE_MARKS))).join(marks, "_mark", "left_semi").drop("_mark")
        out = part.distinct() if out is None else out.unionByName(part.distinct())
    return out


def source_label(source: Column) -> Column:
    """``2025Q4-P09`` as ``2025Q4, page 9``; anything else unchanged."""
    period = F.regexp_extract(source, r"^(\d{4}Q\d)-P(\d+)$", 1)
    page = F.regexp_extract(source, r"^(\d{4}Q\d)-P(\d+)$", 2)
    return F.when(period == "", source).otherwise(
        F.concat(period, F.lit(", page "), F.when(page != "", page.try_cast("int").cast("string")))
    )


def source_level(sources: Column) -> Column:
    """How far a list of sources can be verified: to a page, to a table only, or not at all."""
    return (
        F.when(F.exists(sources, lambda s: s.rlike(CHUNK_ID)), "page")
        .when(F.size(F.filter(sources, lambda s: s != "")) > 0, "table")
        .otherwise("none")
    )
