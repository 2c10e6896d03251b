"""Lookup, join, set and report plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.numbers import canonical_numbers
from plumbline.operators import combine as C
from plumbline.operators import lookup as L
from plumbline.operators import ranking as R
from plumbline.operators import report as P
from plumbline.operators import topk as K
from plumbline.plans.aggregates import sql_numbers
from plumbline.plans.oracle import every_value, half_up, oracle
from plumbline.plans.ranking import DEV, dbl
from plumbline.plans.registry import plan
from plumbline.sources import views as V
from plumbline.sources.tables import NAMES as TABLES

ASKS = """SELECT o_orderkey AS ask_id, n_name AS entity, o_orderpriority AS metric,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '1990Q1'
         ELSE concat(year(o_orderdate), 'Q', quarter(o_orderdate)) END AS period
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def asks(t):
    """One lookup per order: its quarter, nation and priority; some lack the period, some name an unknown one."""
    k = F.col("o_orderkey")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("ask_id"), F.col("n_name").alias("entity"), F.col("o_orderpriority").alias("metric"),
        F.when(k % 13 == 0, None).when(k % 17 == 0, F.lit("1990Q1")).otherwise(V.period_of(F.col("o_orderdate"))).alias("period"))


STATUS = """CASE WHEN a.period IS NULL THEN 'incomplete' WHEN s.score IS NOT NULL THEN 'ok'
    WHEN a.period IN (SELECT period FROM score) THEN 'no_match' ELSE 'out_of_coverage' END AS status"""


@plan("flt_score_lookup", oracle("score", f"""
    SELECT ask_id, a.period, a.entity, s.score, s.source, {STATUS} FROM asks a
    LEFT JOIN score s ON a.period = s.period AND a.entity = s.entity""", asks=ASKS))
def flt_score_lookup(t):
    """FLT-1, FLT-11: score and source per asked key, with a status."""
    return L.point_lookup(asks(t).drop("metric"), V.score(t), ["period", "entity"], ["score", "source"]).select(
        "ask_id", "period", "entity", *dbl("score"), "source", "status")


@plan("flt_metric_lookup", oracle("score metric_score", f"""
    SELECT ask_id, a.period, a.entity, a.metric, s.score, s.source, {STATUS} FROM asks a
    LEFT JOIN metric_score s ON a.period = s.period AND a.entity = s.entity AND a.metric = s.metric""", asks=ASKS))
def flt_metric_lookup(t):
    """FLT-3: metric score per asked key."""
    return L.point_lookup(asks(t), V.metric_score(t), ["period", "entity", "metric"], ["score", "source"]).select(
        "ask_id", "period", "entity", "metric", *dbl("score"), "source", "status")


@plan("flt_meta_lookup", oracle("period_meta_q", """
    SELECT ask_id, a.period, m.sample_n, m.entity_n, m.basis_version FROM asks a LEFT JOIN period_meta_q m ON a.period = m.period""", asks=ASKS))
def flt_meta_lookup(t):
    """FLT-2: period metadata per ask."""
    return asks(t).select("ask_id", "period").join(V.period_meta_q(t), "period", "left").select(
        "ask_id", "period", "sample_n", "entity_n", "basis_version")


@plan("flt_entity_metrics", oracle("metric_score", """
    SELECT period, entity, array_to_string(list_sort(list(concat(metric, '=', printf('%.2f', score)))), ';') AS line,
           first(metric ORDER BY h DESC, metric) AS best, first(metric ORDER BY h, metric) AS worst, count(*) AS n_metrics
    FROM metric_score GROUP BY 1, 2"""))
def flt_entity_metrics(t):
    """FLT-4: all metrics of an entity in one line, best and worst named."""
    return L.best_and_worst(V.metric_score(t))


@plan("flt_tier_of_entity", oracle("tier", "SELECT period, entity, tier, tier_avg, source FROM tier"))
def flt_tier_of_entity(t):
    """FLT-5: tier and tier average."""
    return V.tier(t).select("period", "entity", "tier", *dbl("tier_avg"), "source")


@plan("flt_in_list", oracle("score", """
    SELECT entity, count(*) AS n, sum(h) / 100.0 AS total FROM score WHERE period IN ('1996Q1', '1997Q3') GROUP BY 1"""))
def flt_in_list(t):
    """FLT-6: an IN list; an empty one keeps everything."""
    s = L.filter_in(V.score(t), "period", ["1996Q1", "1997Q3"])
    return L.filter_in(s, "period", []).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("double").alias("total"))


@plan("flt_substring_periods", oracle("chunk", """
    SELECT 'tion' AS word, CASE WHEN min(period) = max(period) THEN min(period) ELSE concat(min(period), '~', max(period)) END AS span,
           count(DISTINCT period) AS n_periods, count(*) AS n_chunks FROM chunk WHERE contains(text, 'tion')"""))
def flt_substring_periods(t):
    """FLT-7: periods whose text contains a word."""
    return L.substring_periods(V.chunk(t), "tion")


NAMES = "SELECT c_name AS name FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region"
PREFIXES = """SELECT DISTINCT c_name[1:length(c_name) - c_custkey % 3] AS ask FROM customer UNION
    SELECT n_name[1:length(n_name) - n_nationkey % 2] FROM nation UNION SELECT r_name[1:2] FROM region UNION SELECT concat(n_name, 'x') FROM nation"""


@plan("flt_resolve_prefix", oracle("", f"""
    WITH names AS ({NAMES}), asks AS ({PREFIXES})
    SELECT ask, CASE WHEN exact THEN ask WHEN n = 1 THEN first END AS name,
           CASE WHEN exact THEN 'exact' WHEN n = 1 THEN 'prefix' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
    FROM (SELECT ask, count(name) AS n, min(name) AS first, bool_or(name = ask) AS exact
          FROM asks LEFT JOIN names ON starts_with(name, ask) GROUP BY 1)"""))
def flt_resolve_prefix(t):
    """FLT-8: exact name, unique prefix, ambiguous or missing."""
    c, n, r = t.customer, t.nation, t.region
    names = c.select(F.col("c_name").alias("name")).union(n.select("n_name")).union(r.select("r_name"))
    cut = lambda col, k: F.substring(col, F.lit(1), F.length(col) - k)
    wanted = c.select(cut(F.col("c_name"), (F.col("c_custkey") % 3).cast("int")).alias("ask")).union(
        n.select(cut(F.col("n_name"), F.col("n_nationkey") % 2))).union(r.select(F.substring("r_name", 1, 2))).union(
        n.select(F.concat("n_name", F.lit("x"))))
    return L.resolve_prefix(wanted, names)


@plan("flt_not_prefix", oracle("chunk", "SELECT page_kind, count(*) AS n FROM chunk WHERE NOT starts_with(page_kind, 'en') GROUP BY 1"))
def flt_not_prefix(t):
    """FLT-9: indexable kinds only."""
    return V.chunk(t).filter(~F.col("page_kind").startswith("en")).groupBy("page_kind").agg(F.count(F.lit(1)).alias("n"))


@plan("flt_catalogs", oracle("score metric_score members", r"""
    SELECT DISTINCT kind, name, regexp_replace(name, '^\d+-', '') AS short FROM (
      SELECT 'entity' AS kind, entity AS name FROM score UNION ALL SELECT 'metric', metric FROM metric_score UNION ALL
      SELECT 'period', period FROM score UNION ALL SELECT 'tier', tier FROM members)"""))
def flt_catalogs(t):
    """FLT-10: distinct entities, metrics, periods and tiers with short names."""
    return L.catalogs(entity=V.score(t).select("entity"), metric=V.metric_score(t).select("metric"),
                      period=V.score(t).select("period"), tier=V.members(t).select("tier"))


SELECTORS = ("rank", "score", "source", "entity_n", "top", "sample_n", "l1_n", "l2_n", "basis_version")


@plan("flt_choose_field", oracle("ranked period_meta_q", f"""
    SELECT a.period, a.entity, field, n, CASE field WHEN 'rank' THEN CAST(row_no AS VARCHAR) WHEN 'score' THEN printf('%.2f', score)
           WHEN 'source' THEN source WHEN 'entity_n' THEN CAST(r.entity_n AS VARCHAR) WHEN 'top' THEN list_aggregate(lines[:n], 'string_agg', ';')
           WHEN 'sample_n' THEN CAST(sample_n AS VARCHAR) WHEN 'l1_n' THEN CAST(l1_n AS VARCHAR) WHEN 'l2_n' THEN CAST(l2_n AS VARCHAR) WHEN 'basis_version' THEN basis_version END AS value
    FROM (SELECT period, entity, {list(SELECTORS)}[ask_id % 9 + 1] AS field, CAST(ask_id // 9 % 4 + 1 AS INT) AS n FROM asks WHERE period IS NOT NULL) a
    LEFT JOIN ranked r ON a.period = r.period AND a.entity = r.entity LEFT JOIN period_meta_q m ON m.period = a.period
    LEFT JOIN (SELECT period, list(concat(entity, ' ', printf('%.2f', score)) ORDER BY row_no) AS lines FROM ranked GROUP BY 1) l ON l.period = a.period""", asks=ASKS))
def flt_choose_field(t):
    """FLT-12: one selected field per ask: of an entity, of its period, or the first N."""
    fields = F.array(*[F.lit(x) for x in SELECTORS])
    wanted = asks(t).filter("period is not null").select("period", "entity", fields[(F.col("ask_id") % 9).cast("int")].alias("field"), F.expr("cast(ask_id div 9 % 4 + 1 as int)").alias("n"))
    return L.choose_field(wanted, R.rank_table(V.score(t)), V.period_meta_q(t))


def _fields(table: str, names: str, measures: str, per_entity: str) -> str:
    listed = names.split()
    marks = ", ".join(str(n in measures.split()).lower() for n in listed)
    quoted = ", ".join(f"'{n}'" for n in listed)
    return f"SELECT '{table.removesuffix('_q')}' AS \"table\", unnest([{quoted}]) AS field, unnest([{marks}]) AS is_measure, {per_entity} AS per_entity, (SELECT count(*) FROM {table}) AS n_values"


@plan("flt_field_catalog", oracle("score metric_score tier period_meta_q", " UNION ALL ".join([
    _fields("score", "period entity score source", "score", "true"),
    _fields("metric_score", "period metric entity score source", "score", "true"),
    _fields("tier", "period entity tier tier_avg source", "tier_avg", "true"),
    _fields("period_meta_q", "period sample_n entity_n l1_n l2_n basis_version", "sample_n entity_n l1_n l2_n basis_version", "false")])))
def flt_field_catalog(t):
    """FLT-13: what can be asked, from the schemas of the derived tables."""
    return L.field_catalog({"score": V.score(t), "metric_score": V.metric_score(t), "tier": V.tier(t), "period_meta": V.period_meta_q(t)},
                           {"period", "entity", "metric", "tier", "source"}).drop("type")


@plan("src_value_set", oracle("", every_value()))
def src_value_set(t):
    """SRC-8: every value of every column of every table."""
    return L.value_set({name: getattr(t, name) for name in TABLES})


@plan("ext_source_label", oracle("metric_score", """
    SELECT DISTINCT source, concat(source[1:6], ', page ', CAST(source[9:] AS INT)) AS label FROM metric_score"""))
def ext_source_label(t):
    """EXT-19: a readable label of a source id."""
    return V.metric_score(t).select("source", L.source_label(F.col("source")).alias("label")).distinct()


@plan("jon_tier_scores", oracle("tier", "SELECT period, tier, entity, h / 100.0 AS score, tier_avg FROM tier"))
def jon_tier_scores(t):
    """JON-1: tier joined with score on the composite key."""
    s = V.score(t)
    return V.tier(t, s).drop("source").join(s, ["period", "entity"]).select("period", "tier", "entity", *dbl("score", "tier_avg"))


@plan("jon_metrics_of_first", oracle("ranked metric_score", """
    SELECT m.period, m.metric, m.entity, m.score FROM metric_score m SEMI JOIN
      (SELECT period, entity FROM ranked WHERE row_no = 1) r ON m.period = r.period AND m.entity = r.entity"""))
def jon_metrics_of_first(t):
    """JON-3: metrics of the first-ranked entity."""
    first = K.top_n(V.score(t), 1)
    return V.metric_score(t).join(first, ["period", "entity"], "left_semi").select("period", "metric", "entity", *dbl("score"))


@plan("jon_peer_means", oracle("metric_score members", f"""
    SELECT m.period, m.metric, m.entity, tier, m.score, {half_up('sum(h) OVER w * 10', 'count(*) OVER w')} / 1000.0 AS peer_mean,
           count(*) OVER w AS n_peers FROM metric_score m JOIN members USING (entity) WINDOW w AS (PARTITION BY period, metric, tier)"""))
def jon_peer_means(t):
    """JON-6: mean of the peers per metric, self included."""
    return C.peer_means(V.metric_score(t), V.members(t)).select("period", "metric", "entity", "tier", *dbl("score", "peer_mean"), "n_peers")


@plan("jon_unknown_periods", oracle("score", """
    SELECT period, count(*) AS n FROM asks WHERE period IS NOT NULL AND period NOT IN (SELECT period FROM score) GROUP BY 1""", asks=ASKS))
def jon_unknown_periods(t):
    """JON-5: asked periods that do not exist."""
    named = asks(t).filter("period is not null").groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return named.join(V.score(t).select("period").distinct(), "period", "left_anti")


@plan("jon_run_by_key", oracle("run", """
    SELECT r.question_id, expected_answer, answer, o_orderstatus AS status FROM run r JOIN orders ON o_orderkey = question_id"""))
def jon_run_by_key(t):
    """JON-10: questions meet their run rows by key, never by position."""
    return V.run(t).join(t.orders.select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("status")), "question_id").select(
        "question_id", "expected_answer", "answer", "status")


@plan("jon_explain_differences", oracle("run", f"""
    SELECT question_id, array_to_string(list_transform(list_filter(d, lambda x: x.low IS NOT NULL), lambda x: concat(x.number, '=',
             regexp_replace(CAST(x.low + CAST(x.number AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', ''), '-',
             regexp_replace(CAST(x.low AS VARCHAR), '\\.?0+$', ''))), ';') AS derived,
           array_to_string(list_transform(list_filter(d, lambda x: x.low IS NULL), lambda x: x.number), ';') AS still_missing
    FROM (SELECT question_id, list_transform(miss, lambda m: {{'number': m, 'low': list_filter(list_sort(list_transform(have, lambda n: CAST(n AS DECIMAL(18,2)))),
            lambda a: CAST(m AS DECIMAL(18,2)) > 0 AND list_contains(list_transform(have, lambda n: CAST(n AS DECIMAL(18,2))), a + CAST(m AS DECIMAL(18,2))))[1]}}) AS d
          FROM (SELECT question_id, {sql_numbers('answer')} AS have,
                       list_filter({sql_numbers('expected_answer')}, lambda w: NOT list_contains({sql_numbers('answer')}, w)) AS miss FROM run))"""))
def jon_explain_differences(t):
    """JON-11, AUD-11: missing numbers that are a difference of two given ones."""
    rows = V.run(t).select("question_id", canonical_numbers(F.col("answer")).alias("have"), canonical_numbers(F.col("expected_answer")).alias("want"))
    rows = rows.withColumn("miss", F.array_except("want", "have"))
    return C.explain_differences(rows, "miss", "have").select(
        "question_id", F.array_join("derived", ";").alias("derived"), F.array_join("still_missing", ";").alias("still_missing"))


@plan("jon_previous_score", oracle("score", """
    SELECT period, entity, score, lag(score) OVER (PARTITION BY entity ORDER BY period) AS prev_score FROM score"""))
def jon_previous_score(t):
    """JON-13: previous score beside the score, NULL in the first period."""
    return R.with_neighbours(V.score(t)).select("period", "entity", *dbl("score", "prev_score"))


@plan("set_differences", oracle("score", """
    SELECT entity, 'only_left' AS side FROM a WHERE entity NOT IN (SELECT entity FROM b) UNION ALL
    SELECT entity, 'only_right' FROM b WHERE entity NOT IN (SELECT entity FROM a)""",
    a="SELECT DISTINCT entity FROM score WHERE h > 310", b="SELECT DISTINCT entity FROM score WHERE h < 190"))
def set_differences(t):
    """SET-5: two entity lists, both differences."""
    s = V.score(t)
    return C.both_ways(s.filter("score > 3.10").select("entity").distinct(), s.filter("score < 1.90").select("entity").distinct())


@plan("set_ordered_distinct", oracle("", """
    SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words
    FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)"""))
def set_ordered_distinct(t):
    """SET-6: first occurrences in order."""
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@plan("set_coverage_difference", oracle("score", """
    SELECT entity, array_to_string(list_sort(list_filter(['1995Q1', '1996Q2', '1999Q4', '2030Q1'],
             lambda p: list_contains(have, p) AND NOT list_contains(used, p))), '/') AS left_out
    FROM (SELECT entity, list(period) AS have, list(period) FILTER (h >= 250) AS used FROM score GROUP BY 1)"""))
def set_coverage_difference(t):
    """SET-7: requested and available, but not used."""
    requested = F.array(*[F.lit(p) for p in ("1995Q1", "1996Q2", "1999Q4", "2030Q1")])
    per = V.score(t).groupBy("entity").agg(
        F.collect_set("period").alias("have"), F.collect_set(F.when(F.col("score") >= 2.5, F.col("period"))).alias("used"))
    return per.select("entity", F.array_join(F.sort_array(F.array_except(F.array_intersect(requested, "have"), "used")), "/").alias("left_out"))


@plan("set_version_numbers", oracle("run", f"""
    SELECT period, number, count(DISTINCT category) AS n_seen, n_versions FROM (
      SELECT period, category, unnest({sql_numbers('answer')}) AS number, count(DISTINCT category) OVER (PARTITION BY period) AS n_versions FROM run)
    GROUP BY period, number, n_versions HAVING count(DISTINCT category) < n_versions"""))
def set_version_numbers(t):
    """SET-8: numbers that not every version of a group states."""
    values = V.run(t).select("period", "category", F.explode(canonical_numbers(F.col("answer"))).alias("number"))
    return C.version_specific(values, ["period"], "category", "number")


REPORT = f"""SELECT r.period, r.entity, m.tier, r.score, r.row_no, r.entity_n, r.tie_n, x.tier_row_no, x.tier_n, x.mean_h / 100.0 AS tier_mean,
    (r.h - x.mean_h) / 100.0 AS diff_tier, lag(r.period) OVER w AS prev_period, lag(r.score) OVER w AS prev_score, lag(r.source) OVER w AS prev_source, (r.h - lag(r.h) OVER w) / 100.0 AS delta,
    e.strongest, e.weakest, e.n_above, e.n_below, r.source
    FROM ranked r JOIN members m USING (entity) JOIN (
      SELECT period, entity, row_number() OVER (PARTITION BY period, tier ORDER BY h DESC, entity) AS tier_row_no, count(*) OVER (PARTITION BY period, tier) AS tier_n,
             {half_up('sum(h) OVER (PARTITION BY period, tier)', 'count(*) OVER (PARTITION BY period, tier)')} AS mean_h FROM score JOIN members USING (entity)) x
      ON r.period = x.period AND r.entity = x.entity
    LEFT JOIN (SELECT period, entity, first(metric ORDER BY d_tier DESC, metric) AS strongest, first(metric ORDER BY d_tier, metric) AS weakest,
                      count(*) FILTER (d_tier > 0) AS n_above, count(*) FILTER (d_tier < 0) AS n_below FROM dev GROUP BY 1, 2) e
      ON r.period = e.period AND r.entity = e.entity
    WINDOW w AS (PARTITION BY r.entity ORDER BY r.period)"""


@plan("rpt_entity_report", oracle("ranked members metric_score", REPORT, dev=DEV))
def rpt_entity_report(t):
    """RPT-1: the report of every (period, entity), flattened."""
    return P.report_wide(V.score(t), V.metric_score(t), V.members(t)).select(
        "period", "entity", "tier", *dbl("score"), "row_no", "entity_n", "tie_n", "tier_row_no", "tier_n", *dbl("tier_mean", "diff_tier"),
        "prev_period", *dbl("prev_score"), "prev_source", *dbl("delta"), "strongest", "weakest", "n_above", "n_below", "source")


APPENDIX = """SELECT period, entity, unnest(['score', 'rank', 'entity_n', 'tier_rank', 'tier_mean', 'prev_score', 'delta']) AS label,
      unnest([score, row_no, entity_n, tier_row_no, tier_mean, prev_score, delta]) AS value,
      unnest([source, source, NULL, NULL, NULL, prev_source, NULL]) AS src FROM rep UNION ALL
    SELECT period, entity, metric, score, source FROM metric_score"""


@plan("rpt_source_appendix", oracle("ranked members metric_score",
      "SELECT period, entity, label, CAST(value AS DOUBLE) AS value, src FROM app WHERE value IS NOT NULL", dev=DEV, rep=REPORT, app=APPENDIX))
def rpt_source_appendix(t):
    """RPT-3: every number of every report with its source."""
    return P.source_appendix(P.report_records(V.score(t), V.metric_score(t), V.members(t))).drop("how")


@plan("rpt_credibility", oracle("ranked members metric_score", """
    SELECT period, entity, count(*) AS n, count(*) FILTER (regexp_matches(src, '\\d{4}Q\\d-P\\d+')) AS sourced, bool_or(label = 'tier_mean') AS has_tier,
           count(*) - count(*) FILTER (regexp_matches(src, '\\d{4}Q\\d-P\\d+')) AS derived,
           CASE WHEN count(*) = count(*) FILTER (regexp_matches(src, '\\d{4}Q\\d-P\\d+')) THEN 'fully sourced' ELSE 'partly derived' END AS verdict
    FROM app WHERE value IS NOT NULL GROUP BY 1, 2""", dev=DEV, rep=REPORT, app=APPENDIX))
def rpt_credibility(t):
    """RPT-2: how much of each report is sourced."""
    return P.credibility(P.report_records(V.score(t), V.metric_score(t), V.members(t)))
