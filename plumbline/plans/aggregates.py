"""Aggregation and evaluation plans over the score, run, trial and text views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import aggregate as A
from plumbline.operators import evaluate as E
from plumbline.operators import lookup as L
from plumbline.operators import ranking as R
from plumbline.plans.oracle import half_up, oracle
from plumbline.plans.ranking import dbl
from plumbline.plans.registry import plan
from plumbline.sources import views as V

ROUTES = ["clarify", "refuse", "search", "search_0", "sql"]


def sql_numbers(x: str) -> str:
    """DuckDB text for canonical numbers; thousands separators go in three passes (RE2 has no lookaround)."""
    for _ in range(3):
        x = f"regexp_replace({x}, '(\\d),(\\d{{3}})(\\D|$)', '\\1\\2\\3', 'g')"
    return (
        f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '\\d+(?:\\.\\d+)?'), lambda n: "
        "coalesce(regexp_replace(CAST(round(TRY_CAST(n AS DECIMAL(38,6)), 2) AS VARCHAR), '\\.?0+$', ''), "
        "CASE WHEN contains(n, '.') THEN regexp_replace(regexp_replace(n, '^0+(\\d)', '\\1'), '\\.?0+$', '') "
        "ELSE regexp_replace(n, '^0+(\\d)', '\\1') END))))"
    )


# the run data writes its items as "a;b" or as text without digits
SCORED = f"""
    SELECT *, CASE WHEN NOT route_ok THEN 0.0 WHEN expected_route IN ('clarify', 'refuse') THEN 1.0
                   WHEN expected_route = 'search' AND NOT ev THEN 0.0
                   WHEN len(want) > 0 THEN len(list_filter(want, lambda w: list_contains(have, w)
                        OR len(list_filter(have, lambda a: list_contains(have,
                           regexp_replace(CAST(CAST(a AS DECIMAL(18,2)) + CAST(w AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', ''))
                           AND CAST(w AS DECIMAL(18,2)) > 0)) > 0)) / len(want)
                   ELSE 0.0 END AS score,
           route_ok AND expected_route NOT IN ('clarify', 'refuse') AND len(want) = 0
             AND (expected_route <> 'search' OR ev) AS unjudgeable,
           CASE WHEN expected_route = 'search' AND route_ok THEN ev END AS evidence
    FROM (SELECT *, route = expected_route AS route_ok, list_contains(sources, expected_page) AS ev,
                 list_transform(list_filter(string_split(expected_answer, ';'), lambda s: regexp_matches(s, '\\d')),
                   lambda n: regexp_replace(CAST(CAST(n AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '')) AS want,
                 {sql_numbers('answer')} AS have FROM run)"""


@plan("evl_judge", oracle("run", "SELECT question_id, route_ok, evidence, score, unjudgeable FROM scored", scored=SCORED))
def evl_judge(t):
    """EVL-5: the scoring ladder over every recorded answer."""
    return E.judge(V.run(t)).select("question_id", "route_ok", "evidence", "score", "unjudgeable")


SUMMARY = """count(*) AS n, count(*) FILTER (route_ok) AS route_ok, count(*) FILTER (NOT unjudgeable AND score >= 1) AS full_marks,
           count(*) FILTER (unjudgeable) AS unjudgeable, count(*) FILTER (route_ok AND NOT unjudgeable AND score >= 1) AS both_ok,
           round(avg(score) FILTER (NOT unjudgeable), 6) AS mean_score FROM scored"""


@plan("agg_score_summary", oracle("run", f"SELECT {SUMMARY}", scored=SCORED))
def agg_score_summary(t):
    """AGG-7, EVL-6: totals of a scored run."""
    return A.scored_summary(E.judge(V.run(t)))


@plan("agg_category_summary", oracle("run", f"SELECT category, {SUMMARY} GROUP BY 1", scored=SCORED))
def agg_category_summary(t):
    """AGG-8: the same per category."""
    return A.scored_summary(E.judge(V.run(t)), ["category"])


@plan("agg_alarm_rates", oracle("run", """
    SELECT correct, coalesce(route, '(all)') AS route, count(*) AS n, count(*) FILTER (alarm) AS alarms,
           count(*) FILTER (alarm) / count(*) AS rate
    FROM (SELECT score >= 1 AS correct, route,
                 CASE WHEN score >= 1 THEN n_warnings > 0 ELSE n_warnings > 0 OR n_trace > 0 END AS alarm
          FROM scored WHERE NOT unjudgeable) GROUP BY GROUPING SETS ((correct), (correct, route))""", scored=SCORED))
def agg_alarm_rates(t):
    """AGG-9: alarm and false-alarm rates with subtotals."""
    return A.alarm_rates(E.judge(V.run(t)))


@plan("agg_confusion", oracle("run", "SELECT expected_route, " + ", ".join(
    f"count(*) FILTER (route = '{r}') AS \"{r}\"" for r in ROUTES) + " FROM run GROUP BY 1"))
def agg_confusion(t):
    """AGG-10: expected by given route."""
    return A.confusion(V.run(t), ROUTES)


@plan("agg_two_by_two", oracle("run", """
    SELECT a, b, count(*) AS n, grouping(a, b) AS level FROM (
      SELECT list_contains(sources, expected_page) AS a, route = expected_route AS b FROM run) GROUP BY CUBE (a, b)"""))
def agg_two_by_two(t):
    """AGG-11: paired comparison with margins."""
    return A.two_by_two(V.run(t), F.array_contains("sources", F.col("expected_page")), F.col("route") == F.col("expected_route"))


@plan("agg_alarm_outcomes", oracle("run", """
    SELECT *, "right" / ("right" + silent + false_alarm + voiced) AS accuracy, voiced / (silent + voiced) AS alarm_recall,
           voiced / (voiced + false_alarm) AS alarm_precision
    FROM (SELECT count(*) FILTER (NOT s AND h) AS "right", count(*) FILTER (NOT s AND NOT h) AS silent,
                 count(*) FILTER (s AND h) AS false_alarm, count(*) FILTER (s AND NOT h) AS voiced
          FROM (SELECT n_warnings > 0 OR route IN ('refuse', 'search_0') AS s,
                       list_contains(sources, expected_page) AS h FROM run))"""))
def agg_alarm_outcomes(t):
    """AGG-12: right, silent, voiced and false-alarm counts."""
    return A.alarm_outcomes(V.run(t))


@plan("agg_stability", oracle("trial", """
    SELECT CASE WHEN a THEN 'always_right' WHEN NOT o THEN 'always_wrong' ELSE 'swinging' END AS stability,
           count(*) AS items, CAST(sum(n) AS BIGINT) AS trials
    FROM (SELECT bool_and(ok) AS a, bool_or(ok) AS o, count(*) AS n FROM trial GROUP BY question_id) GROUP BY 1"""))
def agg_stability(t):
    """AGG-13: stability of repeated trials."""
    return A.stability(V.trial(t))


@plan("agg_contamination", oracle("run", """
    SELECT coalesce(category, '(all)') AS category, CAST(sum(k) AS BIGINT) AS returned, CAST(sum(o) AS BIGINT) AS outside,
           count(*) FILTER (o > 0) AS questions, sum(o) / sum(k) AS rate
    FROM (SELECT category, len(sources) AS k, len(list_filter(sources, lambda s: NOT starts_with(s, period))) AS o FROM run)
    GROUP BY ROLLUP (category)"""))
def agg_contamination(t):
    """AGG-14: sources outside the asked period."""
    return A.contamination(V.run(t))


WILSON = """
    SELECT {by}, k, n, round(greatest(0.0, c - h), 6) AS low, round(least(1.0, c + h), 6) AS high,
           least(1.0, c + h) - greatest(0.0, c - h) > 0.35 AS wide
    FROM (SELECT *, (p + z2 / (2 * n)) / (1 + z2 / n) AS c,
                 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * CAST(n AS DOUBLE) * n)) / (1 + z2 / n) AS h
          FROM (SELECT {by}, k, n, k / n AS p, CAST(1.96 AS DOUBLE) * CAST(1.96 AS DOUBLE) AS z2
                FROM (SELECT {by}, count(*) FILTER (ok) AS k, count(*) AS n FROM trial GROUP BY 1)))"""


@plan("agg_wilson_by_pages", oracle("trial", WILSON.format(by="pages")))
def agg_wilson_by_pages(t):
    """AGG-16: success rate by number of pages with the Wilson interval."""
    return A.success_rates(V.trial(t), "pages")


@plan("agg_success_by_position", oracle("trial", WILSON.format(by="position")))
def agg_success_by_position(t):
    """AGG-17: success rate by position."""
    return A.success_rates(V.trial(t), "position")


@plan("agg_position_gap", oracle("trial", """
    SELECT question_id % 100 AS item, avg(CAST(ok AS INT)) FILTER (position = 1) AS early,
           avg(CAST(ok AS INT)) FILTER (position = 5) AS late,
           avg(CAST(ok AS INT)) FILTER (position = 1) - avg(CAST(ok AS INT)) FILTER (position = 5) AS gap
    FROM trial GROUP BY 1"""))
def agg_position_gap(t):
    """AGG-17: first against fifth position per item group."""
    return A.position_gap(V.trial(t), F.col("question_id") % 100, 1, 5)


@plan("agg_weights")
def agg_weights(t):
    """AGG-19: weights of the metrics in the headline score."""
    metrics = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = V.metric_score(t).groupBy("period", "entity").pivot("metric", metrics).agg(F.first("score"))
    whole = wide.join(V.score(t).select("period", "entity", "score"), ["period", "entity"]).na.drop()
    return A.constrained_weights(whole, metrics)


@plan("agg_count_per_group", oracle("score", "SELECT period, count(*) AS n FROM score GROUP BY 1"))
def agg_count_per_group(t):
    """AGG-1: rows per period."""
    return V.score(t).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@plan("agg_metric_mean", oracle("metric_score", f"""
    SELECT period, metric, {half_up('sum(h)', 'count(*)')} / 100.0 AS mean, count(*) AS n FROM metric_score GROUP BY 1, 2"""))
def agg_metric_mean(t):
    """AGG-2: mean per (period, metric)."""
    return V.metric_score(t).groupBy("period", "metric").agg(
        F.round(R.exact_mean(), 2).cast("double").alias("mean"), F.count(F.lit(1)).alias("n"))


@plan("agg_metric_tier_mean", oracle("metric_score members", f"""
    SELECT period, metric, tier, {half_up('sum(h)', 'count(*)')} / 100.0 AS mean, count(*) AS n
    FROM metric_score JOIN members USING (entity) GROUP BY 1, 2, 3"""))
def agg_metric_tier_mean(t):
    """AGG-3, JON-2: mean per (period, metric, tier)."""
    return V.metric_score(t).join(V.members(t), "entity").groupBy("period", "metric", "tier").agg(
        F.round(R.exact_mean(), 2).cast("double").alias("mean"), F.count(F.lit(1)).alias("n"))


@plan("agg_pages_in_many_periods", oracle("chunk", r"""
    SELECT md5(regexp_replace(text, '\s+', '', 'g')) AS key, count(DISTINCT period) AS n_periods, count(*) AS n
    FROM chunk GROUP BY 1 HAVING count(DISTINCT period) > 1"""))
def agg_pages_in_many_periods(t):
    """AGG-4: contents that occur in more than one period."""
    keyed = V.chunk(t).select(F.md5(F.regexp_replace("text", r"\s+", "").cast("binary")).alias("key"), "period")
    pairs = keyed.groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n_periods"), F.sum("n").alias("n")).filter("n_periods > 1")


@plan("agg_span", oracle("score", """
    SELECT entity, CASE WHEN min(period) = max(period) THEN min(period) ELSE concat(min(period), '~', max(period)) END AS span,
           (max(h) - min(h)) / 100.0 AS spread FROM score GROUP BY 1"""))
def agg_span(t):
    """AGG-5: covered span and score range of each entity."""
    return V.score(t).groupBy("entity").agg(
        A.span_label(F.min("period"), F.max("period")).alias("span"),
        (F.max("score") - F.min("score")).cast("double").alias("spread"))


@plan("agg_category_tally", oracle("run", """
    SELECT category, count(*) AS n, count(*) FILTER (route = expected_route) AS ok FROM run GROUP BY 1"""))
def agg_category_tally(t):
    """AGG-6: per category two counters."""
    return V.run(t).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("route") == F.col("expected_route")).alias("ok"))


@plan("agg_accountability", oracle("run", """
    SELECT section, got, to_page, warned, CASE WHEN got = 0 THEN 'missing' WHEN warned > 0 THEN 'warned'
           WHEN to_page = got THEN 'verifiable' ELSE 'partly' END AS verdict
    FROM (SELECT category AS section, count(*) FILTER (answer IS NOT NULL) AS got,
                 count(*) FILTER (answer IS NOT NULL AND len(list_filter(sources, lambda s: regexp_matches(s, '\\d{4}Q\\d-P\\d+'))) > 0)
                   AS to_page, count(*) FILTER (n_warnings > 1) AS warned FROM run GROUP BY 1)"""))
def agg_accountability(t):
    """AGG-20, AUD-12: how far each section can be verified."""
    return A.accountability(V.run(t).select(
        F.col("category").alias("section"), F.col("answer").alias("value"), L.source_level(F.col("sources")).alias("level"),
        (F.col("n_warnings") > 1).alias("warned")))


@plan("agg_basis_mix", oracle("period_meta_q", """
    SELECT period[1:4] AS year, count(DISTINCT basis_version) AS n_versions, count(DISTINCT basis_version) > 1 AS mixed
    FROM period_meta_q GROUP BY 1"""))
def agg_basis_mix(t):
    """AGG-21: more than one methodology version inside a year."""
    n = F.countDistinct("basis_version")
    return V.period_meta_q(t).groupBy(F.substring("period", 1, 4).alias("year")).agg(n.alias("n_versions"), (n > 1).alias("mixed"))


@plan("agg_usage", oracle("", r"""
    SELECT coalesce(role, '(all)') AS role, count(*) AS calls, CAST(sum(w) AS BIGINT) AS tokens, CAST(sum(c) AS BIGINT) AS chars
    FROM (SELECT role, length(text) AS c, len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) AS w
          FROM conversations) GROUP BY ROLLUP (role)"""))
def agg_usage(t):
    """AGG-22: counters of a call log."""
    return A.usage(t.conversations, "role")


@plan("evl_refusals", oracle("run", """
    SELECT count(*) FILTER (expected_route = 'refuse') AS should_refuse,
           count(*) FILTER (expected_route = 'refuse' AND route = 'refuse') AS did_refuse,
           count(*) FILTER (expected_route <> 'refuse') AS should_answer,
           count(*) FILTER (expected_route <> 'refuse' AND route = 'refuse') AS wrongly_refused,
           count(*) FILTER (route = 'search_0') AS zero_hit FROM run"""))
def evl_refusals(t):
    """EVL-7: both directions of refusing."""
    return E.refusal_metrics(V.run(t))


@plan("evl_silent_failures", oracle("run", """
    SELECT question_id, route, score FROM scored
    WHERE NOT unjudgeable AND score < 1 AND n_warnings = 0 AND n_trace = 0""", scored=SCORED))
def evl_silent_failures(t):
    """EVL-8: wrong answers without any signal."""
    return E.silent_failures(E.judge(V.run(t))).select("question_id", "route", "score")


@plan("evl_verdict_cache", oracle("run", """
    SELECT concat(question_id, '|', md5(expected_answer)[1:12], '|', md5(answer)[1:12]) AS key, question_id,
           CASE WHEN question_id % 3 = 0 THEN 0.5 ELSE score END AS score, question_id % 3 = 0 AS from_cache
    FROM scored""", scored=SCORED))
def evl_verdict_cache(t):
    """EVL-9: a third of the verdicts comes from a cache, the rest is judged."""
    run = V.run(t)
    stored = run.filter("question_id % 3 = 0").select(
        E.cache_key(F.col("question_id"), F.col("expected_answer"), F.col("answer")).alias("key"), F.lit(0.5).alias("cached_score"))
    return E.judge_with_cache(run, stored)


@plan("evl_case_check", oracle("", """
    SELECT conv_id AS case_id, bool_and(ok) AS passed, count(*) AS turns, count(*) FILTER (ok) AS turns_ok
    FROM (SELECT conv_id, contains(text, '.') AND NOT contains(text, '@') AS ok FROM conversations) GROUP BY 1"""))
def evl_case_check(t):
    """EVL-10: must-contain and must-not-contain per turn."""
    return E.case_check(t.conversations.select(
        F.col("conv_id").alias("case_id"), "turn", "text", F.array(F.lit(".")).alias("must"), F.array(F.lit("@")).alias("must_not")))


@plan("evl_pass_rates", oracle("", """
    SELECT turns AS kind, count(*) AS cases, count(*) FILTER (passed) AS passed, count(*) FILTER (passed) / count(*) AS rate
    FROM (SELECT conv_id, count(*) AS turns, bool_and(contains(text, '.') AND NOT contains(text, '@')) AS passed
          FROM conversations GROUP BY 1) GROUP BY 1"""))
def evl_pass_rates(t):
    """EVL-11: pass rates per kind of case (its number of turns)."""
    cases = evl_case_check(t)
    ok = F.count_if("passed")
    return cases.groupBy(F.col("turns").alias("kind")).agg(
        F.count(F.lit(1)).alias("cases"), ok.alias("passed"), (ok / F.count(F.lit(1))).alias("rate"))


@plan("evl_allocation", oracle("", """
    SELECT category, item_id, n, n <= 3 AS first_batch FROM (
      SELECT lang AS category, doc_id AS item_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)
    WHERE n <= 5 + length(category) * 2 + CASE WHEN category = 'en' THEN 10 ELSE 0 END"""))
def evl_allocation(t):
    """EVL-12: a quota of documents per language."""
    items = t.documents.select(F.col("lang").alias("category"), F.col("doc_id").alias("item_id"))
    quotas = items.select("category").distinct().withColumn(
        "quota", 5 + F.length("category") * 2 + F.when(F.col("category") == "en", 10).otherwise(0))
    return E.allocate(items, quotas, 3)


CODE = E.code_version()


@plan("evl_fingerprint", oracle("", f"""
    SELECT 'nation' AS input, '{CODE}' AS code, count(*) AS n_rows, CAST(sum(CAST(concat('0x', md5(concat_ws(chr(31), n_name, n_nationkey,
           n_regionkey))[1:12]) AS BIGINT)) AS VARCHAR) AS content, '5' AS k FROM nation UNION ALL
    SELECT 'documents', '{CODE}', count(*), CAST(sum(CAST(concat('0x', md5(concat_ws(chr(31), doc_id, lang, n_chars, source, text))[1:12])
           AS BIGINT)) AS VARCHAR), '5' FROM documents"""))
def evl_fingerprint(t):
    """EVL-15: content hashes of the inputs, one made of two parts, beside the code version and the parameters."""
    even = [E.fingerprint(t.documents.filter(F.col("doc_id") % 2 == k), "documents", CODE, k="5") for k in (0, 1)]
    return E.fingerprint(t.nation, "nation", CODE, k="5").unionByName(E.merged_fingerprints(even[0].unionByName(even[1])))


@plan("evl_drift", oracle("ranked", """
    SELECT entity AS claim, recorded, now, CASE WHEN recorded = now THEN 'same' ELSE 'drifted' END AS status
    FROM (SELECT entity, count(*) FILTER (row_no <= 5) AS now, count(*) FILTER (rnk <= 5) AS recorded FROM ranked GROUP BY 1)
    """))
def evl_drift(t):
    """EVL-14: claims recorded under one tie rule, recomputed under another."""
    ranked = R.rank_table(V.score(t))
    def claim(col):
        return ranked.groupBy(F.col("entity").alias("claim")).agg(F.count_if(F.col(col) <= 5).alias("value"))
    return E.drift(claim("rnk"), claim("row_no"))
