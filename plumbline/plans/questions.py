"""Question-labelling and answering plans over one question per order.

The oracles know what each wording means from how it was made, so they share no pattern with the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import label as L
from plumbline.operators import ranking as R
from plumbline.plans.oracle import half_up, oracle
from plumbline.plans.ranking import DEV, dbl
from plumbline.plans.registry import plan
from plumbline.session import durable
from plumbline.sources import views as V

TAILS = (5, 6)
TIER_WORD = "(AFRICA|AMERICA|ASIA|EUROPE|EAST)"
YEAR = 2002
HEADLINES = ["综合得分", "样本量", "得分情况", "总分"]  # fixed values


def labelled(t):
    V.keep_cells(t)
    s = V.score(t).select("period", "entity")
    metrics = V.metric_score(t).select("metric").distinct()
    names = V.members(t).select("entity")
    q = durable(V.question(t).select("question_id", "kind", "text"))  # every label reads it
    return durable(L.label_questions(q, s, names, metrics, V.members(t), YEAR, TAILS, TIER_WORD))


def answerable(t):
    """Catalog of what can be asked for: the headline words and every metric of the data."""
    headlines = t.spark.createDataFrame([(w,) for w in HEADLINES], "word string")
    return headlines.unionByName(t.orders.select(F.col("o_orderpriority").alias("word")).distinct())


def routed(t):
    known = V.score(t).select("period")
    out = L.route(labelled(t), known, known.filter("period >= '1998Q1'"))
    return durable(L.apply_gates(out, L.refusals(out, answerable(t)).filter("reason is not null")))  # every kind of answer reads it


LABELS = {
    "cal": "SELECT list_sort(list(DISTINCT period)) AS c FROM score",
    "lab": """SELECT question_id, kind, text, p, p2, e, e2, m, t, CAST(n AS INT) AS n, nk,
        CASE WHEN kind IN (0,1,2,3,4,5,6,7,8,12,13,17,20,21,22,23,24,11) THEN [p] WHEN kind = 9 THEN c[-1:] WHEN kind = 10 THEN c[len(c) - CAST(n AS INT) + 1:]
             WHEN kind = 14 THEN ['1990Q1'] WHEN kind = 16 THEN list_sort([p, p2]) ELSE [] END AS explicit,
        CASE WHEN kind IN (11, 12) THEN 'compare_with_previous' WHEN kind = 10 THEN 'take_recent_n' WHEN kind = 9 THEN 'latest' END AS relation,
        CASE WHEN kind = 11 THEN [p] ELSE [] END AS refs,
        CASE WHEN kind IN (11, 12) THEN (CASE WHEN list_position(c, p) > 1 THEN [c[list_position(c, p) - 1]] ELSE [] END) END AS prev, c
        FROM question, cal""",
    "lab2": """SELECT *, CASE WHEN kind = 11 THEN prev WHEN kind = 12 THEN list_concat([p], prev) ELSE explicit END AS targets,
        CASE WHEN kind IN (0,1,3,7,9,10,11,12,13,14,15,18,22) THEN [e] WHEN kind IN (16, 17) THEN [e, e2] WHEN kind = 24 AND length(nk) = 2 THEN [e] ELSE [] END AS entities,
        CASE WHEN kind IN (16, 17) THEN 'contrast' WHEN kind = 23 THEN 'ambiguous'
             WHEN kind IN (0,1,3,7,9,10,11,12,13,14,15,18,22) OR (kind = 24 AND length(nk) = 2) THEN 'unique' ELSE 'none' END AS entity_status,
        CASE WHEN kind IN (1, 15) THEN m WHEN kind IN (0, 11) THEN '综合得分' WHEN kind = 17 THEN '总分' END AS metric,
        CASE WHEN kind IN (5, 6) THEN t END AS tier FROM lab""",
    "rt": """SELECT *, CASE WHEN reason IN ('number') THEN 'sql' WHEN reason = 'prose' THEN 'search' WHEN reason = 'no signal' THEN 'undecided' ELSE 'refuse' END AS route
        FROM (SELECT *, CASE WHEN kind = 18 THEN 'no signal' WHEN kind = 19 THEN 'annual report' WHEN kind IN (13, 20) THEN 'prose'
              WHEN len(targets) = 0 THEN 'no period' WHEN len(list_filter(targets, lambda x: NOT list_contains(c, x))) > 0 THEN 'unknown period'
              WHEN kind = 1 AND p < '1998Q1' THEN 'metric not covered' ELSE 'number' END AS reason FROM lab2)""",
    "gated": """SELECT * REPLACE (CASE WHEN kind IN (20, 21, 22) THEN 'refuse' ELSE route END AS route,
        CASE kind WHEN 20 THEN 'internal process' WHEN 21 THEN 'unknown entity' WHEN 22 THEN 'unknown metric' ELSE reason END AS reason) FROM rt""",
}


def lab(body: str, views: str = "question score", **more: str) -> str:
    return oracle(views, body, **LABELS, **more)


@plan("lab_period_plan", lab("""
    SELECT question_id, array_to_string(explicit, '/') AS explicit, relation, array_to_string(refs, '/') AS refs, array_to_string(targets, '/') AS targets FROM lab2"""))
def lab_period_plan(t):
    """LAB-1..4: explicit periods, relation, references and targets."""
    q = V.question(t).select("question_id", "text")
    j = lambda c: F.array_join(c, "/").alias(c)
    return L.period_plan(q, V.score(t), YEAR).select("question_id", j("explicit"), "relation", j("refs"), j("targets"))


@plan("lab_relative_periods", oracle("score cells", """
    SELECT r.period, w.word, CASE w.word WHEN '上一期' THEN CASE WHEN i > 1 THEN c[i - 1] END WHEN '下一期' THEN c[i + 1]
        WHEN '去年' THEN list_filter(c, lambda x: x[1:4] = CAST(CAST(r.period[1:4] AS INT) - 1 AS VARCHAR))[-1]
        WHEN '现在' THEN c[-1] WHEN '近三期' THEN array_to_string(c[-3:], '/') END AS got
    FROM (SELECT DISTINCT period, c, list_position(c, period) AS i FROM score, (SELECT list_sort(list(DISTINCT period)) AS c FROM score)) r,
         (SELECT unnest(['上一期', '下一期', '去年', '现在', '近三期']) AS word) w"""))
def lab_relative_periods(t):
    """LAB-2: previous, next, last year, latest and recent three against every period as the remembered reference."""
    words = F.array(*[F.lit(w) for w in ("上一期", "下一期", "去年", "现在", "近三期")])
    base = V.score(t).select("period").distinct().select("period", F.explode(words).alias("word"))
    got = L.with_calendar(base, V.score(t)).select(
        "period", "word", L.relative_periods(F.col("word"), F.col("calendar"), F.col("period"), YEAR)["values"].alias("v"))
    # a written "latest" or "recent n" is its own reference
    return got.select("period", "word", F.when(F.size("v") > 0, F.array_join("v", "/")).alias("got"))


@plan("lab_entities", lab("SELECT question_id, array_to_string(entities, '/') AS entities, entity_status AS status FROM lab2"))
def lab_entities(t):
    """LAB-5, JON-7: full names, endings, city prefixes; ambiguous never resolves."""
    q = durable(V.question(t).select("question_id", "text"))
    return L.link_entity(q, V.members(t).select("entity"), TAILS).select("question_id", F.array_join("entities", "/").alias("entities"), "status")


@plan("lab_all_mentions", lab("SELECT question_id, array_to_string(entities, '/') AS entities FROM lab2 WHERE len(entities) > 0"))
def lab_all_mentions(t):
    """LAB-6: all entities, longest first without overlap, in text order."""
    q = durable(V.question(t).select("question_id", "text"))
    return L.all_mentions(q, V.members(t).select("entity"), TAILS).select("question_id", F.array_join("entities", "/").alias("entities"))


@plan("lab_metric", lab("SELECT question_id, metric FROM lab2 WHERE metric IS NOT NULL"))
def lab_metric(t):
    """LAB-7, TOP-6: the longest metric name or headline word."""
    q = V.question(t).select("question_id", "text")
    return L.link_metric(q, V.metric_score(t).select("metric").distinct()).select("question_id", "metric")


@plan("lab_tier", lab("SELECT question_id, tier FROM lab2 WHERE tier IS NOT NULL"))
def lab_tier(t):
    """LAB-8: tier by its unique ending."""
    return L.link_tier(V.question(t).select("question_id", "text"), V.members(t), TIER_WORD)


@plan("top_longest_entity", lab("SELECT question_id, list_reverse_sort(list_transform(list_filter([e, e2], lambda x: list_contains(entities, x)), lambda x: length(x)))[1] AS n_chars FROM lab2 WHERE len(entities) > 0 AND kind <> 24"))
def top_longest_entity(t):
    """TOP-6: length of the longest entity name in each question."""
    q = V.question(t).select("question_id", "text")
    return L.link_longest(q, V.members(t), "entity").select("question_id", F.length("entity").cast("bigint").alias("n_chars"))


@plan("lab_route", lab("SELECT question_id, route, reason FROM rt"))
def lab_route(t):
    """LAB-9: route and reason by the ordered rules."""
    known = V.score(t).select("period")
    return L.route(labelled(t), known, known.filter("period >= '1998Q1'")).select("question_id", "route", "reason")


@plan("lab_confusion", lab("""SELECT kind, count(*) FILTER (route = 'refuse') AS refuse, count(*) FILTER (route = 'search') AS search,
    count(*) FILTER (route = 'sql') AS sql, count(*) FILTER (route = 'undecided') AS undecided FROM gated GROUP BY 1"""))
def lab_confusion(t):
    """AGG-10: wording by route, after the gates."""
    return routed(t).groupBy("kind").pivot("route", ["refuse", "search", "sql", "undecided"]).count().na.fill(0)


@plan("lab_mixed_basis", lab("""
    SELECT question_id, count(DISTINCT basis_version) AS n_versions, count(DISTINCT basis_version) > 1 AS mixed
    FROM (SELECT question_id, unnest(targets) AS period FROM lab2) JOIN period_meta_q USING (period) GROUP BY 1""", "question score period_meta_q"))
def lab_mixed_basis(t):
    """LAB-10: periods of different methodology in one question."""
    q = L.period_plan(V.question(t).select("question_id", "text"), V.score(t), YEAR)
    return L.mixed_basis(q, V.period_meta_q(t))


@plan("lab_refusals", lab("""
    SELECT question_id, CASE kind WHEN 20 THEN 'internal process' WHEN 21 THEN 'unknown entity' WHEN 22 THEN 'unknown metric' END AS reason,
           CASE kind WHEN 21 THEN '光明国际机场' WHEN 22 THEN '靠桥率' END AS word FROM lab2"""))
def lab_refusals(t):
    """LAB-11: the three refusal gates."""
    return L.refusals(labelled(t), answerable(t))


@plan("lab_nearest_names", oracle("", """
    SELECT word, array_to_string(list_transform(list_sort(list({'r': -r, 'n': n}) FILTER (r >= 0.45))[1:3], lambda x: x.n), '/') AS near
    FROM (SELECT word, n, 1 - levenshtein(word, n) / greatest(length(word), length(n)) AS r
          FROM (SELECT DISTINCT replace(c_name, 'Customer#0000', 'NATION_') AS word FROM customer), (SELECT n_name AS n FROM nation)) GROUP BY 1"""))
def lab_nearest_names(t):
    """LAB-12: up to three known names near an unknown one."""
    words = t.customer.select(F.replace("c_name", F.lit("Customer#0000"), F.lit("NATION_")).alias("word"))
    return L.nearest_names(words, t.nation.select("n_name"))


@plan("lab_name_hints", oracle("", """
    SELECT word, CASE WHEN same IS NOT NULL THEN 'same city' WHEN near <> '' THEN 'near' ELSE 'none' END AS basis, coalesce(same, near) AS names FROM (
      SELECT word, string_agg(n, '/' ORDER BY n) FILTER (contains(n, word[1:4])) AS same,
             coalesce(array_to_string(list_transform(list_sort(list({'r': -r, 'n': n}) FILTER (r >= 0.45))[1:3], lambda x: x.n), '/'), '') AS near
      FROM (SELECT word, n, 1 - levenshtein(word, n) / greatest(length(word), length(n)) AS r
            FROM (SELECT DISTINCT p_name AS word FROM part UNION SELECT DISTINCT replace(n_name, 'NATION_', 'NATIO-') FROM nation UNION SELECT DISTINCT r_name FROM region),
                 (SELECT n_name AS n FROM nation UNION SELECT DISTINCT p_type FROM part)) GROUP BY 1)"""))
def lab_name_hints(t):
    """LAB-12: names of the same city, else near names, for every unknown name."""
    words = t.part.select(F.col("p_name").alias("word")).union(t.nation.select(F.replace("n_name", F.lit("NATION_"), F.lit("NATIO-")))).union(t.region.select("r_name"))
    return L.name_hints(words, t.nation.select("n_name").union(t.part.select("p_type")), 4)


@plan("lab_word_periods", oracle("chunk", """
    SELECT word, concat(min(period), '~', max(period)) AS span, count(DISTINCT period) AS n_periods FROM (
      SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark) JOIN chunk ON contains(text, word) GROUP BY 1"""))
def lab_word_periods(t):
    """LAB-12: the periods in which an unknown word does occur."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return L.word_periods(words, V.chunk(t))


@plan("lab_ambiguous_extreme", oracle("metric_score members", """
    SELECT period, entity, first(metric ORDER BY h, metric) AS by_score, first(metric ORDER BY d_tier, metric) AS by_gap,
           first(metric ORDER BY h, metric) <> first(metric ORDER BY d_tier, metric) AS clarify FROM dev GROUP BY 1, 2""", dev=DEV))
def lab_ambiguous_extreme(t):
    """LAB-13: two readings of "weakest"."""
    return L.ambiguous_extreme(R.with_deviations(V.metric_score(t), V.members(t)))


@plan("lab_headline_default", lab("""
    SELECT question_id, CASE WHEN kind IN (0, 11, 17) THEN 'explicit' WHEN kind IN (2, 3, 6, 8, 10, 12, 16) THEN 'ranked'
        WHEN kind = 18 THEN 'default' WHEN kind IN (1, 7, 9, 14, 23, 24, 21, 5) THEN (CASE WHEN kind IN (7, 5, 21) THEN 'cannot_tell' ELSE 'explicit' END)
        ELSE 'cannot_tell' END AS headline FROM lab2"""))
def lab_headline_default(t):
    """LAB-14: is the headline score meant?"""
    q = labelled(t)
    return q.select("question_id", L.headline_default(F.col("text"), F.size("entities") > 0).alias("headline"))


@plan("lab_premise", oracle("score members", f"""
    SELECT question_id, claimed, actual, CASE WHEN claimed = actual THEN 'agrees' WHEN actual = 'equal' THEN 'equal' ELSE 'contradicted' END AS verdict, above / 100.0 AS above_tier
    FROM (SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 2 = 0 THEN 'down' ELSE 'up' END AS claimed,
                 CASE WHEN b.h > a.h THEN 'up' WHEN b.h < a.h THEN 'down' ELSE 'equal' END AS actual, b.h - tm.mh AS above
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN members ON entity = n_name
          JOIN score a ON a.entity = n_name AND a.period = concat(year(o_orderdate) - 1, 'Q', quarter(o_orderdate))
          JOIN score b ON b.entity = n_name AND b.period = concat(year(o_orderdate), 'Q', quarter(o_orderdate))
          JOIN (SELECT period, tier, {half_up('sum(h)', 'count(*)')} AS mh FROM score JOIN members USING (entity) GROUP BY 1, 2) tm
            ON tm.period = b.period AND tm.tier = members.tier)"""))
def lab_premise(t):
    """LAB-15: a claimed rise or fall against the scores, with the tier beside it."""
    k = F.col("question_id")
    q = V.question(t).select("question_id", F.col("e").alias("entity"), F.array("p2", "p").alias("periods"),
                             F.when(k % 2 == 0, F.concat("p", F.lit("为什么下降"))).otherwise(F.concat("p", F.lit("进步了吗"))).alias("text"))
    return L.check_premise(q, V.score(t), V.members(t)).select("question_id", "claimed", "actual", "verdict", *dbl("above_tier"))


@plan("lab_verify_search", lab("""
    SELECT question_id, CASE WHEN len(targets) = 0 OR len(entities) = 0 THEN 'not applicable' WHEN d.doc_id IS NULL THEN 'no hits'
           WHEN NOT regexp_matches(d.text, '[0-9]') THEN 'no number' ELSE 'ok' END AS status
    FROM lab2 LEFT JOIN documents d ON d.doc_id = question_id // 8 AND question_id % 3 > 0"""))
def lab_verify_search(t):
    """LAB-16: did a search for a number bring one back? (one document stands for the hits of eight questions)"""
    hits = V.question(t).filter("question_id % 3 > 0").select("question_id", F.expr("question_id div 8").alias("doc_id")).join(
        t.documents.select("doc_id", "text"), "doc_id").select("question_id", "text")
    return L.verify_search(labelled(t), hits)


@plan("lab_phrasing_flags", lab("SELECT question_id, kind = 6 AS multi_step, false AS preference FROM lab2"))
def lab_phrasing_flags(t):
    """LAB-19: several steps, or a preference."""
    return V.question(t).select("question_id", L.phrasing_flags(F.col("text")).alias("f")).select("question_id", "f.multi_step", "f.preference")


@plan("lab_hard_limits", oracle("question", """
    SELECT question_id, array_to_string(CASE WHEN question_id % 3 = 0 THEN [concat(n, '000万-1500万'), '权属声明'] WHEN question_id % 3 = 1 THEN [concat(n, '000万级以上')] ELSE [] END, '/') AS limits
    FROM question"""))
def lab_hard_limits(t):
    """LAB-17: literal limits in a question."""
    k = F.col("question_id") % 3
    text = F.when(k == 0, F.concat("n", F.lit("000万-1500万级和1 权属声明"))).when(k == 1, F.concat("p", F.lit(" "), "n", F.lit("000万级以上有谁"))).otherwise(F.col("e"))
    return V.question(t).select("question_id", F.array_join(L.hard_limits(text), "/").alias("limits"))


@plan("lab_requirement", oracle("question", """
    SELECT question_id, CASE WHEN question_id % 2 = 0 THEN concat(n, '000万级以上') END AS tier, CASE question_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 1 END AS n FROM question"""))
def lab_requirement(t):
    """LAB-23: tier and the largest N of a ranked question."""
    k = F.col("question_id")
    words = F.array(*[F.lit(w) for w in ("第一和前三名", "前五", "第一", "全部")])[(k % 4).cast("int")]
    text = F.concat(F.when(k % 2 == 0, F.concat("n", F.lit("000万级以上"))).otherwise(F.lit("")), words)
    return V.question(t).select("question_id", L.ranked_requirement(text).alias("r")).select("question_id", "r.tier", "r.n")


ANSWERS = {
    "ranked2": "SELECT *, row_number() OVER (PARTITION BY period ORDER BY h DESC, entity) AS row_no, min(h) OVER (PARTITION BY period) AS low FROM score",
    "tiers": f"SELECT period, tier, {half_up('sum(h)', 'count(*)')} / 100.0 AS tier_mean FROM score JOIN members USING (entity) GROUP BY 1, 2",
    "ok": "SELECT * FROM gated WHERE route = 'sql'",
    "each": """SELECT question_id, kind, m, unnest(targets) AS period, e AS entity FROM ok WHERE len(entities) = 1 UNION ALL
        SELECT question_id, kind, m, p, e FROM ok WHERE kind IN (16, 17) UNION ALL SELECT question_id, kind, m, p2, e2 FROM ok WHERE kind = 16 UNION ALL
        SELECT question_id, kind, m, p, e2 FROM ok WHERE kind = 17""",
    "ans": """SELECT question_id, 'metadata' AS kind, p AS period, unnest(['sample_n', 'entity_n', 'l1_n', 'l2_n']) AS subject, CAST(unnest([sample_n, entity_n, l1_n, l2_n]) AS DOUBLE) AS value, NULL AS source
        FROM ok JOIN period_meta_q ON period = p WHERE kind = 4 UNION ALL
        SELECT question_id, 'metric', x.period, x.entity, score, source FROM each x JOIN metric_score s ON s.period = x.period AND s.entity = x.entity AND s.metric = m WHERE kind = 1 UNION ALL
        SELECT question_id, 'all_metrics', x.period, s.metric, score, source FROM each x JOIN metric_score s ON s.period = x.period AND s.entity = x.entity WHERE kind = 7 UNION ALL
        SELECT question_id, 'top_n', p, entity, score, source FROM ok JOIN ranked2 ON period = p AND row_no <= n WHERE kind = 2 UNION ALL
        SELECT question_id, 'tier_mean', p, tiers.tier, tier_mean, NULL FROM ok JOIN tiers ON period = p AND tiers.tier = t WHERE kind = 5 UNION ALL
        SELECT question_id, 'tier_of', x.period, tier, score, source FROM each x JOIN score s ON s.period = x.period AND s.entity = x.entity JOIN members ON members.entity = x.entity WHERE kind = 3 UNION ALL
        SELECT question_id, 'tier_list', p, s.entity, score, source FROM ok JOIN score s ON s.period = p JOIN members mm ON mm.entity = s.entity AND mm.tier = t WHERE kind = 6 UNION ALL
        SELECT question_id, 'lowest', p, entity, score, source FROM ok JOIN ranked2 ON period = p AND h = low WHERE kind = 8 UNION ALL
        SELECT question_id, 'headline', x.period, x.entity, score, source FROM each x JOIN score s ON s.period = x.period AND s.entity = x.entity WHERE kind NOT IN (1, 3, 7)""",
}
VIEWS = "question score metric_score members period_meta_q"


def answers(t, out=None):
    V.keep_cells(t)
    s, m = V.score(t), V.members(t)
    return L.answer_questions(routed(t) if out is None else out, m.select("entity"), s, V.metric_score(t), m, V.period_meta_q(t))


@plan("lab_answers", lab("SELECT * FROM ans", VIEWS, **ANSWERS))
def lab_answers(t):
    """LAB-20: answer lines of every question, one join pipeline per kind."""
    return answers(t)


@plan("lab_comparison_lines", lab("""
    SELECT question_id, abs(d) / 100.0 AS difference, CASE WHEN d > 0 THEN hi WHEN d < 0 THEN lo ELSE 'equal' END AS higher FROM (
      SELECT question_id, CAST(round((arg_max(value, concat(period, subject)) - arg_min(value, concat(period, subject))) * 100) AS BIGINT) AS d,
             max(concat(period, ' ', subject)) AS hi, min(concat(period, ' ', subject)) AS lo FROM ans WHERE kind = 'headline' GROUP BY 1 HAVING count(*) = 2)""", VIEWS, **ANSWERS))
def lab_comparison_lines(t):
    """LAB-21: difference and the higher one where two values were found."""
    return L.comparison_lines(answers(t))


@plan("lab_lookup_outcome", lab("""
    SELECT question_id, CASE WHEN k_lines > 0 THEN 'ok' WHEN route = 'refuse' AND reason = 'no period' THEN 'incomplete' WHEN route = 'refuse' THEN 'not covered'
           WHEN route <> 'sql' OR kind = 23 OR (kind = 24 AND len(entities) = 0) THEN 'cannot answer' ELSE 'nothing found' END AS status,
           array_to_string(targets, '/') AS used_periods, array_to_string(entities, '/') AS used_entities, metric AS used_metric
    FROM gated LEFT JOIN (SELECT question_id, count(*) AS k_lines FROM ans GROUP BY 1) USING (question_id)""", VIEWS, **ANSWERS))
def lab_lookup_outcome(t):
    """LAB-22: status of every lookup with the parameters it used."""
    out = routed(t)
    return L.lookup_outcome(out, answers(t, out))


@plan("lab_turn_outcome", oracle("", """
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'not applicable' WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) > 0 OR role = 'system' THEN 'answered' ELSE 'no answer' END AS outcome
    FROM conversations"""))
def lab_turn_outcome(t):
    """LAB-24: answered, no answer, or nothing attempted."""
    digits = F.regexp_replace("text", "[^0-9]", "")
    results = F.when(F.col("role") == "user", F.array().cast("array<string>")).when(F.col("role") == "system", F.array(F.lit(None), F.col("text"))).otherwise(F.array(digits, F.lit(None)))
    return t.conversations.select("conv_id", "turn", L.turn_outcome(results).alias("outcome"))


@plan("lab_stated_comparison", oracle("question score", """
    SELECT question_id AS claim_id, p AS a, p2 AS b, a.score AS a_score, b.score AS b_score,
           CASE WHEN question_id % 3 = 2 OR a.h IS NULL OR b.h IS NULL THEN 'undecidable' WHEN sign(a.h - b.h) = CASE WHEN question_id % 3 = 0 THEN -1 ELSE 1 END THEN 'true' ELSE 'false' END AS verdict
    FROM question LEFT JOIN score a ON a.period = p AND a.entity = e LEFT JOIN score b ON b.period = p2 AND b.entity = e"""))
def lab_stated_comparison(t):
    """LAB-25: "A-period value below B-period value" checked on the scores."""
    word = F.array(F.lit("综合得分 < "), F.lit("高于"), F.lit("和"))[(F.col("question_id") % 3).cast("int")]
    claims = V.question(t).select(F.col("question_id").alias("claim_id"), F.col("e").alias("entity"), F.concat("p", word, "p2").alias("text"))
    return L.stated_comparison(claims, V.score(t)).select("claim_id", "a", "b", *dbl("a_score", "b_score"), "verdict")


@plan("jon_nearest_preceding", lab("""
    SELECT question_id, unnest([e, e2]) AS entity, unnest([p, p2]) AS period FROM lab2 WHERE kind = 16"""))
def jon_nearest_preceding(t):
    """JON-9: each entity takes the nearest period written before it."""
    return L.pair_mentions(labelled(t), V.members(t).select("entity"))
