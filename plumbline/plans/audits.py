"""Grounding-audit plans over one stated answer per order, with slips planted by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import combine as C
from plumbline.operators import matching as M
from plumbline.functions.numbers import canonical_numbers
from plumbline.plans.aggregates import sql_numbers
from plumbline.plans.oracle import oracle
from plumbline.operators.topk import top_n
from plumbline.plans.registry import plan
from plumbline.sources import views as V


def answers(t):
    """answer(answer_id, answer, sources, source_text, terms): every fifth number, seventh citation and eleventh name is wrong."""
    k = F.col("answer_id")
    q = V.question(t).select(F.col("question_id").alias("answer_id"), F.col("e").alias("entity"), F.col("p").alias("period"))
    s = q.join(V.score(t), ["period", "entity"])
    right = F.col("score").cast("string")
    said = F.when(k % 5 == 0, (F.col("score") + F.lit(90)).cast("string")).otherwise(right)
    cited = F.when(k % 7 == 0, "1901Q1-P99").otherwise(F.col("source"))
    tail = F.when(k % 11 == 0, "，和光明山机场一样").when(k % 11 == 1, "，哪些机场更好").otherwise("")
    full = F.concat("entity", F.lit("在"), "period", F.lit("综合得分"), said, F.lit("分，排名第 3 名（出处: "), cited, F.lit("）"), tail)
    return s.select(
        "answer_id", F.when(k % 13 == 0, "材料里没有提到").otherwise(full).alias("answer"), F.array("source").alias("sources"),
        F.concat_ws(" ", "entity", "period", right, "source").alias("source_text"), F.array("entity", F.lit("zz"), F.lit("nothing")).alias("terms"))


ANS = """SELECT question_id AS k, s.entity, s.period, s.h, s.source, question_id % 13 = 0 AS none, question_id % 5 = 0 AS num, question_id % 7 = 0 AS cit,
    question_id % 11 = 0 AS ent, concat((h + 9000) // 100, '.', lpad(CAST((h + 9000) % 100 AS VARCHAR), 2, '0')) AS wrong
    FROM question JOIN score s ON s.period = p AND s.entity = e"""


@plan("aud_invented_numbers", oracle("question score", """
    SELECT k AS answer_id, CASE WHEN NOT none AND num THEN regexp_replace(wrong, '\\.?0+$', '') ELSE '' END AS invented FROM ans""", ans=ANS))
def aud_invented_numbers(t):
    """AUD-1: stated numbers without a source."""
    return answers(t).select("answer_id", F.array_join(A.invented_numbers(F.col("answer"), F.col("source_text")), "/").alias("invented"))


@plan("aud_invented_citations", oracle("question score", "SELECT k AS answer_id, CASE WHEN NOT none AND cit THEN '1901Q1-P99' ELSE '' END AS invented FROM ans", ans=ANS))
def aud_invented_citations(t):
    """AUD-2: cited ids that were not supplied."""
    return answers(t).select("answer_id", F.array_join(A.invented_citations(F.col("answer"), F.col("sources")), "/").alias("invented"))


@plan("aud_invented_entities", oracle("question score", "SELECT k AS answer_id, CASE WHEN NOT none AND ent THEN 1 ELSE 0 END AS n_invented FROM ans", ans=ANS))
def aud_invented_entities(t):
    """AUD-3: names without a source; generic mentions pass."""
    return answers(t).select("answer_id", F.size(A.invented_entities(F.col("answer"), F.col("source_text"))).alias("n_invented"))


@plan("aud_missed_terms", oracle("question score", "SELECT k AS answer_id, CASE WHEN none THEN entity ELSE '' END AS missed FROM ans", ans=ANS))
def aud_missed_terms(t):
    """AUD-4: "not in the material" although a term is."""
    return answers(t).select("answer_id", F.array_join(A.missed_terms(F.col("answer"), F.col("terms"), F.col("source_text")), "/").alias("missed"))


def rankings(t):
    """One stated top three per order: the true list, short by its last name for every third key."""
    placed = V.score(t).join(V.members(t), "entity")
    k = F.col("question_id")
    best = top_n(placed, 3, ["period", "tier"])
    first = best.groupBy("period", "tier").agg(F.sort_array(F.collect_list(F.struct("row_no", "entity"))).alias("r"))  # three
    names = F.transform("r", lambda x: F.concat(x["entity"], F.lit("。")))
    listed = F.array_join(F.when(k % 3 == 0, F.slice(names, 1, 2)).otherwise(names), "")
    q = V.question(t).select("question_id", F.col("p").alias("period"), F.col("t").alias("tier"))
    return q.join(first, ["period", "tier"]).select(k.alias("answer_id"), "period", "tier", listed.alias("answer")), placed


RANK = {
    "pl": "SELECT *, row_number() OVER (PARTITION BY period, tier ORDER BY h DESC, entity) AS rn FROM score JOIN members USING (entity)",
    "cutoff": "SELECT *, min(h) FILTER (rn <= 3) OVER (PARTITION BY period, tier) AS cut FROM pl",
    "miss": """SELECT question_id AS answer_id, entity, score, source FROM question q JOIN cutoff c ON c.period = q.p AND c.tier = q.t
        WHERE h >= cut AND rn > CASE WHEN question_id % 3 = 0 THEN 2 ELSE 3 END
          AND len(list_filter((SELECT list(entity ORDER BY rn) FROM pl WHERE pl.period = q.p AND pl.tier = q.t AND rn <= CASE WHEN question_id % 3 = 0 THEN 2 ELSE 3 END),
              lambda x: contains(concat(x, '。'), c.entity))) = 0""",
}


@plan("aud_incomplete_rankings", oracle("question score members", "SELECT answer_id, entity, score, source FROM miss", **RANK))
def aud_incomplete_rankings(t):
    """AUD-5: ranked answers against the complete list with ties."""
    asked, placed = rankings(t)
    return A.incomplete_rankings(asked, placed, 3, ["period", "tier"]).withColumn("score", F.col("score").cast("double"))


@plan("aud_supplement", oracle("question score members", """
    SELECT q.question_id AS answer_id, coalesce(m.n, 0) AS n_added FROM question q JOIN (SELECT DISTINCT period, tier FROM pl) x ON x.period = q.p AND x.tier = q.t
    LEFT JOIN (SELECT answer_id, count(*) AS n FROM miss GROUP BY 1) m ON m.answer_id = q.question_id""", **RANK))
def aud_supplement(t):
    """AUD-6: how many items each answer gets appended."""
    asked, placed = rankings(t)
    return A.supplement(asked, A.incomplete_rankings(asked, placed, 3, ["period", "tier"])).select("answer_id", "n_added")


@plan("aud_diagnose", oracle("question score", """
    SELECT k AS answer_id, CASE WHEN none THEN 'said missing but present' WHEN num THEN 'invented number' WHEN cit THEN 'invented citation' WHEN ent THEN 'invented entity' END AS failure,
           CASE WHEN NOT none AND (num OR cit OR ent) THEN 'regenerate' END AS action FROM ans""", ans=ANS))
def aud_diagnose(t):
    """AUD-7: failure class by precedence, and its action."""
    return A.diagnose(answers(t)).select("answer_id", "failure", "action")


def holders(t):
    """(answer_id, chunk_id): documents that hold the opening of each benchmark item."""
    opening = t.benchmark.select(F.col("item_id").alias("phrase_id"), F.substring("text", 1, 30).alias("phrase"))
    hits = M.phrase_occurrences(t.documents.select(F.col("doc_id").alias("text_id"), "text"), opening, fold_case=False)
    return hits.select(F.col("phrase_id").alias("answer_id"), F.col("text_id").alias("chunk_id")).distinct()


@plan("aud_segments")
def aud_segments(t):
    """AUD-8: sentences of each benchmark item against the documents given for it."""
    given = holders(t)
    expected = given.groupBy("answer_id").agg(F.min("chunk_id").alias("expected"))
    said = t.benchmark.select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer")).join(expected, "answer_id")
    return A.attribute_segments(said, given, V.chunk(t), "[.\n]")


@plan("aud_citation_verdicts", oracle("run score", """
    SELECT question_id, CASE WHEN count(*) FILTER (known.source IS NULL) > 0 THEN 'ghost'
           WHEN count(*) FILTER (x.s <> expected_page) = 0 THEN 'expected' ELSE 'other page' END AS verdict
    FROM (SELECT question_id, expected_page, unnest(sources) AS s FROM run) x LEFT JOIN score known ON known.source = x.s GROUP BY 1"""))
def aud_citation_verdicts(t):
    """AUD-9: verdict from the cited ids alone."""
    return A.citation_verdicts(V.run(t), V.score(t))


@plan("aud_fault_detection", oracle("question score", """
    SELECT fault, count(*) AS injected, count(*) FILTER (fault = 'entity' OR NOT none) AS detected
    FROM ans, (SELECT unnest(['number', 'citation', 'entity']) AS fault) GROUP BY 1""", ans=ANS))
def aud_fault_detection(t):
    """AUD-10: injected faults found by AUD-1..3 (an answer without a number or citation offers nothing to swap)."""
    return A.detection_rates(answers(t))


@plan("aud_silent_versions", oracle("run", """
    SELECT question_id AS answer_id, count(*) AS n_specific, bool_and(NOT regexp_matches(answer, '\\d{4}Q\\d')) AS silent FROM numbers JOIN specific USING (period, number) GROUP BY 1""",
    numbers=f"SELECT question_id, period, category, answer, unnest({sql_numbers('answer')}) AS number FROM run",
    specific="""SELECT period, number FROM (SELECT period, number, count(DISTINCT category) AS n FROM numbers GROUP BY 1, 2)
        JOIN (SELECT period, count(DISTINCT category) AS k FROM numbers GROUP BY 1) USING (period) WHERE n < k"""))
def aud_silent_versions(t):
    """AUD-13: experimental version-silence probe."""
    run = V.run(t)
    numbers = run.select("period", "category", F.explode(canonical_numbers(F.col("answer"))).alias("number"))
    specific = C.version_specific(numbers, ["period"], "category", "number").select(F.col("period").alias("page"), "number")
    return A.silent_versions(run.select(F.col("question_id").alias("answer_id"), F.col("period").alias("page"), "answer"), specific)
