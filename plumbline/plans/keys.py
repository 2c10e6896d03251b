"""Answer-key verification and challenge-set plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import evaluate as E
from plumbline.operators import extract as X
from plumbline.operators import ranking as R
from plumbline.plans.aggregates import sql_numbers
from plumbline.plans.oracle import oracle
from plumbline.plans.registry import plan
from plumbline.session import durable
from plumbline.sources import views as V


def keys(t):
    """One answer key per order: a citation of each kind, every third answer wrong, some refusals and broken citations."""
    k = F.col("question_id")
    q = V.question(t).select("question_id", "p", "e", "m").join(
        R.rank_table(V.score(t)).select(F.col("period").alias("p"), F.col("entity").alias("e"), "score", "row_no"), ["p", "e"])
    base = F.concat(F.lit("表=综合得分;期次="), "p")
    citation = (
        F.when(k % 13 == 0, F.concat(base, F.lit(";期次="), "p"))
        .when(k % 5 == 0, F.concat(base, F.lit(";机场="), "e"))
        .when(k % 5 == 1, F.concat(base, F.lit(";机场="), "e", F.lit(";字段=排名")))
        .when(k % 5 == 2, F.concat(base, F.lit(";取前=25")))
        .when(k % 5 == 3, F.concat(F.lit("表=指标得分;期次=1990Q1;指标="), "m", F.lit(";机场="), "e"))
        .otherwise(F.concat(F.lit("表=meta;期次="), "p")))
    answer = (
        F.when(k % 17 == 0, "看原文").when(k % 5 == 1, F.concat(F.lit("名次 "), (F.col("row_no") + F.when(k % 3 == 0, 100).otherwise(0)).cast("string")))
        .when(k % 5 == 4, F.when(k % 3 == 0, "0.123").otherwise("25"))
        .otherwise((F.col("score") + F.when(k % 3 == 0, 77).otherwise(0)).cast("string")))
    refuse = k % 19 == 0
    return q.select("question_id", F.when(refuse, "refuse").otherwise("sql").alias("expected_route"), answer.alias("expected_answer"),
                    F.when(refuse & (k % 2 == 0), "no data").alias("refusal_reason"), citation.alias("citation"))


@plan("evl_verify_keys", oracle("question score period_meta_q", """
    SELECT k AS question_id, CASE WHEN k % 19 = 0 AND k % 2 <> 0 THEN 'to fill' WHEN k % 19 = 0 AND k % 17 <> 0 THEN 'format' WHEN k % 19 = 0 THEN 'ok'
        WHEN k % 13 = 0 THEN 'format' WHEN k % 5 = 3 THEN 'citation' WHEN k % 17 = 0 THEN 'not machine-checkable'
        WHEN k % 5 = 4 THEN CASE WHEN k % 3 > 0 AND entity_n = 25 OR k % 3 > 0 AND (sample_n = 25 OR sample_n - entity_n = 25 OR abs(entity_n - l2_n) = 25
             OR abs(sample_n - l1_n) = 25 OR abs(sample_n - l2_n) = 25 OR entity_n - l1_n = 25) THEN 'ok' ELSE 'mismatch' END
        WHEN k % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict
    FROM (SELECT question_id AS k, p, e FROM question) JOIN score ON period = p AND entity = e JOIN period_meta_q m ON m.period = p"""))
def evl_verify_keys(t):
    """EVL-1/2: answer keys against what their citations point at."""
    V.keep_cells(t)
    q = durable(keys(t))
    clauses = durable(X.parse_citations(q.select("question_id", "citation")))  # looked up, and asked for errors
    found = E.lookup_citations(clauses, R.rank_table(V.score(t)), V.metric_score(t), V.period_meta_q(t))
    return E.verify_keys(q, clauses, found)


CITED = {
    1: "chunk={source},{period}-P01", 2: "chunk={source},1990Q1-P01", 3: "chunk=多版本;页码={page}", 4: "chunk=多版本;页码={page};分界=1995Q1", 5: "chunk=多版本;页码={page};分界=1995",
    6: "表=meta;期次={period};字段=样本量,机场数", 7: "表=meta;期次={period};字段=名次", 8: "表=综合得分;期次={period};机场={entity};字段=排名", 9: "表=综合得分;期次={period};机场=NAT",
    10: "表=综合得分;期次={period};机场=Nowhere", 11: "表=综合得分;期次={period};取前=3", 12: "表=综合得分;期次={period};取前=x", 13: "表=指标得分;期次={period};指标=1-UR",
    14: "表=指标得分;期次={period}", 15: "期次={period}", 16: "表=指标得分;期次={period};指标=1-URGENT;机场={entity}",
}


def _cited(kind: int, numbers: str = "NULL", names: str = "NULL", problem: str = "NULL", note: str = "''", rest: str = "") -> str:
    return f"""SELECT concat(s.source, '#{kind}') AS question_id, array_to_string({numbers}, ',') AS numbers, {names} AS names, {problem} AS problem, {note} AS note
        FROM pg s {rest}"""


def _cited_sql() -> str:
    score, merged = sql_numbers("printf('%.2f', s.score)"), "list_sort(list_distinct(list_concat(s.nums, o.nums)))"
    best = "LEFT JOIN (SELECT period, list_sort(list(entity)) AS e, first(score) AS score FROM (SELECT *, max(h) OVER (PARTITION BY period) AS top FROM metric_score WHERE metric = '1-URGENT') WHERE h = top GROUP BY 1) m USING (period)"
    every = "JOIN (SELECT page, list_sort(list_distinct(flatten(list(nums)))) AS nums, count(DISTINCT text) AS v, count(*) FILTER (period < '1995Q1') AS b, count(*) FILTER (period >= '1995Q1') AS a FROM pg GROUP BY 1) o USING (page)"
    top = "JOIN (SELECT period, list(score ORDER BY row_no) AS x, string_agg(entity, '/' ORDER BY row_no) AS e FROM ranked WHERE row_no <= 3 GROUP BY 1) r USING (period)"
    parts = [
        _cited(1, f"CASE WHEN o.source IS NOT NULL THEN {merged} END", problem="CASE WHEN o.source IS NULL THEN 'unknown page' END", rest="LEFT JOIN pg o ON o.source = concat(s.period, '-P01')"),
        _cited(2, problem="'unknown page'"), _cited(3, "o.nums", note="concat(v, ' versions')", rest=every), _cited(4, "o.nums", note="concat(b, ' before, ', a, ' after')", rest=every),
        _cited(5, problem="'bad boundary'"),
        _cited(6, "list_sort(list_distinct([CAST(sample_n AS VARCHAR), CAST(entity_n AS VARCHAR)]))", rest="JOIN period_meta_q USING (period)"),
        _cited(7, problem="'unknown field'"), _cited(8, "[CAST(row_no AS VARCHAR)]", "s.entity", rest="JOIN ranked r ON r.period = s.period AND r.entity = s.entity"),
        _cited(9, problem="'ambiguous entity'"), _cited(10, problem="'unknown entity'"),
        _cited(11, "list_sort(list_distinct(list_transform(r.x, lambda y: " + sql_numbers("printf('%.2f', y)") + "[1])))", "r.e", rest=top),
        _cited(12, problem="'bad number'"),
        _cited(13, "CASE WHEN m.e IS NOT NULL THEN " + sql_numbers("printf('%.2f', m.score)") + " END", "array_to_string(m.e, '/')", "CASE WHEN m.e IS NULL THEN 'nothing found' END",
               "'1-UR = 1-URGENT'", best),
        _cited(14, problem="'no metric'"), _cited(15, problem="'no table'"),
        _cited(16, "CASE WHEN m.score IS NOT NULL THEN " + sql_numbers("printf('%.2f', m.score)") + " END", "m.entity", "CASE WHEN m.score IS NULL THEN 'nothing found' END",
               rest="LEFT JOIN (SELECT * FROM metric_score WHERE metric = '1-URGENT') m ON m.period = s.period AND m.entity = s.entity"),
    ]
    return " UNION ALL ".join(parts)


def score_pages(t):
    """A page for every score: its id, quarter, number and text."""
    s = V.score(t)
    return s.select(F.col("source").alias("chunk_id"), "period", "entity", F.regexp_extract("source", r"P(\d+)$", 1).cast("int").alias("page_no"),
                    F.concat_ws(" ", "entity", F.col("score").cast("string")).alias("text"))


@plan("evl_citation_lookup", oracle("score ranked metric_score period_meta_q", _cited_sql(),
                                    pg=f"SELECT source, period, entity, score, nk + 1 AS page, concat(entity, ' ', printf('%.2f', score)) AS text, {sql_numbers("concat(entity, ' ', printf('%.2f', score))")} AS nums FROM score"))
def evl_citation_lookup(t):
    """EVL-2: a citation of every kind, right and wrong, for every score of every period."""
    pages = durable(score_pages(t))
    cell = {"{source}": "chunk_id", "{period}": "period", "{entity}": "entity", "{page}": "page_no"}

    def citation(text: str):
        out = F.lit(text)
        for mark, column in cell.items():
            out = F.replace(out, F.lit(mark), F.col(column).cast("string"))
        return out

    every = F.array(*[F.struct(F.lit(str(k)).alias("kind"), citation(c).alias("citation")) for k, c in CITED.items()])
    asks = pages.select("chunk_id", F.inline(every)).select(F.concat_ws("#", "chunk_id", "kind").alias("question_id"), "citation")
    found = E.lookup_citations(X.parse_citations(asks), R.rank_table(V.score(t)), V.metric_score(t), V.period_meta_q(t), pages)
    return found.select("question_id", F.array_join(F.array_sort(F.array_distinct("numbers")), ",").alias("numbers"), "names", "problem", "note")


PATTERN = r"[A-Z][a-z]{4,}|\d{3,}"
CHALLENGE = {
    "found": f"SELECT DISTINCT chunk_id, period, unnest(regexp_extract_all(text, '(?:^|[^\\p{{L}}])({PATTERN})', 1)) AS phrase FROM chunk",
    "firsts": "SELECT phrase, min(chunk_id) AS page, arg_min(period, chunk_id) AS period FROM found WHERE length(phrase) BETWEEN 2 AND 14 GROUP BY 1 HAVING count(*) <= 3",
    "rare": "SELECT phrase, page, f.period, md5(concat('7|', phrase)) AS o FROM firsts f WHERE (SELECT count(*) FROM chunk c WHERE contains(c.text, f.phrase)) <= 3",
    "picked": "SELECT * FROM rare ORDER BY o, phrase LIMIT 40",
    "staged": f"""SELECT *, coalesce(lead(phrase) OVER w, lag(phrase) OVER w, phrase) AS nb, left(phrase, CAST(greatest(4, ceil(length(phrase) / 2)) AS INT)) AS half,
        {list(E.ASKS)}[CAST(concat('0x', o[1:4]) AS INT) % 4 + 1] AS template FROM picked WINDOW w AS (ORDER BY phrase)""",
    "options": r"""SELECT phrase, place, counter FROM (
        SELECT phrase, 0 AS place, CASE WHEN regexp_matches(phrase, '\d') THEN concat(regexp_extract(phrase, '^(\D*)', 1), CAST(regexp_extract(phrase, '(\d+)', 1) AS BIGINT) + 700,
               regexp_extract(phrase, '^\D*\d+(.*)$', 1)) END AS counter FROM staged UNION ALL
        SELECT phrase, 1, concat(half, substring(nb, length(nb) // 2 + 1)) FROM staged UNION ALL SELECT phrase, 2, concat('ZZ', reverse(phrase)) FROM staged)
        WHERE counter IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunk WHERE contains(lower(text), lower(counter)))""",
    "kinds": """SELECT phrase, period, template, 'real' AS category, phrase AS asked, page AS expected_page FROM staged UNION ALL
        SELECT phrase, period, template, 'short', half, page FROM staged WHERE length(half) < length(phrase) AND half IN (SELECT half FROM staged GROUP BY 1 HAVING count(*) = 1) UNION ALL
        SELECT phrase, period, template, 'false', counter, NULL FROM staged JOIN (SELECT phrase, arg_min(counter, place) AS counter FROM options GROUP BY 1) USING (phrase)""",
}


@plan("evl_challenge_set", oracle("chunk", """
    SELECT phrase, category, asked, replace(replace(template, '{period}', period), '{phrase}', asked) AS question, expected_page FROM kinds""", **CHALLENGE))
def evl_challenge_set(t):
    """EVL-13: forty distinctive phrases by seeded hash, asked whole, shortened, and falsified into what no page says."""
    return E.challenge_set(V.chunk(t), PATTERN, "7", 40)
