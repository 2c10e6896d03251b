"""Questions are labelled, and terms scored, where their texts lie."""

import math

from plumbline.operators import label as L
from plumbline.operators import retrieval as S

NAMES = ("甲城北站", "乙城北站", "丙城南站", "丙城东站二", "城北", "大甲城北站口", "丁城西门")


def questions():
    texts = ["甲城北站的得分", "甲城北站和大甲城北站口", "北站怎么样", "甲城北站比北站", "丙城如何", "丁城的m得分", "南站2024Q1与东站二2024Q2m", "城北北站南站", "", "近二期丙城南站综合得分", "北站城北和乙城北站", None,
             "上一期大甲城北站口", "站口南站西门", "甲城北站乙城北站北站南站"]
    return [*enumerate(texts), (3, "甲城北站比北站"), (90, "南站"), (90, "南站")]


def test_mentions_in_rows_are_those_of_joins(spark):
    names = spark.createDataFrame([(n,) for n in NAMES], "entity string")
    for rows in (questions()[:15], questions()):
        q = spark.createDataFrame(rows, "question_id long, text string")
        got = L.link_entity(q, names).collect()
        assert sorted(map(str, got)) == sorted(map(str, L._link_joined(q, names, (2, 3), 2).collect()))
    by_id = {r.question_id: (r.entities, r.status) for r in got}
    assert by_id[10] == (["甲城北站", "城北", "乙城北站"], "contrast") and by_id[3] == (["甲城北站"], "unique") and by_id[4] == ([], "ambiguous") and by_id[5] == (["丁城西门"], "unique")


def test_labels_do_not_meet_by_question(spark):
    names = spark.createDataFrame([(n,) for n in NAMES if n in ("甲城北站", "丙城南站", "大甲城北站口", "丁城西门")], "entity string")  # no ending of several
    periods = spark.createDataFrame([("2024Q1",), ("2024Q2",), ("2024Q3",)], "period string")
    tiers = spark.createDataFrame([(n, "上 EAST") for n in NAMES], "entity string, tier string")
    metrics = spark.createDataFrame([("m",), ("得分",), (None,)], "metric string")
    q = spark.createDataFrame([*questions()[:15], (40, "EAST的有谁"), (None, "丙城南站")], "question_id long, text string")
    out = L.label_questions(q, periods, names, metrics, tiers, 2024, (2, 3), "(EAST|WEST)")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(question_id" not in plan and plan.count("MapInArrow") == 1
    rows = {r.question_id: r for r in out.collect()}
    assert sorted(rows) == [*range(15), 40]
    assert rows[40].tier == "上 EAST" and rows[0].tier is None and rows[9].metric == "综合得分" and rows[5].metric == "得分"
    assert rows[9].targets == ["2024Q2", "2024Q3"] and rows[9].entities == ["丙城南站"] and rows[6].explicit == ["2024Q1", "2024Q2"]


def test_gates_bring_questions_without_a_metric_into_no_one_task(spark):
    out = spark.createDataFrame([(1, "甲的靠桥率是多少", []), (2, "甲", []), (3, "甲的得分", ["甲"]), (4, None, [])], "question_id long, text string, entities array<string>")
    got = {r.question_id: (r.reason, r.word) for r in L.refusals(out, spark.createDataFrame([("得分",)], "word string")).collect()}
    assert got == {1: ("unknown metric", "靠桥率"), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_terms_are_scored_where_the_texts_lie(spark):
    texts = {1: "abc def abc", 2: "def def ghi", 3: "nothing here", 4: "abcabc x"}
    rows = [(i, "2024Q1", len(x), x) for i, x in texts.items()]
    asked = spark.createDataFrame([(10, "abc def"), (11, "DEF zzz"), (12, "zzz")], "query_id long, phrase string")

    def expected(rows):
        n, mean, out = len(rows), sum(max(r[2] - 2, 0) for r in rows) / len(rows), {}
        for query, terms in ((10, ("abc", "def")), (11, ("def",))):
            for term in terms:
                df = sum(term in r[3] for r in rows)
                for r in rows:
                    if tf := r[3].count(term):
                        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
                        score = idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * max(r[2] - 2, 0) / mean))
                        out[query, r[0]] = max(score, out.get((query, r[0]), 0))
        return out

    for some in (rows, [*rows, rows[0], rows[0]]):  # an id in several rows
        chunks = spark.createDataFrame(some, "chunk_id long, period string, n_chars int, text string")
        found = S.term_scores(chunks, asked)
        got = {(r.query_id, r.id): r.bm25 for r in found.collect()}
        want = expected(some)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
        assert found.count() == len(want)
    plan = S.term_scores(spark.createDataFrame(rows, "chunk_id long, period string, n_chars int, text string"), asked)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(query_id" not in plan
