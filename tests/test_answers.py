"""Answer lines of questions that name no entity."""

from plumbline.operators import label as L


def test_lists_without_an_entity(spark):
    rows = [(i, f"e{i}", 1.0 * i) for i in range(8)]
    score = spark.createDataFrame([("2024Q1", e, s, f"2024Q1-P{i:02d}") for i, e, s in rows], "period string, entity string, score double, source string")
    metric = spark.createDataFrame([("2024Q1", "靠桥率", e, 10 - s, f"2024Q1-P{i + 20}") for i, e, s in rows], "period string, metric string, entity string, score double, source string")
    members = spark.createDataFrame([(e, "t") for _, e, _ in rows], "entity string, tier string")
    meta = spark.createDataFrame([("2024Q1", 100)], "period string, sample_n long")
    asked = [(1, "2024Q1靠桥率怎么样", "靠桥率"), (2, "2024Q1靠桥率最低的", "靠桥率"), (3, "2024Q1综合得分情况", "综合得分"), (4, "2024Q1怎么样", None)]
    routed = spark.createDataFrame([(i, t, "sql", m, None, [], ["2024Q1"], [], "none", ["2024Q1"]) for i, t, m in asked],
                                   "question_id int, text string, route string, metric string, tier string, entities array<string>, targets array<string>, refs array<string>, entity_status string, explicit array<string>")
    score = score.withColumn("score", score.score.cast("decimal(6,2)"))
    metric = metric.withColumn("score", metric.score.cast("decimal(6,2)"))
    got = {}
    for r in L.answer_questions(routed, members.select("entity"), score, metric, members, meta).collect():
        got.setdefault((r.question_id, r.kind), []).append((-r.value, r.subject))
    assert {k: [s for _, s in sorted(v)] for k, v in got.items()} == {
        (1, "metric_list"): ["e0", "e1", "e2", "e3", "e4"], (2, "metric_list"): ["e3", "e4", "e5", "e6", "e7"], (3, "headline_list"): ["e7", "e6", "e5", "e4", "e3"]}


def test_citations_meet_short_tables_where_they_lie(spark):
    from plumbline.operators import evaluate as E
    from plumbline.operators import extract as X
    from plumbline.session import durable

    asks = [(1, "表=综合得分;期次=2024Q1;取前=2"), (2, "表=综合得分;期次=2024Q1;机场=B;字段=排名"), (3, "表=综合得分;期次=2024Q1;机场=A"), (4, "表=meta;期次=2024Q1"),
            (5, "表=指标得分;期次=2024Q1;指标=m;机场=A"), (6, "表=综合得分;期次=2024Q1;取前=0"), (3, "表=综合得分;期次=2024Q1;机场=A")]
    clauses = durable(X.parse_citations(spark.createDataFrame(asks, "question_id long, citation string")))
    ranked = durable(spark.createDataFrame([("2024Q1", "A", 4.5, 1, "x"), ("2024Q1", "B", 4.0, 2, "y"), ("2024Q1", "C", 3.0, 3, "z")], "period string, entity string, score double, row_no int, source string"))
    metric = durable(spark.createDataFrame([("2024Q1", "m", "A", 2.25)], "period string, metric string, entity string, score double"))
    meta = durable(spark.createDataFrame([("2024Q1", 30, 3)], "period string, sample_n int, entity_n int"))
    found = E.lookup_citations(clauses, ranked, metric, meta)
    got = sorted((r.question_id, tuple(r.numbers or ()), r.names, r.problem) for r in found.collect())
    assert got == sorted([(1, ("4.5", "4"), "A/B", None), (2, ("2",), "B", None), *[(3, ("4.5",), "A", None)] * 4, (4, ("30", "3"), None, None), (5, ("2.25",), "A", None),
                          (6, (), None, "nothing found")], key=lambda x: x[0])
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 4
