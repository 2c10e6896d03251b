"""Cleaning, extraction, matching and audits on small pages."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.numbers import answer_numbers, canonical_numbers, numeral
from plumbline.operators import audit as A
from plumbline.operators import clean as C
from plumbline.operators import extract as X
from plumbline.operators import matching as M
from plumbline.operators import versions as V
from plumbline.operators.combine import explain_differences


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first().x


def test_wraps_footers_and_lists(spark):
    raw = "第一行\n续行\n（1）项目\n 12 \n页\n• 点\nCopyright X\nSource: Y\n末"
    own = (r"^Source: Y$",)  # a source line is a footer only where the publisher is named
    assert one(spark, raw, C.merge_wraps(F.col("text"), own)) == "第一行续行\n（1）项目\n• 点末"
    assert one(spark, raw, C.strip_footers(F.col("text"), own)) == "第一行\n续行\n（1）项目\n• 点\n末"
    assert "Source: Y" in one(spark, raw, C.strip_footers(F.col("text")))


def test_vertical_names_and_two_layouts(spark):
    assert one(spark, "深\n圳\n宝\n安", C.join_vertical(F.col("text"))) == "深圳宝安"
    a = "9\n页\n4.28 4.27\n平均, 4.15\n北\n京\n机\n场\n深\n圳\n机\n场"
    b = "4.28\n4.27\n平均\n：4.11\n北京机场深圳机场"
    for raw in (a, b):
        assert one(spark, raw, C.repair_score_table(F.col("text"))) == "北京机场 4.28\n深圳机场 4.27"
    assert one(spark, "4.28\n平均, 4.1\n北京机场深圳机场", C.repair_score_table(F.col("text"))) is None


def test_numbers(spark):
    assert one(spark, "共 205,164 份，4.20 与 7.00，1,2345", canonical_numbers(F.col("text"))) == ["1", "205164", "2345", "4.2", "7"]
    assert one(spark, "2023Q3 得 4.14，排名第一", answer_numbers(F.col("text"))) == ["1", "4.14"]
    assert [one(spark, s, numeral(F.col("text"))) for s in ("两", "十", "十二", "7", "百")] == [2, 10, 12, 7, None]


def test_difference_is_explained(spark):
    df = spark.createDataFrame([(["0.05", "9"], ["4.15", "4.2", "4.3"])], "miss array<string>, have array<string>")
    r = explain_differences(df, "miss", "have").first()
    assert r.derived == ["0.05=4.2-4.15"] and r.still_missing == ["9"]


def test_glyphs_and_meta(spark):
    pages = spark.createDataFrame([(1, "ab")], "k int, raw string")
    assert [r.n for r in C.unmapped_glyphs(pages, "k").collect()] == [1]
    assert one(spark, "6项一级指标，一级指标 6 项", X.pick_one(C.squash(F.col("text")), X.META["l1_n"]))["status"] == "ok"
    assert one(spark, "6项一级指标，一级指标7项", X.pick_one(F.col("text"), X.META["l1_n"]))["status"] == "conflict"


def test_duplicate_citation_key_is_an_error(spark):
    asks = spark.createDataFrame([(1, "表=a;期次=b;表=c"), (2, "表＝a；期次：b | chunk=2024Q2-P05"), (3, "R_2024Q2_报告P5"), (4, "")], "question_id int, citation string")
    got = [(r.question_id, r.error, r.fields) for r in X.parse_citations(asks).orderBy("question_id", "clause_no").collect()]
    assert got == [(1, "repeated key", None), (2, None, {"表": "a", "期次": "b"}), (2, None, {"chunk": "2024Q2-P05"}), (3, None, {"chunk": "2024Q2-P05"}), (4, "empty", None)]


def test_phrases_against_brute_force(spark):
    rnd = random.Random(5)
    texts = [(i, "".join(rnd.choice("ab 中ß") for _ in range(rnd.randint(0, 90)))) for i in range(60)]
    texts.append((99, "x" * 40 + "a long phrase of many characters" + "x"))
    texts = [(i, t + "|a hot phrase that is everywhere|") for i, t in texts] + [(500, ""), (501, None)]
    words = sorted({t[j : j + n] for _, t in texts if t for j, n in ((0, 1), (3, 2), (5, 3), (2, 5), (1, 17), (4, 30), (2, 40)) if t[j : j + n]} | {"a hot phrase that is everywhere"})
    want = sorted((i, w, p + 1) for i, t in texts if t for w in words for p in range(len(t)) if t.startswith(w, p))
    for chosen in (words, [w for w in words if len(w) > 16], [w for w in words if len(w) == 1], []):
        before = spark.sparkContext.statusTracker().getJobIdsForGroup()
        hits = M.phrase_positions(spark.createDataFrame(texts, "text_id int, text string"),
                                  spark.createDataFrame([(w, w) for w in chosen], "phrase_id string, phrase string"), fold_case=False)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before  # no job while the plan is built
        assert sorted((r.text_id, r.phrase_id, r.pos) for r in hits.collect()) == [x for x in want if x[1] in set(chosen)]


def test_one_space_is_the_same_version(spark):
    chunks = spark.createDataFrame([(1, "2023Q3", "叙述页", "指标 2023Q3 共6项"), (2, "2024Q1", "叙述页·x", "指标2024Q1共6项"), (3, "2024Q2", "叙述页", "指标共7项")],
                                   "chunk_id long, period string, page_kind string, text string")
    assert sorted((r.rep_id, r.members) for r in V.version_groups(chunks).collect()) == [(1, 2), (3, 1)]


def test_audits(spark):
    rows = [(1, "得分 4.20（出处: 2025Q4-P09）", ["2025Q4-P09"], "A 4.20", ["A"]), (2, "相差 0.05，第 3 名", [], "4.15 4.20", []),
            (3, "得分 5（出处: 2025Q4-P10）", ["2025Q4-P09"], "4", []), (4, "桂林两江机场最好，哪些机场差", [], "无", []), (5, "材料里没有", [], "靠桥率 3", ["靠桥率"])]
    df = spark.createDataFrame(rows, "answer_id int, answer string, sources array<string>, source_text string, terms array<string>")
    got = {r.answer_id: r.failure for r in A.diagnose(df).collect()}
    assert got == {1: None, 2: None, 3: "invented number", 4: "invented entity", 5: "said missing but present"}


def test_segments_are_attributed(spark):
    body = "the quick brown fox jumps over the lazy dog today"
    chunks = spark.createDataFrame([(1, body), (2, "a wholly different page about other things entirely")], "chunk_id long, text string")
    answers = spark.createDataFrame([(7, "the quick brown fox jumps\na wholly different page\nnothing like these at all", 1)], "answer_id int, answer string, expected long")
    given = spark.createDataFrame([(7, 1), (7, 2)], "answer_id int, chunk_id long")
    assert [r.kind for r in A.attribute_segments(answers, given, chunks).orderBy("segment_no").collect()] == ["expected", "other page", "ungrounded"]


def test_titles_meet_official_names_without_a_broadcast_of_rows(spark):
    titles = spark.createDataFrame([(1, "big red"), (2, "red"), (3, "blue"), (4, None), (4, "big red"), (None, "red")], "page_id long, candidate string")
    official = spark.createDataFrame([("red",), ("big red",), ("red",), ("e",), (None,)], "metric string")
    found = X.metric_of_title(titles, official)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, "big red", "ok"), (2, "red", "ok"), (3, "e", "ok"), (4, "big red", "ok"), (4, "big red", "ok"), (None, None, "none")], key=str)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()  # only the one row of lengths is sent


def test_official_lists_of_any_length(spark):
    from plumbline.plans.text import SENTENCE
    long = "Aa" + ", bb" * 200_000
    docs = spark.createDataFrame([(1, f"{long}.\nAa bb, cc.\nAa bb"), (2, "Aa, bb,. Cc.")], "doc int, text string")
    rows = {r.doc: r for r in X.official_lists(docs, SENTENCE, "[, ]").collect()}
    assert (rows[1].n_lists, rows[1].n_sets, rows[1].agrees) == (2, 2, False) and 2 not in rows


def test_pairs_fetch_texts_of_unlike_contents_only(spark):
    rows = [(1, "2020Q1", "a", "the quick brown fox"), (2, "2020Q2", "a", "the quick brown  fox"), (3, "2020Q3", "a", "the quick brown cat"), (4, "2020Q4", "b", "the quick brown fox"),
            (5, "2020Q1", "a", None), (6, "2020Q1", "a", "tiny"), (7, "2020Q2", "a", "wee"), (8, "2020Q1", "a", "the quick brown fox"), (8, "2020Q2", "a", "the quick brown cat")]
    chunks = spark.createDataFrame(rows, "chunk_id long, period string, page_kind string, text string")
    pairs = spark.createDataFrame([(w, w, g) for w, g in ((1, 2), (1, 3), (1, 4), (1, 5), (6, 7), (8, 3), (2, 8), (1, 9))], "question_id long, want long, got long")
    compared = V.compare_pages(pairs, chunks, "want", "got", ["page_kind"])
    found = sorted((r.want, r.got, r.p1, r.p2, r.similarity is not None and round(r.similarity, 6)) for r in compared.collect())
    near = round(6 / 12, 6)  # "thequickbrownfox" and "thequickbrowncat" share 6 of 12 shingles
    assert found == [(1, 2, "2020Q1", "2020Q2", 1.0), (1, 3, "2020Q1", "2020Q3", near), (1, 5, "2020Q1", "2020Q1", False), (2, 8, "2020Q2", "2020Q1", 1.0),
                     (2, 8, "2020Q2", "2020Q2", near), (6, 7, "2020Q1", "2020Q2", 1.0), (8, 3, "2020Q1", "2020Q3", near), (8, 3, "2020Q2", "2020Q3", 1.0)]
    plan = compared._jdf.queryExecution().executedPlan().toString()
    shuffled = [x for x in plan.splitlines() if "array<string>" in x]
    assert "Exchange" in plan and not shuffled and not any("Exchange" in x and ("s1#" in x or "s2#" in x) for x in plan.splitlines())
