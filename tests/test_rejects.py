"""What can't be read is told, not dropped, and never ends the query."""

from pyspark.sql import functions as F

from plumbline.functions.numbers import canonical_numbers, numeral
from plumbline.operators import evaluate as E
from plumbline.operators import extract as X
from plumbline.operators import ranking as R
from plumbline.operators import report as P
from plumbline.sources import readers, sinks


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


def test_numbers_of_any_length(spark):
    long = "1" * 31
    assert one(spark, f"{long} and 5", canonical_numbers) == sorted([long, "5"])
    assert one(spark, f"007.50 0{long}.500 000 {'9' * 50}", canonical_numbers) == sorted(["7.5", f"{long}.5", "0", "9" * 50])
    assert one(spark, "12345678901", numeral) is None and one(spark, "12", numeral) == 12 and one(spark, "十二", numeral) == 12


def test_pages_that_cannot_be_paired(spark):
    pages = spark.createDataFrame([("2024Q1", 1, "4.50 4.20\n平均, 4.35\n甲机场 乙机场"), ("2024Q1", 2, "4.50 4.20\n平均, 4.35\n甲机场"),
                                   ("2024Q1", 3, "10000.00 4.20\n平均, 4.35\n甲机场 乙机场"), ("2024Q1", 4, "")], "period string, page_no int, raw string")
    assert {r.source for r in X.extract_pairs(pages).collect()} == {"2024Q1-P01"}
    assert {(r.source, r.reason) for r in X.rejected_pages(pages).collect()} == {
        ("2024Q1-P02", "counts differ"), ("2024Q1-P03", "score out of range"), ("2024Q1-P04", "no scores")}


def test_a_citation_with_an_unreadable_count_finds_nothing(spark):
    asks = spark.createDataFrame([(1, "表=综合得分;期次=2024Q1;取前=三"), (2, "表=综合得分;期次=2024Q1;取前=1")], "question_id int, citation string")
    ranked = spark.createDataFrame([("2024Q1", "甲", 4.5, "2024Q1-P01", 1)], "period string, entity string, score double, source string, row_no int")
    metric = spark.createDataFrame([], "period string, metric string, entity string, score double")
    meta = spark.createDataFrame([], "period string, sample_n int, entity_n int, l1_n int, l2_n int")
    got = {r.question_id: r.numbers for r in E.lookup_citations(X.parse_citations(asks), ranked, metric, meta).collect()}
    assert got == {1: None, 2: ["4.5"]}


def test_source_of_the_previous_score(spark):
    score = spark.createDataFrame([("2024Q1", "a", 4.0, "2024Q1-P07"), ("2024Q2", "a", 4.5, "2024Q2-P31")], "period string, entity string, score double, source string")
    assert {r.period: r.prev_source for r in R.with_neighbours(score).collect()} == {"2024Q1": None, "2024Q2": "2024Q1-P07"}
    d = score.withColumn("score", F.col("score").cast("decimal(6,2)"))
    metric = d.withColumn("metric", F.lit("m"))
    members = spark.createDataFrame([("a", "t")], "entity string, tier string")
    got = {r.period: r.prev_score.src for r in P.report_records(d, metric, members).collect()}
    assert got == {"2024Q1": None, "2024Q2": "2024Q1-P07"}


def test_readers_return_what_they_reject(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "period": "2024Q1", "page_no": 3, "text": "x"}\nnot json\n\n{"chunk_id": "b", "page_no": "three"}\n')
    rows, bad = readers.read_chunks(spark, str(tmp_path / "c.jsonl"))
    assert [r.chunk_id for r in rows.collect()] == ["a"] and bad.count() == 2
    (tmp_path / "r.json").write_text('[{"question_id": 1, "sources": ["p"]},\n {"question_id": "x"}]')
    rows, bad = readers.read_run(spark, str(tmp_path / "r.json"))
    assert [r.question_id for r in rows.collect()] == [1] and bad.count() == 1
    (tmp_path / "q.csv").write_text("question_id,batch,category,question,expected_route,expected_answer,citation,refusal_reason,tests\n1,1,c,why,r,,,,\nx1,1,c,how,r,,,,\n2,1,c,,r,,,,\n")
    rows, bad = readers.read_questions(spark, str(tmp_path / "q.csv"))
    assert [r.question_id for r in rows.collect()] == [1] and len(bad.collect()) == 1 and "x1" in bad.first().line


def test_sinks_of_tables_by_period(spark, tmp_path):
    score = spark.createDataFrame([("2024Q1", "a", 4.0), ("2024Q2", "b", 4.5)], "period string, entity string, score double")
    assert callable(sinks.load_table)
    sinks.load_table(score, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.period, r.entity) for r in back.collect()) == [("2024Q1", "a"), ("2024Q2", "b")]
