"""Readers and sinks, retrieval against brute force, and a pass over registered plans."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import report as P
from plumbline.operators import retrieval as S
from plumbline.plans import oracle_queries, spark_queries
from plumbline.plans.lookups import rpt_entity_report
from plumbline.sources import Tables, readers, sinks
from plumbline.sources import views as V


def test_csv_round_trip_with_byte_order_mark(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("﻿period,entity,score,source\n2025Q4,甲,4.23,2025Q4-P09\n", encoding="utf-8")
    df = readers.read_table(spark, str(p), readers.SCORE)
    assert [str(x) for x in df.first()] == ["2025Q4", "甲", "4.23", "2025Q4-P09"]
    sinks.write_table(df, str(tmp_path / "out"), ["entity", "score"], single_file=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["entity", "score"]


def test_variants_keep_rejected_lines(spark, tmp_path):
    p = tmp_path / "v.tsv"
    p.write_text("# note\n1\tv\tb\tp\tt1 t2\tA|B\nshort\trow\n", encoding="utf-8")
    rows, rejected = readers.read_variants(spark, str(p))
    assert rows.first().expected == ["A", "B"] and [r.line for r in rejected.collect()] == ["short\trow"]


def test_pages_take_the_period_from_the_name(spark, tmp_path):
    (tmp_path / "R_2024Q2_x.txt").write_text("one\ftwo")
    (tmp_path / "annual.txt").write_text("none")
    got = readers.read_pages(spark, str(tmp_path), "*.txt").collect()
    assert sorted((r.period, r.page_no, r.raw) for r in got) == [("2024Q2", 1, "one"), ("2024Q2", 2, "two")]


def test_run_sink_replaces_one_tag(spark, tmp_path):
    path = str(tmp_path / "runs")
    for tag, v in (("a", 1), ("b", 2), ("a", 3)):
        sinks.write_run(spark.createDataFrame([(v,)], "v int"), path, tag)
    assert sorted((r.run_tag, r.v) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


def test_report_sink(spark, sf, tmp_path):
    t = Tables(spark, sf)
    records = P.report_records(V.score(t), V.metric_score(t), V.members(t))
    sinks.write_reports(records, str(tmp_path))
    assert spark.read.json(str(tmp_path / "reports")).count() == rpt_entity_report(t).count()


def test_vector_blocks_and_deep_ranks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    queries = corpus.filter("id < 9").withColumnRenamed("id", "query_id")
    order = {q: sorted(range(60), key=lambda i: (-round(float(v[q] @ v[i]), 6), i)) for q in range(9)}
    got = S.vector_top_k(queries, corpus, 4, block_rows=2).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in got) == sorted((q, k + 1, order[q][k]) for q in range(9) for k in range(4))
    wanted = spark.createDataFrame([(q, i, round(float(v[q] @ v[i]), 6)) for q in range(9) for i in (5, 30, 59)], "query_id long, id long, cosine double")
    ranks = S.vector_ranks(queries, corpus, wanted, block_rows=4).collect()
    assert all(order[r.query_id][r["rank"] - 1] == r.id for r in ranks) and len(ranks) == 27


def test_fusion_depth_is_enough():
    for k, a, b in ((5, 1, 1), (5, 2, 1), (3, 1, 2)):
        m = S.depth_for(k, a, b)
        assert b / (60 + k) >= (a + b) / (60 + m + 1)


def test_registry_names():
    assert set(oracle_queries()) <= set(spark_queries()) and len(spark_queries()) > 150


def test_every_kind_of_plan_runs(spark, sf):
    for name in ("win_rank_view", "evl_judge", "ret_back_off", "val_attack", "ver_notes", "aud_segments"):
        assert spark_queries()[name](spark, sf).count() > 0


def test_repartitioned_input_gives_the_same_report(spark, sf):
    t = Tables(spark, sf)
    a = rpt_entity_report(t)
    shuffled = V.score(t).repartition(13, F.rand(1))
    from plumbline.operators.ranking import rank_table
    assert rank_table(shuffled).select("period", "entity", "row_no").exceptAll(a.select("period", "entity", "row_no")).count() == 0
