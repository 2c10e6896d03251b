"""Report-shaped views derived from the supplied tables.

Every view aggregates before it joins names, so what crosses the network is
periods x entities, not the fact table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.periods import page_id, period_of
from plumbline.session import durable, spread
from plumbline.sources.tables import Tables

SCORE_SCALE = 100_000


def keep_cells(t: Tables) -> Tables:
    """From now on the views of ``t`` read one stored copy of :func:`cells`; for plans that use several of them."""
    if "kept_cells" not in t.__dict__:
        t.kept_cells = durable(cells(t))
    return t


def cells(t: Tables) -> DataFrame:
    """(period, nation, metric) with the sum in cents and the row count: the base of both score tables."""
    if "kept_cells" in t.__dict__:
        return t.kept_cells
    facts = t.orders.select(
        "o_custkey",
        period_of(F.col("o_orderdate")).alias("period"),
        F.col("o_orderpriority").alias("metric"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    owners = t.customer.select("c_custkey", "c_nationkey")
    return (
        facts.join(owners, facts.o_custkey == owners.c_custkey)
        .groupBy("period", F.col("c_nationkey").alias("nk"), "metric")
        .agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
    )


def _as_score(cents: str, n: str):
    """Two-decimal score from an exact ratio of integers."""
    hundredths = F.expr(f"(2 * {cents} + {n} * {SCORE_SCALE}) div (2 * {n} * {SCORE_SCALE})")
    return (hundredths.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(6,2)")


def score(t: Tables) -> DataFrame:
    """score(period, entity, score, source)."""
    sums = cells(t).groupBy("period", "nk").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"))
    return sums.join(t.nation, sums.nk == F.col("n_nationkey")).select(
        "period",
        F.col("n_name").alias("entity"),
        _as_score("cents", "n").alias("score"),
        page_id(F.col("period"), F.col("nk") + 1).alias("source"),
    )


def metric_score(t: Tables) -> DataFrame:
    """metric_score(period, metric, entity, score, source)."""
    base = cells(t)
    return base.join(t.nation, base.nk == F.col("n_nationkey")).select(
        "period",
        "metric",
        F.col("n_name").alias("entity"),
        _as_score("cents", "n").alias("score"),
        page_id(F.col("period"), F.col("nk") + 101).alias("source"),
    )


def members(t: Tables) -> DataFrame:
    """(entity, tier): every entity belongs to one tier."""
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("entity"), F.col("r_name").alias("tier")
    )


def tier(t: Tables, scores: DataFrame | None = None) -> DataFrame:
    """tier(period, entity, tier, tier_avg, source) for every observed (period, entity)."""
    scores = score(t) if scores is None else scores
    placed = scores.join(members(t), "entity")
    means = placed.groupBy("period", "tier").agg(
        F.round(F.sum("score") / F.count(F.lit(1)), 2).cast("decimal(6,2)").alias("tier_avg")
    )
    return placed.join(means, ["period", "tier"]).select("period", "entity", "tier", "tier_avg", "source")


def period_meta_q(t: Tables) -> DataFrame:
    """period_meta at quarter grain: sample size, entities, and a two-part methodology version."""
    per_entity = cells(t).groupBy("period", "nk").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("n_metrics")
    )
    return (
        per_entity.groupBy("period")
        .agg(
            F.sum("n").alias("sample_n"),
            F.count(F.lit(1)).cast("int").alias("entity_n"),
            F.min("n_metrics").alias("l1_n"),
            F.count_if(F.col("n_metrics") == 5).cast("int").alias("l2_n"),
        )
        .withColumn("basis_version", F.concat_ws("+", "l1_n", "l2_n"))
    )


def period_meta_d(t: Tables) -> DataFrame:
    """period_meta per day of the event table; the distinct counts are exact."""
    return (
        t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("period"))
        .agg(
            F.count(F.lit(1)).alias("sample_n"),
            F.countDistinct("user_id").alias("entity_n"),
            F.countDistinct("event_type").alias("l1_n"),
            F.countDistinct("props").alias("l2_n"),
        )
        .withColumn("basis_version", F.concat_ws("+", "l1_n", "l2_n"))
    )


def chunk(t: Tables) -> DataFrame:
    """One chunk per document: its source number gives the quarter, its language the page kind."""
    k = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return t.documents.select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(
            (F.lit(2020) + F.floor(k / 4)).cast("string"), F.lit("Q"), (k % 4 + 1).cast("string")
        ).alias("period"),
        F.col("n_chars").cast("int").alias("n_chars"),
        F.col("lang").alias("page_kind"),
        "text",
    )


def query(t: Tables) -> DataFrame:
    """query(query_id, phrase): each benchmark item, whole."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))


def run(t: Tables) -> DataFrame:
    """One recorded run row per order: expected against given route, answer and sources.

    Deterministic slips are spread over the keys so that every verdict occurs.
    """
    base = spread(t.orders).select(
        F.col("o_orderkey").alias("question_id"),
        "o_custkey",
        period_of(F.col("o_orderdate")).alias("period"),
        F.col("o_orderpriority").alias("category"),
        F.expr("cast(round(o_totalprice * 100) as bigint) div 100000").alias("h"),
    ).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nk")), "o_custkey")
    k = F.col("question_id")

    def money(h):
        return F.concat(F.expr(f"({h}) div 100").cast("string"), F.lit("."), F.lpad(F.expr(f"({h}) % 100").cast("string"), 2, "0"))

    expected_route = F.when(k % 9 == 0, "refuse").when(k % 9 <= 2, "search").when(k % 9 == 3, "clarify").otherwise("sql")
    page = page_id(F.col("period"), F.col("nk") + 1)
    beside = page_id(F.col("period"), (F.col("nk") + 2) % 25 + 1)
    return base.select(
        "question_id",
        "category",
        "period",
        expected_route.alias("expected_route"),
        F.when(k % 11 != 0, expected_route).when(expected_route == "sql", "search_0").otherwise("sql").alias("route"),
        F.when(k % 7 == 0, F.concat(money("h"), F.lit(";0.05")))
        .when(k % 17 == 0, F.lit("见原文"))
        .otherwise(F.concat(money("h"), F.lit(";"), (F.col("o_custkey") % 97).cast("string")))
        .alias("expected_answer"),
        F.when(k % 5 == 0, F.concat(money("h + 5"), F.lit(" / "), (F.col("o_custkey") % 97).cast("string")))
        .when(k % 8 == 0, F.concat(money("h"), F.lit(" / "), money("h + 9")))
        .when(k % 7 == 0, F.concat(money("h"), F.lit(" / "), money("h + 5")))
        .otherwise(F.concat(money("h"), F.lit(" / "), (F.col("o_custkey") % 97).cast("string")))
        .alias("answer"),
        page.alias("expected_page"),
        F.when(k % 4 == 0, F.array(beside))
        .when(k % 6 == 1, F.array(page, F.lit("1999Q1-P01")))
        .otherwise(F.array(beside, page))
        .alias("sources"),
        F.when(k % 10 == 0, 1).when(k % 10 == 3, 2).otherwise(0).alias("n_warnings"),
        F.when(k % 6 == 0, 1).otherwise(0).alias("n_trace"),
    )


def trial(t: Tables) -> DataFrame:
    """Repeated trials of a question: position, number of pages shown, and whether it was right."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("question_id"),
        F.col("l_linenumber").alias("position"),
        (F.col("l_suppkey") % 5 + 1).alias("pages"),
        (F.col("l_quantity") >= 13).alias("ok"),
    )


def raw_page(t: Tables) -> DataFrame:
    """raw_page(period, page_no, raw): every document as a page of its source's quarter."""
    k = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return spread(t.documents).select(
        F.concat((F.lit(2020) + F.floor(k / 4)).cast("string"), F.lit("Q"), (k % 4 + 1).cast("string")).alias("period"),
        F.col("doc_id").alias("page_no"),
        F.col("text").alias("raw"),
    )


def score_page(t: Tables) -> DataFrame:
    """score_page(period, page_no, raw): the printed form of a period's score table.

    Scores, then the average, then the names in the same order. A page lists one period's entities.
    """
    row = F.struct((-F.col("score")).alias("s"), "entity")
    pages = score(t).groupBy("period").agg(
        F.sort_array(F.collect_list(row)).alias("r"), F.round(F.sum("score") / F.count(F.lit(1)), 2).alias("m"))
    return pages.select(
        "period",
        F.lit(9).alias("page_no"),
        F.concat(
            F.lit("9\n页\n第\n"), F.array_join(F.transform("r", lambda x: (-x["s"]).cast("string")), " "),
            F.lit("\n平均, "), F.col("m").cast("decimal(6,2)").cast("string"), F.lit("\n"),
            F.array_join(F.transform("r", lambda x: x["entity"]), "\n"), F.lit("\nCopyright, All rights reserved"),
        ).alias("raw"),
    )


def tier_page(t: Tables) -> DataFrame:
    """tier_page(source, period, raw): the printed form of one tier of one period."""
    r = tier(t).groupBy("period", "tier", "tier_avg").agg(F.sort_array(F.collect_list("entity")).alias("e"))
    return r.select(
        F.concat("period", F.lit("-P"), F.translate("tier", " ", "")).alias("source"),
        "period",
        F.concat(F.lit("— "), "tier", F.lit(" 机场综合得分\n"), F.col("tier_avg").cast("string"), F.lit(" 平均\n"), F.array_join("e", "\n")).alias("raw"),
    )


# Question wordings; the order key picks one, the order fills it. {e}/{e2} entities, {p}/{p2} periods, {m} metric,
# {t} tier, {n}/{cn} a count in digits and as a numeral, {nk} the number in an entity's name.
TEMPLATES = (
    "{p}{e}的综合得分是多少", "{p}{e}的{m}得分是多少", "{p}前{n}名是哪些", "{p}{e}属于哪个档", "{p}样本量是多少",
    "{p}{t}平均得分是多少", "{p}{t}的有谁，得分多少", "{e}在{p}各项得分", "{p}最低得分是谁", "最新一期{e}得分多少",
    "{e}近{cn}期排名", "{p}的上一期{e}综合得分是多少", "{p}和上一期{e}的得分变化", "{p}报告里{e}的背景介绍", "1990Q1{e}得分多少",
    "为什么{e}的{m}下降", "{p}{e}与{p2}{e2}相差多少", "{p}{e}和{e2}谁的总分高", "{e}表现如何", "2024年度报告里说了什么背景",
    "{p}第3页为什么没进库", "{p}光明国际机场得分多少", "{p}{e}的靠桥率是多少", "{p}NA得分多少", "{p}ON_{nk}得分多少",
)
NUMERAL_WORDS = "一二三四五六七八九"


def question(t: Tables) -> DataFrame:
    """question(question_id, kind, text) and the parts it was filled with."""
    k = F.col("o_orderkey")
    base = spread(t.orders).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    n = (F.floor(k / 25) % 9 + 1).cast("int")
    parts = base.select(
        k.alias("question_id"), (k % 25).cast("int").alias("kind"), F.col("n_name").alias("e"),
        F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 7) % 25).cast("string")).alias("e2"),
        period_of(F.col("o_orderdate")).alias("p"),
        F.concat((F.year("o_orderdate") - 1).cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("p2"),
        F.col("o_orderpriority").alias("m"), F.col("r_name").alias("t"), n.cast("string").alias("n"),
        F.substring(F.lit(NUMERAL_WORDS), n, F.lit(1)).alias("cn"), F.col("n_nationkey").cast("string").alias("nk"),
    )
    text = None
    for i, template in enumerate(TEMPLATES):
        filled = F.concat(*[F.col(x[1:-1]) if x.startswith("{") else F.lit(x) for x in pieces(template)])
        text = F.when(F.col("kind") == i, filled) if text is None else text.when(F.col("kind") == i, filled)
    return parts.withColumn("text", text)


def pieces(template: str) -> list[str]:
    """A template cut into literal parts and ``{placeholders}``."""
    import re

    return [x for x in re.split(r"(\{\w+\})", template) if x]
