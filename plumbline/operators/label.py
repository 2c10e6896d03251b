"""Labels for a table of questions: periods, entities, metrics, tiers, routes, refusals, answers.

Period logic uses one row that holds the observed calendar; names are found by the substring join.
Every label carries a status, and an ambiguous one never turns into a value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import NUMBER, RANK_NUMERAL, TOP_N, numeral  # noqa: F401
from plumbline.functions.periods import PERIOD_LOOSE, periods_in
from plumbline.operators import ranking as R
from plumbline.operators.combine import nearest_preceding
from plumbline.operators.matching import longest_mentions, phrase_counts, phrase_lists, phrase_occurrences
from plumbline.operators.topk import top_n
from plumbline.session import durable

# Word lists and patterns of the question language.
NUMERIC = r"多少|几分|几期|第几|排名|名次|前\s*\d|最高|最低|得分|分数|样本量|家数"
PROSE = "为什么|为何|原因|背景|变更|介绍|简介"
DOC_SECTION = "(?:报告|概况|简介|说明|声明|测评|简报|名录|附录)里"
POSITION = (
    r"排名|名次|第几|第一|第二|第三|前\s*\d+\s*名|前\s*\d+|榜首"
    "|最高|最低|最强|最弱|最好|最差|最大|最小|最多|最少|最后|垫底|倒数"
)
HEADLINE = ("综合得分", "综合评分", "综合分", "总分", "总评分", "总得分", "整体得分", "整体分")
WHOLE = "|".join(HEADLINE)
VAGUE = "(?<![一-鿿])得分|的得分|是多少分|多少分|分数"
VAGUE_ASK = "表现|如何|怎么样|怎样|情况"
RANK_WORDS = r"排名|名次|第几|第\s*\d+\s*名|前\s*\d+|最后|末位|垫底|倒数|最差|最弱|最好|最强"
COMPARE_WORDS = "哪[个家]|谁|相差|差距|变化"
RECENT_N = r"近\s*([一二三四五六七八九十两\d]+)\s*期"
LATEST = "最新|最近|最后一期|最后那期"
RELATIONS = {
    "compare_with_previous": "上一?期|前一期|上期|上一?季度",
    "compare_with_next": "下一?期|后一期|下期|下一?季度",
    "take_recent_n": r"近\s*[一二三四五六七八九十两\d]+\s*期",
    "latest": "最新一期|最近一期|最后那期|现在|当前",
}
AS_REFERENCE = r"^\s*的\s*(?:.{0,3}?(?:上一?期|下一?期|近|最新|上期))"
LAST_YEAR = "去年|上一年|上年"
INTERNAL = "进库|入库|切片|没进|未入库|不在库里|收录|没收录"
NAMED_METRIC = r"(?:的|里|中|内)\s*([一-鿿]{2,6})(率|度|值|量|务|保障|设施|得分|分数)"
NAME_LIKE = "([一-鿿]{2,6})机场"
GENERIC_HEAD = "^(?:这|那|该|各|某|每|全|所|几|多)"
GENERIC_ASK = "哪些|什么|多少|几个|哪家|哪几|几家"
GENERIC_CHARS = "[的了与及或为是在有从对把被而且也就还很更最等各该这那其之所以于由因但只又将总并则]"
TIER_WORD = r"(\d{4}万(?:-\d{4}万)?级(?:以上)?)"
TOP_WORDS = (("前两名", 2), ("前三名", 3), ("前五名", 5), ("前五", 5), ("前二", 2), ("第二名", 2), ("第三名", 3), ("第一", 1))
DOWN_WORDS = "下降|下滑|变差|退步|降低|掉了|差了"
UP_WORDS = "上升|上涨|变好|进步|提高|涨了|好了"
MULTI_STEP = "[，,；;]|如果|要是|假如|顺便|以及|还有"
PREFERENCE = "关注|在意|重点|喜欢|习惯|以后|别再|不用|不要|偏向|更想看"
MEAN_WORDS = "平均|均值"
WORST_WORDS = "最低|最差|垫底|最后"
LISTED = 5  # a metric or the headline without an entity is answered by so many rows
META_WORDS = "样本量|样本数|机场数|多少家机场|几家机场"
META_LINES = ("sample_n", "entity_n", "l1_n", "l2_n")  # a question about any of them is told all
OF_ENTITIES = ("metric", "all_metrics", "tier_of", "headline")  # kinds that are answered for every entity named
FACT_ROWS = 500_000  # so many facts travel to every task; more are joined by a shuffle
LIMIT = r"\d+万\s*[-~]\s*\d+万|\d+万级以上|\d+万级|[一-鿿]{2,6}(?:声明|简介)"
NEAR_RATIO = 0.45


def found(values: Column, why: Column | str, confidence: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(values.alias("values"), lit(why).alias("why"), lit(confidence).alias("confidence"))


def _alone(key: str) -> Column:
    """A join key that meets nothing, for rows without one; unlike one null for all, it does not bring them into one task."""
    return F.concat(F.lit("\0"), F.col(key).cast("string"))


def _none() -> Column:
    return F.array().cast("array<string>")


def calendar(periods: DataFrame) -> DataFrame:
    """One row: the observed periods in order. As long as the calendar, whatever the data."""
    return periods.select("period").distinct().agg(F.sort_array(F.collect_list("period")).alias("calendar"))


def with_calendar(questions: DataFrame, periods: DataFrame) -> DataFrame:
    return questions.join(F.broadcast(calendar(periods)))  # one row


def _recent(text: Column) -> Column:
    word = F.regexp_extract(text, RECENT_N, 1)
    return F.when(word != "", numeral(word))


def stated_periods(text: Column, cal: Column, written: Column | None = None, recent: Column | None = None) -> Column:
    """Periods written in the text, else the recent N (only 1..all), else the latest. ``written`` and ``recent``: both, where they are columns already."""
    explicit, n = periods_in(text) if written is None else written, _recent(text) if recent is None else recent
    size = F.size(cal)
    return (
        F.when(F.size(explicit) > 0, found(explicit, "written", "certain"))
        .when(n.between(1, size), found(F.slice(cal, size - n + 1, n), "recent n", "certain"))
        .when(text.rlike(LATEST), found(F.slice(cal, size, F.lit(1)), "latest", "certain"))
        .otherwise(found(_none(), "no period", "none"))
    )


def relative_periods(text: Column, cal: Column, reference: Column, this_year: int, explicit: Column | None = None, recent: Column | None = None) -> Column:
    """Previous / next / last year / recent N / latest, against the last written period or else the reference.

    Neighbours are taken in the observed sequence. ``this_year`` replaces the wall clock.
    """
    explicit = stated_periods(text, cal)["values"] if explicit is None else explicit
    ref = F.coalesce(F.get(explicit, F.size(explicit) - 1), reference)
    at = F.array_position(cal, ref)
    year = F.coalesce(F.substring(ref, 1, 4).cast("int"), F.lit(this_year)) - 1
    of_year = F.filter(cal, lambda p: F.substring(p, 1, 4) == year.cast("string"))
    n, size = _recent(text) if recent is None else recent, F.size(cal)

    def step(move: int, edge: Column, name: str):
        return (
            F.when(ref.isNull(), found(_none(), f"{name}: no reference", "none"))
            .when(at == 0, found(_none(), f"{name}: unknown reference", "none"))
            .when(edge, found(_none(), f"{name}: no such neighbour", "none"))
            .otherwise(found(F.array(F.get(cal, (at + (move - 1)).cast("int"))), name, "certain"))
        )

    return (
        F.when(text.rlike("上一?期|前一期|上期"), step(-1, at == 1, "previous"))
        .when(text.rlike("下一?期|后一期|下期"), step(1, at == size, "next"))
        .when(text.rlike(LAST_YEAR), F.when(F.size(of_year) > 0, found(F.slice(of_year, -1, 1), "last year", "default inference"))
              .otherwise(found(_none(), "last year: no data", "none")))
        .when(n.isNotNull(), F.when(n.between(1, size), found(F.slice(cal, size - n + 1, n), "recent n", "certain"))
              .otherwise(found(_none(), "recent n: out of range", "none")))
        .when(text.rlike("最新|现在|当前"), found(F.slice(cal, size, F.lit(1)), "latest", "certain"))
        .otherwise(found(_none(), "nothing relative", "none"))
    )


def as_reference(text: Column, period: Column) -> Column:
    """Is this written period only the point that another one is relative to?"""
    at = F.instr(text, period)
    return (at > 0) & F.substring(text, at + F.length(period), F.lit(8)).rlike(AS_REFERENCE)


def period_plan(questions: DataFrame, periods: DataFrame, this_year: int, reference: str | None = None) -> DataFrame:
    """explicit, relation, references and targets of every question; later steps read only the targets."""
    text, cal = F.col("text"), F.col("calendar")
    ref = F.col(reference) if reference else F.lit(None).cast("string")
    relation = None
    for name, pattern in RELATIONS.items():
        relation = F.when(text.rlike(pattern), name) if relation is None else relation.when(text.rlike(pattern), name)
    # columns of their own, so that what several rules ask for is read off the text once
    staged = with_calendar(questions, periods).withColumn("_written", periods_in(text)).withColumn("_word", F.regexp_extract(text, RECENT_N, 1))
    staged = staged.withColumn("_recent", F.when(F.col("_word") != "", numeral(F.col("_word"))))
    staged = staged.withColumn("explicit", stated_periods(text, cal, F.col("_written"), F.col("_recent"))["values"]).withColumn("relation", relation)
    staged = staged.withColumn("refs", F.when(F.col("relation").isNull(), _none()).otherwise(F.filter("explicit", lambda p: as_reference(F.col("text"), p))))
    staged = staged.withColumn("_ref", F.coalesce(F.get("refs", F.size("refs") - 1), ref))
    staged = staged.withColumn("derived", relative_periods(text, cal, F.col("_ref"), this_year, F.col("explicit"), F.col("_recent"))["values"])
    targets = F.when(F.col("relation").isNull(), F.col("explicit")).otherwise(
        F.array_distinct(F.concat(F.array_except("explicit", "refs"), "derived")))
    return staged.withColumn("targets", targets).drop("calendar", "derived", "_written", "_word", "_recent", "_ref")


# ---- names ------------------------------------------------------------------------------------------------


def _positions(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrases(phrase)`` in question texts: (question_id, phrase, pos, len)."""
    hits = phrase_occurrences(
        questions.select(F.col("question_id").alias("text_id"), "text"), phrases.select(F.col("phrase").alias("phrase_id"), "phrase").distinct(), fold_case=False)
    return hits.select(F.col("text_id").alias("question_id"), F.col("phrase_id").alias("phrase"), "pos", "len")


def full_mentions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Whole names in the text; a name inside a longer name is not mentioned. ``names(entity)``."""
    hits = _positions(questions, names.select(F.col("entity").alias("phrase")))
    kept = longest_mentions(hits.select(F.col("question_id").alias("text_id"), F.col("phrase").alias("entity"), "pos", "len"))
    return kept.select(F.col("text_id").alias("question_id"), "entity", "pos", "len")


def tail_mentions(questions: DataFrame, names: DataFrame, full: DataFrame, tails: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Name endings in the text, only when one entity ends so and that entity is not named in full."""
    ends = names.select("entity", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.expr(f"right(entity, {n})").alias("phrase")) for n in tails])).alias("x"))
    ends = ends.select("entity", "x.n", "x.phrase").filter(F.length("entity") > F.col("n"))
    hits = _positions(questions, ends).groupBy("question_id", "phrase").agg(F.min("pos").alias("pos"), F.min("len").alias("len"))
    named = full.select("question_id", "entity").distinct()
    meant = hits.join(ends, "phrase").join(named, ["question_id", "entity"], "left_anti")
    shortest = meant.groupBy("question_id", "entity").agg(F.min(F.struct("n", "phrase", "pos", "len")).alias("h"))
    alone = shortest.groupBy("question_id", "h.phrase").agg(
        F.count(F.lit(1)).alias("k"), F.min("entity").alias("entity"), F.min("h.pos").alias("pos"), F.min("h.len").alias("len"))
    return alone.filter("k = 1").select("question_id", "entity", "pos", "len")


def all_mentions(questions: DataFrame, names: DataFrame, tails: tuple[int, ...] = (2, 3)) -> DataFrame:
    """All entities of each text: longest first, no overlap, listed in text order."""
    full = full_mentions(questions, names)
    first = full.groupBy("question_id", "entity").agg(F.min("pos").alias("pos"), F.min("len").alias("len"))
    every = first.unionByName(tail_mentions(questions, names, full, tails))
    lists = every.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("len")).alias("l"), "pos", "entity"))).alias("m"))
    free = F.aggregate(
        "m", F.slice("m", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: (x["pos"] < y["pos"] - y["l"]) & (y["pos"] < x["pos"] - x["l"])), acc).otherwise(F.concat(acc, F.array(x))))
    in_order = F.array_sort(F.transform(free, lambda x: F.struct(x["pos"], x["entity"])))
    return lists.select("question_id", F.transform(in_order, lambda x: x["entity"]).alias("entities"))


def _by_row(questions: DataFrame, in_row: Callable[[DataFrame], DataFrame], joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``in_row`` for questions whose id comes once, which need not meet by id; ``joined`` for the rest, if any."""
    again = durable(questions.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and question_id is not null").select("question_id"))
    if not again.limit(1).count():
        return in_row(questions)
    return in_row(questions.join(again, "question_id", "left_anti")).unionByName(joined(questions.join(again, "question_id", "left_semi")))


def name_phrases(names: DataFrame, tails: tuple[int, ...], city: int) -> DataFrame:
    """What a question may say of a catalog: (phrase, name, tail, start). Endings and prefixes hold how many entities have them, and the first.

    A text that holds a longer ending holds the shortest too, and an entity is meant by the shortest one found, so only that one is looked for.
    """
    known, n = names.select("entity").distinct(), min(tails)
    part = lambda phrase, longer: known.filter(F.length("entity") > longer).groupBy(phrase.alias("phrase")).agg(
        F.struct(F.count(F.lit(1)).alias("k"), F.min("entity").alias("entity")).alias("of"))
    none = F.lit(None).cast("struct<k:bigint,entity:string>")
    every = known.select(F.col("entity").alias("phrase"), F.lit(True).alias("name"), none.alias("tail"), none.alias("start"))
    every = every.unionByName(part(F.expr(f"right(entity, {n})"), n).select("phrase", F.lit(False).alias("name"), F.col("of").alias("tail"), none.alias("start")))
    every = every.unionByName(part(F.substring("entity", 1, city), city).select("phrase", F.lit(False).alias("name"), none.alias("tail"), F.col("of").alias("start")))
    return every.groupBy("phrase").agg(F.max("name").alias("name"), F.max("tail").alias("tail"), F.max("start").alias("start"))


def _mentions(rows: DataFrame, names: DataFrame, tails: tuple[int, ...]) -> DataFrame:
    """:func:`all_mentions` and :func:`link_entity` of rows with ``hits``: adds entities and entity_status; ids come once."""
    end = lambda x: x["pos"] + x["len"]
    known = names.select("entity").distinct().filter(F.length("entity") > min(tails)).withColumn("phrase", F.expr(f"right(entity, {min(tails)})"))
    named = F.filter("hits", lambda x: x["phrase_id"]["name"])
    wider = lambda x, y: (y["pos"] <= x["pos"]) & (end(y) >= end(x)) & (y["len"] > x["len"])
    rows = rows.withColumn("_named", named)
    rows = rows.withColumn("_full", F.filter("_named", lambda x: ~F.exists("_named", lambda y: wider(x, y))))
    rows = rows.withColumn("_who", F.array_distinct(F.transform("_full", lambda x: x["phrase_id"]["phrase"])))
    first = lambda of: F.array_distinct(F.transform(F.col(of), lambda x: x["phrase_id"]))
    at = lambda of, phrase: F.array_min(F.transform(F.filter(of, lambda y: y["phrase_id"]["phrase"] == phrase), lambda y: y["pos"]))
    item = lambda entity, pos, size: F.struct((-size).alias("l"), pos.alias("pos"), entity.alias("entity"))
    rows = rows.withColumn("_tails", F.filter("hits", lambda x: x["phrase_id"]["tail"].isNotNull()))
    # how many entities an ending leaves once those named in full are gone
    left = F.transform(first("_tails"), lambda p: F.struct(
        p["phrase"].alias("phrase"), p["tail"]["k"].alias("k"), p["tail"]["entity"].alias("entity"), at("_tails", p["phrase"]).alias("pos"),
        (p["tail"]["k"] - F.size(F.filter("_who", lambda e: F.endswith(e, p["phrase"]) & (F.length(e) > F.length(p["phrase"]))))).alias("left")))
    rows = rows.withColumn("_left", F.filter(left, lambda x: x["left"] == 1))
    rows = rows.withColumn("_alone", F.transform(F.filter("_left", lambda x: x["k"] == 1), lambda x: item(x["entity"], x["pos"], F.length(x["phrase"]))))
    shared = known.groupBy("phrase").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("phrase")
    if shared.limit(1).count():  # an ending of several, of which all but one are named in full: which is it?
        open_ = rows.filter(F.exists("_left", lambda x: x["k"] > 1)).select("question_id", "_who", F.explode(F.filter("_left", lambda x: x["k"] > 1)).alias("x"))
        meant = open_.join(known.withColumnRenamed("entity", "other"), F.col("x.phrase") == F.col("phrase")).filter(~F.array_contains("_who", F.col("other")))
        more = meant.groupBy("question_id").agg(F.collect_list(item(F.col("other"), F.col("x.pos"), F.length("phrase"))).alias("_more"))
        rows = rows.join(more, "question_id", "left").withColumn("_alone", F.concat("_alone", F.coalesce("_more", F.slice("_alone", 1, 0)))).drop("_more")
    fully = F.transform("_who", lambda e: item(e, at("_full", e), F.length(e)))
    rows = rows.withColumn("_m", F.sort_array(F.concat(fully, "_alone")))
    free = F.aggregate(
        "_m", F.slice("_m", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda y: (x["pos"] < y["pos"] - y["l"]) & (y["pos"] < x["pos"] - x["l"])), acc).otherwise(F.concat(acc, F.array(x))))
    rows = rows.withColumn("_in", F.transform(F.array_sort(F.transform(free, lambda x: F.struct(x["pos"], x["entity"]))), lambda x: x["entity"]))
    rows = rows.withColumn("_city", F.filter(first("hits"), lambda p: p["start"].isNotNull()))
    one = (F.size("_city") == 1) & (F.col("_city")[0]["start"]["k"] == 1)
    rows = rows.withColumn("entities", F.when(F.size("_in") > 0, F.col("_in")).when(one, F.array(F.col("_city")[0]["start"]["entity"])).otherwise(_none()))
    status = (F.when(F.size("_in") == 1, "unique").when(F.size("_in") > 1, "contrast").when(one, "unique").when(F.size("_city") > 0, "ambiguous").otherwise("none"))
    return rows.withColumn("entity_status", status).drop("_named", "_full", "_who", "_tails", "_left", "_alone", "_m", "_in", "_city")


def link_entity(questions: DataFrame, names: DataFrame, tails: tuple[int, ...] = (2, 3), city: int = 2) -> DataFrame:
    """Full names, else endings, else the city prefix: (question_id, entities, status).

    unique, contrast (several named), ambiguous (a prefix fits several, or several prefixes), none.
    """
    def in_row(some: DataFrame) -> DataFrame:
        asked = some.select("question_id", F.when(F.col("question_id").isNotNull(), F.col("text")).alias("text"))
        hits = phrase_lists(asked, name_phrases(names, tails, city).select(F.struct("phrase", "name", "tail", "start").alias("phrase_id"), "phrase"))
        return _mentions(hits, names, tails).select("question_id", "entities", F.col("entity_status").alias("status"))

    return _by_row(questions, in_row, lambda some: _link_joined(some, names, tails, city))


def _link_joined(questions: DataFrame, names: DataFrame, tails: tuple[int, ...], city: int) -> DataFrame:
    """:func:`link_entity` where an id may come in several rows, whose texts count as one."""
    named = all_mentions(questions, names, tails)
    prefixes = names.filter(F.length("entity") > city).select("entity", F.substring("entity", 1, city).alias("phrase"))
    sizes = prefixes.groupBy("phrase").agg(F.countDistinct("entity").alias("k"), F.min("entity").alias("entity"))
    rest = questions.join(named.select("question_id"), "question_id", "left_anti")
    cities = _positions(rest, sizes).select("question_id", "phrase").distinct().join(sizes, "phrase").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("cities"), F.max("k").alias("k"), F.min("entity").alias("entity"))
    both = questions.select("question_id").join(named, "question_id", "left").join(cities, "question_id", "left")
    one = (F.col("cities") == 1) & (F.col("k") == 1)
    return both.select(
        "question_id",
        F.when(F.col("entities").isNotNull(), F.col("entities")).when(one, F.array("entity")).otherwise(_none()).alias("entities"),
        F.when(F.size("entities") == 1, "unique").when(F.size("entities") > 1, "contrast").when(one, "unique")
        .when(F.col("cities").isNotNull(), "ambiguous").otherwise("none").alias("status"))


def link_longest(questions: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """The longest name of a catalog in each text, with how many occur: (question_id, column, n_names)."""
    hits = _positions(questions, names.select(F.col(column).alias("phrase"))).select("question_id", "phrase").distinct()
    return hits.groupBy("question_id").agg(
        F.min(F.struct((-F.length("phrase")).alias("l"), "phrase"))["phrase"].alias(column), F.count(F.lit(1)).alias("n_names"))


def link_metric(questions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metric names and the words for the headline score; longest wins."""
    return link_longest(questions, _metric_words(metrics), "metric")


def _metric_words(metrics: DataFrame) -> DataFrame:
    return metrics.select("metric").unionByName(metrics.sparkSession.createDataFrame([(w,) for w in HEADLINE], "metric string"))


def link_tier(questions: DataFrame, tiers: DataFrame, word: str = TIER_WORD) -> DataFrame:
    """The tier whose name is, or alone ends with, the tier word of the text."""
    asked = questions.select("question_id", F.regexp_extract("text", word, 1).alias("word")).filter("word <> ''")
    hits = asked.join(_tier_ends(tiers), "word").groupBy("question_id").agg(F.countDistinct("tier").alias("k"), F.min("tier").alias("tier"))
    return hits.filter("k = 1").select("question_id", "tier")


def _tier_ends(tiers: DataFrame) -> DataFrame:
    return tiers.select("tier").distinct().select("tier", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("tier")), lambda k: F.substring(F.col("tier"), k, F.length("tier")))).alias("word"))


# ---- routes and gates ---------------------------------------------------------------------------------------


def label_questions(questions: DataFrame, periods: DataFrame, names: DataFrame, metrics: DataFrame, tiers: DataFrame, this_year: int,
                    tails: tuple[int, ...] = (2, 3), tier_word: str = TIER_WORD) -> DataFrame:
    """All labels on one row per question. Names, endings, prefixes and metrics are found in one pass over the texts, and a question stays one row throughout."""

    def in_row(some: DataFrame) -> DataFrame:
        words = _metric_words(metrics).filter("metric is not null").distinct().select(F.col("metric").alias("phrase"), F.lit(True).alias("metric"))
        phrases = name_phrases(names, tails, 2).join(words, "phrase", "full_outer").select(
            F.struct("phrase", F.coalesce("name", F.lit(False)).alias("name"), "tail", "start", F.coalesce("metric", F.lit(False)).alias("metric")).alias("phrase_id"), "phrase")
        word = F.regexp_extract("text", tier_word, 1)
        listed = phrase_lists(some.filter("question_id is not null"), phrases).withColumn("_tier", F.when(word != "", word).otherwise(_alone("question_id")))
        rows = _mentions(period_plan(listed, periods, this_year), names, tails)
        said = F.transform(F.filter("hits", lambda x: x["phrase_id"]["metric"]), lambda x: F.struct((-x["len"]).alias("l"), x["phrase_id"]["phrase"].alias("phrase")))
        alone = _tier_ends(tiers).groupBy(F.col("word").alias("_tier")).agg(F.countDistinct("tier").alias("k"), F.min("tier").alias("tier")).filter("k = 1")
        return rows.withColumn("metric", F.array_min(said)["phrase"]).drop("hits").join(alone.select("_tier", "tier"), "_tier", "left").drop("_tier")

    def joined(some: DataFrame) -> DataFrame:
        planned = period_plan(some, periods, this_year)
        entity = _link_joined(some, names, tails, 2).withColumnRenamed("status", "entity_status")
        metric = link_metric(some, metrics).select("question_id", "metric")
        return planned.join(entity, "question_id").join(metric, "question_id", "left").join(link_tier(some, tiers, tier_word), "question_id", "left")

    return _by_row(questions, in_row, joined)


def route(labelled: DataFrame, known: DataFrame, metric_periods: DataFrame) -> DataFrame:
    """The ordered rules: route and reason. ``known(period)`` and ``metric_periods(period)`` give the coverage."""
    text = F.col("text")
    metric, has_entity = F.col("metric").isNotNull(), F.size("entities") > 0
    annual = F.contains(text, F.lit("年度")) & ~text.rlike(PERIOD_LOOSE)
    section = text.rlike(DOC_SECTION) & ~annual & ~(metric & text.rlike(POSITION))
    number = ~section & (metric | text.rlike(NUMERIC) | text.rlike(POSITION) | (has_entity & F.contains(text, F.lit("档"))))
    prose = section | text.rlike(PROSE)
    one = lambda df, name: F.broadcast(calendar(df).withColumnRenamed("calendar", name))  # noqa: E731  one row
    staged = labelled.join(one(known, "known")).join(one(metric_periods, "covered"))
    unknown = F.size(F.array_except("targets", "known")) > 0
    component = metric & ~F.col("metric").isin(*HEADLINE)
    outside = component & (F.size(F.array_except("targets", "covered")) > 0)
    # the first rule that applies
    rules = [
        (~number & ~prose, "undecided", "no signal"),
        (annual, "refuse", "annual report"),
        (prose & ~number, "search", "prose"),
        (F.size("targets") == 0, "refuse", "no period"),
        (unknown, "refuse", "unknown period"),
        (outside, "refuse", "metric not covered"),
    ]
    where, why = None, None
    for test, name, reason in rules:
        where = F.when(test, name) if where is None else where.when(test, name)
        why = F.when(test, reason) if why is None else why.when(test, reason)
    return staged.withColumn("route", where.otherwise("sql")).withColumn("reason", why.otherwise("number")).drop("known", "covered")


def mixed_basis(labelled: DataFrame, meta: DataFrame, column: str = "targets") -> DataFrame:
    """Do the periods of a question have different methodology versions?"""
    each = labelled.select("question_id", F.explode(column).alias("period")).join(meta.select("period", "basis_version"), "period")
    return each.groupBy("question_id").agg(
        F.countDistinct("basis_version").alias("n_versions"), (F.countDistinct("basis_version") > 1).alias("mixed"))


def is_generic(word: Column) -> Column:
    """``哪些机场`` names nobody."""
    stem = F.substring(word, F.lit(1), F.length(word) - 2)
    return word.rlike(GENERIC_HEAD) | word.rlike(GENERIC_ASK) | stem.rlike(GENERIC_CHARS)


def known_words(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """The asked words that contain a catalog word or lie in one: (word). ``asked(word)``, ``catalog(word)``."""
    words, names = durable(asked.select("word").distinct()), durable(catalog.select("word").distinct())  # each is read twice
    as_text = lambda df: df.select(F.col("word").alias("text_id"), F.col("word").alias("text"))
    as_phrase = lambda df: df.select(F.col("word").alias("phrase_id"), F.col("word").alias("phrase"))
    holds = phrase_counts(as_text(words), as_phrase(names), fold_case=False).select(F.col("text_id").alias("word"))
    held = phrase_counts(as_text(names), as_phrase(words), fold_case=False).select(F.col("phrase_id").alias("word"))
    return holds.unionByName(held).distinct()


def refusals(labelled: DataFrame, catalog: DataFrame) -> DataFrame:
    """The three gates: internal process, unknown metric, unknown entity. NULL reason = not refused.

    ``catalog(word)`` holds the field and metric names that can be answered.
    """
    text = F.col("text")
    stem, unit = F.regexp_extract(text, NAMED_METRIC, 1), F.regexp_extract(text, NAMED_METRIC, 2)
    asked = F.concat(stem, unit)
    known = known_words(labelled.filter(stem != "").select(asked.alias("word")), catalog).select(F.col("word").alias("_asked"), F.lit(True).alias("_known"))
    # who asks for no metric meets nothing, and not all in one task
    labelled = labelled.withColumn("_asked", F.when(stem != "", asked).otherwise(_alone("question_id"))).join(durable(known), "_asked", "left")
    unknown_metric = (stem != "") & F.col("_known").isNull()
    names = F.filter(F.regexp_extract_all(text, F.lit(NAME_LIKE), F.lit(0)), lambda w: ~is_generic(w))
    unknown_entity = (F.size("entities") == 0) & (F.size(names) > 0)
    return labelled.select(
        "question_id",
        F.when(text.rlike(INTERNAL), "internal process").when(unknown_metric, "unknown metric").when(unknown_entity, "unknown entity").alias("reason"),
        F.when(unknown_metric, asked).when(unknown_entity, F.get(names, F.lit(0))).alias("word"))


def apply_gates(routed: DataFrame, gates: DataFrame) -> DataFrame:
    """A question that a gate refuses is refused, whatever its route was."""
    gate = gates.select("question_id", F.col("reason").alias("_gate"))
    return routed.join(gate, "question_id", "left").withColumn("route", F.when(F.col("_gate").isNotNull(), "refuse").otherwise(F.col("route"))).withColumn(
        "reason", F.coalesce("_gate", "reason")).drop("_gate")


def pair_mentions(labelled: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, entity, period) for questions with several periods and several entities.

    Every entity takes the nearest period written before it; a question where one entity finds none, or where two
    pairs coincide, is not paired at all.
    """
    several = durable(labelled.filter((F.size("explicit") > 1) & (F.size("entities") > 1)).select("question_id", "text", "explicit"))  # read three times
    written = several.select(F.explode("explicit").alias("phrase")).distinct()
    periods = _positions(several, written).select("question_id", "pos", F.col("phrase").alias("value"))
    mentions = full_mentions(several, names).select("question_id", "pos", F.col("entity").alias("name"))
    near = nearest_preceding(periods, mentions, "question_id").filter("value is not null")
    return near.select("question_id", F.col("name").alias("entity"), F.col("value").alias("period")).distinct()


def _marks(strings: DataFrame, text: str) -> DataFrame:
    """(text, mark): the characters of a string, the second, third, ... of a kind being marks of their own."""
    at = F.sequence(F.lit(1), F.length(text))
    head = lambda i: F.substring(F.col(text), F.lit(1), i)
    char = lambda i: F.substring(F.col(text), i, F.lit(1))
    mark = F.transform(at, lambda i: F.concat(char(i), (F.length(head(i)) - F.length(F.replace(head(i), char(i), F.lit("")))).cast("string")))
    return strings.filter(F.length(text) > 0).select(text, F.explode(mark).alias("mark"))


def _near_pairs(words: DataFrame, names: DataFrame, ratio: float) -> DataFrame:
    """(word, name) pairs that may be ``ratio`` alike: none that is gets lost, and no two strings meet without a rare mark in common.

    Strings within the ratio keep that share of the longer one's characters, so they share at least k = ceil(ratio * own length) marks. Marks are ordered from rare to
    frequent in the catalog; each string enters under all but its last k - 1, and two that share k marks then share one of these.
    """
    frequency = _marks(names, "name").groupBy("mark").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(strings: DataFrame, text: str) -> DataFrame:
        ranked = _marks(strings, text).join(frequency, "mark", "left").groupBy(text).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "mark"))).alias("m"))
        spare = F.ceil(F.round(F.length(text) * F.lit(ratio), 9)).cast("int") - 1
        return ranked.select(text, F.explode(F.slice("m", F.lit(1), F.size("m") - spare)).alias("x")).select(text, "x.mark")

    shared = prefixes(words, "word").join(prefixes(names, "name"), "mark").select("word", "name").distinct()
    shorter, longer = F.least(F.length("word"), F.length("name")), F.greatest(F.length("word"), F.length("name"))
    return shared.filter(shorter >= longer * ratio - 1e-9)


def nearest_names(words: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` catalog names at least 45 % alike by edit distance. ``words(word)``; the first column of ``names`` is the name.

    The measure is ``1 - levenshtein / longer length``; see :func:`_near_pairs` for which pairs are measured.
    """
    catalog = names.select(F.col(names.columns[0]).alias("name")).filter("name is not null").distinct()
    asked = words.select("word").distinct()
    ratio = 1 - F.levenshtein("word", "name") / F.greatest(F.length("word"), F.length("name"))
    alike = _near_pairs(asked, catalog, NEAR_RATIO).withColumn("r", ratio).filter(F.col("r") >= NEAR_RATIO)
    order = W.partitionBy("word").orderBy(F.desc("r"), "name")
    first = alike.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    near = first.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("near"))  # at most k
    return asked.join(near, "word", "left").select("word", F.coalesce(F.array_join(F.transform("near", lambda x: x["name"]), "/"), F.lit("")).alias("near"))


def same_city(words: DataFrame, names: DataFrame, city: int = 2) -> DataFrame:
    """(word, same): catalog names that hold the first ``city`` characters of the word, in order of name."""
    catalog = names.select(F.col(names.columns[0]).alias("name")).filter("name is not null").distinct()
    asked = words.select("word").distinct().filter(F.length("word") >= city).withColumn("city", F.substring("word", 1, city))
    held = phrase_counts(catalog.select(F.col("name").alias("text_id"), F.col("name").alias("text")),
                         asked.select(F.col("city").alias("phrase_id"), F.col("city").alias("phrase")).distinct(), fold_case=False)
    lists = held.groupBy(F.col("phrase_id").alias("city")).agg(F.array_join(F.sort_array(F.collect_set("text_id")), "/").alias("same"))  # the names of one city
    return asked.join(lists, "city").select("word", "same")


def name_hints(words: DataFrame, names: DataFrame, city: int = 2, k: int = 3) -> DataFrame:
    """What to say to an unknown name: (word, basis, names). Names of the same city, else the nearest names, else none."""
    near = nearest_names(words, names, k)
    both = near.join(same_city(words, names, city), "word", "left")
    basis = F.when(F.col("same").isNotNull(), "same city").when(F.col("near") != "", "near").otherwise("none")
    return both.select("word", basis.alias("basis"), F.coalesce("same", "near").alias("names"))


def word_periods(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Where an unknown word does occur: (word, span, n_periods)."""
    texts = chunks.select(F.struct("chunk_id", "period").alias("text_id"), "text")
    hits = phrase_counts(texts, words.select(F.col("word").alias("phrase_id"), F.col("word").alias("phrase")).distinct(), fold_case=False)
    return hits.groupBy(F.col("phrase_id").alias("word")).agg(
        F.concat_ws("~", F.min("text_id.period"), F.max("text_id.period")).alias("span"), F.countDistinct("text_id.period").alias("n_periods"))


def ambiguous_extreme(deviations: DataFrame) -> DataFrame:
    """"Weakest" by raw score and by gap to the tier; where they differ the question must be asked back."""
    low = F.min(F.struct(F.col("score"), "metric"))["metric"]
    gap = F.min(F.struct(F.col("diff_tier"), "metric"))["metric"]
    return deviations.groupBy("period", "entity").agg(low.alias("by_score"), gap.alias("by_gap")).withColumn(
        "clarify", F.col("by_score") != F.col("by_gap"))


def headline_default(text: Column, has_entity: Column) -> Column:
    """explicit / ranked / default (the headline is assumed and said so) / cannot_tell."""
    return (
        F.when(text.rlike(WHOLE), "explicit")
        .when(text.rlike(RANK_WORDS) | text.rlike(COMPARE_WORDS), "ranked")
        .when(text.rlike(VAGUE), "explicit")
        .when(has_entity & text.rlike(VAGUE_ASK), "default")
        .otherwise("cannot_tell")
    )


def check_premise(claims: DataFrame, score: DataFrame, members: DataFrame) -> DataFrame:
    """A claimed rise or fall against the scores: ``claims(question_id, text, entity, periods)``.

    contradicted / agrees / equal; questions without a claim or with fewer than two scores are not judged.
    """
    claimed = F.when(F.col("text").rlike(DOWN_WORDS), "down").when(F.col("text").rlike(UP_WORDS), "up")
    rows = claims.withColumn("claimed", claimed).filter("claimed is not null").select("question_id", "claimed", "entity", F.explode("periods").alias("period"))
    valued = rows.join(score.select("period", "entity", "score"), ["period", "entity"])
    ends = valued.groupBy("question_id", "claimed", "entity").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("period", "score")).alias("a"), F.max(F.struct("period", "score")).alias("b")).filter("n > 1")
    tiers = score.join(members, "entity").groupBy("period", "tier").agg(F.round(R.exact_mean(), 2).alias("tier_mean"))
    actual = F.when(F.col("b.score") > F.col("a.score"), "up").when(F.col("b.score") < F.col("a.score"), "down").otherwise("equal")
    return (
        ends.withColumn("actual", actual).withColumn("period", F.col("b.period")).join(members, "entity").join(tiers, ["period", "tier"])
        .select("question_id", "claimed", "actual",
                F.when(F.col("claimed") == F.col("actual"), "agrees").when(F.col("actual") == "equal", "equal").otherwise("contradicted").alias("verdict"),
                (F.col("b.score") - F.col("tier_mean")).alias("above_tier"))
    )


def verify_search(labelled: DataFrame, hits: DataFrame) -> DataFrame:
    """A question with a period and an entity that was searched: did anything with a number come back?

    ``hits(question_id, text)``, one row per returned text.
    """
    got = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("text").rlike(r"\d")).alias("numbers"))
    needs = (F.size("targets") > 0) & (F.size("entities") > 0)
    return labelled.join(got, "question_id", "left").select(
        "question_id",
        F.when(~needs, "not applicable").when(F.col("n").isNull(), "no hits").when(~F.col("numbers"), "no number").otherwise("ok").alias("status"))


def hard_limits(text: Column) -> Column:
    found_ = F.transform(F.regexp_extract_all(text, F.lit(LIMIT), F.lit(0)), lambda x: F.regexp_replace(F.trim(x), "^的+", ""))
    return F.array_distinct(F.filter(found_, lambda x: F.length(x) >= 2))


def phrasing_flags(text: Column) -> Column:
    return F.struct(text.rlike(MULTI_STEP).alias("multi_step"), text.rlike(PREFERENCE).alias("preference"))


def top_wanted(text: Column) -> Column:
    """N of "top N", in digits or as a numeral."""
    word = F.regexp_extract(text, TOP_N, 1)
    return F.when(word != "", numeral(word))


def ranked_requirement(text: Column, tier_word: str = TIER_WORD) -> Column:
    """struct(tier, n) of a ranked question: the largest N among its ranking words."""
    n = F.greatest(*[F.when(F.contains(text, F.lit(w)), k) for w, k in TOP_WORDS])
    tier = F.regexp_extract(text, tier_word, 1)
    return F.struct(F.when(tier != "", tier).alias("tier"), n.alias("n"))


# ---- answers ------------------------------------------------------------------------------------------------


def question_kind(labelled: DataFrame, wanted: Column | None = None) -> Column:
    """What is asked, by precedence: metadata, metric (of entities, or its list), all metrics, top n, tier mean, tier membership, tier list, headline (or its list).

    ``wanted``: :func:`top_wanted`, where it is a column already.
    """
    text = F.col("text")
    component = F.col("metric").isNotNull() & ~F.col("metric").isin(*HEADLINE)
    one = F.size("entities") == 1
    return (
        F.when(text.rlike(META_WORDS), "metadata")
        .when(component & ~text.rlike(WHOLE), F.when(F.size("entities") == 0, "metric_list").otherwise("metric"))
        .when(one & F.contains(text, F.lit("各项")), "all_metrics")
        .when((top_wanted(text) if wanted is None else wanted).isNotNull() & (F.size("entities") == 0), "top_n")
        .when(F.col("tier").isNotNull() & text.rlike(MEAN_WORDS), "tier_mean")
        .when((F.size("entities") > 0) & F.contains(text, F.lit("档")), "tier_of")
        .when(F.col("tier").isNotNull(), "tier_list")
        .when((F.size("entities") == 0) & text.rlike(WORST_WORDS), "lowest")
        .when(F.size("entities") > 0, "headline")
        .when(F.col("metric").isin(*HEADLINE) | text.rlike(WHOLE), "headline_list")
        .otherwise("cannot_tell")
    )


def fact_table(score: DataFrame, metric_score: DataFrame, members: DataFrame, meta: DataFrame) -> DataFrame:
    """Everything a question can be answered with, under one key: (kind, key, place, subject, value, source).

    ``place`` orders the facts of a key where a question may ask for the first ones. The table is as long as its score tables, whatever the number of questions.
    """
    c, none = F.col, F.lit(None).cast("string")
    ranked = R.rank_table(score)
    placed = score.join(members, "entity")
    means = placed.groupBy("period", "tier").agg(F.round(R.exact_mean(), 2).alias("tier_mean"))
    low = score.groupBy("period").agg(F.min("score").alias("score"))
    every = F.array(*[F.struct(F.lit(x).alias("field"), c(x).cast("double").alias("value")) for x in META_LINES if x in meta.columns])
    parts = []

    def facts(kind: str, df: DataFrame, key: list[Column], subject: Column, value: Column, source: Column, place: Column | None = None) -> None:
        parts.append(df.select(F.lit(kind).alias("kind"), F.concat_ws("|", *key).alias("key"), (F.lit(0) if place is None else place).cast("int").alias("place"),
                               subject.alias("subject"), value.cast("double").alias("value"), source.alias("source")))

    facts("metadata", meta.select("period", F.inline(every)), [c("period")], c("field"), c("value"), none)
    facts("metric", metric_score, [c("period"), c("metric"), c("entity")], c("entity"), c("score"), c("source"))
    for worst in (False, True):
        listed = top_n(metric_score, LISTED, ["period", "metric"], worst=worst)
        facts("metric_list", listed, [c("period"), c("metric"), F.lit(str(worst).lower())], c("entity"), c("score"), c("source"))
    facts("headline_list", ranked.filter(c("row_no") <= LISTED), [c("period")], c("entity"), c("score"), c("source"))
    facts("all_metrics", metric_score, [c("period"), c("entity")], c("metric"), c("score"), c("source"))
    facts("top_n", ranked, [c("period")], c("entity"), c("score"), c("source"), c("row_no"))
    facts("tier_mean", means, [c("period"), c("tier")], c("tier"), c("tier_mean"), none)
    facts("tier_of", placed, [c("period"), c("entity")], c("tier"), c("score"), c("source"))
    facts("tier_list", placed, [c("period"), c("tier")], c("entity"), c("score"), c("source"))
    facts("lowest", score.join(low, ["period", "score"]), [c("period")], c("entity"), c("score"), c("source"))
    facts("headline", score, [c("period"), c("entity")], c("entity"), c("score"), c("source"))
    return reduce(DataFrame.unionByName, parts)


def answer_questions(routed: DataFrame, names: DataFrame, score: DataFrame, metric_score: DataFrame, members: DataFrame, meta: DataFrame) -> DataFrame:
    """Answer lines for all questions routed to the tables: (question_id, kind, period, subject, value, source).

    A question becomes keys of the fact table, one for each period (and entity, where its kind asks for one); one join answers them all.
    """
    c = F.col
    several = (F.size("explicit") > 1) & (F.size("entities") > 1)
    asked = routed.filter("route = 'sql'").withColumn("_word", F.regexp_extract("text", TOP_N, 1)).withColumn("n", F.when(c("_word") != "", numeral(c("_word"))))
    asked = asked.withColumn("kind", question_kind(asked, c("n")))
    asked = asked.select("question_id", "kind", "metric", "tier", "entities", "n", F.col("text").rlike(WORST_WORDS).alias("worst"),
                         several.alias("several"), F.explode("targets").alias("period"))
    of = F.when(c("kind").isin(*OF_ENTITIES), c("entities")).otherwise(F.array(F.lit(None).cast("string")))
    every = durable(asked.withColumn("entity", F.explode(of)).drop("entities"))  # read twice
    pairs = durable(pair_mentions(routed.filter("route = 'sql'"), names))
    # a paired question is asked about its pairs only, any other about every combination; only a question of several can be paired
    meet = c("several") & c("kind").isin(*OF_ENTITIES)
    marked = every.filter(meet).join(pairs.withColumn("_pair", F.lit(True)), ["question_id", "entity", "period"], "left").join(
        pairs.select("question_id").distinct().withColumn("_paired", F.lit(True)), "question_id", "left")
    each = marked.filter(c("_paired").isNull() | c("_pair")).drop("_pair", "_paired")
    rest = every.filter(~F.coalesce(meet, F.lit(False)))
    key = (F.when(c("kind") == "metric", F.concat_ws("|", "period", "metric", "entity")).when(c("kind") == "metric_list", F.concat_ws("|", "period", "metric", c("worst").cast("string")))
           .when(c("kind").isin(*OF_ENTITIES), F.concat_ws("|", "period", "entity")).when(c("kind").isin("tier_mean", "tier_list"), F.concat_ws("|", "period", "tier")).otherwise(c("period")))
    wanted = each.unionByName(rest).select("question_id", "kind", "period", "n", key.alias("key"))
    facts = durable(fact_table(score, metric_score, members, meta))
    facts = F.broadcast(facts) if facts.count() <= FACT_ROWS else facts
    return wanted.join(facts, ["kind", "key"]).filter((c("kind") != "top_n") | (c("place") <= c("n"))).select("question_id", "kind", "period", "subject", "value", "source")


def comparison_lines(answers: DataFrame) -> DataFrame:
    """Where a headline question found exactly two values: their difference and the higher one."""
    pair = answers.filter("kind = 'headline'").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("period", "subject", "value")).alias("a"), F.max(F.struct("period", "subject", "value")).alias("b")).filter("n = 2")
    cents = lambda x: F.round(x * 100).cast("bigint")
    gap = cents(F.col("b.value")) - cents(F.col("a.value"))
    name = lambda s: F.concat_ws(" ", F.col(f"{s}.period"), F.col(f"{s}.subject"))
    return pair.select("question_id", (F.abs(gap) / 100).alias("difference"), F.when(gap > 0, name("b")).when(gap < 0, name("a")).otherwise("equal").alias("higher"))


def lookup_outcome(routed: DataFrame, answers: DataFrame) -> DataFrame:
    """ok / incomplete / not covered / nothing found / cannot answer, beside the parameters that were used."""
    got = answers.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_lines"))
    kind = question_kind(routed)
    status = (
        F.when(F.col("n_lines") > 0, "ok")
        .when((F.col("route") == "refuse") & (F.col("reason") == "no period"), "incomplete")
        .when(F.col("route") == "refuse", "not covered")
        .when(F.col("route") != "sql", "cannot answer")
        .when(kind == "cannot_tell", "cannot answer")
        .otherwise("nothing found")
    )
    return routed.join(got, "question_id", "left").select(
        "question_id", status.alias("status"), F.array_join("targets", "/").alias("used_periods"), F.array_join("entities", "/").alias("used_entities"),
        F.col("metric").alias("used_metric"))


def turn_outcome(results: Column) -> Column:
    """answered, no answer (work was tried and all of it came back empty), or not applicable (nothing was tried)."""
    return F.when(F.size(results) == 0, "not applicable").when(F.exists(results, lambda r: r.isNotNull() & (r != "")), "answered").otherwise("no answer")


def stated_comparison(claims: DataFrame, score: DataFrame) -> DataFrame:
    """"A-period value < B-period value" checked on the scores: ``claims(claim_id, text, entity)``.

    true / false / undecidable, with both numbers shown.
    """
    text = F.col("text")
    both = F.transform(F.regexp_extract_all(text, F.lit(PERIOD_LOOSE), F.lit(0)), lambda p: F.upper(F.regexp_replace(p, r"\s", "")))
    sign = F.when(text.rlike("<|低于|小于|不如"), -1).when(text.rlike(">|高于|大于|超过"), 1)
    parsed = claims.select("claim_id", "entity", F.get(both, F.lit(0)).alias("a"), F.get(both, F.lit(1)).alias("b"), sign.alias("sign"))
    s = score.select("entity", "period", "score")
    left = s.select("entity", F.col("period").alias("a"), F.col("score").alias("a_score"))
    right = s.select("entity", F.col("period").alias("b"), F.col("score").alias("b_score"))
    joined = parsed.join(left, ["entity", "a"], "left").join(right, ["entity", "b"], "left")
    diff = F.col("a_score") - F.col("b_score")
    return joined.select(
        "claim_id", "a", "b", "a_score", "b_score",
        F.when(F.col("sign").isNull() | diff.isNull(), "undecidable").when(F.signum(diff.cast("double")) == F.col("sign"), "true").otherwise("false").alias("verdict"))
