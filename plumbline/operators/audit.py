"""Does an answer say only what its sources say, and all that they say?

``answers(answer_id, answer, sources array<string>, source_text[, terms])``. All checks are column expressions on
one row; only ranking completeness and segment attribution need joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import ORDINAL, canonical_numbers, let
from plumbline.functions.periods import CHUNK_ID
from plumbline.operators.evaluate import MONEY
from plumbline.operators.extract import CITED, cited_ids
from plumbline.operators.label import NAME_LIKE, is_generic
from plumbline.operators.topk import top_n_with_ties
from plumbline.operators.versions import containment, content_key, shingles

# Fixed values
SAYS_NONE = "材料里没有|材料中没有|材料里不包含|没有提到|未提及|无法确定|没有相关|未找到|没有找到"
MIN_TERM, MIN_SEGMENT, LOW, TIE = 3, 12, 0.35, 0.02
CLASSES = ("said missing but present", "incomplete ranking", "invented number", "invented citation", "invented entity")
ACTIONS = {
    "incomplete ranking": ("compute and append", "once"),
    "invented number": ("regenerate", "again"),
    "invented citation": ("regenerate", "again"),
    "invented entity": ("regenerate", "again"),
}


def stated_numbers(answer: Column) -> Column:
    """Numbers of an answer without its citations and ordinals."""
    return canonical_numbers(F.regexp_replace(F.regexp_replace(answer, CITED, " "), ORDINAL, " "))


def invented_numbers(answer: Column, source_text: Column) -> Column:
    """Stated numbers that the sources neither hold nor give as a difference of two numbers."""
    def derived(m, nums):
        d = m.try_cast(MONEY)  # a number too long for money is no difference of two
        return F.coalesce((d > 0) & F.arrays_overlap(nums, F.transform(nums, lambda a: (a - d).try_cast(MONEY))), F.lit(False))

    def missing(have):
        nums = F.filter(F.transform(have, lambda x: x.try_cast(MONEY)), lambda x: x.isNotNull())
        return let(nums, lambda known: F.filter(F.array_except(stated_numbers(answer), have), lambda m: ~derived(m, known)))

    return let(canonical_numbers(source_text), missing)


def invented_citations(answer: Column, sources: Column) -> Column:
    return F.array_except(cited_ids(answer), sources)


def invented_entities(answer: Column, source_text: Column, name: str = NAME_LIKE) -> Column:
    """Whatever looks like a name, known or not, and is not in the sources; generic mentions do not count."""
    names = F.array_distinct(F.regexp_extract_all(answer, F.lit(name), F.lit(0)))
    return F.filter(names, lambda w: ~is_generic(w) & ~F.contains(source_text, w))


def missed_terms(answer: Column, terms: Column, source_text: Column) -> Column:
    """Search terms that are in the sources although the answer says that nothing is."""
    there = F.filter(terms, lambda t: (F.length(t) >= MIN_TERM) & F.contains(source_text, t))
    return F.when(answer.rlike(SAYS_NONE), there).otherwise(F.array().cast("array<string>"))


def incomplete_rankings(asked: DataFrame, scores: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Entities that belong to a complete top ``n`` with ties but are not in the answer.

    ``asked(answer_id, *keys, answer)``; the expected set is computed from the table, never from the answer.
    """
    expected = top_n_with_ties(scores, n, keys)
    return asked.join(expected, keys).filter(~F.contains("answer", F.col("entity"))).select(
        "answer_id", "entity", "score", "source")


def supplement(asked: DataFrame, missing: DataFrame) -> DataFrame:
    """The answer with its missing items appended, each with its source. A cut list and its ties bound the group."""
    item = F.concat("entity", F.lit(" "), F.col("score").cast("string"), F.lit("（出处: "), "source", F.lit("）"))
    more = missing.groupBy("answer_id").agg(F.array_join(F.sort_array(F.collect_list(item)), "；").alias("more"), F.count(F.lit(1)).alias("n_added"))
    return asked.join(more, "answer_id", "left").select(
        "answer_id", F.concat_ws("\n补充：", "answer", "more").alias("answer"), F.coalesce("n_added", F.lit(0)).alias("n_added"))


def diagnose(answers: DataFrame, incomplete: DataFrame | None = None, name: str = NAME_LIKE) -> DataFrame:
    """The first failure class by fixed precedence, what exactly it is, and the action for it."""
    a, src = F.col("answer"), F.col("source_text")
    rows = answers
    if incomplete is not None:
        listed = incomplete.groupBy("answer_id").agg(F.min("entity").alias("_short"))
        rows = rows.join(listed, "answer_id", "left").withColumn("_ranking", F.when(F.col("_short").isNotNull(), F.array("_short")).otherwise(F.array().cast("array<string>")))
    else:
        rows = rows.withColumn("_ranking", F.array().cast("array<string>"))
    checks = (
        missed_terms(a, F.col("terms"), src), F.col("_ranking"), invented_numbers(a, src), invented_citations(a, F.col("sources")), invented_entities(a, src, name))
    staged = rows.select("answer_id", *[c.alias(f"c{i}") for i, c in enumerate(checks)])
    label, what = None, None
    for i, kind in enumerate(CLASSES):
        hit = F.size(f"c{i}") > 0
        label = F.when(hit, kind) if label is None else label.when(hit, kind)
        brief = F.array_join(F.slice(F.sort_array(f"c{i}"), 1, 2), "/")
        what = F.when(hit, brief) if what is None else what.when(hit, brief)
    action = F.create_map(*[F.lit(x) for k, v in ACTIONS.items() for x in (k, v[0])])
    return staged.select("answer_id", label.alias("failure"), what.alias("what")).withColumn("action", F.element_at(action, F.col("failure")))


def attribute_segments(answers: DataFrame, given: DataFrame, chunks: DataFrame, split: str = "[。\n]") -> DataFrame:
    """Each segment of an answer to the expected content, another page, or nothing.

    ``answers(answer_id, answer, expected)``, ``given(answer_id, chunk_id)``. Only the pages that were given are shingled
    and only against the segments of their own answer.
    """
    parts = F.filter(F.transform(F.split("answer", split), lambda s: F.trim(s)), lambda s: F.length(s) >= MIN_SEGMENT)
    segments = answers.select("answer_id", "expected", F.posexplode(parts).alias("segment_no", "segment")).withColumn("s", shingles(F.col("segment")))
    used = chunks.join(given.select("chunk_id").distinct(), "chunk_id", "left_semi").select(
        "chunk_id", shingles(F.col("text")).alias("g"), content_key(F.col("text")).alias("key"))
    family = chunks.select(F.col("chunk_id").alias("expected"), content_key(F.col("text")).alias("family"))
    scored = segments.join(given, "answer_id").join(used, "chunk_id").join(family, "expected").select(
        "answer_id", "segment_no", F.length("segment").alias("n_chars"), (F.col("key") == F.col("family")).alias("mine"),
        F.coalesce(containment(F.col("s"), F.col("g")), F.lit(0.0)).alias("c"))
    best = scored.groupBy("answer_id", "segment_no", "n_chars").agg(F.max("c").alias("top"), F.max(F.when(F.col("mine"), F.col("c"))).alias("top_mine"))
    return best.select(
        "answer_id", "segment_no", "n_chars", F.round("top", 6).alias("top"),
        F.when(F.col("top") < LOW, "ungrounded").when(F.col("top_mine") >= F.col("top") - TIE, "expected").otherwise("other page").alias("kind"))


def citation_verdicts(run: DataFrame, pages: DataFrame) -> DataFrame:
    """From the cited ids alone: none, ghost (an id that does not exist), expected, or other page.

    ``run(question_id, expected_page, sources)``, ``pages(source)``.
    """
    each = run.select("question_id", "expected_page", F.explode_outer("sources").alias("source"))
    known = pages.select("source").distinct().withColumn("_known", F.lit(True))
    return each.join(known, "source", "left").groupBy("question_id").agg(
        F.count("source").alias("n"), F.count_if(F.col("source").isNotNull() & F.col("_known").isNull()).alias("ghosts"),
        F.count_if(F.col("source") == F.col("expected_page")).alias("right"),
    ).select("question_id", F.when(F.col("n") == 0, "none").when(F.col("ghosts") > 0, "ghost").when(F.col("right") == F.col("n"), "expected").otherwise("other page").alias("verdict"))


def tamper(answers: DataFrame) -> DataFrame:
    """Fault injection: one copy of each answer with a number, a citation and a name replaced, by ``fault``."""
    faults = {
        "number": F.regexp_replace("answer", r"(?<![\d.])\d+\.\d+", "987.65"),
        "citation": F.regexp_replace("answer", CHUNK_ID, "1901Q1-P99"),
        "entity": F.concat("answer", F.lit("，虚构山机场也是")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("fault"), v.alias("answer")) for k, v in faults.items()])
    return answers.select("answer_id", "sources", "source_text", F.inline(rows))


def detection_rates(answers: DataFrame) -> DataFrame:
    """Share of injected faults that the matching audit finds."""
    bad = tamper(answers)
    a, src = F.col("answer"), F.col("source_text")
    seen = (
        F.when(F.col("fault") == "number", F.size(invented_numbers(a, src)) > 0)
        .when(F.col("fault") == "citation", F.size(invented_citations(a, F.col("sources"))) > 0)
        .otherwise(F.size(invented_entities(a, src)) > 0)
    )
    return bad.select("fault", seen.alias("seen")).groupBy("fault").agg(F.count(F.lit(1)).alias("injected"), F.count_if("seen").alias("detected"))


def silent_versions(answers: DataFrame, versions: DataFrame) -> DataFrame:
    """Experimental probe: an answer repeats a number that only some versions of the page hold, without naming a period.

    ``answers(answer_id, page, answer)``, ``versions(page, number)`` from the version-specific numbers. The idea is known
    to be a weak instrument; it is kept for comparison only.
    """
    said = answers.select("answer_id", "page", F.explode(stated_numbers(F.col("answer"))).alias("number"), (~F.col("answer").rlike(r"\d{4}Q\d(?!-P)")).alias("no_period"))
    return said.join(versions.select("page", "number").distinct(), ["page", "number"]).groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("n_specific"), F.bool_and("no_period").alias("silent"))
