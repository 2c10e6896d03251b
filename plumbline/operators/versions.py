"""Versions of one page across periods: exact after normalisation, or by shared shingles.

Copies of one content may be a large part of the corpus, so nothing here lists a group's members:
a group is its key, its representative and its counts, and members find it by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numbers import canonical_numbers
from plumbline.functions.periods import PERIOD_TOKEN, period_ord
from plumbline.operators.matching import grams
from plumbline.session import durable

# Fixed values
PERIOD_MARK = "◇"
SAME_PAGE = 0.95
SHINGLE = 8
EXCERPT = 70


def normalised(text: Column) -> Column:
    """Quarter tokens masked, all whitespace removed."""
    return F.regexp_replace(F.regexp_replace(text, PERIOD_TOKEN, PERIOD_MARK), r"\s+", "")


def content_key(text: Column) -> Column:
    return F.md5(normalised(text).cast("binary"))


def kind_family(kind: Column) -> Column:
    """The part of a page kind before ``·``."""
    return F.substring_index(kind, "·", 1)


def keyed(chunks: DataFrame, within: list[str]) -> DataFrame:
    """Chunks with their content key and group columns; the text itself is left behind."""
    return chunks.select(
        "chunk_id", "period", *[c for c in within if c != "kind"], kind_family(F.col("page_kind")).alias("kind"),
        content_key(F.col("text")).alias("key"),
    )


def version_groups(chunks: DataFrame, within: list[str] | None = None) -> DataFrame:
    """One row per version: representative (first chunk id), its period, span and member counts.

    Members are first counted per (group, key, period), so a content copied a billion times arrives as
    one row per period and map task.
    """
    within = within or ["kind"]
    per_period = keyed(chunks, within).groupBy(*within, "key", "period").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_id")
    )
    return per_period.groupBy(*within, "key").agg(
        F.sum("n").alias("members"),
        F.count(F.lit(1)).alias("n_periods"),
        F.min("first_id").alias("rep_id"),
        F.min(F.struct("first_id", "period"))["period"].alias("rep_period"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.array_join(F.sort_array(F.collect_set("period")), "/").alias("periods"),  # a calendar's length
    )


def version_members(chunks: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Each chunk with the representative of its version."""
    within = within or ["kind"]
    groups = version_groups(chunks, within).select(*within, "key", "rep_id", "members")
    return keyed(chunks, within).join(groups, [*within, "key"]).select("chunk_id", "period", "rep_id", "members")


def version_notes(chunks: DataFrame, page: list[str]) -> DataFrame:
    """Per page with several versions: how many, their span, an excerpt and whether their numbers differ.

    ``page`` names the columns that say which chunks are the same page.
    """
    rows = chunks.select(
        *page, "chunk_id", "period", content_key(F.col("text")).alias("key"),
        F.substring("text", 1, EXCERPT).alias("excerpt"),
        F.array_join(canonical_numbers(F.regexp_replace("text", PERIOD_TOKEN, "")), ",").alias("numbers"),
    )
    versions = rows.groupBy(*page, "key").agg(
        F.min(F.struct("chunk_id", "excerpt", "numbers")).alias("rep"), F.min("period").alias("a"), F.max("period").alias("b")
    )
    return versions.groupBy(*page).agg(
        F.count(F.lit(1)).alias("n_versions"),
        F.min("a").alias("first_period"),
        F.max("b").alias("last_period"),
        F.min("rep")["excerpt"].alias("excerpt"),
        (F.countDistinct("rep.numbers") > 1).alias("numbers_differ"),
    ).filter("n_versions > 1")


def page_versions(chunks: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """One row per version of the wanted pages: ``pages(*page, kind)`` and the key, representative, span, excerpt and numbers of each version.

    Only chunks of a wanted page are normalised. ``n_versions`` is the number of versions of the row's page.
    """
    rows = chunks.withColumn("kind", kind_family(F.col("page_kind"))).join(pages.select(*page, "kind").distinct(), [*page, "kind"], "left_semi")
    facts = rows.select(
        *page, "kind", "chunk_id", "period", content_key(F.col("text")).alias("key"), F.substring("text", 1, EXCERPT).alias("excerpt"),
        F.array_join(canonical_numbers(F.regexp_replace("text", PERIOD_TOKEN, "")), ",").alias("numbers"))
    versions = facts.groupBy(*page, "kind", "key").agg(
        F.min(F.struct("chunk_id", "excerpt", "numbers")).alias("rep"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    counts = versions.groupBy(*page, "kind").agg(F.count(F.lit(1)).alias("n_versions"))
    return versions.join(counts, [*page, "kind"]).select(
        *page, "kind", "n_versions", F.col("rep.chunk_id").alias("rep_id"), "first_period", "last_period", F.col("rep.excerpt").alias("excerpt"), F.col("rep.numbers").alias("numbers"))


def _open_pages(hits: DataFrame, chunks: DataFrame, queries: DataFrame, page: list[str]) -> DataFrame:
    """(query_id, *page, kind): pages of the hits of queries that name no period; the best hit of a page says the kind."""
    free = queries.filter(F.coalesce(F.size("periods") <= 0, F.lit(True))).select("query_id")
    where = chunks.select(F.col("chunk_id").alias("id"), *page, kind_family(F.col("page_kind")).alias("kind"))
    at = hits.join(free, "query_id", "left_semi").join(where, "id")
    return at.groupBy("query_id", *page).agg(F.min(F.struct("rank", "kind"))["kind"].alias("kind"))


def version_aware(hits: DataFrame, chunks: DataFrame, queries: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sources and notes of ranked hits; a query that names no period is told of every version of the pages it hit.

    ``hits(query_id, id, rank)``; ``queries(query_id, periods)``, null or empty for none; ``page`` names the columns that say which chunks are one page over the periods.
    Sources: (query_id, id, origin), the hits and, of pages with several versions, the representative of each. Notes: (query_id, *page, kind, n_versions,
    first_period, last_period, excerpt, numbers_differ).
    """
    opened = durable(_open_pages(hits, chunks, queries, page))
    versions = durable(page_versions(chunks, opened, page).filter("n_versions > 1"))
    told = opened.join(versions, [*page, "kind"])
    more = told.select("query_id", F.col("rep_id").alias("id"), F.lit("version").alias("origin"))
    own = hits.select("query_id", "id", F.lit("hit").alias("origin"))
    sources = own.unionByName(more).groupBy("query_id", "id").agg(F.min("origin").alias("origin"))
    notes = told.groupBy("query_id", *page, "kind").agg(
        F.count(F.lit(1)).alias("n_versions"), F.min("first_period").alias("first_period"), F.max("last_period").alias("last_period"),
        F.min(F.struct("rep_id", "excerpt"))["excerpt"].alias("excerpt"), (F.countDistinct("numbers") > 1).alias("numbers_differ"))
    return sources, notes


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct n-grams of the normalised text."""
    return F.array_distinct(grams(normalised(text), n))


def containment(part: Column, whole: Column) -> Column:
    """Share of the first shingle set found in the second; NULL when there is none."""
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two shingle sets (arrays of distinct shingles); equal empty sets are the same page."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def compare_pages(pairs: DataFrame, chunks: DataFrame, left: str, right: str, same: list[str]) -> DataFrame:
    """Similarity of given id pairs that share the ``same`` columns.

    Pairs meet period, kind and content key only; equal keys need no text. Of the pairs of different contents one each fetches its two texts, which
    are unfolded into shingles where both lie, so no shingle is shuffled.
    """
    ids = pairs.select(F.col(left).alias("chunk_id")).union(pairs.select(F.col(right))).distinct()
    facts = durable(chunks.select("chunk_id", "period", *same, content_key(F.col("text")).alias("key")).join(ids, "chunk_id", "left_semi"))
    a = facts.select(F.col("chunk_id").alias(left), F.col("period").alias("p1"), *[F.col(c).alias(f"{c}_1") for c in same], F.col("key").alias("k1"))
    b = facts.select(F.col("chunk_id").alias(right), F.col("period").alias("p2"), *[F.col(c).alias(f"{c}_2") for c in same], F.col("key").alias("k2"))
    both = pairs.join(a, left).join(b, right)
    for c in same:
        both = both.filter(F.col(f"{c}_1") == F.col(f"{c}_2"))
    both = durable(both.select(*pairs.columns, "p1", "p2", "k1", "k2"))
    # a similarity belongs to two contents; the first pair of ids that holds them fetches the texts, so copies never meet one text
    unlike = both.filter("k1 <> k2").groupBy("k1", "k2").agg(F.min(F.struct(F.col(left).alias("l"), F.col(right).alias("r"))).alias("at"))
    unlike = durable(unlike.select("k1", "k2", F.col("at.l").alias("l"), F.col("at.r").alias("r")))
    ends = unlike.select(F.col("l").alias("chunk_id"), F.col("k1").alias("key")).union(unlike.select("r", "k2")).distinct()
    texts = chunks.select("chunk_id", "text").join(ends.select("chunk_id").distinct(), "chunk_id", "left_semi")
    if facts.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():  # an id with several rows: one text of each content
        texts = texts.withColumn("key", content_key(F.col("text"))).join(ends, ["chunk_id", "key"], "left_semi").dropDuplicates(["chunk_id", "key"])
        first, second = ([F.col("chunk_id").alias(i), F.col("key").alias(k), F.col("text").alias(x)] for i, k, x in (("l", "k1", "x1"), ("r", "k2", "x2")))
        met = unlike.join(texts.select(*first), ["l", "k1"]).join(texts.select(*second), ["r", "k2"])
    else:
        met = unlike.join(texts.select(F.col("chunk_id").alias("l"), F.col("text").alias("x1")), "l").join(texts.select(F.col("chunk_id").alias("r"), F.col("text").alias("x2")), "r")
    alike = met.select("k1", "k2", shingles(F.col("x1")).alias("s1"), shingles(F.col("x2")).alias("s2")).select("k1", "k2", similarity(F.col("s1"), F.col("s2")).alias("unlike"))
    return both.join(alike, ["k1", "k2"], "left").select(
        *pairs.columns, "p1", "p2", F.when(F.col("k1") == F.col("k2"), 1.0).otherwise(F.col("unlike")).alias("similarity"))


def evidence(pairs: DataFrame, chunks: DataFrame, same: list[str]) -> DataFrame:
    """Did the given ids contain the wanted page? ``pairs(question_id, want, got)``.

    ``direct``: the page itself. ``relaxed``: the same page of another period with the same content.
    ``conflict``: the same page of another period that says something else.
    """
    compared = compare_pages(pairs.filter(F.col("want") != F.col("got")), chunks, "want", "got", same).filter("p1 <> p2")
    near = compared.groupBy("question_id").agg(
        F.bool_or(F.col("similarity") >= SAME_PAGE).alias("relaxed"), F.bool_or(F.col("similarity") < SAME_PAGE).alias("conflict"))
    direct = pairs.groupBy("question_id").agg(F.bool_or(F.col("want") == F.col("got")).alias("direct"))
    return direct.join(near, "question_id", "left").select(
        "question_id", "direct", (~F.col("direct") & F.coalesce("relaxed", F.lit(False))).alias("relaxed"),
        F.coalesce("conflict", F.lit(False)).alias("conflict"),
    )


def boundary_sides(asks: DataFrame, chunks: DataFrame, page: list[str]) -> DataFrame:
    """Both sides of a stated boundary period must be hit.

    ``asks(question_id, *page, cut, got)``: one row per returned chunk id of the question.
    """
    got = chunks.select(F.col("chunk_id").alias("got"), *page, "period")
    side = period_ord(F.col("period")) < period_ord(F.col("cut"))
    hits = asks.join(got, ["got", *page], "left")
    return hits.groupBy("question_id").agg(
        F.coalesce(F.bool_or(side), F.lit(False)).alias("before"), F.coalesce(F.bool_or(~side), F.lit(False)).alias("after")
    ).withColumn("n_sides", F.col("before").cast("int") + F.col("after").cast("int"))
