"""Fields, pairs and citations out of page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.periods import CHUNK_ID, page_id
from plumbline.operators.clean import SCORE, SHORT_NAME, join_vertical, split_at_average, squash
from plumbline.operators.matching import longest_mentions, phrase_occurrences

# The shapes of statements, titles and citations.
AVERAGE_STATED = r"平均\s*[：:,，]\s*(\d+\.\d+)"
TITLE = r"\d{4}Q\d内地(.{2,12}?)综合得分"
PROJECTS = r"包含测评项目[：:](.+?)。"
PROJECT_SPLIT = "[、,，]"
TIER_NAME = r"—\s*([^机]+?)\s*机场综合得分"
TIER_AVERAGE = r"(\d+\.\d+)\s*平均"
NOT_A_NAME = ("内地机场",)
META = {
    "sample_n": (r"有效样本量(\d+)份",),
    "entity_n": (r"(?:共测评|选取)(\d+)家",),
    "l1_n": (r"(\d+)项一级指标", r"一级指标(\d+)项"),
    "l2_n": (r"(\d+)项二级指标", r"二级指标(\d+)项"),
}
CITED = r"[（(]\s*出处\s*[:：]\s*([^)）]+)[)）]"
CITE_KEYS = ("表", "期次", "机场", "字段", "指标", "取前", "chunk", "页码", "分界")
FULL_WIDTH, HALF_WIDTH = "：＝，；｜", ":=,;|"
REPORT_NAME = r"(\d{4}Q\d).*?[Pp]\.?(\d+)"


def score_pages(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """Per document the page with most score tokens; ties go to the lowest page. ``pages(doc, page_no, raw)``."""
    counted = pages.select(doc, "page_no", F.regexp_count("raw", F.lit(SCORE)).alias("n_scores"))
    best = F.min(F.struct((-F.col("n_scores")).alias("k"), "page_no"))
    return counted.groupBy(doc).agg(best.alias("b")).select(doc, F.col("b.page_no").alias("page_no"), (-F.col("b.k")).alias("n_scores"))


def paired_lists(text: Column, name: str = SHORT_NAME) -> Column:
    """struct(names, scores, stated): scores before the average, names after it, the stated average apart."""
    whole = join_vertical(text)
    head, tail = split_at_average(whole)
    stated = F.regexp_extract(whole, AVERAGE_STATED, 1)
    names = F.filter(F.regexp_extract_all(squash(tail), F.lit(name), F.lit(0)), lambda n: ~n.isin(*NOT_A_NAME))
    return F.struct(
        names.alias("names"),
        F.transform(F.regexp_extract_all(head, F.lit(SCORE), F.lit(0)), lambda s: s.try_cast("decimal(6,2)")).alias("scores"),
        F.when(stated != "", stated.try_cast("decimal(6,2)")).alias("stated"),
    )


def extract_pairs(pages: DataFrame, name: str = SHORT_NAME) -> DataFrame:
    """``pages(period, page_no, raw)`` to (period, entity, score, source, place); ``rejected_pages`` has the pages without rows."""
    lists = pages.select("period", "page_no", paired_lists(F.col("raw"), name).alias("p"))
    return lists.filter(_page_fault().isNull()).select(
        "period", page_id(F.col("period"), F.col("page_no")).alias("source"), F.posexplode(F.arrays_zip("p.names", "p.scores")).alias("place", "x")
    ).select("period", F.col("x.names").alias("entity"), F.col("x.scores").alias("score"), "source", (F.col("place") + 1).alias("place"))


def _page_fault() -> Column:
    """Why the lists ``p`` of a page can't be paired; NULL when they can."""
    names, scores = F.coalesce(F.size("p.names"), F.lit(0)), F.coalesce(F.size("p.scores"), F.lit(0))  # a blank page has no lists
    return (
        F.when((scores == 0) & (names == 0), "no scores")
        .when(names != scores, "counts differ")
        .when(F.exists("p.scores", lambda s: s.isNull()), "score out of range")
    )


def rejected_pages(pages: DataFrame, name: str = SHORT_NAME) -> DataFrame:
    """The pages that ``extract_pairs`` gives no rows for: (period, source, n_names, n_scores, reason)."""
    lists = pages.select("period", "page_no", paired_lists(F.col("raw"), name).alias("p"))
    return lists.withColumn("reason", _page_fault()).filter("reason is not null").select(
        "period", page_id(F.col("period"), F.col("page_no")).alias("source"), F.size("p.names").alias("n_names"), F.size("p.scores").alias("n_scores"), "reason")


def metric_of_title(titles: DataFrame, official: DataFrame) -> DataFrame:
    """The official metric that a page title ends with: longest wins, two of one length are ambiguous.

    ``titles(page_id, candidate)``, ``official(metric)``. Candidates are unfolded into their suffixes, so the
    official list is met by equality; only suffixes as long as some official name go there. Both joins are shuffles, for no side is
    sure to fit a broadcast: suffixes are many times the titles that sizes are estimated from.
    """
    names = official.select("metric").distinct()
    lengths = names.agg(F.collect_set(F.length("metric")).alias("lengths"))  # one row, at most as many values as the longest name has characters
    every = F.transform(F.sequence(F.lit(1), F.length("candidate")), lambda k: F.substring(F.col("candidate"), k, F.length("candidate")))
    suffixes = titles.join(F.broadcast(lengths)).select(
        "page_id", F.explode(F.filter(every, lambda x: F.array_contains("lengths", F.length(x)))).alias("metric"))
    hits = suffixes.join(names.hint("shuffle_merge"), "metric").groupBy("page_id").agg(
        F.max(F.struct(F.length("metric").alias("n"), "metric"))["metric"].alias("metric"))
    return titles.join(hits.hint("shuffle_merge"), "page_id", "left").select(
        "page_id", "metric", F.when(F.col("metric").isNull(), "none").otherwise("ok").alias("status"))


def title_candidate(text: Column) -> Column:
    found = F.regexp_extract(text, TITLE, 1)
    return F.when(found != "", found)


def official_lists(docs: DataFrame, pattern: str = PROJECTS, split: str = PROJECT_SPLIT) -> DataFrame:
    """Name lists repeated in a document: the set must agree, the order may vary. ``docs(doc, text)``."""
    lists = docs.select("doc", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("raw"))
    names = F.filter(F.transform(F.split("raw", split), lambda x: F.trim(x)), lambda x: x != "")
    per = lists.select("doc", "raw", F.array_join(F.sort_array(names), "/").alias("names"))
    return per.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_lists"), F.countDistinct("names").alias("n_sets"), F.countDistinct("raw").alias("n_orders"),
        F.min("names").alias("names"),
    ).withColumn("agrees", F.col("n_sets") == 1)


def metric_coverage(found: DataFrame, official: DataFrame) -> DataFrame:
    """Metrics found on pages against the official names, both differences. ``found(doc, metric)``, ``official(doc, metric)``."""
    a = found.select("doc", "metric").distinct().withColumn("_f", F.lit(True))
    b = official.select("doc", "metric").distinct().withColumn("_o", F.lit(True))
    return a.join(b, ["doc", "metric"], "full_outer").filter(F.col("_f").isNull() | F.col("_o").isNull()).select(
        "doc", "metric", F.when(F.col("_f").isNull(), "page missing").otherwise("not official").alias("problem"))


def pick_one(text: Column, patterns: tuple[str, ...]) -> Column:
    """struct(value, status) over synonymous patterns: exactly one distinct value, else missing or conflict."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
    return F.struct(
        F.when(F.size(found) == 1, found[0]).alias("value"),
        F.when(F.size(found) == 0, "missing").when(F.size(found) == 1, "ok").otherwise("conflict").alias("status"),
    )


def read_meta(pages: DataFrame, fields: dict[str, tuple[str, ...]] = META) -> DataFrame:
    """Metadata of whole documents, from distinct matches per page. ``pages(doc, page_no, raw)``.

    Pages are searched where they lie and only the values found are grouped; no document is assembled.
    """
    text = squash(F.col("raw"))
    found = [F.struct(F.lit(f).alias("field"), F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ps]).alias("values")) for f, ps in fields.items()]
    per = pages.select("doc", F.inline(F.array(*found)))
    values = per.select("doc", "field", F.explode("values").alias("value")).distinct()
    counted = values.groupBy("doc", "field").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    every = pages.select("doc").distinct().select("doc", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    return every.join(counted, ["doc", "field"], "left").select(
        "doc", "field", F.when(F.col("n") == 1, F.col("value")).alias("value"),
        F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "ok").otherwise("conflict").alias("status"))


def version_in(text: Column) -> Column:
    """``L1+L2`` read from free text; NULL unless both parts have one value."""
    flat = squash(text)
    a, b = pick_one(flat, META["l1_n"]), pick_one(flat, META["l2_n"])
    return F.when(a["value"].isNotNull() & b["value"].isNotNull(), F.concat_ws("+", a["value"], b["value"]))


def tier_pages(pages: DataFrame, names: DataFrame, tier: str = TIER_NAME, average: str = TIER_AVERAGE) -> DataFrame:
    """(period, entity, tier, tier_avg, source): names on a tier page, a name inside a longer one does not count.

    ``pages(source, period, raw)``, ``names(entity)``. An entity on several tier pages of a period keeps the first.
    """
    heads = pages.select(
        "source", "period", F.trim(F.regexp_extract("raw", tier, 1)).alias("tier"), F.regexp_extract("raw", average, 1).alias("avg"), "raw"
    ).filter("tier <> '' and avg <> ''")
    texts = heads.select(F.col("source").alias("text_id"), F.col("raw").alias("text"))
    where = phrase_occurrences(texts, names.select(F.col("entity").alias("phrase_id"), F.col("entity").alias("phrase")).distinct(), fold_case=False)
    kept = longest_mentions(where.withColumnRenamed("phrase_id", "entity")).select(F.col("text_id").alias("source"), "entity").distinct()
    rows = kept.join(heads.drop("raw"), "source")
    first = F.min(F.struct("source", "tier", "avg")).alias("r")
    return rows.groupBy("period", "entity").agg(first).select(
        "period", "entity", F.col("r.tier").alias("tier"), F.col("r.avg").try_cast("decimal(6,2)").alias("tier_avg"), F.col("r.source").alias("source"))


def ranked_table(text: Column, name: str = SHORT_NAME) -> Column:
    """struct(tier, pairs, unpaired) of a tier score table, NULL when the page is none; ``unpaired`` are scores without a name and names without a score."""
    tier = F.regexp_extract(text, r"—\s*([^。]*?)\s*机场综合得分", 1)
    lists = paired_lists(text, name)
    pairs = F.zip_with(lists["scores"], lists["names"], lambda s, n: F.struct(s.alias("score"), n.alias("entity")))
    return F.when(tier != "", F.struct(tier.alias("tier"), F.filter(pairs, lambda p: p["score"].isNotNull() & p["entity"].isNotNull()).alias("pairs"),
        F.filter(pairs, lambda p: p["score"].isNull() | p["entity"].isNull()).alias("unpaired")))


def chunk_ids(text: Column) -> Column:
    """Page ids in a text, distinct, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CHUNK_ID), F.lit(0)))


def cited_ids(answer: Column) -> Column:
    """Page ids inside citation brackets."""
    inside = F.regexp_extract_all(answer, F.lit(CITED), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(inside, lambda c: F.regexp_extract_all(c, F.lit(CHUNK_ID), F.lit(0)))))


def parse_citations(asks: DataFrame) -> DataFrame:
    """``asks(question_id, citation)`` to one row per clause: (question_id, clause_no, fields map, error).

    Clauses are split by ``|``, parts are ``key=value`` split by ``;``. An unknown or repeated key is an error, never an
    overwrite; a bare report name becomes its page id.
    """
    half = F.translate(F.trim("citation"), FULL_WIDTH, HALF_WIDTH)
    named = F.regexp_extract(half, REPORT_NAME, 1)
    page = F.regexp_extract(half, REPORT_NAME, 2)
    bare = ~half.rlike("[=:]")
    number = F.when(page != "", page.try_cast("int"))
    as_page = F.concat(F.lit("chunk="), page_id(named, number))
    base = asks.select(
        "question_id",
        F.when(F.coalesce(half, F.lit("")) == "", F.lit("empty")).when(bare & (named == ""), F.lit("unreadable")).alias("error"),
        F.when(bare & (named != ""), as_page).otherwise(half).alias("body"),
    )
    clauses = base.select("question_id", "error", F.posexplode_outer(
        F.filter(F.split("body", r"[|\n]"), lambda c: F.trim(c) != "")).alias("clause_no", "clause"))
    parts = F.filter(F.transform(F.split("clause", ";"), lambda p: F.trim(p)), lambda p: p != "")
    keys = F.transform(parts, lambda p: F.trim(F.regexp_extract(p, "^([^=:]+)[=:]", 1)))
    values = F.transform(parts, lambda p: F.trim(F.regexp_extract(p, "^[^=:]+[=:](.*)$", 1)))
    staged = clauses.withColumn("k", keys).withColumn("v", values)
    known = F.array(*[F.lit(k) for k in CITE_KEYS])
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.array_contains("k", ""), "unreadable")
        .when(F.size(F.array_except("k", known)) > 0, "unknown key")
        .when(F.size("k") != F.size(F.array_distinct("k")), "repeated key")
    )
    checked = staged.withColumn("error", error)
    return checked.select(
        "question_id", "clause_no", F.when(F.col("error").isNull(), F.map_from_arrays("k", "v")).alias("fields"), "error")


def trace_terms(trace: Column, mark: str = "检索用词") -> Column:
    """Search terms recorded in a run trace: what follows the colon of the first marked line."""
    line = F.get(F.filter(trace, lambda x: F.contains(x, F.lit(mark))), F.lit(0))
    return F.trim(F.regexp_extract(F.translate(line, "：", ":"), "^[^:]*:(.*)$", 1))
