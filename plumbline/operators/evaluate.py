"""Scoring of recorded runs: partial credit, a third outcome for what a machine cannot judge, and bookkeeping."""

from __future__ import annotations

import hashlib
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.numbers import answer_numbers, canonical_numbers, let
from plumbline.functions.periods import PERIOD_TOKEN, period_ord
from plumbline.operators.lookup import resolve_prefix
from plumbline.operators.matching import phrase_counts
from plumbline.operators.versions import content_key
from plumbline.session import durable

MONEY = "decimal(38,2)"
# How a citation names all periods of a page, and the fields of a period.
MANY_VERSIONS = "多版本"
# How a challenge asks for a phrase, and by how much a number is raised to one that no report has.
ASKS = ("{period}的{phrase}是什么", "{period}里,{phrase}是多少", "{period}的{phrase}说的是什么", "{period}报告中{phrase}的内容是什么")
RAISED = 700
FACT_ROWS = 500_000  # so many facts travel to every task; more are joined by a shuffle
META_FIELDS = {"样本量": "sample_n", "机场数": "entity_n", "一级指标数": "l1_n", "二级指标数": "l2_n", "口径版本": "basis_version"}


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def sub_items(answer: Column) -> Column:
    """Items of an expected answer: split on semicolons, else on commas when two parts hold digits, else whole."""
    whole = F.trim(answer)
    explicit = _trimmed(F.split(whole, "[;；]"))
    listed = F.filter(_trimmed(F.split(whole, "[，,]")), lambda p: p.rlike(r"\d"))
    return (
        F.when((F.size(explicit) <= 1) & (F.size(listed) >= 2), listed)
        .when(F.size(explicit) >= 1, explicit)
        .otherwise(F.array(whole))
    )


def covered_by(want: Column, have: Column) -> Column:
    """Every wanted number is among the given ones or is a difference of two of them."""
    nums = F.filter(F.transform(have, lambda x: x.try_cast(MONEY)), lambda x: x.isNotNull())

    def derived(m, nums):
        d = m.try_cast(MONEY)  # a number too long for money is no difference of two
        return F.coalesce((d > 0) & F.arrays_overlap(nums, F.transform(nums, lambda a: (a - d).try_cast(MONEY))), F.lit(False))

    return let(nums, lambda known: F.forall(F.array_except(want, have), lambda m: derived(m, known)))


def judge(run: DataFrame) -> DataFrame:
    """The scoring ladder: ``route_ok``, ``evidence``, ``score`` in [0, 1] and ``unjudgeable``."""
    prepared = run.withColumn("_have", canonical_numbers(F.col("answer"))).withColumn(
        "_want", F.filter(F.transform(sub_items(F.col("expected_answer")), lambda s: answer_numbers(s)), lambda w: F.size(w) > 0)
    )
    matched = F.size(F.filter("_want", lambda w: covered_by(w, F.col("_have"))))
    route_ok = F.col("route") == F.col("expected_route")
    evidence = F.array_contains("sources", F.col("expected_page"))
    by_route = F.col("expected_route").isin("clarify", "refuse")
    search = F.col("expected_route") == "search"
    measurable = F.size("_want") > 0
    unjudgeable = route_ok & ~by_route & ~measurable & (~search | evidence)
    score = (
        F.when(~route_ok, 0.0)
        .when(by_route, 1.0)
        .when(search & ~evidence, 0.0)
        .when(measurable, matched / F.size("_want"))
        .otherwise(0.0)
    )
    return prepared.select(
        *run.columns,
        route_ok.alias("route_ok"),
        F.when(search & route_ok, evidence).alias("evidence"),
        score.cast("double").alias("score"),
        unjudgeable.alias("unjudgeable"),
    )


def silent_failures(scored: DataFrame) -> DataFrame:
    """Wrong, and nothing was said about it."""
    return scored.filter(~F.col("unjudgeable") & (F.col("score") < 1) & (F.col("n_warnings") == 0) & (F.col("n_trace") == 0))


def refusal_metrics(scored: DataFrame) -> DataFrame:
    """Both directions of refusing, and zero-hit searches counted apart."""
    should = F.col("expected_route") == "refuse"
    return scored.agg(
        F.count_if(should).alias("should_refuse"),
        F.count_if(should & (F.col("route") == "refuse")).alias("did_refuse"),
        F.count_if(~should).alias("should_answer"),
        F.count_if(~should & (F.col("route") == "refuse")).alias("wrongly_refused"),
        F.count_if(F.col("route") == "search_0").alias("zero_hit"),
    )


def cache_key(item: Column, expected: Column, answer: Column) -> Column:
    """id, then 12 hash characters of the expected and of the given answer."""
    short = lambda c: F.substring(F.md5(c.cast("binary")), 1, 12)
    return F.concat_ws("|", item.cast("string"), short(expected), short(answer))


def split_by_cache(run: DataFrame, cache: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows already judged with their stored score, rows to judge)."""
    keyed = run.withColumn("key", cache_key(F.col("question_id"), F.col("expected_answer"), F.col("answer")))
    if not enabled:
        return keyed.join(cache, "key").limit(0), keyed
    return keyed.join(cache, "key"), keyed.join(cache.select("key"), "key", "left_anti")


def judge_with_cache(run: DataFrame, cache: DataFrame, enabled: bool = True) -> DataFrame:
    """Judge only what the cache(key, cached_score) lacks; the result covers every row once."""
    known, todo = split_by_cache(run, cache, enabled)
    fresh = judge(todo).select("key", "question_id", "score", F.lit(False).alias("from_cache"))
    return known.select("key", "question_id", F.col("cached_score").alias("score"), F.lit(True).alias("from_cache")).unionByName(fresh)


def case_check(turns: DataFrame) -> DataFrame:
    """A case passes when each of its turns has all of ``must`` and none of ``must_not``.

    turns(case_id, turn, text, must array, must_not array)
    """
    ok = F.forall("must", lambda m: F.contains("text", m)) & ~F.exists("must_not", lambda m: F.contains("text", m))
    return turns.select("case_id", ok.alias("ok")).groupBy("case_id").agg(
        F.bool_and("ok").alias("passed"), F.count(F.lit(1)).alias("turns"), F.count_if("ok").alias("turns_ok")
    )


def allocate(items: DataFrame, quotas: DataFrame, first_batch: int) -> DataFrame:
    """Stratified selection: per category the first ``quota`` items by id, the first few flagged.

    The quota is a property of the category, so the map side may already drop rows beyond the largest quota.
    """
    top = quotas.agg(F.max("quota")).first()[0] or 0
    w = W.partitionBy("category").orderBy("item_id")
    ranked = items.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= int(top))
    return ranked.join(quotas, "category").filter(F.col("n") <= F.col("quota")).select(
        "category", "item_id", "n", (F.col("n") <= first_batch).alias("first_batch")
    )


def code_version() -> str:
    """A digest of the package's own source files, so results made by different code can be told apart."""
    root = Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for path in sorted(root.rglob("*.py")):
        digest.update(path.relative_to(root).as_posix().encode() + b"\0" + path.read_bytes() + b"\0")
    return digest.hexdigest()[:16]


def fingerprint(df: DataFrame, name: str, code: str, **params: str) -> DataFrame:
    """One row that identifies an input and what was run on it: rows, content hash, code version and the parameters.

    The content is the sum of the rows' hashes over columns in order of name, so it is the same for any order and partitioning of the rows, changes
    with any cell, and fingerprints of parts add up (:func:`merged_fingerprints`).
    """
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]).cast("binary"))
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("content")).select(
        F.lit(name).alias("input"), "n_rows", "content", F.lit(code).alias("code"), *[F.lit(v).alias(k) for k, v in sorted(params.items())]
    )


def merged_fingerprints(parts: DataFrame) -> DataFrame:
    """The fingerprints of whole inputs from those of their parts."""
    same = [c for c in parts.columns if c not in ("n_rows", "content")]
    return parts.groupBy(*same).agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("content").cast("decimal(38,0)")).cast("string").alias("content")).select(*parts.columns)


def drift(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Recorded claims against the same claims computed now. Both: (claim, value)."""
    pair = recorded.select("claim", F.col("value").alias("recorded")).join(
        recomputed.select("claim", F.col("value").alias("now")), "claim", "full_outer"
    )
    return pair.withColumn(
        "status",
        F.when(F.col("recorded").isNull(), "new").when(F.col("now").isNull(), "gone")
        .when(F.col("recorded") == F.col("now"), "same").otherwise("drifted"),
    )


def _light(facts: DataFrame) -> DataFrame:
    """A table that many rows are joined with, computed once; a short one travels to the tasks, so that the rows stay where they are."""
    kept = durable(facts)
    return F.broadcast(kept) if kept.count() <= FACT_ROWS else kept


def _cited(clauses: DataFrame, entities: DataFrame, metrics: DataFrame) -> DataFrame:
    """Clauses by kind, with names made whole and what is wrong with the clause itself."""
    f = lambda k: F.col("fields")[k]
    c = clauses.filter("error is null").select(
        "question_id", "clause_no", f("表").alias("tbl"), f("期次").alias("period"), f("机场").alias("asked_entity"), f("指标").alias("asked_metric"),
        F.filter(F.transform(F.split(F.coalesce(f("字段"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("wanted"), f("取前").alias("first"),
        f("取前").try_cast("int").alias("n"), f("chunk").alias("chunk"), f("页码").alias("page"), f("分界").alias("cut"))
    kind = (F.when(F.col("chunk") == MANY_VERSIONS, "versions").when(F.col("chunk").isNotNull(), "pages").when(F.col("tbl") == "meta", "meta")
            .when((F.col("tbl") == "综合得分") & F.col("first").isNotNull(), "top").when(F.col("tbl") == "综合得分", "score")
            .when((F.col("tbl") == "指标得分") & F.col("asked_entity").isNull(), "best").when(F.col("tbl") == "指标得分", "metric"))
    c = c.withColumn("kind", kind)
    for what, catalog in (("entity", entities), ("metric", metrics)):
        whole = _light(resolve_prefix(c.select(F.col(f"asked_{what}").alias("ask")).filter("ask is not null"), catalog.toDF("name").distinct()))
        c = c.join(whole.select(F.col("ask").alias(f"asked_{what}"), F.col("name").alias(what), F.col("status").alias(f"{what}_status")), f"asked_{what}", "left")
    named = lambda what: F.when(F.col(f"asked_{what}").isNull(), f"no {what}").when(F.col(f"{what}_status") == "missing", f"unknown {what}").when(F.col(f"{what}_status") == "ambiguous", f"ambiguous {what}")
    problem = (
        F.when(F.col("kind").isNull(), F.when(F.col("tbl").isNull(), "no table").otherwise("unknown table"))
        .when((F.col("kind") == "versions") & F.col("page").try_cast("int").isNull(), "no page")
        .when((F.col("kind") == "versions") & F.col("cut").isNotNull() & ~F.col("cut").rlike(f"^{PERIOD_TOKEN}$"), "bad boundary")
        .when((F.col("kind") == "meta") & (F.size(F.array_except("wanted", F.array(*[F.lit(x) for x in META_FIELDS]))) > 0), "unknown field")
        .when((F.col("kind") == "top") & F.col("n").isNull(), "bad number")
        .when(F.col("kind") == "score", named("entity"))
        .when(F.col("kind") == "best", named("metric"))
        .when(F.col("kind") == "metric", F.coalesce(named("metric"), named("entity"))))
    note = F.concat_ws("; ", *[F.when(F.col(f"{w}_status") == "prefix", F.concat_ws(" = ", f"asked_{w}", w)) for w in ("entity", "metric")])
    return c.withColumn("problem", problem).withColumn("note", note)


def lookup_citations(clauses: DataFrame, ranked: DataFrame, metric_score: DataFrame, meta: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """What each citation clause points at: (question_id, clause_no, numbers, names, problem, note); NULL numbers have a problem.

    Every clause is of one kind and meets one relation:

    * ``chunk=id,id``: pages, every one of which must be there; their numbers together.
    * ``chunk=多版本;页码=7[;分界=2025Q1]``: one page in all periods; the note tells the number of versions, or of periods on both sides of the boundary.
    * ``表=meta``: all fields of a period, or those named. ``表=综合得分``: the score of an entity, its rank (``字段=排名``), or the first N scores (``取前=N``).
    * ``表=指标得分``: the value of an entity, or without one the best value, with every name that holds it.

    A name may be a unique prefix, which the note says. ``chunks(chunk_id, period, page_no, text)``.
    """
    key = ["question_id", "clause_no"]
    c = durable(_cited(clauses, ranked.select("entity").union(metric_score.select("entity")), metric_score.select("metric")))
    ok = c.filter("problem is null")
    text = lambda x: F.array(F.get(canonical_numbers(x.cast("string")), F.lit(0)))
    none, quiet = F.lit(None).cast("string"), F.lit(None).cast("string")
    parts = []

    def add(rows: DataFrame, numbers: Column, names: Column = none, note: Column = quiet) -> None:
        parts.append(rows.select(*key, numbers.alias("numbers"), names.alias("names"), note.alias("told")))

    # numbers are read once for every fact, not once for every clause that asks for it
    facts = _light(ranked.select("period", "entity", "row_no", "score", text(F.col("score")).alias("_score"), text(F.col("row_no")).alias("_row_no")))
    add(ok.filter("kind = 'score'").join(facts, ["period", "entity"]), F.when(F.array_contains("wanted", "排名"), F.col("_row_no")).otherwise(F.col("_score")), F.col("entity"))
    tables = _light(facts.groupBy("period").agg(F.array_sort(F.collect_list(F.struct("row_no", "entity", "score", F.col("_score")[0].alias("number")))).alias("table")))  # a period's entities
    firsts = ok.filter("kind = 'top'").select(*key, "period", "n").join(tables, "period").select(*key, F.filter("table", lambda r: r["row_no"] <= F.col("n")).alias("rows")).filter(F.size("rows") > 0)
    firsts = firsts.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"))  # at most n
    add(firsts, F.transform("rows", lambda r: r["number"]), F.array_join(F.transform("rows", lambda r: r["entity"]), "/"))
    values = _light(metric_score.select("period", "metric", "entity", text(F.col("score")).alias("_score")))
    add(ok.filter("kind = 'metric'").select(*key, "period", "metric", "entity").join(values, ["period", "metric", "entity"]), F.col("_score"), F.col("entity"))
    best = ok.filter("kind = 'best'").select(*key, "period", "metric").join(metric_score, ["period", "metric"])
    tops = metric_score.groupBy("period", "metric").agg(F.max("score").alias("score"))
    held = best.join(tops, ["period", "metric", "score"]).groupBy(*key, "score").agg(F.array_join(F.sort_array(F.collect_list("entity")), "/").alias("names"))
    add(held, text(F.col("score")), F.col("names"))
    every = F.size("wanted") == 0
    fields = {label: column for label, column in META_FIELDS.items() if column in meta.columns}
    listed = _light(meta.select("period", *[canonical_numbers(F.col(column).cast("string")).alias(column) for column in fields.values()]))
    chosen = F.concat(*[F.when(every | F.array_contains("wanted", label), F.col(column)).otherwise(F.array().cast("array<string>")) for label, column in fields.items()])
    add(ok.filter("kind = 'meta'").select(*key, "period", "wanted").join(listed, "period"), F.array_distinct(chosen))
    if chunks is not None:
        ids = ok.filter("kind = 'pages'").select(*key, F.explode(F.filter(F.transform(F.split("chunk", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("chunk_id"))
        pages = ids.join(chunks.select("chunk_id", "text"), "chunk_id", "left").groupBy(*key).agg(  # a citation's few pages
            F.array_distinct(F.flatten(F.collect_list(canonical_numbers(F.col("text"))))).alias("numbers"), F.bool_or(F.col("text").isNull()).alias("lost"))
        add(pages, F.when(~F.col("lost"), F.col("numbers")), none, F.when(F.col("lost"), "unknown page"))
        asked = ok.filter("kind = 'versions'").select(*key, F.col("page").cast("int").alias("page_no"), "cut")
        facts = chunks.join(asked.select("page_no").distinct(), "page_no", "left_semi").select(
            "page_no", "period", content_key(F.col("text")).alias("version"), canonical_numbers(F.col("text")).alias("numbers"))
        before = period_ord(F.col("period")) < period_ord(F.col("cut"))
        sides = asked.join(facts, "page_no").groupBy(*key, "cut").agg(  # a page's periods
            F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"), F.countDistinct("version").alias("versions"),
            F.count_if(before).alias("before"), F.count_if(~before).alias("after"))
        add(sides, F.col("numbers"), none, F.when(F.col("cut").isNull(), F.format_string("%d versions", "versions")).otherwise(F.format_string("%d before, %d after", "before", "after")))
    found = reduce(DataFrame.unionByName, parts)
    missing = F.when(F.col("numbers").isNull(), F.coalesce(F.when(F.col("kind") == "pages", F.lit("unknown page")).when(F.col("kind") == "versions", F.lit("unknown page")), F.lit("nothing found")))
    return c.join(found, key, "left").select(
        *key, "numbers", "names", F.coalesce("problem", missing).alias("problem"),
        F.concat_ws("; ", F.when(F.col("note") != "", F.col("note")), F.when(F.col("numbers").isNotNull(), F.col("told"))).alias("note"))


def verify_keys(questions: DataFrame, clauses: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Verdict on every answer key: ok, mismatch, format, citation, to fill, or not machine-checkable.

    ``questions(question_id, expected_route, expected_answer, refusal_reason)``.
    """
    errors = clauses.groupBy("question_id").agg(F.min("error").alias("error"))
    have = looked_up.groupBy("question_id").agg(
        F.flatten(F.collect_list("numbers")).alias("have"), F.bool_or(F.col("numbers").isNull()).alias("lost"))  # a citation's few clauses
    want = answer_numbers(F.col("expected_answer"))
    refuse = F.col("expected_route") == "refuse"
    blank = lambda x: F.trim(F.coalesce(F.col(x), F.lit(""))) == ""
    rows = questions.join(errors, "question_id", "left").join(have, "question_id", "left").withColumn("want", want)
    return rows.select(
        "question_id",
        F.when(blank("expected_route"), "to fill")
        .when(refuse & blank("refusal_reason"), "to fill")
        .when(refuse & (F.size("want") > 0), "format")
        .when(refuse, "ok")
        .when(F.col("error").isNotNull(), "format")
        .when(F.coalesce("lost", F.lit(True)), "citation")
        .when(F.size("want") == 0, "not machine-checkable")
        .when(covered_by(F.col("want"), F.col("have")), "ok")
        .otherwise("mismatch").alias("verdict"))


def _absent(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """Of ``phrases(phrase)`` those that no chunk holds, whatever the case."""
    asked = phrases.select("phrase").distinct()
    texts = chunks.select(F.col("chunk_id").alias("text_id"), "text")
    seen = phrase_counts(texts, asked.select(F.col("phrase").alias("phrase_id"), "phrase")).select(F.col("phrase_id").alias("phrase"))
    return asked.join(seen.distinct(), "phrase", "left_anti")


def rare_phrases(chunks: DataFrame, pattern: str, max_pages: int = 3, shortest: int = 2, longest: int = 14) -> DataFrame:
    """(phrase, pages, expected_page, period): phrases of the pattern that begin where a word begins and occur, anywhere in a text, on at most ``max_pages`` pages."""
    bounded = f"(?:^|[^\\p{{L}}])({pattern})"
    found = chunks.select("chunk_id", "period", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(bounded), F.lit(1)))).alias("phrase"))
    fits = found.filter(F.length("phrase").between(shortest, longest) & ~F.startswith("phrase", F.lit("的")) & ~F.endswith("phrase", F.lit("的")))
    first = durable(fits.groupBy("phrase").agg(F.min(F.struct("chunk_id", "period")).alias("at"), F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_pages))
    texts = chunks.select(F.col("chunk_id").alias("text_id"), "text")
    pages = phrase_counts(texts, first.select(F.col("phrase").alias("phrase_id"), "phrase"), fold_case=False).groupBy(F.col("phrase_id").alias("phrase")).agg(F.count(F.lit(1)).alias("pages"))
    return first.join(pages.filter(F.col("pages") <= max_pages), "phrase").select("phrase", "pages", F.col("at.chunk_id").alias("expected_page"), F.col("at.period").alias("period"))


def challenge_set(chunks: DataFrame, pattern: str, seed: str, n: int, max_pages: int = 3) -> DataFrame:
    """A seeded challenge set of ``n`` distinctive phrases: (phrase, category, asked, question, expected_page).

    ``real``: the phrase itself, asked of its own period in a template that the seed picks. ``short``: its first half, at least four characters, where no other picked
    phrase begins so. ``false``: a counterpart that is proven absent from every chunk; the first that is of: the number in it raised, its head with the tail of its
    neighbour in the order of phrases, its letters reversed behind ``ZZ``. A phrase without an absent counterpart has none.
    The sample is the first ``n`` in the order of a seeded hash, so the same seed gives the same set for any partitioning.
    """
    order = F.md5(F.concat_ws("|", F.lit(seed), "phrase").cast("binary"))
    picked = durable(rare_phrases(chunks, pattern, max_pages).withColumn("o", order).orderBy("o", "phrase").limit(n))
    beside = W.partitionBy(F.lit(0)).orderBy("phrase")  # the n phrases of the sample
    half = F.greatest(F.lit(4), F.ceil(F.length("phrase") / 2).cast("int"))
    staged = picked.withColumn("neighbour", F.coalesce(F.lead("phrase").over(beside), F.lag("phrase").over(beside), F.col("phrase"))).withColumn("half", F.expr("left(phrase, greatest(4, cast(ceil(length(phrase) / 2) as int)))"))
    number = F.regexp_extract("phrase", r"(\d+)", 1)
    raised = F.when(number != "", F.concat(F.regexp_extract("phrase", r"^(\D*)", 1), (number.try_cast("bigint") + RAISED).cast("string"), F.regexp_extract("phrase", r"^\D*\d+(.*)$", 1)))
    crossed = F.concat("half", F.expr("substring(neighbour, cast(length(neighbour) / 2 as int) + 1)"))
    made = F.filter(F.array(raised, crossed, F.concat(F.lit("ZZ"), F.reverse("phrase"))), lambda x: x.isNotNull())
    options = staged.select("phrase", F.posexplode(made).alias("place", "counter"))
    free = options.join(_absent(chunks, options.select(F.col("counter").alias("phrase"))).withColumnRenamed("phrase", "counter"), "counter")
    false = free.groupBy("phrase").agg(F.min(F.struct("place", "counter"))["counter"].alias("counter"))
    alone = staged.groupBy("half").agg(F.count(F.lit(1)).alias("k")).filter("k = 1").select("half", F.lit(True).alias("alone"))
    template = F.array(*[F.lit(t) for t in ASKS])[(F.conv(F.substring("o", 1, 4), 16, 10).cast("int") % len(ASKS))]
    page = F.col("expected_page").cast("bigint")
    kinds = F.array(
        F.struct(F.lit("real").alias("category"), F.col("phrase").alias("asked"), page.alias("expected_page")),
        F.when(F.col("alone") & (half < F.length("phrase")), F.struct(F.lit("short").alias("category"), F.col("half").alias("asked"), page.alias("expected_page"))),
        F.when(F.col("counter").isNotNull(), F.struct(F.lit("false").alias("category"), F.col("counter").alias("asked"), F.lit(None).cast("bigint").alias("expected_page"))))
    rows = staged.join(alone, "half", "left").join(false, "phrase", "left").select("phrase", "period", template.alias("template"), F.inline(F.filter(kinds, lambda x: x.isNotNull())))
    question = F.replace(F.replace("template", F.lit("{period}"), F.col("period")), F.lit("{phrase}"), F.col("asked"))
    return rows.select("phrase", "category", "asked", question.alias("question"), "expected_page")
