"""Constraint plans: each returns violation rows or verdict rows over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import lookup as L
from plumbline.operators import retrieval as S
from plumbline.operators import validate as K
from plumbline.plans.lookups import ASKS, asks
from plumbline.plans.oracle import every_value, oracle
from plumbline.plans.ranking import dbl
from plumbline.plans.registry import plan
from plumbline.plans.retrieval import PHRASES, scored
from plumbline.sources import views as V
from plumbline.sources.tables import NAMES


@plan("val_unique", oracle("", """
    SELECT 'unique' AS rule, 'orders' AS "table", concat(o_custkey, '/', o_orderpriority) AS key, CAST(count(*) AS VARCHAR) AS detail
    FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1 UNION ALL
    SELECT 'unique', 'lineitem', concat(l_orderkey, '/', l_linenumber), CAST(count(*) AS VARCHAR) FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""))
def val_unique(t):
    """VAL-1: repeated keys, one and two columns."""
    return K.union_all([K.unique(t.orders, "orders", ["o_custkey", "o_orderpriority"]),
                        K.unique(t.lineitem, "lineitem", ["l_orderkey", "l_linenumber"]), K.unique(V.score(t), "score", ["period", "entity"])])


@plan("val_foreign_key", oracle("", """
    SELECT 'foreign_key' AS rule, 'labels' AS "table", CAST(doc_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail
    FROM (SELECT event_id AS doc_id FROM events) e WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id"""))
def val_foreign_key(t):
    """VAL-2: keys without a parent."""
    return K.foreign_key(t.events.select(F.col("event_id").alias("doc_id")), "labels", ["doc_id"], t.documents)


@plan("val_not_null", oracle("", """
    SELECT 'not_null' AS rule, 'labels' AS "table", CAST(d.doc_id AS VARCHAR) AS key, 'quality,toxic' AS detail
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL"""))
def val_not_null(t):
    """VAL-3: missing values."""
    return K.not_null(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "labels", ["doc_id"], ["quality", "toxic"])


@plan("val_ranges", oracle("", """
    SELECT 'positive' AS rule, 'customer' AS "table", CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_acctbal <= 0 UNION ALL
    SELECT 'one_of', 'events', CAST(event_id AS VARCHAR) FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')"""))
def val_ranges(t):
    """VAL-4/5: positive amounts and listed values."""
    return K.union_all([K.positive(t.customer, "customer", ["c_custkey"], "c_acctbal"),
                        K.one_of(t.events, "events", ["event_id"], "event_type", ["click", "view", "purchase"])]).drop("detail")


@plan("val_version_parts", oracle("period_meta_d", """
    SELECT 'version_parts' AS rule, 'period_meta' AS "table", period AS key, basis_version AS detail
    FROM (SELECT period, l1_n, l2_n, CASE WHEN l2_n % 7 = 0 THEN concat(l1_n, '+', l2_n + 1) ELSE basis_version END AS basis_version FROM period_meta_d)
    WHERE basis_version <> concat(l1_n, '+', l2_n)"""))
def val_version_parts(t):
    """VAL-6: the version must be its two parts; every seventh count is broken on purpose."""
    m = V.period_meta_d(t)
    broken = m.withColumn("basis_version", F.when(F.col("l2_n") % 7 == 0, F.concat_ws("+", "l1_n", F.col("l2_n") + 1)).otherwise(F.col("basis_version")))
    return K.version_parts(broken, "period_meta", ["period"])


@plan("val_attack", oracle("score", """
    SELECT 'duplicate key' AS "case", count(*) AS n_bad, count(*) AS n_found, 'rejected' AS outcome FROM score UNION ALL
    SELECT 'negative score', count(*), count(*), 'rejected' FROM score UNION ALL
    SELECT 'unknown period', count(*), count(DISTINCT period), 'rejected' FROM score UNION ALL
    SELECT 'legal rows', count(*), 0, 'gap' FROM score UNION ALL SELECT 'no rows', 0, 0, 'broken'"""))
def val_attack(t):
    """VAL-7: illegal rows must be rejected; a case without rows is broken, an accepted one a gap."""
    s = V.score(t)
    neg = s.withColumn("score", -F.col("score"))
    lost = s.withColumn("period", F.concat(F.lit("X"), F.col("period")))
    return K.attack({
        "duplicate key": (s, K.unique(s.unionByName(s), "score", ["period", "entity"])),
        "negative score": (neg, K.positive(neg, "score", ["period", "entity"], "score")),
        "unknown period": (lost, K.foreign_key(lost, "score", ["period"], V.period_meta_q(t))),
        "legal rows": (s, K.positive(s, "score", ["period", "entity"], "score")),
        "no rows": (s.limit(0), K.positive(neg, "score", ["period", "entity"], "score").limit(0)),
    })


@plan("val_row_counts", oracle("cells", """
    SELECT 'orders' AS "table", (SELECT count(*) FROM orders) AS n_source, CAST((SELECT sum(n) FROM cells) AS BIGINT) AS n_loaded,
           (SELECT count(*) FROM orders) = (SELECT sum(n) FROM cells) AS same UNION ALL
    SELECT 'events', (SELECT count(*) FROM events), (SELECT count(*) FROM events WHERE value > 0),
           (SELECT count(*) FROM events) = (SELECT count(*) FROM events WHERE value > 0)"""))
def val_row_counts(t):
    """VAL-8: rows before and after a load."""
    loaded = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return K.row_counts({"orders": t.orders, "events": t.events}, {"orders": loaded, "events": t.events.filter("value > 0")})


@plan("val_round_trip", oracle("", """
    SELECT doc_id, n_chars, 'only_left' AS side FROM (SELECT doc_id, n_chars FROM documents EXCEPT ALL SELECT doc_id, length(regexp_replace(text, '[.]+\\z', '')) FROM documents)
    UNION ALL SELECT doc_id, n, 'only_right' FROM (SELECT doc_id, length(regexp_replace(text, '[.]+\\z', '')) AS n FROM documents EXCEPT ALL SELECT doc_id, n_chars FROM documents)"""))
def val_round_trip(t):
    """VAL-9: stored against recomputed rows, both differences."""
    from plumbline.operators.combine import both_ways
    stored = t.documents.select("doc_id", "n_chars")
    return both_ways(stored, t.documents.select("doc_id", F.length(F.regexp_replace("text", r"[.]+\z", "")).cast("bigint").alias("n_chars")))


PAIRS = """SELECT l_orderkey AS key, list(l_quantity ORDER BY l_linenumber, l_quantity) AS scores, count(*) FILTER (l_linenumber <> 4) AS n_names,
    CASE WHEN l_orderkey % 2 = 0 THEN floor(avg(l_quantity)) END AS stated FROM lineitem GROUP BY 1"""


@plan("val_pair_checks", oracle("", f"""
    SELECT key, n_names, len(scores) AS n_scores, CASE WHEN n_names <> len(scores) THEN 'lengths differ'
           WHEN list_reverse_sort(scores) <> scores THEN 'not descending'
           WHEN stated IS NOT NULL AND abs(round(list_sum(scores) / len(scores), 2) - stated) >= 0.005 THEN 'mean differs' ELSE 'ok' END AS verdict
    FROM ({PAIRS})"""))
def val_pair_checks(t):
    """VAL-10: lengths, order and stated mean of paired lists (the lines of each order)."""
    line = F.struct("l_linenumber", F.col("l_quantity").cast("decimal(10,2)").alias("q"))
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(
        F.transform(F.sort_array(F.collect_list(line)), lambda x: x["q"]).alias("scores"),
        F.collect_list(F.when(F.col("l_linenumber") != 4, F.lit("x"))).alias("names"),
        F.floor(F.avg(F.col("l_quantity").cast("decimal(10,2)"))).alias("m"))
    return K.pair_checks(lists.withColumn("stated", F.when(F.col("key") % 2 == 0, F.col("m"))))


@plan("val_cardinality", oracle("metric_score", """
    SELECT 'cardinality' AS rule, 'metric_score' AS "table", concat(period, '/', metric) AS key, CAST(count(*) AS VARCHAR) AS detail
    FROM metric_score GROUP BY period, metric HAVING count(*) NOT IN (25)"""))
def val_cardinality(t):
    """VAL-11: group sizes outside the allowed set."""
    return K.cardinality(V.metric_score(t), "metric_score", ["period", "metric"], [25])


@plan("val_same_entities", oracle("score metric_score", """
    SELECT 'same_entities' AS rule, 'score/metric_score' AS "table", concat(coalesce(a.period, b.period), '/', coalesce(a.entity, b.entity)) AS key,
           CASE WHEN a.period IS NULL THEN 'only metric_score' ELSE 'only score' END AS detail
    FROM (SELECT period, entity FROM score) a FULL JOIN (SELECT DISTINCT period, entity FROM metric_score WHERE metric = '5-LOW') b
      ON a.period = b.period AND a.entity = b.entity WHERE a.period IS NULL OR b.period IS NULL"""))
def val_same_entities(t):
    """VAL-12: entities that only one table has."""
    low = V.metric_score(t).filter("metric = '5-LOW'")
    return K.same_entities(V.score(t), low, ["period", "entity"], "score", "metric_score")


@plan("val_component_bounds", oracle("score metric_score", """
    SELECT s.period, s.entity, s.score, low, high FROM score s JOIN (
      SELECT period, entity, min(score) AS low, max(score) AS high FROM metric_score WHERE metric < '4' GROUP BY 1, 2) m
      ON s.period = m.period AND s.entity = m.entity WHERE s.score < low - 1e-9 OR s.score > high + 1e-9"""))
def val_component_bounds(t):
    """VAL-13: scores outside the range of three of their components (a report)."""
    some = V.metric_score(t).filter("metric < '4'")
    return K.within_components(V.score(t), some).select("period", "entity", *dbl("score", "low", "high"))


@plan("val_stated_counts", oracle("period_meta_q score", """
    SELECT m.period, m.entity_n AS stated, n AS actual, CASE WHEN n IS NULL THEN 'missing' WHEN n <> m.entity_n THEN 'mismatch' ELSE 'ok' END AS status
    FROM period_meta_q m LEFT JOIN (SELECT period, count(*) AS n FROM score WHERE h > 225 AND period[6:6] <> '3' GROUP BY 1) s ON m.period = s.period"""))
def val_stated_counts(t):
    """VAL-14: stated against counted entities, missing apart from mismatched."""
    return K.stated_counts(V.period_meta_q(t), V.score(t).filter("score > 2.25 and substring(period, 6, 1) <> '3'"))


@plan("val_tier_partition", oracle("score members", """
    SELECT 'one_tier' AS rule, 'tier' AS "table", concat(period, '/', entity) AS key, '2' AS detail FROM score JOIN members USING (entity)
      WHERE tier = 'ASIA' AND h > 250 UNION ALL
    SELECT 'no_tier', 'tier', concat(period, '/', entity), 'missing' FROM score JOIN members USING (entity) WHERE tier = 'EUROPE' UNION ALL
    SELECT 'unknown_entity', 'tier', concat(period, '/', entity, 'x'), 'extra' FROM score JOIN members USING (entity) WHERE tier = 'AFRICA' AND h > 260"""))
def val_tier_partition(t):
    """VAL-16: entities in two tiers, in none, or unknown; slips are planted in a copy of the placement."""
    placed = V.score(t).join(V.members(t), "entity")
    twice = placed.filter("tier = 'ASIA' and score > 2.50").withColumn("tier", F.lit("OTHER"))
    extra = placed.filter("tier = 'AFRICA' and score > 2.60").withColumn("entity", F.concat("entity", F.lit("x")))
    return K.partition_check(V.score(t), placed.filter("tier <> 'EUROPE'").unionByName(twice).unionByName(extra))


@plan("val_availability", oracle("score metric_score", """
    SELECT period, bool_or(tb = 's') AS score, bool_or(tb = 'm') AS metric_score FROM (
      SELECT period, 's' AS tb FROM score WHERE h > 285 UNION ALL SELECT period, 'm' FROM metric_score WHERE h > 400) GROUP BY 1"""))
def val_availability(t):
    """VAL-17: which periods each table covers."""
    return L.availability({"score": V.score(t).filter("score > 2.85"), "metric_score": V.metric_score(t).filter("score > 4.00")})


@plan("val_provenance", oracle("score metric_score", """
    SELECT 'source_exists' AS rule, 'metric_score' AS "table", concat(period, '/', metric, '/', entity) AS key, source AS detail FROM metric_score
      WHERE metric = '1-URGENT' UNION ALL
    SELECT 'source_kind', 'metric_score', concat(period, '/', metric, '/', entity), concat(source[1:8], lpad(CAST(CAST(source[9:] AS INT) - 100 AS VARCHAR), 2, '0'))
      FROM metric_score WHERE metric = '2-HIGH'"""))
def val_provenance(t):
    """VAL-18: sources that are no page, or a page of the wrong kind; two metrics carry planted slips."""
    m = V.metric_score(t)
    pages = V.score(t).select("source", F.lit("score").alias("page_kind")).unionByName(
        m.filter("metric > '3'").select("source", F.lit("metric").alias("page_kind")).distinct())
    score_page = F.concat(F.substring("source", 1, 8), F.lpad((F.substring("source", 9, 9).cast("int") - 100).cast("string"), 2, "0"))
    slipped = m.withColumn("source", F.when(F.col("metric") == "1-URGENT", F.concat("source", F.lit("x"))).when(F.col("metric") == "2-HIGH", score_page).otherwise(F.col("source")))
    out = K.provenance(slipped, "metric_score", ["period", "metric", "entity"], pages, "metric")
    return out.withColumn("detail", F.regexp_replace("detail", "x$", ""))


@plan("val_index_complete", oracle("chunk", """
    SELECT 'not_indexed' AS rule, 'chunk' AS "table", CAST(chunk_id AS VARCHAR) AS key, '' AS detail FROM chunk WHERE page_kind <> 'en' AND n_chars < 3 UNION ALL
    SELECT 'stale_index', 'chunk', CAST(chunk_id AS VARCHAR), '' FROM chunk WHERE page_kind = 'fr' AND n_chars >= 3"""))
def val_index_complete(t):
    """VAL-20: chunks not in the index, indexed chunks that should not be (one language left the indexable set)."""
    chunks = V.chunk(t)
    indexed = S.postings(chunks.filter("page_kind <> 'en'"))
    return K.index_complete(indexed, chunks.filter("page_kind not in ('en', 'fr')"))


@plan("val_content_drift", oracle("chunk", """
    SELECT chunk_id, CASE WHEN chunk_id % 10 = 3 THEN 'added' WHEN chunk_id % 10 = 5 THEN 'changed' END AS state FROM chunk WHERE chunk_id % 10 IN (3, 5)
    UNION ALL SELECT chunk_id + 1000000, 'removed' FROM chunk WHERE chunk_id % 10 = 7"""))
def val_content_drift(t):
    """VAL-21: texts that changed, left or came after indexing."""
    chunks, k = V.chunk(t), F.col("chunk_id") % 10
    stored = chunks.select("chunk_id", F.xxhash64(F.when(k == 5, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("hash"))
    gone = stored.filter(k == 7).withColumn("chunk_id", F.col("chunk_id") + 1000000)
    return K.content_drift(stored.filter(k != 3).unionByName(gone), chunks)


@plan("val_known_answers", oracle("chunk query", """
    SELECT e.query_id, min(rank) AS rank, min(rank) IS NOT NULL AS passed
    FROM (SELECT item_id AS query_id, min(doc_id) AS id FROM benchmark JOIN documents d ON contains(d.text, benchmark.text) GROUP BY 1) e
    LEFT JOIN (SELECT phrase_id AS query_id, id, row_number() OVER (PARTITION BY phrase_id ORDER BY bm25 DESC, id) AS rank FROM hits QUALIFY rank <= 5) h
      ON e.query_id = h.query_id AND e.id = h.id GROUP BY 1""", **scored(PHRASES)))
def val_known_answers(t):
    """VAL-22: a document known to hold the item must be among the first five."""
    from plumbline.operators.matching import phrase_occurrences
    texts = t.documents.select(F.col("doc_id").alias("text_id"), "text")
    whole = phrase_occurrences(texts, t.benchmark.select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase")), fold_case=False)
    known = whole.groupBy(F.col("phrase_id").alias("query_id")).agg(F.min("text_id").alias("id"))
    return K.known_answers(S.search(V.chunk(t), V.query(t)), known)


@plan("val_value_status", oracle("score metric_score", """
    SELECT ask_id, CASE WHEN a.entity NOT IN (SELECT entity FROM score) THEN 'unknown entity' WHEN a.period NOT IN (SELECT period FROM score) THEN 'unknown period'
           WHEN a.metric NOT IN (SELECT metric FROM metric_score) THEN 'unknown metric' WHEN a.period IS NOT NULL AND s.h IS NULL THEN 'no such combination'
           ELSE 'ok' END AS status
    FROM (SELECT ask_id, period, CASE WHEN ask_id % 19 = 0 THEN 'NATION_99' ELSE entity END AS entity,
                 CASE WHEN ask_id % 23 = 0 THEN '9-NONE' ELSE metric END AS metric FROM asks) a
    LEFT JOIN (SELECT period, entity, h FROM score WHERE h > 230) s ON a.period = s.period AND a.entity = s.entity""", asks=ASKS))
def val_value_status(t):
    """VAL-23: named values and their combination against the catalogs."""
    k = F.col("ask_id")
    a = asks(t).withColumn("entity", F.when(k % 19 == 0, "NATION_99").otherwise(F.col("entity"))).withColumn(
        "metric", F.when(k % 23 == 0, "9-NONE").otherwise(F.col("metric")))
    s = V.score(t)
    whole = s.select("period", "entity")
    # a catalog of all values, and combinations only where the score is above a bound
    kept = s.filter("score > 2.30").select("period", "entity")
    out = K.value_status(a, whole, V.metric_score(t))
    pair = a.join(kept, ["period", "entity"], "left_anti").filter("period is not null").select("ask_id", F.lit(True).alias("no_pair"))
    return out.join(pair, "ask_id", "left").select("ask_id", F.when((F.col("status") == "ok") & F.col("no_pair"), "no such combination").otherwise(F.col("status")).alias("status"))


TOOLS = {"table": {"periods", "entity"}, "text": set(), "each_metric": {"entity"}, "compare": {"condition"}}


@plan("val_plan_rows", oracle("", """
    SELECT * FROM (
      SELECT 'known_tool' AS rule, 'plan' AS "table", concat(o_orderkey, '/1') AS key, 'magic' AS detail FROM orders WHERE o_orderkey % 10 = 0 UNION ALL
      SELECT 'parameters', 'plan', concat(o_orderkey, '/1'), 'periods' FROM orders WHERE o_orderkey % 10 = 1 UNION ALL
      SELECT 'known_entity', 'plan', concat(o_orderkey, '/1'), 'NATION_99' FROM orders WHERE o_orderkey % 10 = 2 UNION ALL
      SELECT 'known_metric', 'plan', concat(o_orderkey, '/1'), '9-NONE' FROM orders WHERE o_orderkey % 10 = 3 UNION ALL
      SELECT 'known_period', 'plan', concat(o_orderkey, '/1'), '1990Q1' FROM orders WHERE o_orderkey % 10 = 4 UNION ALL
      SELECT 'looks_back', 'plan', concat(o_orderkey, '/2'), '3' FROM orders WHERE o_orderkey % 10 = 5 UNION ALL
      SELECT 'parameters', 'plan', concat(o_orderkey, '/2'), 'condition' FROM orders WHERE o_orderkey % 10 = 6)"""))
def val_plan_rows(t):
    """VAL-24: one two-step plan per order, each kind of slip on one key in ten."""
    k = F.col("o_orderkey") % 10
    none = F.lit(None).cast("string")
    first = F.struct(
        F.lit(1).alias("no"), F.when(k == 0, "magic").otherwise("table").alias("tool"),
        F.when(k == 1, F.array().cast("array<string>")).when(k == 4, F.array(F.lit("1990Q1"))).otherwise(F.array(V.period_of(F.col("o_orderdate")))).alias("periods"),
        F.when(k == 2, "NATION_99").otherwise("NATION_1").alias("entity"), F.when(k == 3, "9-NONE").otherwise(F.col("o_orderpriority")).alias("metric"),
        F.lit(None).cast("int").alias("looks_at"), none.alias("condition"))
    second = F.struct(
        F.lit(2).alias("no"), F.lit("compare").alias("tool"), F.array().cast("array<string>").alias("periods"), none.alias("entity"), none.alias("metric"),
        F.when(k == 5, 3).otherwise(1).alias("looks_at"), F.when(k == 6, none).otherwise("a < b").alias("condition"))
    plans = t.orders.select(F.col("o_orderkey").alias("plan_id"), F.array(first, second).alias("steps"))
    return K.plan_violations(plans, TOOLS, V.score(t), V.metric_score(t), V.score(t))


@plan("val_expected_values", oracle("", rf"""
    SELECT doc_id AS case_id, v AS value FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '\d+(?:,\d{{3}})*(?:\.\d+)?')) AS v FROM documents)
    WHERE replace(v, ',', '') NOT IN (SELECT value FROM ({every_value(("documents",))}))"""))
def val_expected_values(t):
    """VAL-25: numbers that texts expect but no table holds, in any column."""
    stated = t.documents.select(F.col("doc_id").alias("case_id"), F.explode(F.regexp_extract_all("text", F.lit(r"\d+(?:,\d{3})*(?:\.\d+)?"), F.lit(0))).alias("value"))
    return K.expected_values(stated, {name: getattr(t, name) for name in NAMES if name != "documents"})
