"""Cleaning, extraction and version plans over documents, web pages and printed score pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.numbers import answer_numbers, canonical_numbers
from plumbline.operators import clean as C
from plumbline.operators import evaluate as E
from plumbline.operators import extract as X
from plumbline.operators import validate as K
from plumbline.operators import versions as N
from plumbline.plans.aggregates import sql_numbers
from plumbline.plans.oracle import oracle
from plumbline.plans.ranking import dbl
from plumbline.plans.registry import plan
from plumbline.sources import views as V

LICENCE = (r"(?i)^\s*(?:Licensed under|Released under|This work is licensed)\b.*$",)
NAME = r"NATION_\d+"
FOOT = r"""(regexp_matches(x, '^\s*\d+\s*$') OR regexp_matches(x, '^\s*[页第]\s*$') OR regexp_matches(x, '(?i)Copyright|All rights reserved')
    OR regexp_matches(x, '(?i)^\s*(?:Licensed under|Released under|This work is licensed)\b.*$'))"""
LIST = r"^(?:[（(]\s*\d+\s*[)）]|[⚫◆●•·]|[-–—]\s|\d+\s*[.、])"


def kept(text: str) -> str:
    return f"""list_filter(list_transform(string_split({text}, chr(10)), lambda y: regexp_replace(y, '\\s+$', '')), lambda x: x <> '' AND NOT {FOOT})"""


def merged(text: str) -> str:
    trimmed = f"list_transform({kept(text)}, lambda z: regexp_replace(z, '^\\s+', ''))"
    return (f"array_to_string(list_transform({trimmed}, lambda l, i: CASE WHEN i > 1 AND regexp_matches(l, '{LIST}') "
            "THEN concat(chr(10), l) ELSE l END), '')")


@plan("cln_strip_footers", oracle("", f"SELECT doc_id, md5(array_to_string({kept('text')}, chr(10))) AS clean, len({kept('text')}) AS n_lines FROM documents"))
def cln_strip_footers(t):
    """CLN-1/4: footer lines out, line structure kept."""
    return t.documents.select("doc_id", F.md5(C.strip_footers(F.col("text"), LICENCE).cast("binary")).alias("clean"),
                              F.size(C.body_lines(F.col("text"), LICENCE)).alias("n_lines"))


@plan("cln_merge_wraps", oracle("", f"SELECT doc_id, md5({merged('text')}) AS clean, length({merged('text')}) AS n_chars FROM documents"))
def cln_merge_wraps(t):
    """CLN-2: soft wraps joined, list items on new lines."""
    text = C.merge_wraps(F.col("text"), LICENCE)
    return t.documents.select("doc_id", F.md5(text.cast("binary")).alias("clean"), F.length(text).alias("n_chars"))


@plan("cln_glyphs", oracle("", "SELECT doc_id, 'E123' AS glyph, 1 AS n FROM documents WHERE doc_id % 10 = 0"))
def cln_glyphs(t):
    """CLN-3: private-use glyphs without a mapping; every tenth document gets one known and one unknown glyph."""
    glyph = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("\uf06c\ue123"))).otherwise(F.col("text"))
    return C.unmapped_glyphs(t.documents.select("doc_id", glyph.alias("raw")), "doc_id").withColumn("glyph", F.hex(F.encode("glyph", "UTF-16BE")))


KIND = r"""CASE WHEN length(regexp_replace(text, '\s', '', 'g')) < 120 THEN '空白页'
    WHEN len(regexp_extract_all(text, '\d+\.\d+')) + len(regexp_extract_all(text, '[A-Z][a-z]+ion')) >= 5 THEN '数据页' ELSE '叙述页' END"""


@plan("cln_page_kind", oracle("", f"SELECT doc_id, {KIND} AS kind FROM documents"))
def cln_page_kind(t):
    """CLN-5: blank, data or narrative, thresholds as parameters."""
    return t.documents.select("doc_id", C.page_kind(F.col("text"), "[A-Z][a-z]+ion", 120, 5).alias("kind"))


@plan("cln_repair_score_table", oracle("score", """
    SELECT period, array_to_string(list(concat(entity, ' ', printf('%.2f', score)) ORDER BY h DESC, entity), chr(10)) AS lines FROM score GROUP BY 1"""))
def cln_repair_score_table(t):
    """CLN-6: all scores then all names, re-paired into lines."""
    return V.score_page(t).select("period", C.repair_score_table(F.col("raw"), NAME).alias("lines"))


@plan("cln_join_vertical", oracle("", """
    SELECT c_custkey, concat('深圳宝安', chr(10), n_name) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey"""))
def cln_join_vertical(t):
    """CLN-7: one character per line becomes a word; a Latin neighbour keeps its line."""
    tall = F.concat(F.lit("深\n圳\n宝 \n 安"), F.lit("\n"), F.col("n_name"))
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", C.join_vertical(tall).alias("text"))


@plan("cln_squash", oracle("", r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS n_dense, md5(regexp_replace(text, '\s+', '', 'g')) AS key FROM documents"))
def cln_squash(t):
    """CLN-8: no whitespace at all."""
    dense = C.squash(F.col("text"))
    return t.documents.select("doc_id", F.length(dense).alias("n_dense"), F.md5(dense.cast("binary")).alias("key"))


CHUNKED = f"""SELECT concat(period, '-P', CASE WHEN doc_id < 10 THEN '0' ELSE '' END, doc_id) AS chunk_id, period, doc_id AS page_no, kind AS page_kind,
    {merged('text')} AS text
    FROM (SELECT *, {KIND} AS kind, concat(2020 + CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) // 4, 'Q', CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 4 + 1)
            AS period FROM documents) WHERE kind <> '空白页'"""


def chunks(t):
    return C.build_chunks(V.raw_page(t), "[A-Z][a-z]+ion", NAME, 120, 5, LICENCE)


@plan("cln_build_chunks", oracle("", "SELECT chunk_id, period, page_no, page_kind, md5(text) AS text, length(text) AS n_chars FROM chunked", chunked=CHUNKED))
def cln_build_chunks(t):
    """CLN-9: pages to chunks, cleaned by kind."""
    return chunks(t).withColumn("text", F.md5(F.col("text").cast("binary")))


@plan("cln_chunk_statistics", oracle("", """
    SELECT period, count(*) AS n, min(length(text)) AS shortest, list_sort(list(length(text)))[count(*) // 2 + 1] AS median, max(length(text)) AS longest
    FROM chunked GROUP BY 1""", chunked=CHUNKED))
def cln_chunk_statistics(t):
    """CLN-10: chunk counts and lengths with the exact upper median."""
    return C.chunk_statistics(chunks(t))


@plan("val_chunk_quality", oracle("", f"""
    SELECT chunk_id, CASE WHEN trim(text) = '' THEN 'blank' ELSE 'footer' END AS problem FROM (
      SELECT doc_id AS chunk_id, text, len(list_filter(string_split(text, chr(10)), lambda x: {FOOT})) AS n FROM documents) WHERE trim(text) = '' OR n > 0"""))
def val_chunk_quality(t):
    """VAL-19: footer lines or glyphs left in a text (here: in the uncleaned documents)."""
    return C.quality_problems(t.documents.select(F.col("doc_id").alias("chunk_id"), "text"), LICENCE)


HTML = r"""trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'),
    '<[^>]*>', chr(10), 'g'), '\s*\n\s*', chr(10), 'g'))"""


@plan("src_page_lines", oracle("", f"""
    SELECT page_id, line_no, line FROM (SELECT page_id, unnest(string_split(x, chr(10))) AS line, unnest(range(1, len(string_split(x, chr(10))) + 1)) AS line_no
      FROM (SELECT page_id, {HTML} AS x FROM pages)) WHERE line <> ''"""))
def src_page_lines(t):
    """SRC-7: page text as numbered lines, from web pages."""
    lines = t.pages.select("page_id", F.posexplode(F.split(C.page_text(F.col("html")), "\n")).alias("p", "line"))
    return lines.select("page_id", (F.col("p") + 1).alias("line_no"), "line").filter("line <> ''")


@plan("ext_score_pages", oracle("", r"""
    SELECT doc, page_no, n_scores FROM (SELECT source AS doc, doc_id AS page_no, len(regexp_extract_all(text, '\d+\.\d+')) AS n_scores FROM documents)
    QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n_scores DESC, page_no) = 1"""))
def ext_score_pages(t):
    """EXT-1: the page with most scores per source."""
    return X.score_pages(t.documents.select(F.col("source").alias("doc"), F.col("doc_id").alias("page_no"), F.col("text").alias("raw")))


@plan("ext_pairs", oracle("score", """
    SELECT period, entity, score, concat(period, '-P09') AS source, row_number() OVER (PARTITION BY period ORDER BY h DESC, entity) AS place FROM score"""))
def ext_pairs(t):
    """EXT-2/3: names and scores read back from the printed pages."""
    return X.extract_pairs(V.score_page(t), NAME).select("period", "entity", *dbl("score"), "source", "place")


@plan("ext_stated_average", oracle("score", """
    SELECT period, CAST((2 * sum(h) + count(*)) // (2 * count(*)) AS BIGINT) / 100.0 AS stated, count(*) AS n_scores FROM score GROUP BY 1"""))
def ext_stated_average(t):
    """EXT-3: the stated average is no score."""
    return V.score_page(t).select("period", X.paired_lists(F.col("raw"), NAME).alias("p")).select(
        "period", F.col("p.stated").cast("double").alias("stated"), F.size("p.scores").alias("n_scores"))


# the sentence that opens a line; the repetition never gives back, since what follows a word of the list is no full stop inside it, so it needs no stack
SENTENCE = r"(?:^|\n)([A-Z][a-z]+(?:[, ]+[a-z]+)*+)\."
OFFICIAL = "SELECT DISTINCT string_split(p_name, ' ')[-1] AS metric FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_partkey % 7 = 0"


@plan("ext_metric_of_title", oracle("", f"""
    SELECT p_partkey AS page_id, first(metric ORDER BY length(metric) DESC) AS metric, CASE WHEN count(metric) = 0 THEN 'none' ELSE 'ok' END AS status
    FROM part LEFT JOIN ({OFFICIAL}) ON ends_with(CASE WHEN p_partkey % 11 = 0 THEN concat(p_name, '!') ELSE p_name END, metric) GROUP BY 1"""))
def ext_metric_of_title(t):
    """EXT-4, JON-8: the longest official name that a title ends with."""
    official = t.part.select(F.substring_index("p_name", " ", -1).alias("metric")).union(t.part.filter("p_partkey % 7 = 0").select("p_name"))
    titles = t.part.select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_partkey") % 11 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("candidate"))
    return X.metric_of_title(titles, official)


@plan("ext_official_lists", oracle("", r"""
    SELECT doc, count(*) AS n_lists, count(DISTINCT names) AS n_sets, count(DISTINCT raw) AS n_orders, min(names) AS names, count(DISTINCT names) = 1 AS agrees FROM (
      SELECT doc, raw, array_to_string(list_sort(list_filter(list_transform(string_split_regex(raw, '[, ]'), lambda x: trim(x)), lambda x: x <> '')), '/') AS names
      FROM (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '(?:^|\n)([A-Z][a-z]+(?:[, ]+[a-z]+)*)\.', 1)) AS raw FROM documents)) GROUP BY 1"""))
def ext_official_lists(t):
    """EXT-5: name lists of a document (its line-opening sentences): one set or several, one order or several."""
    docs = t.documents.select(F.col("doc_id").alias("doc"), "text")
    return X.official_lists(docs, SENTENCE, "[, ]")


@plan("ext_metric_coverage", oracle("score metric_score", """
    SELECT concat(s.period, '/', s.entity) AS doc, k.metric, 'page missing' AS problem
    FROM score s, (SELECT DISTINCT o_orderpriority AS metric FROM orders) k
    WHERE (s.period, s.entity, k.metric) NOT IN (SELECT period, entity, metric FROM metric_score WHERE h > 150)"""))
def ext_metric_coverage(t):
    """EXT-6: official metrics without a page."""
    doc = F.concat_ws("/", "period", "entity").alias("doc")
    every = F.array(*[F.lit(m) for m in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    return X.metric_coverage(V.metric_score(t).filter("score > 1.50").select(doc, "metric"), V.score(t).select(doc, F.explode(every).alias("metric")))


FIELDS = {"licence": (r"Version(\d+)\.0", r"version(\d+)\."), "address": (r"(\d+\.\d+\.\d+\.\d+)",), "call": (r"555-(\d{4})",)}


@plan("ext_pick_one", oracle("", r"""
    SELECT doc_id, CASE WHEN len(v) = 1 THEN v[1] END AS value, CASE len(v) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'conflict' END AS status
    FROM (SELECT doc_id, list_distinct(list_concat(regexp_extract_all(text, '(\d+\.\d+\.\d+\.\d+)', 1), regexp_extract_all(text, '555-(\d{4})', 1))) AS v FROM documents)"""))
def ext_pick_one(t):
    """EXT-7: synonymous patterns must agree on one value."""
    return t.documents.select("doc_id", X.pick_one(F.col("text"), (*FIELDS["address"], *FIELDS["call"])).alias("p")).select("doc_id", "p.value", "p.status")


@plan("ext_read_meta", oracle("", r"""
    SELECT doc, field, CASE WHEN len(v) = 1 THEN v[1] END AS value, CASE len(v) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'conflict' END AS status FROM (
      SELECT doc_id // 5 AS doc, field, list_distinct(flatten(list(v))) AS v FROM (
        SELECT doc_id, 'licence' AS field, list_concat(regexp_extract_all(x, 'Version(\d+)\.0', 1), regexp_extract_all(x, 'version(\d+)\.', 1)) AS v FROM squashed UNION ALL
        SELECT doc_id, 'address', regexp_extract_all(x, '(\d+\.\d+\.\d+\.\d+)', 1) FROM squashed UNION ALL
        SELECT doc_id, 'call', regexp_extract_all(x, '555-(\d{4})', 1) FROM squashed) GROUP BY 1, 2)""",
    squashed=r"SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS x FROM documents"))
def ext_read_meta(t):
    """EXT-8: fields of whole documents of five pages each."""
    pages = t.documents.select(F.expr("doc_id div 5").alias("doc"), F.col("doc_id").alias("page_no"), F.col("text").alias("raw"))
    return X.read_meta(pages, FIELDS)


@plan("ext_tier_pages", oracle("tier", "SELECT period, entity, tier, tier_avg, concat(period, '-P', replace(tier, ' ', '')) AS source FROM tier"))
def ext_tier_pages(t):
    """EXT-9: tier pages read back, longest name first."""
    return X.tier_pages(V.tier_page(t), V.members(t)).select("period", "entity", "tier", *dbl("tier_avg"), "source")


@plan("ext_ranked_table", oracle("tier", """
    SELECT period, tier, entity, h / 100.0 AS score FROM tier"""))
def ext_ranked_table(t):
    """EXT-10: a ranked tier table parsed into pairs."""
    placed = V.score(t).join(V.members(t), "entity")
    row = F.struct((-F.col("score")).alias("s"), "entity")
    pages = placed.groupBy("period", "tier").agg(F.sort_array(F.collect_list(row)).alias("r"))
    raw = F.concat(F.lit("— "), "tier", F.lit(" 机场综合得分\n"), F.array_join(F.transform("r", lambda x: (-x["s"]).cast("string")), "\n"),
                   F.lit("\n平均, 2.50\n"), F.array_join(F.transform("r", lambda x: x["entity"]), ""))
    parsed = pages.select("period", X.ranked_table(raw, NAME).alias("p"))
    return parsed.select("period", F.col("p.tier").alias("tier"), F.inline("p.pairs")).select("period", "tier", "entity", *dbl("score"))


@plan("ext_text_versions", oracle("period_meta_q", """
    SELECT period, basis_version, CASE WHEN sample_n % 7 = 0 THEN NULL WHEN sample_n % 5 = 0 THEN least(basis_version, concat(l1_n, '+', l2_n + 1)) ELSE basis_version END AS text_version,
           CASE WHEN sample_n % 7 = 0 THEN 0 WHEN sample_n % 5 = 0 THEN 2 ELSE 1 END AS n_versions,
           CASE WHEN sample_n % 7 = 0 THEN 'missing' WHEN sample_n % 5 = 0 THEN 'conflict' ELSE 'ok' END AS status FROM period_meta_q"""))
def ext_text_versions(t):
    """EXT-11, VAL-15: versions stated in two word orders, checked against the table."""
    m = V.period_meta_q(t)
    a = F.concat(F.lit("含 "), F.col("l1_n"), F.lit(" 项一级指标，"), F.col("l2_n"), F.lit(" 项二级指标"))
    b = F.concat(F.lit("一级指标 "), F.col("l1_n"), F.lit(" 项；二级指标 "), F.col("l2_n") + 1, F.lit(" 项"))
    texts = F.when(F.col("sample_n") % 7 == 0, F.array(F.lit("没有"))).when(F.col("sample_n") % 5 == 0, F.array(a, b)).otherwise(F.array(a))
    found = m.select("period", F.explode(texts).alias("x")).select("period", X.version_in(F.col("x")).alias("version"))
    return K.text_versions(found, m)


@plan("ext_numbers", oracle("", f"SELECT doc_id, array_to_string({sql_numbers('text')}, ' ') AS numbers FROM documents"))
def ext_numbers(t):
    """EXT-12: the set of numbers in every document."""
    return t.documents.select("doc_id", F.array_join(canonical_numbers(F.col("text")), " ").alias("numbers"))


@plan("ext_answer_numbers", oracle("run", f"""
    SELECT question_id, array_to_string(list_sort(list_distinct(list_concat({sql_numbers('answer')}, [['1', '2', '3', '10'][question_id % 4 + 1]]))), ' ') AS numbers,
           array_to_string({sql_numbers('answer')}, ' ') AS plain FROM run"""))
def ext_answer_numbers(t):
    """EXT-13, LAB-18: period tokens are no numbers, ordinal words are."""
    word = F.array(*[F.lit(x) for x in "一二三十"])[(F.col("question_id") % 4).cast("int")]
    text = F.concat("period", F.lit(" "), "answer", F.lit("，排名第"), word)
    return V.run(t).select("question_id", F.array_join(answer_numbers(text), " ").alias("numbers"), F.array_join(answer_numbers(text, with_ranks=False), " ").alias("plain"))


@plan("ext_cited_ids", oracle("run", """
    SELECT question_id, array_to_string(list_concat([expected_page], list_filter(sources, lambda s: s <> expected_page)), ' ') AS named,
           array_to_string(list_filter(sources, lambda s, i: list_position(sources, s) = i), ' ') AS cited FROM run"""))
def ext_cited_ids(t):
    """EXT-14/15: page ids anywhere in a text, and those inside citation brackets."""
    text = F.concat("expected_page", F.lit(" 见（出处: "), F.array_join("sources", " / "), F.lit("）"))
    return V.run(t).select("question_id", F.array_join(X.chunk_ids(text), " ").alias("named"), F.array_join(X.cited_ids(text), " ").alias("cited"))


@plan("ext_citations", oracle("run", """
    SELECT question_id, CASE WHEN k < 6 THEN i ELSE NULL END AS clause_no, CASE WHEN k IN (0, 1) THEN '综合得分' WHEN k = 2 AND i = 0 THEN '综合得分' WHEN k = 2 THEN '指标得分' END AS tbl,
           CASE WHEN k IN (0, 1) THEN period WHEN k = 2 THEN period END AS period, CASE WHEN k = 3 THEN concat(period, '-P05') END AS page,
           CASE k WHEN 4 THEN 'unknown key' WHEN 5 THEN 'repeated key' WHEN 6 THEN 'empty' END AS error
    FROM (SELECT question_id, period, question_id % 7 AS k, unnest(CASE WHEN question_id % 7 = 2 THEN [0, 1] ELSE [0] END) AS i FROM run)"""))
def ext_citations(t):
    """EXT-16: citation mini-records with unknown and repeated keys, full-width signs and report names."""
    k, p = F.col("question_id") % 7, F.col("period")
    text = (
        F.when(k == 0, F.concat(F.lit("表=综合得分;期次="), p))
        .when(k == 1, F.concat(F.lit("表＝综合得分；期次："), p))
        .when(k == 2, F.concat(F.lit("表=综合得分;期次="), p, F.lit(" | 表=指标得分;期次="), p))
        .when(k == 3, F.concat(F.lit("R_"), p, F.lit("_报告P5")))
        .when(k == 4, F.concat(F.lit("表=综合得分;日期="), p))
        .when(k == 5, F.concat(F.lit("表=综合得分;期次="), p, F.lit(";期次="), p))
        .otherwise(F.lit(" "))
    )
    return X.parse_citations(V.run(t).select("question_id", text.alias("citation"))).select(
        "question_id", "clause_no", F.col("fields")["表"].alias("tbl"), F.col("fields")["期次"].alias("period"), F.col("fields")["chunk"].alias("page"), "error")


@plan("ext_sub_items", oracle("run", "SELECT question_id, expected_answer AS items, len(string_split(expected_answer, ';')) AS n FROM run"))
def ext_sub_items(t):
    """EXT-17: items of the expected answer."""
    items = E.sub_items(F.col("expected_answer"))
    return V.run(t).select("question_id", F.array_join(items, ";").alias("items"), F.size(items).alias("n"))


@plan("ext_trace_terms", oracle("run", "SELECT question_id, CASE WHEN n_trace > 0 THEN concat(category, ' ', period) END AS terms FROM run"))
def ext_trace_terms(t):
    """EXT-18: search terms out of the run trace."""
    trace = F.when(F.col("n_trace") > 0, F.array(F.lit("路由：SQL"), F.concat(F.lit("检索用词： "), "category", F.lit(" "), "period"))).otherwise(F.array(F.lit("无")))
    return V.run(t).select("question_id", X.trace_terms(trace).alias("terms"))


KEY = "md5(regexp_replace(regexp_replace(text, '\\d{4}Q\\d', '◇', 'g'), '\\s+', '', 'g'))"


@plan("ver_content_keys", oracle("chunk", f"SELECT chunk_id, {KEY} AS key FROM chunk"))
def ver_content_keys(t):
    """VER-1: the normalised content key."""
    return V.chunk(t).select("chunk_id", N.content_key(F.col("text")).alias("key"))


@plan("ver_groups", oracle("chunk", f"""
    SELECT page_kind AS kind, {KEY} AS key, count(*) AS members, count(DISTINCT period) AS n_periods, min(chunk_id) AS rep_id, arg_min(period, chunk_id) AS rep_period,
           min(period) AS first_period, max(period) AS last_period, array_to_string(list_sort(list(DISTINCT period)), '/') AS periods FROM chunk GROUP BY 1, 2"""))
def ver_groups(t):
    """VER-2, WIN-12: exact version groups with their representative."""
    return N.version_groups(V.chunk(t))


@plan("ver_members", oracle("chunk", f"""
    SELECT chunk_id, period, min(chunk_id) OVER (PARTITION BY page_kind, {KEY}) AS rep_id, count(*) OVER (PARTITION BY page_kind, {KEY}) AS members FROM chunk"""))
def ver_members(t):
    """VER-2: every chunk with its representative."""
    return N.version_members(V.chunk(t))


@plan("ver_notes", oracle("chunk", f"""
    SELECT page, count(*) AS n_versions, min(a) AS first_period, max(b) AS last_period, first(excerpt ORDER BY rep) AS excerpt, count(DISTINCT numbers) > 1 AS numbers_differ
    FROM (SELECT n_chars // 40 AS page, {KEY} AS key, min(chunk_id) AS rep, min(period) AS a, max(period) AS b, first(text[1:70] ORDER BY chunk_id) AS excerpt,
                 first(array_to_string({sql_numbers("regexp_replace(text, '\\d{4}Q\\d', '', 'g')")}, ',') ORDER BY chunk_id) AS numbers
          FROM chunk GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1"""))
def ver_notes(t):
    """VER-3: notes on pages with several versions (a page here: documents of about one length)."""
    return N.version_notes(V.chunk(t).withColumn("page", F.expr("n_chars div 40").cast("bigint")), ["page"])


GRAMS = """list_distinct(list_transform(range(1, length(x) - 6), lambda i: x[i:i+7]))"""
NORM = "regexp_replace(regexp_replace(text, '\\d{4}Q\\d', '◇', 'g'), '\\s+', '', 'g')"


@plan("ver_containment", oracle("", f"""
    SELECT item_id, doc_id, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(a), 6) AS share FROM (
      SELECT item_id, doc_id, {GRAMS.replace('x[', 'q[').replace('length(x)', 'length(q)')} AS a, {GRAMS} AS b FROM (
        SELECT item_id, doc_id, {NORM.replace('(text', '(b.text')} AS q, {NORM.replace('(text', '(d.text')} AS x
        FROM benchmark b JOIN documents d ON contains(d.text, b.text[1:30])))"""))
def ver_containment(t):
    """VER-6: share of a benchmark item's shingles that a document holding its opening contains."""
    from plumbline.operators.matching import phrase_occurrences
    opening = t.benchmark.select(F.col("item_id").alias("phrase_id"), F.substring("text", 1, 30).alias("phrase"))
    pairs = phrase_occurrences(t.documents.select(F.col("doc_id").alias("text_id"), "text"), opening, fold_case=False).select(
        F.col("phrase_id").alias("item_id"), F.col("text_id").alias("doc_id")).distinct()
    a = t.benchmark.select("item_id", N.shingles(F.col("text")).alias("a"))
    b = t.documents.select("doc_id", N.shingles(F.col("text")).alias("b"))
    return pairs.join(a, "item_id").join(b, "doc_id").select("item_id", "doc_id", F.round(N.containment(F.col("a"), F.col("b")), 6).alias("share"))


def version_pairs(t):
    """Wanted document against what came back: its version's representative and the next document."""
    m = N.version_members(V.chunk(t))
    return m.select(F.col("chunk_id").alias("question_id"), F.col("chunk_id").alias("want"), F.explode(F.array("rep_id", F.col("chunk_id") + 1)).alias("got"))


PAIRED = f"""SELECT w.chunk_id AS question_id, w.chunk_id AS want, g.chunk_id AS got, w.period AS p1, g.period AS p2, w.key = g.key AS same, w.x AS x1, g.x AS x2 FROM (
    SELECT *, min(chunk_id) OVER (PARTITION BY page_kind, key) AS rep FROM ks) w JOIN ks g ON g.chunk_id IN (w.rep, w.chunk_id + 1) AND g.page_kind = w.page_kind"""
KS = f"SELECT chunk_id, period, page_kind, {NORM} AS x, md5({NORM}) AS key FROM chunk"
SIM = f"""CASE WHEN same THEN 1.0 ELSE CAST(len(list_intersect({GRAMS.replace('x[', 'x1[').replace('length(x)', 'length(x1)')}, {GRAMS.replace('x[', 'x2[').replace('length(x)', 'length(x2)')})) AS DOUBLE)
    / len(list_distinct(list_concat({GRAMS.replace('x[', 'x1[').replace('length(x)', 'length(x1)')}, {GRAMS.replace('x[', 'x2[').replace('length(x)', 'length(x2)')}))) END"""


@plan("ver_similar_pages", oracle("chunk", f"SELECT question_id, want, got, round({SIM}, 6) AS similarity FROM paired WHERE want <> got", ks=KS, paired=PAIRED))
def ver_similar_pages(t):
    """VER-4, JON-12: similarity of given page pairs of one kind."""
    pairs = version_pairs(t).filter("want <> got").distinct()
    return N.compare_pages(pairs, V.chunk(t), "want", "got", ["page_kind"]).select("question_id", "want", "got", F.round("similarity", 6).alias("similarity"))


@plan("evl_evidence", oracle("chunk", f"""
    SELECT question_id, bool_or(want = got) AS direct, NOT bool_or(want = got) AND coalesce(bool_or(s >= 0.95) FILTER (p1 <> p2 AND want <> got), false) AS relaxed,
           coalesce(bool_or(s < 0.95) FILTER (p1 <> p2 AND want <> got), false) AS conflict
    FROM (SELECT *, {SIM} AS s FROM paired UNION ALL SELECT chunk_id, chunk_id, -1, period, period, true, '', '', 1.0 FROM chunk) GROUP BY 1""", ks=KS, paired=PAIRED))
def evl_evidence(t):
    """EVL-3/4: direct evidence, the same page of another period, or a page that says something else."""
    return N.evidence(version_pairs(t).distinct(), V.chunk(t), ["page_kind"])


@plan("ver_boundary", oracle("run", """
    SELECT question_id, before, after, CAST(before AS INT) + CAST(after AS INT) AS n_sides FROM (
      SELECT question_id, coalesce(bool_or(o < 19981), false) AS before, coalesce(bool_or(o >= 19981), false) AS after FROM (
        SELECT question_id, CAST(concat(s[1:4], s[6:6]) AS INT) AS o FROM (SELECT question_id, unnest(sources) AS s FROM run)) GROUP BY 1)"""))
def ver_boundary(t):
    """VER-5: sources on both sides of a stated boundary period."""
    got = V.run(t).select("question_id", F.explode("sources").alias("got"), F.lit("x").alias("page"), F.lit("1998Q1").alias("cut"))
    pages = got.select(F.col("got").alias("chunk_id"), "page", F.substring("got", 1, 6).alias("period")).distinct()
    return N.boundary_sides(got, pages, ["page"])
