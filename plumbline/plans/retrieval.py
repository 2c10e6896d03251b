"""Retrieval plans: benchmark phrases over documents, embedding queries over the embedding corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.operators import aggregate as A
from plumbline.operators import combine as C
from plumbline.operators import retrieval as S
from plumbline.operators import versions as X
from plumbline.plans.oracle import oracle
from plumbline.plans.registry import plan
from plumbline.plans.aggregates import sql_numbers
from plumbline.session import durable
from plumbline.sources import views as V

SAFE = r"[^\x{4e00}-\x{9fff}\p{L}\p{N}_]"


def scored(phrases: str) -> dict[str, str]:
    """CTEs that end in ``hits(phrase_id, id, period, bm25)`` for the phrases of a CTE."""
    return {
        "needle": f"SELECT phrase_id, lower(phrase) AS p FROM ({phrases}) WHERE length(regexp_replace(phrase, '{SAFE}', '', 'g')) >= 3",
        # overlapping occurrences: the characters of each matching text, rejoined at every place
        "near": "SELECT phrase_id, chunk_id AS id, period, p, lower(text) AS hay FROM chunk JOIN needle ON contains(lower(text), p)",
        "tf": """SELECT phrase_id, id, period, CAST(CASE WHEN len(list_filter(range(1, length(p)),
                   lambda i: p[:i] = p[length(p) - i + 1:])) > 0
                 THEN len(list_filter(range(1, length(hay) - length(p) + 2), lambda i: substring(hay, i, length(p)) = p))
                 ELSE (length(hay) - length(replace(hay, p, ''))) // length(p) END AS BIGINT) AS tf FROM near""",
        "hits": """SELECT phrase_id, tf.id, tf.period,
                 greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * (tf * 2.2::DOUBLE)
                 / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(length(c.text) - 2, 0) / avgdl)) AS bm25
                 FROM tf JOIN (SELECT phrase_id, count(*) AS df FROM tf GROUP BY 1) USING (phrase_id)
                 JOIN chunk c ON c.chunk_id = tf.id,
                 (SELECT count(*) AS n_docs, sum(greatest(length(text) - 2, 0)) / count(*) AS avgdl FROM chunk)""",
    }


PHRASES = "SELECT query_id AS phrase_id, phrase FROM query"
TERMS = {
    "term": f"""SELECT DISTINCT ON (query_id, term) query_id, term_no, term FROM (
        SELECT query_id, i - 1 AS term_no, lower(regexp_replace(w[i], '{SAFE}', '', 'g')) AS term
        FROM (SELECT query_id, string_split_regex(trim(phrase), '\\s+') AS w,
                     unnest(range(1, len(string_split_regex(trim(phrase), '\\s+')) + 1)) AS i FROM query))
        WHERE length(term) >= 3 ORDER BY query_id, term, term_no""",
    **scored("SELECT DISTINCT term AS phrase_id, term AS phrase FROM term"),
    "kw": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rank FROM (
        SELECT query_id, id, max(bm25) AS bm25 FROM hits JOIN term ON phrase_id = term GROUP BY 1, 2)""",
}
# query vectors are embeddings 0..; the corpus is every embedding
VEC = {
    "qvec": "SELECT item_id AS query_id, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id",
    "vec": """SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank, same FROM (
        SELECT query_id, vec_id AS id, round(list_dot_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS cosine,
               label = (SELECT label FROM embeddings e2 WHERE e2.vec_id = query_id) AS same
        FROM qvec, embeddings)""",
}


def vectors(t):
    own = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("only"))
    return own.join(t.benchmark.select(F.col("item_id").alias("query_id")), "query_id", "left_semi")


def corpus(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding")


def keyword_list(t, k=5):
    return S.search_terms(V.chunk(t), V.query(t), k)


def vector_list(t, k=5):
    return S.vector_top_k(vectors(t).drop("only"), corpus(t), k)


@plan("ret_gram_statistics", oracle("chunk", """
    SELECT gram, count(DISTINCT chunk_id) AS df, count(*) AS occurrences FROM (
      SELECT chunk_id, substring(hay, pos, 3) AS gram FROM (
        SELECT chunk_id, lower(text) AS hay, unnest(range(1, length(text) - 1)) AS pos FROM chunk WHERE page_kind <> 'en'))
    GROUP BY 1"""))
def ret_gram_statistics(t):
    """RET-1: the trigram index over the indexable kinds, summarised per gram."""
    return S.gram_statistics(V.chunk(t).filter(~F.col("page_kind").startswith("en")))


@plan("ret_searchable", oracle("query", f"""
    SELECT query_id, word_no, regexp_replace(word, '{SAFE}', '', 'g') AS clean,
           length(regexp_replace(word, '{SAFE}', '', 'g')) >= 3 AS searchable
    FROM (SELECT query_id, unnest(string_split(phrase, ' ')) AS word, generate_subscripts(string_split(phrase, ' '), 1) - 1 AS word_no
          FROM query)"""))
def ret_searchable(t):
    """RET-2: sanitised words and whether the index can serve them."""
    words = V.query(t).select("query_id", F.posexplode(F.split("phrase", " ")).alias("word_no", "word"))
    return words.select("query_id", "word_no", S.sanitise(F.col("word")).alias("clean"), S.searchable(F.col("word")).alias("searchable"))


@plan("ret_phrase_search", oracle("chunk query", """
    SELECT phrase_id AS query_id, id, round(bm25, 6) AS bm25, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY bm25 DESC, id) AS rank FROM hits) WHERE rank <= 5""",
    **scored(PHRASES)))
def ret_phrase_search(t):
    """RET-3: phrase search in BM25 order."""
    return S.search(V.chunk(t), V.query(t)).withColumn("bm25", F.round("bm25", 6))


@plan("ret_phrase_search_in_periods", oracle("chunk query", """
    SELECT phrase_id AS query_id, id, round(bm25, 6) AS bm25, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY bm25 DESC, id) AS rank FROM hits
      WHERE phrase_id % 2 = 0 OR period IN ('2020Q1', '2021Q3', '2022Q2', '2023Q4')) WHERE rank <= 5""",
    **scored(PHRASES)))
def ret_phrase_search_in_periods(t):
    """RET-3, FLT-6: a period list filters before the cut; an empty list does not filter."""
    some = F.array(*[F.lit(p) for p in ("2020Q1", "2021Q3", "2022Q2", "2023Q4")])
    asked = V.query(t).withColumn("periods", F.when(F.col("query_id") % 2 == 0, F.array().cast("array<string>")).otherwise(some))
    return S.search(V.chunk(t), asked).withColumn("bm25", F.round("bm25", 6))


@plan("ret_term_search", oracle("chunk query", """
    SELECT query_id, id, round(bm25, 6) AS bm25, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rank FROM (
        SELECT query_id, id, max(bm25) AS bm25 FROM (
          SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY bm25 DESC, id) AS r FROM hits) JOIN term ON phrase_id = term
        WHERE r <= 5 GROUP BY 1, 2)) WHERE rank <= 5""", **TERMS))
def ret_term_search(t):
    """RET-4: terms as alternatives, best score per chunk."""
    return keyword_list(t).withColumn("bm25", F.round("bm25", 6))


@plan("ret_vector_search", oracle("", "SELECT query_id, id, rank, cosine FROM vec WHERE rank <= 5", **VEC))
def ret_vector_search(t):
    """RET-5, SRC-9: cosine top five."""
    return vector_list(t)


@plan("ret_vector_search_filtered", oracle("", """
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank, cosine
    FROM vec WHERE same QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) <= 5""", **VEC))
def ret_vector_search_filtered(t):
    """RET-5: the same, restricted to the group of the query before the cut."""
    return S.vector_top_k(vectors(t), t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("grp")))


def fused(kw: str, vec: str, w_kw: float = 1, w_vec: float = 1, where: str = "true") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, kw_rank NULLS LAST, vec_rank NULLS LAST, id)
      AS rank FROM (SELECT query_id, id, sum(part) AS fused, min(k) AS kw_rank, min(v) AS vec_rank FROM (
        SELECT query_id, id, {w_kw}::DOUBLE / (60 + rank) AS part, rank AS k, NULL AS v FROM {kw} WHERE {where} UNION ALL
        SELECT query_id, id, {w_vec}::DOUBLE / (60 + rank), NULL, rank FROM {vec} WHERE {where}) GROUP BY 1, 2)"""


KW5 = """SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rank FROM (
        SELECT query_id, id, max(bm25) AS bm25 FROM (
          SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY bm25 DESC, id) AS r FROM hits) JOIN term ON phrase_id = term
        WHERE r <= {k} GROUP BY 1, 2) QUALIFY rank <= {k}"""
SHORT = {**TERMS, **VEC, "kw5": KW5.format(k=5), "vec5": "SELECT query_id, id, rank FROM vec WHERE rank <= 5"}


@plan("ret_fusion", oracle("chunk query", """
    SELECT query_id, id, rank, round(fused, 9) AS fused, kw_rank, vec_rank FROM f WHERE rank <= 5""",
    **SHORT, f=fused("kw5", "vec5")))
def ret_fusion(t):
    """RET-6: reciprocal-rank fusion of two top-five lists."""
    return S.fuse(keyword_list(t), vector_list(t)).withColumn("fused", F.round("fused", 9))


@plan("ret_fusion_weighted", oracle("chunk query", """
    SELECT query_id, id, rank, round(fused, 9) AS fused, kw_rank, vec_rank FROM f WHERE rank <= 5""",
    **SHORT, f=fused("kw5", "vec5", 2, 1, "rank <= 3")))
def ret_fusion_weighted(t):
    """RET-6: weights 2:1 and a rank cut of 3."""
    return S.fuse(keyword_list(t), vector_list(t), 5, 2.0, 1.0, 3).withColumn("fused", F.round("fused", 9))


@plan("ret_hybrid_search", oracle("chunk query", """
    SELECT query_id, id, rank, round(fused, 9) AS fused, kw_rank, vec_rank, period, n_chars, period IS NULL AS ghost
    FROM f LEFT JOIN chunk ON chunk_id = id WHERE rank <= 5""", **TERMS, **VEC, f=fused("kw", "vec")))
def ret_hybrid_search(t):
    """RET-7, JON-4/5: fusion over both whole rankings, contents attached, ghosts marked."""
    return S.hybrid_search(V.chunk(t), V.query(t), vectors(t).drop("only"), corpus(t)).withColumn("fused", F.round("fused", 9))


@plan("ret_hybrid_shortfall", oracle("chunk query", """
    SELECT k.query_id, k.n AS baseline, coalesce(g.n, 0) AS returned, coalesce(g.n, 0) < k.n AS short
    FROM (SELECT query_id, count(*) AS n FROM kw5 GROUP BY 1) k
    LEFT JOIN (SELECT query_id, count(*) AS n FROM f JOIN chunk ON chunk_id = id WHERE rank <= 5 GROUP BY 1) g USING (query_id)""",
    **SHORT, f=fused("kw", "vec")))
def ret_hybrid_shortfall(t):
    """RET-7: warn when fusion returns fewer than keyword search alone."""
    merged = S.hybrid_search(V.chunk(t), V.query(t), vectors(t).drop("only"), corpus(t))
    return S.shortfall(merged, keyword_list(t))


PAGE = "n_chars // 40"  # a page here: documents of about one length
VERSIONS = {
    "opened": f"""SELECT query_id, {PAGE} AS page, arg_min(page_kind, rank) AS kind FROM hit JOIN chunk ON chunk_id = id WHERE query_id % 2 = 0 GROUP BY 1, 2""",
    "versions": f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page, kind) AS n_versions FROM (
        SELECT {PAGE} AS page, page_kind AS kind, md5(regexp_replace(regexp_replace(text, '\\d{{4}}Q\\d', '◇', 'g'), '\\s+', '', 'g')) AS key, min(chunk_id) AS rep_id,
               min(period) AS a, max(period) AS b, first(text[1:70] ORDER BY chunk_id) AS excerpt,
               first(array_to_string({sql_numbers("regexp_replace(text, '\\d{4}Q\\d', '', 'g')")}, ',') ORDER BY chunk_id) AS numbers
        FROM chunk GROUP BY 1, 2, 3)) WHERE n_versions > 1""",
}


def asked(t):
    """Queries of which every other one names a period."""
    return V.query(t).withColumn("periods", F.when(F.col("query_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("2020Q1"))))


def paged(t):
    return V.chunk(t).withColumn("page", F.expr("n_chars div 40").cast("bigint"))


@plan("ret_version_aware", oracle("chunk query", """
    SELECT query_id, id, min(origin) AS origin FROM (
      SELECT query_id, id, 'hit' AS origin FROM hit UNION ALL SELECT query_id, rep_id, 'version' FROM opened JOIN versions USING (page, kind)) GROUP BY 1, 2""",
    **{**TERMS, "hit": KW5.format(k=5), **VERSIONS}))
def ret_version_aware(t):
    """RET-8: a query without a period gets the representative of every version of the pages it hit."""
    return X.version_aware(keyword_list(t), paged(t), asked(t), ["page"])[0]


@plan("ret_version_notes", oracle("chunk query", """
    SELECT query_id, page, kind, count(*) AS n_versions, min(a) AS first_period, max(b) AS last_period, first(excerpt ORDER BY rep_id) AS excerpt,
           count(DISTINCT numbers) > 1 AS numbers_differ
    FROM opened JOIN versions USING (page, kind) GROUP BY 1, 2, 3""",
    **{**scored(PHRASES), "hit": "SELECT phrase_id AS query_id, id, row_number() OVER (PARTITION BY phrase_id ORDER BY bm25 DESC, id) AS rank FROM hits QUALIFY rank <= 5", **VERSIONS}))
def ret_version_notes(t):
    """RET-8, VER-3: what a reader is told about pages with several versions."""
    return X.version_aware(S.search(V.chunk(t), V.query(t)), paged(t), asked(t), ["page"])[1]


@plan("ret_drop_periods", oracle("query chunk", """
    SELECT query_id, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE w END, ' ') AS terms FROM (
      SELECT query_id, w, list_filter(w, lambda x: NOT regexp_full_match(x, '\\d{4}Q\\d')) AS kept FROM (
        SELECT query_id, string_split(concat(CASE WHEN query_id % 3 = 0 THEN '' ELSE concat(phrase, ' ') END, '2024Q', query_id % 4 + 1), ' ')
               AS w FROM query))"""))
def ret_drop_periods(t):
    """RET-9: quarter tokens leave the search terms unless nothing else is there."""
    tagged = F.concat(F.when(F.col("query_id") % 3 == 0, "").otherwise(F.concat("phrase", F.lit(" "))), F.lit("2024Q"),
                      (F.col("query_id") % 4 + 1).cast("string"))
    return V.query(t).select("query_id", F.array_join(S.drop_periods(F.split(tagged, " ")), " ").alias("terms"))


WORDS = """SELECT query_id, i - 1 AS word_no, w[i] AS word, len(w) AS n FROM (
    SELECT query_id, string_split_regex(trim(phrase), '\\s+') AS w, unnest(range(1, len(string_split_regex(trim(phrase), '\\s+')) + 1)) AS i FROM query)"""
TRIES = {
    "word": WORDS,
    "worded": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df, word_no DESC) AS place,
        row_number() OVER (PARTITION BY query_id ORDER BY df DESC, word_no) AS best
        FROM word JOIN (SELECT lower(word) AS lw, count(chunk_id) AS df FROM (SELECT DISTINCT word FROM word) LEFT JOIN chunk ON contains(lower(text), lower(word)) GROUP BY 1) ON lw = lower(word)""",
    "said": """SELECT query_id, attempt, string_agg(word, ' ' ORDER BY word_no) AS phrase FROM worded, (SELECT unnest([0, 1, 2, 3]) AS attempt)
        WHERE place > attempt GROUP BY 1, 2 UNION ALL
        SELECT query_id, 4, left(word, CAST(greatest(3, ceil(length(word) / 2)) AS INT)) FROM worded WHERE best = 1 AND length(word) > 3""",
    "tries": "SELECT query_id, min(attempt) AS attempt, concat(query_id, '|', min(attempt)) AS phrase_id, phrase FROM said GROUP BY query_id, phrase",
}


@plan("ret_back_off", oracle("chunk query", """
    SELECT query_id, attempt, phrase, id, rank, bm25, CASE WHEN id IS NULL THEN 'no_match' WHEN attempt = 0 THEN 'ok' ELSE 'backed_off' END AS status FROM query q
    LEFT JOIN (SELECT query_id, attempt, t.phrase AS said, id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id, attempt ORDER BY bm25 DESC, id) AS rank
               FROM hits JOIN tries t USING (phrase_id) QUALIFY attempt = min(attempt) OVER (PARTITION BY query_id)) USING (query_id)
    WHERE rank IS NULL OR rank <= 5""".replace("attempt, phrase, id", "attempt, said AS phrase, id", 1),
    **{**TRIES, **scored("SELECT phrase_id, phrase FROM tries")}))
def ret_back_off(t):
    """RET-10: zero-hit queries lose their rarest words, then all but half a word; what never hits says so."""
    return S.back_off(V.chunk(t), V.query(t)).withColumn("bm25", F.round("bm25", 6))


@plan("ret_query_status", oracle("chunk query", f"""
    SELECT query_id, coalesce(n, 0) AS n, CASE WHEN length(regexp_replace(phrase, '{SAFE}', '', 'g')) < 3 THEN 'unsupported'
           WHEN n > 0 THEN 'ok' ELSE 'no_match' END AS status
    FROM query LEFT JOIN (SELECT phrase_id, least(count(*), 5) AS n FROM hits GROUP BY 1) ON phrase_id = query_id""", **scored(PHRASES)))
def ret_query_status(t):
    """FLT-11: no match is not the same as not searchable."""
    return S.query_status(V.query(t), S.search(V.chunk(t), V.query(t)))


EXPECTED = "SELECT item_id AS query_id, vec_id AS id FROM benchmark, embeddings WHERE vec_id <> item_id AND label = (SELECT label FROM embeddings e WHERE e.vec_id = item_id)"


def labels(t):
    """(query_id, label) of every query."""
    return t.embeddings.select(F.col("vec_id").alias("query_id"), "label").join(t.benchmark.select(F.col("item_id").alias("query_id")), "query_id", "left_semi")


def expected(t, *lists):
    """Of the listed ids of a query, those that answer it: embeddings of its label other than its own. A label's embeddings never meet its queries as pairs."""
    listed = reduce(lambda a, b: a.unionByName(b), [x.select("query_id", "id") for x in lists]).distinct().filter("id <> query_id")
    meant = listed.join(labels(t), "query_id").join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("own")), "id")
    return meant.filter("label = own").select("query_id", "id")


def askable(t):
    """Queries that some embedding other than their own answers."""
    sizes = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels(t).join(sizes, "label").filter("n > 1").select("query_id").distinct()


COMBOS = [(1.0, 1.0, 0), (2.0, 1.0, 0), (1.0, 2.0, 0), (1.0, 1.0, 3), (1.0, 0.0, 0), (0.0, 1.0, 0)]


def _sweep_sql() -> dict[str, str]:
    parts = []
    for a, b, cut in COMBOS:
        where = f"rank <= {cut}" if cut else "true"
        kw = "kw5" if a else "(SELECT * FROM kw5 WHERE false)"
        vec = "vec5" if b else "(SELECT * FROM vec5 WHERE false)"
        parts.append(f"SELECT '{a:g}:{b:g}/{cut}' AS combo, query_id, id FROM ({fused(kw, vec, a or 1, b or 1, where)}) WHERE rank <= 3")
    return {"grid": " UNION ALL ".join(parts), "expect": EXPECTED,
            "found": "SELECT DISTINCT combo, query_id FROM grid JOIN expect USING (query_id, id)"}


@plan("ret_sweep", oracle("chunk query", """
    SELECT combo, coalesce(hits, 0) AS hits, (SELECT count(DISTINCT query_id) FROM expect) AS queries,
           (SELECT count(DISTINCT query_id) FROM found) AS reachable,
           coalesce(hits, 0) / (SELECT count(DISTINCT query_id) FROM found) AS rate_of_reachable
    FROM (SELECT DISTINCT combo FROM grid) LEFT JOIN (SELECT combo, count(*) AS hits FROM found GROUP BY 1) USING (combo)""",
    **SHORT, **_sweep_sql()))
def ret_sweep(t):
    """RET-11: every weight and cut over every query, unreachable queries set aside."""
    kw, vec = durable(keyword_list(t)), durable(vector_list(t))
    return S.sweep(kw, vec, expected(t, kw, vec), COMBOS, 3, askable(t))


STRATS = ["keyword", "fill", "intersect", "union"]


def merged_lists(t):
    kw, vec = durable(keyword_list(t)), durable(vector_list(t))  # both are read by every strategy
    out = None
    for name in STRATS:
        part = C.STRATEGIES[name](kw, vec, 5).select(F.lit(name).alias("strategy"), "query_id", "id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


MERGED = {
    **SHORT,
    "expect": EXPECTED,
    "pooled": """SELECT query_id, id, min(leg * 100 + rank) AS o FROM (SELECT query_id, id, 0 AS leg, rank FROM kw5 UNION ALL
               SELECT query_id, id, 1, rank FROM vec5) GROUP BY 1, 2""",
    "merged": """SELECT 'keyword' AS strategy, query_id, id, rank FROM kw5 UNION ALL
        SELECT 'fill', query_id, id, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS r FROM pooled) WHERE r <= 5 UNION ALL
        SELECT 'union', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o) FROM pooled UNION ALL
        SELECT 'intersect', query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY kw5.rank) FROM kw5 SEMI JOIN vec5 USING (query_id, id)""",
}


@plan("set_merge_strategies", oracle("chunk query", "SELECT strategy, query_id, id, rank FROM merged", **MERGED))
def set_merge_strategies(t):
    """SET-1..4: the four ways to merge two top-five lists."""
    return merged_lists(t)


@plan("agg_list_sizes", oracle("chunk query", """
    SELECT strategy, (SELECT count(*) FROM query) AS queries, CAST(sum(hit) AS BIGINT) AS hits,
           sum(size) / (SELECT count(*) FROM query) AS avg_size, max(size) AS max_size
    FROM (SELECT strategy, query_id, count(*) AS size, max(CASE WHEN (query_id, id) IN (SELECT query_id, id FROM expect) THEN 1 ELSE 0 END) AS hit
          FROM merged GROUP BY 1, 2) GROUP BY 1""", **MERGED))
def agg_list_sizes(t):
    """AGG-15: hits and list sizes per strategy."""
    merged = durable(merged_lists(t))
    return A.list_sizes(merged, expected(t, merged), V.query(t))


CELL = "max(CASE WHEN strategy = '{s}' THEN cell END)"


@plan("ret_outcome_matrix", oracle("chunk query", "SELECT query_id, " + ", ".join(
    f"['empty', 'absent', 'beyond', 'hit'][coalesce(\"{s}\", 0) + 1] AS \"{s}\"" for s in STRATS) + """,
    ['empty', 'absent', 'beyond', 'hit'][least(coalesce(keyword, 0), coalesce(fill, 0), coalesce("intersect", 0), coalesce("union", 0)) + 1] AS worst
    FROM query LEFT JOIN (SELECT query_id, """ + ", ".join(f"{CELL.format(s=s)} AS \"{s}\"" for s in STRATS) + """
      FROM (SELECT strategy, query_id, CASE WHEN r <= 3 THEN 3 WHEN r IS NOT NULL THEN 2 ELSE 1 END AS cell FROM (
        SELECT strategy, query_id, min(rank) FILTER ((query_id, id) IN (SELECT query_id, id FROM expect)) AS r FROM merged GROUP BY 1, 2))
      GROUP BY 1) USING (query_id)""", **MERGED))
def ret_outcome_matrix(t):
    """RET-12: hit, beyond, absent or empty per strategy, with the worst cell."""
    merged = durable(merged_lists(t))
    return S.outcome_matrix(merged, expected(t, merged), V.query(t), STRATS, 3)


DF = {**TERMS, "dfs": """SELECT query_id, term_no, term, coalesce(df, 0) AS df FROM term
    LEFT JOIN (SELECT phrase_id, count(*) AS df FROM tf GROUP BY 1) ON phrase_id = term"""}
EXTREME = """SELECT query_id, first(term ORDER BY df, term_no, term) AS most, first(term ORDER BY df DESC, term_no, term) AS least
    FROM dfs GROUP BY 1"""


@plan("agg_document_frequency", oracle("chunk query", "SELECT DISTINCT term, df FROM dfs", **DF))
def agg_document_frequency(t):
    """AGG-18: document frequency of every query term."""
    return S.document_frequency(V.chunk(t), S.split_terms(V.query(t)))


@plan("top_distinctive_terms", oracle("chunk query", EXTREME, **DF))
def top_distinctive_terms(t):
    """TOP-7: rarest and commonest term of each query."""
    return S.distinctive_terms(V.chunk(t), V.query(t))


@plan("ret_variants", oracle("chunk query", f"""
    SELECT query_id, phrase, max(variant) AS variant FROM (
      SELECT query_id, 'stripped' AS variant, trim(regexp_replace(phrase, '\\d{{4}}Q\\d', '', 'g')) AS phrase FROM query UNION ALL
      SELECT query_id, 'most', most FROM ({EXTREME}) UNION ALL SELECT query_id, 'least', least FROM ({EXTREME}))
    WHERE length(phrase) > 0 GROUP BY 1, 2""", **DF))
def ret_variants(t):
    """RET-13: generated variants of each query."""
    return S.make_variants(V.chunk(t), V.query(t))


DIS = """SELECT query_id, kw_first, vec_first, coalesce(flips, 0) AS flips, kw_first IS DISTINCT FROM vec_first AS first_differs
    FROM query LEFT JOIN (SELECT query_id, min(CASE WHEN k.rank = 1 THEN id END) AS kw_first, min(CASE WHEN v.rank = 1 THEN id END) AS vec_first,
      count(*) FILTER ((k.rank IS NULL) <> (v.rank IS NULL)) AS flips FROM kw5 k FULL JOIN vec5 v USING (query_id, id) GROUP BY 1) USING (query_id)"""


@plan("ret_leg_disagreement", oracle("chunk query", DIS, **SHORT))
def ret_leg_disagreement(t):
    """RET-14: different first hits and ids in one leg only."""
    return S.leg_disagreement(keyword_list(t), vector_list(t), V.query(t))


@plan("ret_merge_inputs", oracle("chunk query", """
    SELECT query_id, id, k.rank AS kw_rank, v.rank AS vec_rank, (query_id, id) IN (SELECT query_id, id FROM expect) AS wanted
    FROM kw5 k FULL JOIN vec5 v USING (query_id, id)""", **SHORT, expect=EXPECTED))
def ret_merge_inputs(t):
    """RET-15: both ranked inputs side by side, wanted ids marked."""
    a = keyword_list(t).select("query_id", "id", F.col("rank").alias("kw_rank"))
    b = vector_list(t).select("query_id", "id", F.col("rank").alias("vec_rank"))
    both = durable(a.join(b, ["query_id", "id"], "full_outer"))
    return both.join(expected(t, both).withColumn("w", F.lit(True)), ["query_id", "id"], "left").select(
        "query_id", "id", "kw_rank", "vec_rank", F.coalesce("w", F.lit(False)).alias("wanted"))


@plan("top_wanted_rank", oracle("chunk query", """
    SELECT query_id, min(rank) FILTER ((query_id, id) IN (SELECT query_id, id FROM expect)) AS wanted_rank
    FROM query LEFT JOIN vec5 USING (query_id) GROUP BY 1""", **SHORT, expect=EXPECTED))
def top_wanted_rank(t):
    """TOP-8: rank of a wanted id; NULL when it is not listed."""
    found = durable(vector_list(t))
    return S.wanted_rank(found, expected(t, found), V.query(t))
