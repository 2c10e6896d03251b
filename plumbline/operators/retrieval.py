"""Keyword search with BM25, vector search, rank fusion, and the studies built on them.

Results are always ``(query_id, id, rank, ...)``. Ties are broken by id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.periods import PERIOD_TOKEN
from plumbline.operators.matching import grams, phrase_best, phrase_counts, phrase_tops
from plumbline.session import durable, spread

# Fixed values
K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
RRF = 60
MIN_QUERY = 3
WANTED_ROWS = 500_000  # so many wanted ids travel to the scores; more meet them by a shuffle
UNSAFE = r"[^\x{4e00}-\x{9fff}\p{L}\p{N}_]"


def sanitise(query: Column) -> Column:
    """Letters, digits, underscore and CJK only."""
    return F.regexp_replace(query, UNSAFE, "")


def searchable(query: Column) -> Column:
    """Long enough for a trigram index. False is not the same as "no hits"."""
    return F.length(sanitise(query)) >= MIN_QUERY


def postings(chunks: DataFrame, n: int = 3) -> DataFrame:
    """(gram, chunk_id, tf) of every indexed chunk, case folded. Counted per chunk before the shuffle."""
    unfolded = spread(chunks).select("chunk_id", F.explode(grams(F.lower("text"), n)).alias("gram"))
    return unfolded.groupBy("chunk_id", "gram").agg(F.count(F.lit(1)).alias("tf"))


def gram_statistics(chunks: DataFrame, n: int = 3) -> DataFrame:
    return postings(chunks, n).groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def corpus_size(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean length in trigrams."""
    return chunks.agg(
        F.count(F.lit(1)).alias("n_docs"), (F.sum(F.greatest(F.col("n_chars") - 2, F.lit(0))) / F.count(F.lit(1))).alias("avgdl")
    )


def bm25(tf: Column, df: Column, dl: Column, n_docs: Column, avgdl: Column) -> Column:
    return _idf(df, n_docs) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def _idf(df: Column, n_docs: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def phrase_scores(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase_id, id, period, bm25) of every chunk that contains the phrase.

    ``chunks(chunk_id, period, n_chars, text)``; ``phrases(phrase_id, phrase)``. Document frequencies are
    counted over the whole index, before any period filter.
    """
    texts = chunks.select(F.col("chunk_id").alias("text_id"), "text")
    tf = durable(phrase_counts(spread(texts), phrases))  # read twice below; the corpus is unfolded once
    return _scored(chunks, tf, tf.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("df")))


def _scored(chunks: DataFrame, tf: DataFrame, df: DataFrame) -> DataFrame:
    """BM25 of ``tf(text_id, phrase_id, tf)`` by the frequencies ``df(phrase_id, df)``."""
    facts = chunks.select(F.col("chunk_id").alias("text_id"), "period", _length().alias("dl"))
    size = F.broadcast(corpus_size(chunks))  # one row
    scored = tf.join(facts, "text_id").join(df, "phrase_id").join(size)
    return scored.select(
        "phrase_id",
        F.col("text_id").alias("id"),
        "period",
        bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n_docs"), F.col("avgdl")).alias("bm25"),
    )


def _length() -> Column:
    return F.greatest(F.col("n_chars") - 2, F.lit(0))


def top_scores(chunks: DataFrame, phrases: DataFrame, k: int) -> DataFrame:
    """Of :func:`phrase_scores` every row that may be among the first ``k`` of its phrase, by score and id.

    Within a phrase the order needs no document frequency, so every task that searches texts hands on its own first ``k`` and its counts. Ids that
    come in several rows, which a task cannot see, hand on all their hits.
    """
    texts = spread(chunks.select(F.col("chunk_id").alias("text_id"), "text", _length().cast("bigint").alias("dl")))
    mean = corpus_size(chunks).first()["avgdl"] or 1.0  # without a text, or a letter in one, there is nothing to order
    found = durable(phrase_tops(texts, phrases, k, K1, B, mean))
    df = found.filter("df is not null").groupBy("phrase_id").agg(F.sum("df").alias("df"))
    tf = found.filter("df is null").select("text_id", "phrase_id", "tf")
    again = durable(chunks.groupBy(F.col("chunk_id").alias("text_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and text_id is not null").select("text_id"))
    if again.limit(1).count():
        more = phrase_counts(texts.join(again, "text_id", "left_semi"), phrases).select("text_id", "phrase_id", "tf")
        tf = tf.join(again, "text_id", "left_anti").unionByName(more)
    return _scored(chunks, tf, df)


def best_first(scores: DataFrame, by: str, score: str, k: int | None) -> DataFrame:
    """Rank by score; with ``k`` every map task keeps only its own first ``k`` per group."""
    w = W.partitionBy(by).orderBy(F.desc(score), "id")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def search(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Phrase search: ``queries(query_id, phrase[, periods])``. An empty period list does not filter."""
    wanted = queries.filter(searchable(F.col("phrase")))
    scores = phrase_scores(chunks, wanted.select(F.col("query_id").alias("phrase_id"), "phrase"))
    scores = scores.withColumnRenamed("phrase_id", "query_id")
    if "periods" in queries.columns:
        asked = queries.select("query_id", "periods")
        scores = scores.join(asked, "query_id").filter(
            (F.size("periods") == 0) | F.array_contains("periods", F.col("period"))
        )
    return best_first(scores, "query_id", "bm25", k).select("query_id", "id", "rank", "bm25")


def split_terms(queries: DataFrame, text: str = "phrase") -> DataFrame:
    """(query_id, term_no, term): one row per searchable term."""
    words = queries.select("query_id", F.posexplode(F.split(F.trim(text), r"\s+")).alias("term_no", "term"))
    return words.filter(searchable(F.col("term"))).withColumn("term", F.lower(sanitise(F.col("term"))))


def term_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, bm25): the best term of the query for each chunk it reaches (terms are alternatives).

    One pass counts which terms the chunks hold, a second one scores each chunk where its text lies. Ids that come in several rows, which a task cannot see, meet by id.
    """
    terms = split_terms(queries)
    wanted = durable(terms.select("query_id", F.col("term").alias("phrase_id")).distinct())
    distinct = wanted.select("phrase_id", F.col("phrase_id").alias("phrase")).distinct()
    texts = spread(chunks.select(F.col("chunk_id").alias("text_id"), "text", _length().cast("bigint").alias("dl")))
    size = corpus_size(chunks)
    mean = size.first()["avgdl"] or 1.0
    df = durable(phrase_tops(texts, distinct, 1, K1, B, mean).filter("df is not null").groupBy("phrase_id").agg(F.sum("df").alias("df")))
    weighed = df.join(F.broadcast(size)).select("phrase_id", _idf(F.col("df"), F.col("n_docs")).alias("weight"))
    asked = wanted.join(weighed, "phrase_id").groupBy(F.col("phrase_id").alias("phrase"), "weight").agg(F.collect_list(F.struct("query_id")).alias("queries"))
    again = durable(chunks.groupBy(F.col("chunk_id").alias("text_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and text_id is not null").select("text_id"))
    if not again.limit(1).count():
        return phrase_best(texts, asked, K1, B, mean)
    tf = phrase_counts(texts.join(again, "text_id", "left_semi").select("text_id", "text"), distinct)
    several = _scored(chunks, tf, df).join(wanted, "phrase_id").groupBy("query_id", "id").agg(F.max("bm25").alias("bm25"))
    return phrase_best(texts.join(again, "text_id", "left_anti"), asked, K1, B, mean).unionByName(several)


def search_terms(chunks: DataFrame, queries: DataFrame, k: int = 5, mode: str = "best") -> DataFrame:
    """Search each term alone, then the best score per chunk among the first ``k`` of each term (or the sum over all terms), then ``k``."""
    terms = split_terms(queries)
    distinct = terms.select(F.col("term").alias("phrase_id"), F.col("term").alias("phrase")).distinct()
    # a sum needs every term's whole list
    per_term = best_first(top_scores(chunks, distinct, k), "phrase_id", "bm25", k).drop("rank") if mode == "best" else phrase_scores(chunks, distinct)
    wanted = terms.select("query_id", F.col("term").alias("phrase_id")).distinct()
    merged = per_term.join(wanted, "phrase_id").groupBy("query_id", "id").agg(
        (F.max if mode == "best" else F.sum)("bm25").alias("bm25")
    )
    return best_first(merged, "query_id", "bm25", k).select("query_id", "id", "rank", "bm25")


def _packed(rows: DataFrame, key: str, part: str, extra: list[str], per_part: int, least: int = 1) -> tuple[DataFrame, int]:
    """One row per part of about ``per_part`` rows, dealt by hash: ids, the vectors as one run of doubles, and the extra columns as arrays."""
    parts = max(least, math.ceil(rows.count() / per_part))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{part} int", f"{key}s array<bigint>", f"{part}_vectors binary", *[f"{c} array<{kinds[c]}>" for c in extra]])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.vstack(pdf["embedding"].to_list()).astype(np.float64)
        return pd.DataFrame({part: pdf[part][:1], f"{key}s": [pdf[key].to_list()], f"{part}_vectors": [v.tobytes()], **{c: [pdf[c].astype(object).where(pdf[c].notna(), None).to_list()] for c in extra}})

    dealt = rows.select(F.col(key).cast("bigint").alias(key), "embedding", *extra, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias(part))
    return dealt.groupBy(part).applyInPandas(pack, schema), parts


def _meetings(queries: DataFrame, corpus: DataFrame, block_rows: int, shard_rows: int) -> DataFrame:
    """A row for every block of queries with every shard of the corpus; nothing passes through the driver."""
    blocks, _ = _packed(queries, "query_id", "block", [c for c in ("only", "asked") if c in queries.columns], block_rows)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    shards, n = _packed(corpus, "id", "shard", [c for c in ("grp",) if c in corpus.columns], shard_rows, cores)
    return blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition("shard", "block").join(shards, "shard")


def _vectors(row, part: str, ids) -> np.ndarray:
    return np.frombuffer(row[f"{part}_vectors"], np.float64).reshape(len(ids), -1)


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, block_rows: int = 1024, shard_rows: int = 16384) -> DataFrame:
    """Exact cosine top-k of unit vectors: (query_id, id, rank, cosine).

    ``queries(query_id, embedding[, only])``; ``corpus(id, embedding[, grp])``. Each block of queries is multiplied
    with each shard of the corpus and keeps its best ``k`` per query, so k rows per query and shard go on,
    never all pairs. ``only`` restricts a query to one ``grp`` before the cut.
    """

    def score(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                ids, cid = np.asarray(row["query_ids"]), np.asarray(row["ids"])
                s = np.round(_vectors(row, "block", ids) @ _vectors(row, "shard", cid).T, 6)
                if "grp" in row and "only" in row:
                    g = np.asarray(row["grp"])
                    for i, want in enumerate(row["only"]):
                        if want is not None:
                            s[i, g != want] = -np.inf
                order = np.lexsort((np.broadcast_to(cid, s.shape), -s), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(ids)), order.shape[1])
                cols = order.ravel()
                keep = np.isfinite(s[rows, cols])
                yield pd.DataFrame({"query_id": ids[rows][keep], "id": cid[cols][keep], "cosine": s[rows, cols][keep]})

    found = _meetings(queries, corpus, block_rows, shard_rows).mapInPandas(score, "query_id bigint, id bigint, cosine double")
    return best_first(found, "query_id", "cosine", k).select("query_id", "id", "rank", "cosine")


def vector_ranks(queries: DataFrame, corpus: DataFrame, wanted: DataFrame, block_rows: int = 1024, shard_rows: int = 16384) -> DataFrame:
    """Exact ranks of chosen ids in the full cosine order: (query_id, id, rank), however deep they lie.

    ``wanted(query_id, id, cosine)`` is a short list per query. Every shard counts how many of its rows
    fall before each wanted entry; only these counts are shuffled.
    """
    entry = F.struct((-F.col("cosine")).alias("minus"), F.col("id").cast("bigint").alias("id"))
    lists = wanted.groupBy("query_id").agg(F.struct(F.array_sort(F.collect_list(entry)).alias("list")).alias("asked"))

    def count(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                ids, cid = np.asarray(row["query_ids"]), np.asarray(row["ids"])
                s = -np.round(_vectors(row, "block", ids) @ _vectors(row, "shard", cid).T, 6)
                rows = []
                for i, qid in enumerate(ids):
                    asked = [(x["minus"], x["id"]) for x in row["asked"][i]["list"]]
                    edges = np.array([x[0] for x in asked])
                    slot = np.searchsorted(edges, s[i], "left")
                    # rows level with a wanted entry go by id
                    for j in np.flatnonzero(slot != np.searchsorted(edges, s[i], "right")):
                        slot[j] = sum(1 for x in asked if x <= (s[i, j], cid[j]))
                    ahead = np.cumsum(np.bincount(slot, minlength=len(asked) + 1))
                    rows.extend((qid, x[1], int(ahead[j])) for j, x in enumerate(asked))
                yield pd.DataFrame(rows, columns=["query_id", "id", "n"])

    out = _meetings(queries.join(lists, "query_id"), corpus, block_rows, shard_rows).mapInPandas(count, "query_id bigint, id bigint, n bigint")
    return out.groupBy("query_id", "id").agg((F.sum("n") + 1).alias("rank"))


def score_ranks(scores: DataFrame, wanted: DataFrame, score: str) -> DataFrame:
    """Exact ranks of chosen ids in a scored list of any length: (query_id, id, rank).

    Every scored row is put into one slot between the wanted entries of its query; the slots are
    counted on the map side and summed along the short list.
    """
    short = (lambda df: F.broadcast(df)) if wanted.count() <= WANTED_ROWS else (lambda df: df)  # noqa: E731  else the scores would be dealt out for it
    known = scores.select("query_id", "id", score).join(short(wanted.select("query_id", "id")), ["query_id", "id"])
    entry = F.struct((-F.col(score)).alias("s"), F.col("id").alias("id"))
    lists = durable(known.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("c")))  # read twice
    slot = F.expr(f"size(filter(c, x -> x.s < -{score} or (x.s = -{score} and x.id <= id)))")
    slots = scores.join(short(lists), "query_id").groupBy("query_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    along = W.partitionBy("query_id").orderBy("slot")
    sums = slots.select("query_id", "slot", F.sum("n").over(along).alias("upto"))
    places = lists.select("query_id", F.posexplode("c").alias("j", "x")).select("query_id", "j", F.col("x.id").alias("id"))
    # rows before entry j are those in slots up to j
    ahead = places.join(sums, (places.query_id == sums.query_id) & (sums.slot <= places.j), "left").groupBy(
        places.query_id, places.id).agg((F.coalesce(F.max("upto"), F.lit(0)) + 1).alias("rank"))
    return ahead.select("query_id", "id", "rank")


def fuse(keyword: DataFrame, vector: DataFrame, k: int = 5, w_kw: float = 1.0, w_vec: float = 1.0, cut: int = 0) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists; weight 0 drops a leg, cut 0 keeps all ranks."""
    legs = []
    for leg, weight, name in ((keyword, w_kw, "kw_rank"), (vector, w_vec, "vec_rank")):
        if weight:
            rows = leg if not cut else leg.filter(F.col("rank") <= cut)
            other = "vec_rank" if name == "kw_rank" else "kw_rank"
            legs.append(rows.select("query_id", "id", (F.lit(float(weight)) / (RRF + F.col("rank"))).alias("part"),
                                    F.col("rank").cast("bigint").alias(name), F.lit(None).cast("bigint").alias(other)))
    if not legs:
        raise ValueError("both legs are switched off")
    both = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
    sums = both.groupBy("query_id", "id").agg(
        F.sum("part").alias("fused"), F.min("kw_rank").alias("kw_rank"), F.min("vec_rank").alias("vec_rank")
    )
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("fused", 12)), F.asc_nulls_last("kw_rank"), F.asc_nulls_last("vec_rank"), "id")
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "id", "rank", "fused", "kw_rank", "vec_rank"
    )


def depth_for(k: int, w_kw: float, w_vec: float) -> int:
    """How far both legs must be read so that nothing deeper in both can enter the fused top ``k``.

    The vector leg ranks everything, so its first k score at least ``w_vec / (60 + k)``; an id beyond depth
    M in both legs scores at most ``(w_kw + w_vec) / (61 + M)``.
    """
    return max(k, math.ceil((RRF + k) * (w_kw + w_vec) / w_vec) - RRF)


def hybrid_search(
    chunks: DataFrame, queries: DataFrame, vectors: DataFrame, corpus: DataFrame, k: int = 5, w_kw: float = 1.0, w_vec: float = 1.0
) -> DataFrame:
    """Fusion over both *whole* rankings without materialising them.

    1. Read each leg to the proven depth; the union of the two short lists is the only possible top ``k``.
    2. Find the exact rank that each candidate holds in the other leg by counting what lies before it.
    3. Fuse, attach the chunk, and mark ids the chunk table does not hold.
    """
    depth = depth_for(k, w_kw, w_vec)
    kw_all = durable(term_scores(chunks, queries))  # read four times below, searched once
    kw_top = best_first(kw_all, "query_id", "bm25", depth).select("query_id", "id")
    vec_top = vector_top_k(vectors, corpus, depth).select("query_id", "id")
    candidates = durable(kw_top.unionByName(vec_top).distinct())

    kw_rank = score_ranks(kw_all, candidates, "bm25")
    pairs = candidates.join(vectors.select("query_id", F.col("embedding").alias("qv")), "query_id").join(
        corpus.select("id", "embedding"), "id")
    dot = F.aggregate(
        F.zip_with("qv", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    vec_known = pairs.select("query_id", "id", F.round(dot, 6).alias("cosine"))
    vec_rank = vector_ranks(vectors, corpus, vec_known)

    fused = fuse(kw_rank, vec_rank, k, w_kw, w_vec)
    found = fused.join(chunks.select(F.col("chunk_id").alias("id"), "period", "n_chars"), "id", "left")
    return found.withColumn("ghost", F.col("period").isNull())


def shortfall(results: DataFrame, keyword: DataFrame, k: int = 5) -> DataFrame:
    """Queries for which fusion returns fewer ids than keyword search alone would."""
    kw = keyword.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count(F.lit(1)).alias("baseline"))
    got = results.filter(~F.col("ghost")).groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"))
    return kw.join(got, "query_id", "left").select(
        "query_id", "baseline", F.coalesce("returned", F.lit(0)).alias("returned"),
        (F.coalesce("returned", F.lit(0)) < F.col("baseline")).alias("short"),
    )


def drop_periods(terms: Column) -> Column:
    """Terms without quarter tokens, unless nothing would remain."""
    kept = F.filter(terms, lambda t: ~t.rlike(f"^{PERIOD_TOKEN}$"))
    return F.when(F.size(kept) > 0, kept).otherwise(terms)


def attempts(chunks: DataFrame, queries: DataFrame, rounds: int = 3) -> DataFrame:
    """(query_id, attempt, phrase): what a query says, then without its rarest word, its two rarest, ...; at last half of its commonest word.

    Words are rare by the number of chunks that hold them; of equally rare ones the later goes first. An attempt that repeats an earlier one is not made.
    """
    words = queries.select("query_id", F.posexplode(F.split(F.trim("phrase"), r"\s+")).alias("word_no", "word")).filter("word <> ''")
    df = document_frequency(chunks, words.select(F.lower("word").alias("term")))
    known = words.withColumn("term", F.lower("word")).join(df, "term")
    listed = known.groupBy("query_id").agg(  # the words of one query
        F.array_sort(F.collect_list(F.struct("df", (-F.col("word_no")).alias("back"), "word"))).alias("rare"),
        F.min(F.struct((-F.col("df")).alias("d"), "word_no", "word"))["word"].alias("common"))
    rest = lambda r: F.array_join(F.transform(F.array_sort(F.transform(F.slice("rare", F.lit(r + 1), F.size("rare")), lambda x: F.struct((-x["back"]).alias("no"), x["word"].alias("word")))), lambda x: x["word"]), " ")
    half = F.when(F.length("common") > MIN_QUERY, F.expr(f"left(common, cast(greatest({MIN_QUERY}, ceil(length(common) / 2)) as int))"))
    said = F.array(*[F.when(F.size("rare") > r, F.struct(F.lit(r).alias("attempt"), rest(r).alias("phrase"))) for r in range(rounds + 1)],
                   F.when(half.isNotNull(), F.struct(F.lit(rounds + 1).alias("attempt"), half.alias("phrase"))))
    every = listed.select("query_id", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x")).select("query_id", "x.attempt", "x.phrase")
    return every.groupBy("query_id", "phrase").agg(F.min("attempt").alias("attempt"))


def back_off(chunks: DataFrame, queries: DataFrame, rounds: int = 3, k: int = 5) -> DataFrame:
    """Zero-hit fallback: the first of a query's :func:`attempts` that hits, with its hits; a query that never hits keeps one row.

    All attempts of all queries are searched in one pass over the corpus; ``attempt`` says which one answered. status: ok, backed_off, no_match.
    """
    tries = attempts(chunks, queries, rounds).filter(searchable(F.col("phrase")))
    keys = durable(tries.select(F.concat_ws("|", "query_id", "attempt").alias("phrase_id"), "phrase", "query_id", "attempt"))
    scores = phrase_scores(chunks, keys.select("phrase_id", "phrase")).join(keys, "phrase_id")
    first = scores.groupBy("query_id").agg(F.min("attempt").alias("attempt"))
    ranked = best_first(scores.join(first, ["query_id", "attempt"]), "query_id", "bm25", k).select("query_id", "attempt", "phrase", "id", "rank", "bm25")
    status = F.when(F.col("id").isNull(), "no_match").when(F.col("attempt") == 0, "ok").otherwise("backed_off")
    return queries.select("query_id").join(ranked, "query_id", "left").withColumn("status", status)


def query_status(queries: DataFrame, results: DataFrame) -> DataFrame:
    """ok / no_match / unsupported for every query, and how many slots were filled."""
    n = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.join(n, "query_id", "left").select(
        "query_id",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(~searchable(F.col("phrase")), "unsupported").when(F.col("n") > 0, "ok").otherwise("no_match").alias("status"),
    )


def document_frequency(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) for every term, 0 included. ``terms(term)``."""
    wanted = terms.select("term").distinct()
    texts = chunks.select(F.col("chunk_id").alias("text_id"), "text")
    hits = phrase_counts(spread(texts), wanted.select(F.col("term").alias("phrase_id"), F.col("term").alias("phrase")))
    df = hits.groupBy(F.col("phrase_id").alias("term")).agg(F.count(F.lit(1)).alias("df"))
    return wanted.join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def distinctive_terms(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Rarest and commonest term of each query; ties go to the earlier term."""
    terms = split_terms(queries)
    df = document_frequency(chunks, terms)
    both = terms.join(df, "term")
    return both.groupBy("query_id").agg(
        F.min(F.struct("df", "term_no", "term"))["term"].alias("most"),
        F.min(F.struct((-F.col("df")).alias("d"), "term_no", "term"))["term"].alias("least"),
    )


def make_variants(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Metamorphic variants of each query: period stripped, only the most or the least distinctive term.

    A variant whose wording equals another's of the same query is made once.
    """
    stripped = queries.select(
        "query_id", F.lit("stripped").alias("variant"), F.trim(F.regexp_replace("phrase", PERIOD_TOKEN, "")).alias("phrase"))
    words = distinctive_terms(chunks, queries)
    rest = words.select("query_id", F.expr("stack(2, 'most', most, 'least', least) as (variant, phrase)"))
    every = stripped.unionByName(rest).filter(F.length("phrase") > 0)
    return every.groupBy("query_id", "phrase").agg(F.max("variant").alias("variant"))


def wanted_rank(results: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """Best rank of an expected id per query; NULL when it is not in the list at all."""
    best = results.join(expected, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("wanted_rank"))
    return queries.select("query_id").join(best, "query_id", "left")


def leg_disagreement(keyword: DataFrame, vector: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """First hit of each leg, whether they differ, and how many ids are in the top ``k`` of exactly one leg."""
    a = keyword.filter(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("a"))
    b = vector.filter(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias("b"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    per = both.groupBy("query_id").agg(
        F.min(F.when(F.col("a") == 1, F.col("id"))).alias("kw_first"),
        F.min(F.when(F.col("b") == 1, F.col("id"))).alias("vec_first"),
        F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("flips"),
    )
    return queries.select("query_id").join(per, "query_id", "left").select(
        "query_id", "kw_first", "vec_first", F.coalesce("flips", F.lit(0)).alias("flips"),
        (~F.col("kw_first").eqNullSafe(F.col("vec_first"))).alias("first_differs"),
    )


def sweep(keyword: DataFrame, vector: DataFrame, expected: DataFrame, combos: list[tuple[float, float, int]], k: int = 5, askable: DataFrame | None = None) -> DataFrame:
    """Hits per weight/cut combination; queries that no combination answers are set aside.

    The ranked lists are computed once by the caller; each combination only re-weights them. ``askable(query_id)`` are the queries that have an
    answer, where ``expected`` holds only the listed ones.
    """
    found = None
    for w_kw, w_vec, cut in combos:
        top = fuse(keyword, vector, k, w_kw, w_vec, cut).join(expected, ["query_id", "id"], "left_semi")
        part = top.select("query_id").distinct().withColumn("combo", F.lit(f"{w_kw:g}:{w_vec:g}/{cut}"))
        found = part if found is None else found.unionByName(part)
    askable = expected.select("query_id").distinct() if askable is None else askable
    reachable = found.select("query_id").distinct()
    totals = askable.agg(F.count(F.lit(1)).alias("queries")).join(F.broadcast(reachable.agg(F.count(F.lit(1)).alias("reachable"))))
    names = keyword.sparkSession.createDataFrame([(f"{a:g}:{b:g}/{c}",) for a, b, c in combos], "combo string")
    hits = names.join(found.groupBy("combo").agg(F.count(F.lit(1)).alias("hits")), "combo", "left")
    return hits.join(F.broadcast(totals)).select(  # one row
        "combo", F.coalesce("hits", F.lit(0)).alias("hits"), "queries", "reachable",
        (F.coalesce("hits", F.lit(0)) / F.col("reachable")).alias("rate_of_reachable"),
    )


def outcome_matrix(results: DataFrame, expected: DataFrame, queries: DataFrame, strategies: list[str], k: int = 5) -> DataFrame:
    """Per query and strategy: hit / beyond (found deeper than k) / absent / empty, and the worst cell.

    results(strategy, query_id, id, rank)
    """
    marked = results.join(expected.withColumn("_w", F.lit(True)), ["query_id", "id"], "left")
    per = marked.groupBy("query_id", "strategy").agg(
        F.min(F.when(F.col("_w"), F.col("rank"))).alias("r")
    ).withColumn("cell", F.when(F.col("r") <= k, 3).when(F.col("r").isNotNull(), 2).otherwise(1))
    wide = queries.select("query_id").join(per.groupBy("query_id").pivot("strategy", strategies).agg(F.first("cell")), "query_id", "left")
    name = {0: "empty", 1: "absent", 2: "beyond", 3: "hit"}
    label = F.create_map(*[F.lit(x) for kv in name.items() for x in kv])
    cells = [F.coalesce(F.col(f"`{s}`"), F.lit(0)) for s in strategies]
    worst = F.least(*cells) if len(cells) > 1 else cells[0]
    return wide.select("query_id", *[label[c].alias(s) for c, s in zip(cells, strategies)], label[worst].alias("worst"))
