"""Substring dedup by recompression.

A text is a string of words. Rounds rename it: first runs of two equal symbols, then pairs whose left symbol is of one kind and whose right
symbol is of the other (a bit of the name), up to ``LONGEST`` words. A new name is a hash of the names it stands for, so every task
gives the same stretch the same name and the naming is global without a dictionary. A round looks one symbol to either side; so
equal stretches get equal symbols but for a margin that the rounds bound: ``MARGIN`` words. Each window of ``WIDTH`` words thus holds
whole symbols that all its copies share. The rarest-looking of them (least hash of the name) is the window's anchor, and windows
meet by it (see repeats). Matches are verified on the windows themselves.

Removed is each word in a window that also starts in a row with a smaller key.

Defined results: null and empty texts have no words; a row without a key is left as it is and makes no other lose words; rows with one key are one
document and lose nothing to each other; an empty table has no rows. Input columns besides key and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE_SEPARATED, arrow_batches, durable, mix, normalised, only, pieces, stored, utf8, words
from plumbline.llm.repeats import contexts, covered, windows_of

WIDTH = 50
LONGEST = 4
PAIR_ROUNDS = 2
# Words at either end of a window whose symbols may depend on what lies outside: a run of two, then a symbol per pair round.
MARGIN = 2 + 2 + LONGEST
KEY_WORDS = 20
RECENT = 50_000


def _units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, h, first = words(data, off, SPACE_SEPARATED)
    return h, first


def symbols(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the symbols after all rounds; no symbol crosses texts."""
    name, start = h, np.arange(len(h))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def merge(left: np.ndarray, round_: int) -> None:
        nonlocal name, start, doc
        i = np.flatnonzero(left)
        name = name.copy()
        name[i] = mix(name[i] * np.uint64(0xC2B2AE3D27D4EB4F) + name[i + 1] + np.uint64(round_))
        keep = np.ones(len(name), bool)
        keep[i + 1] = False
        name, start, doc = name[keep], start[keep], doc[keep]

    def beside() -> np.ndarray:
        return doc[1:] == doc[:-1]

    if len(name) < 2:
        return name, start
    same = (name[1:] == name[:-1]) & beside()
    alone = same.copy()  # a run of exactly two
    alone[1:] &= ~same[:-1]
    alone[:-1] &= ~same[1:]
    merge(np.r_[alone, False], 0)
    for r in range(1, PAIR_ROUNDS + 1):
        if len(name) < 2:
            break
        left = (mix(name + np.uint64(r * 7919)) >> np.uint64(40) & np.uint64(1)).astype(bool)
        length = np.diff(np.r_[start, len(h)])
        merge(np.r_[left[:-1] & ~left[1:] & beside() & (length[:-1] + length[1:] <= LONGEST), False], r)
    return name, start


def text_contexts(h: np.ndarray, first: np.ndarray, width: int):
    name, start = symbols(h, first)
    rank = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    rank[start] = mix(name) >> np.uint64(1)
    # A symbol that starts in the span also ends before the right margin, and LONGEST < span, so there is one in every window.
    span = width - 2 * MARGIN - LONGEST + 1
    return contexts(h, first, rank, width, MARGIN, span, -MARGIN, KEY_WORDS)


def _read(key_type: pa.DataType, width: int):
    """Rows of two kinds: one per document (n_words, sha256 of all words), and one per context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, int] = {}
        for whole in batches:
            for batch in pieces(whole, "text"):
                col = lambda c: batch.column(batch.schema.get_field_index(c))
                data, off, _ = utf8(col("text"))
                begin, end, h, first = words(data, off, SPACE_SEPARATED)
                n = np.diff(first)
                out, to = normalised(data, begin, end)
                sha = [hashlib.sha256(out[to[a]: max(to[a], to[b] - 1)]).hexdigest() for a, b in zip(first[:-1], first[1:])]
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_pydict({"key": col("key"), "text_id": col("text_id"), "n": pa.array(n), "sha": pa.array(sha),
                                                  "anchor": none, "content": none, "start": pa.nulls(len(n), pa.int32()), "count": pa.nulls(len(n), pa.int32())})
                keys, texts = col("key").to_pylist(), col("text_id").to_pylist()
                use = np.zeros(len(n), bool)
                for i, (k, t) in enumerate(zip(keys, texts)):  # of copies in this task, the smallest key so far speaks
                    if k is not None and n[i] >= width and not recent.get(t, k + 1) <= k:
                        use[i] = True
                        recent[t] = k
                while len(recent) > RECENT:
                    recent.pop(next(iter(recent)))
                h = h[np.repeat(use, n)]
                c = text_contexts(h, np.r_[0, np.cumsum(np.where(use, n, 0))], width)
                rows = pa.array(c.doc)
                yield pa.RecordBatch.from_pydict({
                    "key": col("key").take(rows), "text_id": col("text_id").take(rows), "n": pa.nulls(len(rows), pa.int64()), "sha": pa.nulls(len(rows), pa.string()),
                    "anchor": pa.array(c.key.view(np.int64)), "content": pa.array(c.content.view(np.int64)), "start": pa.array(c.start.astype(np.int32)), "count": pa.array(c.count.astype(np.int32))})

    return run


def _rewrite(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                col = lambda c: batch.column(batch.schema.get_field_index(c))
                data, off, _ = utf8(col("text"))
                begin, end, _, first = words(data, off, SPACE_SEPARATED)
                removed, sha = [], []
                for i, spans in enumerate(col("spans").to_pylist()):
                    a, b = first[i], first[i + 1]
                    gone = covered(b - a, spans, width)
                    out, _ = normalised(data, begin[a:b][~gone], end[a:b][~gone])
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(out[:-1]).hexdigest())
                yield pa.RecordBatch.from_pydict({"key": col("key"), "text_id": col("text_id"), "n_removed": pa.array(removed, pa.int64()), "sha": pa.array(sha, pa.string())})

    return run


def removal_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with key, text, text_id; a row per document with n and sha; spans per (key, text_id) as array of start, count in windows)."""
    spark = documents.sparkSession
    arrow_batches(spark)
    docs = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_id"))
    read = stored(docs.mapInArrow(_read(pa.int64(), width), "key long, text_id long, n long, sha string, anchor long, content long, start int, count int"))
    per_doc = read.filter("n is not null").select("key", "text_id", "n", "sha")
    found = read.filter("n is null").drop("n", "sha")
    # One row per context with its smallest key; contexts that share an anchor with others are looked at window by window.
    each = found.groupBy("anchor", "content").agg(F.min(F.struct("key", "text_id", "start", "count")).alias("at"), F.max("key").alias("last"))
    each = stored(each)
    open_ = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("at.key").alias("low"), F.max("at.key").alias("high")).filter("n > 1 and low < high")
    asked = (each.join(open_.select("anchor"), "anchor")
             .groupBy(F.col("at.key").alias("key"), F.col("at.text_id").alias("text_id"))
             .agg(F.collect_list(F.struct(F.col("anchor").alias("key"), "content", F.col("at.start").alias("start"), F.col("at.count").alias("count"))).alias("asked")))
    asked = durable(asked)
    texts = only(docs, asked.select("key", "text_id"), ["key", "text_id"]).join(asked, ["key", "text_id"]).select(F.col("key").alias("doc"), "text", "asked")
    seen = stored(texts.mapInArrow(windows_of(_units, "text", width, ["doc"]), "key long, content long, place int, window long, doc long"))
    least = seen.groupBy("key", "window").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").drop("high")
    later = (seen.join(least, ["key", "window"]).filter("doc > low").select(F.col("key").alias("anchor"), "content", "place").distinct()
             .groupBy("anchor", "content").agg(F.array_sort(F.collect_list("place")).alias("places")))
    # Back to the documents: a later occurrence of a context loses all of it, the first one loses the windows found above. The marks are
    # stored, so that what follows is one plain join and Spark can split the contexts of a common passage.
    marks = stored(each.filter("last > at.key").select("anchor", "content", F.col("at.key").alias("low"), F.lit(None).cast("array<int>").alias("places"))
                   .unionByName(later.select("anchor", "content", F.lit(None).cast("long").alias("low"), "places")))
    hits = found.join(marks, ["anchor", "content"]).filter(F.col("places").isNotNull() | (F.col("key") > F.col("low")))
    whole = F.array(F.struct(F.col("start"), F.col("count")))
    some = F.transform("places", lambda p: F.struct((F.col("start") + p).alias("start"), F.lit(1).alias("count")))
    spans = (hits.select("key", "text_id", F.explode(F.when(F.col("places").isNull(), whole).otherwise(some)).alias("x"))
             .groupBy("key", "text_id").agg(F.collect_list("x").alias("spans")))
    return docs, per_doc, spans


def dedup_substrings(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) of every row."""
    docs, per_doc, spans = removal_spans(documents, key, text, width)
    # A copy of a text with a smaller key loses all words if it has a window at all; the rest is rewritten by its spans.
    first = per_doc.filter("key is not null").groupBy("text_id").agg(F.min("key").alias("first"))
    per_doc = per_doc.join(first, "text_id", "left")
    copy = (F.col("key") > F.col("first")) & (F.col("n") >= width)
    spans = durable(spans.join(first, "text_id").filter("key = first").drop("first"))
    some = only(docs, spans.select("key", "text_id"), ["key", "text_id"]).join(spans, ["key", "text_id"]).select("key", "text_id", "text", "spans")
    new = some.mapInArrow(_rewrite(width), "key long, text_id long, n_removed long, sha string").dropDuplicates(["key", "text_id"])
    new = new.withColumnRenamed("sha", "new_sha")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return (per_doc.join(new, ["key", "text_id"], "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_words"),
                    F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
                    F.when(copy, nothing).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), m AS MATERIALIZED (
  SELECT s, min(doc_id) AS low FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1
), r AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM g JOIN m USING (s) WHERE doc_id > low
), a AS (
  SELECT doc_id, list(p) AS gone, count(*) AS n FROM r GROUP BY doc_id
), k AS (
  SELECT x.doc_id, string_agg(x.v, ' ' ORDER BY x.p) AS kept
  FROM (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d) x LEFT JOIN r ON r.doc_id = x.doc_id AND r.p = x.p
  WHERE r.p IS NULL GROUP BY x.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(a.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)
"""
