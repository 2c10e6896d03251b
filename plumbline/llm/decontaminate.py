"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is the words of a text, lower-cased in A-Z. Test strings are all windows of ``width`` consecutive words of an item (an item with
fewer words is one shorter string). Strings of one length share a machine: a shift table over blocks of two words says how far
the search may jump, the hash of the last words selects a bucket of strings where the shift is zero, and a direct comparison of all
words, then of their bytes, confirms an occurrence. Texts are cut into lanes that overlap by a string, and all lanes of a piece jump at once.

The items travel to the tasks in blocks of at most about ``BLOCK_BYTES``; each block is one more pass over the documents, so neither
driver nor task ever holds more than one block's strings at a time of its own.

Defined results: a null or empty text has no words and no hits; an item without words is no string; items that share an id are one item; an item
without an id is named "null"; repeated rows are judged one by one; no items means no hits. Input columns stay; ``n_words``,
``n_hit``, ``items`` and ``spans`` replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import ALPHANUMERIC, FOLD, arrow_batches, durable, mix, normalised, pieces, utf8, words

WIDTH = 10
BLOCK_BYTES = 4_000_000
BUCKET_WORDS = 4
LANE = 64
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
                      T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])))])


def _block(h: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that end at ``end``."""
    out = np.zeros(len(end), np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[end - (n - 1 - j)]
    return mix(out)


class Machine:
    """Shift table and suffix buckets for strings of one length; a string is a place in the items' word list."""

    def __init__(self, h: np.ndarray, starts: np.ndarray, width: int):
        self.width, self.block = width, min(2, width)
        bits = min(24, max(12, int(math.log2(max(1, len(starts) * 8))) + 1))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, width - self.block + 1, np.uint8 if width < 256 else np.int32)
        for end in range(self.block - 1, width):  # the largest shift first, so that the smallest stays
            at = _block(h, starts + end, self.block) & self.mask
            np.minimum.at(self.shift, at, np.array(width - 1 - end, self.shift.dtype))
        key = _block(h, starts + width - 1, min(BUCKET_WORDS, width))
        order = np.argsort(key, kind="stable")
        self.key, self.start = key[order], starts[order]

    def search(self, h: np.ndarray, first: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of occurrences in ``h`` and the places of their strings; ``first`` has where each text begins."""
        ends = np.diff(first) - self.width + 1
        lanes = np.maximum(0, -(-ends // LANE))
        which = np.repeat(np.arange(len(ends)), lanes)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[which] + self.width - 1 + turn * LANE
        stop = np.minimum(at + LANE, first[which + 1])
        zero = []
        while len(at):
            jump = self.shift[_block(h, at, self.block) & self.mask].astype(np.int64)
            zero.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        end = np.concatenate(zero) if zero else np.zeros(0, np.int64)
        key = _block(h, end, min(BUCKET_WORDS, self.width))
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = high - low
        pick = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        end, start = np.repeat(end, n), self.start[pick]
        for j in range(self.width):
            same = h[end - self.width + 1 + j] == items[start + j]
            end, start = end[same], start[same]
        return end, start


class Items:
    """One block of items with a machine per string length."""

    def __init__(self, ids: list[str], texts: list[str], width: int):
        data, off, _ = utf8(pa.array(texts, pa.large_string()))
        begin, stop, self.h, first = words(data, off, ALPHANUMERIC, FOLD)
        self.text, self.place = normalised(FOLD[data], begin, stop)
        self.ids = ids
        self.item = np.repeat(np.arange(len(ids)), np.diff(first))
        self.machines = []
        n = np.diff(first)
        for k in [*np.unique(n[(n > 0) & (n < width)]), width]:
            at = first[:-1][n == k] if k < width else np.concatenate([np.arange(a, a + c - width + 1) for a, c in zip(first[:-1], n) if c >= width] or [np.zeros(0, np.int64)])
            if len(at):
                self.machines.append(Machine(self.h, at.astype(np.int64), int(k)))

    def find(self, data: np.ndarray, off: np.ndarray):
        """Words per text, and for texts with occurrences their hit words and item ids."""
        begin, stop, h, first = words(data, off, ALPHANUMERIC, FOLD)
        cover, said = np.zeros(len(h) + 1, np.int32), {}
        text = None
        for m in self.machines:
            end, start = m.search(h, first, self.h)
            if len(end) and text is None:
                text, place = normalised(FOLD[data], begin, stop)
            for e, s in zip(end.tolist(), start.tolist()):
                b = e - m.width + 1
                if text[place[b]: place[e + 1]].tobytes() == self.text[self.place[s]: self.place[s + m.width]].tobytes():
                    cover[b] += 1
                    cover[e + 1] -= 1
                    said.setdefault(int(np.searchsorted(first, b, "right")) - 1, set()).add(self.ids[self.item[s]])
        hit = np.cumsum(cover[:-1]) > 0
        return np.diff(first), {i: (hit[first[i]: first[i + 1]], ids) for i, ids in said.items()}


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


def _search_with(sent, text: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        for whole in batches:
            for batch in pieces(whole, text):
                data, off, _ = utf8(batch.column(batch.schema.get_field_index(text)))
                n, found = items.find(data, off)
                earlier = {}
                if "spans" in batch.schema.names:  # what earlier blocks have found
                    known, ids = batch.column(batch.schema.get_field_index("spans")), batch.column(batch.schema.get_field_index("items"))
                    earlier = {i: (known[i].as_py(), ids[i].as_py()) for i in np.flatnonzero(np.asarray(known.value_lengths().fill_null(0)))}
                hits = np.zeros(len(n), np.int64)
                said, spans = [[] for _ in n], [[] for _ in n]
                for i in found.keys() | earlier.keys():
                    hit, names = found.get(i, (np.zeros(n[i], bool), set()))
                    before, ids = earlier.get(i, ((), ()))
                    hit = hit.copy()
                    for x in before:
                        hit[x["first"]: x["last"] + 1] = True
                    hits[i], said[i], spans[i] = hit.sum(), sorted({*names, *ids}), _spans(hit)
                new = {"n_words": n, "n_hit": hits, "items": said, "spans": spans}
                yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else batch.column(batch.schema.get_field_index(f.name)).cast(f.type)
                                                  for f in schema], schema=schema)

    return run


def find_benchmark(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """``documents`` with n_words, n_hit (words inside any occurrence), items (sorted distinct ids) and spans (hit word ranges, from 0)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = documents.sparkSession
    arrow_batches(spark)
    strings = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    size = strings.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out = documents.drop(*FOUND.names)
    plain = T.StructType([f for f in out.schema if f.name not in FOUND.names])
    schema = T.StructType(plain.fields + FOUND.fields)
    for k in range(blocks):
        rows = strings.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        sent = spark.sparkContext.broadcast(Items([r["id"] for r in rows], [r["text"] for r in rows], width))
        if k:
            out = durable(out)  # one block's strings at a time in a task
        out = out.mapInArrow(_search_with(sent, text, to_arrow_schema(schema)), schema)
    return out


def item_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def decontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents in which no string of the benchmark occurs."""
    return find_benchmark(documents, benchmark, text, item, item_text, width).filter("n_hit = 0").select(*documents.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), p AS (
  SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT item, w, least(len(w), 10) AS m, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT rid, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), o AS (
  SELECT rid, i, m, item FROM dw JOIN p USING (m, s)
), h AS (
  SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS x FROM (SELECT DISTINCT rid, i, m FROM o)) GROUP BY rid
), n AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS said FROM o GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""
