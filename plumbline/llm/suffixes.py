"""Substring dedup over bytes with a logarithmic family of suffix arrays.

Of each text, the suffixes at anchors are indexed: places chosen by content so that every ``WIDTH`` bytes hold one at a place that all their
copies share (the least hash of ``KEY_BYTES`` bytes). An array is a table in suffix order in every partition (``anchor``: two bytes of
the suffix and a hash of its key bytes; ``content``: the hash of all bytes that the anchor stands for), with one row per content.

New batches get an array of their own. Arrays of equal size merge until sizes differ, so n batches make at most log2(n) + 1 levels and an entry is
rewritten log2(n) times at most. A merge is one scan in suffix order; it says which contents occur again and which anchors have
different contents. Of the latter, one occurrence each travels with its bytes, and its windows are compared (see repeats); anchors of more than
``FEW`` contents, such as the edge of a passage that is everywhere, are compared window by window in an aggregate instead.

Removed is each byte of a ``WIDTH``-byte string that also starts at any other place, in the same text or another. Strings do not cross texts.

Defined results: a null text is empty; equal texts are occurrences of each other, so they lose everything from ``WIDTH`` bytes on; removal may
split a character, kept bytes are hashed as they are; repeated rows are further copies; an empty table has no rows. Input columns besides key and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_batches, byte_hashes, durable, mix, only, pieces, stored, utf8
from plumbline.llm.repeats import Hashes, contexts, covered, windows_of

WIDTH = 400
KEY_BYTES = 128
BATCHES = 2
RECENT = 50_000
FEW = 4096
ENTRY = ["anchor", "content", "text_id", "start", "count", "again"]
SPANS = "array<struct<start:int,count:int>>"


def _units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_hashes(data), off


def sampled_suffixes(data: np.ndarray, off: np.ndarray, width: int, key_bytes: int):
    """Contexts of the anchors of all texts, and the anchors' keys: their order is that of the first two bytes of the suffix."""
    h = byte_hashes(data)
    rank = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    n = len(h) - key_bytes + 1
    if n > 0:
        rank[:n] = mix(Hashes(h).of(np.arange(n), key_bytes)) >> np.uint64(1)
    c = contexts(h, off, rank, width, 0, width - key_bytes + 1, 0, key_bytes)
    head = data[c.anchor].astype(np.uint64) << np.uint64(8) | data[c.anchor + 1].astype(np.uint64)
    key = head << np.uint64(48) | c.key >> np.uint64(16)
    return c, (key ^ np.uint64(1 << 63)).view(np.int64)  # the sign bit turned: signed order is byte order


def _read(width: int, key_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, None] = {}
        for whole in batches:
            for batch in pieces(whole, "text"):
                ids = batch.column(batch.schema.get_field_index("text_id"))
                data, off, _ = utf8(batch.column(batch.schema.get_field_index("text")))
                n = np.diff(off)
                use = n >= width
                for i, t in enumerate(ids.to_pylist()):  # a text that this task has read is not told twice
                    use[i] &= t not in recent
                    recent[t] = None
                while len(recent) > RECENT:
                    recent.pop(next(iter(recent)))
                c, key = sampled_suffixes(data[np.repeat(use, n)], np.r_[0, np.cumsum(np.where(use, n, 0))], width, key_bytes)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(key), "content": pa.array(c.content.view(np.int64)), "text_id": ids.take(pa.array(c.doc)),
                                                  "start": pa.array(c.start.astype(np.int32)), "count": pa.array(c.count.astype(np.int32))})

    return run


def _columns(batch: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, content, text_id, start) to one row per content: ``again`` if it is at two places, ``differ`` if its
    anchor has another content. Holds back one content, which the next batch may go on with."""
    held, told = None, None  # the last content, and the anchor of the last row given out

    def give(x, differ):
        return pa.RecordBatch.from_pydict({**{c: pa.array(x[c]) for c in ENTRY}, "differ": pa.array(differ)})

    for batch in batches:
        if not batch.num_rows:
            continue
        x = _columns(batch, ENTRY)
        if held is not None:
            x = {c: np.concatenate([held[c], v]) for c, v in x.items()}
        new_anchor = np.r_[True, x["anchor"][1:] != x["anchor"][:-1]]
        new = new_anchor | np.r_[True, x["content"][1:] != x["content"][:-1]]
        moved = np.r_[False, (x["text_id"][1:] != x["text_id"][:-1]) | (x["start"][1:] != x["start"][:-1])] & ~new
        first = np.flatnonzero(new)
        again = np.logical_or.reduceat(x["again"] | moved, first)
        one = {c: v[first] for c, v in x.items()} | {"again": again}
        run = np.cumsum(new_anchor[first]) - 1
        differ = (np.bincount(run) > 1)[run] | (one["anchor"] == told if told is not None else False)
        held = {c: v[-1:] for c, v in one.items()}
        if len(first) > 1:
            yield give({c: v[:-1] for c, v in one.items()}, differ[:-1])
            told = one["anchor"][-2]
    if held is not None:
        yield give(held, np.array([bool(told is not None and held["anchor"][0] == told)]))


class SuffixFamily:
    """Levels of suffix arrays over all batches added so far."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []  # (batches, array), largest first

    @staticmethod
    def scan(rows: DataFrame) -> DataFrame:
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.select(*ENTRY).repartition(n, "anchor").sortWithinPartitions("anchor", "content", "text_id", "start")
        return stored(ordered.mapInArrow(_scan, "anchor long, content long, text_id long, start int, count int, again boolean, differ boolean"))

    def add(self, entries: DataFrame) -> None:
        """``entries``: anchor, content, text_id, start, count of the texts of a new batch."""
        size, level = 1, self.scan(entries.withColumn("again", F.lit(False)))
        while self.levels and self.levels[-1][0] == size:
            level = self.scan(self.levels.pop()[1].union(level))
            size *= 2
        self.levels.append((size, level))

    def whole(self) -> DataFrame:
        """What a scan over all levels says: one row per content."""
        if len(self.levels) == 1:
            return self.levels[0][1]
        return self.scan(reduce(DataFrame.union, [x for _, x in self.levels]))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without the texts that this task has given out before."""
    recent: dict[int, None] = {}
    for batch in batches:
        fresh = []
        for t in batch.column(batch.schema.get_field_index("text_id")).to_pylist():
            fresh.append(t not in recent)
            recent[t] = None
        while len(recent) > RECENT:
            recent.pop(next(iter(recent)))
        yield batch if all(fresh) else batch.filter(pa.array(fresh, pa.bool_()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For texts with ``asked`` contexts: a row for every context with its bytes."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            data, off, _ = utf8(batch.column(batch.schema.get_field_index("text")))
            asked = batch.column(batch.schema.get_field_index("asked"))
            row = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
            flat = asked.flatten()
            field = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "size")}
            begin = off[:-1][row] + field["start"]
            raw = data.tobytes()
            yield pa.RecordBatch.from_pydict({"anchor": flat.field("key"), "content": flat.field("content"),
                                              "bytes": pa.array([raw[a: a + n] for a, n in zip(begin.tolist(), field["size"].tolist())], pa.binary())})


def _runs(places: np.ndarray) -> list[dict]:
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    return [{"start": int(p[0]), "count": len(p)} for p in np.split(places, cut)]


def _compare(width: int):
    """Contexts in order of (anchor, content), of which one each is kept, to the windows that another context of the anchor has, too: (anchor, content, spans)."""

    def groups(anchor: np.ndarray, content: np.ndarray, column: pa.Array) -> pa.RecordBatch:
        data, off, _ = utf8(column)
        n = np.maximum(0, np.diff(off) - width + 1)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        window = Hashes(byte_hashes(data)).of(off[:-1][row] + place, width) + mix(anchor.view(np.uint64))[row]
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(window), bool)
        twice[order] = np.r_[same, False] | np.r_[False, same]
        hit = np.flatnonzero(twice)
        rows, at = np.unique(row[hit], return_index=True)
        spans = [_runs(p) for p in np.split(place[hit], at[1:])] if len(rows) else []
        return pa.RecordBatch.from_pydict({"anchor": pa.array(anchor[rows]), "content": pa.array(content[rows]),
                                           "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32())])))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            anchor, content = table.column("anchor").to_numpy(), table.column("content").to_numpy()
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]
            if not new.all():  # copies of a text from several tasks
                table, anchor = table.filter(pa.array(new)), anchor[new]
            last = int(np.searchsorted(anchor, anchor[-1], "left"))  # the last anchor may go on
            if last:
                yield groups(anchor[:last], table.column("content").to_numpy()[:last], table.column("bytes").slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield groups(held.column("anchor").to_numpy(), held.column("content").to_numpy(), held.column("bytes"))

    return run


def _rewrite(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, off, _ = utf8(batch.column(batch.schema.get_field_index("text")))
                removed, spans, sha = [], [], []
                for i, asked in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                    text = data[off[i]: off[i + 1]]
                    gone = covered(len(text), asked, width)
                    removed.append(int(gone.sum()))
                    spans.append(int(np.count_nonzero(np.diff(np.r_[0, gone.view(np.int8)]) == 1)))
                    sha.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
                yield pa.RecordBatch.from_pydict({"text_id": batch.column(batch.schema.get_field_index("text_id")), "n_removed": pa.array(removed, pa.int64()),
                                                  "n_spans": pa.array(spans, pa.int64()), "new_sha": pa.array(sha, pa.string())})

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, key_bytes: int = KEY_BYTES, batches: int = BATCHES, few: int = FEW) -> DataFrame:
    """text_id and spans (start, count of windows that also start elsewhere, by other texts or this one) of distinct texts.

    ``docs``: text_id, text. Batches are dealt by text_id; an index that lives on would add each delivery as it comes.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(docs.mapInArrow(_read(width, key_bytes), "anchor long, content long, text_id long, start int, count int"))
    family = SuffixFamily()
    for k in range(batches):
        family.add(found.filter(F.pmod(F.xxhash64("text_id"), F.lit(batches)) == k))
    every = family.whole()
    open_ = every.filter("differ")
    counts = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))

    def texts_of(which: DataFrame) -> DataFrame:
        asked = durable(which.groupBy("text_id").agg(F.collect_list(F.struct(
            F.col("anchor").alias("key"), "content", "start", "count", (F.col("count") + width - 1).alias("size"))).alias("asked")))
        # Copies of a text stay with the task that reads them, and the few of several tasks fall out where contexts are compared.
        once = only(docs, asked.select("text_id"), ["text_id"]).select("text_id", "text").mapInArrow(_once, "text_id long, text string")
        return once.join(asked, "text_id").select("text", "asked")

    small = texts_of(open_.join(counts.filter(F.col("n") <= few), "anchor", "left_semi")).mapInArrow(_slices, "anchor long, content long, bytes binary")
    parts = small.repartition(n, "anchor").sortWithinPartitions("anchor", "content").mapInArrow(_compare(width), f"anchor long, content long, spans {SPANS}")
    # Windows of one context differ, so a window with two contents is at two places.
    seen = stored(texts_of(open_.join(counts.filter(F.col("n") > few), "anchor", "left_semi")).mapInArrow(
        windows_of(_units, "text", width, []), "key long, content long, place int, window long"))
    twice = seen.groupBy("key", "window").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low < high").select("key", "window")
    more = (seen.join(twice, ["key", "window"]).groupBy(F.col("key").alias("anchor"), "content")
            .agg(F.collect_set(F.struct(F.col("place").alias("start"), F.lit(1).alias("count"))).cast(SPANS).alias("spans")))
    # Stored, so that what follows is one plain join and Spark can split the contexts of a common passage.
    whole = every.filter("again").select("anchor", "content", F.lit(None).cast(SPANS).alias("spans"))
    marks = stored(whole.unionByName(parts).unionByName(more))
    own = F.array(F.struct(F.col("start"), F.col("count")))
    some = F.transform("spans", lambda x: F.struct((F.col("start") + x["start"]).alias("start"), x["count"].alias("count")))
    return (found.join(marks, ["anchor", "content"]).select("text_id", F.explode(F.when(F.col("spans").isNull(), own).otherwise(some)).alias("x"))
            .groupBy("text_id").agg(F.collect_set("x").alias("spans")))


def dedup_bytes(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, key_bytes: int = KEY_BYTES, batches: int = BATCHES, few: int = FEW) -> DataFrame:
    """key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every row."""
    arrow_batches(documents.sparkSession)
    docs = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_id", F.xxhash64("text"))
    per_doc = stored(docs.select("key", "text_id", F.octet_length("text").cast("long").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    copies = per_doc.groupBy("text_id").agg(F.count(F.lit(1)).alias("copies"))
    spans = repeated_spans(docs.select("text_id", "text"), width, key_bytes, batches, few)
    spans = durable(spans.join(copies.filter("copies = 1"), "text_id", "left_semi"))
    some = only(docs.select("text_id", "text"), spans.select("text_id"), ["text_id"]).join(spans, "text_id")
    new = some.mapInArrow(_rewrite(width), "text_id long, n_removed long, n_spans long, new_sha string")
    gone = (F.col("copies") > 1) & (F.col("n") >= width)
    zero = F.lit(0).cast("long")
    return (per_doc.join(copies, "text_id").join(new, "text_id", "left")
            .select(F.col("key").alias(key), F.col("n").alias("n_bytes"), F.when(gone, F.col("n")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
                    F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
                    F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256")))
