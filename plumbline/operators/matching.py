"""Where do these phrases occur in those texts? One exact substring search for every caller.

Every phrase enters an index under its rarest gram: of all its windows of ``GRAMS`` characters (the longest that fits) the one that is met
least often in a sample of the texts. Texts stay where they are: a task computes the grams of a text, looks them up in the index, and
holds each phrase found there against the text at the place that the gram's offset gives, first by a rolling hash, then character by character.
Only occurrences leave the task; no text, position or gram is shuffled, whether a phrase is nowhere or in every text.

The index travels to the tasks. It holds at most ``BLOCK_CHARS`` characters of phrases; more phrases are dealt to blocks by hash, with one
pass over the texts each, so neither the driver nor a task ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.session import durable

GRAMS = (16, 8, 5, 3, 2, 1)
BLOCK_CHARS = 8_000_000
FEW_PHRASES, SHORT = 5000, 1000  # so many phrases of so few characters are read at once
SAMPLE_TEXTS = 2000  # texts that gram frequencies are read from; they decide what is looked up first, never what is found
SAMPLE_CHARS = 2000  # of each
FEW_CHARS = 20_000  # so few characters of phrases enter without a sample
BUCKETS = 20  # bits of a gram that frequencies and the first test go by
SLICE_CHARS = 1_000_000  # characters that are searched at once
PAIRS = 2_000_000  # (place, phrase) that are compared at once
KEPT = 1_000_000  # (text, phrase) that a task holds before it drops what cannot be among the first
NEAR = 1e-9  # scores that differ by less, relative, may change places by rounding
_BASE = 0x9E3779B97F4A7C15
# The form that is a plan alone
WINDOW = 16
ANCHORS = (16, 8, 4, 2, 1)
MARKS = 1 << 16


def grams(text: Column, n: int) -> Column:
    """All overlapping n-grams of a text, in order; one linear pass of the regex engine."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any ranges of a text from one running sum."""

    def __init__(self, code: np.ndarray):
        n = len(code) + 1
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_spread(code.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _spread((self.sums[start + length] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all ranges of ``n`` characters."""
        m = max(0, len(self.sums) - n)
        return _spread((self.sums[n:] - self.sums[:m]) * self.down[:m])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each begins (n + 1 values)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, texts)])


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


def _bucket(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - BUCKETS)).astype(np.int64)


def gram_frequencies(texts: list[str]) -> dict[int, np.ndarray]:
    """How often the grams of each length occur, by bucket."""
    code, _ = _codes(texts)
    rolling = Rolling(code)
    return {n: np.bincount(_bucket(rolling.windows(n)), minlength=1 << BUCKETS) for n in GRAMS}


@dataclass
class PhraseIndex:
    """One block of phrases: ids, characters and hashes, and by gram length the sorted grams with the phrases that enter under them."""

    ids: pa.Array
    code: np.ndarray
    begin: np.ndarray
    whole: np.ndarray
    entries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # length: (grams, phrases, offsets, marks)

    @staticmethod
    def build(ids: pa.Array, phrases: list[str], frequencies: dict[int, np.ndarray]) -> PhraseIndex:
        code, begin = _codes(phrases)
        rolling, length = Rolling(code), np.diff(begin)
        entries, taken = {}, np.zeros(len(length), bool)
        for n in GRAMS:
            which = np.flatnonzero((length >= n) & ~taken)
            taken[which] = True
            if not len(which):
                continue
            many = length[which] - n + 1
            place = _ranges(begin[which], many)
            gram = rolling.of(place, n)
            often = frequencies[n][_bucket(gram)]
            edge = np.cumsum(many) - many
            least = np.repeat(np.minimum.reduceat(often, edge), many)
            first = np.minimum.reduceat(np.where(often == least, np.arange(len(gram)), len(gram)), edge)
            own = gram[first]
            order = np.argsort(own, kind="stable")
            marks = np.zeros(1 << BUCKETS, bool)
            marks[_bucket(own)] = True
            entries[n] = own[order], which[order], (place[first] - begin[which])[order], marks
        return PhraseIndex(ids, code, begin, rolling.of(begin[:-1], length), entries)

    def search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, phrase, place from 0) of every occurrence, in no order. A long text alone is read in parts that overlap by a phrase."""
        if len(texts) != 1 or len(texts[0]) <= 2 * SLICE_CHARS:
            return self._search(texts)
        out, more = [], int(np.diff(self.begin).max()) - 1
        for a in range(0, len(texts[0]), SLICE_CHARS):
            text, phrase, place = self._search([texts[0][a: a + SLICE_CHARS + more]])
            own = place < SLICE_CHARS
            out.append((text[own], phrase[own], place[own] + a))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, off = _codes(texts)
        rolling, length = Rolling(code), np.diff(self.begin)
        out = []
        for n, (own, phrase, offset, marks) in self.entries.items():
            gram = rolling.windows(n)
            at = np.flatnonzero(marks[_bucket(gram)])
            low, high = np.searchsorted(own, gram[at], "left"), np.searchsorted(own, gram[at], "right")
            there = high > low
            at, low, many = at[there], low[there], (high - low)[there]
            ends = np.cumsum(many)
            first = 0
            while first < len(at):  # so many at once that their pairs fit
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
                k = many[first:last]
                entry = _ranges(low[first:last], k)
                p, start = phrase[entry], np.repeat(at[first:last], k) - offset[entry]
                first = last
                inside = (start >= 0) & (start + length[p] <= len(code))
                p, start = p[inside], start[inside]
                same = rolling.of(start, length[p]) == self.whole[p]
                p, start = p[same], start[same]
                if not len(p):
                    continue
                text = np.searchsorted(off, start, "right") - 1
                equal = code[_ranges(start, length[p])] == self.code[_ranges(self.begin[p], length[p])]
                good = np.logical_and.reduceat(equal, np.cumsum(length[p]) - length[p]) & (start + length[p] <= off[text + 1])
                out.append((text[good], p[good], (start - off[text])[good]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str], list[pa.Array]]]:
    """Ids, texts and further columns of a batch, about ``SLICE_CHARS`` characters at a time; null texts have none."""
    ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS or i == len(texts) - 1:
            yield ids.slice(first, i + 1 - first), texts[first: i + 1], [c.slice(first, i + 1 - first) for c in batch.columns[2:]]
            first, size = i + 1, 0


def _scan(shared, counted: bool):
    """Occurrences in the texts of a task, or their number and first place by text and phrase. ``shared``: the broadcast index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: PhraseIndex = shared.value
        length = np.diff(index.begin)
        for batch in batches:
            for ids, texts, _ in _slices(batch):
                text, phrase, place = index.search(texts)
                order = np.lexsort((place, phrase, text))
                text, phrase, place = text[order], phrase[order], place[order]
                if counted:
                    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (phrase[1:] != phrase[:-1])]) if len(text) else text
                    more = {"tf": pa.array(np.diff(np.r_[first, len(text)]), pa.int64()), "pos": pa.array((place[first] + 1).astype(np.int32))}
                    text, phrase = text[first], phrase[first]
                else:
                    more = {"pos": pa.array((place + 1).astype(np.int32)), "len": pa.array(length[phrase].astype(np.int32))}
                yield pa.RecordBatch.from_pydict({"text_id": ids.take(pa.array(text)), "phrase_id": index.ids.take(pa.array(phrase)), **more})

    return run


def _first_of_each(phrase: np.ndarray, score: np.ndarray, same: np.ndarray, order_id: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the first ``k`` of their phrase: the first k by score and id, and of scores within ``NEAR`` of the k-th the first k of each."""
    order = np.lexsort((order_id, same, -score, phrase))
    p, s, e = phrase[order], score[order], same[order]
    start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    size = np.diff(np.r_[start, len(p)])
    last = np.repeat(s[start + np.minimum(size, k) - 1], size)  # the k-th best score of the phrase
    group = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (e[1:] != e[:-1]) | (s[1:] != s[:-1])])
    place = np.arange(len(p)) - np.repeat(group, np.diff(np.r_[group, len(p)]))
    return order[(s >= last - np.abs(last) * NEAR) & (place < k)]


def _tops(shared, k: int, saturation: float, slope: float, mean: float):
    """Per task: how many of its texts hold a phrase, and the texts that may be among the first ``k`` of a phrase by BM25, whose order within a phrase needs no frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: PhraseIndex = shared.value
        df = np.zeros(len(index.ids), np.int64)
        held: list[tuple] = []
        kind = None

        def reduce_() -> None:
            ids = pa.concat_arrays([x[0] for x in held])
            phrase, tf, dl = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            score = tf * (saturation + 1) / (tf + saturation * (1 - slope + slope * dl / mean))
            keep = _first_of_each(phrase, score, dl, pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(), k) if len(phrase) else np.zeros(0, np.int64)
            held[:] = [(ids.take(pa.array(keep)), phrase[keep], tf[keep], dl[keep])]

        for batch in batches:
            kind = batch.column(0).type
            for ids, texts, more in _slices(batch):
                text, phrase, _ = index.search(texts)
                pair, tf = np.unique(text * len(df) + phrase, return_counts=True)
                text, phrase = pair // len(df), pair % len(df)
                df += np.bincount(phrase, minlength=len(df))
                known = ids.is_valid().to_numpy(zero_copy_only=False)[text]  # a text without an id counts and is not listed
                dl = more[0].to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((ids.take(pa.array(text[known])), phrase[known], tf[known].astype(np.int64), dl[text[known]]))
                if sum(len(x[1]) for x in held) > max(KEPT, 4 * k * len(df)):
                    reduce_()
        if kind is None:
            return
        reduce_()
        ids, phrase, tf, _ = held[0]
        seen = np.flatnonzero(df)
        counts = {"text_id": pa.nulls(len(seen), kind), "phrase_id": index.ids.take(pa.array(seen)), "tf": pa.nulls(len(seen), pa.int64()), "df": pa.array(df[seen])}
        yield pa.RecordBatch.from_pydict(counts)
        yield pa.RecordBatch.from_pydict({"text_id": ids, "phrase_id": index.ids.take(pa.array(phrase)), "tf": pa.array(tf), "df": pa.nulls(len(tf), pa.int64())})

    return run


def phrase_tops(texts: DataFrame, phrases: DataFrame, k: int, saturation: float, slope: float, mean: float, fold_case: bool = True) -> DataFrame:
    """(text_id, phrase_id, tf, df): of each task the texts that may be among the first ``k`` of a phrase by BM25 (``tf``, no ``df``) and how many of its texts hold the phrase (``df``, no id).

    ``texts(text_id, text, dl)``, one row per id; ``dl`` is the length that BM25 takes and ``mean`` its mean. Within a phrase the order depends on tf and dl alone, so a task
    drops what its own texts put out of the first k; what leaves it does not grow with its texts.
    """
    return _found(texts, phrases, fold_case, lambda shared: _tops(shared, k, saturation, slope, mean), ", tf bigint, df bigint")


def _best(shared, saturation: float, slope: float, mean: float):
    """The best score that a text has in a query, for every query one of whose phrases it holds. The index names a phrase by its weight and its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: PhraseIndex = shared.value
        asked = index.ids.field("queries")
        begin, weight = asked.offsets.to_numpy(), index.ids.field("weight").to_numpy()
        of = pc.dictionary_encode(asked.values.field("query_id"), null_encoding="encode")
        query, names, many = of.indices.to_numpy(), of.dictionary, np.diff(begin)
        for batch in batches:
            for ids, texts, more in _slices(batch):
                text, phrase, _ = index.search(texts)
                pair, tf = np.unique(text * len(many) + phrase, return_counts=True)
                text, phrase = pair // len(many), pair % len(many)
                known = ids.is_valid().to_numpy(zero_copy_only=False)[text]
                text, phrase, tf = text[known], phrase[known], tf[known]
                dl = more[0].to_numpy(zero_copy_only=False)[text]
                score = weight[phrase] * (tf * (saturation + 1)) / (tf + saturation * (1 - slope + slope * dl / mean))
                q, t, s = query[_ranges(begin[phrase], many[phrase])], np.repeat(text, many[phrase]), np.repeat(score, many[phrase])
                order = np.lexsort((-s, q, t))
                q, t, s = q[order], t[order], s[order]
                first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (q[1:] != q[:-1])]) if len(t) else t
                yield pa.RecordBatch.from_pydict({"query_id": names.take(pa.array(q[first])), "id": ids.take(pa.array(t[first])), "bm25": pa.array(s[first])})

    return run


def phrase_best(texts: DataFrame, phrases: DataFrame, saturation: float, slope: float, mean: float) -> DataFrame:
    """(query_id, id, bm25): the best phrase of every query in every text that holds one, found where the text lies; no hit is shuffled.

    ``texts(text_id, text, dl)``, one row per id; ``phrases(phrase, weight, queries)`` with the queries of a phrase as a list of structs.
    """
    needles = phrases.select(F.struct("weight", "queries").alias("phrase_id"), F.lower("phrase").alias("needle")).filter(F.length("needle") > 0)
    hay = texts.select("text_id", F.lower("text").alias("hay"), "dl")
    name = needles.schema["phrase_id"].dataType["queries"].dataType.elementType["query_id"].dataType.simpleString()
    schema = f"query_id {name}, id {hay.schema['text_id'].dataType.simpleString()}, bm25 double"
    parts = [hay.mapInArrow(_best(index, saturation, slope, mean), schema) for index in _indexes(hay, needles)]
    if not parts:
        return texts.sparkSession.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else reduce(DataFrame.union, parts).groupBy("query_id", "id").agg(F.max("bm25").alias("bm25"))


def _found(texts: DataFrame, phrases: DataFrame, fold_case: bool, scan, columns: str) -> DataFrame:
    """``scan(index)`` over the texts, for every block of phrases; further columns of ``texts`` go along."""
    spark, fold = texts.sparkSession, F.lower if fold_case else (lambda c: c)
    needles = phrases.select("phrase_id", fold(F.col("phrase")).alias("needle")).filter(F.length("needle") > 0)
    hay = texts.select("text_id", fold(F.col("text")).alias("hay"), *[c for c in texts.columns if c not in ("text_id", "text")])
    schema = f"text_id {hay.schema['text_id'].dataType.simpleString()}, phrase_id {needles.schema['phrase_id'].dataType.simpleString()}"
    schema += columns
    parts = [hay.mapInArrow(scan(index), schema) for index in _indexes(hay, needles)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def _indexes(hay: DataFrame, needles: DataFrame) -> Iterator:
    """The broadcast index of every block of phrases."""
    frequencies = None
    for block in _blocks(needles):
        words = block.column("needle").to_pylist()
        if frequencies is None:
            many = sum(map(len, words)) > FEW_CHARS
            seen = hay.select(F.substring("hay", 1, SAMPLE_CHARS).alias("hay")).filter("hay <> ''").limit(SAMPLE_TEXTS).collect() if many else []
            frequencies = gram_frequencies([r.hay for r in seen])
        index = PhraseIndex.build(block.column("phrase_id").combine_chunks(), words, frequencies)
        yield hay.sparkSession.sparkContext.broadcast(index)


def _blocks(needles: DataFrame) -> Iterator[pa.Table]:
    """The phrases, at most about ``BLOCK_CHARS`` characters at a time. Few and short ones come in one job."""
    first = needles.withColumn("needle", F.when(F.length("needle") <= SHORT, F.col("needle"))).limit(FEW_PHRASES + 1).toArrow()
    if first.num_rows <= FEW_PHRASES and not first.column("needle").null_count:
        if first.num_rows:
            yield first
        return
    kept = durable(needles)
    blocks = -(-kept.agg(F.sum(F.length("needle"))).first()[0] // BLOCK_CHARS)
    for b in range(blocks):
        block = kept.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).toArrow()
        if block.num_rows:
            yield block


def phrase_occurrences(texts: DataFrame, phrases: DataFrame, fold_case: bool = True) -> DataFrame:
    """Every occurrence as (text_id, phrase_id, pos, len), overlaps included; ``pos`` counts characters from 1.

    ``texts(text_id, text)``; ``phrases(phrase_id, phrase)``. Null and empty texts and phrases have no occurrence.
    """
    return _found(texts.select("text_id", "text"), phrases, fold_case, lambda shared: _scan(shared, False), ", pos int, len int")


def phrase_counts(texts: DataFrame, phrases: DataFrame, fold_case: bool = True) -> DataFrame:
    """(text_id, phrase_id, tf, pos): occurrences (overlaps count) and the first position, counted where the text lies.

    ``texts`` has one row per id, and ``phrases`` too.
    """
    return _found(texts.select("text_id", "text"), phrases, fold_case, lambda shared: _scan(shared, True), ", tf bigint, pos int")


def _lists(shared):
    """The rows of a task with one more column: the occurrences in their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: PhraseIndex = shared.value
        length = np.diff(index.begin)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            first = 0
            for _, texts, _ in _slices(pa.RecordBatch.from_arrays([batch.column(at)] * 2, ["id", "text"])):
                text, phrase, place = index.search(texts)
                order = np.lexsort((phrase, place, text))
                text, phrase, place = text[order], phrase[order], place[order]
                values = pa.StructArray.from_arrays(
                    [index.ids.take(pa.array(phrase)), pa.array((place + 1).astype(np.int32)), pa.array(length[phrase].astype(np.int32))], ["phrase_id", "pos", "len"])
                ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
                rows = batch.slice(first, len(texts))
                first += len(texts)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(ends), values)], [*batch.schema.names, "_hits"])

    return run


def phrase_lists(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``texts`` with a column ``hits``, the occurrences in a row's text as a list of (phrase_id, pos, len); rows stay where they lie, nothing is shuffled.

    ``texts(text, ...)`` keeps its columns and needs no id; ``phrases(phrase_id, phrase)``. Case counts. Each block of phrases is one pass.
    """
    needles = phrases.select("phrase_id", F.col("phrase").alias("needle")).filter(F.length("needle") > 0)
    hit = f"struct<phrase_id:{needles.schema['phrase_id'].dataType.simpleString()},pos:int,len:int>"
    hits = F.array().cast(f"array<{hit}>")
    out = texts.withColumn("hits", hits)
    for index in _indexes(texts.select(F.col("text").alias("hay")), needles):
        out = out.mapInArrow(_lists(index), StructType([*out.schema.fields, *StructType.fromDDL(f"_hits array<{hit}>").fields]))
        out = out.withColumn("hits", F.concat("hits", "_hits")).drop("_hits")
    return out


def _anchor_length(needle: Column) -> Column:
    out = F.when(F.length(needle) >= ANCHORS[0], ANCHORS[0])
    for a in ANCHORS[1:]:
        out = out.when(F.length(needle) >= a, a)
    return out


def _windows(text: Column) -> Column:
    """At each position the next 16 characters, fewer at the end of the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{WINDOW}}}))"), F.lit(1))


def phrase_positions(texts: DataFrame, phrases: DataFrame, fold_case: bool = True) -> DataFrame:
    """:func:`phrase_occurrences` as a plan alone: no job runs before the result is asked for, and every position with an anchor's mark is shuffled.

    ``texts(text_id, text)`` with one row per id; ``phrases(phrase_id, phrase)``. Only positions whose mark is
    that of an anchor go on, without their text; phrases longer than a window meet the text again by id.
    """
    fold = F.lower if fold_case else (lambda c: c)
    needles = phrases.select("phrase_id", fold(F.col("phrase")).alias("needle")).filter(F.length("needle") > 0)
    needles = needles.withColumn("w", _anchor_length(F.col("needle"))).select(
        "phrase_id", "needle", "w", F.substring("needle", 1, WINDOW).alias("begin"), F.xxhash64(F.expr("substring(needle, 1, w)")).alias("head"))
    lengths = needles.agg(F.collect_set("w").alias("lengths"))  # one row, at most len(ANCHORS) values
    marks = needles.select(F.pmod("head", F.lit(MARKS)).alias("mark")).distinct()  # at most MARKS rows
    hay = texts.select("text_id", fold(F.col("text")).alias("hay"))
    windows = hay.select("text_id", F.posexplode(_windows(F.col("hay"))).alias("p", "win")).join(F.broadcast(lengths))
    # at the end of a text the heads of several lengths are one
    heads = F.array_distinct(F.transform("lengths", lambda w: F.xxhash64(F.substring("win", F.lit(1), w))))
    unfolded = windows.select("text_id", "p", "win", F.explode(heads).alias("head")).withColumn("mark", F.pmod("head", F.lit(MARKS)))
    likely = unfolded.join(F.broadcast(marks), "mark", "left_semi").drop("mark")
    candidates = likely.join(needles, "head").filter(F.startswith("win", "begin"))
    out = ("text_id", "phrase_id", (F.col("p") + 1).alias("pos"), F.length("needle").alias("len"))
    # a long phrase is compared against the text once its first 16 characters agree
    rest = (F.length("needle") <= WINDOW) | F.expr("substring(hay, p + 1, length(needle)) = needle")
    return candidates.join(hay, "text_id").filter(rest).select(*out)


def longest_mentions(positions: DataFrame) -> DataFrame:
    """Drop a mention that lies inside a longer mention of the same text.

    ``positions(text_id, name, pos, len)``. The mentions of one text are swept in order once;
    the text bounds the group.
    """
    from pyspark.sql import Window as W

    end = F.col("pos") + F.col("len")
    order = W.partitionBy("text_id").orderBy("pos", F.desc("len")).rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(end).over(order)
    return positions.withColumn("_reach", reach).filter(F.col("_reach").isNull() | (end > F.col("_reach"))).drop("_reach")
