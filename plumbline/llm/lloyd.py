"""Vector code compression: product codes learned by Lloyd rounds over resident members.

A vector of whole numbers is cut into ``PARTS`` equal parts; every part position has a codebook. Parts are members of the entry that is nearest
to them and live in the partition of their owner (position, entry, salt). In a round

* members whose nearest entry has changed migrate to their new owner: they alone are shuffled, all others stay in the partition where they are;
* owners update: each partition adds up the members it holds, and the sums of a (position, entry), one row per partition, make the entry's new components.

Salts deal the members of one entry to as many owners as there are shuffle partitions, so an entry that holds a third of all parts is no
burden to one task. The driver holds the codebooks (``PARTS`` x ``ENTRIES`` parts of a vector, whatever the data); tasks get them with
their code. Residents and migrants are checkpointed once a round. The last assignment needs no owners and is one pass over the vectors.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of another length than most have; a vector whose length
is no multiple of ``PARTS`` has longer parts first; fewer rows than entries make smaller codebooks; of equal keys the smaller vector comes first, null keys come last;
repeated rows count as often as they occur; scaled components are cut off where a sum of squares would no longer fit a long (``limit``: beyond +-2^27 for 64 components);
an empty table has no rows. Input columns besides key, vector and label are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ID_LIST, durable
from plumbline.llm.vectors import field, finite, matrix, scaled, usual_length

PARTS = 4
ENTRIES = 256
ROUNDS = 4
CHUNK = 4096
OWNER = ["position", "entry", "salt"]
MEMBER = "position int, entry int, salt int, part binary"
Codebooks = list[np.ndarray]  # by position: entries x components, long


def limit(dims: int) -> int:
    """Components of this size at most keep the squared distance of two vectors within a long."""
    return math.isqrt(2**60 // max(dims, 1))


def bounds(dims: int, parts: int) -> np.ndarray:
    """Where parts begin and end (parts + 1 values)."""
    short, longer = divmod(dims, parts)
    return np.r_[0, np.cumsum([short + (i < longer) for i in range(parts)])]


def nearest_entry(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` the nearest entry, of equally near ones the first, and the squared distance; both exact."""
    best, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not x.shape[1]:
        return best, error
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    in_doubles = 4 * x.shape[1] * largest * largest < 2**53  # then products and sums of doubles are exact
    e = entries.astype(np.float64)
    own = (e * e).sum(axis=1)
    for a in range(0, len(x), CHUNK):
        part = x[a: a + CHUNK]
        if in_doubles:
            at = (own - 2 * (part.astype(np.float64) @ e.T)).argmin(axis=1)
        else:
            at = np.array([((row - entries) ** 2).sum(axis=1).argmin() for row in part], np.int64)
        best[a: a + CHUNK] = at
        error[a: a + CHUNK] = ((part - entries[at]) ** 2).sum(axis=1)
    return best, error


def _members(position: np.ndarray, column: pa.Array, cut: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position, rows and parts of each position in a batch."""
    for p in np.unique(position).tolist():
        rows = np.flatnonzero(position == p)
        raw = b"".join(column.take(pa.array(rows)).to_pylist())
        yield p, rows, np.frombuffer(raw, np.int64).reshape(len(rows), cut[p + 1] - cut[p])


def _place(books: Codebooks, cut: np.ndarray, most: int, salts: int):
    """Vectors to members of their nearest entries; consecutive members get different salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            x = scaled(matrix(field(batch, "vector"), int(cut[-1])), most)
            salt = ((turn + np.arange(len(x))) % salts).astype(np.int32)
            turn += len(x)
            for p, book in enumerate(books):
                part = np.ascontiguousarray(x[:, cut[p]: cut[p + 1]])
                entry, _ = nearest_entry(part, book)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(salt),
                                                  pa.array([row.tobytes() for row in part], pa.binary())], names=["position", "entry", "salt", "part"])

    return run


def _reassign(books: Codebooks, cut: np.ndarray):
    """Adds ``nearest``, the entry that a member belongs to now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = np.zeros(batch.num_rows, np.int32)
            for p, rows, part in _members(field(batch, "position").to_numpy(), field(batch, "part"), cut):
                now[rows] = nearest_entry(part, books[p])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(now)], names=[*batch.schema.names, "nearest"])

    return run


def _sums(cut: np.ndarray, entries: int, members: bool):
    """One row (position, entry, count, part) for each entry with members in the task: componentwise sums of ``members``, or of such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((entries, b - a), np.int64) for a, b in zip(cut, cut[1:])]
        count = np.zeros((len(total), entries), np.int64)
        for batch in batches:
            entry = field(batch, "entry").to_numpy()
            n = np.ones(len(entry), np.int64) if members else field(batch, "count").to_numpy()
            for p, rows, part in _members(field(batch, "position").to_numpy(), field(batch, "part"), cut):
                np.add.at(total[p], entry[rows], part)
                np.add.at(count[p], entry[rows], n[rows])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
                                          pa.array([total[i][j].tobytes() for i, j in zip(p.tolist(), e.tolist())], pa.binary())], names=["position", "entry", "count", "part"])

    return run


def updated(books: Codebooks, residents: DataFrame, cut: np.ndarray) -> Codebooks:
    """Every entry as the componentwise floor of its members' mean; an entry without members stays."""
    spark, kind = residents.sparkSession, "position int, entry int, count long, part binary"
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(books) * len(books[0]))
    held = residents.mapInArrow(_sums(cut, len(books[0]), True), kind)
    sums = held.repartition(n, "position", "entry").mapInArrow(_sums(cut, len(books[0]), False), kind).collect()  # one row per entry
    books = [b.copy() for b in books]
    for r in sums:
        books[r.position][r.entry] = np.frombuffer(r.part, np.int64) // r["count"]
    return books


def first_codebooks(rows: DataFrame, cut: np.ndarray, most: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest keys. ``rows``: key, vector."""
    first = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    x = scaled(np.array([r.vector for r in first], np.float64).reshape(len(first), int(cut[-1])), most)
    return [x[:, a:b] for a, b in zip(cut, cut[1:])]


def learned(rows: DataFrame, cut: np.ndarray, most: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and update. ``rows``: key, vector, all of one length."""
    books = first_codebooks(rows, cut, most, entries)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    residents = durable(rows.select("vector").mapInArrow(_place(books, cut, most, n), MEMBER).repartition(n, *OWNER))
    books = updated(books, residents, cut)
    for _ in range(rounds - 1):
        judged = durable(residents.mapInArrow(_reassign(books, cut), f"{MEMBER}, nearest int"))
        migrants = judged.filter("nearest <> entry").select("position", F.col("nearest").alias("entry"), "salt", "part")
        residents = judged.filter("nearest = entry").drop("nearest").union(durable(migrants.repartition(n, *OWNER)))
        books = updated(books, residents, cut)
    return books


def _codes(books: Codebooks, cut: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(matrix(field(batch, "vector"), int(cut[-1])), most)
            code, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                code[:, p], apart = nearest_entry(np.ascontiguousarray(x[:, cut[p]: cut[p + 1]]), book)
                error += apart
            yield pa.RecordBatch.from_arrays([field(batch, "key"), field(batch, "label"), pa.array(code.tolist(), pa.list_(pa.int32())), pa.array(error)],
                                             names=["key", "label", "codes", "error"])

    return run


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()


def compressed(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, parts: int = PARTS,
               rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """key, label, codes (entry of every part) and error (squared distance to the codes' vector) of every row that takes part, and the codebooks."""
    rows = table.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label")).filter(finite(F.col("vector")))
    dims = usual_length(rows, "vector")
    names = rows.schema
    kind = f"key {names['key'].dataType.simpleString()}, label {names['label'].dataType.simpleString()}, codes array<int>, error long"
    if dims is None:
        return table.sparkSession.createDataFrame([], kind), []
    rows = rows.filter(F.size("vector") == dims)
    cut, most = bounds(dims, parts), limit(dims)
    books = learned(rows, cut, most, entries, rounds)
    return rows.mapInArrow(_codes(books, cut, most), kind), books


def code_table(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """key, code (two hexadecimal digits a part), error, label_error (errors of equal labels, nulls being equal) and codebooks_sha256."""
    rows, books = compressed(table, key, vector, label, entries, parts, rounds)
    coded = durable(rows)
    totals = durable(coded.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error")))
    few = totals.count() <= ID_LIST  # rows of a label and a number; more go by a shuffle
    hexes = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return (coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("_of")))
            .select(F.col("key").alias(key), hexes.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same codes for DuckDB: whole numbers as doubles, in which all products and sums here are exact."""
    distance = "list_dot_product(p.d, p.d) - 2 * list_dot_product(p.d, c.d) + list_dot_product(c.d, c.d)"
    steps = [f"""k AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), w AS (SELECT max(len(x)) // {PARTS} AS w FROM k
), p AS MATERIALIZED (SELECT rn, pos, x[pos * w + 1 : pos * w + w] AS d FROM k, w, (SELECT unnest(range({PARTS})) AS pos)
), c0 AS MATERIALIZED (SELECT pos, rn - 1 AS e, d FROM p WHERE rn <= {ENTRIES}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT p.rn, p.pos, min({{'d': {distance}, 'e': c.e}}) AS m FROM p JOIN c{r} c ON c.pos = p.pos GROUP BY 1, 2
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.pos, c.e, coalesce(n.d, c.d) AS d FROM c{r} c LEFT JOIN (
    SELECT pos, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS d FROM (
      SELECT p.pos, a.m.e AS e, i, sum(p.d[i]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN p ON p.rn = a.rn AND p.pos = a.pos, w, unnest(range(1, w.w + 1)) AS t(i) GROUP BY 1, 2, 3)
    GROUP BY 1, 2) n ON n.pos = c.pos AND n.e = c.e
)""")
    last = rounds
    return "WITH " + ", ".join(steps) + f""", h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY pos, e, i)) AS sha FROM (SELECT pos, e, unnest(d) AS v, unnest(range(len(d))) AS i FROM c{last})
), r AS (SELECT rn, string_agg(printf('%02x', m.e), '' ORDER BY pos) AS code, sum(m.d)::BIGINT AS error FROM a{last} GROUP BY 1
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM k JOIN r USING (rn), h"""
