"""Product codes and whitening against plain definitions, on vectors with every trouble."""

import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lloyd, whitening
from plumbline.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, entry int, part string, n int"


def usable(v, dims):
    return v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8)
    out = [(i * 2, [float(np.float32(c)) for c in rng.normal(size=8)], i % 5 if i % 7 else None, 1, "x", 2) for i in range(300)]
    out += [(1000 + i, [float(np.float32(c)) for c in hot], 1, 1, "x", 2) for i in range(150)]  # copies
    out += [(7, None, 1, 1, "x", 2), (9, [], 1, 1, "x", 2), (11, [1.0] * 7 + [None], 1, 1, "x", 2), (13, [float("nan")] * 8, 1, 1, "x", 2),
            (15, [float("inf")] + [1.0] * 7, 1, 1, "x", 2), (17, [1.0] * 4, 1, 1, "x", 2), (None, [0.5] * 8, 1, 1, "x", 2), (19, [0.0] * 8, None, 1, "x", 2)]
    return out + [out[0], out[0], out[5], (out[3][0], out[4][1], 2, 1, "x", 2)]  # repeated rows, and an id with two vectors


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(7)


def plain_codes(rows, dims, entries=256, parts=4, rounds=4):
    kept = [r for r in rows if usable(r[1], dims)]
    x = [[math.floor(Fraction(c) * 1024) for c in r[1]] for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    w = dims // parts
    books = [[x[i][p * w: (p + 1) * w] for i in first] for p in range(parts)]

    def assign(p):
        out = []
        for v in x:
            part = v[p * w: (p + 1) * w]
            out.append(min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p])))
        return out

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for v, (_, k) in zip(x, assign(p)):
                members[k].append(v[p * w: (p + 1) * w])
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m)]
    last = [assign(p) for p in range(parts)]
    error = [sum(last[p][i][0] for p in range(parts)) for i in range(len(x))]
    by_label = Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((repr(r[0]), "".join(f"{last[p][i][1]:02x}" for p in range(parts)), error[i], by_label[r[2]], sha) for i, r in enumerate(kept)))


def told(df):
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("entries", [256, 12])
def test_codes(table, rows, entries):
    assert told(lloyd.code_table(table, entries=entries)) == plain_codes(rows, 8, entries)


def test_codes_of_large_components_and_of_few_rows(spark):
    few = [(i, [10.0 ** (i + k - 1) * (-1) ** k for k in range(4)], None, 1, "x", 2) for i in range(4)]
    table = spark.createDataFrame(few, VECTORS.replace("float", "double"))
    assert told(lloyd.code_table(table)) == plain_codes(few, 4)
    uneven = lloyd.code_table(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert [(r.code, r.error) for r in uneven] == [("00000000", 0)]
    huge = lloyd.code_table(spark.createDataFrame([(1, [1e30] * 4, 1), (2, [-1e30] * 4, 1)], "vec_id long, embedding array<float>, label int"), entries=1).collect()
    assert all(0 < r.error < 2**62 for r in huge)


def test_residents_stay_and_migrants_move(spark, table):
    """Every member is with an owner of its nearest entry of the round before, and members of one entry have many owners."""
    rows = table.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")).filter(lloyd.finite(F.col("vector"))).filter(F.size("vector") == 8)
    cut = lloyd.bounds(8, 4)
    books = lloyd.first_codebooks(rows, cut, lloyd.limit(8), 16)
    placed = rows.select("vector").mapInArrow(lloyd._place(books, cut, lloyd.limit(8), 8), lloyd.MEMBER)
    judged = placed.mapInArrow(lloyd._reassign(books, cut), f"{lloyd.MEMBER}, nearest int")
    assert judged.count() == 4 * rows.count() and judged.filter("nearest <> entry").count() == 0
    hot = placed.groupBy("position", "entry").agg(F.count("*").alias("n"), F.countDistinct("salt").alias("owners")).filter("n >= 150").collect()
    assert hot and all(r.owners == 8 for r in hot)


def test_nothing_to_code(spark, table):
    assert lloyd.code_table(table.filter("false")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert lloyd.code_table(table.filter("false")).count() == 0 and lloyd.code_table(table.filter("vec_id in (7, 13)")).count() == 0


def test_codes_of_the_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert told(QUERIES["op11_member_lloyd"](spark, sf)) == plain_codes(rows, len(rows[0][1]))


# Whitening -----------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("dims", [1, 2, 3, 8, 40])
def test_rank_one_updates(dims):
    rng = np.random.default_rng(dims)
    spectrum, scatter, base = whitening.Spectrum.empty(dims), np.zeros((dims, dims)), rng.normal(size=(3, dims))
    for i in range(120):
        x = rng.normal(size=dims) * 10.0 ** (i % 5)
        x = base[i % 3] if i % 4 == 0 else np.eye(dims)[i % dims] if i % 7 == 0 else x * 0 if i % 17 == 0 else x
        spectrum.add(x[None])
        scatter += np.outer(x, x)
        again = spectrum.vectors * spectrum.values @ spectrum.vectors.T
        assert np.abs(again - scatter).max() <= 1e-12 * max(np.abs(scatter).max(), 1e-300)
        assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(dims)).max() < 1e-11
        assert (np.diff(spectrum.values) >= 0).all()
    other = whitening.Spectrum.empty(dims)
    other.add(base)
    spectrum.absorb(other)
    assert np.allclose(spectrum.vectors * spectrum.values @ spectrum.vectors.T, scatter + base.T @ base, rtol=0, atol=1e-11 * np.abs(scatter).max())


def plain_whitening(rows, dims, most=8):
    kept = [r for r in rows if usable(r[1], dims)]
    x = [[math.floor(Fraction(c) * 1024) + 100000 for c in r[1]] for r in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(row, sums)] for row in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return kept, n, deviation, centred @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(cov)


def same_whitening(out, rows, dims):
    kept, n, deviation, y, explained = plain_whitening(rows, dims)
    got = out.toPandas()
    assert len(got) == len(kept) * len(explained) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    share = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, explained, rtol=1e-9)
    want = Counter()
    for (r, d) in zip(kept, deviation):
        want[repr(r[0]), d] += len(explained)
    ids = ["None" if i != i else repr(int(i)) for i in got.vec_id.tolist()]
    assert Counter(zip(ids, got.deviation.tolist())) == want
    for c in range(len(explained)):
        mine = sorted(zip(ids, got.deviation.tolist(), got.whitened.where(got.component == c + 1).tolist()), key=lambda t: (t[0], t[1]))
        mine = np.array([t[2] for t in mine if t[2] == t[2]])
        plain = np.array([t[2] for t in sorted(zip([repr(r[0]) for r in kept], deviation, y[:, c].tolist()), key=lambda t: (t[0], t[1]))])
        assert min(np.abs(mine - plain).max(), np.abs(mine + plain).max()) < 1e-8


@pytest.mark.parametrize("block, fan", [(32, 8), (1, 2)])
def test_whitening(table, rows, block, fan):
    same_whitening(whitening.whitened(table, block=block, fan=fan), rows, 8)


def test_whitening_of_odd_tables(spark, table):
    assert whitening.whitened(table.filter("false")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened(table.filter("false")).count() == 0
    assert whitening.whitened(table.filter("vec_id between 1000 and 1100")).count() == 0  # copies only: no spread
    line = [(i, [float(i), 2.0 * i, 0.0], 1, 1, "x", 2) for i in range(9)]
    same_whitening(whitening.whitened(spark.createDataFrame(line, VECTORS)), line, 3)
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.deviation is None for r in whitening.whitened(huge).collect()} == {1: True, 2: True, 3: False}


def test_whitening_of_the_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same_whitening(QUERIES["op12_secular_whitening"](spark, sf), rows, len(rows[0][1]))
