"""The corpus operators against brute force on a small fixture of difficult rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard, mixing, quality, recompression, sharding, suffixes, urlfilter, vptree
from plumbline.llm.components import connected
from plumbline.llm.repeats import sliding_min
from tests.llm.conftest import prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text, fold=False):
    raw = (text or "").encode()
    return [w.lower() if fold else w for w in WORD.findall(raw)]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def counted(rows):
    return Counter(tuple(r) for r in rows)


# 1 -------------------------------------------------------------------------------------------------------------------------------
def test_virtual_slots(odd, odd_rows, none):
    out = sharding.shard_documents(odd, shards=4, slots=64).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, None if r[1] is None else zlib.crc32(r[1].encode())) for r in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    load, places = Counter(), defaultdict(list)
    for r in out:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    longest = max(len((r[1] or "").encode()) for r in odd_rows) + 8
    assert max(load.values()) - min(load.get(s, 0) for s in range(4)) <= longest
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None} and {r.map_version for r in out} == {2}
    assert sharding.shard_documents(none, shards=4).count() == 0


def test_versions_of_the_map_move_few_slots(odd):
    sized = sharding.sized_rows(odd.filter("length(text) < 3000"), slots=64)  # no row as heavy as a shard
    versions = sharding.build_map(sized, 4, 64)
    newest = versions.filter("version = 2")
    more = sharding.grown(newest, 4)
    before = {(r.v_slot, r.part): r.shard for r in newest.collect()}
    after = {(r.v_slot, r.part): r.shard for r in more.collect()}
    assert before.keys() == after.keys() and len(before) >= 64
    moved = {k for k in before if before[k] != after[k]}
    assert moved and {after[k] for k in moved} == {4} and {r.version for r in more.collect()} == {3}


def test_a_hot_record_is_split(spark):
    hot = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("x" * 100).alias("text"))
    load = {r.shard: r["sum(size)"] for r in sharding.shard_documents(hot, shards=4, slots=64).groupBy("shard").sum("size").collect()}
    assert len(load) == 4 and max(load.values()) < 1.2 * min(load.values())


# 2 -------------------------------------------------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark, sf, odd, none):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    out = quality.classify(docs.select("doc_id", "text"), labels)
    known = out.join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = known[known.quality == 1], known[known.quality == 0]
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean() > 0.95
    assert good.predicted.mean() > 0.95 and out.filter("score < 0 or score > 1 or score is null").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.select("doc_id", "held_out").collect())
    # Labels of the held-out fold and labels 0 change nothing.
    blind = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).filter("quality = 1")
    assert quality.train(docs, blind).tolist() == quality.train(docs, labels).tolist()
    odd_labels = spark.createDataFrame([(r * 3, 1) for r in range(40)] + [(3, 1), (10**9, 1), (None, 1), (6, None)], "doc_id long, quality int")
    scored = quality.classify(odd, odd_labels)
    assert scored.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "score", "held_out", "predicted"]
    assert scored.filter("score between 0 and 1").count() == odd.count()
    assert {r.score for r in quality.classify(odd, odd_labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, odd_labels).count() == 0


def test_prior_of_a_mixture():
    rng = np.random.default_rng(3)
    p, u = rng.normal(2, 1, 3000), np.r_[rng.normal(2, 1, 2100), rng.normal(-2, 1, 900)]
    assert abs(quality.estimate_prior(p, u) - 0.7) < 0.06


# 4 -------------------------------------------------------------------------------------------------------------------------------
def brute_benchmark(rows, items, width=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    strings = defaultdict(set)
    for i, t in items:
        w = pat.findall((t or "").translate(low))
        for s in range(max(1, len(w) - width + 1)) if w else ():
            strings[tuple(w[s: s + width])].add("null" if i is None else str(i))
    out = []
    for key, text in rows:
        w, hit, said = pat.findall((text or "").translate(low)), set(), set()
        for m in {len(s) for s in strings}:
            for s in range(len(w) - m + 1):
                if tuple(w[s: s + m]) in strings:
                    hit |= set(range(s, s + m))
                    said |= strings[tuple(w[s: s + m])]
        out.append((key, len(w), len(hit), len(said), sha(",".join(sorted(said)).encode()), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [4_000_000, 300])
def test_wu_manber(spark, odd, odd_rows, none, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    passage = next(r[1] for r in odd_rows if r[1] and 100 < len(r[1].split()) < 190 and not r[1].isupper()).split()
    items = [(1, " ".join(passage[3:30])), (2, ", ".join(passage[5:16]).upper()), (3, "one TWO"), (4, None), (5, ""), (6, "漢字 é"), (7, "a a a"), (7, "w1 w2 w3"), (None, "ü ñ"), (9, "zzz")]
    items += [(r[0], r[1]) for r in odd_rows[10:14]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_benchmark(odd, bench)
    got = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), decontaminate.item_digest(F.col("items")), F.col("n_hit") > 0)
    assert counted(got.collect()) == brute_benchmark([(r[0], r[1]) for r in odd_rows], items)
    assert all(sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_hit for r in found.collect())
    assert decontaminate.decontaminated(odd, bench).columns == odd.columns
    assert decontaminate.find_benchmark(odd, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_benchmark(none, bench).count() == 0


# 5 -------------------------------------------------------------------------------------------------------------------------------
def test_rules_and_propagation(spark):
    rows = [(1, "http://WWW.Example.com/en/x?q", None), (2, "https://a.example.com/en/", "<a href='http://far.org/x'>"), (3, "http://b.com/", ""), (4, "http://c.net/es/1", "<a HREF=//evil.org>"),
            (5, "http://d.net/de/1", '<a href="http://c.net/es/1">'), (6, None, "x"), (7, "no scheme", "x"), (8, "http://com/", ""), (9, "http://xcom/", ""), (10, "ftp://far.org#f", ""),
            (11, "http://evil.org", '<a href="http://c.net/"><a href="http://a.example.com/">'), (11, "http://evil.org", None), (None, "http://b.com", None)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, rank int")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urlfilter.judge_urls(pages).collect()}
    assert got[(1, "www.example.com", "/en/x")] == ("www.example.com/en/", "allow")
    assert got[(2, "a.example.com", "/en/")] == ("example.com/en/", "block")
    assert got[(3, "b.com", "/")] == ("com/", "allow") and got[(8, "com", "/")] == ("com/", "allow")
    assert got[(4, "c.net", "/es/1")] == ("net/es/", "block")
    assert got[(5, "d.net", "/de/1")] == (None, "block")  # links to a blocked host, and nobody trusted links to it
    assert got[(11, "evil.org", "")] == (None, "block")
    assert got[(6, "", "")] == (None, "allow") and got[(7, "", "")] == (None, "allow")
    assert got[(9, "xcom", "/")][0] is None and got[(None, "b.com", "")][0] is None
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------------------
def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark, odd, odd_rows, none):
    out = mixing.mix_sources(odd).collect()
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len(words_of(r[1]))
    goal = brute_targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], len(words_of(r[1]))) for r in odd_rows)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = mixing.mix_sources(odd.repartition(3)).select("doc_id", "size", "taken").collect()
    assert counted(again) == Counter((r.doc_id, r["size"], r.taken) for r in out)
    copies = mixing.mixed_documents(odd)
    assert copies.columns == odd.columns
    words = {r.source: r.n for r in copies.groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()}
    longest = defaultdict(int)
    for r in odd_rows:
        longest[r[3]] = max(longest[r[3]], len(words_of(r[1])))
    assert all(goal[s] - 1 <= words[s] <= goal[s] + longest[s] for s in sizes)
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_targets_by_brute_force(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 3, "d": 0, None: 40}, {"a": 1, "b": 1}, {"x": 0, "y": 0}, {f"s{i}": i * i for i in range(30)}, {"one": 5}):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want), (sizes, got, want)


# 7 and 8 -------------------------------------------------------------------------------------------------------------------------
def brute_words(rows, width=50):
    low = {}
    for key, text in rows:
        w = words_of(text)
        for s in range(len(w) - width + 1):
            if key is not None:
                k = tuple(w[s: s + width])
                low[k] = min(key, low.get(k, key))
    out = []
    for key, text in rows:
        w, gone = words_of(text), set()
        for s in range(len(w) - width + 1):
            if key is not None and low[tuple(w[s: s + width])] < key:
                gone |= set(range(s, s + width))
        out.append((key, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return Counter(out)


def test_recompression(odd, odd_rows, none):
    assert counted(recompression.dedup_substrings(odd).collect()) == brute_words([(r[0], r[1]) for r in odd_rows])
    assert recompression.dedup_substrings(none).count() == 0


def test_symbols_inside_equal_stretches_are_equal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        same = rng.integers(0, 4, 60).astype(np.uint64)
        parses = []
        for _ in range(2):
            left, right = rng.integers(0, 4, rng.integers(0, 30)), rng.integers(0, 4, rng.integers(0, 30))
            h = np.r_[left, same, right].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            name, start = recompression.symbols(h, np.array([0, len(h)]))
            stop = np.r_[start[1:], len(h)]
            assert (stop - start).max() <= recompression.LONGEST
            inside = (start - len(left) >= recompression.MARGIN) & (stop - len(left) <= len(same) - recompression.MARGIN)
            parses.append(list(zip((start[inside] - len(left)).tolist(), name[inside].tolist())))
        assert parses[0] == parses[1] and parses[0]


def brute_bytes(rows, width=400):
    seen = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - width + 1):
            seen[raw[s: s + width]] += 1
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            if seen[raw[s: s + width]] > 1:
                gone[s: s + width] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((key, len(raw), int(gone.sum()), runs, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return Counter(out)


@pytest.mark.parametrize("batches, few", [(1, 4096), (3, 2)])
def test_suffix_family(odd, odd_rows, none, batches, few):
    assert counted(suffixes.dedup_bytes(odd, batches=batches, few=few).collect()) == brute_bytes([(r[0], r[1]) for r in odd_rows])
    assert suffixes.dedup_bytes(none, batches=batches).count() == 0


def test_copies_are_one_context(spark):
    rng = random.Random(4)
    hot = prose(rng, 300)
    near = hot[:900] + "#" + hot[901:]
    rows = [(i, hot) for i in range(60)] + [(60, near), (61, prose(rng, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert counted(suffixes.dedup_bytes(docs).collect()) == brute_bytes(rows)
    batch = pa.RecordBatch.from_pydict({"text_id": pa.array([1, 1, 2, 1]), "text": pa.array(["a", "a", "b", "a"])})
    assert [b.num_rows for b in suffixes._once(iter([batch, batch]))] == [2, 0]
    a, b = prose(rng, 200)[:500].encode(), prose(rng, 200)[:500].encode()
    one = lambda content, raw: pa.RecordBatch.from_pydict({"anchor": pa.array([7] * 50), "content": pa.array([content] * 50), "bytes": pa.array([raw] * 50, pa.binary())})
    assert [b.num_rows for b in suffixes._compare(400)(iter([one(1, a), one(1, a), one(2, b)]))] == [0]  # a copy is no other content


def test_levels_are_of_different_sizes(odd):
    docs = odd.select(F.xxhash64("text").alias("text_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = docs.mapInArrow(suffixes._read(400, 128), "anchor long, content long, text_id long, start int, count int").cache()
    family = suffixes.SuffixFamily()
    for k in range(5):
        family.add(found.filter(F.pmod("text_id", F.lit(5)) == k))
    assert [n for n, _ in family.levels] == [4, 1]
    rows = found.distinct().collect()
    places, contents = defaultdict(set), defaultdict(set)
    for r in rows:
        places[r.anchor, r.content].add((r.text_id, r.start))
        contents[r.anchor].add(r.content)
    got = {(r.anchor, r.content): (r.again, r.differ) for r in family.whole().collect()}
    assert got == {k: (len(v) > 1, len(contents[k[0]]) > 1) for k, v in places.items()} and any(a for a, _ in got.values()) and any(d for _, d in got.values())


def test_sliding_min():
    rng = np.random.default_rng(2)
    for n, w in ((1, 1), (10, 3), (100, 7), (31, 31), (30, 31), (64, 8)):
        v = rng.integers(0, 1 << 60, n).astype(np.uint64)
        assert sliding_min(v, w).tolist() == [v[i: i + w].min() for i in range(n - w + 1)]


# 9 -------------------------------------------------------------------------------------------------------------------------------
def brute_nearest(rows, k, wanted):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, a in ok:
        if wanted(q):
            near = {(-float(vptree.cosines(a[None], b[None])[0]), i) for i, b in ok if i != q and len(b) == len(a)}
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(near)[:k])}
    return out


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(600 + i, hot) for i in range(200)] + [(900, [2 * x for x in hot])]
    rows += [(901, None), (902, []), (903, [0.0] * 8), (904, [float("nan")] * 8), (905, [None] + [1.0] * 7), (906, [float("inf")] * 8), (None, hot), (910, [1.0, 2.0]), (950, [2.0, 1.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    index = vptree.build_index(table, shard_rows=300)
    got = vptree.nearest(index, table.filter("vec_id % 50 = 0"), factor=1.0, block=7).collect()
    assert {tuple(r) for r in got} == brute_nearest(rows, 5, lambda i: i % 50 == 0) and len(got) == len({tuple(r) for r in got})
    assert vptree.nearest(vptree.build_index(table.limit(0)), table).count() == 0 and vptree.nearest(index, table.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_nearest_of_repeated_ids(spark, shard_rows):
    rng = np.random.default_rng(9)
    vector = lambda: rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, vector()) for i in range(1, 120)]
    rows += [rows[49]] * 40 + [rows[3]] * 25  # repeated rows, of a query and of a candidate
    near = np.array(rows[99][1], np.float32)
    rows += [(100, (near + np.float32(1e-3 * j)).tolist()) for j in range(1, 13)]  # more vectors of a query's id than are asked for
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = vptree.nearest(vptree.build_index(table, shard_rows=shard_rows), table.filter("vec_id % 50 = 0"), factor=1.0, block=7).collect()
    assert counted(got) == Counter(brute_nearest(rows, 5, lambda i: i % 50 == 0)) and len(got) == 5 * 14


def test_recall_of_the_registered_factor(spark, sf):
    table = spark.read.parquet(f"{sf}/../sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    queries = table.filter("vec_id % 50 = 0")
    want = {(q, i) for q, _, i, _ in brute_nearest(rows, 5, lambda i: i % 50 == 0)}
    got = {(r.query_id, r.vec_id) for r in vptree.nearest(vptree.build_index(table), queries).collect()}
    assert len(got & want) >= 0.9 * len(want)


# 10 ------------------------------------------------------------------------------------------------------------------------------
def brute_components(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        w = words_of(text, fold=True)
        sets.append({tuple(w[i: i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    forest = jaccard.Forest(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                forest.join(i, j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[forest.find(i)].append(key)
    low = {r: min((k for k in g if k is not None), default=None) for r, g in groups.items()}
    return Counter((k, len(s), low[forest.find(i)] if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("block, common, percent", [(2048, 64, 85), (8, 3, 85), (2048, 2, 70)])
def test_jaccard_components(odd, odd_rows, none, monkeypatch, block, common, percent):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COMMON", common)
    got = counted(jaccard.jaccard_components(odd, percent=percent).collect())
    assert got == brute_components([(r[0], r[1]) for r in odd_rows], percent=percent)
    assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize("paired", [2, 64])
def test_shared_passages_make_no_candidates(spark, monkeypatch, paired):
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "HELD_PAIRS", 50)
    rng = random.Random(8)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(150)
    texts = [own(200) + passage + own(200) for _ in range(30)]
    texts += [[w if rng.random() > 0.02 else "z" for w in t] for t in texts[:10]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    edges = {(r.a, r.b) for r in jaccard.candidate_edges(docs, "text", 5, 80).collect()}
    if paired == 64:  # each near copy with its source, and nothing by the passage
        assert len(edges) == 10
    got = counted(jaccard.jaccard_components(docs, width=5, percent=80).collect())
    assert got == brute_components([(i, " ".join(t)) for i, t in enumerate(texts)], 5, 80)


def test_no_linked_pair_is_missed_by_signatures():
    rng = np.random.default_rng(6)
    for size in (6, 7, 13, 40, 111, 300):
        for _ in range(30):
            a = rng.integers(0, 1 << 62, size).astype(np.uint64)
            most = int(0.15 / 1.85 * 2 * size)  # the largest symmetric difference of sets of this size
            b = np.r_[a[: size - most // 2], rng.integers(0, 1 << 62, most - most // 2 if rng.random() < 0.5 else most // 2).astype(np.uint64)]
            both = len(np.intersect1d(a, b))
            sigs = []
            for s in (a, b):
                _, _, sig, left = jaccard.signatures(np.sort(s), np.array([0, len(s)]))
                sigs.append(set(sig.tolist()))
            if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert sigs[0] & sigs[1]


def test_tree_links_by_brute_force():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = []
    for _ in range(80):
        keep = base[rng.random(60) < 0.96]
        sets.append(np.unique(np.r_[keep, rng.integers(0, 1 << 60, rng.integers(0, 6)).astype(np.uint64)]))
    forest, links = jaccard.tree_links(sets)
    want = np.zeros(80, int)
    brute = jaccard.Forest(80)
    for i in range(80):
        for j in range(80):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i != j and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                want[i] += 1
                brute.join(i, j)
    assert links.tolist() == want.tolist() and want.any()
    assert [forest.find(i) for i in range(80)] == [brute.find(i) for i in range(80)]


def test_sketches_lose_no_link():
    rng = np.random.default_rng(9)
    sets = []
    for size in (1, 5, 60, 64, 300):
        base = rng.integers(0, 1 << 62, 2 * size).astype(np.uint64)
        sets += [np.unique(rng.choice(base, max(1, int(size * rng.uniform(0.8, 1.2))), replace=False)) for _ in range(20)]
        sets += [np.unique(np.r_[base[: size], rng.integers(0, 1 << 62, k).astype(np.uint64)]) for k in range(size // 2)]
    sets.sort(key=len)
    n = np.array([len(x) for x in sets])
    for percent in (50, 80, 85):
        label = jaccard.sketch_links(n, [jaccard.sketch(x) for x in sets], percent)
        brute = jaccard.Forest(len(sets))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    assert label[i] == label[j]
                    brute.join(i, j)
        assert len(set(label.tolist())) > 20 or percent == 50
        assert len(set(label.tolist())) <= len({brute.find(i) for i in range(len(sets))})


def test_chains_of_candidates_are_split_before_sets_travel(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SKETCHED", 16, raising=False)
    compare = jaccard._group_links

    def noted(percent):
        run, to = compare(percent), str(tmp_path)

        def each(pdf):
            with open(f"{to}/{pdf.sid.min()}-{pdf.i.iloc[0]}-{pdf.j.iloc[0]}", "w") as f:
                f.write(str(pdf.sid.nunique()))
            return run(pdf)

        return each

    monkeypatch.setattr(jaccard, "_group_links", noted)
    rng = random.Random(12)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(150)
    texts = [own(40) + passage + own(40) for _ in range(120)]  # one group of candidates by signatures of the passage
    texts += [t[:20] + ["z"] + t[21:] for t in texts[:10]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (130, None), (131, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert counted(jaccard.jaccard_components(docs, width=5, percent=80).collect()) == brute_components(rows, 5, 80)
    sent = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sent) == 20  # the near copies and their sources, not all sets for each block


def test_connected(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(5, 9), (9, 1), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 5: 1, 9: 1, 200: 200, 201: 200}
