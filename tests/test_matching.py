"""The phrase index against a plain search."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import matching as M

ALPHABET = "ab cß漢İ😀Σ"


def plain(texts, phrases, fold):
    out = []
    for t, text in texts:
        hay = text.lower() if fold and text else text
        for p, phrase in phrases:
            needle = phrase.lower() if fold and phrase else phrase
            if hay and needle:
                out += [(t, p, i + 1, len(needle)) for i in range(len(hay) - len(needle) + 1) if hay.startswith(needle, i)]
    return sorted(out)


@pytest.fixture(scope="module")
def some():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    texts = [(i, word(rng.randrange(0, 60))) for i in range(80)] + [(100, None), (101, ""), (102, "aaaaaaaaaaaa"), (103, "x")]
    cut = lambda t: t[(a := rng.randrange(len(t))): a + rng.randrange(1, 25)]
    phrases = [(f"p{i}", cut(t)) for i, t in enumerate(t for _, t in texts[:60] if t)] + [("n", None), ("e", ""), ("aa", "aa"), ("aaa", "AaA"), ("again", "aa"), ("far", "zzzz"), ("x", "x")]
    return texts, phrases


@pytest.mark.parametrize("fold", [True, False])
@pytest.mark.parametrize("blocks", [1, 7])
def test_positions_and_counts(spark, some, fold, blocks, monkeypatch):
    texts, phrases = some
    monkeypatch.setattr(M, "BLOCK_CHARS", M.BLOCK_CHARS if blocks == 1 else 60)
    monkeypatch.setattr(M, "FEW_CHARS", M.FEW_CHARS if blocks == 1 else 0)
    monkeypatch.setattr(M, "FEW_PHRASES", M.FEW_PHRASES if blocks == 1 else 5)
    a, b = spark.createDataFrame(texts, "text_id int, text string").repartition(3), spark.createDataFrame(phrases, "phrase_id string, phrase string")
    want = plain(texts, phrases, fold)
    assert sorted(map(tuple, M.phrase_occurrences(a, b, fold).collect())) == want
    counts = {}
    for t, p, pos, _ in want:
        n, first = counts.get((t, p), (0, pos))
        counts[t, p] = n + 1, min(first, pos)
    assert {(r.text_id, r.phrase_id): (r.tf, r.pos) for r in M.phrase_counts(a, b, fold).collect()} == counts


def test_long_texts_are_read_in_parts(some, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(M, "SLICE_CHARS", 50)
    rng = random.Random(4)
    text = "".join(rng.choice("abc") for _ in range(3000))
    phrases = [text[i: i + n] for i, n in ((0, 3), (45, 12), (49, 40), (2990, 10), (100, 1))]
    index = M.PhraseIndex.build(pa.array(range(len(phrases))), phrases, M.gram_frequencies([]))
    got = sorted(zip(*[x.tolist() for x in index.search([text])]))
    assert got == sorted((0, p, i) for p, s in enumerate(phrases) for i in range(len(text)) if text.startswith(s, i))


def test_ids_of_any_type_and_nothing_to_find(spark, some):
    a = spark.createDataFrame([(1, "one two")], "k int, text string").select(F.struct("k", F.lit("x").alias("s")).alias("text_id"), "text")
    b = spark.createDataFrame([(["q"], "two")], "phrase_id array<string>, phrase string")
    r = M.phrase_occurrences(a, b).first()
    assert (r.text_id.k, r.phrase_id, r.pos, r["len"]) == (1, ["q"], 5, 3)
    assert M.phrase_occurrences(a, b.filter("false")).count() == 0 and M.phrase_counts(a.filter("false"), b).count() == 0


def test_rarest_gram(spark):
    import pyarrow as pa

    often = M.gram_frequencies(["abcdefgh" * 50])
    index = M.PhraseIndex.build(pa.array([7]), ["abcdefghXabcdefgh"[:12]], often)
    (n, (own, phrase, offset, _)), = index.entries.items()
    assert n == 8 and offset.tolist()[0] >= 1  # not the gram that is everywhere


def test_a_million_phrases_and_one_that_is_everywhere(spark):
    """Nothing is shuffled for the texts, and the work stays near linear."""
    n = 1_000_000
    phrases = spark.range(n).select(F.col("id").alias("phrase_id"), F.when(F.col("id") == 0, "common words").otherwise(F.concat(F.lit("k"), F.substring(F.md5(F.col("id").cast("string")), 1, 14))).alias("phrase"))
    texts = spark.range(3000).select(F.col("id").alias("text_id"), F.concat(
        F.lit("these are common words and k"), F.substring(F.md5((F.col("id") * 333).cast("string")), 1, 14), F.lit(" k"), F.md5(F.lit("z")), F.repeat(F.lit(" filler text"), 30)).alias("text"))
    began = time.time()
    counts = M.phrase_counts(texts, phrases)
    plan = counts._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
    found = counts.filter("phrase_id <> 0").select("text_id", "phrase_id").collect()
    assert counts.filter("phrase_id = 0").count() == 3000
    assert sorted((r.text_id, r.phrase_id) for r in found) == [(i, i * 333) for i in range(1, 3000)]
    assert time.time() - began < 240


def test_term_lists_are_cut_where_the_texts_lie(spark):
    from plumbline.operators import retrieval as S

    rng = random.Random(5)
    words = ["red", "green", "blue", "grey", "rose"]
    rows = [(i, "2020Q1", t, len(t)) for i, t in enumerate(" ".join(rng.choices(words, weights=[9, 5, 3, 2, 1], k=rng.randint(1, 9))) for _ in range(400))]
    rows += [(7, "2020Q1", "red red", 7), (7, "2020Q2", "red", 3), (None, "2020Q1", "red blue", 8), (900, "2020Q1", None, None), (901, "2020Q1", "rose", None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, period string, text string, n_chars int").repartition(5)
    queries = spark.createDataFrame([(1, "red rose"), (2, "blue"), (3, "e r"), (4, "grey green")], "query_id long, phrase string")
    terms = S.split_terms(queries).select(F.col("term").alias("phrase_id"), F.col("term").alias("phrase")).distinct()
    whole = S.best_first(S.phrase_scores(chunks, terms), "phrase_id", "bm25", 5)
    cut = S.top_scores(chunks, terms, 5)
    listed = lambda df: sorted(map(tuple, df.select("phrase_id", "rank", "id", "bm25").collect()))
    assert listed(S.best_first(cut, "phrase_id", "bm25", 5)) == listed(whole)
    assert cut.count() < S.phrase_scores(chunks, terms).count() / 3
    none = chunks.filter("chunk_id < 0")
    assert S.search_terms(none, queries).count() == 0
