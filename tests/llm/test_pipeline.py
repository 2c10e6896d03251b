"""The pipeline, and that the rest of the library works without it."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, jaccard, quality
from plumbline.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import brute_components

REPO = Path(corpus_pipeline.__file__).parent


def test_one_query_per_operator():
    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in QUERIES) == 1] == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES) and [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_stages(spark, sf, tmp_path):
    docs = corpus_pipeline.table(spark, sf, "documents")
    labels, bench = corpus_pipeline.table(spark, sf, "labels"), corpus_pipeline.table(spark, sf, "benchmark")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if i == 0:
            kept = {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
            assert set(ids) == kept and 0 < len(ids) < before
        elif i == 1:
            want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert sorted(ids) == sorted(k for k, _, low in want if k == low)
        elif i == 2:
            hit = decontaminate.find_benchmark(docs, bench).filter("n_hit > 0").count()
            assert len(ids) == before - hit
        elif i == 4:
            assert len(ids) == before and {r.shard for r in out.collect()} <= set(range(24))
        docs = out


def test_near_duplicates_from_four_fifths_on(spark, sf):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    near = words[:94] + [f"x{i}" for i in range(10)]  # 90 of them shared, of 110: 0.818
    far = words[:90] + [f"y{i}" for i in range(14)]  # 86 of 114: 0.754
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, near, far))], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, sf).collect()) == [0, 2]


def test_one_per_component_of_odd_rows(odd, odd_rows, none):
    out = jaccard.one_per_component(odd)
    assert out.columns == odd.columns
    got = sorted((r.doc_id, r.text) for r in out.filter("doc_id is not null").collect() if (r.text or "").split())
    want = {(r[0], r[1]) for r, (k, n, low) in zip(odd_rows, _in_order(odd_rows)) if n and k == low}
    assert got == sorted(want)
    bare = sum(not (r[1] or "").split() for r in odd_rows)
    assert sum(not (r.text or "").split() for r in out.collect()) == bare
    assert jaccard.one_per_component(none).count() == 0


def _in_order(rows):
    """Key, shingles and component of each row, in the order of the rows."""
    out, seen = [], brute_components([(r[0], r[1]) for r in rows])
    by_text = {}
    for i, r in enumerate(rows):  # one row at a time beside all others
        by_text.setdefault((r[0], r[1]), None)
    for r in rows:
        n = len(_shingles(r[1]))
        low = next(c for (k, m, c) in seen if k == r[0] and m == n)
        out.append((r[0], n, low))
    return out


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i: i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


@pytest.mark.parametrize("gone", [["corpus_pipeline.py"], ["corpus_pipeline.py", "plumbline/llm"]])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    for p in ("__spark_entry__.py", "plumbline", "corpus_pipeline.py"):
        if p not in gone:
            (tmp_path / p).symlink_to(REPO / p) if p != "plumbline" else (tmp_path / p).mkdir()
    for p in (REPO / "plumbline").iterdir():
        if f"plumbline/{p.name}" not in gone:
            (tmp_path / "plumbline" / p.name).symlink_to(p)
    entry = (REPO / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [x for x in q if x.startswith('op') and x[2].isdigit()] and 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
