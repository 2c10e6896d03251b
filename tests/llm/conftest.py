import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts with every trouble: nulls, empties, one very long text, copies, near copies, shared passages, runs, repeated rows."""
    rng = random.Random(5)
    passage, base = prose(rng, 70), prose(rng, 150)
    texts = [None, "", "   \n\t", "One", "one two", "one two three", "ONE two three", "é ü ñ 漢字 é ü ñ 漢字", "a " * 300, "a " * 120 + "b", "ab" * 700, "-" * 900]
    texts += [prose(rng, rng.randrange(1, 260)) for _ in range(30)]
    texts += [prose(rng, rng.randrange(5, 60)) + " " + passage + " " + prose(rng, rng.randrange(5, 60)) for _ in range(12)]
    texts += [base] * 9
    for _ in range(25):  # near copies
        w = base.split(" ")
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [prose(rng, 9000) + " " + passage, base.upper(), base.replace(" ", "\n"), passage * 3]
    rng.shuffle(texts)
    rows = [(i * 3, t, "en", (None, "src1", "src2", "hot", "hot", "hot")[i % 6], len(t or ""), 7, 0.5) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[20]]  # repeated rows
    rows.append((None, base, "en", "hot", 1, 7, 0.5))  # no key
    rows.append((rows[7][0], prose(rng, 80), "en", "hot", 1, 7, 0.5))  # a key with another text
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Extra columns ``size`` and ``score`` clash with names the operators use."""
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
