"""Merge rounds against the library itself, on every kind of text that needs care."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from plumbline.llm import sentencepieces as sp
from plumbline.llm.queries import QUERIES, piece_model
from tests.llm.conftest import COLUMNS


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def difficult():
    rng = random.Random(1)
    texts = [None, "", " ", "  ", "   \n\t x", "a", "the the therapy", "▁", "▁▁x ▁", "\x00", "a\x00b", "漢字かな 벨梦 ﬁ Ａ 😀😀 é", "é", "<s></s><unk><0x41>"]
    texts += [" " * k for k in range(1, 60)] + ["x" + " " * k + "the" for k in range(1, 40)] + ["a" * k for k in (2, 3, 17, 399, 400, 401, 3000)]
    texts += ["".join(rng.choice("etaoinshrdlu th") for _ in range(rng.randrange(1, 700))) for _ in range(80)]
    texts += ["".join(rng.choice(["the", "on", "in", "ing", "t", "h"]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]  # long words
    kinds = ((1, 128), (128, 0x3000), (0x3000, 0xD7FF), (0x10000, 0x10FFFF))
    texts += ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("window", [sp.WINDOW, 97])
def test_rounds_equal_the_library(library, window):
    texts, v = difficult(), sp.vocabulary(sp.model_bytes(piece_model()))
    parts, counts = [], np.zeros(len(texts), np.int64)
    for ids, n in sp.encode_windows(v, texts, window):
        parts.append(ids)
        counts += n
    if window < 1000:  # windows of one text come one after the other, so the ids lie in the order of the texts
        assert len(parts) > 10
    ids, at = np.concatenate(parts), np.r_[0, np.cumsum(counts)]
    raw, ends = sp.decode_ids(v, ids, counts)
    for i, text in enumerate(texts):
        want = library.encode(text or "")
        assert ids[at[i]: at[i + 1]].tolist() == want, text
        assert raw[ends[i]: ends[i + 1]].tobytes().decode() == library.decode(want), text


def test_rows(spark, library, odd, odd_rows, none):
    model = piece_model()
    out = sp.decoded(sp.encoded(odd, model), model).collect()
    assert len(out) == len(odd_rows)
    want = sorted((repr(r[0]), tuple(library.encode(r[1] or "", add_eos=True)), library.decode(library.encode(r[1] or ""))) for r in odd_rows)
    assert sorted((repr(r.doc_id), tuple(r.ids), r.text) for r in out) == want
    assert sp.decoded(sp.encoded(none, model), model).count() == 0
    clash = spark.createDataFrame([(1, "a b", 5, [7])], "key long, text string, ids long, symbol array<int>")
    assert sp.encoded(clash, model, key="key").collect()[0].asDict() == {"key": 1, "ids": library.encode("a b", add_eos=True)}


def test_words_of_one_hash_stand_for_themselves():
    first, length = np.array([0, 2, 4]), np.array([2, 2, 2])
    one, like = sp._distinct(np.array([5, 6, 5, 6, 5, 7], np.uint32), first, length)
    assert like[0] == like[1] != like[2] and len(one) == 2


def test_query(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op13_merge_rounds"](spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = library.encode(docs[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
