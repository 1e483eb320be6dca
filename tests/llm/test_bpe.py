import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessellum.llm import bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return t


def ours(texts):
    ids, per_text, _ = bpe.encoder(bpe.default_path()).encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(per_text)[:-1])]


PIECES = ["'", "'s", "'re", "'ll", "'LL", "don't", " ", "  ", "\n", "\t", "\r\n", "abc", "Zé", "12", "٣", "½", "!", "?!", "中文", "ไทย", " ", "　", "👩‍🔬", "́", "<|endoftext|>", "\x00", "\x85", "_", "=== x ==="]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=10).map("".join), min_size=1, max_size=6))
def test_equals_the_library(texts):
    t = Tokenizer.from_file(bpe.default_path()) if not hasattr(test_equals_the_library, "t") else test_equals_the_library.t
    t.encode_special_tokens = True
    test_equals_the_library.t = t
    clean = [x.encode("utf-8", "ignore").decode() for x in texts]
    assert ours(clean) == [e.ids for e in t.encode_batch(clean, add_special_tokens=False)]


def test_null_empty_and_long(library):
    long = "Koabre divides 3.5 spots; don't! " * 5000 + "中" * 3000
    got = ours([None, "", long, long])
    assert got[0] == got[1] == [] and got[2] == got[3] == library.encode(long, add_special_tokens=False).ids
    assert bpe.decode_ids(got[2]) == long


def test_round_trip_offsets_and_rows(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld's", 9), (1, "Hello  wörld's", 9), (None, None, 1), (3, "", 2)], "doc_id bigint, text string, ids int")
    out = bpe.encode(docs, offsets=True)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == 4 and sorted(len(r[1]) for r in rows)[:2] == [0, 0]
    first = next(r for r in rows if r[0] == 1)
    assert len(first[1]) == len(first[2]) and first[2][0] == 0
    assert {(r["doc_id"], r["text"]) for r in bpe.decode(out).collect()} == {(1, "Hello  wörld's"), (None, ""), (3, "")}
    assert bpe.encode(docs.limit(0)).count() == 0


def test_equal_hashes_are_told_apart(monkeypatch):
    from tessellum.llm import textbatch

    monkeypatch.setattr(textbatch.SliceHasher, "of", lambda self, start, stop: np.zeros(len(start), np.uint64))
    points = np.frombuffer("abcabxab".encode("utf-32-le"), np.uint32)
    code, first = textbatch.distinct_slices(points, np.array([0, 3, 6, 3]), np.array([2, 5, 8, 6]))
    assert code[0] == code[1] == code[2] != code[3] and len(first) == 2
