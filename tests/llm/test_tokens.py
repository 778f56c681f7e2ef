import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import bpe, queries, tokenfile
from tests.llm.helpers import ODD_ROWS, SF, no_docs, odd_docs

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(queries.vocab_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.read_spec(queries.vocab_path()))


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("abcthe 'sΣé\t\n.,12$%漢́")), max_size=60))
def test_encode_as_the_library(own, whole, text):
    ids = whole.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == whole.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [t or "" for _, t, _ in ODD_ROWS])
def test_odd_texts(own, whole, text):
    assert own.encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_bpe_query_against_library(spark, whole):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_of_rows(spark, own, whole):
    coded = bpe.encode(odd_docs(spark), queries.vocab_path())
    back = bpe.decode(coded, queries.vocab_path()).collect()
    assert len(back) == len(ODD_ROWS)
    assert sorted(r["text"] for r in back) == sorted(whole.decode(whole.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t, _ in ODD_ROWS)
    assert bpe.digests(no_docs(spark), queries.vocab_path()).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=400), st.integers(1, 32))
def test_blocks_round_trip(ids, bits):
    x = np.array(ids, np.uint32) & np.uint32(2**bits - 1)
    x[::50] = ids[0]  # outliers
    assert (tokenfile.unpack_block(tokenfile.pack_block(x)) == x).all()


def test_ranges_of_a_segment():
    x = np.random.default_rng(1).integers(0, 50_000, 5000).astype(np.uint32)
    blocks, payload = tokenfile.pack(x)
    for start, n in ((0, 5000), (1023, 2), (4999, 1), (10, 0), (1024, 1024)):
        assert (tokenfile.read_range(blocks, payload, start, n) == x[start : start + n]).all()


def _expected(rows, whole):
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_query_against_library(spark, whole):
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op4_token_files(spark, SF).collect())
    assert got == _expected(rows, whole)


def test_files_of_odd_rows(spark, whole, tmp_path):
    tokenfile.write(odd_docs(spark), queries.vocab_path(), str(tmp_path / "a"))
    got = sorted((tuple(r) for r in tokenfile.digests(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert got == _expected([(d, t or "") for d, t, _ in ODD_ROWS], whole)
    tokenfile.write(no_docs(spark), queries.vocab_path(), str(tmp_path / "b"))
    assert tokenfile.digests(spark, str(tmp_path / "b")).count() == 0


@pytest.fixture(scope="module")
def files():
    return tokenfile.WordTokenizer("-", bpe.read_spec(queries.vocab_path()))


def test_all_code_points_as_the_library(own, whole, files):
    """Code points, assigned or not, inside a word and before a mark: all of the first three planes, some of the others."""
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x30000), *range(0x30000, 0x110000, 211))]
    for lo in range(0, len(points), 20_000):
        texts = [t for c in points[lo : lo + 20_000] for t in (f"a{c}b {c},",)]
        want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
        assert [bpe.numbers(e).tolist() for e in own.encoded(texts)] == want
        assert [np.frombuffer(x, "<u4").tolist() for x in files.ids(texts)] == want


@pytest.mark.parametrize("text", ["x İ, y", "İ. İSTANBUL'da", "<|ENDOFTEXT|> a", "<|endoftext|><|STARTOFTEXT|>", "ŉ, ǅ, ﬀ.", "é, Ȩ́́.", "ΣΑΣ. ΑΣ, Σ", "a b\u0085c d　e", "Ĳ. ÿ, Ÿ,"])
def test_case_and_marks_as_the_library(own, whole, files, text):
    want = whole.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert np.frombuffer(files.ids([text])[0], "<u4").tolist() == want


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("abthİıſßéÉΣ '́̇.,:12<|>")), max_size=30), max_size=5))
def test_files_as_the_library(whole, files, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in files.ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
