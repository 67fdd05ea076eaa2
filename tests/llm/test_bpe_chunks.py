import hashlib
import random

import pytest
from tokenizers import Tokenizer

from weftgraph.llm import bpe_chunks as B

PARTS = [" ", "  ", "\n", "\t", "<|endoftext|>", "don't", "'s", "abc", "é", "1234", "...", "日本語", " x", "\x1c", "\x85", "　", "'", "re", "👩‍👩", "\r\n", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(B.tokenizer_path())


def test_any_text_as_the_library(library):
    rng = random.Random(1)
    reader = B.Reader(B.codec(B.tokenizer_path()), {})
    for n in (0, 1, 2, 40, 700, 700, 5000):
        for _ in range(40 if n < 5000 else 4):
            text = "".join(rng.choice(PARTS) for _ in range(n))
            ids = reader.encode(text)
            assert ids == library.encode(text, add_special_tokens=False).ids
            assert reader.tokens.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for text in ("x" * 20_000, "ab" * 9000 + " c", " " * 9000, "\n" * 300 + "a"):
        assert reader.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_shared_chunks_have_one_cut_and_are_reused():
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randint(0, 999)}" for _ in range(6000))
    cuts = [{passage[a:b] for a, b in zip([0, *e], e, strict=False)} for e in [B.chunk_ends(passage)]][0]
    moved = "other words before " * 30 + passage
    again = {moved[a:b] for a, b in zip([0, *B.chunk_ends(moved)], B.chunk_ends(moved), strict=False)}
    assert len(cuts & again) >= len(cuts) - 2 and len(cuts) > 5
    reader = B.Reader(B.codec(B.tokenizer_path()), {})
    reader.encode(passage)
    reader.encode(moved)
    assert reader.reused >= len(cuts) - 2


def test_query(spark, awkward, nothing, folder, library):
    rows = B.op2_bpe_chunks(spark, folder(documents=awkward)).collect()
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    assert len(rows) == 13
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert B.op2_bpe_chunks(spark, folder(documents=nothing)).collect() == []


def test_dictionary_bound_changes_no_id(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = B.tokenizer_path()
    many = docs.union(docs).union(docs)
    assert B.dictionary(many, path) and len(B.dictionary(many, path, 5000)) <= 5000 // B.LEAST
    one, three = B.encode_decode(docs, path).collect(), B.encode_decode(many, path).distinct().collect()
    assert sorted(one) == sorted(three)
