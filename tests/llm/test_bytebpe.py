from __future__ import annotations

import base64
import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import LONG, no_documents, odd_documents

from tellurix.llm import bytebpe
from tellurix.llm.queries import BYTE_BPE

PATTERN = public_tokenizers.PATTERN
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache
def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(path, text):
    return np.frombuffer(bytebpe.pieces(path, PATTERN).encode(text), "<u4").tolist()


@pytest.mark.parametrize("path", [BYTE_BPE, MULTI])
@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aeiou tnsr\n\x1c\u0085'12é😀가́<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_ids_are_those_of_the_library(path, text):
    assert ids_of(path, text) == library(path).encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" * 30000, " " * 9999 + "y", "9" * 20001, "".join(random.Random(1).choice("abcdeir") for _ in range(30000)), "가나" * 9000, LONG, "ab"])
def test_long_pieces(text):
    assert ids_of(BYTE_BPE, text) == library(BYTE_BPE).encode_ordinary(text)


def test_all_characters_fall_into_the_pieces_of_the_library():
    for start in range(0, 0x110000, 0x800):
        if not 0xD800 <= start < 0xE000:
            text = "".join(f"a{chr(c)}1 {chr(c)}" for c in range(start, start + 0x800))
            assert ids_of(BYTE_BPE, text) == library(BYTE_BPE).encode_ordinary(text)


def test_the_tree_keeps_the_leftmost_least_key():
    r = random.Random(2)
    for n in range(1, 40):
        keys = [r.randint(0, 5) << bytebpe.PLACE | i for i in range(n)]
        tree = bytebpe.grown(keys)
        for _ in range(60):
            assert tree[1] == min(keys)
            i = r.randrange(n)
            keys[i] = r.choice([bytebpe.NONE, r.randint(0, 5) << bytebpe.PLACE | i])
            bytebpe.put(tree, n + i, keys[i])


def check(spark, docs):
    rows = docs.select("doc_id", "text").collect()

    def plain(doc_id, text):
        ids = library(BYTE_BPE).encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library(BYTE_BPE).decode_bytes(ids)).hexdigest()

    out = bytebpe.encode(docs, BYTE_BPE, PATTERN).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr(plain(r.doc_id, r.text)) for r in rows)


def test_documents(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    check(spark, odd_documents(spark))
    assert bytebpe.encode(no_documents(spark), BYTE_BPE, PATTERN).count() == 0


def test_texts_come_back_from_their_ids():
    p = bytebpe.pieces(BYTE_BPE, PATTERN)
    for text in (LONG, "é😀\n\n  don't 12", ""):
        assert b"".join(p.decode(p.encode(text))) == text.encode()


def test_a_vocabulary_without_all_bytes_is_refused(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        bytebpe.Pieces(str(tmp_path / "v"), PATTERN)
