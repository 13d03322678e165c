from __future__ import annotations

import hashlib
import random
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import no_documents, odd_documents
from tokenizers import Tokenizer

from tellurix.llm import bpe
from tellurix.llm.queries import WORD_BPE

WHOLE = Tokenizer.from_file(WORD_BPE)
ODD = "aé́ßİΣς'sd 1２x   \u0085\x1c\n\t\r\x0b\x0c<|endoftext|>́가😀﻿#$"


def whole(text):
    ids = WHOLE.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(WHOLE.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_give_the_ids_of_the_whole_text(text):
    w = bpe.words(WORD_BPE)
    assert w.digests(w.encode(text.encode())) == whole(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aZéİßſǅɐΣ́1'!#$~<>=\"", min_size=1, max_size=8), max_size=12))
def test_letters_with_marks_behind_them(parts):
    w = bpe.words(WORD_BPE)
    assert w.marks == bpe.MARKS and w.digests(w.encode(" ".join(parts).encode())) == whole(" ".join(parts))


def test_marks_stay_with_words_where_a_token_joins_them(tmp_path):
    t = Tokenizer.from_file(WORD_BPE)
    t.add_tokens(["o!"])
    t.save(f"{tmp_path}/joined.json")
    w = bpe.Words(f"{tmp_path}/joined.json")
    assert w.marks == b"" and w.encode(b"foo!") == np.array(t.encode("foo!", add_special_tokens=False).ids, w.kind).tobytes()


def test_borders_depend_on_what_stands_before_them():
    r = random.Random(1)
    passage = " ".join(f"w{r.randint(0, 999)}" for _ in range(4000)).encode()
    a, b = set(bpe.borders(passage)), {x - 777 for x in bpe.borders(b"x" * 777 + passage)}
    assert len(a & b) > 0.9 * len(a) and max(a) == len(passage) and bpe.borders(b"") == []


def check(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    out = bpe.encode(docs, spark, WORD_BPE).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr((r.doc_id, *whole(r.text))) for r in rows)


def test_shared_chunks_copies_and_texts_without_blanks(spark):
    r = random.Random(2)
    passage = "".join(r.choice(ODD + "    etaoin") for _ in range(12000))
    rows = [(i, passage[i * 13 :] + f" tail {i} " + passage[: 3000 + i]) for i in range(12)] + [(100 + i, passage) for i in range(40)]
    rows += [(200, passage + passage), (201, "x" * 20000), (202, "".join(r.choice("abc") for _ in range(9000))), (203, "ß́" * 4000)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_documents(spark):
    check(spark, odd_documents(spark))
    assert bpe.encode(no_documents(spark), spark, WORD_BPE).count() == 0


def test_joins_are_repaired_until_they_agree():
    """Chunks have ids of their own for the pieces of words at their borders, which are not those of the text."""
    w, r = bpe.Words(WORD_BPE), random.Random(3)
    raw = " ".join("".join(r.choice("etaoinshrdluéß가") for _ in range(r.randint(1, 12))) for _ in range(4000)).encode()
    at, ids, dropped, differ = 0, b"", 0, 0
    for start, end in pairwise([0, *bpe.borders(raw)]):
        own, size = w.encode(raw[start:end]), w.kind().itemsize
        a, b, head, tail = w.repaired(raw, start, end)
        held = own[head * size : len(own) - tail * size]
        assert held == w.encode(raw[a:b]) and start <= a <= b <= end
        ids += w.encode(raw[at:a]) + held
        at, dropped = b, dropped + head + tail
        differ += bool(head) and own[:size] != w.encode(raw[raw.rindex(b" ", 0, start) + 1 : a])[:size]
    assert w.digests(ids + w.encode(raw[at:])) == whole(raw.decode()) and dropped > 20 and differ > 10


def test_shared_chunks_come_with_cut_words(spark):
    """The same passage behind openings of different lengths: its chunks are borrowed, and words at their borders cut."""
    r = random.Random(4)
    passage = "-".join("".join(r.choice("etaoin") for _ in range(9)) + (" " if r.random() < 0.3 else "") for _ in range(3000))
    check(spark, spark.createDataFrame([(i, "ab" * i + passage + "x" * i) for i in range(8)], "doc_id long, text string"))


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Words(public_tokenizers.path("byte_bpe_50k.json"))
