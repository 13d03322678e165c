"""Byte-level BPE encoding and decoding: a segment tree over the bytes of a piece finds the next merge."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import methodcaller

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurix.llm.common import per_batch, record_batch

#: Pieces that a worker remembers at a time, and the longest of them in characters.
MEMO, SHORT = 400_000, 64
#: The key of a byte at which no pair starts that could be merged; others are the pair's rank, then its place.
NONE, PLACE = (1 << 62), 32


def grown(keys: list[int]) -> list[int]:
    """A segment tree over byte positions: leaf i, at len(keys) + i, holds the key of the pair that starts at byte i, an
    inner node the smaller of its two children, so that the root, at 1, is the leftmost pair of the least rank."""
    n = len(keys)
    tree = [NONE] * n + keys
    for i in range(n - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    return tree


def put(tree: list[int], node: int, key: int) -> None:
    """Changes a leaf, and the nodes above it up to the first that stays as it is."""
    tree[node] = key
    while node > 1:
        other = tree[node ^ 1]
        least = key if key < other else other
        node >>= 1
        if tree[node] == least:
            return
        tree[node] = key = least


class Pieces(dict):
    """The ids of a piece, as unsigned 32-bit numbers in little-endian order, for a vocabulary of byte strings and ranks."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        if any(bytes([x]) not in self.ranks for x in range(256)):
            raise ValueError(f"{path}: not every byte has a rank")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)

    def merged(self, raw: bytes) -> list[int]:
        """Ids of a piece of at least two bytes. `after` and `before` link the starts of the parts that are left. A merge
        changes three leaves: its own pair, that of the part before it, and that of the part it swallowed."""
        n, rank, place = len(raw), self.ranks.get, (1 << PLACE) - 1
        leaves = n - 1
        found = [rank(raw[i : i + 2], NONE) for i in range(leaves)]
        tree = grown([NONE if r == NONE else r << PLACE | i for i, r in enumerate(found)])
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (top := tree[1]) < NONE:
            i = top & place
            gone = after[i]
            after[i] = then = after[gone]
            before[then] = i
            if gone < leaves:  # the last byte starts no pair and has no leaf
                put(tree, leaves + gone, NONE)
            r = NONE if then == n else rank(raw[i : after[then]], NONE)
            put(tree, leaves + i, NONE if r == NONE else r << PLACE | i)
            if i:
                j = before[i]
                r = rank(raw[j:then], NONE)
                put(tree, leaves + j, NONE if r == NONE else r << PLACE | j)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[raw[i : after[i]]])
            i = after[i]
        return ids

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.ranks.get(raw)  # a piece that is a token is that token, however merges would build it
        ids = struct.pack("<I", whole) if whole is not None else struct.pack(f"<{len(m := self.merged(raw))}I", *m)
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of all pieces of the text; what the pattern leaves out has none."""
        if len(self) > MEMO:
            self.clear()
        return b"".join(map(self.__getitem__, map(methodcaller("group"), self.pattern.finditer(text))))

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The bytes of the ids, some at a time."""
        numbers = np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), 1 << 16):
            yield b"".join(map(self.tokens.__getitem__, numbers[at : at + (1 << 16)].tolist()))


@lru_cache(1)
def pieces(path: str, pattern: str) -> Pieces:
    return Pieces(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` for each row of `docs`, by a file of tokens and ranks and a pattern of
    pieces. Each task reads the file by itself; nothing is shuffled.

    A null or empty text has no tokens, and the digests of nothing. Rows are independent: null and repeated ids stay as
    they are, an empty table gives an empty one, and only doc_id and text are looked at. A piece of n bytes takes
    n log n steps, so a text without blanks is no worse than others by more than the logarithm.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, out = pieces(ranks, pattern), []
        for text in batch.column("text"):
            ids, decoded = p.encode(text.as_py() or ""), hashlib.sha256()
            for raw in p.decode(ids):
                decoded.update(raw)
            out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
        n, a, d = zip(*out, strict=True) if out else ((), (), ())
        return record_batch({"doc_id": (batch.column("doc_id"), pa.int64()), "n_tokens": (list(n), pa.int64()), "ids_sha256": (list(a), pa.string()), "decoded_sha256": (list(d), pa.string())})

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
