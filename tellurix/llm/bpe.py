"""BPE encoding and decoding with reuse of content-defined chunks: a chunk that stands in several places is encoded
once, as it stands, and where its borders cut words, the joins are repaired."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurix.llm.common import Scratch, per_batch, record_batch

#: A chunk ends where the hash of the last 32 bytes has MEAN_BITS zero bits, and has LEAST bytes or more.
MEAN_BITS, LEAST = 10, 256
#: Encoded words that a worker remembers at a time.
MEMO = 400_000
GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)
WORDS = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
SPACES = b" \t\n\r\x0b\x0c"
#: Marks that may stand behind a word's letters and leave their ids as they are; tried out for each tokenizer.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def borders(raw: bytes) -> list[int]:
    """Ends of a text's chunks. They depend on the bytes before them only, so that the same passage is cut alike in
    any text, some bytes after its start. An end within a character's bytes moves behind them."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # each doubles the window
        if len(h) > step:
            h[step:] += h[:-step] << np.uint32(step)
    ends, last = [], 0
    for end in (np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist():
        if end - last >= LEAST:
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            ends.append(end)
            last = end
    if last < len(raw):
        ends.append(len(raw))
    return ends


def body(raw: bytes, start: int, end: int) -> tuple[int, int] | None:
    """The part of a chunk from its first to its last white space: whole words, whatever stands around the chunk."""
    space = np.flatnonzero(IS_SPACE[np.frombuffer(raw, np.uint8, end - start, start)])
    return (start + int(space[0]), start + int(space[-1])) if len(space) > 1 else None


def latin(word: bytes) -> bool:
    """Latin letters only, in lower case too, none of which joins with a mark behind it."""
    text = word.decode().lower()
    return text.isalpha() and (text.isascii() or max(text) < "\u0250")


class Words(dict):
    """A word's ids, as 2 or 4 bytes each. White space ends every piece that merges can reach in such a tokenizer, so a
    word's ids are the same in every text; that this is so is tried out on its own pieces when it is read."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tried(path)
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if n <= 1 << 16 else np.uint32
        self.decimal = [str(i).encode() for i in range(n)]
        self.piece = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(n)]

    def plain(self, raw: bytes) -> list[int]:
        return self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids

    def tried(self, path: str) -> None:
        """Raises unless words around each kind of white space have the ids that they have alone, and ids decode to their
        pieces with blanks between: tried on pieces from all over the vocabulary, in ASCII and other scripts, and on marks."""
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        probes = [self.tokenizer.id_to_token(i) or "" for i in range(0, n, max(1, n // 300))] + ["don't", "a.b,c", "１２", "é", "x\u00a0y", "#", "😀"]
        probes = [x.encode() for p in probes for x in p.split()]
        alone = [self.plain(x) for x in probes]
        for space in (" ", "\n", "\t", "\r", "\x0b", "\x0c", "  \n"):
            if self.plain(space.join(x.decode() for x in probes).encode()) != [i for ids in alone for i in ids] or self.plain(space.encode()):
                raise ValueError(f"{path}: a word's ids depend on what stands beyond {space!r}")
        letters = [x for x in probes if latin(x)]
        behind = [MARKS[i : i + 1] * k for i in range(len(MARKS)) for k in (1, 2, 3)] + [MARKS, MARKS[::-1]]
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        own = all(self.plain(x + m) == self.plain(x) + self.plain(m) for x in letters[:5] for m in behind)
        own = own and all(self.plain(t) == self.plain(x) + self.plain(t[len(x) :]) for t in added if latin(x := t.rstrip(MARKS)))
        self.marks = MARKS if own and all(self.plain(x + b"#,") == self.plain(x) + self.plain(b"#,") for x in letters) else b""
        ids = [i for some in alone for i in some]
        if self.tokenizer.decode(ids, skip_special_tokens=False) != " ".join(self.tokenizer.id_to_token(i) or "" for i in ids):
            raise ValueError(f"{path}: not a tokenizer that decodes to its pieces with blanks between")

    def repaired(self, raw: bytes, start: int, end: int) -> tuple[int, int, int, int]:
        """Where in a text the ids of the chunk at `start` to `end` hold, and how many of those that it has by itself come
        before and after. From a border inwards, the text's words and the chunk's are compared until one has the same
        place in both, and so the same ids; the ids of the chunk's words before it are dropped, and the text's own are
        encoded again with what stands around. As no word's ids depend on another, that is the word the border cuts."""
        first, last = body(raw, start, end)
        cut = [0 < at < len(raw) and not IS_SPACE[raw[at - 1]] and not IS_SPACE[raw[at]] for at in (start, end)]
        head, tail = (len(self.encode(x)) // self.kind().itemsize if c else 0 for x, c in zip((raw[start:first], raw[last:end]), cut, strict=True))
        return (first if cut[0] else start, last if cut[1] else end, head, tail)

    def __missing__(self, word: bytes) -> bytes:
        """Letters with marks behind them are put together from the two, which fewer of are new."""
        core = word.rstrip(self.marks) if self.marks else word
        if core and len(core) < len(word) and latin(core):
            return self[core] + self[word[len(core) :]]
        self[word] = ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        return ids

    def encode(self, raw: bytes) -> bytes:
        if len(self) > MEMO:
            self.clear()
        return b"".join(map(self.__getitem__, raw.split()))

    def digests(self, ids: bytes) -> tuple[int, str, str]:
        numbers = np.frombuffer(ids, self.kind).tolist()
        a = hashlib.sha256(b" ".join(map(self.decimal.__getitem__, numbers))).hexdigest()
        return len(numbers), a, hashlib.sha256(b" ".join(map(self.piece.__getitem__, numbers))).hexdigest()


@lru_cache(1)
def words(path: str) -> Words:
    return Words(path)


def chunks(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, starts, ends = [], [], []
    for text in batch.column("text").to_pylist():
        raw = (text or "").encode()
        own = [(a, b) for a, b in pairwise([0, *borders(raw)]) if body(raw, a, b)]
        hashes.append([xxhash.xxh3_128_digest(raw[a:b]) for a, b in own])
        starts.append([a for a, _ in own])
        ends.append([b for _, b in own])
    types = {"hash": pa.binary(), "from": pa.int32(), "to": pa.int32()}
    lists = {n: (v, pa.list_(types[n])) for n, v in zip(types, (hashes, starts, ends), strict=True)}
    return record_batch({"key": (batch.column("key"), pa.string()), "doc_id": (batch.column("doc_id"), pa.int64())} | lists)


def encoded(path: str):
    """Encodes what is a text's own, and the shared chunks that it is to give to others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, z = words(path), zstandard.ZstdCompressor(1)
        for b in batches:
            cols = {k: [] for k in ("n", "ids_sha256", "decoded_sha256", "own", "need", "head", "tail", "gave_hash", "gave")}
            for text, shared in zip(b.column("text").to_pylist(), b.column("shared").to_pylist(), strict=True):
                raw = (text or "").encode()
                at, run_, own, need, head, tail, gave, size = 0, [], [], [], [], [], {}, w.kind().itemsize
                for s in shared or []:
                    if s["owned"]:
                        gave[s["hash"]] = w.encode(raw[s["from"] : s["to"]])
                    start, end, skip, drop = w.repaired(raw, s["from"], s["to"])
                    run_.append(w.encode(raw[at:start]))
                    if s["hash"] in gave:
                        run_.append(gave[s["hash"]][skip * size : len(gave[s["hash"]]) - drop * size])
                    else:
                        own.append(b"".join(run_))
                        need.append(s["hash"])
                        head.append(skip)
                        tail.append(drop)
                        run_ = []
                    at = end
                run_.append(w.encode(raw[at:]))
                done = w.digests(b"".join(run_)) if not need else (None, None, None)
                own.append(b"".join(run_))
                for k, v in zip(cols, (*done, [z.compress(x) for x in own] if need else None, need or None, head, tail, list(gave), [z.compress(x) for x in gave.values()]), strict=True):
                    cols[k].append(v)
            types = (pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.binary())] * 2, *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.binary())] * 2)
            yield record_batch({"key": (b.column("key"), pa.string())} | {k: (v, t) for (k, v), t in zip(cols.items(), types, strict=True)})

    return run


def joined(path: str):
    """Puts own and borrowed ids together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, z = words(path), zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for own, got in zip(b.column("own").to_pylist(), b.column("got").to_pylist(), strict=True):
                ids = [z.decompress(own[0])]
                for x, after in zip(got, own[1:], strict=True):
                    lent, size = z.decompress(x["ids"]), w.kind().itemsize
                    ids += [lent[x["head"] * size : len(lent) - x["tail"] * size], z.decompress(after)]
                out.append(w.digests(b"".join(ids)))
            n, a, d = zip(*out, strict=True) if out else ((), (), ())
            yield record_batch({"key": (b.column("key"), pa.string()), "n": (list(n), pa.int64()), "ids_sha256": (list(a), pa.string()), "decoded_sha256": (list(d), pa.string())})

    return run


def encode(docs: DataFrame, spark: SparkSession, tokenizer: str) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are dropped): doc_id, n_tokens, ids_sha256, decoded_sha256, the
    digests being of the decimal ids and of the decoded text. `tokenizer` is a file's path, the same on all executors.
    A null text is an empty one; rows equal in id and text have equal results; an id may be null or repeated; very long
    texts are encoded whole, and an empty table gives an empty one.

    1. Each text is cut into chunks by a rolling hash; only chunk hashes leave the first pass.
    2. Chunks found in several places get the first of these as their owner.
    3. Each text meets its list of such chunks. It encodes all other text, and the chunks it owns, each with the pieces
       of words at its borders. Each join of a chunk with the text around is repaired: words are encoded again from
       the border on until text and chunk agree on a word's place, and the chunk's ids before that are dropped.
    4. The ids of owned chunks go to the texts that borrow them.
    Texts move once; a chunk held by a third of all texts is joined as a row, not gathered.
    """
    scratch = Scratch(spark, "bpe")
    keyed = docs.select(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text")).alias("key"), "doc_id", "text")
    cut = scratch.table(per_batch(keyed, chunks, "key string, doc_id long, hash array<binary>, `from` array<int>, `to` array<int>"), "chunks")
    places = cut.select("key", F.inline(F.arrays_zip("hash", "from", "to")))
    shared = scratch.table(places.groupBy("hash").agg(F.min(F.struct("key", "from")).alias("owner"), F.max(F.struct("key", "from")).alias("last")).where("owner < last").drop("last"), "shared")
    owned = F.struct("key", "from") == F.col("owner")
    lists = places.join(shared, "hash").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("from", "to", "hash", owned.alias("owned")))).alias("shared"))
    lists = scratch.table(lists, "lists")
    parts = keyed.select("key", "text").join(lists, "key", "left").mapInArrow(
        encoded(tokenizer), "key string, n long, ids_sha256 string, decoded_sha256 string, own array<binary>, need array<binary>, head array<int>, tail array<int>, gave_hash array<binary>, gave array<binary>"
    )
    parts = scratch.table(parts, "parts")
    scratch.drop(shared, lists)
    gave = parts.where(F.size("gave") > 0).select(F.inline(F.arrays_zip("gave_hash", "gave"))).toDF("hash", "ids")
    waiting = parts.where("need is not null")
    wanted = waiting.select("key", F.posexplode(F.arrays_zip(F.col("need").alias("hash"), "head", "tail")).alias("at", "x")).select("key", "at", "x.*").join(gave, "hash")
    got = wanted.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "ids", "head", "tail"))).alias("got"))
    late = waiting.select("key", "own").join(got, "key").mapInArrow(joined(tokenizer), "key string, n long, ids_sha256 string, decoded_sha256 string")
    done = parts.where("need is null").select("key", "n", "ids_sha256", "decoded_sha256").union(late).dropDuplicates(["key"])
    out = scratch.table(cut.select("key", "doc_id").join(done, "key").select("doc_id", F.col("n").alias("n_tokens"), "ids_sha256", "decoded_sha256"), "result")
    scratch.drop_all_but(out)
    return out
