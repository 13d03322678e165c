"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers, compared by
their log-likelihood ratio."""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tellurix.llm.common import per_batch, record_batch

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "markov")

#: What the models may call a secret: parts of runs of these characters, of this many or more.
RUN_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
#: A part's characters count with their log-likelihood ratio (random over ordinary) less LEVEL; the sum must reach TOTAL, and
#: twice that in a part without a digit, as letters alone are mostly words of a language the models have not seen.
LEVEL, TOTAL = 0.4, 8.0
#: Labelled samples of each kind that the models are trained on.
SAMPLES = 4000

# Parts of ordinary identifiers, for the labelled samples.
PARTS = (
    "get set add remove update create delete find list read write open close load save parse format build make run start stop "
    "check test is has to from with by for on in of at max min sum count total average first last next previous index key value "
    "name type id user account order item product customer price date time day month year hour minute second file path folder "
    "line text string number integer float double boolean array map table row column field record query result error message "
    "status code level state event handler listener manager service client server request response session token config option "
    "parameter argument function method class object instance interface module package version license document section chapter "
    "example project report analysis network connection database storage memory buffer cache stream channel thread process task "
    "queue stack tree graph node edge vertex image color width height size length position left right top bottom center "
    "international information development government university environment understanding responsibility communication"
).split()


def labelled(n: int, seed: int) -> list[tuple[str, int]]:
    """n random strings (1) and n ordinary identifiers, words and paths (0)."""
    r, out = random.Random(seed), []
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    alphabets = [digits + "abcdef", lower + digits, lower.upper() + digits, lower + lower.upper() + digits, lower + lower.upper() + digits + "+/", lower + lower.upper() + digits + "_-"]
    joins = ["_".join, "-".join, "/".join, "".join, lambda p: "".join(x.title() for x in p), lambda p: p[0] + "".join(x.title() for x in p[1:]), lambda p: "_".join(p).upper()]
    for i in range(n):
        out.append(("".join(r.choice(alphabets[i % len(alphabets)]) for _ in range(r.randint(16, 48))), 1))
        own = [r.choice(PARTS) for _ in range(r.randint(2, 7))]
        name = r.choice(joins)(own)
        out.append((name + (r.choice(["", "", "", f"_{r.randint(0, 99)}", str(r.randint(1, 2030))])), 0))
    return out


def trained(samples: list[tuple[str, int]]) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each character after each other, from bigrams with one added to
    every count. Characters outside RUN_CHARS share the last place, as does the start of a string."""
    n = len(RUN_CHARS) + 1
    counts = np.ones((2, n, n))
    for text, label in samples:
        codes = encoded(text)
        np.add.at(counts[label], (np.r_[n - 1, codes[:-1]], codes), 1)
    p = np.log(counts / counts.sum(2, keepdims=True))
    return p[1] - p[0]


PLACE = np.full(256, len(RUN_CHARS), np.intp)
PLACE[np.frombuffer(RUN_CHARS, np.uint8)] = np.arange(len(RUN_CHARS))


def encoded(text: str) -> np.ndarray:
    return PLACE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


@lru_cache(1)
def model() -> np.ndarray:
    """The ratios from SAMPLES labelled strings of each kind, trained once in a process, when first asked for."""
    return trained(labelled(SAMPLES, seed=1))


def random_parts(run: str) -> list[tuple[int, int]]:
    """The parts of a run that are random strings: the part whose characters' ratios less LEVEL have the largest sum, if
    that is large enough, widened to whole strings of letters and digits, and likewise what lies to both sides of it."""
    codes = encoded(run)
    gain = model()[np.r_[len(RUN_CHARS), codes[:-1]], codes] - LEVEL
    out, todo = [], [(0, len(run))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST_RUN:
            continue
        sums = np.r_[0.0, np.cumsum(gain[lo:hi])]
        rise = sums - np.minimum.accumulate(sums)
        end = int(rise.argmax())
        start = int(sums[: end + 1].argmin())
        total, a, b = float(rise[end]), lo + start, lo + end
        while a > lo and run[a - 1].isalnum():
            a -= 1
        while b < hi and run[b].isalnum():
            b += 1
        part = run[a:b]
        letters, digits = any(map(str.isalpha, part)), any(map(str.isdigit, part))
        if total < TOTAL:
            continue
        if b - a >= LEAST_RUN and letters and (digits or (total >= 2 * TOTAL and not part.islower() and not part.isupper())):
            out.append((a, b))
        todo += [(lo, a), (b, hi)]
    return sorted(out)


# One byte stands for the characters of a class, so that a run of the least length is found by a plain search.
HEX_MAP = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
RUN_MAP = bytes(1 if c in RUN_CHARS else 0 for c in range(256))


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) in code points. Searches in the bytes rule out most texts first."""
    spans = []
    lower = raw.lower()
    if any(k in lower for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"\1" * LEAST_HEX in raw.translate(HEX_MAP):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(spans)


def markov_spans(text: str, raw: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Random parts of runs, outside the base spans."""
    if b"\1" * LEAST_RUN not in raw.translate(RUN_MAP):
        return []
    out = []
    for m in RUN.finditer(text):
        at = m.start()
        for s, e in [(s, e) for s, _, e in base if s < m.end() and m.start() < e] + [(m.end(), m.end())]:
            if s - at >= LEAST_RUN:
                out += [(at + a, 3, at + b) for a, b in random_parts(text[at:s])]
            at = max(at, e)
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "starts", "ends")}
    for text in batch.column("text").to_pylist():
        text = text or ""
        raw = text.encode()
        base = base_spans(text, raw)
        every = sorted(base + markov_spans(text, raw, base))
        for k in range(3):
            cols[("n_assign", "n_access", "n_hex")[k]].append(sum(x[1] == k for x in base))
        cols["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
        cols["spans"].append(listed(every))
        cols["starts"].append([s for s, _, _ in every])
        cols["ends"].append([e for _, _, e in every])
    types = dict(zip(cols, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.int32())] * 2, strict=True))
    return record_batch({"doc_id": (batch.column("doc_id"), pa.int64())} | {k: (v, types[k]) for k, v in cols.items()})


def scan(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are dropped) the secrets of its whole text.

    The base patterns are matched leftmost without overlap for each kind, and matches that are too short dropped. The
    models add random parts of 16 or more characters of the runs between these. starts and ends are the spans' places in code points,
    ends exclusive; spans lists them as kind:start:end. Null and empty texts have none; very long
    ones are scanned whole; repeated rows have equal results, and an empty table has none. A map over rows: no shuffle.
    """
    return per_batch(docs.select("doc_id", "text"), scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, starts array<int>, ends array<int>")


def masked(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, sizes = [], []
    for text in batch.column("text").to_pylist():
        if text:
            raw = text.encode()
            base = base_spans(text, raw)
            done, at = [], 0
            for s, _, e in sorted(base + markov_spans(text, raw, base)):
                if s >= at:
                    done += [text[at:s], "[secret]"]
                at = max(at, e)
            text = "".join([*done, text[at:]])
        texts.append(text)
        sizes.append(None if text is None else len(text))
    out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
    if "n_chars" in batch.schema.names:
        at = batch.schema.get_field_index("n_chars")
        out = out.set_column(at, "n_chars", pa.array(sizes, pa.int64()).cast(batch.schema.field(at).type))
    return out


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with every secret of its texts replaced by [secret]; n_chars follows. No row goes, and a text without
    secrets is left as it is."""
    return per_batch(docs, masked, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op8(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("starts", "ends")
