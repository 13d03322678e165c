"""Vector code compression: product codes in whole numbers, their codebooks found by Lloyd rounds with Elkan's bounds.

Each part of a vector keeps an upper bound on its distance to the entry it is assigned to, and one lower bound for each
entry. They are written with the vectors after every round. In the next one the upper bound grows and each lower bound
shrinks by as much as its entry moved, and only entries that the triangle inequality can't rule out are measured. An entry is
ruled out only if it must be strictly farther, so ties are always measured, in whole numbers, and go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurix.llm.common import Scratch

#: Parts of a vector, entries of a part's codebook, rounds, and units of 1.
PARTS, ENTRIES, ROUNDS, UNIT = 4, 256, 4, 1024
#: Components may be so large, in units: their squared distances then fit a long.
LARGEST = 1 << 26
#: What rounding may have added to a bound, relatively; bounds are moved by it to their safe side.
SLACK = 1e-9
#: Tasks are put together so many at a time when the first vectors are sought.
BINS = 1024


@dataclass
class Book:
    """A part's entries, and how far each moved in the last round."""

    entries: np.ndarray
    moves: np.ndarray

    def prepared(self) -> Book:
        """With half the distances between entries, and half of that to the nearest other entry, both rounded down."""
        self.half = np.sqrt(squares(self.entries, self.entries).astype(float)) / 2 * (1 - SLACK)
        others = self.half + np.where(np.eye(len(self.entries), dtype=bool), np.inf, 0)
        self.gap = others.min(1) if len(others) else np.zeros(0)
        return self

    def moved(self, sums: dict[int, tuple[int, list[int]]]) -> Book:
        """After a round: the floor of its parts' mean for each entry; entries without parts stay."""
        entries = self.entries.copy()
        for e, (n, total) in sums.items():
            entries[e] = [x // n for x in total]
        step = (entries - self.entries).astype(float)
        return Book(entries, np.sqrt((step * step).sum(1)) * (1 + SLACK))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `x` to all of `c`; by floating-point products where those are exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)


def packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes, in 255ths of the row's largest, rounded down; and that largest."""
    top = lower.max(1, initial=0)
    return np.floor(lower * (255 / np.where(top > 0, top, 1))[:, None] * (1 - SLACK)).astype(np.uint8), top


def unpacked(lower: np.ndarray, top: np.ndarray) -> np.ndarray:
    return lower * (top / 255 * (1 - SLACK))[:, None]


def assigned(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first round: each row's nearest entry, and its bounds; all distances are measured."""
    d = squares(x, book.entries)
    own = d.argmin(1)
    return own, np.sqrt(d[np.arange(len(x)), own].astype(float)) * (1 + SLACK), np.sqrt(d.astype(float)) * (1 - SLACK)


def reassigned(x: np.ndarray, book: Book, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A later round: nearest entries and bounds, from those of the round before; and how many distances each row took."""
    own, upper, lower = own.copy(), upper + book.moves[own], np.maximum(lower - book.moves, 0)
    upper, lower = upper * (1 + SLACK), lower * (1 - SLACK)
    looked = np.zeros(len(x), np.int32)
    some = np.flatnonzero(upper >= book.gap[own])  # of the others, no entry can be as near as their own
    if not len(some):
        return own, upper, lower, looked
    rows, a = x[some], own[some]
    square = lambda p, q: ((p - q) ** 2).sum(1)
    least = square(rows, book.entries[a])
    reach = np.sqrt(least.astype(float)) * (1 + SLACK)
    near = (lower[some] <= reach[:, None]) & (book.half[a] <= reach[:, None])
    near[np.arange(len(some)), a] = False
    i, j = np.nonzero(near)
    d = square(rows[i], book.entries[j])
    lower[some, a] = np.sqrt(least.astype(float)) * (1 - SLACK)
    lower[some[i], j] = np.sqrt(d.astype(float)) * (1 - SLACK)
    best = least.copy()
    np.minimum.at(best, i, d)
    entry = np.where(least == best, a, len(book.entries))
    tie = d == best[i]
    np.minimum.at(entry, i[tie], j[tie])
    own[some], upper[some] = entry, np.sqrt(best.astype(float)) * (1 + SLACK)
    looked[some] = 1 + np.bincount(i, minlength=len(some))
    return own, upper, lower, looked


STATE = "vec_id long, label long, width int, x array<int>, own binary, upper array<double>, lower binary, top array<double>, looked long"
Books = dict[int, list[Book]]


def rows_of(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """A column of lists or byte strings of one length, as rows of an array."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one width, a bounded number at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            widths = part.column("width").to_numpy()
            for w in np.unique(widths).tolist():
                yield w, part.take(pa.array(np.flatnonzero(widths == w)))


def round_of(books: Books) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assigns parts to their nearest entries: measuring all where rows have no bounds yet, else by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {w: [b.prepared() for b in parts] for w, parts in books.items()}
        for w, b in blocks(batches):
            x, fresh, k = rows_of(b.column("x"), w, np.int64), "own" not in b.schema.names, len(ready[w][0].entries)
            looked = np.zeros(b.num_rows, np.int64) if fresh else b.column("looked").to_numpy().astype(np.int64)
            if not fresh:
                own, upper, top = rows_of(b.column("own"), PARTS, np.uint8), rows_of(b.column("upper"), PARTS, float), rows_of(b.column("top"), PARTS, float)
                lower = rows_of(b.column("lower"), PARTS * k, np.uint8).reshape(b.num_rows, PARTS, k)
            out = []
            for m, book in enumerate(ready[w]):
                part = x[:, m * w // PARTS : (m + 1) * w // PARTS]
                if fresh:
                    out.append((*assigned(part, book), np.full(len(x), k)))
                else:
                    out.append(reassigned(part, book, own[:, m].astype(np.int64), upper[:, m], unpacked(lower[:, m], top[:, m])))
            bounds = [packed(o[2]) for o in out]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id"),
                    b.column("label"),
                    b.column("width"),
                    b.column("x"),
                    pa.array([r.tobytes() for r in np.stack([o[0] for o in out], 1).astype(np.uint8)], pa.binary()),
                    lists(np.stack([o[1] for o in out], 1)),
                    pa.array([r.tobytes() for r in np.stack([p[0] for p in bounds], 1)], pa.binary()),
                    lists(np.stack([p[1] for p in bounds], 1)),
                    pa.array(looked + sum(o[3] for o in out)),
                ],
                names=["vec_id", "label", "width", "x", "own", "upper", "lower", "top", "looked"],
            )

    return run


def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of parts of each entry, and their sums by component."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w, b in blocks(batches):
        x, own = rows_of(b.column("x"), w, np.int64), rows_of(b.column("own"), PARTS, np.uint8)
        n, total = found.setdefault(w, (np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, w // PARTS), np.int64)))
        for m in range(PARTS):
            np.add.at(n[m], own[:, m], 1)
            np.add.at(total[m], own[:, m], x[:, m * w // PARTS : (m + 1) * w // PARTS])
    for w, (n, total) in found.items():
        m, e = np.nonzero(n)
        rows = np.concatenate([n[m, e][:, None], total[m, e]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), w, np.int32)), pa.array(m.astype(np.int32)), pa.array(e.astype(np.int32)), lists(rows)], names=["width", "part", "entry", "sums"])


def first_books(whole: DataFrame) -> Books:
    """The parts of the vectors with the smallest ids. Of each task no more than ENTRIES are passed on, and of each bin of
    tasks; these are then few, whatever the number of tasks."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy("width", *by).orderBy(*order))).where(F.col("nth") <= ENTRIES)
    some = first(whole.select("width", "vec_id", "x", F.pmod(F.spark_partition_id(), F.lit(BINS)).alias("bin")), "bin").drop("nth")
    books: Books = {}
    for r in first(some).select("width", "x").orderBy("width", "nth").collect():  # ENTRIES of each width
        own = books.setdefault(r.width, [[] for _ in range(PARTS)])
        for m in range(PARTS):
            own[m].append(r.x[m * r.width // PARTS : (m + 1) * r.width // PARTS])
    return {w: [Book(np.array(p, np.int64).reshape(len(p), w // PARTS), np.zeros(len(p))) for p in parts] for w, parts in books.items()}


def after_round(books: Books, state: DataFrame) -> Books:
    """Books whose entries have become their parts' means. Only sums by entry and component reach the driver."""
    each = state.select("width", "x", "own").mapInArrow(sums_of, "width int, part int, entry int, sums array<long>")
    each = each.select("width", "part", "entry", F.posexplode("sums").alias("at", "value")).groupBy("width", "part", "entry", "at").agg(F.sum("value").alias("value"))
    found: dict[tuple[int, int], dict[int, dict[int, int]]] = {}
    for r in each.collect():  # ENTRIES times the width, and PARTS * ENTRIES counts, of each width
        found.setdefault((r.width, r.part), {}).setdefault(r.entry, {})[r["at"]] = r.value
    moved = lambda w, m, b: b.moved({e: (s[0], [s[i] for i in range(1, len(s))]) for e, s in found.get((w, m), {}).items()})
    return {w: [moved(w, m, b) for m, b in enumerate(parts)] for w, parts in books.items()}


def final(books: Books) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Codes, and the whole-number distances to the entries they name."""
    digests = {w: hashlib.sha256(",".join(str(i) for b in parts for i in b.entries.reshape(-1).tolist()).encode()).hexdigest() for w, parts in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, b in blocks(batches):
            x, own, error = rows_of(b.column("x"), w, np.int64), rows_of(b.column("own"), PARTS, np.uint8), np.zeros(b.num_rows, np.int64)
            for m, book in enumerate(books[w]):
                error += ((x[:, m * w // PARTS : (m + 1) * w // PARTS] - book.entries[own[:, m]]) ** 2).sum(1)
            code, digest = pa.array([r.tobytes().hex() for r in own]), pa.array([digests[w]] * b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), code, pa.array(error), digest, b.column("looked")], names=["vec_id", "label", "code", "error", "codebooks_sha256", "n_distances"])

    return run


def compress(vectors: DataFrame, spark: SparkSession) -> DataFrame:
    """`vec_id, code, error, label_error, codebooks_sha256, n_distances` for each usable row of `vec_id, embedding, label`.

    Rows whose vector is null, holds a null or non-finite component, or has a length that PARTS does not divide are dropped.
    Vectors of different lengths have codebooks of their own; that of an empty one has no components. Repeated rows count
    each; null ids come last and equal ids in order of their components where the first entries are chosen, and fewer
    than ENTRIES vectors give as many entries. Null labels are a label. An empty table gives an empty one. Other columns are
    not looked at. A component of over LARGEST units is an error, as its squares would not fit a long.

    Codebooks go through the driver: ENTRIES vectors of each length, whatever the number of rows. `n_distances` is how many
    of the (ROUNDS + 1) * PARTS * ENTRIES distances of a row were measured.
    """
    scratch, units = Scratch(spark, "codes"), F.transform("embedding", lambda x: F.floor(UNIT * x.cast("double")))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))) & (F.size("embedding") % PARTS == 0)
    checked = F.transform("units", lambda x: F.when(F.abs(x) <= LARGEST, x.cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {UNIT}"))))
    whole = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("embedding").alias("width"), units.alias("units"))
    whole = scratch.table(whole.select("vec_id", "label", "width", checked.alias("x")), "units")
    books = first_books(whole)
    state = scratch.table(whole.mapInArrow(round_of(books), STATE), "state")
    scratch.drop(whole)
    for _ in range(ROUNDS):
        books, before = after_round(books, state), state
        state = scratch.table(before.mapInArrow(round_of(books), STATE), "state")
        scratch.drop(before)
    coded = scratch.table(state.mapInArrow(final(books), "vec_id long, label long, code string, error long, codebooks_sha256 string, n_distances long"), "codes")
    errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = scratch.table(coded.join(errors, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256", "n_distances"), "result")
    scratch.drop_all_but(out)
    return out


def op11(vectors: DataFrame, spark: SparkSession) -> DataFrame:
    return compress(vectors, spark).drop("n_distances")


def sql() -> str:
    """The rounds one after another, without bounds."""
    steps = []
    best = "min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x))::BIGINT * 256 + c.e)"
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT k, p.m, {best} AS best FROM p JOIN c{r} c USING (m) GROUP BY k, p.m)")
        if r < ROUNDS:
            mean = f"SELECT m, best % 256 AS e, i, floor(sum(x) / count(*)) AS x FROM (SELECT p.m, best, unnest(p.x) AS x, generate_subscripts(p.x, 1) AS i FROM p JOIN a{r} USING (k, m)) GROUP BY ALL"
            steps.append(f"u{r} AS MATERIALIZED (SELECT m, e, list(x ORDER BY i) AS x FROM ({mean}) GROUP BY m, e)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT m, e, coalesce(u{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN u{r} USING (m, e))")
    return f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: floor({UNIT} * x::DOUBLE)) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT k, m, x[m * len(x) // 4 + 1 : (m + 1) * len(x) // 4] AS x FROM v, range(4) t(m)),
    c0 AS MATERIALIZED (SELECT m, k - 1 AS e, x FROM p WHERE k <= 256),
    {", ".join(steps)},
    books AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY m, e, i)) AS codebooks_sha256 FROM (SELECT m, e, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM c{ROUNDS})),
    o AS (SELECT k, string_agg(format('{{:02x}}', best % 256), '' ORDER BY m) AS code, sum(best // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY k)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN o USING (k), books"""


SQL = sql()
