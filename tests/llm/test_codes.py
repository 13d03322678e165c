from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurix.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, x int, own string, `from` int"


def brute(rows):
    """Lloyd's rounds without bounds, in Python's whole numbers; rows of one length."""
    kept = [(i, [math.floor(1024 * c) for c in map(float, v)], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[v[m * w : (m + 1) * w] for _, v, _ in kept] for m in range(4)]
    books = [p[:256] for p in parts]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, book: min(range(len(book)), key=lambda e: (distance(p, book[e]), e))
    for _ in range(4):
        for m in range(4):
            of = {}
            for p in parts[m]:
                of.setdefault(nearest(p, books[m]), []).append(p)
            books[m] = [[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else b for e, b in enumerate(books[m])]
    own = [[nearest(p, books[m]) for p in parts[m]] for m in range(4)]
    errors = [sum(distance(parts[m][k], books[m][own[m][k]]) for m in range(4)) for k in range(len(kept))]
    by = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{own[m][k]:02x}" for m in range(4)), errors[k], by[label], digest)) for k, (i, _, label) in enumerate(kept))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.drop("n_distances").collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "o", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("kind", ["spread", "ties", "clusters"])
def test_rounds_agree_with_those_without_bounds(spark, kind):
    r = random.Random(kind)
    grid = {"spread": lambda: r.gauss(0, 1), "ties": lambda: r.randint(-1, 1) / 1024, "clusters": lambda: r.choice([-3, 0, 3]) + r.gauss(0, 0.01)}[kind]
    rows = [(r.randint(0, 900), [np.float32(grid()).item() for _ in range(8)], r.choice([None, 1, 2])) for _ in range(600)]
    rows += [rows[0], rows[0], (None, rows[1][1], None)]
    assert rows_of(codes.compress(table(spark, rows).repartition(5), spark)) == brute(rows)


def test_odd_vectors(spark):
    good = [(1, [0.5, -0.5, 0.25, 1.0], None), (1, [0.5, -0.5, 0.25, 1.0], 3), (None, [2.0, 0.0, 0.0, -2.0], None), (3, [0.5, -0.5, 0.25, 1.0], 3)]
    bad = [(4, None, 1), (5, [1.0, None, 1.0, 1.0], 1), (6, [float("nan"), 0.0, 0.0, 0.0], 1), (7, [float("inf"), 0.0, 0.0, 0.0], 1), (8, [1.0, 2.0, 3.0], 1)]
    assert rows_of(codes.compress(table(spark, good + bad), spark)) == brute(good)
    empty = {r.vec_id: r for r in codes.compress(table(spark, [*good, (9, [], None), (10, [0.0] * 8, 3)]), spark).collect()}
    assert (empty[9].code, empty[9].error, empty[10].code) == ("00000000", 0, "00000000") and len({r.codebooks_sha256 for r in empty.values()}) == 3
    assert codes.compress(table(spark, []), spark).count() == 0 and codes.compress(table(spark, bad), spark).count() == 0
    with pytest.raises(Exception, match="a component is beyond"):
        codes.compress(table(spark, [(1, [1e9, 0.0, 0.0, 0.0], 1)]), spark)


def test_bounds_rule_entries_out_and_never_the_nearest():
    r = np.random.default_rng(3)
    centres = r.integers(-4000, 4000, (64, 16))
    x = centres[r.integers(0, 64, 4000)] + r.integers(-40, 40, (4000, 16))
    old = codes.Book(x[:64].copy(), np.zeros(64)).prepared()
    own, upper, lower = codes.assigned(x, old)
    book = old.moved({e: (int((own == e).sum()), x[own == e].sum(0).tolist()) for e in range(64) if (own == e).any()}).prepared()
    lower, top = codes.packed(lower)
    kept = codes.unpacked(lower, top)
    assert (kept <= np.sqrt(codes.squares(x, old.entries))).all()
    now, upper, lower, looked = codes.reassigned(x, book, own, upper, kept)
    d = codes.squares(x, book.entries)
    assert (now == d.argmin(1)).all() and looked.sum() < 0.2 * d.size
    assert (upper >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(d)).all()


def test_distances_that_floats_cannot_hold_are_whole():
    x, c = np.array([[codes.LARGEST, 1 - codes.LARGEST]]), np.array([[-codes.LARGEST, codes.LARGEST], [0, 1]])
    assert codes.squares(x, c).tolist() == [[(2 * codes.LARGEST) ** 2 + (2 * codes.LARGEST - 1) ** 2, codes.LARGEST**2 * 2]]


def test_n_distances_counts_what_was_measured(spark):
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") % 10 * 5 + F.rand(i)).cast("float") for i in range(16)]).alias("embedding"), F.lit(1).alias("label"))
    share = codes.compress(df, spark).agg((F.sum("n_distances") / (F.count("*") * 5 * 4 * 256)).alias("s")).first().s
    assert 0.2 <= share < 0.6
