from __future__ import annotations

from collections import defaultdict

from odd import no_documents, odd_documents
from pyspark.sql import functions as F

from tellurix.llm import mixing
from tellurix.llm.common import n_words


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """The rule as it is told: share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), {s for s in names if sizes[s]}
    while left > 1e-9 and open_:
        total, part = sum(w[s] for s in open_), left
        left = 0.0
        for s in list(open_):
            target[s] += part * w[s] / total
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                open_.discard(s)
    return target


def sized(spark, rows):
    return spark.createDataFrame([(*r, "k", 1.0) for r in rows], "doc_id long, source string, size long, _key string, target double")


def check(rows, out):
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n or 0
    want, taken, source = brute_targets(sizes), defaultdict(int), {i: s for i, s, _ in rows}
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and len(out) == len(rows)


def test_targets_and_cuts(spark):
    hot = [(i, "big", 10 + i % 7) for i in range(900)]
    for rows in (hot + [(10_000 + i, s, 5) for i, s in enumerate(["a", "b", "c", None, "é", "Z"] * 20)], [(1, "a", 7)], [(1, "a", 0), (2, "b", 0)], [(1, "a", None), (2, "b", 3)], [(1, "a", 1000), (2, "b", 1), (3, "c", 1)]):
        check(rows, mixing.mix(sized(spark, rows)).collect())


def test_reruns_agree_and_seeds_differ(spark):
    df = sized(spark, [(i, f"s{i % 3}", 1 + i % 11) for i in range(500)])
    a, b, c = (sorted(map(tuple, mixing.mix(d, seed=s).collect())) for d, s in ((df, "x"), (df.repartition(11), "x"), (df, "y")))
    assert a == b != c


def test_odd_documents(spark):
    docs = odd_documents(spark)
    out = mixing.op4(docs).collect()
    assert len(out) == docs.count() and {r.size for r in out if r.doc_id == 1} == {0}
    assert mixing.op4(no_documents(spark)).count() == 0


def test_texts_are_repeated_and_cut_at_the_budget(spark):
    rows = [(i, "  " * (i % 2) + "\n".join(f"é{i}.{j}" for j in range(5 + i % 9)), "en", f"s{i % 4}", 0, 1, "x") for i in range(200)] + [(900, None, None, None, None, 1, "x"), (None, "a b", "en", "s1", 3, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _size int, _tail string")
    mixed = mixing.mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    taken = {r.doc_id: r.taken for r in mixed.collect() if r.doc_id is not None}
    out, got, text = mixing.apply(docs).collect(), defaultdict(int), {r[0]: r[1] for r in rows}
    for r in out:
        if r.doc_id is not None:
            got[r.doc_id] += len(r.text.split())
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) and r["_tail"] == "x"
    assert dict(got) == {i: n for i, n in taken.items() if n} and out[0].asDict().keys() == set(docs.columns)


def test_repeated_and_null_ids_keep_the_target(spark):
    """360 words of one source: 540 are taken, however ids repeat, and no row above twice its size."""
    text = lambda k, n: " ".join(f"{k}.{i}" for i in range(n))
    for ids in ([1, 1, 1, 2, 3], [None, None, None, 2, None], [1, 2, 3, 4, 5]):
        for same in (True, False):
            rows = [(i, text(0 if same and k < 3 else k, n), "s") for k, (i, n) in enumerate(zip(ids, [80, 80, 80, 60, 60], strict=True))]
            out = [r.text for r in mixing.apply(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
            assert sum(len(t.split()) for t in out) == 540 and 5 <= len(out) <= 10
