from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from odd import LONG, no_documents, odd_documents

from tellurix.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """All terms of all pairs of groups. `rows` of (text, lang, source)."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out, f = [], lambda p, q: (p - q) ** 2 // q
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= 3}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s], "term": [(t, f(p[s][t], q[t])) for t in counts[s] if p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(items, 1) if part == "pair" or k <= 200]
    return sorted(map(repr, out))


def check(spark, docs):
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert sorted(repr(tuple(r)) for r in divergence.audit(docs, spark).collect()) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_corrections_add_up_to_the_sums_over_all_terms(spark, seed):
    r = random.Random(seed)
    words = [f"{r.choice('aéxİ')}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = [(" ".join(r.choice(words[: 1 + int(400 * r.random() ** 3)]).upper() if r.random() < 0.1 else words[int(400 * r.random() ** 2)] for _ in range(r.randint(0, 60))), r.choice(["en", "de", None]), r.choice([*"abcde", None, ""])) for _ in range(250)]
    check(spark, spark.createDataFrame([*rows, *rows[:20]], "text string, lang string, source string").repartition(4))


def test_groups_without_terms_and_languages_that_keep_none(spark):
    rows = [("one two", "x", "a"), ("one", "x", "b"), (None, "x", "c"), ("1 2 3", "y", "a"), ("same same", "z", "a"), ("same", "z", "b"), ("same", "z", "c"), ("", "z", "d"), (None, None, None)]
    check(spark, spark.createDataFrame(rows, "text string, lang string, source string"))


def test_more_terms_than_ranks_and_ties(spark):
    many = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500))
    check(spark, spark.createDataFrame([(many, "l", "a")] * 3 + [("other", "l", "b")] * 4, "text string, lang string, source string"))


def test_odd_documents(spark):
    check(spark, odd_documents(spark))
    assert divergence.audit(no_documents(spark), spark).count() == 0


def test_a_task_passes_its_counts_on_when_it_holds_many(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    text = pa.array(["a b A", "c d e", "a é", LONG[:20]])
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 4), pa.array(["s"] * 4), text], names=["lang", "source", "text"])
    out = [tuple(r.values()) for b in divergence.counted(iter([batch])) for r in b.to_pylist()]
    assert sum(n for *_, n, _ in out) == 12 and len(list(divergence.counted(iter([batch])))) > 1 and ("l", "s", "a", 2, 1) in out


def test_terms_are_dealt_out_once_before_they_are_kept(spark, monkeypatch):
    """The sums of a term by source and over its sources come from one shuffle of what the tasks have counted."""
    plans = []
    table = divergence.Scratch.table

    def planned(self, df, name):
        if name == "kept":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, name)

    monkeypatch.setattr(divergence.Scratch, "table", planned)
    docs = spark.createDataFrame([("x", "en", "aa bb aa"), ("y", "en", "aa cc"), ("x", "en", "aa")], "source string, lang string, text string")
    assert divergence.audit(docs, spark).where("part = 'pair'").count() == 2
    assert plans[0].count("Exchange") == plans[0].count("Exchange hashpartitioning(lang") == 1
