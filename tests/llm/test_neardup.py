from __future__ import annotations

import random
import re

import pytest
from helpers import SMALL
from odd import no_documents, odd_documents
from pyspark.sql import functions as F

from tellurix.llm import neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Component of each id by comparing all pairs of distinct sets."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, t in rows:
        s = frozenset(shingle_set(t))
        if s and s in first:
            a, b = root(first[s]), root(i)
            parent[max(a, b)] = min(a, b)
        elif s:
            first[s] = i
    sets = list(first.items())
    for k, (s, i) in enumerate(sets):
        for t, j in sets[:k]:
            if 4 * min(len(s), len(t)) >= 3 * max(len(s), len(t)) and 100 * (n := len(s & t)) >= 75 * (len(s) + len(t) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, same string, n int").repartition(parts)
    out = {r.doc_id: r for r in neardup.near_duplicates(df, spark).collect()}
    want = brute(rows)
    assert {i: r.component_id for i, r in out.items()} == want
    assert {i: r.n_shingles for i, r in out.items()} == {i: len(shingle_set(t)) for i, t in rows}
    assert all(r.kept == (r.component_id == i) for i, r in out.items())


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.random()}"
    return words


def test_the_smallest_tables(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()])


@pytest.mark.parametrize("size", [90, 400])
def test_large_groups_of_near_copies(spark, size):
    """A group around one text, copies of copies, and texts that share a passage: long lists, pivots and rounds."""
    r = random.Random(size)
    base = [f"b{i}" for i in range(size)]
    rows, texts = [], [base]
    for _ in range(250):
        texts.append(edited(r, base if r.random() < 0.6 else r.choice(texts), r.randint(0, size // 25)))
    passage = [f"p{i}" for i in range(60)]
    texts += [[*passage, *(f"o{k}.{i}" for i in range(r.randint(1, 40)))] for k in range(250)]
    texts += [[*[f"s{i}" for i in range(r.randint(size // 2, size))]] for _ in range(60)]
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(10_000 + i, " ".join(base)) for i in range(200)]
    check(spark, rows)


def test_at_the_threshold(spark):
    w = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = [(1, " ".join(w)), (2, " ".join(w[:79])), (3, " ".join(w[:78])), (4, "A b C d"), (5, "a B c D"), (6, "a b c d e"), (7, "x"), (8, "x\ny"), (9, "X\x0by")]
    assert len(shingle_set(rows[1][1])) == 75
    check(spark, rows)
    assert brute(rows)[2] == 1 and brute(rows[:1] + rows[2:])[3] == 3


def test_odd_documents(spark):
    out = neardup.near_duplicates(odd_documents(spark), spark).collect()
    of = lambda i: {(r.component_id, r.kept) for r in out if r.doc_id == i}
    assert of(1) == {(1, True)} and of(2) == {(2, True)} and of(5) == {(5, True)} and of(6) == {(5, False)} and of(8) == {(7, False)} and of(10) == {(10, True)}
    assert of(None) == {(5, True), (None, True)} and len(out) == 13
    assert neardup.near_duplicates(no_documents(spark), spark).count() == 0


def test_links_of_members_unlike_their_pivot(spark):
    """Pairs of pages made of three passages: other pages with each passage are the pivots of all lists they share."""
    r, passage, own = random.Random(7), lambda k: [f"v{k}.{i}" for i in range(40)], lambda n: [f"o{r.random()}" for _ in range(n)]
    texts = []
    for k in range(12):
        texts += [[*passage(k), *own(4), *passage((k + 1) % 12), *own(4), *passage((k + 5) % 12)] for _ in range(2)]
        texts += [[*passage(k), *own(1), *(f"u{i}" for i in range(79))] for _ in range(8)]
        texts += [[*passage(k), *own(83)] for _ in range(20)]
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert len(set(brute(rows).values())) == 12 * (1 + 1 + 20)
    check(spark, rows)


@pytest.mark.parametrize("few", [(8, 300), (2, 3)])
def test_links_beside_a_larger_document_of_their_lists(spark, monkeypatch, few):
    """Twelve documents that link with each other; a larger one holds all that they share, short ones its other words.
    Whether lists give pairs or go through rounds, the links are the same."""
    monkeypatch.setattr(neardup, "SMALL", few[0])
    monkeypatch.setattr(neardup, "MORE", few[1])
    monkeypatch.setattr(neardup, "BLOCK", few[1] // 3)
    word = lambda p, n: [f"{p}{i}" for i in range(n)]
    shared, more = word("s", 53), word("m", 19)
    texts = [[*shared, *word(f"own{k}.", 8)] for k in range(12)] + [[*shared, *more[4:]]] + [[*more, *word(f"x{k}.", 3)] for k in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert set(list(brute(rows).values())[:12]) == {0}
    check(spark, rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_mixtures_of_passages(spark, seed):
    """Texts of 20 to 400 words put together from the same few passages, whole and in part, with edits: long lists in
    which links lie beside the pivots."""
    r = random.Random(seed)
    passages = [[f"p{k}.{i}" for i in range(r.choice([20, 35, 60, 110]))] for k in range(7)]
    texts = []
    for _ in range(25):
        parts = r.sample(passages, r.randint(1, 4))
        core = [w for p in parts for w in (p if r.random() < 0.7 else p[r.randint(0, len(p) // 2) :])]
        core += [f"c{r.random()}" for _ in range(r.choice([0, 5, 20]))]
        for _ in range(r.choice([1, 2, 3, 30])):
            texts.append(edited(r, core, r.randint(0, 3))[r.choice([0, 0, 3]) :])
    texts += [[*r.choice(passages), *(f"o{r.random()}" for _ in range(r.randint(1, 60)))] for _ in range(60)]
    r.shuffle(texts)
    check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])


def test_copies_are_in_lists_of_one_band_alone(spark):
    """Of sets alike in size, lists of lower bands hold no smaller set, so they are not looked at again."""
    sets = spark.createDataFrame([(i, 100 + i % 2, v) for i in range(12) for v in range(5)] + [(50, 140, 0)], "id long, n long, v long")
    rows = neardup.in_bands(sets).withColumns({"component": F.col("id"), "top": F.lit(1 << 62), "side": F.lit(0), "sides": F.lit(0)})
    found = neardup.open_lists(rows, ["v", "band"], neardup.Scratch(spark, "test"), F.col("n"), F.col("size") == F.col("band"))
    assert found.where("id < 50").count() == 60 and {r.v for r in found.where("id = 50").collect()} == {0}


def test_what_a_hub_has_of_its_own_is_in_no_list(spark, monkeypatch):
    """Groups of copies around one passage: what a group, or the hub of all, has besides leads to no other group."""
    r, values, put = random.Random(3), [], neardup.Scratch.table

    def table(self, df, name):
        out = put(self, df, name)
        if name == "rest":
            values.append(out.selectExpr("coalesce(sum(size(rest)), 0) n").first().n)
        return out

    monkeypatch.setattr(neardup.Scratch, "table", table)
    passage, texts = [f"p{i}" for i in range(90)], []
    for k in range(60):
        core = [*edited(r, passage, k % 3), *(f"o{k}.{i}" for i in range(r.randint(10, 30)))]
        texts += [core, *(edited(r, core, 1) for _ in range(2))]
    r.shuffle(texts)
    check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    assert values and sum(values) < 15 * len(texts)


def test_members_are_listed_once_for_all_their_partners(spark):
    """Sets of 146 values around a centre, from most of which 30 or so are gone, in runs of five: most lie too far from the
    others to link, so their differences make few rows; all pairs that can link are still found."""
    r, scratch = random.Random(7), neardup.Scratch(spark, "test")
    gone = [{a + j for a in r.choices(range(142), k=r.randint(1, 12)) for j in range(5)} for _ in range(200)]
    excess = [146 * 75 / 175 + 73 - (146 - len(g)) for g in gone]
    rows = [(0, i, 146, 1 << 40, 1.0, i, 146 / 56, e, sorted(g)) for i, (g, e) in enumerate(zip(gone, excess, strict=True))]
    rest = spark.createDataFrame(rows, "of long, id long, n long, top long, hot double, component long, step double, excess double, rest array<long>")
    members = neardup.open_lists(neardup.needed(rest, scratch), ["of", "v"], scratch, F.col("hot"))
    assert members.count() < 15 * len(gone)
    found = {(p.a, p.b) for p in neardup.all_pairs(members, ["of", "v"], 1 << 40).collect()}
    want = {(i, j) for j in range(len(gone)) for i in range(j) if len(gone[i] & gone[j]) >= max(1, excess[i] + excess[j] + 1e-5)}
    assert len(want) > 100 and want <= found
