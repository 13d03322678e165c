from __future__ import annotations

import numpy as np
import pytest

from tellurix.llm import embeddings


def brute(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = {i: i for i, _ in rows}, dict.fromkeys([i for i, _ in rows], 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for dim in {len(v) for _, v in good}:
        own = [(i, v / np.linalg.norm(v)) for i, v in good if len(v) == dim]
        x = np.stack([v for _, v in own])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True):
            i, j = own[a][0], own[b][0]
            links[i] += 1
            links[j] += 1
            p, q = root(i), root(j)
            parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i)) for i, _ in rows}


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, same string").repartition(3)
    out = {r.vec_id: r for r in embeddings.near_duplicates(df, spark).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in out.items()} == brute(rows)
    assert all(r.kept == (r.component_id == i) for i, r in out.items())


def cloud(r, n, dim, spread, around=None):
    return ((r.normal(size=dim) if around is None else around) + spread * r.normal(size=(n, dim))).tolist()


@pytest.mark.parametrize("block", [64, 4096])
def test_clusters_copies_and_noise(spark, monkeypatch, block):
    """Tight clusters that bounds take whole, loose ones on the threshold, copies, noise; many blocks or one."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    r = np.random.default_rng(block)
    vectors = cloud(r, 150, 24, 0.02) + cloud(r, 120, 24, 0.25) + cloud(r, 60, 24, 0.1) + r.normal(size=(150, 24)).tolist()
    vectors += [vectors[0]] * 90 + [(2.5 * np.array(vectors[5])).tolist()]
    order = r.permutation(len(vectors))
    check(spark, [(int(i), vectors[k]) for i, k in enumerate(order)])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (10, [1e-30, 2e-30]), (11, [1e30, 2e30]), (12, [1.0, 2.0])]
    check(spark, rows)
    df = spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(repr, map(tuple, embeddings.near_duplicates(df, spark).collect()))) == sorted(map(repr, [(None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True)]))
    assert embeddings.near_duplicates(df.where("false"), spark).count() == 0


def test_levels_cover_and_nest():
    r = np.random.default_rng(3)
    x = embeddings.unit(cloud(r, 200, 8, 0.3) + r.normal(size=(50, 8)).tolist())
    before = np.zeros(0, int)
    for (nodes, of), radius in zip(embeddings.cover_tree(x), embeddings.RADII, strict=False):
        assert set(before) <= set(nodes) and embeddings.covering(x, nodes, of).max() <= radius + 1e-9
        before = nodes


def dual_links(x, y):
    whole, pairs = embeddings.dual(x, y, embeddings.cover_tree(x), embeddings.cover_tree(y))
    return sorted([*zip(*pairs.tolist(), strict=True), *((int(i), int(j)) for p, q in whole for i in p for j in q)])


def test_a_point_in_another_node_above_than_its_centre(monkeypatch):
    """Points and clusters on a sphere: levels above drop node pairs, and none that a link is in."""
    kept, own = [], embeddings.inherited
    monkeypatch.setattr(embeddings, "inherited", lambda *a: kept.append(a[0].mean()) or own(*a))
    for seed in range(20):
        r = np.random.default_rng(seed)
        even, clusters = (lambda: r.normal(size=(300, 3))), (lambda: np.concatenate([cloud(r, 20, 3, 0.1) for _ in range(12)]))  # noqa: B023
        for some in (even, clusters):
            x, y = embeddings.unit(some()), embeddings.unit(some())
            assert dual_links(x, y) == [(int(i), int(j)) for i, j in zip(*np.nonzero(x @ y.T >= embeddings.COSINE), strict=True)]
    assert len(kept) > 20 and min(kept) < 0.7


def test_doubles_stay_doubles(spark):
    rows = [(1, [1.0, 2.0]), (2, [1e39, 2e39]), (3, [1e-60, 2e-60]), (4, [1.0, -2.0]), (5, [1e300, 2e300])]
    for kind in ("double", "decimal(38,18)"):
        some = rows if kind == "double" else [rows[0], rows[3]]
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>").selectExpr("vec_id", f"cast(embedding AS array<{kind}>) AS embedding")
        out = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, spark).collect()}
        assert out == ({1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)} if kind == "double" else {1: (0, 1), 4: (0, 4)})


def measured(monkeypatch, x, y):
    """Links, and the share of node pairs' distances that the traversal measures, of all at the levels it looks at."""
    trees, counts, own = (embeddings.cover_tree(x), embeddings.cover_tree(y)), [], embeddings.distances
    with monkeypatch.context() as m:
        m.setattr(embeddings, "distances", lambda a, b: counts.append(len(a) * len(b)) or own(a, b))
        whole, pairs = embeddings.dual(x, y, *trees)
    n = len(whole) and sum(len(p) * len(q) for p, q in whole)
    return n + pairs.shape[1], sum(counts) / (len(x) * len(y))


def test_pruned_pairs_cost_their_children_no_distance(monkeypatch):
    """In clusters, node pairs stand for most pairs of points and far ones are dropped early; without clusters all are measured."""
    r = np.random.default_rng(8)
    around = r.normal(size=(60, 32))
    clusters = lambda spread: embeddings.unit(np.concatenate([cloud(r, 20, 32, spread, c) for c in around]))
    for spread, most in ((0.01, 0.02), (0.2, 0.35)):
        x, y = clusters(spread), clusters(spread)
        n, share = measured(monkeypatch, x, y)
        assert n == (x @ y.T >= embeddings.COSINE).sum() and share < most, share
    x, y = embeddings.unit(r.normal(size=(1200, 32))), embeddings.unit(r.normal(size=(1200, 32)))
    n, share = measured(monkeypatch, x, y)
    assert n == (x @ y.T >= embeddings.COSINE).sum() and share <= 1.0
