"""Embedding near-duplicates: all pairs above a cosine threshold, by dual traversal of cover trees."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurix.llm.common import Scratch, per_batch, record_batch
from tellurix.llm.graph import components

COSINE = 0.9
#: The same as a distance of unit vectors, and what bounds leave to an exact comparison.
NEAR, ROUNDING = math.sqrt(2 - 2 * COSINE), 1e-7
#: Vectors that the upper tree is built from, at most; every vector is placed in it.
SAMPLE = 1024
#: Vectors in a block, about: what one task compares with another block.
BLOCK = 4096
#: Radii of the levels, halved from the largest distance of unit vectors.
RADII = (2.0, 1.0, 0.5, 0.25, 0.125)


def unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def net(x: np.ndarray, first: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of x so that each point lies within `radius` of one: those of the level above (`first`), then greedily.
    Also the place in it of the nearest one of those tried for each point."""
    centers, best, of = [], np.full(len(x), np.inf), np.zeros(len(x), np.int64)

    def add(i: int) -> None:
        d = distances(x, x[i : i + 1])[:, 0]
        closer = d < best
        best[closer], of[closer] = d[closer], len(centers)
        centers.append(i)

    for i in first:
        add(int(i))
    while len(far := np.flatnonzero(best > radius)):
        add(int(far[0]))
    return np.array(centers, np.int64), of


def cover_tree(x: np.ndarray, radii: tuple[float, ...] = RADII) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from coarse to fine: a level's nodes (places in x, the level above's first) and each point's node."""
    levels, first = [], np.zeros(0, np.int64)
    for r in radii:
        first, of = net(x, first, r)
        levels.append((first, of))
        if len(first) == len(x):
            break
    return levels


def covering(x: np.ndarray, nodes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Each node's distance from the farthest of its points."""
    out = np.zeros(len(nodes))
    np.maximum.at(out, of, np.sqrt(np.maximum(0, 2 - 2 * (x * x[nodes][of]).sum(1))))
    return out


def inherited(mask: np.ndarray, above: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each node of a level a row of `mask`, whose rows are the nodes of a level above: true where it is so for any
    node that the points of this one are of there. Points go to the nearest node of each level, so they are of several."""
    node, parent = np.divmod(np.unique(of * len(mask) + above), len(mask))
    return np.logical_or.reduceat(mask[parent], np.flatnonzero(np.diff(node, prepend=-1)), axis=0)


def families(above: np.ndarray, mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The nodes of a level, 1,024 at most of one node of the level above (`above`) at a time, each time with the other tree's
    nodes that `mask` leaves to any of them."""
    order = np.argsort(above, kind="stable")
    own = np.split(order, np.flatnonzero(np.diff(above[order])) + 1)
    pieces = [rows[at : at + 1024] for rows in own for at in range(0, len(rows), 1024)]
    return [(rows, cols) for rows in pieces if len(cols := np.flatnonzero(mask[rows].any(0)))]


def dual(xa: np.ndarray, xb: np.ndarray, ta: list, tb: list) -> tuple[list, np.ndarray]:
    """Linked pairs of two blocks: node pairs all of whose points link, as (nodes' points a, points b), and pairs of
    points. Level by level, node pairs farther apart than their covering radii and the threshold are dropped, and
    pairs that lie within the threshold with their radii are taken whole; what is left in the end is compared point by
    point. A level with nearly as many nodes as the next one is passed over, as it can drop nothing that this doesn't.
    A node pair is dropped for a level above only if all pairs of nodes that their points are of there were. Distances
    are measured between the children of nodes that are left, so a pair that was dropped costs its children none.
    """
    depth = min(len(ta), len(tb))
    alive = None
    for level in range(1, depth):
        (na, oa), (nb, ob) = ta[level], tb[level]
        last = level == depth - 1
        if not last and len(na) * len(nb) > 0.25 * len(ta[level + 1][0]) * len(tb[level + 1][0]):
            continue
        ra, rb = covering(xa, na, oa), covering(xb, nb, ob)
        if alive is not None:
            pa_, pb_, mask = alive
            mask = inherited(inherited(mask, pa_, oa).T, pb_, ob).T
            parts = families(pa_[na], mask)
        else:
            parts = [(np.arange(at, min(at + 1024, len(na))), np.arange(len(nb))) for at in range(0, len(na), 1024)]  # bounds the memory of a level
        whole, split, left = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)], np.zeros((0 if last else len(na), len(nb)), bool)
        ya, yb = xa[na], xb[nb]
        for rows, cols in parts:
            d, r = distances(ya[rows], yb if len(cols) == len(nb) else yb[cols]), ra[rows, None] + rb[None, cols]
            maybe = d - r <= NEAR + ROUNDING
            if alive is not None:
                maybe &= mask[rows[:, None], cols]
            if not last:
                left[rows[:, None], cols] = maybe
                continue
            sure = maybe & (d + r <= NEAR - ROUNDING)
            for into, some in ((whole, sure), (split, maybe & ~sure)):
                i, j = np.nonzero(some)
                into.append(np.stack([rows[i], cols[j]]))
        if not last:
            alive = (oa, ob, left)
            if not left.any():
                return [], np.zeros((2, 0), np.int64)
            continue
        points = lambda of, n: np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=n))[:-1])
        pa_, pb_ = points(oa, len(na)), points(ob, len(nb))
        taken = [(pa_[i], pb_[j]) for i, j in np.concatenate(whole, 1).T]
        pairs = np.concatenate(split, 1)
        single = (np.bincount(oa, minlength=len(na))[pairs[0]] == 1) & (np.bincount(ob, minlength=len(nb))[pairs[1]] == 1)
        found = [exact(xa, xb, na[pairs[0, single]], nb[pairs[1, single]])]
        for i, j in pairs[:, ~single].T:
            a, b = pa_[i], pb_[j]
            i_, j_ = np.nonzero(xa[a] @ xb[b].T >= COSINE)
            found.append(np.stack([a[i_], b[j_]]))
        return taken, np.concatenate(found, 1)
    i, j = np.nonzero(xa @ xb.T >= COSINE)
    return [], np.stack([i, j])


def exact(xa: np.ndarray, xb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    ok = (xa[i] * xb[j]).sum(1) >= COSINE
    return np.stack([i[ok], j[ok]])


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each vertex's smallest vertex reachable over the edges."""
    label = np.arange(n)
    while True:
        before = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if (label == before).all():
            return label


def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per vector of two blocks its links across them, and the least vector that it is joined to there."""
    ids, counts, least = [], [], []
    for r in batch.to_pylist():
        a, b = load(r["a"]), load(r["b"])
        same = r["i"] == r["j"]
        whole, pairs = dual(a["x"], b["x"], a["tree"], b["tree"])
        if same:
            pairs = pairs[:, pairs[0] != pairs[1]]
        na, nb = len(a["x"]), len(b["x"])
        offset = 0 if same else na
        links = np.zeros(na + (0 if same else nb), np.int64)
        np.add.at(links, pairs[0], b["copies"][pairs[1]])
        if not same:
            np.add.at(links, pairs[1] + offset, a["copies"][pairs[0]])
        ei, ej = [pairs[0]], [pairs[1] + offset]
        for p, q in whole:
            links[p] += b["copies"][q].sum()
            if same:
                both = np.intersect1d(p, q)  # a vector is no link of its own
                links[both] -= a["copies"][both]
                if len(p) == 1 and np.array_equal(p, q):
                    continue
            else:
                links[q + offset] += a["copies"][p].sum()
            ei += [np.full(len(q), p[0]), p]
            ej += [q + offset, np.full(len(p), q[0] + offset)]
        own = a["ids"] if same else np.concatenate([a["ids"], b["ids"]])
        order = np.argsort(own, kind="stable")
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        label = own[order][least_labels(len(own), place[np.concatenate(ei)], place[np.concatenate(ej)])][place]
        some = links > 0
        ids.append(own[some])
        counts.append(links[some])
        least.append(label[some])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return record_batch({"id": (cat(ids), pa.int64()), "n": (cat(counts), pa.int64()), "least": (cat(least), pa.int64())})


def load(b: dict) -> dict:
    ids, copies = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["copies"], np.int64)
    tree, at, flat = [], 0, np.frombuffer(b["tree"], np.int64)
    for n in b["sizes"]:
        tree.append((flat[at : at + n], flat[at + n : at + n + len(ids)]))
        at += n + len(ids)
    kind = np.float32 if b["narrow"] else np.float64
    return {"ids": ids, "copies": copies, "x": unit(np.frombuffer(b["vectors"], kind).reshape(len(ids), -1)), "tree": tree}


BLOCK_SCHEMA = "block long, ids binary, copies binary, vectors binary, narrow boolean, tree binary, sizes array<int>"


def built(t: pa.Table) -> pa.Table:
    """One row for a block: its vectors and their cover tree."""
    v = np.stack(t.column("embedding").to_numpy()).astype(np.float64)
    tree = cover_tree(unit(v))
    with np.errstate(over="ignore"):
        narrow = v.astype(np.float32)
    same = bool((narrow == v).all())  # floats, stored as they came
    return pa.table(
        {
            "block": pa.array([t.column("block")[0].as_py()], pa.int64()),
            "ids": [t.column("id").to_numpy().astype(np.int64).tobytes()],
            "copies": [t.column("copies").to_numpy().astype(np.int64).tobytes()],
            "vectors": [(narrow if same else v).tobytes()],
            "narrow": [same],
            "tree": [np.concatenate([np.concatenate(x) for x in tree]).astype(np.int64).tobytes()],
            "sizes": pa.array([[len(n) for n, _ in tree]], pa.list_(pa.int32())),
        }
    )


def placed(centers: np.ndarray):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = unit(np.stack(batch.column("embedding").to_numpy(zero_copy_only=False))) if batch.num_rows else np.zeros((0, centers.shape[1]))
        d = distances(x, centers)
        cell = d.argmin(1)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell], pa.float64())], names=[*batch.schema.names, "cell", "away"]
        )

    return run


def groups_of(centers: np.ndarray, cells: dict[int, tuple[int, float]]) -> tuple[list, list]:
    """Cells packed into groups of about BLOCK vectors in the order of the tree, as (cell, group, parts); and the pairs
    of groups that hold cells within reach of each other by their covering radii. Both are bounded by SAMPLE."""
    tree = cover_tree(centers)
    order = np.lexsort([of for _, of in reversed(tree)]) if tree else np.arange(len(centers))
    rows, sizes, group = [], [0], 0
    for c in order.tolist():
        n = cells.get(c, (0, 0.0))[0]
        if n and sizes[group] and sizes[group] + n > BLOCK:
            group += 1
            sizes.append(0)
        if n:
            sizes[group] += n
            rows.append((c, group))
    rows = [(c, g, -(-sizes[g] // BLOCK)) for c, g in rows]
    d, radius = distances(centers, centers), np.array([cells.get(c, (0, 0.0))[1] for c in range(len(centers))])
    within = d - radius[:, None] - radius[None, :] <= NEAR + ROUNDING
    of = {g: [c for c, h, _ in rows if h == g] for g in range(group + 1)}
    near = [(g, h) for g, h in combinations_with_replacement(range(group + 1), 2) if g == h or within[np.ix_(of[g], of[h])].any()]
    return rows, near


def links(classes: DataFrame, spark: SparkSession, scratch: Scratch) -> DataFrame:
    """Rows (id, n, least) of the linked vectors of `classes` (id, embedding, copies), all of one dimension; a vector
    has a row for each pair of blocks in which it has links."""
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()
    centers = unit([r[0] for r in sample])
    schema = f"id long, embedding {classes.schema['embedding'].dataType.simpleString()}, copies long, cell int, away double"
    own = scratch.table(per_batch(classes.select("id", "embedding", "copies"), placed(centers), schema), "placed")
    cells = {r[0]: (r[1], r[2]) for r in own.groupBy("cell").agg(F.count("*"), F.max("away")).collect()}
    rows, near = groups_of(centers, cells)
    group = spark.createDataFrame(rows, "cell int, group long, parts long")
    number = lambda g, part: F.col(g) * (1 << 24) + part
    blocks = own.join(F.broadcast(group), "cell").withColumn("block", number("group", F.pmod(F.xxhash64("id"), F.col("parts"))))
    blocks = scratch.table(blocks.select("block", "id", "copies", "embedding").groupBy("block").applyInArrow(built, BLOCK_SCHEMA), "blocks")
    parts = {g: p for _, g, p in rows}
    pairs = spark.createDataFrame([(g, h, parts[g], parts[h]) for g, h in near], "g long, h long, p long, q long")
    pairs = pairs.select("g", "h", "q", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("s")).select("g", "h", "s", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("t"))
    pairs = pairs.select(number("g", F.col("s")).alias("i"), number("h", F.col("t")).alias("j")).where("i <= j")
    side = lambda key, name: blocks.select(F.col("block").alias(key), F.struct("ids", "copies", "vectors", "narrow", "tree", "sizes").alias(name))
    return scratch.table(per_batch(pairs.join(side("i", "a"), "i").join(side("j", "b"), "j"), compared, "id long, n long, least long"), "compared")


def near_duplicates(vectors: DataFrame, spark: SparkSession) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding; other columns are dropped): vec_id, n_links, component_id, kept.

    Links are all pairs with a cosine of COSINE or more in double precision. Equal vectors are one class with a number
    of copies, so copies never form pairs. An upper cover tree over a bounded sample places every vector; its cells,
    packed or split into blocks of about BLOCK vectors, have their true covering radii, and only blocks with
    cells in reach are compared, by the dual traversal of their own trees. Each task holds two blocks, whatever the
    skew, and returns sums and one edge for a linked vector. In data without clusters no bound can drop anything, and
    the work is that of all pairs, in blocks.

    Components may be of any number type; floats stay floats when moved, and all else is a double.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of
    different dimension don't link. A null id has no links of its own to count; repeated ids are one vector each.
    """
    scratch = Scratch(spark, "embeddings")
    ok = F.expr(
        "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('Infinity')) AND exists(embedding, x -> x != 0)"
    )
    key = F.when(ok, F.concat_ws(":", F.size("embedding"), F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")))
    kind = vectors.schema["embedding"].dataType.simpleString()
    wide = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    own = scratch.table(vectors.select("vec_id", wide.alias("embedding")).withColumn("same", F.when(F.col("vec_id").isNotNull(), key)), "vectors")
    classes = own.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = scratch.table(classes, "classes")
    found = None
    for (dimension,) in classes.select(F.size("embedding")).distinct().collect():
        some = links(classes.where(F.size("embedding") == dimension), spark, scratch)
        found = some if found is None else found.union(some)
    if found is None:
        found = spark.createDataFrame([], "id long, n long, least long")
    joined = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")), scratch)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    per_class = classes.select("same", "id", "copies").join(counts, "id", "left").join(joined, "id", "left")
    per_class = scratch.table(per_class.select("same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "per_class")
    out = own.select("vec_id", "same").join(per_class, "same", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = scratch.table(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "result")
    scratch.drop_all_but(out)
    return out


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 WHERE list_dot_product(a.x, b.x) >= {COSINE} * a.n * b.n),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT b, root FROM r JOIN e ON id = a),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN k ON k.a = vec_id
"""
