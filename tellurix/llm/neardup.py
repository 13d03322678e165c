"""MinHash near-duplicates: bottom-k sketches from one hash function, inverted lists of the retained values, an
estimate from the sketch of the union, and the exact Jaccard similarity of the whole sets."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurix.llm.common import WORD, Scratch, WordHashes, long_lists, per_batch, record_batch, rolling, row_key
from tellurix.llm.graph import components

WORDS, PERCENT = 5, 75
#: Values kept in a sketch, and standard deviations allowed for when a sketch stands for its set.
KEPT, SLACK = 64, 5
#: Lists with up to this many documents beside their most frequent component give all pairs of these, others pairs with
#: their hub: lists of retained values, and lists of what members differ from a hub by, which hold less that is soon ruled out.
SMALL, MORE = 8, 300
#: Rows of a list that are put side by side in one.
BLOCK = 512
#: Members whose majority a star's differences are taken from, and up to how many values of the members beside a star's
#: most frequent component the others are asked for.
SAMPLE, ASKED = 15, 2048
#: Rounds in which lists have hubs; after them, all lists give all their pairs.
ROUNDS = 4
#: Size classes between the sizes of two sets that may just link, for the first lists and for those left after them;
#: classes of excess for the size of a hub, and the highest one.
CLASSES, FINE, STEPS, FARTHEST = 2, 6, 56, 24
SPREAD = math.sqrt(KEPT * PERCENT / 100 * (1 - PERCENT / 100))
LEAST = int(KEPT * PERCENT / 100 - SLACK * SPREAD)
#: Up to this size, a set and all that may link with it are kept whole in their sketches.
WHOLE = KEPT * PERCENT // 100


def shingles(text: str | None, memo=WordHashes()) -> np.ndarray:  # noqa: B008  kept between calls
    """The sorted hashes of a text's distinct 5-word shingles; of fewer words, one hash of all; of none, nothing."""
    words = (text or "").encode().lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64)
    return np.unique(rolling(memo.of(words), WORDS))


def sketches(batch: pa.RecordBatch) -> pa.RecordBatch:
    n, same, sketch = [], [], []
    for text in batch.column("text").to_pylist():
        s = shingles(text)
        n.append(len(s))
        same.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
        sketch.append(s[:KEPT])
    own = [pa.array(n, pa.int64()), pa.array(same, pa.string()), long_lists(sketch)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *own], names=["doc_id", "row_key", "n", "same", "sketch"])


def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    z = zstandard.ZstdCompressor(3)
    return record_batch({"id": (batch.column("doc_id"), pa.int64()), "packed": ([z.compress((x or "").encode()) for x in batch.column("text").to_pylist()], pa.binary())})


def rows_of(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """A list column's values as arrays, in their unsigned order."""
    c = batch.column(name)
    flat, at = np.asarray(c.values).view(np.uint64), np.asarray(c.offsets)
    return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The pairs whose union's sketch holds enough common values; of sets that sketches hold whole, exactly enough."""
    keep = []
    for a, b, na, nb in zip(rows_of(batch, "sa"), rows_of(batch, "sb"), *(batch.column(c).to_pylist() for c in ("na", "nb")), strict=True):
        both = np.intersect1d(a, b, assume_unique=True)
        if max(na, nb) <= KEPT:
            keep.append(100 * len(both) >= PERCENT * (na + nb - len(both)))
        else:
            union = np.union1d(a, b)[:KEPT]
            keep.append(np.searchsorted(both, union[-1], "right") >= LEAST)
    return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whether the whole sets of a and b are similar enough. A set a is kept from row to row."""

    @lru_cache(8)
    def of(z: bytes) -> np.ndarray:
        return shingles(zstandard.ZstdDecompressor().decompress(z).decode())

    linked = []
    for za, zb in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True):
        a, b = of(za), of(zb)
        both = len(np.intersect1d(a, b, assume_unique=True))
        linked.append(100 * both >= PERCENT * (len(a) + len(b) - both))
    return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def compared(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whether a and b, of different components, are similar enough by their sizes and the values that they share with
    other components; of a star, also the step of its classes and the values that only one of its hub a and b has."""
    linked, step, rest = [], [], []
    for a, b, na, nb, star in zip(rows_of(batch, "va"), rows_of(batch, "vb"), *(batch.column(c).to_pylist() for c in ("na", "nb", "star")), strict=True):
        both = len(np.intersect1d(a, b, assume_unique=True))
        linked.append(100 * both >= PERCENT * (na + nb - both))
        step.append(na / STEPS if star else None)
        rest.append(np.setxor1d(a, b, assume_unique=True) if star else b[:0])
    own = [pa.array(linked, pa.bool_()), pa.array(step, pa.float64()), long_lists(rest)]
    return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *own], names=["a", "b", "linked", "step", "rest"])


def majority(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The values that more than half of a star's sampled members differ from its hub by."""
    flips = []
    for some in batch.column("some").to_pylist():
        v, n = np.unique(np.array([x for one in some for x in one], np.int64), return_counts=True)
        flips.append(v[2 * n > len(some)])
    return pa.RecordBatch.from_arrays([batch.column("of"), long_lists(flips)], names=["of", "flips"])


def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The whole sets of packed texts."""
    own = [shingles(zstandard.ZstdDecompressor().decompress(z).decode()) for z in batch.column("packed").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, own), pa.int64()), long_lists(own)], names=["id", "n", "v"])


def in_bands(rows: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Each row once for its own size class and once for each class below from which a set may link with it."""
    own = F.floor(F.log(F.col("n")) / math.log(100 / PERCENT) * classes)
    return rows.withColumn("size", own).withColumn("band", F.explode(F.sequence(own - classes, own)))


def within_reach(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (id, n, size, band, top) in lists named by `by` those that a new link may hold. A pair's smaller set is of
    its band's own class, so a list without such a set has no pair, and a row links with none in it if the smallest
    such set is larger than its `top`."""
    low = rows.groupBy(*by).agg(F.min(F.when(F.col("size") == F.col("band"), F.col("n"))).alias("low"))
    return rows.join(low.where("low is not null"), by).where("top >= low").drop("low")


def open_lists(rows: DataFrame, by: list[str], scratch: Scratch, hub: Column, smaller: Column | None = None) -> DataFrame:
    """The rows (id, n, top, component, excess, reach) of the lists, named by `by`, that hold several components: each row
    once, with its list's most frequent component, the number `few` of its rows of other components, and the row that is
    largest by `hub`.

    Rows of one component have nothing left to find out about each other. Where `smaller` says which rows may be the smaller
    set of a pair, lists without such a row have no pair and go, too: of copies, alike in size, those of all bands but
    one. So do rows that nothing in their list is near enough to by excess and reach (see `needed`; where rows have neither,
    all are). Lists are counted before they are shuffled, and rows meet their list's counts in a join that Spark can split.
    """
    rows = rows if "reach" in rows.columns else rows.withColumns({"excess": F.lit(0.0), "reach": F.lit(0.0)})
    any_ = F.lit(True) if smaller is None else smaller
    bounds = [F.min("excess").alias("_least"), F.max(F.col("reach") - F.col("excess")).alias("_most")]
    own = rows.groupBy(*by, "component").agg(F.count("*").alias("c"), F.max(any_).alias("_any"), F.max(F.struct(hub.alias("by"), "id")).alias("_hub"), *bounds)
    most = F.max(F.struct("c", "component"))["component"].alias("most")
    bounds = [F.min("_least").alias("_least"), F.max("_most").alias("_most")]
    own = own.groupBy(*by).agg(F.count("*").alias("_n"), most, (F.sum("c") - F.max("c")).alias("few"), F.max("_hub")["id"].alias("hub"), F.max("_any").alias("_any"), *bounds)
    members = rows.select(*by, "id", "n", "top", "component", "excess", "reach").join(own.where("_n > 1 and _any").drop("_n", "_any"), by)
    return scratch.table(members.where("excess <= _most and _least <= reach - excess").drop("_least", "_most"), "members")


def stars(members: DataFrame, few: int) -> DataFrame:
    """Pairs (a, b) of the hub of each list with more than `few` rows beside its most frequent component, and the list's
    other rows."""
    return members.where(F.col("few") > few).where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def all_pairs(members: DataFrame, by: list[str], few: int) -> DataFrame:
    """Pairs (a, b), a below b, of different components in each list with up to `few` rows beside its most frequent
    component: those rows with all whose excess and their own make up no more than the reach of either, if their sizes may
    link. Those rows are dealt out in blocks, each of which meets all rows, so a row holds about BLOCK of them at most, however long the list."""
    short, blocks = members.where(F.col("few") <= few), F.ceil(F.col("few") / BLOCK)
    others = short.where("component != most").groupBy(*by, F.pmod(F.xxhash64("id"), blocks).alias("_block")).agg(F.collect_set(F.struct("id", "component", "n", "top", "excess", "reach")).alias("others"))
    fit = lambda o: (
        (o["component"] != F.col("component")) & (F.col("n") <= o["top"]) & (o["n"] <= F.col("top")) & (o["excess"] + F.col("excess") <= F.least("reach", o["reach"]))
        & (100 * F.least("n", o["n"]) >= PERCENT * F.greatest("n", o["n"]))
    )
    pairs = short.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).join(others, [*by, "_block"]).select("id", F.explode(F.filter("others", fit)["id"]).alias("o"))
    return pairs.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()


def differences(done: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """Of stars the rows of, id, step, rest, e: what members differ from their star's centre by, in place of its hub.

    The centre is the hub, but for the values that more than half of some members differ from it by. So a hub that has much
    of its own, which all members lack, does not bring that into each one's list. Any set will do as a centre (see `needed`),
    so the sample does not decide which links are found. e is the excess in 2 * (100 + PERCENT) parts.
    """
    stars_ = scratch.table(done.where("step is not null").select(F.col("a").alias("of"), F.col("b").alias("id"), "step", "rest"), "stars")
    some = stars_.select("of", "id").withColumn("_r", F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("id")))).where(F.col("_r") <= SAMPLE).drop("_r")
    some = some.join(stars_.select("of", "id", "rest"), ["of", "id"]).groupBy("of").agg(F.collect_list("rest").alias("some"))
    flips = scratch.table(per_batch(some, majority, "of long, flips array<long>"), "flips")
    rest = F.concat(F.array_except("rest", "flips"), F.array_except("flips", "rest"))
    e = 2 * PERCENT * F.col("n") + (100 + PERCENT) * (F.size("rest") - F.col("held"))
    out = stars_.join(flips, "of").withColumn("rest", rest).join(held.select("id", "n", F.size("v").alias("held")), "id")
    return scratch.table(out.select("of", "id", "step", "rest", e.cast("long").alias("e")), "differences")


def certain(rest: DataFrame) -> DataFrame:
    """The links (a, b) of each star's member with the least excess and those whose excess makes a sum of 0 or less with it."""
    least = rest.groupBy("of").agg(F.min(F.struct("e", "id")).alias("_least"))
    return rest.join(least, "of").where("e + _least.e <= 0 and id != _least.id").select(F.col("_least.id").alias("a"), F.col("id").alias("b"))


def asked(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """`rest` of the stars with several components, without values that can be in one component alone: those of the most
    frequent one that no other member has, unless the others have more than ASKED in all."""
    own = rest.groupBy("of", "component").agg(F.count("*").alias("c"), F.sum(F.size("rest")).alias("s"))
    own = own.groupBy("of").agg(F.count("*").alias("_n"), F.max(F.struct("c", "component", "s")).alias("_most"), F.sum("s").alias("_s"))
    open_ = scratch.table(own.where("_n > 1").select("of", F.col("_most.component").alias("most"), (F.col("_s") - F.col("_most.s")).alias("others")), "open")
    all_ = rest.join(open_, "of")
    wanted = all_.where((F.col("component") != F.col("most")) & (F.col("others") <= ASKED)).groupBy("of").agg(F.array_distinct(F.flatten(F.collect_list("rest"))).alias("wanted"))
    all_ = all_.join(wanted, "of", "left")
    fewer = F.when((F.col("component") == F.col("most")) & F.col("wanted").isNotNull(), F.array_intersect("rest", "wanted")).otherwise(F.col("rest"))
    return scratch.table(all_.withColumn("rest", fewer).where("size(rest) > 0").drop("most", "others", "wanted"), "rest")


def needed(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """Lists, by hub (of) and value, of what members of stars differ from a centre by. `rest` has of, id, n, top, hot,
    component, step, excess and rest.

    Take a set p and two members b and c. What b and c have in common is the size of p, less what each one lacks of p,
    plus what both lack of it and what both have besides; that is, plus the number of values in both their differences
    from p. They link if it is at least PERCENT / (100 + PERCENT) of the sum of their sizes. So they link if their
    differences share at least as many values as the sum of their excesses, where the excess of b is that share of b's
    size, plus half the size of p, less what b and p have in common: that share of b's size, plus half of what the difference
    is larger than b. If that sum is 0 or less, they link, and so do both with the member of the least excess (`certain`).
    All this holds as well if only values are counted that several components share, as what members of different ones have
    in common is among them. So members of different components need a value in common, and
    more of them, the farther they are from p. Only values with several components count, and as in any
    prefix filter all but that number less one of a member's most common ones can be left out. How many values a member
    has from one on is that one's reach, so two rows of a list are a pair if the sum of their excesses is not above
    the reach of either. A row is listed once, whichever its partners, and only if some class of excess has one for it: of another
    component, and with so many values that the sum can be met.
    """
    values = rest.withColumn("v", F.explode("rest")).drop("rest")
    lists = values.groupBy("of", "v").agg(F.count("*").alias("c"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
    own = Window.partitionBy("of", "id")
    ranked = values.join(lists.where("_lo < _hi").select("of", "v", "c"), ["of", "v"])
    ranked = ranked.withColumns({"_r": F.row_number().over(own.orderBy("c", "v")), "_n": F.count("*").over(own), "side": F.least(F.floor(F.col("excess") / F.col("step")), F.lit(FARTHEST))})
    ranked = scratch.table(ranked.withColumn("reach", (F.col("_n") - F.col("_r") + 1).cast("double")).drop("_n", "c"), "ranked")
    classes = ranked.where("_r = 1").groupBy("of", "side").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("excess").alias("least"), F.max(F.col("reach") - F.col("excess")).alias("most"))
    classes = classes.groupBy("of").agg(F.collect_list(F.struct("lo", "hi", "least", "most")).alias("_classes"))
    fit = lambda x: ((x["lo"] != F.col("component")) | (x["hi"] != F.col("component"))) & (F.col("excess") <= x["most"]) & (x["least"] <= F.col("reach") - F.col("excess"))
    return scratch.table(ranked.join(classes, "of").where(F.exists("_classes", fit)).select("of", "v", "id", "n", "top", "hot", "component", "excess", "reach"), "needed")


def listed(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Inverted lists of retained values: rows (id, n, v, hot) of set representatives (id, n, sketch).

    Values go from rare to common. Two sets similar enough share at least m of the values that they retain (for sets
    kept whole, by arithmetic; else by a bound that a pair at the very threshold fails less than once in a million
    times), so they share one among the rarest s - m + 1 of each one's s values, and only these are listed. A passage
    that very many documents repeat is among the common ones and seldom listed at all. In a group of copies the
    document whose values are most common (hot) is the one that the others derive from.
    """
    values = classes.select("id", "n", F.explode("sketch").alias("v"))
    common = scratch.table(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "common")
    shared = values.join(common, "v")
    own, least = Window.partitionBy("id"), F.when(F.col("n") <= WHOLE, F.ceil(F.col("n") * PERCENT / 100)).otherwise(F.least(F.lit(LEAST), F.ceil(F.col("n") * LEAST / KEPT)))
    kept = F.least("n", F.lit(KEPT))
    ranked = shared.withColumns({"_r": F.row_number().over(own.orderBy("df", "v")), "_c": F.count("*").over(own), "hot": F.sum("df").over(own) / kept})
    return scratch.table(ranked.where(kept - F.col("_c") + F.col("_r") <= kept - least + 1).select("id", "n", "v", "hot"), "listed")


class Sets:
    """Sketches of all set representatives, and the texts of those that are to be compared exactly."""

    def __init__(self, docs: DataFrame, classes: DataFrame, scratch: Scratch):
        self.docs, self.classes, self.scratch = docs, classes, scratch

    def likely(self, pairs: DataFrame) -> DataFrame:
        of = lambda x: self.classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "na", "nb", "sa", "sb")
        return self.scratch.table(per_batch(both, likely, "a long, b long"), "likely")

    def texts(self, ids: DataFrame) -> DataFrame:
        wanted = self.scratch.table(ids.toDF("doc_id").distinct(), "wanted")
        return self.scratch.table(per_batch(self.docs.select("doc_id", "text").join(wanted, "doc_id"), packed, "id long, packed binary"), "texts")

    def held(self, texts: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of the whole sets of `texts` their size and those values (v) that several components hold, among which is what two
        of different components have in common; and the size (top) beyond which none of another component links with
        it, for that reason, and how many hold one of its values on average (hot)."""
        sets = self.scratch.table(per_batch(texts, opened, "id long, n long, v array<long>"), "sets")
        values = sets.join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.explode("v").alias("v"))
        several = values.groupBy("v").agg(F.count("*").alias("df"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("v", "df")
        own = values.select("id", "v").join(several, "v").groupBy("id").agg(F.collect_list("v").alias("v"), F.sum("df").alias("df"))
        top = F.floor(F.size("v") * ((100 + PERCENT) / PERCENT) - F.col("n") + 1e-6)
        own = own.join(sets.select("id", "n"), "id").withColumns({"top": top, "hot": F.col("df") / F.col("n")})
        own = self.scratch.table(own.where(F.col("top") >= F.col("n") * (PERCENT / 100)).drop("df"), "held")
        return own.select("id", "n", "v"), own.select("id", "n", "top", "hot")

    def confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """`pairs` (a, b) with linked, by their whole texts."""
        of = lambda x: texts.select(F.col("id").alias(x), F.col("packed").alias(f"z{x}"))
        both = pairs.join(of("b"), "b").join(of("a"), "a")
        return self.scratch.table(per_batch(both, confirmed, "a long, b long, linked boolean"), "confirmed")

    def compared(self, pairs: DataFrame, held: DataFrame) -> DataFrame:
        """`pairs` (a, b, star) with linked, by all values that several components hold, and of stars step and rest."""
        of = lambda x: held.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("v").alias(f"v{x}"))
        both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "star", "na", "nb", "va", "vb")
        out = per_batch(both, compared, "a long, b long, linked boolean, step double, rest array<long>")
        return self.scratch.table(out, "confirmed")


def linked_components(docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component of every set representative (id, n, sketch) with a link, but the components' smallest.

    First, short lists give all their pairs, and long ones the pairs of their hub, which in a group of copies links
    most of it at once. Long lists that then still hold several components are finished exactly. Of their members, many
    have so many values that no other one holds that they can link with none of their size, and drop out. The others
    meet their list's hub, a document whose values are the most common. Two of them that link and are not known to be of one
    component differ from what is common around it in common values (see `needed`), so these differences, of whole sets and
    not of sketches, make new lists, and those with several components go on in the same way. A list in which all but a few rows are of one component,
    and after some rounds any list, gives the pairs of these few. Both decide only which way links are found.
    """
    sets = Sets(docs, classes, scratch)
    rows = in_bands(listed(classes, scratch)).withColumns({"component": F.col("id"), "top": F.lit(1 << 62)})
    first = open_lists(scratch.table(rows, "rows"), ["v", "band"], scratch, F.struct(-F.col("size"), "hot", -F.col("n"), -F.col("id")), F.col("size") == F.col("band"))
    near = stars(first, SMALL).union(all_pairs(first, ["v", "band"], SMALL)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    compared = sets.likely(near.distinct())
    done = sets.confirmed(compared, sets.texts(compared.select("a").union(compared.select("b"))))
    joined = scratch.table(components(done.where("linked").select("a", "b"), scratch), "components")
    now = lambda rows: rows.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    hub = F.struct("hot", -F.col("n"), -F.col("id"))
    left = first.where(F.col("few") > SMALL).select("v", "band", "id", "n", "top").withColumn("hot", F.lit(0))
    members = open_lists(scratch.table(now(left), "left"), ["v", "band"], scratch, hub)
    if members.isEmpty():
        return joined
    held, tops = sets.held(sets.texts(members.select("id")), joined)  # those of the rounds, too
    by = ["v", "band"]
    # rows have the component of when they were made, after which none changes before they are looked at
    rows = scratch.table(within_reach(in_bands(members.select("v", "id").distinct().join(now(tops), "id"), FINE), by), "rows")
    for few in [SMALL, *[MORE] * (ROUNDS - 1), 1 << 62]:
        members = open_lists(rows, by, scratch, hub)
        if members.isEmpty():
            break
        short = sets.likely(all_pairs(members, by, few).join(compared, ["a", "b"], "left_anti"))
        compared = compared.union(short)
        done = sets.compared(stars(members, few).withColumn("star", F.lit(True)).union(short.withColumn("star", F.lit(False))), held)
        rest = differences(done, held, scratch)
        links = done.where("linked").select("a", "b").union(certain(rest)).withColumnRenamed("a", "id")
        links = scratch.table(now(links).withColumnsRenamed({"component": "ca", "id": "a", "b": "id"}), "links")
        fresh = now(links).where("ca != component").select("a", F.col("id").alias("b"))
        if not fresh.isEmpty():
            joined = scratch.table(components(fresh.union(joined), scratch), "components")
        excess = F.col("e") / (2 * (100 + PERCENT)) - 1e-6
        rows, by = needed(asked(now(rest.join(tops, "id")).withColumn("excess", excess).drop("e"), scratch), scratch), ["of", "v"]
    return joined


def near_duplicates(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are dropped): doc_id, n_shingles, component_id, kept, and the
    row's digest row_key.

    Documents whose word 5-grams (A-Z lower-cased) have a Jaccard similarity of 0.75 or more are linked; component_id
    is the smallest doc_id reachable. Documents with the same set are one class from the start, so exact copies never
    form pairs. Null and empty texts have an empty set and link with nothing; rows that repeat an id are one
    document; a row with a null id has the component of its copies, or null, and is kept. Very long texts are
    compared whole; an empty table gives an empty one; other columns may have any name.
    """
    scratch = Scratch(spark, "neardup")
    all_ = scratch.table(per_batch(docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text"), sketches, "doc_id long, row_key string, n long, same string, sketch array<long>"), "sketches")
    classes = all_.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.table(classes.where("id is not null"), "classes")
    found = linked_components(docs, classes, scratch).select("id", F.col("component").alias("_least"))
    ids = classes.select("same", "id")
    out = all_.select("doc_id", "row_key", "n", "same").join(ids, "same", "left").join(found, "id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("_least", "id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "row_key")
    out = scratch.table(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result")
    scratch.drop_all_but(out)
    return out


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT b, root FROM r JOIN both_ways ON id = a),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
