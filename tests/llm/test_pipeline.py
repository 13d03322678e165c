"""The pipeline's stages, each against a plain version over the same rows."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import test_bpe
import test_mixing
import test_neardup
import test_quality
from helpers import SMALL
from odd import no_documents, odd_documents
from pyspark.sql import functions as F

from tellurix.llm import secrets
from tellurix.llm.common import row_key


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [len(stages), corpus_pipeline.ORACLE_SQL] == [5, None]
    run = lambda name, d: stages[name](spark, d, SMALL).cache()
    rows = lambda d: sorted(map(tuple, d.collect()))

    a = run("quality rules", docs)
    good = lambda t: (s := test_quality.brute(t))[0] >= 50 and 100 * s[4] <= 50 * s[0]
    lines = test_quality.frequent([(r.source, r.text) for r in docs.collect()])
    first = {}
    by_hash = docs.select("*", F.xxhash64(row_key("source", "text")).alias("hash")).orderBy(F.desc("hash")).collect()
    for r in by_hash:
        first.update({(r.source, test_quality.norm(x)): r.text for x in r.text.split("\n") if good(r.text)})
    gone = lambda r: {x for x in lines[r[3]] if first.get((r[3], x)) != r[1]}
    strip = lambda r: r if not gone(r) else (r[0], t := test_quality.stripped(r[1], gone(r)), r[2], r[3], len(t))
    assert rows(a) == sorted(strip(r) for r in rows(docs) if good(r[1]) and len(strip(r)[1].split()) >= max(50, 0.3 * len(r[1].split())))

    b = run("MinHash near-dedup", a)
    component = test_neardup.brute([(r.doc_id, r.text) for r in a.collect()])
    assert rows(b) == [r for r in rows(a) if component[r[0]] == r[0]]

    c = run("secret scans", b)
    found = {r.doc_id: r for r in b.collect()}
    for r in c.collect():
        t = found[r.doc_id].text
        assert (r.text == t) == (not secrets.base_spans(t, t.encode()) + secrets.markov_spans(t, t.encode(), [])) and not test_quality.re.search("AKIA[A-Z0-9]{16}", r.text)
    assert c.count() == b.count()

    d = run("mixing sources to target weights", c)
    sizes, taken = defaultdict(int), Counter()
    for r in c.collect():
        sizes[r.source] += len(r.text.encode().split())
    for r in d.collect():
        taken[r.source] += len(r.text.encode().split())
    want = test_mixing.brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)

    e = run("BPE encoding and decoding", d)
    assert sorted(map(tuple, e.collect())) == sorted((r.doc_id, *test_bpe.whole(r.text)) for r in d.collect())
    assert all(x.columns == columns for x in (a, b, c, d))
    assert rows(corpus_pipeline.run(spark, SMALL)) == rows(e)


def test_odd_documents_and_none(spark):
    long = lambda k: " ".join(f"{k}w{i}" for i in range(90))
    base = odd_documents(spark)
    more = [(None, long("a"), "en", "s", 1), (None, long("a"), "en", "s", 1), (None, long("b"), "en", None, 1), (77, long("c"), "en", "s", 1), (77, long("d"), "en", "s", 1), (77, long("c"), "en", "s", 1)]
    odd = base.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    counts = []
    for docs in (odd, no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert name.startswith("BPE") or docs.columns == no_documents(spark).columns
            counts.append(Counter(r.doc_id for r in docs.collect()))
    assert counts[0] == Counter({5: 1, 6: 2, None: 4, 77: 3})  # the long texts repeat one word
    assert counts[1] == counts[2] == Counter({5: 1, None: 4, 77: 3}) and not any(counts[5:])
    assert sum(counts[3].values()) >= 8 and counts[3] == counts[4]


def test_one_of_a_group_of_near_copies_comes_through_whole(spark):
    own = lambda k, n=12: [" ".join(f"{k}x{j}y{i}" for i in range(20)) for j in range(n)]
    rows = [(i, "\n".join([*own(f"other{i}"), "the same line of all"]), "en", "s", 0) for i in range(50)]
    near = {100 + i: "\n".join([*own("near", 11), f"line of copy {i}"]) for i in range(6)}
    rows += [(i, t, "en", "s", 0) for i, t in near.items()] + [(200 + i, "\n".join(own("exact")), "en", "s", 0) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, "")
    left = {r.doc_id: r.text for r in docs.collect()}
    one = [i for i in left if i in near]
    assert set(left) == {*range(50), *one, 200} and len(one) == 1 and left[one[0]] == near[one[0]] and left[200] == rows[-1][1]
    assert sum(left[i].endswith("the same line of all") for i in range(50)) == 1
