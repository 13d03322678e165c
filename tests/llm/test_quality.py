from __future__ import annotations

import re
from collections import Counter

import pytest
from helpers import SMALL
from odd import no_documents, odd_documents

from tellurix.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def frequent(rows):
    """Per host the lines that its documents share above the limits."""
    lines, texts = {}, {}
    for host, text in set(rows):
        texts[host] = texts.get(host, 0) + 1
        own = {norm(x) for x in (text or "").split("\n")} - {""}
        lines.setdefault(host, Counter()).update(own)
    return {h: {x for x, n in c.items() if n > quality.MAX_DOCS and n > quality.MAX_SHARE * texts[h]} for h, c in lines.items()}


def norm(line):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def stripped(text, lines):
    return "\n".join(x for x in text.split("\n") if norm(x) not in lines)


def test_statistics(spark):
    docs = odd_documents(spark)
    out = quality.rules(docs, spark).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert all(r.kept == (not r.base_failed) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out)
    assert quality.rules(no_documents(spark), spark).count() == 0


def own(i, n=80):
    return " ".join(f"d{i}w{j}" for j in range(n))


def corpus(spark, words):
    """Own texts of 80 words below a notice of `words` words, among other texts of their host; copies of one text; the notice
    alone on another host; and short texts that a common line leaves too few words."""
    notice = "\n".join(" ".join(f"n{j}x{i}" for i in range(words // 4)) for j in range(4))
    rows = [(i, f"{notice}\n{own(i)}", "h") for i in range(200)] + [(1000 + i, own("copy") + "\n" + own("more"), "h") for i in range(300)]
    rows += [(2000 + i, own(f"other{i}"), "h") for i in range(50)] + [(5000, notice, "other")]
    rows += [(6000 + i, f"{own('line', 10)}\n{own(f's{i}', 45 + i)}", "short") for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("words", [200, 400, 800, 1600])
def test_boilerplate_goes_and_copies_stay(spark, words):
    docs = corpus(spark, words)
    verdicts = quality.rules(docs, spark)
    out = {r.doc_id: r for r in verdicts.collect()}
    depleted = 80 < 0.3 * (words + 80)
    assert all(not out[i].base_failed and out[i].kept != depleted and out[i].removed_words == words for i in range(200))
    assert all(out[i].kept and not out[i].removed for i in [*range(1000, 1300), *range(2000, 2050), 5000])
    assert [out[6000 + i].kept for i in range(10)] == [45 + i >= 50 for i in range(10)]
    left = {r.doc_id: r.text for r in quality.cleaned(docs, verdicts).collect()}
    assert (3 in left) != depleted and left.get(3, own(3)) == own(3) and left[5000].count("\n") == 3 and left[6009] == own("s9", 54)
    assert set(left) == {i for i, r in out.items() if r.kept}


def test_cleaned_rows_keep_their_number(spark):
    """Rows that repeat an id or have none: each meets its own verdict, once."""
    common = own("line", 20)
    rows = [(1, f"{common}\n{own(i // 2)}", "s", 7) for i in range(20)] + [(None, own("x"), None, 1), (None, own("x"), None, 1), (1, None, "s", None), (None, "short", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = quality.cleaned(docs, quality.rules(docs, spark)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(1, own(i // 2)) for i in range(20)] + [(None, own("x"))] * 2)
    assert all(r.n_chars == (len(r.text) if r.doc_id else 1) for r in out)


@pytest.mark.parametrize("folder", [SMALL])
def test_rows_agree_whatever_the_partitions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a, b = (sorted(map(tuple, quality.op3(d, spark).collect())) for d in (docs, docs.repartition(9)))
    assert a == b


def test_very_many_distinct_words():
    import numpy as np

    n = np.arange(1 << 21)
    assert quality.repeated_words(n) == 0 and quality.repeated_words(np.r_[n, n[:5]]) == 10
