from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from odd import PROSE, no_documents, odd_documents

from tellurix.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for i in range(len(w)) for p, label in licenses.PHRASES.items() if tuple(w[i : i + len(p)]) == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "license", "License,", "apache", "general", "Public", "public-license", "é", "licenses", "x\x85license", "\n", "ſ", "K"]), max_size=20))
def test_places(words):
    text = " ".join(words)
    w = licenses.words_of(text)
    found = licenses.places(w)
    starts = [s for s, _ in found]
    assert (len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))) == brute(text)


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, at int, label string")
    return {r.doc_id: r for r in licenses.scan(df, spark).collect()}


def test_notices_with_words_missing_put_in_and_changed(spark):
    bsd = licenses.NOTICES["bsd"][0]
    w = bsd.split()
    texts = [
        f"{PROSE} {bsd.upper()} {PROSE}", " ".join(w[:8] + ["really", "truly"] + w[8:]), " ".join(w[:6] + w[8:]), " ".join(w[:7]), " ".join(reversed(w)), "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0",
        f"{bsd} {PROSE * 3} {bsd}", " ".join(x for p in zip(w, ["and"] * len(w), strict=True) for x in p), "the mit license and the mit license", "licensed under the",
    ]
    out = scan(spark, texts)
    assert [out[i].labels for i in range(11)] == ["bsd", "bsd", "bsd", "", "", "cc-by-nc", "cc-by", "bsd", "", "mit", ""]
    assert out[0].score == 1.0 and 0.8 <= out[2].score < 1 and out[3].score == 0.0 and out[9].score == 1.0 and (out[9].first_word, out[9].last_word) == (1, 5)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    out = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in licenses.scan(docs, spark).collect())
    assert out == sorted(repr((r.doc_id, *brute(r.text))) for r in docs.collect())
    assert licenses.scan(no_documents(spark), spark).count() == 0


def test_whole_texts_identifiers_and_changed_words(spark):
    mit, disclaimer = " ".join(licenses.TEMPLATES["mit"][:3]), licenses.TEMPLATES["bsd"][4]
    texts = ["SPDX-License-Identifier: Apache-2.0", "// SPDX-License-Identifier: BSD-3-Clause", disclaimer, mit, licenses.TEMPLATES["lgpl"][0], "x " + licenses.TEMPLATES["zlib"][0].upper(), "permission to use the software"]
    assert [r.labels for _, r in sorted(scan(spark, texts).items())] == ["apache", "bsd", "bsd", "mit", "gpl,lgpl", "zlib", ""]


def test_each_licence_has_its_own_label_alone(spark):
    """Whole texts and identifiers of all licences, and identifiers that are none of them: labels equal to what was planted."""
    texts, want = [], []
    for label, own in licenses.TEMPLATES.items():
        whole = [x for x in own if len(licenses.words_of(x)) >= licenses.SHORT] or own[:1]
        texts += [f"{PROSE} {' '.join(whole)}", *own, *(f"# SPDX-License-Identifier: {x}\n{PROSE}" for x in licenses.SPDX[label])]
        want += [label] * (1 + len(own) + len(licenses.SPDX[label]))
    texts += [f"SPDX-License-Identifier: {x}" for x in ("MIT-0", "Apache-2.0.1", "ISC-Veillard", "GPL-2.0-with-classpath-exception", "BSD-3-Clause-Clear", "MIT.x")]
    want += [""] * 6
    out = scan(spark, texts)
    for i, t in enumerate(texts):
        assert set(filter(None, out[i].labels.split(","))) == set(filter(None, {want[i]} | set(brute(t)[4].split(",")))), t
    ends = scan(spark, ["SPDX-License-Identifier: MIT.", "(SPDX-License-Identifier: MIT)", "SPDX-License-Identifier: MIT"])
    assert [ends[i].labels for i in range(3)] == ["mit"] * 3


def brute_spans(text):
    """Windows of the text that hold enough of a notice when aligned with it, without those that another licence's notice
    explains better: best part by label."""
    from difflib import SequenceMatcher

    words, found = licenses.words_of(text), []
    for label, notices in licenses.NOTICES.items():
        for notice in map(licenses.words_of, notices):
            for at in range(len(words)):
                window = words[at : at + len(notice)]
                if len(window) * 2 < len(notice) or window[:1] != notice[:1]:
                    continue
                held = sum(n for _, _, n in SequenceMatcher(None, window, notice, autojunk=False).get_matching_blocks())
                if held >= (1 if len(notice) < licenses.SHORT else licenses.LEAST_HELD) * len(notice):
                    found.append((label, at, at + len(window), held, len(notice)))
    best = {}
    for label, a, b, held, size in found:
        better = [x for x in found if x[0] != label and 2 * x[3] - x[4] > 2 * held - size and 2 * (min(b, x[2]) - max(a, x[1])) > min(b - a, x[2] - x[1])]
        if not better:
            best[label] = max(best.get(label, 0), held / size)
    return best


def test_labels_against_brute_force(spark):
    """Notices with one word left out, put in or changed in four, in prose: neither a label less nor one more."""
    import random

    r, texts = random.Random(4), []
    every = [x for own in licenses.TEMPLATES.values() for x in own]
    for _ in range(150):
        w = r.choice(every).split()
        for _ in range(r.randint(0, len(w) // 12)):
            w[r.randrange(2, len(w))] = f"w{r.randint(0, 99)}"
        texts.append(f"{PROSE[: r.randint(0, 200)]} {' '.join(w)} {PROSE[: r.randint(0, 99)]}")
    out = scan(spark, texts)
    for i, t in enumerate(texts):
        want, base = brute_spans(t), set(filter(None, brute(t)[4].split(",")))
        assert set(filter(None, out[i].labels.split(","))) == set(want) | base, t
        assert out[i].score == (1.0 if base else out[i].score) and (base or not want or out[i].score >= max(want.values()) - 0.1)  # longest blocks first: windows differ a little
