"""License scans: fixed phrases, and diagonal voting of word k-grams against the texts of known notices."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurix.llm.common import WordHashes, long_lists, per_batch, record_batch, rolling

# The base phrases and their labels.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

# Public licence texts by paragraph, and the notices that name a licence.
AS_IS = "IS PROVIDED {} ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
TEMPLATES = {
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "Released under the MIT License", "Licensed under the MIT License",
    ],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "licensed under the GNU General Public License, version 3",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "licensed under the GNU Lesser General Public License",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "licensed under the GNU Affero General Public License, version 3",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE " + AS_IS.format("BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "licensed under the BSD 3-Clause License", "licensed under the BSD 2-Clause License",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        "licensed under the ISC License",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "licensed under the Mozilla Public License, version 2.0"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
}
# Identifiers of licences, as in "SPDX-License-Identifier: MIT".
SPDX = {
    "mit": ["MIT"], "apache": ["Apache-2.0"], "gpl": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "isc": ["ISC"], "mpl": ["MPL-2.0"],
    "unlicense": ["Unlicense"], "zlib": ["Zlib"], "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"],
}
NOTICES = {label: [*texts, *(f"SPDX-License-Identifier: {x}" for x in SPDX[label])] for label, texts in TEMPLATES.items()}

#: Words in a k-gram; difference of diagonals and gap in words that are still one span; least part of a notice's words
#: that a span must hold in order, and least part of the span's own words that these must be.
K, SLACK, GAP = 4, 4, 8
LEAST_HELD, LEAST_DENSE = 0.8, 0.6
#: Notices of fewer words than this differ from each other in one, and must be held whole.
SHORT = 12
#: A candidate is looked at word by word when its k-grams hold this part of its notice.
LEAST_VOTED = 0.4
#: What goes on with an identifier after its last word; a run of a word's bytes.
FURTHER, RUN = re.compile(rb"[-.+][0-9A-Za-z]"), re.compile(rb"[^ ]+")
DELIMITERS = bytes(32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(DELIMITERS).split()


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """Where a base phrase starts, and its label."""
    out, at = [], -1
    for _ in range(words.count(b"license")):
        at = words.index(b"license", at + 1)
        for phrase, label in PHRASES.items():
            start = at - len(phrase) + 1
            if start >= 0 and words[start : at + 1] == [w.encode() for w in phrase]:
                out.append((start, label))
    return out


def base(batch: pa.RecordBatch) -> pa.RecordBatch:
    cols = {"n_words": [], "n_base": [], "first_word": [], "last_word": [], "base_labels": []}
    for text in batch.column("text").to_pylist():
        words = words_of(text)
        found = places(words)
        starts = [s for s, _ in found]
        for k, v in zip(cols, (len(words), len(found), min(starts, default=None), max(starts, default=None), sorted({x for _, x in found})), strict=True):
            cols[k].append(v)
    types = [*[pa.int64()] * 4, pa.list_(pa.string())]
    return record_batch({"key": (batch.column("key"), pa.string()), "doc_id": (batch.column("doc_id"), pa.int64())} | {k: (v, t) for (k, v), t in zip(cols.items(), types, strict=True)})


def grams(batch: pa.RecordBatch, memo=WordHashes()) -> pa.RecordBatch:  # noqa: B008  kept between batches
    lists = long_lists([rolling(memo.of(words_of(text)), K) for text in batch.column("text").to_pylist()])
    return pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "grams"])


def notices(spark: SparkSession) -> DataFrame:
    """Every position of every notice: gram, notice, label, at, size. A fixed table of a few hundred rows."""
    rows, number = [], 0
    for label, texts in NOTICES.items():
        for text in texts:
            words = words_of(text)
            hashes = rolling(WordHashes().of(words), K).view(np.int64).tolist()
            rows += [(h, number, label, at, len(words)) for at, h in enumerate(hashes)]
            number += 1
    return spark.createDataFrame(rows, "gram long, notice int, label string, at int, size int")


def spans(keyed: DataFrame, spark: SparkSession) -> DataFrame:
    """Verified spans of `keyed` (key, text): key, label, start, end (in words, end exclusive), held.

    Every k-gram of every text is joined to the notices' positions. A match votes for the diagonal text position -
    notice position; votes are added up by diagonal, and diagonals that lie within SLACK of the one before and within
    GAP words of its span are one candidate, as words may be missing or put in. A candidate is verified word by word: its
    words and a few on either side are aligned with the notice's, and must hold LEAST_HELD of these in order, as
    LEAST_DENSE of their own; short notices must stand there whole. Of overlapping spans the best stays (see `best_alone`). A diagonal has at most as many votes as its notice has words, so no group is large; only
    texts with candidates meet them, a text's candidates being bounded by its words.
    """
    all_ = per_batch(keyed, grams, "key string, grams array<long>").select("key", F.posexplode("grams").alias("pos", "gram"))
    votes = all_.join(F.broadcast(notices(spark)), "gram")
    diagonal = votes.groupBy("key", "notice", "label", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.min("pos").alias("start"), (F.max("pos") + K).alias("end"), F.collect_set("at").alias("held")
    )
    w = Window.partitionBy("key", "notice").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > SLACK) | (F.col("start") > F.lag("end").over(w) + GAP) | (F.lag("start").over(w) > F.col("end") + GAP), F.lit(True))
    group = diagonal.withColumn("_g", F.sum(apart.cast("int")).over(w)).groupBy("key", "notice", "label", "size", "_g")
    merged = group.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.flatten(F.collect_list("held")).alias("held"))
    words = F.size(F.array_distinct(F.flatten(F.transform("held", lambda x: F.sequence(x, x + K - 1)))))
    likely = merged.where(words >= LEAST_VOTED * F.col("size")).groupBy("key").agg(F.collect_set(F.struct("notice", "label", "start", "end")).alias("spans"))
    return per_batch(keyed.join(likely, "key").dropDuplicates(["key"]), verified, "key string, label string, start int, end int, held double")


def ends_there(raw: bytes, end: int) -> bool:
    """Whether an identifier of which the last word ends at this byte goes no further: MIT-0 is not MIT."""
    return not FURTHER.match(raw, end)


def best_alone(found: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Of spans (label, start, end, words held, words of the notice) that share more than half of the shorter one's words and have
    different labels, those of the notice that explains most: its held words less those that are missing. Licences copy each
    other's sentences, and what tells them apart are these few words."""
    worth = lambda s: 2 * s[3] - s[4]
    kept: list[tuple[str, int, int, int, int]] = []
    for s in sorted(found, key=worth, reverse=True):
        shared = lambda k: min(s[2], k[2]) - max(s[1], k[1])  # noqa: E731, B023
        if not any(k[0] != s[0] and worth(k) > worth(s) and 2 * shared(k) > min(s[2] - s[1], k[2] - k[1]) for k in kept):
            kept.append(s)
    return kept


def verified(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Aligns each candidate's words with its notice's."""
    out = []
    every = [(words_of(x), x.startswith("SPDX-")) for own in NOTICES.values() for x in own]
    for key, text, spans_ in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "spans")), strict=True):
        raw = (text or "").encode()
        places_ = [m.span() for m in RUN.finditer(raw.lower().translate(DELIMITERS))]
        words, found = words_of(text), []
        for s in spans_:
            notice, identifier = every[s["notice"]]
            lo, hi = max(0, s["start"] - SLACK), min(len(words), s["end"] + SLACK)
            same = [(i, n) for i, _, n in SequenceMatcher(None, words[lo:hi], notice, autojunk=False).get_matching_blocks() if n]
            held = sum(n for _, n in same)
            start, end = (lo + same[0][0], lo + same[-1][0] + same[-1][1]) if same else (lo, hi)
            least = (1, 1) if len(notice) < SHORT else (LEAST_HELD, LEAST_DENSE)
            if held >= least[0] * len(notice) and held >= least[1] * (end - start) and (not identifier or ends_there(raw, places_[end - 1][1])):
                found.append((s["label"], start, end, held, len(notice)))
        out += [(key, label, start, end, held / size) for label, start, end, held, size in best_alone(found)]
    columns = list(zip(*out, strict=True)) or [()] * 5
    types = {"key": pa.string(), "label": pa.string(), "start": pa.int32(), "end": pa.int32(), "held": pa.float64()}
    return record_batch({k: (list(v), t) for (k, t), v in zip(types.items(), columns, strict=True)})


def scan(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """Per row of `docs` (doc_id, text; other columns are dropped): n_words, the base phrases' n_base, first_word,
    last_word and base_labels, labels with those of verified spans, and score: 1 with a base phrase, else the part of
    a notice that the best span holds, else 0.

    A-Z are lower-cased. A null or empty text has no words, null places and empty labels; rows equal in id and text
    have equal results; very long texts are scanned whole; an empty table gives an empty one. Only the few matching
    k-grams leave the first pass.
    """
    keyed = docs.select(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text")).alias("key"), "doc_id", "text")
    own = per_batch(keyed, base, "key string, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>")
    found = spans(keyed.select("key", "text"), spark).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("held").alias("held"))
    out = own.join(found, "key", "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("held", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
