from __future__ import annotations

import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tellurix.llm import common, warc

COLUMNS = "page_id long, url string, timestamp string, html string, digest string, refers_to long, file string, run string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "f", "r") for r in rows], COLUMNS)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree_merges_like_a_sort(runs):
    merged = list(warc.LoserTree([iter(sorted((x, i) for x in run)) for i, run in enumerate(runs)]))
    assert merged == sorted((x, i) for i, run in enumerate(runs) for x in run)


def test_records_round_trip():
    for url, html, refers in (("http://a/ü?\r\nX: y", "é" * 9, None), (None, "", None), ("u", "\r\n\r\nbody\r\n\r\n", None), ("u", "body", 7)):
        fields, http, payload = warc.read_record(warc.record(url, 3, "2024-01-01T00:00:00Z", html.encode(), digest(html), refers))
        assert warc.number(fields["WARC-Record-ID"]) == 3 and fields["WARC-Payload-Digest"] == f"sha1:{digest(html)}"
        assert payload == (html.encode() if refers is None else b"") and f"Content-Length: {len(html.encode())}" in http.decode()
        assert "X" not in fields and ("WARC-Refers-To" in fields) == (refers is not None)


def test_captures(spark):
    same = "<p>same</p>"
    rows = [(i, f"http://WWW.b.org/{i % 3}", f"2024-01-0{1 + i % 9}T00:00:00Z", same) for i in range(60)]  # a hot payload and hot urls
    rows += [(100, "https://a.com:80/x?q=1#f", "2024-01-01T00:00:00Z", "<b>é</b>"), (101, None, "2024-01-01T00:00:00Z", None), (102, "not a url", None, ""), (None, "http://a.com/", "2024", same), (103, "http://a.com/", "2024", "x" * 300000)]
    rows += [(59, "http://b.org/again", "2024", same)]  # the largest id, repeated
    out = warc.captures(pages(spark, rows).repartition(7), spark).collect()
    out.sort(key=lambda r: (r.part, r.place))
    assert len({r.part for r in out}) > 1
    keys = [(r.url_key, r.timestamp or "", -1 if r.page_id is None else r.page_id) for r in out]
    assert len(out) == len(rows) and keys == sorted(keys)
    want = sorted(repr((i, len((h or "").encode()), digest(h), "revisit" if h == same and i != 59 else "revisit" if i == 101 else "response", 59 if h == same and i != 59 else 102 if i == 101 else None)) for i, _, _, h in rows)
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out) == want
    assert next(r.url_key for r in out if r.page_id == 100) == "com,a)/x?q=1" or next(r.url_key for r in out if r.page_id == 100) == "com,a):80/x?q=1"


def test_small_payloads_may_be_left_alone(spark):
    out = warc.captures(pages(spark, [(1, "u", "2024", "ab"), (2, "u", "2024", "ab"), (3, "u", "2024", "abcd"), (4, "u", "2024", "abcd")]), spark, least_bytes=3)
    assert {r.page_id: r.record_type for r in out.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_no_pages(spark):
    assert warc.captures(pages(spark, []), spark).count() == 0


def test_files_hold_what_the_captures_say(spark, monkeypatch):
    """Each row's archive, read at its offset, holds its record; and a folder that tasks can't open is refused."""
    out = warc.captures(pages(spark, [(i, f"http://h{i % 5}/", "2024", f"page {i}") for i in range(40)]), spark).collect()
    archives = warc.Archives()
    for r in out:
        fields, _, payload = warc.read_record(archives.read(r.file, r.offset, 10000))
        assert warc.number(fields["WARC-Record-ID"]) == r.page_id and payload == f"page {r.page_id}".encode()
    monkeypatch.setattr(common, "shared_folder", lambda spark: "wasb://store/shared")
    with pytest.raises(ValueError, match="pyarrow"):
        warc.captures(pages(spark, []), spark)


def test_more_runs_than_are_merged_at_a_time(spark, monkeypatch):
    """17 runs, 3 at a time: two passes before the last merge, no group above 3, rows and order as without passes."""
    rows = [(None if i % 50 == 7 else i, None if i % 9 == 0 else f"http://h{i % 4}.org/{i % 5}", None if i % 11 == 0 else f"2024-{i % 3}", f"page {i % 60}") for i in range(200)]
    docs = pages(spark, rows).repartition(17)
    whole = warc.captures(docs, spark)
    monkeypatch.setattr(warc, "FAN_IN", 3)
    sizes, plain = [], warc.groups_of_runs

    def spied(runs, n):
        out = plain(runs, n)
        sizes.append((n, [len(r.slices) for r in out.collect()]))
        return out

    monkeypatch.setattr(warc, "groups_of_runs", spied)
    few = warc.captures(docs, spark)
    assert len(sizes) >= 2 and sizes[0][0] > 9 and all(max(x) <= 3 and sum(x) == n for n, x in sizes)
    key = lambda r: (r.url_key, r.timestamp or "", -1 if r.page_id is None else r.page_id)
    got = sorted(few.collect(), key=lambda r: (r.part, r.place))
    assert list(map(key, got)) == sorted(map(key, got))
    bare = lambda df: sorted(repr(r[:-4]) for r in df.collect())
    assert bare(few) == bare(whole) and len(got) == 200
