"""Python in groups: a call for a block of users, and the same rows as for each user."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tellurix.plans import extension

T = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Many users with few events each, instants that several share, and rows without a user or a time."""
    r, out = random.Random(3), str(tmp_path_factory.mktemp("events"))
    rows = [(e, r.choice([None, *range(400)]), None if e % 97 == 0 else T + timedelta(minutes=30 * r.randrange(900)), r.choice(["view", "view", "purchase"]), r.random()) for e in range(6000)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{out}/events.parquet")
    return out, rows


@pytest.fixture(params=[None, 200])
def rows_of_a_call(request, monkeypatch):
    """All users of a week in one call, or about so many rows."""
    if request.param:
        monkeypatch.setattr(extension, "ROWS", request.param)


def test_nearest_views_of_many_users_in_a_call(spark, folder, rows_of_a_call):
    path, rows = folder
    views = {}
    for e, u, t, kind, _ in rows:
        if kind == "view" and u is not None and t is not None:
            views.setdefault(u, []).append((t, e))

    def nearest(u, t):
        near = [(abs(s - t), s, e) for s, e in views.get(u, []) if abs(s - t) <= timedelta(hours=6)] if t is not None else []
        return min(near)[2] if near else None

    want = sorted((e, nearest(u, t)) for e, u, t, kind, _ in rows if kind == "purchase")
    assert sorted(map(tuple, extension.cogrouped_nearest(spark, path).collect())) == want


def test_anomalies_of_many_users_in_a_call(spark, folder, rows_of_a_call):
    path, rows = folder
    values = {}
    for _, u, _, _, v in rows:
        values.setdefault(u, []).append(v)
    got = {r.event_id: r.anomaly for r in extension.grouped_map(spark, path).collect()}
    assert got == {e: pytest.approx(v - sum(values[u]) / len(values[u]), abs=2e-9) for e, u, _, _, v in rows}


@pytest.mark.parametrize("rows, most", [(20_000, 1), (1_000, 8)])
def test_calls_follow_the_rows_and_not_the_users(spark, folder, monkeypatch, rows, most):
    monkeypatch.setattr(extension, "ROWS", rows)
    events = spark.read.parquet(f"{folder[0]}/events.parquet")
    found = events.select(extension.blocks(events).alias("block")).distinct().count()
    assert 1 <= found <= most
