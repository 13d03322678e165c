"""Streams: the same rows as the batch form for windows that closed, late rows dropped, state kept between batches."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest

from tellurix.sources import formats
from tellurix.streaming import sinks, verification

T = datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp_ntz, value double"


def files(spark, folder, parts):
    """One file for each part, in order of their modification times."""
    for i, rows in enumerate(parts):
        path = f"{folder}/{i}.json"
        with open(path, "w") as f:
            f.writelines(f'{{"event_id": {e}, "user_id": {u}, "ts": "{(T + timedelta(minutes=m)).isoformat()}", "value": {v}}}\n' for e, u, m, v in rows)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return formats.stream(spark, folder, SCHEMA, "json", files_per_batch=1)


def run(spark, df, folder, mode="append"):
    name = f"out_{abs(hash(str(folder)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for s in p["stateOperators"])
    return spark.table(name).collect(), dropped


def test_tumbling_scores_emit_closed_windows_and_drop_late_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    parts = [[(1, 1, 0, 1.0), (2, 1, 5, 3.0)], [(3, 1, 40, 2.0)], [(4, 1, 90, 2.0)], [(5, 1, 1, 99.0)], [(6, 1, 200, 1.0)]]
    df = files(spark, str(tmp_path / "in"), parts).selectExpr("ts", "value as f", "0.0D as o")
    rows, dropped = run(spark, verification.scores_by_window(df, "ts", "15 minutes"), tmp_path / "in")
    first = [r for r in rows if r.start == T]
    assert [(r.n, r.bias) for r in first] == [(2, 2.0)] and dropped == 1


def test_sessions_and_first_rows(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    parts = [[(1, 1, 0, 1.0), (1, 1, 10, 1.0)], [(2, 1, 100, 1.0)], [(3, 1, 400, 1.0)]]
    rows, _ = run(spark, verification.sessions(files(spark, str(tmp_path / "a"), parts), "ts", "30 minutes", "user_id"), tmp_path / "a")
    assert sorted((r.start, r.n) for r in rows)[0] == (T, 2)
    rows, _ = run(spark, verification.once(files(spark, str(tmp_path / "b"), parts), "ts", ["event_id"]), tmp_path / "b")
    assert sorted(r.event_id for r in rows) == [1, 2, 3]


def test_streams_are_matched_within_their_bound(spark, tmp_path):
    (tmp_path / "f").mkdir(), (tmp_path / "o").mkdir()
    f = files(spark, str(tmp_path / "f"), [[(1, 1, 0, 5.0)], [(2, 1, 60, 6.0)]]).selectExpr("user_id", "ts as ft", "value as f")
    o = files(spark, str(tmp_path / "o"), [[(1, 1, 3, 7.0)], [(2, 1, 30, 8.0)]]).selectExpr("user_id", "ts as ot", "value as o")
    rows, _ = run(spark, verification.matched(f, o, "user_id", 600), tmp_path / "f")
    assert [(r.f, r.o) for r in rows] == [(5.0, 7.0)]


def test_running_persistence_keeps_the_last_value(spark, tmp_path):
    pytest.importorskip("google.protobuf", reason="Spark's state protocol needs protobuf")
    (tmp_path / "s").mkdir()
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        parts = [[(1, 1, 0, 1.0), (2, 1, 5, 3.0)], [(3, 1, 9, 7.0), (4, 2, 9, 1.0)]]
        rows, _ = run(spark, verification.running_persistence(files(spark, str(tmp_path / "s"), parts)), tmp_path / "s")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert sorted((r.event_id, r.f, r.o) for r in rows) == [(2, 1.0, 3.0), (3, 3.0, 7.0)]


def frames_of(spark, parts):
    return [spark.createDataFrame([(e, u, T + timedelta(minutes=m), v) for e, u, m, v in p], SCHEMA) for p in parts]


PARTS = [[(1, 1, 0, 1.0), (2, 1, 5, 3.0)], [(3, 1, 300, 2.0)], [(4, 1, 10, 9.0), (5, 2, 310, 4.0)], [(6, 2, 4000, 5.0)]]


def test_a_parquet_sink_goes_on_from_its_checkpoint(spark, tmp_path):
    folder = f"file://{tmp_path}"
    start = lambda s: sinks.to_parquet(verification.once(s, "ts", ["event_id"]).select("event_id"), folder)
    parts = frames_of(spark, [PARTS[0], PARTS[0], PARTS[1], PARTS[3]])
    sinks.fed(parts[:2], folder, start)
    sinks.fed(parts[2:], folder, start)
    start(formats.stream(spark, f"{folder}/in", SCHEMA)).awaitTermination()
    assert sorted(r.event_id for r in sinks.rows(spark, f"{folder}/rows", "event_id long").collect()) == [1, 2, 3, 6]


def replayed(folder, start, spark):
    """Runs the last batch again, as after a crash between its output and its commit."""
    done = sorted(folder.glob("state/commits/[0-9]*"), key=lambda p: int(p.name))[-1]
    done.unlink()
    (done.parent / f".{done.name}.crc").unlink(missing_ok=True)
    start(formats.stream(spark, f"file://{folder}/in", SCHEMA)).awaitTermination()


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}"
    start = lambda s: sinks.by_batch(s, folder, sinks.late_apart("ts", "1 hour", folder))
    sinks.fed(frames_of(spark, PARTS), folder, start)
    read = lambda name: sorted(r.event_id for r in sinks.rows(spark, f"{folder}/{name}", SCHEMA).collect())
    want = ([1, 2, 3, 5, 6], [4])
    assert (read("on_time"), read("late")) == want
    replayed(tmp_path, start, spark)
    assert (read("on_time"), read("late")) == want


def test_updates_come_to_the_last_of_each_key(spark, tmp_path):
    folder = f"file://{tmp_path}"
    start = lambda s: sinks.by_batch(s.groupBy("user_id").count(), folder, lambda batch, _: {"rows": batch}, "update")
    sinks.fed(frames_of(spark, PARTS), folder, start)
    read = lambda: sorted(map(tuple, sinks.latest(sinks.rows(spark, f"{folder}/rows", "user_id long, count long, batch long"), ["user_id"]).collect()))
    assert read() == [(1, 4), (2, 2)]
    replayed(tmp_path, start, spark)
    assert read() == [(1, 4), (2, 2)]


def state_rows(query):
    return sum(s["numRowsTotal"] for s in query.recentProgress[-1]["stateOperators"])


def test_forecasts_without_a_match_are_emitted_and_state_is_let_go(spark, tmp_path):
    folder = f"file://{tmp_path}"
    start = lambda s: sinks.to_parquet(verification.matched(s.selectExpr("user_id", "ts as ft", "event_id as f"), s.selectExpr("user_id", "ts as ot", "event_id as o").where("o % 2 = 0"), "user_id", 600, "10 minutes", "left_outer"), folder)
    parts = [[(i, i % 7, i, 1.0) for i in range(k * 200, k * 200 + 200)] for k in range(4)] + [[(10_000, 99, 100_000, 1.0)]]
    runs = sinks.fed(frames_of(spark, parts), folder, start)
    out = sinks.rows(spark, f"{folder}/rows", "user_id long, ft timestamp, ot timestamp, f long, o long").where("f < 10000").collect()
    events = [(e, u, m) for p in parts[:4] for e, u, m, _ in p]
    want = {(e, o) for e, u, m in events for o, v, n in events if v == u and o % 2 == 0 and 0 <= n - m <= 10}
    want |= {(e, None) for e, *_ in events if not any(x == e for x, _ in want)}
    assert {(r.f, r.o) for r in out} == want and len(out) == len(want)
    assert max(map(state_rows, runs[:4])) < 800 and state_rows(runs[-1]) <= 2


def test_timers_close_sessions_and_leave_no_state(spark, tmp_path):
    pytest.importorskip("google.protobuf", reason="Spark's state protocol needs protobuf")
    folder = f"file://{tmp_path}"
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        parts = [[(1, 1, 0, 1.0), (2, 1, 50, 1.0), (3, 2, 0, 1.0)], [(4, 1, 25, 1.0), (5, 1, 90, 1.0)], [(6, 3, 9000, 1.0)]]
        sinks.fed(frames_of(spark, parts), folder, lambda s: sinks.to_parquet(verification.timed_sessions(s, "ts", 1800, "user_id", "3 hours"), folder))
    finally:
        spark.conf.set(name, old)
    out = sinks.rows(spark, f"{folder}/rows", "key string, start long, last long, n long").collect()
    minute = lambda m: int((T + timedelta(minutes=m) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert sorted(map(tuple, out)) == [("1", minute(0), minute(50), 3), ("1", minute(90), minute(90), 1), ("2", minute(0), minute(0), 1)]
    held = spark.read.format("statestore").option("stateVarName", "open").load(f"{folder}/state")
    assert [r.key.key for r in held.select("key").distinct().collect()] == ["3"]


def test_a_block_of_keys_has_one_row_of_state(spark, tmp_path):
    pytest.importorskip("google.protobuf", reason="Spark's state protocol needs protobuf")
    folder = f"file://{tmp_path}"
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        user = lambda e: None if e % 41 == 40 else e % 41
        first = [(e, user(e), e * 37 % 400, 1.0) for e in range(300)]
        second = [(e, user(e), 200 + e * 53 % 900, 1.0) for e in range(300, 500)]
        start = lambda s: sinks.to_parquet(verification.timed_sessions(s, "ts", 1800, "user_id", "10 hours", 4), folder)
        sinks.fed(frames_of(spark, [first, second]), folder, start)
        open_ = spark.read.format("statestore").option("stateVarName", "open").load(f"{folder}/state")
        assert 1 <= open_.count() <= 4
        sinks.fed(frames_of(spark, [[(900, 77, 90_000, 1.0)]]), folder, start)
    finally:
        spark.conf.set(name, old)
    want, times = [], {}
    for e, u, m, _ in first + second:
        times.setdefault(u, []).append(m)
    for u, ms in times.items():
        runs = []
        for m in sorted(ms):
            if runs and m < runs[-1][-1] + 30:
                runs[-1].append(m)
            else:
                runs.append([m])
        want += [(str(u), r[0], r[-1], len(r)) for r in runs]
    minute = lambda us: (us - int((T - datetime(1970, 1, 1)).total_seconds() * 1e6)) // 60_000_000
    out = sinks.rows(spark, f"{folder}/rows", "key string, start long, last long, n long").collect()
    assert sorted((str(r.key), minute(r.start), minute(r.last), r.n) for r in out) == sorted(want)
