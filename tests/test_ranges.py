"""Sessions and lockouts by ranges of times against plain loops."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import events

START = datetime.datetime(1969, 12, 31, 23, 0)


def rows(n=400):
    rng = np.random.default_rng(9)
    out, at = [], 0
    for i in range(n):
        at += int(rng.choice([0, 1, 3, 5, 6, 40, 400], p=[0.1, 0.4, 0.2, 0.1, 0.1, 0.05, 0.05]))
        out.append((i, [1, 1, 1, 2, None][int(rng.integers(0, 5))], START + datetime.timedelta(seconds=at), bool(rng.random() < 0.8)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "event_id int, user_id int, ts timestamp, fail boolean")


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_against_loops(spark, monkeypatch, stretch):
    monkeypatch.setattr(events, "STRETCH", stretch)
    data, gap = rows(), 5
    sessions, failures, state = [], {}, {}
    for key in {r[1] for r in data}:
        last = None
        for i, _, t, _ in sorted((r for r in data if r[1] == key), key=lambda r: (r[2], r[0])):
            if last is None or (t - last).total_seconds() > gap:
                sessions.append([key, sum(s[0] == key for s in sessions) + 1, t, t, 0])
            sessions[-1][3:] = [t, sessions[-1][4] + 1]
            last = t
        count, last, last_fail = 0, None, None
        for i, _, t, fail in sorted((r for r in data if r[1] == key), key=lambda r: (r[2], r[0])):
            if last is None or not fail or not last_fail or (t - last).total_seconds() > gap:
                count = 0
            count += fail
            failures[i] = count
            last, last_fail = t, fail
    df = frame(spark, data)
    got = {(r["user_id"], r["session"]): (r["start"], r["end"], r["n"]) for r in events.sessions_of(df, "user_id", gap).collect()}
    assert got == {(k, s): (a, b, n) for k, s, a, b, n in sessions} and not state
    locked = events.lockouts(df, "user_id", F.col("fail"), ~F.col("fail"), 3, gap)
    assert locked.columns == ["event_id", "user_id", "ts", "fail", "failures", "locked"]
    assert {r["event_id"]: (r["failures"], r["locked"]) for r in locked.collect()} == {i: (n, n >= 3) for i, n in failures.items()}
    assert events.sessions_of(df.limit(0), "user_id", gap).count() == events.lockouts(df.limit(0), "user_id", F.col("fail"), ~F.col("fail"), 3, gap).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_packing_against_a_loop(spark, parts):
    from sparkloom.operators import sequences

    rng = np.random.default_rng(11)
    data = [(int(rng.integers(0, 3)) if i % 50 else None, i, None if i % 31 == 0 else int(rng.choice([0, 1, 3, 9, 40, -2]))) for i in range(900)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for most_items, most_size in ((5, 20), (1, 100), (1000, 7), (300, 1000)):
            want = {}
            for key in {r[0] for r in data}:
                held = items = batch = 0
                for _, i, n in sorted((r for r in data if r[0] == key), key=lambda r: r[1]):
                    n = max(0, n or 0)
                    if items and (held + n > most_size or items >= most_items):
                        held, items, batch = 0, 0, batch + 1
                    held, items = held + n, items + 1
                    want[key, i] = batch
            df = spark.createDataFrame(data, "k int, i int, n int").repartition(5)
            assert {(r["k"], r["i"]): r["batch"] for r in sequences.packed(df, "k", "i", F.col("n"), most_items, most_size).collect()} == want
        assert sequences.packed(df.limit(0), "k", "i", F.col("n"), 3, 3).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
