"""Streaming jobs over several micro-batches: late rows, restarts, timers, against plain versions."""

import datetime as dt
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from airgate.plans import registry
from airgate.streaming import jobs, marks, upserts

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)
TICKS = "event_id long, ts timestamp, gpu_class int, kind string, source string, usd double"


def write(spark, folder, name, rows, schema):
    """One file of a stream; files are read in the order in which they are written."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    (part,) = [f for f in os.listdir(f"{folder}/tmp-{name}") if f.startswith("part")]
    os.makedirs(f"{folder}/in", exist_ok=True)
    at = 1_700_000_000 + 60 * len(os.listdir(f"{folder}/in"))
    os.utime(f"{folder}/tmp-{name}/{part}", (at, at))
    os.rename(f"{folder}/tmp-{name}/{part}", f"{folder}/in/{name}.parquet")


def streamed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def utc(rows):
    return [tuple(x.replace(tzinfo=dt.UTC) if isinstance(x, dt.datetime) else x for x in r) for r in rows]


def plain_marks(batches, ttl, delay):
    held, mark, seen = {}, None, None
    for rows in batches:
        # A batch is judged by the watermark that the batches before it have set.
        late = seen - delay if seen else None
        for event_id, ts, *key, usd in rows:
            seen = max(seen, ts) if seen else ts
            if late and ts <= late:
                continue
            mark = held.setdefault(tuple(key), {"n": 0, "usd": [], "last": None})
            mark["n"] += 1
            mark["usd"] += [usd] if usd is not None else []
            mark["last"] = max(mark["last"] or (ts, event_id, usd), (ts, event_id, usd), key=lambda m: m[:2])
    mark = seen - delay
    return {
        k: (m["n"], min(m["usd"], default=None), max(m["usd"], default=None), m["last"][2], m["last"][1], m["last"][0] + ttl < mark)
        for k, m in held.items()
    }


def marks_of(found):
    return {(r["gpu_class"], r["kind"], r["source"]): (r["n"], r["low"], r["high"], r["usd"], r["event_id"], r["stale"]) for r in marks.last_told(found).collect()}


def tick_batches(seed):
    rng = np.random.default_rng(seed)
    out, event = [], 0
    for b in range(3):
        rows = []
        for _ in range(60):
            event += 1
            # Now and then a tick comes days late; sources fall silent for a while.
            hours = 36 * b + rng.random() * 36 - (80 if rng.random() < 0.1 else 0)
            source = (["a", "b", None], ["a"], ["a", None])[b][int(rng.integers(0, 6)) % (3, 1, 2)[b]]
            rows.append((event, START + dt.timedelta(hours=100 + round(hours, 3)), int(rng.integers(0, 3)), "spot", source, None if rng.random() < 0.1 else round(float(rng.random()), 3)))
        out.append(rows)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_marks_with_late_ticks_and_restarts(spark, tmp_path, seed):
    batches = tick_batches(seed)
    ttl, delay = dt.timedelta(hours=24), dt.timedelta(hours=1)
    with marks.keyed_state(spark):
        for upto, rows in enumerate(batches, 1):
            write(spark, tmp_path, f"f{upto}", utc(rows), TICKS)
            # Each run goes on from the checkpoint of the one before.
            found = jobs.drained(marks.latest_marks(streamed(spark, tmp_path, TICKS)), "update", f"{tmp_path}/job")
            assert marks_of(found) == plain_marks(batches[:upto], ttl, delay)
        at_once = jobs.drained(marks.latest_marks(streamed(spark, tmp_path, TICKS)), "update", f"{tmp_path}/whole")
    want, got = plain_marks(batches, ttl, delay), marks_of(at_once)
    # Within one run a micro-batch's rows are judged by the watermark of the last but one, so it may keep more of them.
    assert all(got[k][0] >= w[0] and got[k][3:] == w[3:] for k, w in want.items()) and {w[-1] for w in want.values()} == {True, False}
    assert sum(w[0] for w in want.values()) < 180  # late ticks are left out


def test_a_stale_mark_is_taken_back(spark, tmp_path):
    rows = [(1, START, 0, "spot", "a", 2.0)], [(2, START + 3 * DAY, 0, "spot", "b", 3.0)], [(3, START + 3 * DAY, 0, "spot", "a", 1.0)]
    said = []
    with marks.keyed_state(spark):
        for k, r in enumerate(rows):
            write(spark, tmp_path, f"f{k}", utc(r), TICKS)
            found = marks_of(jobs.drained(marks.latest_marks(streamed(spark, tmp_path, TICKS)), "update", f"{tmp_path}/job"))
            said.append(found[(0, "spot", "a")])
    assert said == [(1, 2.0, 2.0, 2.0, 1, False), (1, 2.0, 2.0, 2.0, 1, True), (2, 1.0, 2.0, 1.0, 3, False)]


def test_trailing_volume_slides_over_panes_and_drops_late_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    schema = "ts timestamp, county string"
    batches, kept, latest, before = [], [], None, None
    for b in range(3):
        rows = [(START + dt.timedelta(days=6 * b + float(rng.random()) * 6 - (12 if rng.random() < 0.05 else 0)), f"c{int(rng.integers(0, 3))}") for _ in range(80)]
        mark = before
        # What lies in a pane that the watermark has passed comes too late.
        kept += [r for r in rows if not mark or r[0].replace(hour=0, minute=0, second=0, microsecond=0) + DAY > mark]
        before = latest - DAY if latest else None
        latest = max([r[0] for r in rows] + [latest or START])
        batches.append(rows)
    for k, rows in enumerate(batches):
        write(spark, tmp_path, f"f{k}", utc(rows), schema)
    with marks.many_windows(spark):
        found = jobs.drained(marks.trailing_volume(streamed(spark, tmp_path, schema), "county", days=5), "append", f"{tmp_path}/job")
    panes = Counter((c, t.date()) for t, c in kept)
    passed = [min(d for _, d in panes) + k * DAY for k in range(40)]
    passed = [d for d in passed if dt.datetime.combine(d, dt.time()) + DAY <= latest - DAY]
    want = {(c, d): (panes[c, d], sum(panes[c, d - k * DAY] for k in range(5))) for c in ("c0", "c1", "c2") for d in passed}
    assert {(r["county"], r["day"]): (r["n"], r["behind"]) for r in found.collect()} == {k: v for k, v in want.items() if v[1]}
    assert len(kept) < 240


def test_first_sight_keeps_one_row_a_key(spark, sf):
    found = jobs.drained(jobs.first_sight(jobs.stream(spark, sf, "events"), ["user_id", "event_type"], "14 days"), "append").collect()
    rows = {r["event_id"]: r for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    keys = Counter((r["user_id"], r["event_type"]) for r in rows.values())
    assert sorted((r["user_id"], r["event_type"]) for r in found) == sorted(keys)
    assert all((rows[r["event_id"]]["user_id"], rows[r["event_id"]]["event_type"]) == (r["user_id"], r["event_type"]) for r in found)


def test_first_sight_drops_copies_of_later_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, url string"
    batches = [[(1, START, "u"), (2, START, "v")], [(3, START + 5 * DAY, "u"), (4, START + 30 * DAY, "w")], [(7, START + 30 * DAY, "x")], [(5, START + 31 * DAY, "u"), (6, START + 32 * DAY, "w")]]
    for k, rows in enumerate(batches):
        write(spark, tmp_path, f"f{k}", utc(rows), schema)
    found = jobs.drained(jobs.first_sight(streamed(spark, tmp_path, schema), ["url"], "14 days"), "append", f"{tmp_path}/job")
    # A copy within 14 days is dropped; one that comes after its key was let go, at the end of a batch, is a first sight again.
    assert sorted(r["event_id"] for r in found.select(F.col("event_id")).collect()) == [1, 2, 4, 5, 7]


def files(folder):
    return {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_only_the_parts_it_touches(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, at long, v string").schema
    table = upserts.PartedTable(spark, str(tmp_path), schema, "k", "at", parts=8)
    batch = lambda rows: spark.createDataFrame(rows, schema)
    assert table.read().count() == 0 and table.merge(batch([]), 0) == []
    assert len(table.merge(batch([(k, 1, "a") for k in range(50)] + [(None, 1, "x")]), 1)) == 8
    before = files(tmp_path / "data")
    assert len(table.merge(batch([(7, 2, "b")]), 2)) == 1
    new = set(files(tmp_path / "data")) - set(before)
    assert len({os.path.dirname(f) for f in new}) == 1 and all("number=2" in f for f in new) and before.items() <= files(tmp_path / "data").items()
    want = {k: "b" if k == 7 else "a" for k in range(50)}
    now = lambda: {r["k"]: r["v"] for r in table.read().collect()}
    assert now() == want
    # Run again, a batch changes nothing; an older row doesn't win over a newer one, a row of the same age does.
    table.merge(batch([(7, 2, "b")]), 2)
    assert now() == want and table.read().count() == 50
    table.merge(batch([(7, 1, "old"), (8, 1, "same"), (99, 5, "new")]), 3)
    want |= {8: "same", 99: "new"}
    assert now() == want
    # What was written without a mark doesn't count.
    import shutil

    shutil.rmtree(tmp_path / "marks" / "3")
    assert now() == {k: "b" if k == 7 else "a" for k in range(50)}
    table.merge(batch([(7, 1, "old"), (8, 1, "same"), (99, 5, "new")]), 3)
    assert now() == want


def test_a_stream_keeps_its_table_up_over_restarts(spark, tmp_path):
    schema, want = "k long, at long, v double", {}
    rng = np.random.default_rng(4)
    for b in range(3):
        rows = [(int(rng.integers(0, 30)), 100 * b + i, float(i)) for i in range(40)]
        want |= {k: v for k, _, v in rows}
        write(spark, tmp_path, f"f{b}", rows, schema)
        table = upserts.kept_up(streamed(spark, tmp_path, schema), "k", "at", 8, f"{tmp_path}/job")
        assert {r["k"]: r["v"] for r in table.read().collect()} == want
    assert max(table.versions().values()) == 2


def test_meter_equals_its_sql_on_odd_costs(spark, tmp_path):
    """Calls that cost nothing right where a run reaches its ceiling, unknown costs, credits, runs without an id."""
    runs = {
        1: [300.0, 200.0, 0.0, 0.0, 0.01, 0.0], 2: [499.99, 0.0, 0.01, 0.0], 3: [None, None], 4: [400.0, None, 150.0, None, 0.0, 1.0],
        5: [600.0, -50.0, 10.0, -300.0, 20.0], 6: [None, 700.0, 0.0, 1.0], None: [500.0, 0.0, 1.0], 7: [0.0, 1.0],
    }
    rows = [(k * 10 + (run or 0), START + k * DAY, run, "click", cost, "") for run, costs in runs.items() for k, cost in enumerate(costs)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.orderBy(F.col("event_id").desc()).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    names = ["user_id", "event_id", "spent", "refused"]
    want = duck.execute(f"select {', '.join(names)} from ({registry.ORACLES['str4_metered']})").fetchall()
    got = registry.QUERIES["str4_metered"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) == len(rows)


def test_meter_goes_on_in_later_batches(spark, tmp_path):
    schema = "user_id long, event_id long, value double"
    batches = [[(1, 1, None), (1, 2, 400.0)], [(1, 4, 0.0), (1, 3, 100.0)], [(1, 5, 0.0), (1, 6, 5.0), (2, 7, None)]]
    for k, rows in enumerate(batches):
        write(spark, tmp_path, k, rows, schema)
    found = jobs.drained(jobs.metered(streamed(spark, tmp_path, schema), ceiling=500.0), "append", str(tmp_path / "run"))
    want = [(1, 1, None, False), (1, 2, 400.0, False), (1, 3, 500.0, False), (1, 4, 500.0, False), (1, 5, 500.0, False), (1, 6, 500.0, True), (2, 7, None, False)]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want
