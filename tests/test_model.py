"""Reads, retention and replay against a plain dictionary model."""

import random

import pytest

from keystrata.operators import compaction, oplog, reads, vsep

SCHEMA = "user_key string, seq long, type int, value string"


@pytest.fixture(scope="module")
def history():
    rng = random.Random(7)
    keys = [f"k{i}" for i in range(40)] + [""]
    return [(rng.choice(keys), seq, *((1, f"v{rng.randrange(1000)}") if rng.random() < 0.75 else (0, None))) for seq in range(1, 801)]


@pytest.fixture(scope="module")
def log(spark, history):
    return spark.createDataFrame(history, SCHEMA).repartition(4).cache()


def state(history, snapshot=None):
    out = {}
    for key, seq, kind, value in history:
        if snapshot is None or seq <= snapshot:
            out[key] = (seq, kind, value)
    return {k: v for k, (_, kind, v) in out.items() if kind}


@pytest.mark.parametrize("snapshot", [None, 0, 1, 400, 800])
def test_latest(log, history, snapshot):
    assert {r.user_key: r.value for r in reads.latest(log, snapshot).collect()} == state(history, snapshot)


def test_scan_bounds(log, history):
    live = state(history)
    assert [(r.user_key, r.value) for r in reads.scan(log, "k1", "k3").collect()] == sorted((k, v) for k, v in live.items() if "k1" <= k < "k3")
    assert reads.scan(log, "k1", "k1").count() == 0
    assert reads.scan(log, "k1", "").count() == 0
    assert reads.scan(log, "", "~").count() == len(live)


def test_scan_is_union_of_gets(log, history):
    live = state(history)
    for key in ["k0", "k7", "", "absent"]:
        assert [r.value for r in reads.get(log, key).collect()] == ([live[key]] if key in live else [])


@pytest.mark.parametrize("floor", [None, 1, 400, 800])
@pytest.mark.parametrize("bottom", [False, True])
def test_retention(log, history, floor, bottom):
    want, seen = [], set()
    for key, seq, kind, _ in reversed(history):
        if floor is not None and seq > floor:
            want.append((key, seq))
        elif key not in seen:
            seen.add(key)
            if not (bottom and kind == 0):
                want.append((key, seq))
    kept = compaction.retain(log, floor, bottom)
    assert sorted((r.user_key, r.seq) for r in kept.collect()) == sorted(want)
    if floor is not None:
        assert {r.user_key: r.value for r in reads.latest(kept, floor).collect()} == state(history, floor)
    assert {r.user_key: r.value for r in reads.latest(kept).collect()} == state(history)


def test_multi_snapshot(log, history):
    points = [1, 250, 400, 799]
    rows = reads.multi_snapshot(log, points).collect()
    for s in points:
        assert {r.user_key: r.value for r in rows if r.snapshot == s} == state(history, s)


def test_lookup_and_counts(spark, log, history):
    live = state(history)
    known = {k for k, *_ in history}
    wanted = ["k1", "k1", "k2", "nothing", ""]
    keys = spark.createDataFrame([(k,) for k in wanted], "user_key string")
    got = sorted((r.user_key, r.status) for r in reads.lookup(log, keys).collect())
    assert got == sorted((k, "found" if k in live else "deleted" if k in known else "missing") for k in wanted)
    assert reads.exists_count(log, keys).first().n == sum(k in live for k in wanted)
    assert reads.delete_count(log, keys).first().n == len({k for k in wanted if k in live})


def test_numbers_follow_arrival(spark):
    df = spark.createDataFrame([(f"k{i % 7}", str(i), i * 3 % 1009) for i in range(1009)], "k string, v string, arrival long")
    rows = sorted(oplog.put(df, "k", "v", "arrival", 50).collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(51, 51 + 1009))
    assert [int(r.value) * 3 % 1009 for r in rows] == list(range(1009))


def test_generations(spark, log, history):
    want, held, now = {}, 300, -1
    for key, seq, _, value in history:
        if held >= 300:
            now, held = now + 1, 0
        held += len(key) + len(value or "") + 36
        want[seq] = now
    assert {r.seq: r.generation for r in oplog.generations(log, 300).collect()} == want


def test_value_separation(spark):
    rows = [("a", 1, 1, "x" * 2000), ("b", 2, 1, "y" * 63), ("a", 3, 1, "z" * 64), ("c", 4, 0, None), ("b", 5, 1, "w" * 64)]
    log, entries = vsep.split(spark.createDataFrame(rows, SCHEMA), 3, 64)
    assert sorted((r.seq, r.offset, r.size) for r in entries.collect()) == [(1, 0, 2000), (3, 2013, 64), (5, 2090, 64)]
    live = {r.user_key: (r.value, r.status) for r in vsep.resolve(reads.latest(log), entries).collect()}
    assert live == {"a": ("z" * 64, "ok"), "b": ("w" * 64, "ok")}
    broken = vsep.resolve(reads.latest(log), entries.where("seq <> 3"))
    assert {r.user_key: r.status for r in broken.collect()} == {"a": "corruption: missing", "b": "ok"}
    assert [r.seq for r in vsep.live_entries(log, entries, live=False).collect()] == [1]


def test_overlap_is_transitive(spark):
    files = [(1, 1, "m", "p"), (2, 2, "a", "c"), (3, 2, "d", "l"), (4, 2, "l", "m"), (5, 2, "q", "t"), (6, 2, "p", "p")]
    df = spark.createDataFrame(files, "file_number long, level int, smallest_key string, largest_key string")
    got = compaction.overlap(df, df.where("level = 1"), 2)
    assert sorted(r.file_number for r in got.collect()) == [3, 4, 6]


def test_locate_in_gaps(spark):
    files = spark.createDataFrame([(1, 1, "b", "d"), (2, 1, "f", "h")], "file_number long, level int, smallest_key string, largest_key string")
    keys = spark.createDataFrame([(k,) for k in "abdefhz"], "user_key string")
    got = {r.user_key: r.file_number for r in compaction.locate(files, keys, 1).collect()}
    assert got == {"a": None, "b": 1, "d": 1, "e": None, "f": 2, "h": 2, "z": None}
