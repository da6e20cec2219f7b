"""The store against a dictionary: writes, snapshots, maintenance, reopening."""

import random

import pytest

from keystrata.sources.store import Corruption, Store

OPS = "user_key string, type int, value string, arrival long"


def apply(spark, store, model, ops):
    store.write(spark.createDataFrame([(k, int(v is not None), v, i) for i, (k, v) in enumerate(ops)], OPS))
    for k, v in ops:
        model.pop(k, None)
        if v is not None:
            model[k] = v


def contents(store, snapshot=None):
    rows = store.scan("", "~", snapshot).collect()
    assert all(r.status == "ok" for r in rows)
    return {r.user_key: r.value for r in rows}


@pytest.mark.parametrize("threshold", [None, 64])
def test_model(spark, tmp_path, threshold):
    rng, model = random.Random(3), {}
    store = Store(spark, str(tmp_path / "s"), threshold=threshold, l0_trigger=2, level_base=2000, gc_size=1)
    for step in range(4):
        ops = [(f"k{rng.randrange(30)}", None if rng.random() < 0.2 else chr(97 + step) * rng.choice([1, 64, 200])) for _ in range(60)]
        apply(spark, store, model, ops)
        if step == 1:
            snap, then = store.snapshot(), dict(model)
        store.maintain()
        assert contents(store) == model
    assert contents(store, snap) == then
    store.release(snap)
    store.release(12345)
    store.maintain()
    again = Store(spark, str(tmp_path / "s"), threshold=threshold, l0_trigger=2, level_base=2000, gc_size=1)
    assert contents(again) == model
    assert again.latest_seq() == store.latest_seq()
    assert again.counters()["total_files"] == sum(again.counters()["level_files"])
    if threshold:
        assert len(again.manifest["vlogs"]) == 1
        with pytest.raises(Corruption):
            Store(spark, str(tmp_path / "s"))


def test_orphans_and_bad_manifest(spark, tmp_path):
    model = {}
    store = Store(spark, str(tmp_path / "s"))
    apply(spark, store, model, [("a", "1"), ("b", "2")])
    (tmp_path / "s" / "sst" / "99").mkdir(parents=True)
    again = Store(spark, str(tmp_path / "s"))
    assert (tmp_path / "s" / "sst" / "99").exists() and again.remove_orphans() == [], "a reader deletes nothing, nor does a writer what is fresh"
    assert again.remove_orphans(0) == ["sst/99"]
    assert not (tmp_path / "s" / "sst" / "99").exists()
    assert contents(Store(spark, str(tmp_path / "s"))) == model
    (tmp_path / "s" / "MANIFEST.json").write_text("{")
    for crc in (tmp_path / "s").glob(".MANIFEST*.crc"):
        crc.unlink()
    with pytest.raises(Corruption):
        Store(spark, str(tmp_path / "s"))


@pytest.mark.parametrize("threshold", [None, 64])
def test_lookup(spark, tmp_path, threshold):
    """Batched lookups fetch values through their pointers."""
    model = {}
    store = Store(spark, str(tmp_path / "s"), threshold=threshold)
    apply(spark, store, model, [(f"k{i}", "v" * (10 * i)) for i in range(20)])
    store.flush()
    apply(spark, store, model, [(f"k{i}", None) for i in range(0, 20, 4)] + [("k1", ""), ("k2", "w" * 300)])
    keys = spark.createDataFrame([(f"k{i}",) for i in range(25)] + [("k2",)], "user_key string")
    got = sorted((r.user_key, r.status, r.value) for r in store.lookup(keys).collect())
    want = [(k, "found", model[k]) if k in model else (k, "deleted" if int(k[1:]) < 20 else "missing", None) for k in [f"k{i}" for i in range(25)] + ["k2"]]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))


def test_outputs_are_split_between_keys(spark, tmp_path):
    model = {}
    store = Store(spark, str(tmp_path / "s"), max_table=500, l0_trigger=1)
    snap = [store.snapshot()]
    for step in range(3):
        apply(spark, store, model, [(f"k{i:02}", f"{step}" * 40) for i in range(40)] + [("hot", "h" * 90)] * 8)
        snap.append(store.snapshot())
    store.flush()
    store.compact()
    tables = sorted(store.manifest["tables"], key=lambda t: t["smallest_key"])
    assert len(tables) > 5 and all(a["largest_key"] < b["smallest_key"] for a, b in zip(tables, tables[1:]))
    assert sum(t["entry_count"] for t in tables) == 3 * 48
    assert contents(store) == model


def test_readers_keep_their_files(spark, tmp_path):
    model = {}
    store = Store(spark, str(tmp_path / "s"))
    apply(spark, store, model, [("a", "1"), ("b", "2")])
    reader = Store(spark, str(tmp_path / "s"))
    before = dict(model)
    apply(spark, store, model, [("a", "3"), ("b", None)])
    store.maintain()
    assert contents(reader) == before and contents(store) == model
    assert sorted(store.remove_orphans(0)) == ["log/1", "log/2"] and contents(store) == model


def test_failed_batches_are_applied_again(spark, tmp_path):
    from keystrata.streaming.ingest import append_to

    store = Store(spark, str(tmp_path / "s"))
    batch = spark.createDataFrame([("a", 1, "1", 0)], OPS)
    write, store.fs = store.fs, None
    with pytest.raises(AttributeError):
        append_to(store)(batch, 0)
    store.fs = write
    append_to(store)(batch, 0)
    append_to(store)(batch, 0)
    again = Store(spark, str(tmp_path / "s"))
    append_to(again)(batch, 0)
    assert contents(again) == {"a": "1"} and again.latest_seq() == 1


def test_replay(spark, tmp_path):
    """Record logs are replayed up to the first torn record, each version once."""
    from keystrata.sources import logfile

    def log(rows):
        df = spark.createDataFrame(rows, "seq long, type int, user_key string, value string")
        return logfile.encode([bytes(r.payload) for r in logfile.payloads(df).orderBy("seq").collect()])

    (tmp_path / "1.log").write_bytes(log([(i, 1, f"k{i % 7}", f"v{i}") for i in range(1, 51)]))
    (tmp_path / "2.log").write_bytes(log([(i, i % 2, f"k{i % 7}", f"v{i}" if i % 2 else None) for i in range(51, 101)])[:-5])
    store = Store(spark, str(tmp_path / "s"))
    assert store.replay([str(tmp_path / "1.log"), str(tmp_path / "2.log")]) == 99
    assert store.replay([str(tmp_path / "*.log")]) == 0
    model = {}
    for i in range(1, 100):
        model.pop(f"k{i % 7}", None)
        if i <= 50 or i % 2:
            model[f"k{i % 7}"] = f"v{i}"
    assert contents(store) == model and store.latest_seq() == 99
    assert store.counters()["user_bytes"] > 0


def test_counters(spark, tmp_path):
    model = {}
    store = Store(spark, str(tmp_path / "s"), threshold=64, l0_trigger=1, gc_size=1)
    apply(spark, store, model, [("a", "x" * 100), ("b", "y"), ("a", "z" * 80)])
    c = store.counters()
    assert c["user_bytes"] == 3 + 181 and c["vlog_bytes"] == 2 * (12 + 1) + 180 and c["log_bytes"] == 3 * (9 + 17 + 1) + 2 * 21 + 1 and c["table_bytes"] == 0
    apply(spark, store, model, [("c", "w" * 70)])
    store.maintain()
    c = store.counters()
    assert c["flushes"] == 1 and c["compactions"] == 1 and c["collections"] == 1 and c["table_bytes"] > 0
    assert store.write_amplification() == (c["log_bytes"] + c["table_bytes"] + c["vlog_bytes"]) / c["user_bytes"]
