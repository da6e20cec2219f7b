"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from keystrata.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    rel = duck.sql(catalog.ORACLES[name])
    columns = sorted(rel.columns)
    assert columns == sorted(df.columns)
    own = sorted(([r[c] for c in columns] for r in df.collect()), key=repr)
    want = sorted(([dict(zip(rel.columns, r))[c] for c in columns] for r in rel.fetchall()), key=repr)
    assert own == want


def test_without_sql(spark):
    q = catalog.QUERIES
    rows = q["bloom_probe"](spark, FOLDER).collect()
    assert all(r.n == r.hits for r in rows if r.present)
    assert sum(r.hits for r in rows if not r.present) < 0.2 * sum(r.n for r in rows if not r.present)
    rows = q["bloom_blocks"](spark, FOLDER).collect()
    assert all(r.n == r.hits for r in rows if r.present)
    assert sum(r.hits for r in rows if not r.present) < 0.2 * sum(r.n for r in rows if not r.present)
    assert q["make_value"](spark, FOLDER).count() == q["crc32_values"](spark, FOLDER).count() * 5 == 1000
    assert sum(r.n for r in q["ycsb_operations"](spark, FOLDER).collect()) == 6000
    parsed = q["resp_parse"](spark, FOLDER).collect()
    assert len(parsed) == 1000 and all(r.error is None and len(r.args) == 3 and r.args[0] == "SET" for r in parsed)


def test_lru(spark):
    """Against a list in order of use, shard by shard."""
    import random

    from pyspark.sql import functions as F

    from keystrata.plans import workload

    rng = random.Random(1)
    rows = [(i, rng.randrange(60), rng.choice([1, 2, 40, 100])) for i in range(4000)]
    weights = {k: w for _, k, w in rows}
    rows = [(i, k, weights[k]) for i, k, _ in rows]
    df = spark.createDataFrame(rows, "place long, key long, weight long").repartition(3)
    shard = {r.key: r.s for r in df.select("key", F.pmod(F.xxhash64("key"), F.lit(4)).alias("s")).distinct().collect()}
    want = {}
    for s in set(shard.values()):
        used, hits, misses = [], 0, 0
        for _, k, w in rows:
            if shard[k] != s:
                continue
            if k in used:
                hits += 1
                used.remove(k)
                used.append(k)
            else:
                misses += 1
                if w <= 80:
                    used.append(k)
                    while sum(weights[x] for x in used) > 20:
                        used.pop(0)
        want[s] = (hits, misses)
    assert {r.shard: (r.hits, r.misses) for r in workload.lru(df, 4, 80).collect()} == want


def test_generations_in_blocks():
    """Starts don't depend on how the log is cut into blocks."""
    import numpy as np

    from keystrata.operators.oplog import generation_starts

    rng = np.random.default_rng(2)
    size = rng.integers(1, 90, 5000)
    before = np.cumsum(size) - size
    want, held = [], 1000
    for i, n in enumerate(size.tolist()):
        if held >= 1000:
            want.append(i)
            held = 0
        held += n
    for cuts in ([], [1, 2, 3000], list(range(100, 5000, 100))):
        blocks = [(s.astype(np.int64).tobytes(), b.astype(np.int64).tobytes()) for s, b in zip(np.split(np.arange(5000), cuts), np.split(before, cuts))]
        assert generation_starts(blocks, 1000) == want
