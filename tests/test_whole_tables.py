"""Queries without SQL over whole tables, against plain Python."""

import pytest

from keystrata.plans import catalog

KINDS = ["view", "error", "purchase"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Events far apart, with ids of all sizes, and their folder."""
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, i * 7 % 5, KINDS[i % 3]) for i in (*range(40), *range(2980, 3040), *range(4980, 5040), *range(70_000, 70_040))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").repartition(3).write.parquet(f"{folder}/events.parquet")
    return folder, rows


def test_resp_parse(spark, events):
    folder, rows = events
    want = []
    for c in range(20):
        own = [r for r in rows if r[0] % 20 == c]
        want += [(c, k, ["SET", f"user{u:019d}", kind], None) for k, (_, u, kind) in enumerate(own)]
    got = sorted((r.connection, r.request, r.args, r.error) for r in catalog.QUERIES["resp_parse"](spark, folder).collect())
    assert got == want


def test_command_replay(spark, events):
    folder, rows = events
    live, want = {}, {}
    for i, u, kind in rows:
        at = i % 5
        if at == 0:
            live[u], want[i] = kind, "+OK\r\n"
        elif at == 1:
            want[i] = f"${len(live[u])}\r\n{live[u]}\r\n" if u in live else "$-1\r\n"
        elif at == 2:
            want[i] = f":{2 * (u in live)}\r\n"
        elif at == 3:
            want[i] = f":{int(live.pop(u, None) is not None)}\r\n"
        else:
            want[i] = "+PONG\r\n"
    assert {r.request: r.reply for r in catalog.QUERIES["command_replay"](spark, folder).collect()} == want
