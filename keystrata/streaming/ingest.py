"""Streams of operations: appended to a store, and as state by key.

There is no event time: the winner of a key is its largest sequence number, so
late and repeated rows are harmless.
"""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keystrata.functions.resp import Parser, ProtocolError
from keystrata.sources.store import Store


def append_to(store: Store):
    """A foreachBatch function that applies (user_key, type, value, arrival) rows.

    A batch that was already applied before a restart is passed over; its number
    is published together with its rows, so a batch that failed is applied again.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        store.write(batch, epoch)

    return apply


def latest_by_key(log: DataFrame) -> DataFrame:
    """(user_key, seq, type, value) of each key's newest version, in update mode.

    One bounded state row a key; arrival order doesn't matter.
    """
    best = F.max_by(F.struct("seq", "type", "value"), "seq")
    return log.groupBy("user_key").agg(best.alias("v")).select("user_key", "v.*")


def parse_stream(chunks: DataFrame) -> DataFrame:
    """Requests out of a stream of (connection, chunk_no, data binary) chunks.

    The state of a connection is its unparsed rest; it ends with an error row.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, missing, args, done, n = state.get if state.exists else (b"", -1, [], False, 0)
        parser = Parser(bytearray(rest), missing if missing >= 0 else None, list(args))
        rows = []
        data = pd.concat(list(frames)).sort_values("chunk_no")["data"]
        # The empty chunk raises a fault that came behind whole requests.
        for chunk in [] if done else [*data, b""]:
            try:
                got = parser.feed(bytes(chunk))
            except ProtocolError as e:
                rows.append((key[0], n, None, str(e)))
                n, done = n + 1, True
                parser.reset()
                break
            for request in got:
                rows.append((key[0], n, request, None))
                n += 1
        state.update((bytes(parser.buffer), -1 if parser.missing is None else parser.missing, parser.args, done, n))
        yield pd.DataFrame(rows, columns=["connection", "request", "args", "error"])

    return chunks.groupBy("connection").applyInPandasWithState(
        run, "connection long, request long, args array<binary>, error string",
        "rest binary, missing int, args array<binary>, done boolean, n long", "append", GroupStateTimeout.NoTimeout,
    )
