"""Wire protocol as data: an incremental request parser and a command replay.

The parser is an ordered fold over the chunks of a connection, so it runs per
connection (batch: applyInArrow; stream: keyed state); connections run apart.
"""

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.codec import MAX_ARGS, MAX_BULK, MAX_HEADER_LINE, MAX_INLINE, bulk, error, integer, lower_ascii, simple

DIGITS = frozenset(b"0123456789")
HEADER_ARRAY, HEADER_BULK = b"*$"
SAFE_NUMBER = 1 << 63


class ProtocolError(ValueError):
    """A request that can't be parsed; the connection is to be closed."""


def number(raw: bytes) -> int | None:
    """Unsigned decimal digits only."""
    if not raw or not DIGITS.issuperset(raw):
        return None
    n = int(raw)
    return n if n < SAFE_NUMBER else None


#: For each header sign, its largest number and the messages of a
#: header that is too long and of one that is no such number.
HEADERS = {
    b"*": (MAX_ARGS, "Protocol error: too big multibulk length", "Protocol error: invalid multibulk length"),
    b"$": (MAX_BULK, "Protocol error: invalid bulk length", "Protocol error: invalid bulk length"),
}


@dataclass
class Parser:
    """Requests out of chunks, however they are cut.

    A cursor moves over the buffer; what it has passed is dropped once a chunk.
    Between chunks the state is the unread rest, how many arguments are still
    missing, and those that are there.
    """

    buffer: bytearray = field(default_factory=bytearray)
    #: Arguments still missing in the current request; None outside of one.
    missing: int | None = None
    args: list[bytes] = field(default_factory=list)
    at: int = 0
    failed: str | None = None

    def feed(self, chunk: bytes) -> list[list[bytes]]:
        """All requests that are complete with this chunk.

        Those before a fault are returned first; the fault is raised when there
        are none, by the next call if need be.
        """
        out: list[list[bytes]] = []
        self.buffer += chunk
        if self.failed is None:
            try:
                while self.advance(out):
                    pass
            except ProtocolError as e:
                self.failed = str(e)
            del self.buffer[: self.at]
            self.at = 0
        if self.failed is not None and not out:
            raise ProtocolError(self.failed)
        return out

    def pending(self) -> int:
        return len(self.buffer)

    def reset(self) -> None:
        self.buffer.clear()
        self.missing, self.args, self.at, self.failed = None, [], 0, None

    def advance(self, out: list[list[bytes]]) -> bool:
        """Read the next line or argument; whether there was a whole one."""
        if self.missing is not None:
            return self.argument(out)
        while self.at < len(self.buffer) and self.buffer[self.at] in b"\r\n":
            self.at += 1
        if self.at == len(self.buffer):
            return False
        return self.array() if self.buffer[self.at] == HEADER_ARRAY else self.inline(out)

    def header(self, sign: bytes) -> tuple[int, int] | None:
        """(number, end) of the header at the cursor, None while its line is open."""
        most, too_long, invalid = HEADERS[sign]
        end = self.buffer.find(b"\r\n", self.at + 1)
        if end < 0:
            if len(self.buffer) - self.at > MAX_HEADER_LINE:
                raise ProtocolError(too_long)
            return None
        n = number(bytes(self.buffer[self.at + 1 : end]))
        if n is None or n > most:
            raise ProtocolError(invalid)
        return n, end + 2

    def array(self) -> bool:
        if (head := self.header(b"*")) is None:
            return False
        # An array of no arguments is passed over.
        self.missing, self.at = head[0] or None, head[1]
        self.args = []
        return True

    def argument(self, out: list[list[bytes]]) -> bool:
        if self.at == len(self.buffer):
            return False
        if self.buffer[self.at] != HEADER_BULK:
            raise ProtocolError(f"Protocol error: expected '$', got '{chr(self.buffer[self.at])}'")
        if (head := self.header(b"$")) is None:
            return False
        begin, end = head[1], head[1] + head[0]
        if len(self.buffer) < end + 2:
            return False
        if self.buffer[end : end + 2] != b"\r\n":
            raise ProtocolError("Protocol error: bulk string missing terminator")
        self.args.append(bytes(self.buffer[begin:end]))
        self.at, self.missing = end + 2, self.missing - 1
        if not self.missing:
            out.append(self.args)
            self.missing, self.args = None, []
        return True

    def inline(self, out: list[list[bytes]]) -> bool:
        """A line of words between spaces and tabs; a blank one is passed over."""
        end = self.buffer.find(b"\n", self.at)
        if end < 0:
            if len(self.buffer) - self.at > MAX_INLINE:
                raise ProtocolError("Protocol error: too big inline request")
            return False
        line, self.at = bytes(self.buffer[self.at : end]).removesuffix(b"\r"), end + 1
        if words := [w for w in re.split(rb"[ \t]", line) if w]:
            out.append(words)
        return True


REQUESTS = "connection long, request long, args array<binary>, error string"


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """Requests of (connection, chunk_no, data) rows, numbered by connection.

    A protocol error ends its connection with a row that holds the message.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_no")
        connection, parser, rows = table.column("connection")[0].as_py(), Parser(), []
        try:
            for chunk in [*table.column("data").to_pylist(), b""]:
                rows += [(args, None) for args in parser.feed(chunk or b"")]
        except ProtocolError as e:
            rows.append((None, str(e)))
        n = len(rows)
        return pa.table([pa.array([connection] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.binary())), pa.array([r[1] for r in rows], pa.string())], names=["connection", "request", "args", "error"])

    return chunks.select("connection", "chunk_no", F.col("data").cast("binary").alias("data")).groupBy("connection").applyInArrow(run, REQUESTS)


def inline_words(line: Column) -> Column:
    """The words of an inline command line."""
    return F.filter(F.split(F.regexp_replace(line, "\r?\n$", ""), "[ \t]"), lambda w: w != "")


def replay(commands: DataFrame) -> DataFrame:
    """Replies to (request, args array<string>) commands of one database, in order.

    A command sees what earlier ones wrote: reads and deletes of all keys are
    ranked against writes of the same key, so keys run apart and nothing is
    folded in one place.  DEL counts an argument if it is live just then.
    """
    name = lower_ascii(F.try_element_at("args", F.lit(1)))
    argc = F.size("args")
    known = commands.withColumns({"cmd": F.when(argc > 0, name), "argc": argc})
    fits = F.when(F.col("cmd").isin("set"), argc == 3).when(F.col("cmd").isin("get", "echo"), argc == 2).when(F.col("cmd").isin("del", "exists"), argc >= 2).when(F.col("cmd") == "ping", F.lit(True)).otherwise(False)
    known = known.withColumn("fits", F.coalesce(fits, F.lit(False)))
    touching = known.where(F.col("fits") & F.col("cmd").isin("set", "get", "del", "exists"))
    last = F.when(F.col("cmd").isin("set", "get"), 2).otherwise(F.col("argc"))
    keys = touching.select("request", "cmd", F.try_element_at("args", F.lit(3)).alias("new"), F.posexplode(F.slice("args", F.lit(2), last - 1)).alias("arg_no", "user_key"))
    order = Window.partitionBy("user_key").orderBy("request", "arg_no").rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("cmd") == "set", F.struct(F.col("new").alias("value"))).when(F.col("cmd") == "del", F.struct(F.lit(None).cast("string").alias("value")))
    seen = keys.withColumn("value", F.last(write, ignorenulls=True).over(order)["value"])
    per = seen.groupBy("request").agg(F.sum(F.col("value").isNotNull().cast("long")).alias("hits"), F.max("value").alias("value"))
    joined = known.join(per, "request", "left")
    wrong = error(F.concat(F.lit("ERR wrong number of arguments for '"), F.col("cmd"), F.lit("' command")))
    arg = F.try_element_at("args", F.lit(2))
    reply = (
        F.when(F.col("cmd").isNull(), error(F.lit("ERR empty command")))
        .when(~F.col("cmd").isin("ping", "echo", "set", "get", "del", "exists"), error(F.concat(F.lit("ERR unknown command '"), F.col("cmd"), F.lit("'"))))
        .when(~F.col("fits"), wrong)
        .when(F.col("cmd") == "ping", F.when(F.col("argc") == 1, simple(F.lit("PONG"))).otherwise(bulk(arg)))
        .when(F.col("cmd") == "echo", bulk(arg))
        .when(F.col("cmd") == "set", simple(F.lit("OK")))
        .when(F.col("cmd") == "get", bulk(F.col("value")))
        .otherwise(integer(F.coalesce("hits", F.lit(0))))
    )
    return joined.select("request", reply.alias("reply"))
