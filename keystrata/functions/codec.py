"""Scalar functions as column expressions: they stay in generated JVM code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_ARGS, MAX_INLINE, MAX_BULK, MAX_HEADER_LINE = 1_048_576, 65_536, 512 << 20, 32


def swapped(digits: Column, size: int) -> Column:
    """Hex digits of ``size`` bytes in reverse order of bytes."""
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))


def fixed32(n: Column) -> Column:
    """Four little-endian bytes."""
    return F.unhex(swapped(F.lpad(F.hex(n.cast("long")), 8, "0"), 4))


def fixed64(n: Column) -> Column:
    """Eight little-endian bytes of a long."""
    return F.unhex(swapped(F.lpad(F.hex(n.cast("long")), 16, "0"), 8))


def get_fixed(data: Column, size: int = 8) -> Column:
    """The number in ``size`` little-endian bytes, as decimal(20,0); null for other lengths."""
    return F.when(F.octet_length(data) == size, F.conv(swapped(F.hex(data), size), 16, 10)).cast("decimal(20,0)")


def pack_tag(seq: Column, kind: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(kind.cast("long"))


def unpack_tag(tag: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(tag, 8), tag.bitwiseAND(F.lit(255))


def snapshot_tag(snapshot: Column) -> Column:
    """The tag to seek for a snapshot: all ones at null (the latest)."""
    return F.when(snapshot.isNull(), F.lit(-1).cast("long")).otherwise(F.shiftleft(snapshot.cast("long"), 8).bitwiseOR(F.lit(255).cast("long")))


def internal_key(user_key: Column, seq: Column, kind: Column) -> Column:
    return F.concat(user_key.cast("binary"), fixed64(pack_tag(seq, kind)))


def split_internal_key(key: Column) -> tuple[Column, Column]:
    """(user key, tag); keys under 8 bytes are bare user keys of tag 0."""
    n = F.octet_length(key)
    user = F.when(n < 8, key).otherwise(F.substring(key, F.lit(1), n - 8))
    return user, F.when(n < 8, F.lit(0).cast("decimal(20,0)")).otherwise(get_fixed(F.substring(key, n - 7, F.lit(8))))


def value_pointer(vlog: Column, offset: Column, size: Column) -> Column:
    """The 21-byte pointer: tag byte, two longs and an int, little-endian."""
    return F.concat(F.unhex(F.lit("FF")), fixed64(vlog), fixed64(offset), fixed32(size))


def read_pointer(data: Column) -> Column:
    """struct(vlog, offset, size) of a pointer-shaped value, else null."""
    shaped = (F.octet_length(data) == 21) & (F.hex(F.substring(data, 1, 1)) == "FF")
    parts = F.struct(get_fixed(F.substring(data, 2, 8)).alias("vlog"), get_fixed(F.substring(data, 10, 8)).alias("offset"), get_fixed(F.substring(data, 18, 4), 4).alias("size"))
    return F.when(shaped, parts)


def log_payload(seq: Column, kind: Column, key: Column, value: Column) -> Column:
    """The bytes of a log record's payload."""
    head = F.concat(fixed64(seq), F.unhex(F.lpad(F.hex(kind.cast("long")), 2, "0")), fixed32(F.octet_length(key)), key.cast("binary"))
    return F.when(kind == 1, F.concat(head, fixed32(F.octet_length(value)), value.cast("binary"))).otherwise(head)


def parse_payload(data: Column) -> Column:
    """struct(seq, type, user_key, value) of a well-formed payload, else null."""
    n = F.octet_length(data)
    klen = get_fixed(F.substring(data, 10, 4), 4).cast("long")
    kind = F.conv(F.hex(F.substring(data, 9, 1)), 16, 10).cast("int")
    vlen = get_fixed(F.substring(data, (klen + 14).cast("int"), F.lit(4)), 4).cast("long")
    fits = (n >= 13) & (klen <= n - 13)
    value_ok = fits & (kind == 1) & (n >= 17 + klen) & (n == 17 + klen + vlen)
    deletion_ok = fits & (kind == 0) & (n == 13 + klen)
    value = F.when(value_ok, F.substring(data, (klen + 18).cast("int"), vlen.cast("int")))
    parts = F.struct(get_fixed(F.substring(data, 1, 8)).alias("seq"), kind.alias("type"), F.substring(data, F.lit(14), klen.cast("int")).alias("user_key"), value.alias("value"))
    return F.when(F.coalesce(value_ok | deletion_ok, F.lit(False)), parts)


def crc32(data: Column) -> Column:
    return F.crc32(data)


def file_name(number: Column, suffix: str) -> Column:
    return F.format_string(f"%06d.{suffix}", number)


def file_number(name: Column, suffix: str) -> Column:
    """The number in a file name of digits and suffix; null otherwise or on overflow."""
    digits = F.regexp_extract(name, rf"^([0-9]+)\.{suffix}$", 1)
    number = F.when(F.length(digits) > 0, digits).try_cast("decimal(38,0)")
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number.cast("decimal(20,0)"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def make_key(n: Column) -> Column:
    return F.format_string("user%019d", n)


def parse_digits(text: Column) -> Column:
    """An unsigned decimal number, without sign or space; null otherwise."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def status_text(code: Column, message: Column) -> Column:
    return F.when(code == "OK", F.lit("OK")).otherwise(F.concat_ws(": ", code, message))


def format_ns(ns: Column) -> Column:
    """A duration in ns, us or ms."""
    return (
        F.when(ns >= 1_000_000, F.format_string("%.1fms", ns / F.lit(1e6)))
        .when(ns >= 1000, F.format_string("%.1fus", ns / F.lit(1e3)))
        .otherwise(F.format_string("%dns", ns))
    )


def simple(text: Column) -> Column:
    return F.concat(F.lit("+"), text, F.lit("\r\n"))


def error(text: Column) -> Column:
    """An error reply; line ends in the message become spaces."""
    return F.concat(F.lit("-"), F.translate(text, "\r\n", "  "), F.lit("\r\n"))


def integer(n: Column) -> Column:
    return F.concat(F.lit(":"), n.cast("string"), F.lit("\r\n"))


def bulk(text: Column) -> Column:
    """A bulk reply, its length in bytes; null gives the null bulk."""
    return F.when(text.isNull(), F.lit("$-1\r\n")).otherwise(F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit("\r\n"), text, F.lit("\r\n")))


def array_header(n: Column) -> Column:
    return F.concat(F.lit("*"), n.cast("string"), F.lit("\r\n"))
