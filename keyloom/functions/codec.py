"""Binary values as column expressions: a tag byte, the payload's length in 4 bytes little-endian, the payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING_TAG, INT_TAG = "01", "02"


def _little_endian(number: Column, size: int) -> Column:
    big = F.unhex(F.lpad(F.hex(number), 2 * size, "0"))
    return F.concat(*[F.substring(big, k, 1) for k in range(size, 0, -1)])


def _number(binary: Column, start: int, size: int) -> Column:
    """The little-endian number of `size` bytes from the 1-based place `start`."""
    big = F.concat(*[F.substring(binary, start + k, 1) for k in range(size - 1, -1, -1)])
    return F.conv(F.hex(big), 16, -10).cast("long")


def encode_string(text: Column) -> Column:
    payload = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lit(STRING_TAG)), _little_endian(F.octet_length(payload).cast("long"), 4), payload)


def encode_int(number: Column) -> Column:
    return F.concat(F.unhex(F.lit(INT_TAG)), _little_endian(F.lit(8).cast("long"), 4), _little_endian(number.cast("long"), 8))


def encode(kind: Column, text: Column, number: Column) -> Column:
    """By type; null for hashes and lists, whose values are in their own tables."""
    return F.when(kind == "string", encode_string(text)).when(kind == "int", encode_int(number))


def _sound(binary: Column, tag: str) -> Column:
    return (F.octet_length(binary) >= 5) & (F.hex(F.substring(binary, 1, 1)) == tag) & (_number(binary, 2, 4) + 5 == F.octet_length(binary))


def decode_string(binary: Column) -> Column:
    """The text, or null if the header, tag or length is wrong."""
    return F.when(_sound(binary, STRING_TAG), F.decode(F.substring(binary, 6, 2**31 - 1), "UTF-8"))


def decode_int(binary: Column) -> Column:
    return F.when(_sound(binary, INT_TAG) & (F.octet_length(binary) == 13), _number(binary, 6, 8))


def parse_int(text: Column) -> Column:
    """A 64-bit integer of at most 31 bytes with leading white space and a sign allowed; null for anything else."""
    fits = (F.octet_length(text) <= 31) & F.regexp_like(text, F.lit("^[ \\t\\n\\x0B\\f\\r]*[+-]?[0-9]+\\z"))
    return F.when(fits, F.btrim(text, F.lit(" \t\n\x0b\f\r")).try_cast("long"))
