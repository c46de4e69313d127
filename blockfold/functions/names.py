"""Account names: at most 13 characters of `.12345a-z`, as canonical strings that sort like their 64-bit values."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of a name by their 5-bit codes.
ALPHABET = ".12345abcdefghijklmnopqrstuvwxyz"


def canonical(name: Column) -> Column:
    """The string that a name's 64-bit value stands for: other characters become dots, the 13th has 4 bits, trailing dots go."""
    dotted = F.regexp_replace(F.substring(name, 1, 12), "[^a-z1-5]", ".")
    last = F.translate(F.regexp_replace(F.substring(name, 13, 1), "[^a-z1-5]", "."), ALPHABET[16:], ALPHABET[:16])
    return F.rtrim(F.concat(dotted, last), F.lit("."))


def to_u64(name: Column) -> Column:
    """The value as DECIMAL(20, 0); it may exceed a signed long."""
    padded = F.rpad(canonical(name), 13, ".")
    code = lambda k: (F.instr(F.lit(ALPHABET), F.substring(padded, k, 1)) - 1).cast("long")
    head = reduce(lambda a, k: a * 32 + code(k), range(2, 13), code(1))
    tail = F.instr(F.lit(ALPHABET), F.substring(padded, 13, 1)) - 1
    return (head.cast("decimal(20,0)") * F.lit(16).cast("decimal(3,0)") + tail.cast("decimal(3,0)")).cast("decimal(20,0)")


def signed(value: Column) -> Column:
    """The long with the same 64 bits as a DECIMAL(20, 0) value."""
    return F.when(value >= F.lit(Decimal(2**63)), value - F.lit(Decimal(2**64))).otherwise(value).cast("long")


def from_u64(value: Column) -> Column:
    """The canonical string of a DECIMAL(20, 0) value."""
    head = F.floor(value / F.lit(16)).cast("decimal(20,0)").cast("long")
    tail = (value - head.cast("decimal(20,0)") * F.lit(16)).cast("int")
    code = lambda i: F.call_function("shiftright", head, (F.lit(11) - i) * 5) % 32
    chars = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.substring(F.lit(ALPHABET), (code(i) + 1).cast("int"), F.lit(1)))
    return F.rtrim(F.concat(F.array_join(chars, ""), F.substring(F.lit(ALPHABET), tail + 1, F.lit(1))), F.lit("."))


def short(number: Column, prefix: str) -> Column:
    """A name for a number: a prefix and its digits as letters a to j."""
    return F.concat(F.lit(prefix), F.translate(number.cast("string"), "0123456789", "abcdefghij"))
