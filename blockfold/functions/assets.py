"""Amounts with a precision and a symbol code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbol_code(value: Column) -> Column:
    """Up to seven ASCII letters packed little-endian in a long."""
    letters = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.chr(F.floor(value / F.pow(F.lit(256.0), i)).cast("long") % 256))
    return F.when(value.isNotNull(), F.array_join(F.filter(letters, lambda c: F.ascii(c) > 0), ""))


def symbol_value(code: Column, precision: Column) -> Column:
    """code << 8 | precision; null for a code of more than seven letters, which has no value."""
    code = F.when(F.length(code) <= 7, code)
    packed = F.aggregate(F.reverse(F.split(code, "")), F.lit(0).cast("long"), lambda a, c: a * 256 + F.ascii(c))
    return packed * 256 + precision


def asset_format(amount: Column, precision: Column, code: Column) -> Column:
    """`-1.2345 FOO`; no point where the precision is 0. Digits only, no floating point."""
    digits = F.lpad(F.abs(amount).cast("string"), F.greatest(F.length(F.abs(amount).cast("string")), precision + 1), "0")
    whole = F.substring(digits, F.lit(1), F.length(digits) - precision)
    part = F.when(precision > 0, F.concat(F.lit("."), F.substring(digits, F.length(digits) - precision + 1, precision))).otherwise("")
    return F.concat(F.when(amount < 0, "-").otherwise(""), whole, part, F.lit(" "), code)


def asset_parse(text: Column) -> Column:
    """struct(amount, precision, code); null where the text is not `digits[.digits] CODE`."""
    pattern = r"^(-?)([0-9]+)(?:\.([0-9]+))? ([A-Z]{1,7})$"
    group = lambda k: F.regexp_extract(text, pattern, k)
    amount = F.concat(group(1), group(2), group(3)).try_cast("long")
    made = F.struct(amount.alias("amount"), F.length(group(3)).alias("precision"), group(4).alias("code"))
    return F.when(text.rlike(pattern) & amount.isNotNull(), made)
