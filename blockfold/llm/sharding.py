"""Reproducible shuffle into shards by a Feistel permutation of global row numbers (native).

A row's number in doc_id order is permuted within [0, n) by a Feistel network
over the next power of two, walking a cycle until the image is below n. Shard
and slot follow from the image by division, so either can be computed for any
row number without looking at other rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, numbered, table

#: Primes just under 2**31: products of two residues stay within 63 bits.
P1, P2 = 2147483647, 2147483629
ROUNDS = 6
#: Steps of a cycle walk before it is an error; each is needed with probability under 1/2.
WALK = 128


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(multiplier, addend) of each round, from the seed."""
    out = []
    for i in range(rounds):
        d = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        out.append((int.from_bytes(d[:4], "big") % (P1 - 2) + 2, int.from_bytes(d[4:8], "big") % P1))
    return out


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and the right half of the smallest network over at least n numbers."""
    bits = max(2, (n - 1).bit_length())
    if bits > 62:
        raise ValueError("too many rows for 31-bit halves")
    return bits // 2, bits - bits // 2


def permute(x: int, n: int, seed: int) -> int:
    """The permutation for one number, in Python: the law the columns follow."""
    left_bits, right_bits = widths(n)
    while True:
        left, right = x >> right_bits, x & ((1 << right_bits) - 1)
        for i, (a, k) in enumerate(round_keys(seed)):
            t = ((left if i % 2 else right) * a + k) % P1
            u = (t * t + t) % P2
            if i % 2:
                right ^= u & ((1 << right_bits) - 1)
            else:
                left ^= u & ((1 << left_bits) - 1)
        x = left << right_bits | right
        if x < n:
            return x


def permuted(x: Column, n: int, seed: int) -> Column:
    left_bits, right_bits = widths(n)
    right_mask, left_mask = (1 << right_bits) - 1, (1 << left_bits) - 1
    rounds = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(k).cast("long").alias("k"), F.lit(i % 2 == 1).alias("odd")) for i, (a, k) in enumerate(round_keys(seed))))

    def step(v: Column, r: Column) -> Column:
        half = F.when(r["odd"], F.shiftright(v, right_bits)).otherwise(v.bitwiseAND(right_mask))
        t = (half * r["a"] + r["k"]) % P1
        u = (t * t + t) % P2
        return v.bitwiseXOR(F.when(r["odd"], u.bitwiseAND(right_mask)).otherwise(F.shiftleft(u.bitwiseAND(left_mask), right_bits)))

    def once(v: Column) -> Column:
        return F.aggregate(rounds, v, step)

    first = once(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(first < n, first).otherwise(walked)


def shard(df: DataFrame, n_shards: int = 8, seed: int = 2024, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df with `shard` and `slot`: row counts of shards differ by one at most, slots are gapless from 0.

    Nulls in the order columns come first; rows equal in them get consecutive
    numbers in any order, so equal rows may swap places but never share one. An
    empty table stays empty. Columns of df named shard or slot are replaced, all
    others stay; texts among them travel with the row, however long.
    """
    df = df.drop("shard", "slot")
    own = fresh(df, "row", "x")
    rows = numbered(df, *order, name=own["row"])
    n = max(1, df.count())
    x = permuted(F.col(own["row"]), n, seed)
    x = F.when(x < n, x).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    return rows.withColumn(own["x"], x).withColumn("shard", (F.col(own["x"]) % n_shards).cast("int")).withColumn("slot", F.expr(f"`{own['x']}` div {n_shards}")).drop(own["x"], own["row"])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def crc_table() -> str:
    """CRC-32 of each byte, as a SQL list."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return str(out) + "::BIGINT[]"


def oracle(n_shards: int = 8, seed: int = 2024) -> str:
    """DuckDB SQL for op2: the same law, the cycle walked by a recursive query. The halves' widths depend on n, as in `widths`."""
    x = "SELECT doc_id, n, rb, xor(l, ((t * t + t) % {p2}) & lm) AS l, r, lm, rm FROM (SELECT *, (r * {a} + {k}) % {p1} AS t FROM ({s}))"
    y = "SELECT doc_id, n, rb, l, xor(r, ((t * t + t) % {p2}) & rm) AS r, lm, rm FROM (SELECT *, (l * {a} + {k}) % {p1} AS t FROM ({s}))"

    def once(source: str) -> str:
        s = f"SELECT doc_id, n, rb, x >> rb AS l, x & ((1::BIGINT << rb) - 1) AS r, (1::BIGINT << lb) - 1 AS lm, (1::BIGINT << rb) - 1 AS rm FROM (SELECT *, bits - bits // 2 AS rb, bits // 2 AS lb FROM {source})"
        for i, (a, k) in enumerate(round_keys(seed)):
            s = (y if i % 2 else x).format(a=a, k=k, p1=P1, p2=P2, s=s)
        return f"SELECT doc_id, n, rb + length(ltrim(bin(lm), '0')) AS bits, (l << rb) | r AS x FROM ({s})"

    return f"""
WITH RECURSIVE sums AS (
  SELECT doc_id, xor(4294967295::BIGINT, list_reduce(list_transform(range(strlen(h) // 2), lambda i: (instr('0123456789ABCDEF', substr(h, CAST(2 * i + 1 AS BIGINT), 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, CAST(2 * i + 2 AS BIGINT), 1)) - 1),
    lambda c, b: xor(({crc_table()})[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT)) AS crc
  FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
counted AS (
  SELECT doc_id, n, greatest(2, CASE WHEN n <= 1 THEN 0 ELSE length(ltrim(bin(n - 1), '0')) END)::BIGINT AS bits, x FROM (
    SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS x FROM documents)),
walk AS (
  {once("counted")}
  UNION ALL
  {once("(SELECT * FROM walk WHERE x >= n)")})
SELECT d.doc_id, strlen(coalesce(d.text, ''))::BIGINT + 1 AS size, sums.crc AS text_crc32, 'rows' AS law,
  (w.x % {n_shards})::INTEGER AS shard, (w.x // {n_shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM documents d JOIN walk w ON d.doc_id = w.doc_id AND w.x < w.n JOIN sums ON d.doc_id = sums.doc_id"""
