"""Identifiers, fingerprints, JSON cleaning, and the binary forms of actions."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .names import ALPHABET
from .timeslots import time_text

#: Transaction states by their number.
STATUS = ("executed", "soft_fail", "hard_fail", "delayed", "expired")


def status_name(status: Column) -> Column:
    names = F.array(*map(F.lit, STATUS))
    return F.coalesce(F.get(names, status.cast("int")), F.lit("unknown"))


def expiration(seconds: Column) -> Column:
    return time_text(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def trx_prefix(trx_id: Column) -> Column:
    """struct: first five bytes, the first two of them (partition) and the other three, in hex."""
    return F.struct(F.substring(trx_id, 1, 10).alias("prefix"), F.substring(trx_id, 1, 4).alias("partition"), F.substring(trx_id, 5, 6).alias("suffix"))


def block_to_slice(block: Column, size: int = 10_000) -> Column:
    return F.when(block <= 0, F.lit(0).cast("long")).otherwise(F.floor((block - 1) / size).cast("long"))


def slice_name(number: Column, size: int = 10_000) -> Column:
    return F.format_string("history_%010d-%010d", number * size + 1, (number + 1) * size)


def fingerprint(account: str, contract: str = "", action: str = "", date: str = "", start: str = "", end: str = "") -> str:
    """Of a query: base64 of the first eight bytes of SHA-256 of its bound parts."""
    return base64.b64encode(hashlib.sha256("|".join((account, contract, action, date, start, end)).encode()).digest()[:8]).decode()


def fingerprint_column(*parts: Column) -> Column:
    return F.base64(F.substring(F.unhex(F.sha2(F.concat_ws("|", *parts), 256)), 1, 8))


def flex_int(value: Column) -> Column:
    """A JSON number or numeric string as long."""
    return F.trim(value, F.lit('"')).try_cast("long")


def human(n: Column) -> Column:
    """1234567 as 1.23M."""
    big = lambda unit, letter: F.concat(F.format_number(n / unit, 2), F.lit(letter))
    return F.when(n >= 10**9, big(1e9, "B")).when(n >= 10**6, big(1e6, "M")).when(n >= 1000, big(1e3, "K")).otherwise(n.cast("string"))


def little(value: Column, size: int) -> Column:
    """A whole number's low bytes in little-endian order, as binary."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(size))))


def name_value(name: str) -> int:
    out = 0
    for k in range(13):
        c = ALPHABET.find(name[k]) if k < len(name) else 0
        out = out << 4 | max(0, c) & 15 if k == 12 else out << 5 | max(0, c)
    return out


def value_name(value: int) -> str:
    chars = [ALPHABET[value & 15]]
    value >>= 4
    for _ in range(12):
        chars.append(ALPHABET[value & 31])
        value >>= 5
    return "".join(reversed(chars)).rstrip(".")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """Value and the place after it."""
    out = shift = 0
    while True:
        byte = data[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def unzigzag(n: int) -> int:
    return n >> 1 if n & 1 == 0 else -(n + 1 >> 1)


@pandas_udf(BinaryType())
def varint_bytes(numbers: pd.Series) -> pd.Series:
    """Zig-zag variable-length integers."""
    return numbers.map(lambda n: varint(zigzag(int(n))))


@pandas_udf(LongType())
def varint_numbers(data: pd.Series) -> pd.Series:
    return data.map(lambda b: unzigzag(read_varint(b)[0]))


@pandas_udf(BinaryType())
def action_bytes(contract: pd.Series, action: pd.Series, actors: pd.Series, data: pd.Series) -> pd.Series:
    """An action's canonical bytes; actors: array of `actor@permission`."""

    def one(c: str, a: str, actors: Any, d: bytes | None) -> bytes:
        out = struct.pack("<QQ", name_value(c), name_value(a)) + varint(len(actors))
        for x in actors:
            actor, _, permission = x.partition("@")
            out += struct.pack("<QQ", name_value(actor), name_value(permission))
        d = d or b""
        return out + varint(len(d)) + d

    return pd.Series([one(*x) for x in zip(contract, action, actors, data, strict=True)])


def action_digest(data: Column) -> Column:
    return F.sha2(data, 256)


def drop_nulls(value: Any) -> Any:
    """Null entries of maps and null items of arrays go, at any depth."""
    if isinstance(value, dict):
        return {k: drop_nulls(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [drop_nulls(v) for v in value if v is not None]
    return value


def safe_ints(value: Any) -> Any:
    """Booleans as 1 and 0; integers beyond 32 bits (unsigned from 2**32, negative below -2**31) as strings, at any depth."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        return value if -(2**31) <= value < 2**32 else str(value)
    if isinstance(value, dict):
        return {k: safe_ints(v) for k, v in value.items()}
    if isinstance(value, list):
        return [safe_ints(v) for v in value]
    return value


def _json(change) -> Any:
    @pandas_udf(StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(change(json.loads(t)), separators=(",", ":"), sort_keys=True, ensure_ascii=False))

    return apply


remove_nulls = _json(drop_nulls)
json_safe_ints = _json(safe_ints)


class Reader:
    """Reads the values of an action's data by an ABI (a dict with types and structs)."""

    SIZES = {"int8": "b", "uint8": "B", "int16": "<h", "uint16": "<H", "int32": "<i", "uint32": "<I", "int64": "<q", "uint64": "<Q", "float32": "<f", "float64": "<d"}

    def __init__(self, abi: dict, data: bytes):
        self.aliases = {t["new_type_name"]: t["type"] for t in abi.get("types", [])}
        self.structs = {s["name"]: s for s in abi.get("structs", [])}
        self.variants = {v["name"]: v["types"] for v in abi.get("variants", [])}
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        out, self.at = read_varint(self.data, self.at)
        return out

    def read(self, kind: str) -> Any:
        if kind.endswith("$"):
            return self.read(kind[:-1]) if self.at < len(self.data) else None
        if kind.endswith("[]"):
            return [self.read(kind[:-2]) for _ in range(self.number())]
        if kind.endswith("?"):
            return self.read(kind[:-1]) if self.take(1) != b"\0" else None
        if kind in self.aliases:
            return self.read(self.aliases[kind])
        if kind in self.structs:
            s = self.structs[kind]
            out = dict(self.read(s["base"])) if s.get("base") else {}
            for f in s["fields"]:
                out[f["name"]] = self.read(f["type"])
            return out
        if kind in self.variants:
            own = self.variants[kind][self.number()]
            return [own, self.read(own)]
        if kind in self.SIZES:
            f = self.SIZES[kind]
            return struct.unpack(f, self.take(struct.calcsize(f)))[0]
        if kind == "bool":
            return self.take(1) != b"\0"
        if kind == "name":
            return value_name(struct.unpack("<Q", self.take(8))[0])
        if kind == "varuint32":
            return self.number()
        if kind == "varint32":
            return unzigzag(self.number())
        if kind == "string":
            return self.take(self.number()).decode()
        if kind == "bytes":
            return self.take(self.number()).hex()
        if kind in ("checksum160", "checksum256", "checksum512"):
            return self.take(int(kind[8:]) // 8).hex()
        if kind == "symbol":
            raw = self.take(8)
            return f"{raw[0]},{raw[1:].rstrip(bytes(1)).decode()}"
        if kind == "asset":
            amount, precision, code = struct.unpack("<qB7s", self.take(16))
            digits = f"{abs(amount):0{precision + 1}}"
            whole = digits[:-precision] + "." + digits[-precision:] if precision else digits
            return f"{'-' * (amount < 0)}{whole} {code.rstrip(bytes(1)).decode()}"
        raise ValueError(f"unknown type {kind!r}")


def decode(abi: dict, action: str, data: bytes) -> dict:
    kind = next((a["type"] for a in abi.get("actions", []) if a["name"] == action), None)
    if kind is None:
        raise ValueError(f"no action {action!r}")
    out = Reader(abi, data).read(kind)
    if not isinstance(out, dict):
        raise ValueError("an action's data is a map")
    return out


_ABIS: dict[str, dict] = {}


@pandas_udf(StringType())
def abi_decode(abi: pd.Series, action: pd.Series, data: pd.Series) -> pd.Series:
    """An action's data as JSON by its ABI's JSON; hex in quotes where there is no ABI or the data do not fit."""

    def one(text: str | None, name: str, raw: bytes | None) -> str:
        raw = raw or b""
        try:
            if text not in _ABIS:
                if len(_ABIS) > 1000:
                    _ABIS.clear()
                _ABIS[text] = json.loads(text)
            return json.dumps(drop_nulls(decode(_ABIS[text], name, raw)), separators=(",", ":"), sort_keys=True, ensure_ascii=False)
        except (TypeError, ValueError, KeyError, IndexError, struct.error):
            return json.dumps(raw.hex())

    return pd.Series([one(*x) for x in zip(abi, action, data, strict=True)])


#: The layout of an ABI in binary form.
_PAIR = [{"name": "id", "type": "string"}, {"name": "body", "type": "string"}]
_FIELD = [{"name": "name", "type": "string"}, {"name": "type", "type": "string"}]
ABI_OF_ABIS = {
    "structs": [
        {"name": name, "base": "", "fields": fields}
        for name, fields in (
            ("type", [{"name": "new_type_name", "type": "string"}, {"name": "type", "type": "string"}]),
            ("field", _FIELD),
            ("struct", [{"name": "name", "type": "string"}, {"name": "base", "type": "string"}, {"name": "fields", "type": "field[]"}]),
            ("action", [{"name": "name", "type": "name"}, {"name": "type", "type": "string"}, {"name": "ricardian_contract", "type": "string"}]),
            ("table", [{"name": "name", "type": "name"}, {"name": "index_type", "type": "string"}, {"name": "key_names", "type": "string[]"}, {"name": "key_types", "type": "string[]"}, {"name": "type", "type": "string"}]),
            ("clause", _PAIR),
            ("error", [{"name": "error_code", "type": "uint64"}, {"name": "error_msg", "type": "string"}]),
            ("extension", [{"name": "tag", "type": "uint16"}, {"name": "value", "type": "bytes"}]),
            ("variant", [{"name": "name", "type": "string"}, {"name": "types", "type": "string[]"}]),
            ("result", [{"name": "name", "type": "name"}, {"name": "result_type", "type": "string"}]),
            (
                "abi",
                [{"name": "version", "type": "string"}]
                + [{"name": n, "type": t} for n, t in (("types", "type[]"), ("structs", "struct[]"), ("actions", "action[]"), ("tables", "table[]"), ("ricardian_clauses", "clause[]"), ("error_messages", "error[]"), ("abi_extensions", "extension[]"), ("variants", "variant[]$"), ("action_results", "result[]$"))],
            ),
        )
    ]
}


def unpack_abi(raw: bytes) -> dict:
    """An ABI out of its binary form; parts that later versions have and this one lacks are left out."""
    return drop_nulls(Reader(ABI_OF_ABIS, raw).read("abi"))


#: Bytes of ABIs whose JSON a worker keeps for when they come again.
SHORT_ABI = 1024


def _abi_json(raw: bytes) -> str:
    return json.dumps(unpack_abi(raw), separators=(",", ":"), sort_keys=True, ensure_ascii=False)


@lru_cache(2000)
def _short_abi_json(raw: bytes) -> str:
    return _abi_json(raw)


@pandas_udf(StructType([StructField("contract", StringType()), StructField("abi_json", StringType())]))
def parse_setabi(data: pd.Series) -> pd.DataFrame:
    """Contract and ABI (as JSON, keys sorted) of a setabi action's data: name, length, binary ABI. An empty ABI is null; data that do not fit give two nulls."""

    def one(raw: bytes | None) -> tuple[str | None, str | None]:
        try:
            name = value_name(struct.unpack_from("<Q", raw)[0])
            n, at = read_varint(raw, 8)
            if at + n > len(raw):
                return None, None
            abi = bytes(raw[at : at + n])
            return name, (_short_abi_json if n <= SHORT_ABI else _abi_json)(abi) if n else None
        except (TypeError, ValueError, struct.error, IndexError, RecursionError):
            return None, None

    return pd.DataFrame([one(x) for x in data], columns=["contract", "abi_json"])


#: Chunks that are decoded before they are handed on.
PIECE = 50


def _varints(steps: np.ndarray) -> bytes:
    """Whole numbers, none below 0, one after the other in variable length."""
    size = np.ones(len(steps), np.int64)
    rest = steps >> 7
    while rest.any():
        size += rest > 0
        rest >>= 7
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[first[own] + k] = (steps[own] >> 7 * k & 127) | np.where(size[own] > k + 1, 128, 0)
    return out.tobytes()


def _read_varints(raw: np.ndarray, n: int) -> np.ndarray:
    """The first n numbers, below 2**64."""
    last = np.flatnonzero(raw < 128)[:n]
    if len(last) < n:
        raise ValueError("the chunk ends early")
    first = np.concatenate([[0], last[:-1] + 1])[:n]
    size = last - first + 1
    out = np.zeros(n, np.uint64)
    longest = int(size.max(initial=0))
    if longest > 10:
        raise ValueError("a number is too long")
    for k in range(longest):
        own = size > k
        out[own] |= (raw[first[own] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def encode_chunk(seqs: Any, base: int | None = None) -> bytes:
    """Ascending sequences as a chunk: base and number of them, then differences. With a base kept elsewhere (lean): their number, then differences from it."""
    if not len(seqs):
        raise ValueError("an empty chunk")
    seqs = np.asarray(seqs, np.int64)
    if base is None:
        head, steps = struct.pack("<QI", int(seqs[0]), len(seqs)), np.diff(seqs)
    else:
        head, steps = struct.pack("<I", len(seqs)), np.diff(seqs, prepend=np.int64(base))
    if (steps < 0).any():
        raise ValueError("sequences must ascend")
    return head + _varints(steps)


def _decoded(raw: bytes, base: int | None = None) -> np.ndarray:
    head = struct.calcsize("<QI") if base is None else 4
    if len(raw) < head:
        raise ValueError("the chunk ends early")
    first, n = struct.unpack_from("<QI", raw) if base is None else (base, struct.unpack_from("<I", raw)[0])
    if not n:
        raise ValueError("an empty chunk")
    steps = _read_varints(np.frombuffer(raw, np.uint8, offset=head), n - (base is None))
    out = np.cumsum(np.concatenate([np.zeros(int(base is None), np.uint64), steps])) + np.uint64(first)
    if (out[1:] < out[:-1]).any() or int(out[0]) < first or int(out[-1]) >= 2**63:
        raise ValueError("a sequence is too large")
    return out.astype(np.int64)


def decode_chunk(raw: bytes, base: int | None = None) -> list[int]:
    return _decoded(raw, base).tolist()


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    """An array's rows of numbers, without copies."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return (values[at[k] : at[k + 1]] if column[k].is_valid else None for k in range(len(column)))


def _pieces(*columns: pa.Array) -> Iterator[pa.Array]:
    """Rows (data; perhaps base) decoded, PIECE at a time."""
    for at in range(0, len(columns[0]), PIECE):
        own = [None if None in row else _decoded(*row) for row in zip(*(c.slice(at, PIECE).to_pylist() for c in columns), strict=True)]
        values = np.concatenate([np.empty(0, np.int64), *(x for x in own if x is not None)])
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in own)])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array([x is None for x in own]))


# A batch of chunks that Spark hands over has up to 64 MB (spark.sql.execution.arrow.maxBytesPerBatch)
# and may be all of a task's. It is read where it lies; what is made of it leaves in pieces.
@arrow_udf(BinaryType())
def chunk_bytes(seqs: pa.Array) -> pa.Array:
    return pa.array([None if s is None else encode_chunk(s) for s in _lists(seqs)], pa.binary())


@arrow_udf(ArrayType(LongType()))
def chunk_seqs(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in data:
        yield from _pieces(batch)


@arrow_udf(BinaryType())
def lean_chunk_bytes(base: pa.Array, seqs: pa.Array) -> pa.Array:
    return pa.array([None if s is None or b is None else encode_chunk(s, b) for b, s in zip(base.to_pylist(), _lists(seqs), strict=True)], pa.binary())


@arrow_udf(ArrayType(LongType()))
def lean_chunk_seqs(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for base, data in columns:
        yield from _pieces(data, base)


#: The digits of base 58, and curves by their number.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
CURVES = ("K1", "R1", "WA")


def base58(raw: bytes) -> str:
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, k = divmod(n, 58)
        out = BASE58[k] + out
    return BASE58[0] * (len(raw) - len(raw.lstrip(b"\0"))) + out


def signature(raw: bytes | None) -> str:
    """A signature's bytes (curve, then data) as text with a checksum of four bytes; unknown curves are empty."""
    if not raw or len(raw) < 2 or raw[0] >= len(CURVES):
        return ""
    curve, data = CURVES[raw[0]], bytes(raw[1:])
    return f"SIG_{curve}_" + base58(data + hashlib.new("ripemd160", data + curve.encode()).digest()[:4])


@pandas_udf(StringType())
def signature_text(data: pd.Series) -> pd.Series:
    return data.map(signature)


def packed_trx(expiration: Column, ref_block_num: Column, ref_block_prefix: Column, actions: Column) -> Column:
    """Hex of a transaction's packed form out of the bytes of its root actions (at most 127), without limits, delay and extensions."""
    head = F.concat(little(expiration, 4), little(ref_block_num, 2), little(ref_block_prefix, 4), little(F.lit(0), 3), little(F.lit(0), 1))
    listed = F.array_join(F.transform(actions, lambda a: F.hex(a)), "")
    return F.lower(F.concat(F.hex(head), F.hex(little(F.size(actions), 1)), listed, F.lit("00")))


#: Fixed value: what a zstandard frame begins with.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


@pandas_udf(BinaryType())
def compress(data: pd.Series) -> pd.Series:
    import zstandard

    return data.map(lambda x: None if x is None else zstandard.ZstdCompressor(level=3).compress(x))


@pandas_udf(BinaryType())
def decompress(data: pd.Series) -> pd.Series:
    """What a zstandard frame holds; other bytes as they are."""
    import zstandard

    return data.map(lambda x: zstandard.ZstdDecompressor().decompress(x) if x is not None and bytes(x[:4]) == ZSTD_MAGIC else x)


def checksums(data: Column) -> Column:
    """struct: CRC-32 and SHA-256 of a record."""
    return F.struct(F.crc32(data).alias("crc32"), F.sha2(data, 256).alias("sha256"))
