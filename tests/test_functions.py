"""Scalar functions against golden values and round trips."""

import random

import pytest
from pyspark.sql import functions as F

from blockfold.functions import assets, codecs, names, timeslots


def rows(spark, values, kind, *columns):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_slots(spark):
    golden = {0: "2000-01-01T00:00:00.000", 1: "2000-01-01T00:00:00.500", 120: "2000-01-01T00:01:00.000", 7200: "2000-01-01T01:00:00.000", 172800: "2000-01-02T00:00:00.000"}
    assert [r[0] for r in rows(spark, golden, "long", timeslots.slot_to_time(F.col("x")))] == list(golden.values())
    assert [r[0] for r in rows(spark, [*golden.values(), "", "2000-01-01T00:00:01Z", "nonsense"], "string", timeslots.time_to_slot(F.col("x")))] == [*golden, 0, 2, None]
    assert [r[0] for r in rows(spark, [0, 7200, 1593561600, 1593568800], "long", timeslots.slot_to_hour(F.col("x")))] == [262968, 262969, 484296, 484297]


def test_years_of_five_digits(spark):
    golden = {0: "1970-01-01T00:00:00", 253_402_300_799: "9999-12-31T23:59:59", 253_402_300_800: "10000-01-01T00:00:00", 6_000_000 * 99_991: "20981-07-13T10:40:00"}
    assert [r[0] for r in rows(spark, golden, "long", codecs.expiration(F.col("x")))] == list(golden.values())
    slot = (253_402_300_800 - 946_684_800) * 2
    time = timeslots.slot_to_time(F.col("x"))
    assert rows(spark, [slot + 1], "long", time, timeslots.time_to_slot(F.concat(time, F.lit("Z")))) == [("10000-01-01T00:00:00.500", slot + 1)]
    assert rows(spark, [253_402_300_800 // 3600], "long", timeslots.hour_to_date(F.col("x"))) == [("10000-01-01T00:00:00Z",)]


def test_dates(spark):
    assert timeslots.parse_date("2024-02-31") == timeslots.parse_date("2024-03-02")
    assert timeslots.parse_date("2024-01-05", True) - timeslots.parse_date("2024-01-05:00") == 23
    texts = ["2024-02-31", "2024-01-05:07", "2024-13-01", "x", "2024-01-32", "2024-01-01:24"]
    got = rows(spark, texts, "string", timeslots.date_to_hour(F.col("x")))
    assert [r[0] for r in got] == [timeslots.parse_date(texts[0]), timeslots.parse_date(texts[1]), None, None, None, None]
    assert timeslots.date_range("2024-01-03", None)[0] == timeslots.parse_date("2024-01-03")
    with pytest.raises(ValueError, match="366"):
        timeslots.date_range("2022-01-01", "2024-01-01")


def test_names(spark):
    r = random.Random(1)
    texts = ["", "eosio", "a.b", "zzzzzzzzzzzzz", "ABC", "abc...", "aaaaaaaaaaaaj", *("".join(r.choice("abcxyz.12345_Z") for _ in range(r.randint(0, 15))) for _ in range(200))]
    for text, (canonical, value, back) in zip(texts, rows(spark, texts, "string", names.canonical(F.col("x")), names.to_u64(F.col("x")), names.from_u64(names.to_u64(F.col("x")))), strict=True):
        assert canonical == back == codecs.value_name(codecs.name_value(text)), text
        assert int(value) == codecs.name_value(text)


def test_assets(spark):
    assert [r[0] for r in rows(spark, [0x4D45544F54, 0x4F4F46], "long", assets.symbol_code(F.col("x")))] == ["TOTEM", "FOO"]
    cases = [(1000000, 4, "TOTEM", "100.0000 TOTEM"), (100, 0, "NFT", "100 NFT"), (-12345, 4, "NEGS", "-1.2345 NEGS"), (-1, 4, "NEGS", "-0.0001 NEGS"), (123456789012, 8, "WAX", "1234.56789012 WAX")]
    df = spark.createDataFrame(cases, "a long, p int, c string, t string")
    out = df.select("*", assets.asset_format(F.col("a"), F.col("p"), F.col("c")).alias("f"), assets.asset_parse(F.col("t")).alias("b")).collect()
    assert all(x.f == x.t and (x.b.amount, x.b.precision, x.b.code) == (x.a, x.p, x.c) for x in out)
    assert rows(spark, ["invalid", "no_space_symbol", "1. FOO"], "string", assets.asset_parse(F.col("x"))) == [(None,)] * 3


def test_codecs():
    for n in (0, 1, -1, 127, 128, -300, 2**40, -(2**40)):
        assert codecs.unzigzag(codecs.read_varint(codecs.varint(codecs.zigzag(n)))[0]) == n
    assert codecs.drop_nulls({"a": None, "b": [None, {"c": None}]}) == {"b": [{}]}
    assert codecs.safe_ints([True, 2**32, -(2**31), -(2**31) - 1, {"a": 5}]) == [1, str(2**32), -(2**31), str(-(2**31) - 1), {"a": 5}]


def test_abi_decoding():
    abi = {
        "types": [{"new_type_name": "who", "type": "name"}],
        "structs": [
            {"name": "head", "base": "", "fields": [{"name": "from", "type": "who"}]},
            {"name": "pay", "base": "head", "fields": [{"name": "q", "type": "asset"}, {"name": "tags", "type": "string[]"}, {"name": "note", "type": "string?"}, {"name": "extra", "type": "uint8$"}]},
        ],
        "actions": [{"name": "pay", "type": "pay"}],
    }
    data = codecs.name_value("alice").to_bytes(8, "little") + (12345).to_bytes(8, "little") + b"\x04EOS\0\0\0\0" + b"\x02\x01a\x02bc" + b"\0"
    assert codecs.decode(abi, "pay", data) == {"from": "alice", "q": "1.2345 EOS", "tags": ["a", "bc"], "note": None, "extra": None}
    with pytest.raises(ValueError, match="early"):
        codecs.decode(abi, "pay", data[:20])
    with pytest.raises(ValueError, match="no action"):
        codecs.decode(abi, "other", data)


def test_chunks_of_sequences():
    for seqs in ([5], [100, 101, 400, 10**12], list(range(7, 30_000, 13))):
        assert codecs.decode_chunk(codecs.encode_chunk(seqs)) == seqs
        assert codecs.decode_chunk(codecs.encode_chunk(seqs, seqs[0]), seqs[0]) == seqs
    assert codecs.encode_chunk([300, 301, 600]) == bytes([44, 1, 0, 0, 0, 0, 0, 0, 3, 0, 0, 0, 1, 171, 2])
    assert codecs.encode_chunk([300, 301], 300) == bytes([2, 0, 0, 0, 0, 1])
    for bad in (b"", b"\1" * 5, codecs.encode_chunk([1, 2, 3])[:-1], bytes(12)):
        with pytest.raises(ValueError):
            codecs.decode_chunk(bad)
    with pytest.raises(ValueError):
        codecs.encode_chunk([])


def test_chunks_of_many_sizes():
    r = random.Random(2)
    for _ in range(200):
        seqs = sorted({r.randrange(2 ** r.randint(1, 63)) for _ in range(r.randint(1, 60))})
        parts = [codecs.varint(b - a) for a, b in zip(seqs, seqs[1:])]
        assert codecs.encode_chunk(seqs)[12:] == b"".join(parts)
        assert codecs.decode_chunk(codecs.encode_chunk(seqs) + b"rest") == seqs == codecs.decode_chunk(codecs.encode_chunk(seqs, 0), 0)
    with pytest.raises(ValueError):
        codecs.encode_chunk([2, 1])


def test_chunk_columns(spark):
    lists = [[k + 1, k + 300, k + 2**40] for k in range(120)] + [None]
    raw, lean = codecs.chunk_bytes("x"), codecs.lean_chunk_bytes(F.lit(1), F.col("x"))
    df = spark.createDataFrame([(x,) for x in lists], "x array<long>").coalesce(1).select("x", raw.alias("raw"), lean.alias("lean"))
    got = df.select("x", codecs.chunk_seqs("raw").alias("a"), codecs.lean_chunk_seqs(F.lit(1), F.col("lean")).alias("b")).collect()
    assert [x.a for x in got] == [x.b for x in got] == lists


def test_chunks_leave_in_pieces():
    import pyarrow as pa

    raw = codecs.encode_chunk(list(range(10_000)))
    before = pa.total_allocated_bytes()
    out = codecs.chunk_seqs.func(iter([pa.array([raw] * 2_000)]))
    most = 0
    for piece in out:
        most = max(most, pa.total_allocated_bytes() - before, piece.nbytes)
    assert most < 50 * 2**20  # all of them have 160 MB


def test_signatures():
    import hashlib

    assert codecs.base58(b"") == "" and codecs.base58(b"\0\0\1") == "112" and codecs.base58(b"hello world") == "StV1DL6CwTryKyV"
    for curve, name in enumerate(("K1", "R1", "WA")):
        data = bytes(range(65))
        text = codecs.signature(bytes([curve]) + data)
        n = 0
        for c in text.removeprefix(f"SIG_{name}_"):
            n = n * 58 + codecs.BASE58.index(c)
        raw = n.to_bytes(69, "big")
        assert raw[:65] == data and raw[65:] == hashlib.new("ripemd160", data + name.encode()).digest()[:4]
    assert codecs.signature(b"\3abc") == codecs.signature(b"") == codecs.signature(None) == ""


def test_binary_abis():
    text = lambda x: bytes([len(x)]) + x.encode()
    raw = text("v1") + b"\1" + text("who") + text("name") + b"\0\1" + codecs.name_value("pay").to_bytes(8, "little") + text("pay") + text("") + b"\0\0\0\0"
    assert codecs.unpack_abi(raw) == {
        "version": "v1",
        "types": [{"new_type_name": "who", "type": "name"}],
        "actions": [{"name": "pay", "type": "pay", "ricardian_contract": ""}],
        **{k: [] for k in ("structs", "tables", "ricardian_clauses", "error_messages", "abi_extensions")},
    }
    assert codecs.unpack_abi(raw + b"\1" + text("either") + b"\0")["variants"] == [{"name": "either", "types": []}]
    with pytest.raises(ValueError):
        codecs.unpack_abi(raw[:20])


def test_setabi_and_bytes(spark):
    cases = [None, b"", b"short", (7).to_bytes(8, "little"), (7).to_bytes(8, "little") + b"\0", (7).to_bytes(8, "little") + b"\x05ab"]
    got = rows(spark, cases, "binary", codecs.parse_setabi("x"))
    name = codecs.value_name(7)
    assert [tuple(r[0]) for r in got] == [(None, None)] * 4 + [(name, None), (None, None)]
    assert rows(spark, [258, 2**40 + 1, -2], "long", codecs.little(F.col("x"), 2)) == [(b"\2\1",), (b"\1\0",), (b"\xfe\xff",)]
    assert rows(spark, [b"plain", b"", None], "binary", codecs.decompress(codecs.compress("x")), codecs.decompress("x")) == [(b"plain",) * 2, (b"",) * 2, (None,) * 2]


def test_setabi_data_takes_no_loops_over_constants(spark):
    from blockfold.queries import _setabi

    plan = _setabi(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "aggregate(" not in plan and "lambda" not in plan


def test_an_abi_that_comes_again_is_read_once():
    text = lambda x: bytes([len(x)]) + x.encode()
    raw = (7).to_bytes(8, "little") + b"\x0a" + text("v1") + bytes(7)
    codecs._short_abi_json.cache_clear()
    got = codecs.parse_setabi.func([raw] * 3 + [raw[:9] + b"\x09"])
    assert got.abi_json.tolist()[:3] == [codecs._abi_json(raw[9:])] * 3 and codecs._short_abi_json.cache_info().misses == 1
    assert got.contract.isna().tolist() == [False] * 3 + [True]


def test_packed_transactions(spark):
    action = b"\1" * 40
    packed = codecs.packed_trx(F.lit(1), F.lit(2), F.lit(3), F.array(F.lit(action), F.lit(action)))
    assert rows(spark, [0], "long", packed) == [("0100000002000300000000000000" + "02" + "01" * 80 + "00",)]
