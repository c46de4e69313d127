"""Operators on hand-made histories, and invariants over the driver's events."""

import os

import pytest
from pyspark.sql import functions as F

from blockfold.operators import asof, canonical, filters, integrity, paging, stats
from blockfold.plans.history import History, from_events
from blockfold.sources import store
from blockfold.streaming import jobs

DATA = "/root/testdata/sf0.001"
SCHEMA = "slice_num long, block_num long, trx_index long, action_ordinal long, creator_ordinal long, receiver string, contract string, action string, data_index long, auths array<string>, global_seq long, hour long"


def family(spark):
    rows = [(1, 0, "ga", ["ha"], 4), (2, 1, "ha", ["ha"], 5), (3, 2, "ia", ["ha"], 6), (4, 0, "ga", ["ha"], 7)]
    return spark.createDataFrame([(0, 101, 0, o, c, r, "ga", "x", 0, a, s, 1) for o, c, r, a, s in rows], SCHEMA)


def test_family_rule(spark):
    got = {(r.account, r.global_seq) for r in canonical.canonical_actions(family(spark)).collect()}
    assert got == {("ga", 4), ("ha", 5), ("ia", 6), ("ga", 7), ("ha", 7)}


@pytest.fixture(scope="module")
def h(spark):
    if not os.path.exists(DATA):
        pytest.skip("no driver tables")
    made = from_events(spark.read.parquet(f"{DATA}/events.parquet"))
    return History(made.actions.persist(), made.abis, account_actions=canonical.canonical_actions(made.actions).persist())


def test_rows_are_unique_and_receivers_kept(h):
    rows = h.account_actions
    assert rows.groupBy("account", "global_seq").count().where("count > 1").isEmpty()
    assert h.actions.select(F.col("receiver").alias("account"), "global_seq").exceptAll(rows.select("account", "global_seq")).isEmpty()
    assert rows.count() == 1540


def test_pages_by_cursor_make_the_whole_list(h):
    whole = [r[0] for r in paging.of_account(h.account_actions, "ub").select("global_seq").orderBy(F.desc("global_seq")).collect()]
    seen, cursor = [], ""
    for _ in range(20):
        got = paging.activity(h.account_actions, "ub", limit=40, cursor=cursor)
        seen += [r.global_seq for r in got.rows.collect()]
        if not got.next_cursor:
            break
        cursor = got.next_cursor
    assert seen == whole
    back = paging.activity(h.account_actions, "ub", limit=40, cursor=got.prev_cursor)
    assert [r.global_seq for r in back.rows.collect()] == whole[len(whole) - len(whole) % 40 - 40 : len(whole) - len(whole) % 40]


def test_requests_are_checked(h):
    with pytest.raises(ValueError, match="invalid_filter"):
        paging.of_account(h.account_actions, "ub", action="click")
    with pytest.raises(ValueError, match="invalid_cursor"):
        paging.Cursor.decode("!")
    other = paging.Cursor(5, "desc", "other").encode()
    plain = [r.global_seq for r in paging.activity(h.account_actions, "ub", limit=3).rows.collect()]
    assert [r.global_seq for r in paging.activity(h.account_actions, "ub", limit=3, cursor=other).rows.collect()] == plain


def test_positions(spark):
    rows = spark.createDataFrame([(i,) for i in range(10, 20)], "global_seq long")
    take = lambda p, o: [r.global_seq for r in paging.pos_offset(rows, p, o).orderBy("n").collect()]
    assert take(-1, -3) == [19, 18, 17]
    assert take(-9, 0) == [19]
    assert take(0, 2) == take(1, 2) == [10, 11]
    assert take(3, -2) == [11, 12]
    assert take(99, 2) == [19]
    assert take(99, -2) == [18, 19]


def test_filters(spark):
    df = spark.createDataFrame([("a", "x", "r"), ("b", "y", "b"), ("c", "x", "c")], "contract string, action string, receiver string")
    keep = lambda c: [r.contract for r in df.where(c).collect()]
    assert keep(~filters.ignored(["a", "*::y", "*::*"])) == ["c"]
    assert keep(~filters.ignored([])) == ["a", "b", "c"]
    assert keep(filters.stream_matches()) == []
    assert keep(filters.stream_matches(receivers=["b", "c"], actions=["x"])) == ["c"]
    assert filters.can_fulfill(["a"], []) and not filters.can_fulfill(["a", "z"], ["a"])


def test_asof_ties_and_clears(spark):
    actions = spark.createDataFrame([("k", b, b * 10) for b in (1, 2, 3, 4)], "contract string, block_num long, global_seq long")
    log = spark.createDataFrame([("k", 2, 1, False), ("k", 2, 2, False), ("k", 4, 3, True)], "contract string, block_num long, ord long, cleared boolean")
    got = {r.block_num: (r.abi_ord, r.abi_state) for r in asof.abi_state(actions, log).collect()}
    assert got == {1: (None, "none"), 2: (2, "set"), 3: (2, "set"), 4: (None, "cleared")}


def test_hour_map_merge(spark):
    part = lambda *r: spark.createDataFrame(list(r), "hour long, min_seq long, max_seq long")
    merged = stats.merge_hour_maps(part((1, 100, 200), (3, 0, 0)), part((1, 150, 300), (2, 50, 100)))
    assert {tuple(r) for r in merged.collect()} == {(1, 100, 300), (2, 50, 100)}
    assert stats.hours_to_seqs(merged, 7, 9) == (0, 0)


def test_chunks_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(stats, "CHUNK", 4)
    rows = spark.createDataFrame([("a", i * 10) for i in range(10)], "account string, global_seq long")
    assert {(r.chunk, r.base, r.n) for r in stats.postings(rows, "account").collect()} == {(0, 0, 4), (1, 40, 4), (2, 80, 2)}


def test_integrity(spark):
    blocks = spark.createDataFrame([(0, 2, 1, 4, 4), (0, 3, 5, 6, 2), (0, 6, 9, 9, 1), (1, 12, 10, 11, 2), (1, 12, 10, 11, 2)], "slice_num long, block_num long, glob_min long, glob_max long, n_actions long")
    assert [r.block_num for r in integrity.missing_blocks(blocks).orderBy("block_num").collect()] == [4, 5]
    assert [(r.first_missing, r.last_missing) for r in integrity.missing_ranges(blocks).collect()] == [(4, 5)]
    assert [r.block_num for r in integrity.duplicate_blocks(blocks).collect()] == [12]
    assert [r.slice_num for r in integrity.slice_gaps(blocks).collect()] == [1]
    assert integrity.slice_overlaps(blocks).isEmpty()
    assert {r.slice_num: r.complete for r in integrity.completeness(blocks, 10).collect()} == {0: False, 1: False}


def test_store_round_trip(spark, tmp_path):
    actions = family(spark).drop("slice_num")
    config = store.Config(str(tmp_path), slice_blocks=100)
    store.append_actions(actions, config)
    store.append_actions(actions.withColumn("block_num", F.lit(250).cast("long")).withColumn("global_seq", F.col("global_seq") + 100), config)
    rows = store.open_blocks(spark, str(tmp_path))
    assert store.scan_block(rows, 250, 100).count() == 4
    assert {r.slice_num for r in rows.select("slice_num").distinct().collect()} == {1, 2}
    store.cut_after(spark, config, 150)
    store.cut_after(spark, config, 150)
    assert [r.block_num for r in store.open_blocks(spark, str(tmp_path)).select("block_num").distinct().collect()] == [101]


def test_appending_twice_and_cutting_after_a_crash(spark, tmp_path):
    config = store.Config(str(tmp_path), slice_blocks=100)
    rows = spark.createDataFrame([(b, b * 10, "x") for b in range(1, 301)], "block_num long, global_seq long, receiver string")
    for batch, own in ((0, "block_num <= 150"), (1, "block_num > 150"), (1, "block_num > 150")):
        store.append_actions(rows.where(own), config, batch)
    assert store.open_blocks(spark, str(tmp_path)).count() == 300
    (tmp_path / "_aside").mkdir()  # as if a cut had stopped after it had moved a slice
    (tmp_path / "actions" / "slice_num=2").rename(tmp_path / "_aside" / "slice_num=2")
    store.cut_after(spark, config, 205)
    left = store.open_blocks(spark, str(tmp_path))
    assert sorted(r.block_num for r in left.collect()) == list(range(1, 206))
    assert not (tmp_path / "_aside").exists()


def test_finalised_slices_have_digests(spark, tmp_path):
    rows = spark.createDataFrame([(0, b, b, "r", "c", "a") for b in range(1, 6)] + [(1, 6, 6, "r", "c", "a")], "slice_num long, block_num long, global_seq long, receiver string, contract string, action string")
    blocks = rows.withColumn("glob_min", F.col("global_seq")).withColumn("glob_max", F.col("global_seq"))
    config = store.Config(str(tmp_path), slice_blocks=5)
    done = store.write_finalised(rows, blocks, config).collect()
    again = store.digests(rows.repartition(4)).where("slice_num = 0").first()
    other = store.digests(rows.withColumn("action", F.lit("b"))).where("slice_num = 0").first()
    assert [(r.slice_num, r.found) for r in done] == [(0, 5)] and done[0].digest == again.digest != other.digest


def test_settings_and_traces(tmp_path):
    (tmp_path / "c.ini").write_text("[store]\npath = /x\nslice_blocks = 7\n")
    assert store.Config.load(f"{tmp_path}/c.ini", flags={"slice-blocks": "9"}) == store.Config("/x", 9)
    with pytest.raises(ValueError, match="unknown"):
        store.Config.load(flags={"path": "/x", "colour": "red"})
    trace = store.Trace()
    with trace.step("index", "page") as step:
        step["count"] = 3
    assert trace.steps[0]["count"] == 3 and '"component": "index"' in trace.to_json()
    with pytest.raises(ValueError, match="no source"):
        store.open_blocks(None, "http://x")


def test_compaction_keeps_rows_once(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = spark.createDataFrame([("a", i) for i in range(10)], "account string, global_seq long")
    for n, own in enumerate(("global_seq < 4", "global_seq between 3 and 6")):
        rows.where(own).write.parquet(f"{folder}/delta/batch={n}")
    assert not jobs.compact(spark, folder, "delta", ["account", "global_seq"], at_least=100)
    assert jobs.compact(spark, folder, "delta", ["account", "global_seq"])
    rows.where("global_seq > 6").write.parquet(f"{folder}/delta/batch=2")
    assert jobs.merged(spark, folder, "delta").count() == 10
    rows.where("global_seq between 3 and 6").write.parquet(f"{folder}/delta/batch=1")  # a batch repeated after its compaction
    assert jobs.merged(spark, folder, "delta").count() == 10
    assert jobs.compact(spark, folder, "delta", ["account", "global_seq"]) and not jobs.compact(spark, folder, "delta", ["account", "global_seq"])
    assert sorted(p.name for p in (tmp_path / "base").iterdir()) == ["batch=2"] and not list((tmp_path / "delta").glob("batch=*"))
    assert jobs.merged(spark, folder, "delta").count() == 10


def test_stretches_do_not_show(spark, monkeypatch):
    rows = spark.createDataFrame([("a", i * 3) for i in range(50)] + [("b", 7)], "account string, global_seq long")
    whole = {tuple(r) for r in stats.postings(rows, "account").select("account", "chunk", "base", "n").collect()}
    own = rows.where("account = 'a'").select("global_seq")
    places = [r.global_seq for r in paging.positions(own, 12, 9).orderBy("place").collect()]
    monkeypatch.setattr(stats, "STRETCH", 10)
    assert {tuple(r) for r in stats.postings(rows, "account").select("account", "chunk", "base", "n").collect()} == whole
    assert [r.global_seq for r in paging.positions(own, 12, 9).orderBy("place").collect()] == places == [i * 3 for i in range(12, 21)]
    left = spark.createDataFrame([("k", b, b) for b in range(1, 60)] + [("z", 5, 5)], "k string, at long, id long")
    right = spark.createDataFrame([("k", 3, 1, "x"), ("k", 3, 2, "y"), ("k", 31, 1, "z"), ("q", 1, 1, "w")], "k string, at long, tie long, v string")
    want = {b: None if b < 3 else "y" if b < 31 else "z" for b in range(1, 60)}
    for stretch in (7, 1000):
        assert {r.id: r.v for r in asof.asof(left, right, "k", "at", "tie", "v", stretch).where("k = 'k'").collect()} == want
    near = stats.in_ranges(rows, "global_seq", spark.createDataFrame([(5, 12), (100, 90), (7, 7)], "lo long, hi long"), "lo", "hi", 4)
    assert sorted((r.account, r.global_seq, r.lo) for r in near.collect()) == [("a", 6, 5), ("a", 9, 5), ("a", 12, 5), ("b", 7, 5), ("b", 7, 7)]


def test_request_checks():
    assert filters.query_allowed([], ["a"]) and filters.query_allowed(["z"], []) and not filters.query_allowed(["a", "z"], ["a"])


def test_ingest_invariants(spark):
    df = spark.createDataFrame([(1, "r", "r", ["a"], [5]), (2, "r", "q", ["a"], [5]), (3, "r", "r", ["a"], [5, 6])], "global_seq long, receiver string, receipt_receiver string, auths array<string>, auth_seqs array<long>")
    assert {(r.global_seq, r.rule) for r in integrity.ingest_violations(df).collect()} == {(2, "RECEIPT_RECEIVER"), (3, "AUTH_COUNT")}
    assert integrity.enforce(df.where("global_seq = 1")).count() == 1
    with pytest.raises(Exception, match="invariant broken"):
        integrity.enforce(df).collect()
