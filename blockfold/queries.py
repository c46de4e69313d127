"""Registered queries: each operator with fixed parameters over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import assets, codecs, names, timeslots
from .operators import asof, canonical, filters, integrity, paging, sets, stats, transactions
from .plans.history import SLICE_BLOCKS, History, from_events
from .session import work_folder
from .sources import store
from .streaming import jobs

ACCOUNT, OTHER, CONTRACT, ACTION = "ub", "uc", "cd", "click"
BLOCK, FIRST, LAST = 20, 10, 40
SEQ_LO, SEQ_HI, CURSOR = 100, 700, 500
HOUR_LO, HOUR_HI = 473_352, 473_400
PATTERNS = ("ca", "cb::*", "*::error", "cd::view", "*::*")
ACCOUNT_PATTERNS = ("ca", "ub@cd::click", "uc@*", "ud@*::view")
#: Live subscriptions: contracts, actions, receivers.
SUBSCRIPTIONS = ((("cd",), (), ()), ((), ("click",), ("ub",)), (("ca",), ("view",), ("uc", "ca")), ((), ("error",), ()))
SEQS = (7, 3, 3, 250, 999_999_999, 12)
Query = Callable[[SparkSession, str], DataFrame]


def history(spark: SparkSession, sf_dir: str) -> History:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


_STORES: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str) -> History:
    """The history of a table, read from a clustered store.

    The store is written once per session and state of the table's files, in
    the work folder. Pages of an account then read the few row groups that
    hold its keys.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = [at(f).getFileSystem(conf).getFileStatus(at(f)) for f in sorted(events.inputFiles())]
    state = (spark.sparkContext.applicationId, sf_dir, *((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))
    if state not in _STORES:
        path = work_folder(spark)
        from_events(events).save(path)
        _STORES[state] = path
    return History.load(spark, _STORES[state])


def _paged(part: Callable[[History], DataFrame]) -> Query:
    return lambda spark, sf_dir: part(stored(spark, sf_dir))


def _on(part: Callable[[History], DataFrame]) -> Query:
    return lambda spark, sf_dir: part(history(spark, sf_dir))


def _seqs(df: DataFrame) -> DataFrame:
    return df.select("global_seq")


def _account(h: History, contract: str = "", action: str = "", account: str = ACCOUNT) -> DataFrame:
    return paging.of_account(h.account_actions, account, contract, action)


def _zone(h: History) -> tuple[int, int]:
    return stats.hours_to_seqs(h.hour_map, HOUR_LO, HOUR_HI)


def _split(h: History) -> tuple[DataFrame, DataFrame]:
    """Compacted rows and a delta that overlaps them."""
    rows = h.account_actions.select("account", "global_seq")
    return rows.where("global_seq <= 600"), rows.where("global_seq > 550")


def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 20 log rows of an account."""
    h = stored(spark, sf_dir)
    newest = paging.page(_account(h), 20).select("global_seq", F.floor((F.col("block_num") - 1) / SLICE_BLOCKS).cast("int").alias("slice_num"))
    rows = paging.project_log(h.actions.join(F.broadcast(newest), ["slice_num", "global_seq"]))  # 20 rows, which prune the slices
    return rows.withColumn("block_time", F.date_format("block_time", "yyyy-MM-dd HH:mm:ss"))


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = stored(spark, sf_dir)
    first = paging.activity(h.account_actions, ACCOUNT, limit=10)
    got = paging.activity(h.account_actions, ACCOUNT, limit=10, cursor=first.next_cursor or "")
    return got.rows.select("global_seq", "contract", "action", F.lit(got.next_cursor is not None).alias("has_next"), F.lit(got.prev_cursor is not None).alias("has_prev"))


def _truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _seqs(_account(stored(spark, sf_dir)))
    cases = [(-1, -20), (-5, 0), (0, 5), (3, 4), (7, -3), (10_000, 2), (10_000, -2)]
    parts = [paging.pos_offset(rows, p, o).select(F.lit(p).alias("pos"), F.lit(o).alias("off"), F.col("n").cast("long").alias("n"), "global_seq") for p, o in cases]
    return reduce(DataFrame.union, parts)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("user_id"), F.round(F.col("value") * 10000).cast("long").alias("quantity"))


def _f(columns: Callable[[], list[Column]]) -> Query:
    """Columns are made when the query runs, as they need a session."""
    return lambda spark, sf_dir: _lines(spark, sf_dir).select("event_id", *columns())


def _raw_name() -> Column:
    return F.concat(F.upper(F.substring("event_type", 1, 2)), "event_type", F.lit("z9."), F.col("user_id").cast("string"), F.lit("zz"))


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Actions as a stream of files of whole blocks, and a work folder."""
    folder = work_folder(spark)
    h = history(spark, sf_dir)
    h.actions.repartitionByRange(4, "block_num").write.parquet(f"{folder}/actions")
    return jobs.source(spark, f"{folder}/actions"), folder


def _stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _streamed(spark, sf_dir)
    pushed = jobs.subscribe(stream, contracts=[CONTRACT], names=[ACTION, "view"])
    jobs.run(pushed, f"{folder}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/pushed/batch={n}")).awaitTermination()
    return spark.read.parquet(f"{folder}/pushed").drop("batch")


def _stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _streamed(spark, sf_dir)
    jobs.maintain_index(stream, folder, every=2).awaitTermination()
    return jobs.compacted(spark, folder)


def _stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _streamed(spark, sf_dir)
    jobs.maintain_hours(stream, folder).awaitTermination()
    return jobs.hour_map(spark, folder)


def _stream_trx(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _streamed(spark, sf_dir)
    jobs.maintain_trx(stream, folder, merge_entries=100).awaitTermination()
    return jobs.trx_entries(spark, folder)


def _binary_text(text: Column) -> Column:
    return F.concat(codecs.little(F.length(text), 1), text.cast("binary"))


def _setabi_data(contract: Column, version: Column, empty: Column) -> Column:
    """Data of a setabi action whose ABI has a struct `put` {q: uint64}, for the actions click and view."""
    count = lambda n: bytes([n])
    words = lambda *xs: b"".join(bytes([len(x)]) + x.encode() for x in xs)
    name = lambda x: codecs.name_value(x).to_bytes(8, "little")
    put = count(1) + words("put", "") + count(1) + words("q", "uint64")
    actions = count(2) + name("click") + words("put", "") + name("view") + words("put", "")
    abi = F.concat(_binary_text(version), F.lit(count(0) + put + actions + count(0) * 4))
    size = F.length(abi)
    length = F.concat(codecs.little(size % 128 + 128, 1), codecs.little(F.floor(size / 128), 1))  # as a number of two bytes
    return F.concat(codecs.little(names.signed(names.to_u64(contract)), 8), F.when(empty, F.lit(count(0))).otherwise(F.concat(length, abi)))


def _raw_actions(h: History) -> DataFrame:
    """Actions with binary data: the ABI log's entries as setabi of the system contract, all others with their quantity."""
    set_ = h.abis.select("block_num", F.col("ord").alias("global_seq"), F.lit(store.SYSTEM_CONTRACT).alias("contract"), F.lit(store.SET_ABI).alias("action"), _setabi_data(F.col("contract"), F.concat(F.lit("v"), F.col("ord").cast("string")), F.col("cleared")).alias("data"))
    return h.actions.select("block_num", "global_seq", "contract", "action", codecs.little(F.col("quantity"), 8).alias("data")).unionByName(set_)


def _abi_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rebuilt log appended in two batches, one of them twice, and read back."""
    path = f"{work_folder(spark)}/abis"
    log = store.rebuild_abis(_raw_actions(history(spark, sf_dir)))
    for batch, own in ((0, "ord % 2 = 0"), (1, "ord % 2 = 1"), (1, "ord % 2 = 1")):
        store.append_abis(log.where(own), path, batch)
    return store.abi_log(spark, path).select("contract", "block_num", "ord")


def _stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushed actions with their data decoded by the ABI in force, as hex where there is none for them."""
    stream, folder = _streamed(spark, sf_dir)
    h = history(spark, sf_dir)
    store.rebuild_abis(_raw_actions(h)).select(F.col("ord").alias("abi_ord"), "abi_json").write.parquet(f"{folder}/abis")
    log = spark.read.parquet(f"{folder}/abis")

    def each(df: DataFrame, n: int) -> None:
        out = asof.abi_state(df.select("contract", "block_num", "global_seq", "action", codecs.little(F.col("quantity"), 8).alias("data")), h.abis)
        out = out.join(log, "abi_ord", "left").select("global_seq", "abi_state", codecs.abi_decode("abi_json", "action", "data").alias("data"))
        out.write.mode("overwrite").parquet(f"{folder}/decoded/batch={n}")

    jobs.run(stream, f"{folder}/checkpoint", each).awaitTermination()
    return spark.read.parquet(f"{folder}/decoded").drop("batch")


class _Totals:
    """An index of action totals by contract, for the sync driver."""

    def __init__(self, folder: str):
        self.folder = folder

    def add(self, actions: DataFrame, batch: int) -> None:
        actions.groupBy("contract").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/totals/batch={batch}")

    def finish(self) -> None:
        pass


def _sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, folder = _streamed(spark, sf_dir)
    jobs.sync(stream, _Totals(folder), f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/totals").groupBy("contract").agg(F.sum("n").alias("n"))


def _stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, folder = _streamed(spark, sf_dir)
    stream = store.open_blocks(spark, f"stream:{folder}")
    jobs.process_ids(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/ids/batch={n}"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/ids").drop("batch")


def _stream_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own index over batches: actions by receiver."""
    stream, folder = _streamed(spark, sf_dir)
    own = lambda df, n: df.groupBy("receiver").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/own/batch={n}")
    jobs.process(stream, own, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/own").groupBy("receiver").agg(F.sum("n").alias("n"))


def _appended(spark: SparkSession, sf_dir: str) -> store.Config:
    """A store of all actions, appended in two batches, one of them twice."""
    config = store.Config(work_folder(spark), SLICE_BLOCKS)
    actions = history(spark, sf_dir).actions.drop("slice_num")
    for batch, own in ((0, "block_num <= 700"), (1, "block_num > 700"), (1, "block_num > 700")):
        store.append_actions(actions.where(own), config, batch)
    return config


def _store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.open_blocks(spark, _appended(spark, sf_dir).path)
    return store.rebuild_block_index(rows).select(F.col("slice_num").cast("long").alias("slice_num"), "block_num", "glob_min", "glob_max")


def _store_finalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _appended(spark, sf_dir)
    rows = store.open_blocks(spark, config.path).withColumn("slice_num", F.col("slice_num").cast("long"))
    return store.write_finalised(rows, History(rows).blocks, config)


def _store_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _appended(spark, sf_dir)
    store.cut_after(spark, config, 750)
    return store.open_blocks(spark, config.path).select("block_num", "global_seq")


def _slice_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of a store that grew after it was made."""
    config = store.Config(work_folder(spark), SLICE_BLOCKS)
    actions = history(spark, sf_dir).actions.drop("slice_num")
    store.append_actions(actions.where("block_num <= 750"), config, 0)
    store.refresh_slices(spark, config.path)
    store.append_actions(actions.where("block_num > 750"), config, 1)
    return store.refresh_slices(spark, config.path)


def _can_fulfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [([], []), (["ca"], []), (["ca"], ["ca", "cb"]), (["ca", "cz"], ["ca", "cb"]), ([], ["ca"])]
    return spark.createDataFrame([(i, filters.can_fulfill(*c)) for i, c in enumerate(cases)], "i long, ok boolean")


def _receipts(h: History) -> DataFrame:
    """Actions with their receipts' receiver and authorization sequences, some of them wrong."""
    seq = F.col("global_seq")
    return h.actions.select("global_seq", "receiver", "auths", F.when(seq % 97 == 0, "zz").otherwise(F.col("receiver")).alias("receipt_receiver"), F.when(seq % 89 == 0, F.array(seq)).otherwise(F.transform("auths", lambda a: seq)).alias("auth_seqs"))


def _packed(h: History) -> DataFrame:
    """Packed transactions out of their root actions."""
    raw = codecs.action_bytes("contract", "action", F.array(F.concat(F.col("receiver"), F.lit("@active"))), codecs.little(F.col("quantity"), 8))
    own = transactions.root_actions(h.actions).select("trx_id", "block_num", "global_seq", raw.alias("raw"))
    grouped = own.groupBy("trx_id", "block_num").agg(F.array_sort(F.collect_list(F.struct("global_seq", "raw"))).alias("a"))
    return grouped.select("trx_id", codecs.packed_trx(F.col("block_num") + 1_700_000_000, F.col("block_num") % 65536, F.col("block_num") * 3, F.col("a.raw")).alias("packed"))


def _chunk_codec(h: History) -> DataFrame:
    lists = stats.postings(h.account_actions, "account")
    coded = lists.select("account", "chunk", "base", codecs.chunk_bytes("seqs").alias("raw"), codecs.lean_chunk_bytes("base", "seqs").alias("lean"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return coded.select("account", "chunk", text(codecs.chunk_seqs("raw")).alias("seqs"), text(codecs.lean_chunk_seqs("base", "lean")).alias("lean_seqs"), F.lower(F.hex(F.substring("raw", 1, 12))).alias("head"))


def _issues(h: History) -> DataFrame:
    return integrity.issues(h.blocks, h.actions, SLICE_BLOCKS, CONTRACT, ACTION)


def _modes(h: History) -> DataFrame:
    """Findings of each mode over the leading slices, gaps planted."""
    own = h.blocks.where("block_num % 7 > 1")
    parts = [integrity.report(integrity.validate(own, h.actions, SLICE_BLOCKS, CONTRACT, ACTION, m, 250)).select(F.lit(m).alias("mode"), "kind", "n") for m in ("FAST", "FULL", "ONBLOCK")]
    return reduce(DataFrame.union, parts)


def _broken(h: History) -> DataFrame:
    """Blocks with a duplicate, one beyond its slice, and overlapping slices, to be found."""
    b = h.blocks
    return b.unionByName(b.where("block_num % 50 = 7")).unionByName(b.where("block_num % 100 = 1 and slice_num > 0").withColumn("slice_num", F.col("slice_num") - 1))


#: An ABI for the decoding queries: a struct with a name, a number and a text.
ABI = '{"structs":[{"name":"note","base":"","fields":[{"name":"from","type":"name"},{"name":"n","type":"uint32"},{"name":"memo","type":"string"}]}],"actions":[{"name":"note","type":"note"}]}'


def _decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _lines(spark, sf_dir)
    rows = e.withColumn("u", names.to_u64(names.canonical(F.col("event_type"))))
    rows = rows.withColumn("data", F.concat(codecs.little(names.signed(F.col("u")), 8), codecs.little(F.col("event_id"), 4), codecs.little(F.length("event_type"), 1), F.col("event_type").cast("binary")))
    return rows.select("event_id", codecs.abi_decode(F.lit(ABI), F.lit("note"), "data").alias("decoded"))


def _setabi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _lines(spark, sf_dir)
    data = _setabi_data(F.col("event_type"), F.concat(F.lit("v"), F.col("user_id").cast("string")), F.col("event_id") % 7 == 0)
    return e.select("event_id", codecs.parse_setabi(data).alias("p")).select("event_id", "p.contract", "p.abi_json")


def _json(change) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _lines(spark, sf_dir)
        text = F.concat(F.lit('{"a":'), (F.col("event_id") * 10_000_000).cast("string"), F.lit(',"b":[true,null,'), F.col("user_id").cast("string"), F.lit(',{"c":null}],"d":null}'))
        return e.select("event_id", change(text).alias("out"))

    return query


def _abi_state(h: History) -> DataFrame:
    return asof.abi_state(h.actions.select("contract", "block_num", "global_seq"), h.abis).select("global_seq", "abi_ord", "abi_state")


def _probe_trx(h: History) -> list[str]:
    import hashlib

    return [hashlib.sha256(f"{b}:{t}".encode()).hexdigest() for b, t in ((20, 0), (33, 0), (35, 0), (5, 9))]


def _postings(h: History) -> DataFrame:
    lists = stats.postings(h.account_actions, "account", "contract")
    return lists.select("account", "contract", "chunk", "base", "n", F.array_join(F.col("seqs").cast("array<string>"), ",").alias("seqs"))


def _meta(h: History) -> DataFrame:
    return stats.chunk_metadata(stats.postings(h.account_actions, "account"), "account")


def _ordered(h: History) -> DataFrame:
    w = Window.partitionBy("block_num").orderBy("global_seq")
    return h.actions.select("block_num", "global_seq", (F.row_number().over(w) - 1).cast("long").alias("position"))


def _seq_to_block(h: History) -> DataFrame:
    asked = h.spark.createDataFrame([(s,) for s in sorted(set(SEQS))], "seq long")
    return stats.in_ranges(asked, "seq", h.blocks, "glob_min", "glob_max").select("seq", "block_num")


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = paging.fetch(history(spark, sf_dir).actions, list(SEQS))
    return out.select(F.col("pos").cast("long").alias("pos"), "global_seq", "block_num", "contract", "action")


def _dictionary(h: History) -> DataFrame:
    """Rows as indexes into their block's sorted names, and back."""
    own = h.actions.groupBy("block_num").agg(F.array_sort(F.collect_set("receiver")).alias("names"))
    coded = h.actions.select("block_num", "global_seq", "receiver").join(own, "block_num")
    coded = coded.select("block_num", "global_seq", "names", F.array_position("names", F.col("receiver")).alias("i"))
    return coded.select("block_num", "global_seq", F.element_at("names", F.col("i").cast("int")).alias("receiver"), (F.col("i") - 1).alias("name_index"))


def _has_prev(h: History) -> DataFrame:
    rows = _account(h)
    one = paging.page(rows, 1, newest=False, cursor=CURSOR)
    return one.agg((F.count("*") > 0).alias("has_prev"))


def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    print_ = codecs.fingerprint_column(F.lit(ACCOUNT), F.col("event_type"), F.lit(""), F.lit(""), F.lit(""), F.lit(""))
    text = F.concat(F.lit('{"g":'), F.col("event_id").cast("string"), F.lit(',"o":"desc","q":"'), print_, F.lit('"}'))
    return _lines(spark, sf_dir).select("event_id", F.base64(text.cast("binary")).alias("cursor"))


def _action_bytes(digest: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _lines(spark, sf_dir)
        raw = codecs.action_bytes(F.lit("click"), F.col("event_type"), F.array(F.concat(F.lit("view@"), F.lit("error"))), F.col("quantity").cast("string").cast("binary"))
        out = codecs.action_digest(F.col("raw")).alias("digest") if digest else F.lower(F.hex("raw")).alias("raw")
        return e.select("event_id", raw.alias("raw")).select("event_id", out)

    return query


def _varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _lines(spark, sf_dir).select("event_id", (F.col("event_id") - 300).alias("n"), codecs.varint_bytes(F.col("event_id") - 300).alias("raw"))
    return coded.select("event_id", F.lower(F.hex("raw")).alias("raw"), codecs.varint_numbers("raw").alias("n"))


def _slot() -> Column:
    return F.col("event_id") * 7919 + 1_500_000_000


def _date() -> Column:
    digit, day = (F.col("event_id") % 9 + 1).cast("string"), (F.col("event_id") % 31 + 1).cast("string")
    return F.concat(F.lit("2024-0"), digit, F.lit("-"), F.lpad(day, 2, "0"), F.when(F.col("event_id") % 2 == 0, ":05").otherwise(""))


QUERIES: dict[str, Query] = {
    # scans
    "log_page": log_page,
    "scan_blocks": _on(lambda h: store.scan_block(h.blocks, BLOCK, SLICE_BLOCKS).select("block_num", "glob_min", "glob_max", "n_actions")),
    "scan_block_range": _on(lambda h: store.scan_range(h.actions, FIRST, LAST, SLICE_BLOCKS).where(~filters.ignored(PATTERNS)).select("block_num", "global_seq", "contract", "action")),
    "scan_raw_actions_in_block": _on(lambda h: store.scan_block(h.actions, BLOCK, SLICE_BLOCKS).orderBy("global_seq").select("global_seq", "trx_id", "receiver", "contract", "action", F.array_join("auths", ",").alias("auths"))),
    "notified_in_block": _on(lambda h: store.scan_block(h.actions, BLOCK, SLICE_BLOCKS).select("global_seq", F.array_join(F.array("receiver"), ",").alias("notified"))),
    "raw_actions_filtered": _on(lambda h: store.scan_range(h.actions, FIRST, LAST, SLICE_BLOCKS).where((F.col("contract") == CONTRACT) & (F.col("action") == ACTION)).select("block_num", "global_seq")),
    "scan_slice": _on(lambda h: store.scan_slice(h.actions, 3).select("block_num", "global_seq")),
    "store_append": _store_append,
    "store_finalise": _store_finalise,
    "store_cut": _store_cut,
    "slice_cache": _slice_cache,
    "trx_ids_in_block": _on(lambda h: store.scan_block(h.transactions, BLOCK, SLICE_BLOCKS).select("trx_index", "trx_id")),
    "abi_rebuild": _on(lambda h: store.rebuild_abis(_raw_actions(h))),
    "abi_log_sink": _abi_sink,
    "state_props": _on(lambda h: store.state(h.blocks)),
    "first_available_block": _on(lambda h: store.first_available(h.blocks, 7)),
    "notifications_in_block": _on(lambda h: canonical.notifications(store.scan_block(h.actions, BLOCK, SLICE_BLOCKS)).select("account", F.array_join(F.col("seqs").cast("array<string>"), ",").alias("seqs"))),
    # predicates and projections
    "filter_ignored_actions": _on(lambda h: _seqs(h.actions.where(~filters.ignored(PATTERNS)))),
    "filter_ignored_for_account": _on(lambda h: h.account_actions.where(~filters.ignored_for_account(ACCOUNT_PATTERNS)).select("account", "global_seq")),
    "filter_include_contracts": _on(lambda h: _seqs(h.actions.where(filters.included(["ca", "cd"])))),
    "filter_combined": _on(lambda h: _seqs(h.actions.where(filters.combined(PATTERNS, ["cb", "cd", "ce"])))),
    "filter_stream": _on(lambda h: _seqs(h.actions.where(filters.stream_matches([CONTRACT], [ACTION, "view"], [ACCOUNT, CONTRACT])))),
    "can_fulfill": _can_fulfill,
    "could_match": _on(lambda h: _seqs(h.actions.where(filters.could_match(SUBSCRIPTIONS)))),
    "body_allowed": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", filters.body_allowed(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"account_name":"x","extra":'), "props", F.lit("}"))).otherwise(F.col("props")), ["k", "account_name"]).alias("allowed")),
    "executions": _on(lambda h: _seqs(canonical.executions(h.actions))),
    "filter_seq_range": _on(lambda h: _seqs(h.actions.where(filters.seq_range(SEQ_LO, SEQ_HI)))),
    "filter_date": _on(lambda h: _seqs(filters.hours(h.actions, timeslots.parse_date("2024-01-05"), timeslots.parse_date("2024-01-05", True)))),
    "filter_date_range": _on(lambda h: _seqs(filters.hours(h.actions, *timeslots.date_range("2024-01-03:05", "2024-01-09"), zone=stats.hours_to_seqs(h.hour_map, *timeslots.date_range("2024-01-03:05", "2024-01-09"))))),
    "project_log": _on(lambda h: paging.project_log(h.actions).withColumn("block_time", F.date_format("block_time", "yyyy-MM-dd HH:mm:ss"))),
    "project_activity": _on(lambda h: paging.project_activity(h.actions).select("global_seq", "receiver", F.array_join("auths", ",").alias("auths"), "creator_ordinal", "irreversible", F.col("account_action_seq").cast("long").alias("account_action_seq"))),
    "search_account_in_block": _on(lambda h: filters.account_in_block(h.actions, BLOCK, "cd")),
    "root_actions": _on(lambda h: _seqs(transactions.root_actions(h.actions))),
    # joins
    "fetch_by_seq": _fetched,
    "seq_to_block": _on(_seq_to_block),
    "dictionary_resolve": _on(_dictionary),
    "notify_explode": _on(lambda h: canonical.notified(h.actions).select("account", "global_seq", "is_recv", "is_auth")),
    "canonical_actions": _on(lambda h: h.account_actions),
    "action_tree_root": _on(lambda h: canonical.roots(h.actions).select("global_seq", "action_ordinal", "root")),
    "abi_asof": _on(_abi_state),
    "trx_lookup": _on(lambda h: transactions.lookup(transactions.trx_index(h.transactions), _probe_trx(h)[0])),
    "trx_with_actions": _on(lambda h: transactions.with_actions(h.actions, _probe_trx(h)).select("trx_id", "block_num", F.array_join(F.transform("actions", lambda a: F.concat_ws(":", a["global_seq"].cast("string"), a["receiver"], a["contract"], a["action"])), ";").alias("actions"))),
    "trx_status": _on(lambda h: transactions.status(h.transactions, h.blocks, _probe_trx(h))),
    "delta_read": _on(lambda h: sets.delta_read(*_split(h))),
    "filter_discrepancy": _on(lambda h: canonical.discrepancy(h.actions, h.account_actions, ACCOUNT)),
    "multi_action_merge": _on(lambda h: _seqs(_account(h, CONTRACT, account=CONTRACT).where(F.col("action").isin(ACTION, "view")))),
    # aggregates
    "account_total": _on(lambda h: h.account_actions.groupBy("account").agg(F.count("*").alias("total"))),
    "account_stats": _on(lambda h: stats.account_stats(h.account_actions)),
    "block_seq_minmax": _on(lambda h: h.account_actions.groupBy("block_num").agg(F.min("global_seq").alias("min_seq"), F.max("global_seq").alias("max_seq"))),
    "hour_map": _on(lambda h: h.hour_map),
    "hour_range": _on(lambda h: h.hour_map.agg(F.min("hour").alias("min_hour"), F.max("hour").alias("max_hour"), F.count("*").alias("hours"), F.max("max_seq").alias("max_seq"))),
    "seq_range_for_hours": _on(lambda h: stats.seq_range_of_hours(h.hour_map, HOUR_LO, HOUR_HI)),
    "seq_to_hour": _on(lambda h: stats.hour_of_seq(h.hour_map, _seqs(_account(h)))),
    "actions_per_account_in_block": _on(lambda h: h.account_actions.where(F.col("block_num") == BLOCK).groupBy("account").agg(F.count("*").alias("n"))),
    "block_summary": _on(lambda h: stats.block_summary(h.actions, canonical.notified(h.actions))),
    "index_postings": _on(_postings),
    "chunked_postings": _on(lambda h: stats.postings(h.account_actions, "account").select("account", "chunk", "base", "n")),
    "chunk_metadata": _on(_meta),
    "slice_stats": _on(lambda h: stats.slice_stats(h.blocks)),
    "glob_total": _on(lambda h: stats.glob_total(h.blocks)),
    "trx_index_partitions": _on(lambda h: transactions.partitions(transactions.trx_index(h.transactions))),
    "validation_summary": _on(lambda h: integrity.report(_issues(h))),
    "ingest_stats": _on(lambda h: h.actions.agg(F.count("*").alias("actions"), F.countDistinct("trx_id").alias("transactions"), F.sum(F.length("action")).alias("bytes"), F.max("global_seq").alias("max_seq"))),
    "wal_status": _on(lambda h: _split(h)[1].agg(F.count("*").alias("rows"), F.min("global_seq").alias("min_seq"), F.max("global_seq").alias("max_seq"))),
    "slice_compare": _on(lambda h: stats.slice_compare(stats.slice_stats(h.blocks), 0, 1)),
    # order
    "block_gaps": _on(lambda h: integrity.block_gaps(h.blocks)),
    "glob_gaps": _on(lambda h: integrity.glob_gaps(h.blocks.where("block_num % 5 <> 0"))),
    "duplicate_blocks": _on(lambda h: integrity.duplicate_blocks(_broken(h))),
    "missing_ranges": _on(lambda h: integrity.missing_ranges(h.blocks.where("block_num % 7 > 1"))),
    "slice_overlap_gap": _on(lambda h: integrity.slice_overlaps(_broken(h)).withColumn("kind", F.lit("overlap")).union(integrity.slice_gaps(h.blocks.where("slice_num % 3 <> 1")).withColumn("kind", F.lit("gap")))),
    "action_position": _on(_ordered),
    "asof_last": _on(lambda h: asof.asof(_account(h).select("contract", "block_num", "global_seq"), h.abis, "contract", "block_num", "ord", "cleared").select("contract", "global_seq", "cleared")),
    "top_affected_slices": _on(lambda h: integrity.top_affected(h.blocks.where("block_num % 7 > 1"))),
    # pages
    "last_n": _paged(lambda h: _seqs(paging.page(_account(h), 20))),
    "first_n": _paged(lambda h: _seqs(paging.page(_account(h), 20, False))),
    "last_n_contract_action": _paged(lambda h: _seqs(paging.page(_account(h, CONTRACT, ACTION, CONTRACT), 20))),
    "first_n_contract_action": _paged(lambda h: _seqs(paging.page(_account(h, CONTRACT, ACTION, CONTRACT), 20, False))),
    "last_n_contract": _paged(lambda h: _seqs(paging.page(_account(h, CONTRACT, account=CONTRACT), 20))),
    "first_n_contract": _paged(lambda h: _seqs(paging.page(_account(h, CONTRACT, account=CONTRACT), 20, False))),
    "position_range": _paged(lambda h: _seqs(paging.positions(_account(h), 5, 10))),
    "cursor_page_all": _paged(lambda h: _seqs(paging.page(_account(h), 10, True, CURSOR, SEQ_LO, SEQ_HI))),
    "cursor_page_contract_action": _paged(lambda h: _seqs(paging.page(_account(h, CONTRACT, ACTION, CONTRACT), 10, False, CURSOR))),
    "cursor_page_contract": _paged(lambda h: _seqs(paging.page(_account(h, CONTRACT, account=CONTRACT), 10, True, CURSOR))),
    "seq_range_page": _paged(lambda h: _seqs(paging.page(_account(h), 10, False, None, SEQ_LO, SEQ_HI))),
    "seq_range_page_contract_action": _paged(lambda h: _seqs(paging.page(_account(h, CONTRACT, ACTION, CONTRACT), 10, True, None, SEQ_LO, SEQ_HI))),
    "seq_range_page_contract": _paged(lambda h: _seqs(paging.page(_account(h, CONTRACT, account=CONTRACT), 10, False, None, SEQ_LO, SEQ_HI))),
    "activity_page": _activity,
    "get_actions_pos_offset": _truth_table,
    "cursor_codec": _cursor,
    "has_prev": _paged(_has_prev),
    "multi_key_sort": _on(lambda h: h.account_actions.where("account in ('ub', 'uc')").select("contract", "action", "global_seq", "account").orderBy("contract", F.desc("action"), "global_seq", "account").limit(200)),
    "order_by_seq": _on(lambda h: h.actions.where(F.col("trx_id").isin(_probe_trx(h))).orderBy("global_seq").select("trx_id", "global_seq")),
    # sets
    "merge_dedupe": _on(lambda h: sets.merge_dedupe(_account(h), _account(h, CONTRACT, account=CONTRACT))),
    "multi_account_merge": _on(lambda h: _seqs(h.account_actions.where(F.col("account").isin(ACCOUNT, OTHER))).distinct()),
    "remove_compacted": _on(lambda h: sets.remove_compacted(_split(h)[1], _split(h)[0])),
    "notified_distinct": _on(lambda h: canonical.notified(h.actions).groupBy("global_seq").agg(F.count("*").alias("n"))),
    "missing_seqs": _on(lambda h: _seqs(canonical.notified(h.actions).where("account = 'ub'")).exceptAll(_seqs(_account(h)))),
    # scalar functions
    "name_canonical": _f(lambda: [names.canonical(_raw_name()).alias("name")]),
    "name_to_u64": _f(lambda: [names.to_u64(F.col("event_type")).cast("string").alias("value"), names.from_u64(names.to_u64(F.col("event_type"))).alias("name")]),
    "symbol_code": _f(lambda: [assets.symbol_value(F.upper("event_type"), F.lit(4)).alias("symbol"), assets.symbol_code(F.floor(assets.symbol_value(F.upper("event_type"), F.lit(4)) / 256)).alias("code")]),
    "asset_format": _f(lambda: [assets.asset_format(F.col("quantity") - 500_000, (F.col("event_id") % 5).cast("int"), F.lit("TOK")).alias("asset")]),
    "asset_parse": lambda s, d: _lines(s, d).select("event_id", assets.asset_parse(assets.asset_format(F.col("quantity") - 500_000, (F.col("event_id") % 5).cast("int"), F.lit("TOK"))).alias("p")).select("event_id", "p.amount", F.col("p.precision").cast("long").alias("precision"), "p.code"),
    "slot_to_time": _f(lambda: [timeslots.slot_to_time(_slot()).alias("time")]),
    "time_to_slot": _f(lambda: [timeslots.time_to_slot(F.concat(timeslots.slot_to_time(_slot()), F.lit("Z"))).alias("slot")]),
    "slot_to_hour": _f(lambda: [timeslots.slot_to_hour(_slot()).alias("hour")]),
    "parse_date": _f(lambda: [timeslots.date_to_hour(_date()).alias("first_hour"), timeslots.date_to_hour(_date(), True).alias("last_hour")]),
    "datehour_codec": _f(lambda: [timeslots.datehour_pack(timeslots.slot_to_hour(_slot())).alias("packed"), timeslots.datehour_unpack(timeslots.datehour_pack(timeslots.slot_to_hour(_slot()))).alias("hour")]),
    "hour_to_date": _f(lambda: [timeslots.hour_to_date(timeslots.slot_to_hour(_slot())).alias("date")]),
    "action_bytes": _action_bytes(False),
    "action_digest": _action_bytes(True),
    "varint_codec": _varint,
    "parse_setabi": _setabi,
    "abi_decode": _decode,
    "remove_nulls": _json(codecs.remove_nulls),
    "json_safe_ints": _json(codecs.json_safe_ints),
    "trx_status_name": _f(lambda: [codecs.status_name(F.col("event_id") % 7).alias("status")]),
    "expiration_to_string": _f(lambda: [codecs.expiration(F.col("event_id") * 99_991).alias("expires")]),
    "trx_prefix": _on(lambda h: h.transactions.select("trx_id", codecs.trx_prefix(F.col("trx_id")).alias("p")).select("trx_id", "p.*")),
    "hex_codec": _f(lambda: [F.lower(F.hex(F.col("event_type").cast("binary"))).alias("hexed"), F.unhex(F.hex(F.col("event_type").cast("binary"))).cast("string").alias("back")]),
    "block_to_slice": _f(lambda: [codecs.block_to_slice(F.col("event_id") * 977).alias("slice")]),
    "slice_dir_name": _f(lambda: [codecs.slice_name(codecs.block_to_slice(F.col("event_id") * 977)).alias("name")]),
    "query_fingerprint": _f(lambda: [codecs.fingerprint_column(F.lit(ACCOUNT), F.col("event_type"), F.lit(""), F.lit(""), F.lit(""), F.lit("")).alias("print")]),
    "family_key": _on(lambda h: canonical.roots(h.actions).select("global_seq", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in canonical.FAMILY)), 256).alias("family"))),
    "flex_int": _f(lambda: [codecs.flex_int(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"'))).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise("x1")).alias("n")]),
    "human_format": _f(lambda: [codecs.human(F.col("event_id") * 12_500).alias("shown")]),
    "ram_delta_explode": _on(lambda h: h.actions.select("global_seq", F.explode(F.transform("auths", lambda a: F.struct(a.alias("account"), F.col("quantity").alias("delta")))).alias("d")).select("global_seq", "d.*")),
    "chunk_codec": _on(_chunk_codec),
    "packed_transaction": _on(_packed),
    "signature_text": lambda s, d: _lines(s, d).select("event_id", codecs.signature_text(F.concat(codecs.little(F.col("event_id") % 4, 1), F.unhex(F.sha2(F.col("event_id").cast("string"), 256)))).alias("signature")),
    "zstd_codec": lambda s, d: _lines(s, d).select("event_id", F.when(F.col("event_id") % 2 == 0, codecs.compress(F.col("event_type").cast("binary"))).otherwise(F.col("event_type").cast("binary")).alias("raw")).select("event_id", codecs.decompress("raw").cast("string").alias("text")),
    "record_checksums": lambda s, d: _lines(s, d).select("event_id", codecs.checksums(F.col("event_type").cast("binary")).alias("c")).select("event_id", "c.*"),
    # streams
    "sync_mode": _on(lambda h: h.blocks.crossJoin(F.broadcast(store.state(h.blocks))).select("block_num", jobs.sync_mode(F.col("block_num"), F.col("lib")).alias("mode"))),  # state: one row
    "stream_sync": _sync,
    "stream_trx_ids": _stream_ids,
    "stream_process": _stream_process,
    "stream_catchup_contract_action": _on(lambda h: jobs.catch_up(h.actions, [CONTRACT], [ACTION, "view"])),
    "stream_catchup_single": _on(lambda h: jobs.catch_up(h.actions, receivers=[ACCOUNT], start=200)),
    "stream_catchup_multi": _on(lambda h: jobs.catch_up(h.actions, receivers=[ACCOUNT, OTHER])),
    "stream_live": _stream_live,
    "stream_index_maintain": _stream_index,
    "stream_hour_map": _stream_hours,
    "stream_trx_index": _stream_trx,
    "stream_decode": _stream_decode,
    # integrity
    "v_block_out_of_range": _on(lambda h: integrity.out_of_range(_broken(h), SLICE_BLOCKS).select("slice_num", "block_num")),
    "v_duplicate_block": _on(lambda h: integrity.issue(integrity.duplicate_blocks(_broken(h)), integrity.ERROR, "DUPLICATE_BLOCK")),
    "v_missing_block": _on(lambda h: integrity.issue(integrity.missing_blocks(h.blocks), integrity.ERROR, "MISSING_BLOCK")),
    "v_missing_onblock": _on(lambda h: integrity.missing_action(h.blocks, h.actions, CONTRACT, ACTION).select("slice_num", "block_num")),
    "v_slice_overlap": _on(lambda h: integrity.slice_overlaps(_broken(h))),
    "v_slice_gap": _on(lambda h: integrity.slice_gaps(h.blocks.where("slice_num % 3 <> 1"))),
    "v_report": _on(lambda h: integrity.verdict(_issues(h))),
    "v_continuity": _on(lambda h: integrity.continuity(h.blocks)),
    "v_completeness": _on(lambda h: integrity.completeness(h.blocks, SLICE_BLOCKS)),
    "v_missing_file": _on(lambda h: integrity.missing_files(h.blocks.select("slice_num").distinct(), h.blocks.where("slice_num % 3 <> 1"))),
    "v_empty_index": _on(lambda h: integrity.empty_slices(h.blocks.select("slice_num").distinct(), h.blocks.where("slice_num % 4 <> 2"))),
    "v_modes": _on(_modes),
    "v_ingest_invariants": _on(lambda h: integrity.ingest_violations(_receipts(h))),
    "slice_digests": _on(lambda h: store.digests(h.actions)),
    "v_missing_patterns": _on(lambda h: integrity.missing_ranges(h.blocks.where("block_num % 7 > 1")).groupBy("slice_num").agg(F.count("*").alias("ranges"), F.sum("n").alias("missing"), F.max("n").alias("longest"))),
}
