"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

import zlib

from .queries import ACCOUNT, ACTION, BLOCK, CONTRACT, CURSOR, FIRST, HOUR_HI, HOUR_LO, LAST, OTHER, SEQ_HI, SEQ_LO, SEQS

_HISTORY = """
base AS (
  SELECT event_id + 1 AS global_seq, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, event_type,
    CAST(round(value * 10000) AS BIGINT) AS quantity FROM events),
placed AS (
  SELECT *, 2 + (s - 1704067200) // 1800 AS block_num, 'u' || translate(CAST(user_id AS VARCHAR), '0123456789', 'abcdefghij') AS own,
    'c' || translate(CAST(k % 10 AS VARCHAR), '0123456789', 'abcdefghij') AS own_contract FROM base),
numbered AS (SELECT *, row_number() OVER (PARTITION BY block_num ORDER BY global_seq) - 1 AS pos FROM placed),
trx AS (SELECT *, pos // 4 AS trx_index, pos % 4 + 1 AS action_ordinal FROM numbered),
headed AS (
  SELECT *, first_value(own) OVER w AS sender, first_value(own_contract) OVER w AS c0, first_value(event_type) OVER w AS a0, first_value(k % 3) OVER w AS d0
  FROM trx WINDOW w AS (PARTITION BY block_num, trx_index ORDER BY global_seq)),
actions AS (
  SELECT (block_num - 1) // 100 AS slice_num, block_num, s, s // 3600 AS hour, trx_index, sha256(block_num || ':' || trx_index) AS trx_id, global_seq, action_ordinal,
    CASE WHEN action_ordinal = 4 THEN 0 ELSE action_ordinal - 1 END AS creator_ordinal,
    CASE action_ordinal WHEN 1 THEN c0 WHEN 2 THEN sender WHEN 3 THEN own ELSE own_contract END AS receiver,
    CASE WHEN action_ordinal <= 3 THEN c0 ELSE own_contract END AS contract,
    CASE WHEN action_ordinal <= 3 THEN a0 ELSE event_type END AS action,
    CASE WHEN (global_seq - 1) % 5 = 0 AND own <> sender THEN [sender, own] ELSE [sender] END AS auths,
    CASE WHEN action_ordinal <= 3 THEN d0 ELSE k % 3 END AS data_index, quantity
  FROM headed),
blocks AS (SELECT slice_num, block_num, min(global_seq) AS glob_min, max(global_seq) AS glob_max, count(*) AS n_actions FROM actions GROUP BY ALL),
transactions AS (SELECT DISTINCT slice_num, block_num, trx_index, trx_id FROM actions),
tree AS (
  SELECT block_num, trx_index, action_ordinal, action_ordinal AS root FROM actions WHERE creator_ordinal = 0
  UNION ALL
  SELECT a.block_num, a.trx_index, a.action_ordinal, tree.root FROM actions a
  JOIN tree ON a.block_num = tree.block_num AND a.trx_index = tree.trx_index AND a.creator_ordinal = tree.action_ordinal),
rooted AS (SELECT a.*, tree.root FROM actions a JOIN tree USING (block_num, trx_index, action_ordinal)),
told AS (
  SELECT DISTINCT x.*, account, account = receiver AS is_recv, list_contains(auths, account) AS is_auth
  FROM rooted x, unnest(list_concat([receiver], auths)) AS t(account)),
account_actions AS (
  SELECT account, contract, action, global_seq, block_num, hour, trx_index, is_auth FROM told t
  WHERE is_recv OR (is_auth AND NOT EXISTS (SELECT 1 FROM rooted r WHERE r.block_num = t.block_num AND r.trx_index = t.trx_index AND r.root = t.root
    AND r.data_index = t.data_index AND r.contract = t.contract AND r.action = t.action AND r.receiver = t.account))),
hour_map AS (SELECT hour, min(global_seq) AS min_seq, max(global_seq) AS max_seq FROM actions GROUP BY hour),
abis AS (SELECT own_contract AS contract, block_num, global_seq AS ord, k % 11 = 0 AS cleared FROM placed WHERE event_type = 'signup'),
state AS (
  SELECT a.contract, a.block_num, a.global_seq, a.quantity, arg_max(l.ord, l.ord) AS ord, arg_max(l.cleared, l.ord) AS cleared
  FROM actions a LEFT JOIN abis l ON l.contract = a.contract AND l.block_num <= a.block_num GROUP BY ALL),
broken AS (
  SELECT * FROM blocks UNION ALL SELECT * FROM blocks WHERE block_num % 50 = 7
  UNION ALL SELECT slice_num - 1, block_num, glob_min, glob_max, n_actions FROM blocks WHERE block_num % 100 = 1 AND slice_num > 0),
thin AS (SELECT * FROM blocks WHERE block_num % 7 > 1),
thin_gaps AS (
  SELECT slice_num, prev + 1 AS first_missing, block_num - 1 AS last_missing FROM (
    SELECT *, lag(block_num) OVER (PARTITION BY slice_num ORDER BY block_num) AS prev FROM thin) WHERE block_num > prev + 1),
gaps AS (
  SELECT slice_num, prev + 1 AS first_missing, block_num - 1 AS last_missing FROM (
    SELECT *, lag(block_num) OVER (PARTITION BY slice_num ORDER BY block_num) AS prev FROM blocks) WHERE block_num > prev + 1),
no_action AS (
  SELECT slice_num, block_num FROM blocks b WHERE block_num > 2
  AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.block_num = b.block_num AND a.contract = 'cd' AND a.action = 'click')),
edges AS (SELECT slice_num, min(block_num) AS min_block, max(block_num) AS max_block, count(DISTINCT block_num) AS n FROM blocks GROUP BY slice_num),
found AS (
  SELECT slice_num, 'ERROR' AS severity, 'MISSING_BLOCK' AS kind FROM gaps, unnest(range(first_missing, last_missing + 1))
  UNION ALL SELECT slice_num, 'ERROR', 'MISSING_ONBLOCK' FROM no_action
  UNION ALL SELECT slice_num, 'WARNING', 'SLICE_GAP' FROM (SELECT *, lag(max_block) OVER (ORDER BY slice_num) AS p FROM edges) WHERE min_block > p + 1),
broken_edges AS (
  SELECT *, lag(max_block) OVER (ORDER BY slice_num) AS prev_max_block FROM (
    SELECT slice_num, min(block_num) AS min_block, max(block_num) AS max_block FROM broken GROUP BY slice_num)),
third_edges AS (SELECT slice_num, min_block, lag(max_block) OVER (ORDER BY slice_num) AS prev_max_block FROM edges WHERE slice_num % 3 <> 1)
"""

_PAGE = "SELECT global_seq FROM account_actions WHERE {where} ORDER BY global_seq {order} LIMIT {n}"
_OWN = f"account = '{ACCOUNT}'"
_OF_CONTRACT = f"account = '{CONTRACT}' AND contract = '{CONTRACT}'"
_OF_ACTION = f"{_OF_CONTRACT} AND action = '{ACTION}'"
_RANGE = f"global_seq BETWEEN {SEQ_LO} AND {SEQ_HI}"
_IGNORED = "(contract IN ('ca', 'cb') OR action = 'error' OR (contract = 'cd' AND action = 'view'))"
_TRX = "(sha256('20:0'), sha256('33:0'), sha256('35:0'), sha256('5:9'))"
_SLOT = "(event_id * 7919 + 1500000000)"
_HOUR = f"({_SLOT} // 7200 + 262968)"
_QUANTITY = "CAST(round(value * 10000) AS BIGINT)"
_AMOUNT = f"({_QUANTITY} - 500000)"
_PLACES = "CAST(event_id % 5 AS INTEGER)"
_DIGITS = f"lpad(CAST(abs({_AMOUNT}) AS VARCHAR), CAST(greatest(length(CAST(abs({_AMOUNT}) AS VARCHAR)), {_PLACES} + 1) AS INTEGER), '0')"
_ASSET = f"CASE WHEN {_AMOUNT} < 0 THEN '-' ELSE '' END || substr({_DIGITS}, 1, length({_DIGITS}) - {_PLACES}) || CASE WHEN {_PLACES} > 0 THEN '.' || right({_DIGITS}, {_PLACES}) ELSE '' END || ' TOK'"
_PRINT = f"to_base64(unhex(substr(sha256('{ACCOUNT}|' || event_type || '||||'), 1, 16)))"
_DAY = "CAST(epoch(make_date(2024, CAST(event_id % 9 + 1 AS BIGINT), 1)) AS BIGINT) // 86400 + event_id % 31"
_PUSHED = "global_seq, block_num, receiver, contract, action"


def _pos_offset() -> str:
    rows = f"SELECT global_seq, row_number() OVER (ORDER BY global_seq) AS p, count(*) OVER () AS t FROM account_actions WHERE {_OWN}"
    parts = []
    for pos, off in ((-1, -20), (-5, 0), (0, 5), (3, 4), (7, -3), (10_000, 2), (10_000, -2)):
        size, at = max(1, abs(off)), f"least(greatest({pos}, 1), t)"
        where = f"p > t - {size}" if pos < 0 else f"p > {at} - {size} AND p <= {at}" if off < 0 else f"p >= {at} AND p < {at} + {size}"
        parts.append(f"SELECT {pos} AS pos, {off} AS off, row_number() OVER (ORDER BY p {'DESC' if pos < 0 else ''}) AS n, global_seq FROM ({rows}) WHERE {where}")
    return " UNION ALL ".join(parts)


def _abi(version: str) -> str:
    """The JSON of the ABI that the queries' setabi actions hold."""
    head = '{"abi_extensions":[],"actions":[{"name":"click","ricardian_contract":"","type":"put"},{"name":"view","ricardian_contract":"","type":"put"}],"error_messages":[],"ricardian_clauses":[],'
    body = '"structs":[{"base":"","fields":[{"name":"q","type":"uint64"}],"name":"put"}],"tables":[],"types":[],"version":"'
    return f"'{head}{body}' || {version} || '\"}}'"


def _little(number: str, size: int) -> str:
    """Hex of a number's low bytes in little-endian order."""
    return "(" + " || ".join(f"substr(printf('%016x', {number}), {15 - 2 * k}, 2)" for k in range(size)) + ")"


def _name(name: str) -> str:
    """Hex of a name's value in little-endian order."""
    value = f"(SELECT sum((instr('.12345abcdefghijklmnopqrstuvwxyz', substr({name}, i, 1)) - 1)::HUGEINT * (1::HUGEINT << CAST(4 + 5 * (12 - i) AS INTEGER))) FROM unnest(range(1, length({name}) + 1)) AS t(i))"
    return "(SELECT " + " || ".join(f"printf('%02x', CAST((v // {256**k}::HUGEINT) % 256 AS INTEGER))" for k in range(8)) + f" FROM (SELECT {value} AS v))"


_RAW = f"{_name("'click'")} || {_name('event_type')} || '01' || {_name("'view'")} || {_name("'error'")} || printf('%02x', length(CAST({_QUANTITY} AS VARCHAR))) || lower(hex(CAST({_QUANTITY} AS VARCHAR)))"
_ACTION = f"{_name('contract')} || {_name('action')} || '01' || {_name('receiver')} || {_name("'active'")} || '08' || {_little('quantity', 8)}"
_ZIGZAG = "CASE WHEN event_id >= 300 THEN (event_id - 300) * 2 ELSE (300 - event_id) * 2 - 1 END"
_LEAD = "lead AS (SELECT DISTINCT slice_num FROM thin ORDER BY slice_num LIMIT 2), own AS (SELECT thin.* FROM thin JOIN lead USING (slice_num))"
_MODES = f"""{_LEAD},
steps AS (SELECT *, lag(block_num) OVER w AS prev, lag(glob_max) OVER w AS prev_max FROM own WINDOW w AS (PARTITION BY slice_num ORDER BY block_num)),
bounds AS (SELECT slice_num, min_block, lag(max_block) OVER (ORDER BY slice_num) AS p FROM (SELECT slice_num, min(block_num) AS min_block, max(block_num) AS max_block FROM own GROUP BY slice_num)),
every AS (SELECT unnest(['FAST', 'FULL', 'ONBLOCK']) AS mode),
hits AS (
  SELECT mode, 'MISSING_BLOCK' AS kind, CAST(block_num - prev - 1 AS BIGINT) AS n FROM steps, every WHERE block_num > prev + 1
  UNION ALL SELECT mode, 'SLICE_GAP', 1 FROM bounds, every WHERE min_block > p + 1
  UNION ALL SELECT 'FULL', 'SEQUENCE_GAP', 1 FROM steps WHERE glob_min <> prev_max + 1
  UNION ALL SELECT 'ONBLOCK', 'MISSING_ONBLOCK', 1 FROM own WHERE block_num IN (SELECT block_num FROM no_action))
SELECT mode, kind, CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY ALL"""
_CRCS = " ".join(f"WHEN '{x}' THEN {zlib.crc32(x.encode())}::BIGINT" for x in ("click", "error", "purchase", "signup", "view"))
_RECORD = "sha256(global_seq || '|' || receiver || '|' || contract || '|' || action)"


def _on(sql: str) -> str:
    if sql.startswith("lead AS"):
        return f"WITH RECURSIVE {_HISTORY.rstrip()},\n{sql}"

    return f"WITH RECURSIVE {_HISTORY}\n{sql}"


_ON_HISTORY: dict[str, str] = {
    "log_page": f"SELECT global_seq, block_num, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS block_time, contract, action, trx_id FROM actions WHERE global_seq IN ({_PAGE.format(where=_OWN, order='DESC', n=20)})",
    "scan_blocks": f"SELECT block_num, glob_min, glob_max, n_actions FROM blocks WHERE block_num = {BLOCK}",
    "scan_block_range": f"SELECT block_num, global_seq, contract, action FROM actions WHERE block_num BETWEEN {FIRST} AND {LAST} AND NOT {_IGNORED}",
    "scan_raw_actions_in_block": f"SELECT global_seq, trx_id, receiver, contract, action, array_to_string(auths, ',') AS auths FROM actions WHERE block_num = {BLOCK}",
    "notified_in_block": f"SELECT global_seq, receiver AS notified FROM actions WHERE block_num = {BLOCK}",
    "raw_actions_filtered": f"SELECT block_num, global_seq FROM actions WHERE block_num BETWEEN {FIRST} AND {LAST} AND contract = '{CONTRACT}' AND action = '{ACTION}'",
    "scan_slice": "SELECT block_num, global_seq FROM actions WHERE slice_num = 3",
    "store_append": "SELECT slice_num, block_num, glob_min, glob_max FROM blocks",
    "store_finalise": f"""SELECT e.slice_num, e.n AS found, d.digest FROM edges e JOIN (
      SELECT slice_num, sha256(string_agg(d, '' ORDER BY block_num)) AS digest FROM (SELECT slice_num, block_num, sha256(string_agg({_RECORD}, '' ORDER BY global_seq)) AS d FROM actions GROUP BY ALL) GROUP BY slice_num) d USING (slice_num)
      WHERE e.n = CASE WHEN e.slice_num = 0 AND e.min_block = 2 THEN 99 ELSE 100 END""",
    "store_cut": "SELECT block_num, global_seq FROM actions WHERE block_num <= 750",
    "slice_cache": "SELECT slice_num, min(block_num) AS min_block, max(block_num) AS max_block, min(global_seq) AS glob_min, max(global_seq) AS glob_max, count(*) AS n_actions FROM actions GROUP BY slice_num",
    "multi_key_sort": "SELECT contract, action, global_seq, account FROM account_actions WHERE account IN ('ub', 'uc') ORDER BY contract, action DESC, global_seq, account LIMIT 200",
    "stream_process": "SELECT receiver, count(*) AS n FROM actions GROUP BY receiver",
    "trx_ids_in_block": f"SELECT trx_index, trx_id FROM transactions WHERE block_num = {BLOCK}",
    "abi_rebuild": f"SELECT contract, block_num, ord, {_abi("'v' || ord")} AS abi_json FROM abis WHERE NOT cleared",
    "abi_log_sink": "SELECT contract, block_num, ord FROM abis WHERE NOT cleared",
    "could_match": "SELECT global_seq FROM actions WHERE (contract = 'cd' AND receiver = contract) OR (action = 'click' AND receiver = 'ub') OR (contract = 'ca' AND action = 'view' AND receiver IN ('uc', 'ca'))",
    "chunk_codec": f"SELECT account, p AS chunk, string_agg(CAST(global_seq AS VARCHAR), ',' ORDER BY global_seq) AS seqs, string_agg(CAST(global_seq AS VARCHAR), ',' ORDER BY global_seq) AS lean_seqs, {_little('min(global_seq)', 8)} || {_little('count(*)', 4)} AS head FROM (SELECT *, (row_number() OVER (PARTITION BY account ORDER BY global_seq) - 1) // 10000 AS p FROM account_actions) GROUP BY account, p",
    "packed_transaction": f"""SELECT trx_id, {_little('block_num + 1700000000', 4)} || {_little('block_num % 65536', 2)} || {_little('block_num * 3', 4)} || '00000000' || printf('%02x', count(*)) || string_agg(raw, '' ORDER BY global_seq) || '00' AS packed
      FROM (SELECT trx_id, block_num, global_seq, {_ACTION} AS raw FROM actions WHERE creator_ordinal = 0) GROUP BY trx_id, block_num""",
    "sync_mode": "SELECT block_num, CASE WHEN block_num + 1000 < (SELECT max(block_num) FROM blocks) THEN 'bulk' ELSE 'live' END AS mode FROM blocks",
    "stream_sync": "SELECT contract, count(*) AS n FROM actions GROUP BY contract",
    "stream_trx_ids": "SELECT block_num, trx_index, trx_id FROM transactions",
    "v_missing_file": "SELECT DISTINCT slice_num, 'ERROR' AS severity, 'MISSING_FILE' AS kind FROM blocks WHERE slice_num % 3 = 1",
    "v_empty_index": "SELECT DISTINCT slice_num, 'WARNING' AS severity, 'EMPTY_INDEX' AS kind FROM blocks WHERE slice_num % 4 = 2",
    "v_modes": _MODES,
    "v_ingest_invariants": "SELECT global_seq, CASE WHEN global_seq % 97 = 0 THEN 'RECEIPT_RECEIVER' ELSE 'AUTH_COUNT' END AS rule FROM actions WHERE global_seq % 97 = 0 OR (global_seq % 89 = 0 AND len(auths) <> 1)",
    "slice_digests": f"SELECT slice_num, sha256(string_agg(d, '' ORDER BY block_num)) AS digest FROM (SELECT slice_num, block_num, sha256(string_agg({_RECORD}, '' ORDER BY global_seq)) AS d FROM actions GROUP BY ALL) GROUP BY slice_num",
    "state_props": "SELECT max(block_num) AS head, max(block_num) AS lib FROM blocks",
    "first_available_block": "SELECT min(block_num) AS block_num FROM blocks WHERE block_num >= 7",
    "notifications_in_block": f"SELECT account, string_agg(CAST(global_seq AS VARCHAR), ',' ORDER BY global_seq) AS seqs FROM (SELECT DISTINCT account, global_seq FROM told WHERE block_num = {BLOCK}) GROUP BY account",
    "filter_ignored_actions": f"SELECT global_seq FROM actions WHERE NOT {_IGNORED}",
    "filter_ignored_for_account": "SELECT account, global_seq FROM account_actions WHERE NOT (contract = 'ca' OR (account = 'ub' AND contract = 'cd' AND action = 'click') OR account = 'uc' OR (account = 'ud' AND action = 'view'))",
    "filter_include_contracts": "SELECT global_seq FROM actions WHERE contract IN ('ca', 'cd')",
    "filter_combined": f"SELECT global_seq FROM actions WHERE NOT {_IGNORED} AND contract IN ('cb', 'cd', 'ce')",
    "filter_stream": f"SELECT global_seq FROM actions WHERE contract = '{CONTRACT}' AND action IN ('{ACTION}', 'view') AND receiver IN ('{ACCOUNT}', '{CONTRACT}')",
    "executions": "SELECT global_seq FROM actions WHERE receiver = contract",
    "filter_seq_range": f"SELECT global_seq FROM actions WHERE {_RANGE}",
    "filter_date": "SELECT global_seq FROM actions WHERE s >= 1704412800 AND s < 1704499200",
    "filter_date_range": "SELECT global_seq FROM actions WHERE s >= 1704240000 + 5 * 3600 AND s < 1704844800",
    "project_log": "SELECT global_seq, block_num, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS block_time, contract, action, trx_id FROM actions",
    "project_activity": "SELECT global_seq, receiver, array_to_string(auths, ',') AS auths, creator_ordinal, true AS irreversible, 0::BIGINT AS account_action_seq FROM actions",
    "search_account_in_block": f"SELECT * FROM (SELECT global_seq, receiver = 'cd' AS is_receiver, contract = 'cd' AS is_contract, list_contains(auths, 'cd') AS is_authorizer FROM actions WHERE block_num = {BLOCK}) WHERE is_receiver OR is_contract OR is_authorizer",
    "root_actions": "SELECT global_seq FROM actions WHERE creator_ordinal = 0",
    "fetch_by_seq": f"SELECT r.pos, r.global_seq, a.block_num, a.contract, a.action FROM (SELECT unnest({list(SEQS)})::BIGINT AS global_seq, unnest(range({len(SEQS)})) AS pos) r LEFT JOIN actions a USING (global_seq)",
    "seq_to_block": f"SELECT DISTINCT r.seq, b.block_num FROM (SELECT unnest({list(SEQS)})::BIGINT AS seq) r JOIN blocks b ON r.seq BETWEEN b.glob_min AND b.glob_max",
    "dictionary_resolve": "SELECT block_num, global_seq, receiver, dense_rank() OVER (PARTITION BY block_num ORDER BY receiver) - 1 AS name_index FROM actions",
    "notify_explode": "SELECT account, global_seq, is_recv, is_auth FROM told",
    "canonical_actions": "SELECT * FROM account_actions",
    "action_tree_root": "SELECT global_seq, action_ordinal, root FROM rooted",
    "abi_asof": "SELECT global_seq, CASE WHEN NOT cleared THEN ord END AS abi_ord, CASE WHEN ord IS NULL THEN 'none' WHEN cleared THEN 'cleared' ELSE 'set' END AS abi_state FROM state",
    "trx_lookup": "SELECT substr(trx_id, 1, 4) AS trx_prefix, trx_id, block_num FROM transactions WHERE trx_id = sha256('20:0')",
    "trx_with_actions": f"SELECT trx_id, block_num, string_agg(global_seq || ':' || receiver || ':' || contract || ':' || action, ';' ORDER BY global_seq) AS actions FROM actions WHERE trx_id IN {_TRX} GROUP BY trx_id, block_num",
    "trx_status": f"SELECT trx_id, block_num, 'IRREVERSIBLE' AS state, (SELECT max(block_num) FROM blocks) AS head FROM transactions WHERE trx_id IN {_TRX}",
    "delta_read": "SELECT account, global_seq FROM account_actions",
    "filter_discrepancy": f"SELECT account, global_seq FROM told WHERE {_OWN} EXCEPT SELECT account, global_seq FROM account_actions",
    "multi_action_merge": f"SELECT global_seq FROM account_actions WHERE {_OF_CONTRACT} AND action IN ('{ACTION}', 'view')",
    "account_total": "SELECT account, count(*) AS total FROM account_actions GROUP BY account",
    "account_stats": "SELECT account, count(*) AS total, min(global_seq) AS first_seq, max(global_seq) AS last_seq, min(hour) AS first_hour, max(hour) AS last_hour FROM account_actions GROUP BY account",
    "block_seq_minmax": "SELECT block_num, min(global_seq) AS min_seq, max(global_seq) AS max_seq FROM account_actions GROUP BY block_num",
    "hour_map": "SELECT * FROM hour_map",
    "hour_range": "SELECT min(hour) AS min_hour, max(hour) AS max_hour, count(*) AS hours, max(max_seq) AS max_seq FROM hour_map",
    "seq_range_for_hours": f"SELECT coalesce(min(min_seq), 0) AS min_seq, coalesce(max(max_seq), 0) AS max_seq FROM hour_map WHERE hour BETWEEN {HOUR_LO} AND {HOUR_HI}",
    "seq_to_hour": f"SELECT a.global_seq, min(h.hour) AS hour FROM account_actions a LEFT JOIN hour_map h ON a.global_seq BETWEEN h.min_seq AND h.max_seq WHERE {_OWN} GROUP BY a.global_seq",
    "actions_per_account_in_block": f"SELECT account, count(*) AS n FROM account_actions WHERE block_num = {BLOCK} GROUP BY account",
    "block_summary": "SELECT b.block_num, b.n_actions, t.accounts, b.glob_min AS min_seq, b.glob_max AS max_seq, (SELECT string_agg(CAST(global_seq AS VARCHAR), ',' ORDER BY global_seq) FROM (SELECT global_seq, row_number() OVER (ORDER BY global_seq) AS p FROM actions a WHERE a.block_num = b.block_num) WHERE b.n_actions <= 50 OR p <= 5 OR p > b.n_actions - 5) AS shown FROM blocks b JOIN (SELECT block_num, count(DISTINCT account) AS accounts FROM told GROUP BY block_num) t USING (block_num)",
    "index_postings": "SELECT account, contract, p AS chunk, min(global_seq) AS base, count(*) AS n, string_agg(CAST(global_seq AS VARCHAR), ',' ORDER BY global_seq) AS seqs FROM (SELECT *, (row_number() OVER (PARTITION BY account, contract ORDER BY global_seq) - 1) // 10000 AS p FROM account_actions) GROUP BY account, contract, p",
    "chunked_postings": "SELECT account, p AS chunk, min(global_seq) AS base, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY account ORDER BY global_seq) - 1) // 10000 AS p FROM account_actions) GROUP BY account, p",
    "chunk_metadata": "SELECT account, count(*) AS chunks, min(base) AS first_base, max(base) AS last_base FROM (SELECT account, p, min(global_seq) AS base FROM (SELECT *, (row_number() OVER (PARTITION BY account ORDER BY global_seq) - 1) // 10000 AS p FROM account_actions) GROUP BY account, p) GROUP BY account",
    "slice_stats": "SELECT slice_num, count(*) AS blocks, CAST(sum(n_actions) AS BIGINT) AS actions, min(n_actions) AS min_actions, max(n_actions) AS max_actions, first(block_num ORDER BY n_actions, block_num) AS min_block, first(block_num ORDER BY n_actions DESC, block_num) AS max_block FROM blocks GROUP BY slice_num",
    "glob_total": "SELECT CAST(coalesce(sum(glob_max - glob_min + 1), 0) AS BIGINT) AS total FROM blocks",
    "trx_index_partitions": "SELECT substr(trx_id, 1, 4) AS trx_prefix, count(*) AS entries, min(block_num) AS min_block, max(block_num) AS max_block FROM transactions GROUP BY 1",
    "validation_summary": "SELECT severity, kind, count(*) AS n, count(DISTINCT slice_num) AS slices FROM found GROUP BY ALL",
    "ingest_stats": "SELECT count(*) AS actions, count(DISTINCT trx_id) AS transactions, CAST(sum(length(action)) AS BIGINT) AS bytes, max(global_seq) AS max_seq FROM actions",
    "wal_status": "SELECT count(*) AS rows, min(global_seq) AS min_seq, max(global_seq) AS max_seq FROM account_actions WHERE global_seq > 550",
    "slice_compare": "SELECT round(a.b::DOUBLE / b.b, 6) AS block_ratio, round(a.a::DOUBLE / b.a, 6) AS action_ratio, round((a.a::DOUBLE / a.b) / (b.a::DOUBLE / b.b), 6) AS density_ratio FROM (SELECT count(*) AS b, sum(n_actions) AS a FROM blocks WHERE slice_num = 0) a, (SELECT count(*) AS b, sum(n_actions) AS a FROM blocks WHERE slice_num = 1) b",
    "block_gaps": "SELECT * FROM gaps",
    "glob_gaps": "SELECT slice_num, block_num, glob_min, prev_max FROM (SELECT *, lag(glob_max) OVER (PARTITION BY slice_num ORDER BY block_num) AS prev_max FROM blocks WHERE block_num % 5 <> 0) WHERE glob_min <> prev_max + 1",
    "duplicate_blocks": "SELECT slice_num, block_num, count(*) AS n FROM broken GROUP BY ALL HAVING count(*) > 1",
    "missing_ranges": "SELECT slice_num, first_missing, last_missing, last_missing - first_missing + 1 AS n FROM thin_gaps",
    "slice_overlap_gap": "SELECT slice_num, min_block, prev_max_block, 'overlap' AS kind FROM broken_edges WHERE min_block <= prev_max_block UNION ALL SELECT slice_num, min_block, prev_max_block, 'gap' FROM third_edges WHERE min_block > prev_max_block + 1",
    "action_position": "SELECT block_num, global_seq, pos AS position FROM numbered",
    "asof_last": f"SELECT p.contract, p.global_seq, state.cleared FROM account_actions p JOIN state USING (global_seq) WHERE p.{_OWN}",
    "top_affected_slices": "SELECT slice_num, CAST(sum(last_missing - first_missing + 1) AS BIGINT) AS missing FROM thin_gaps GROUP BY slice_num ORDER BY missing DESC, slice_num LIMIT 5",
    "last_n": _PAGE.format(where=_OWN, order="DESC", n=20),
    "first_n": _PAGE.format(where=_OWN, order="ASC", n=20),
    "last_n_contract_action": _PAGE.format(where=_OF_ACTION, order="DESC", n=20),
    "first_n_contract_action": _PAGE.format(where=_OF_ACTION, order="ASC", n=20),
    "last_n_contract": _PAGE.format(where=_OF_CONTRACT, order="DESC", n=20),
    "first_n_contract": _PAGE.format(where=_OF_CONTRACT, order="ASC", n=20),
    "position_range": _PAGE.format(where=_OWN, order="ASC", n="10 OFFSET 5"),
    "cursor_page_all": _PAGE.format(where=f"{_OWN} AND {_RANGE} AND global_seq < {CURSOR}", order="DESC", n=10),
    "cursor_page_contract_action": _PAGE.format(where=f"{_OF_ACTION} AND global_seq > {CURSOR}", order="ASC", n=10),
    "cursor_page_contract": _PAGE.format(where=f"{_OF_CONTRACT} AND global_seq < {CURSOR}", order="DESC", n=10),
    "seq_range_page": _PAGE.format(where=f"{_OWN} AND {_RANGE}", order="ASC", n=10),
    "seq_range_page_contract_action": _PAGE.format(where=f"{_OF_ACTION} AND {_RANGE}", order="DESC", n=10),
    "seq_range_page_contract": _PAGE.format(where=f"{_OF_CONTRACT} AND {_RANGE}", order="ASC", n=10),
    "activity_page": f"SELECT global_seq, contract, action, count(*) OVER () = 10 AS has_next, true AS has_prev FROM (SELECT * FROM account_actions WHERE {_OWN} ORDER BY global_seq DESC LIMIT 10 OFFSET 10)",
    "get_actions_pos_offset": _pos_offset(),
    "has_prev": f"SELECT count(*) > 0 AS has_prev FROM account_actions WHERE {_OWN} AND global_seq > {CURSOR}",
    "order_by_seq": f"SELECT trx_id, global_seq FROM actions WHERE trx_id IN {_TRX}",
    "merge_dedupe": f"SELECT global_seq FROM account_actions WHERE {_OWN} UNION SELECT global_seq FROM account_actions WHERE {_OF_CONTRACT}",
    "multi_account_merge": f"SELECT DISTINCT global_seq FROM account_actions WHERE account IN ('{ACCOUNT}', '{OTHER}')",
    "remove_compacted": "SELECT account, global_seq FROM account_actions WHERE global_seq > 600",
    "notified_distinct": "SELECT global_seq, count(*) AS n FROM told GROUP BY global_seq",
    "missing_seqs": f"SELECT global_seq FROM told WHERE {_OWN} EXCEPT ALL SELECT global_seq FROM account_actions WHERE {_OWN}",
    "trx_prefix": "SELECT trx_id, substr(trx_id, 1, 10) AS prefix, substr(trx_id, 1, 4) AS partition, substr(trx_id, 5, 6) AS suffix FROM transactions",
    "family_key": "SELECT global_seq, sha256(concat_ws('|', block_num, trx_index, root, data_index, contract, action)) AS family FROM rooted",
    "ram_delta_explode": "SELECT global_seq, unnest(auths) AS account, quantity AS delta FROM actions",
    "stream_catchup_contract_action": f"SELECT {_PUSHED} FROM actions WHERE contract = '{CONTRACT}' AND action IN ('{ACTION}', 'view')",
    "stream_catchup_single": f"SELECT {_PUSHED} FROM actions WHERE receiver = '{ACCOUNT}' AND global_seq >= 200",
    "stream_catchup_multi": f"SELECT {_PUSHED} FROM actions WHERE receiver IN ('{ACCOUNT}', '{OTHER}')",
    "stream_live": f"SELECT {_PUSHED} FROM actions WHERE contract = '{CONTRACT}' AND action IN ('{ACTION}', 'view')",
    "stream_index_maintain": "SELECT * FROM account_actions",
    "stream_hour_map": "SELECT * FROM hour_map",
    "stream_trx_index": "SELECT DISTINCT substr(trx_id, 1, 4) AS trx_prefix, trx_id, block_num FROM transactions",
    "stream_decode": f"""SELECT global_seq, CASE WHEN ord IS NULL THEN 'none' WHEN cleared THEN 'cleared' ELSE 'set' END AS abi_state,
      CASE WHEN ord IS NOT NULL AND NOT cleared AND action IN ('click', 'view') THEN '{{"q":' || state.quantity || '}}' ELSE '"' || {_little('state.quantity', 8)} || '"' END AS data FROM state JOIN actions USING (global_seq)""",
    "v_block_out_of_range": "SELECT slice_num, block_num FROM broken WHERE block_num < slice_num * 100 + 1 OR block_num > (slice_num + 1) * 100",
    "v_duplicate_block": "SELECT slice_num, block_num, 'ERROR' AS severity, 'DUPLICATE_BLOCK' AS kind FROM broken GROUP BY slice_num, block_num HAVING count(*) > 1",
    "v_missing_block": "SELECT slice_num, unnest(range(first_missing, last_missing + 1)) AS block_num, 'ERROR' AS severity, 'MISSING_BLOCK' AS kind FROM gaps",
    "v_missing_onblock": "SELECT slice_num, block_num FROM no_action",
    "v_slice_overlap": "SELECT slice_num, min_block, prev_max_block FROM broken_edges WHERE min_block <= prev_max_block",
    "v_slice_gap": "SELECT slice_num, min_block, prev_max_block FROM third_edges WHERE min_block > prev_max_block + 1",
    "v_report": "SELECT count(*) AS n, count(*) FILTER (severity = 'ERROR') AS errors, CASE WHEN count(*) FILTER (severity = 'ERROR') > 0 THEN 'failed' ELSE 'passed' END AS status FROM found",
    "v_continuity": "SELECT slice_num, count(*) FILTER (block_num > prev + 1) AS block_gaps, count(*) FILTER (glob_min <> prev_max + 1) AS seq_gaps, sum(n_actions) = sum(glob_max - glob_min + 1) AS counts_match FROM (SELECT *, lag(block_num) OVER w AS prev, lag(glob_max) OVER w AS prev_max FROM blocks WINDOW w AS (PARTITION BY slice_num ORDER BY block_num)) GROUP BY slice_num",
    "v_completeness": "SELECT slice_num, CASE WHEN slice_num = 0 AND min_block = 2 THEN 99 ELSE 100 END::BIGINT AS expected, n AS found, n = CASE WHEN slice_num = 0 AND min_block = 2 THEN 99 ELSE 100 END AS complete FROM edges",
    "v_missing_patterns": "SELECT slice_num, count(*) AS ranges, CAST(sum(last_missing - first_missing + 1) AS BIGINT) AS missing, max(last_missing - first_missing + 1) AS longest FROM thin_gaps GROUP BY slice_num",
}

_NAME = "upper(substr(event_type, 1, 2)) || event_type || 'z9.' || user_id || 'zz'"
_CODES = "(SELECT sum((instr('.12345abcdefghijklmnopqrstuvwxyz', substr(event_type, i, 1)) - 1)::HUGEINT * (1::HUGEINT << CAST(4 + 5 * (12 - i) AS INTEGER))) FROM unnest(range(1, length(event_type) + 1)) AS t(i))"

_ON_EVENTS: dict[str, str] = {
    "cursor_codec": f"""SELECT event_id, to_base64(encode('{{"g":' || event_id || ',"o":"desc","q":"' || {_PRINT} || '"}}')) AS cursor FROM events""",
    "name_canonical": f"SELECT event_id, rtrim(regexp_replace(substr(n, 1, 12), '[^a-z1-5]', '.', 'g') || translate(regexp_replace(substr(n, 13, 1), '[^a-z1-5]', '.', 'g'), 'klmnopqrstuvwxyz', '.12345abcdefghij'), '.') AS name FROM (SELECT event_id, {_NAME} AS n FROM events)",
    "name_to_u64": f"SELECT event_id, CAST({_CODES} AS VARCHAR) AS value, event_type AS name FROM events",
    "symbol_code": "SELECT event_id, (SELECT CAST(sum(ascii(substr(upper(event_type), i, 1))::HUGEINT * (1::HUGEINT << CAST(8 * i AS INTEGER))) AS BIGINT) FROM unnest(range(1, length(event_type) + 1)) AS t(i)) + 4 AS symbol, upper(event_type) AS code FROM events WHERE length(event_type) <= 7 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE length(event_type) > 7",
    "asset_format": f"SELECT event_id, {_ASSET} AS asset FROM events",
    "asset_parse": f"SELECT event_id, {_AMOUNT} AS amount, {_PLACES}::BIGINT AS precision, 'TOK' AS code FROM events",
    "slot_to_time": f"SELECT event_id, strftime(make_timestamp((946684800000 + {_SLOT} * 500) * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS time FROM events",
    "time_to_slot": f"SELECT event_id, {_SLOT} AS slot FROM events",
    "slot_to_hour": f"SELECT event_id, {_HOUR} AS hour FROM events",
    "parse_date": f"SELECT event_id, ({_DAY}) * 24 + CASE WHEN event_id % 2 = 0 THEN 5 ELSE 0 END AS first_hour, ({_DAY}) * 24 + CASE WHEN event_id % 2 = 0 THEN 5 ELSE 23 END AS last_hour FROM events",
    "datehour_codec": f"SELECT event_id, ({_HOUR} - 262968) // 24 * 32 + ({_HOUR} - 262968) % 24 AS packed, {_HOUR} AS hour FROM events",
    "hour_to_date": f"SELECT event_id, strftime(make_timestamp({_HOUR} * 3600000000), '%Y-%m-%dT%H:%M:%SZ') AS date FROM events",
    "parse_setabi": f"SELECT event_id, event_type AS contract, CASE WHEN event_id % 7 <> 0 THEN {_abi("'v' || user_id")} END AS abi_json FROM events",
    "can_fulfill": "SELECT unnest(range(5)) AS i, unnest([true, true, true, false, true]) AS ok",
    "body_allowed": "SELECT event_id, event_id % 5 <> 0 AS allowed FROM events",
    "action_bytes": f"SELECT event_id, {_RAW} AS raw FROM events",
    "action_digest": f"SELECT event_id, sha256(unhex(raw)) AS digest FROM (SELECT event_id, {_RAW} AS raw FROM events)",
    "varint_codec": f"""SELECT event_id, CASE WHEN z < 128 THEN printf('%02x', z) WHEN z < 16384 THEN printf('%02x%02x', z % 128 + 128, z // 128)
      WHEN z < 2097152 THEN printf('%02x%02x%02x', z % 128 + 128, z // 128 % 128 + 128, z // 16384) ELSE printf('%02x%02x%02x%02x', z % 128 + 128, z // 128 % 128 + 128, z // 16384 % 128 + 128, z // 2097152) END AS raw,
      event_id - 300 AS n FROM (SELECT event_id, {_ZIGZAG} AS z FROM events)""",
    "zstd_codec": "SELECT event_id, event_type AS text FROM events",
    "record_checksums": f"SELECT event_id, CASE event_type {_CRCS} END AS crc32, sha256(event_type) AS sha256 FROM events",
    "abi_decode": """SELECT event_id, '{"from":"' || event_type || '","memo":"' || event_type || '","n":' || event_id || '}' AS decoded FROM events""",
    "remove_nulls": """SELECT event_id, '{"a":' || event_id * 10000000 || ',"b":[true,' || user_id || ',{}]}' AS out FROM events""",
    "json_safe_ints": """SELECT event_id, '{"a":' || CASE WHEN event_id * 10000000 < 4294967296 THEN CAST(event_id * 10000000 AS VARCHAR) ELSE '"' || event_id * 10000000 || '"' END || ',"b":[1,null,' || user_id || ',{"c":null}],"d":null}' AS out FROM events""",
    "trx_status_name": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'executed' WHEN 1 THEN 'soft_fail' WHEN 2 THEN 'hard_fail' WHEN 3 THEN 'delayed' WHEN 4 THEN 'expired' ELSE 'unknown' END AS status FROM events",
    "expiration_to_string": "SELECT event_id, strftime(make_timestamp(event_id * 99991000000), '%Y-%m-%dT%H:%M:%S') AS expires FROM events",
    "hex_codec": "SELECT event_id, lower(hex(event_type)) AS hexed, event_type AS back FROM events",
    "block_to_slice": "SELECT event_id, CASE WHEN event_id = 0 THEN 0 ELSE (event_id * 977 - 1) // 10000 END AS slice FROM events",
    "slice_dir_name": "SELECT event_id, printf('history_%010d-%010d', s * 10000 + 1, (s + 1) * 10000) AS name FROM (SELECT event_id, CASE WHEN event_id = 0 THEN 0 ELSE (event_id * 977 - 1) // 10000 END AS s FROM events)",
    "query_fingerprint": f"SELECT event_id, {_PRINT} AS print FROM events",
    "flex_int": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id END AS n FROM events",
    "human_format": "SELECT event_id, CASE WHEN n >= 1000000000 THEN printf('%.2fB', n / 1e9) WHEN n >= 1000000 THEN printf('%.2fM', n / 1e6) WHEN n >= 1000 THEN printf('%.2fK', n / 1e3) ELSE CAST(n AS VARCHAR) END AS shown FROM (SELECT event_id, event_id * 12500 AS n FROM events)",
}

ORACLE_SQL: dict[str, str] = {k: _on(v) for k, v in _ON_HISTORY.items()} | _ON_EVENTS
