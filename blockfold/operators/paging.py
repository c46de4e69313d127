"""Pages of an account's actions: newest and oldest rows, keyset cursors, positions."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import fingerprint
from ..functions.timeslots import date_range, parse_date
from .filters import hours, seq_range
from .stats import hours_to_seqs, placed, stretches

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000


def of_account(account_actions: DataFrame, account: str, contract: str = "", action: str = "") -> DataFrame:
    """An account's rows by the longest bound key; an action needs a contract."""
    if action and not contract:
        raise ValueError("invalid_filter: an action needs a contract")
    out = account_actions.where(F.col("account") == account)
    if contract:
        out = out.where(F.col("contract") == contract)
    return out.where(F.col("action") == action) if action else out


def index_used(contract: str = "", action: str = "") -> str:
    return "contract_action" if action else "contract" if contract else "account"


def page(rows: DataFrame, n: int, newest: bool = True, cursor: int | None = None, least: int = 0, most: int = 0) -> DataFrame:
    """The next n rows strictly beyond a cursor, within a sequence range: a top-n, never a full sort."""
    out = rows.where(seq_range(least, most))
    if cursor is not None:
        out = out.where(F.col("global_seq") < cursor if newest else F.col("global_seq") > cursor)
    return out.orderBy(F.desc("global_seq") if newest else F.asc("global_seq")).limit(n)


def positions(rows: DataFrame, first: int, count: int) -> DataFrame:
    """Rows first to first + count - 1 in sequence order, from 0, with their `place`; only the stretches that hold them are ranked."""
    own = stretches(rows).where((F.col("_before") < first + count) & (F.col("_before") + F.col("_n") > first))
    return placed(rows, own).where(F.col("place").between(first, first + count - 1))


def pos_offset(rows: DataFrame, pos: int = -1, offset: int = -20) -> DataFrame:
    """Position paging with `n`, a row's place in the answer.

    A negative pos takes the newest |offset| rows (0: one), newest first.
    Otherwise rows are ascending: from pos on (counted from 1, 0 alike), or
    with a negative offset the rows that end at pos; a pos beyond the last row
    is the last row.
    """
    size = max(1, abs(offset))
    if pos < 0:
        newest = page(rows, size)
        return newest.withColumn("n", F.row_number().over(Window.orderBy(F.desc("global_seq"))))  # a page
    at = max(1, pos)
    if at > 1:
        at = min(at, max(1, rows.count()))
    found = positions(rows, max(0, at - size), min(at, size)) if offset < 0 else positions(rows, at - 1, 1 if pos > at else size)
    return found.withColumn("n", F.row_number().over(Window.orderBy("global_seq"))).drop("place")  # a page


@dataclass(frozen=True)
class Cursor:
    """Place, order and query of a page's edge."""

    seq: int
    order: str
    query: str

    def encode(self) -> str:
        return base64.b64encode(json.dumps({"g": self.seq, "o": self.order, "q": self.query}, separators=(",", ":")).encode()).decode()

    @classmethod
    def decode(cls, text: str) -> Cursor:
        try:
            raw = json.loads(base64.b64decode(text, validate=True))
            return cls(int(raw["g"]), str(raw["o"]), str(raw["q"]))
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("invalid_cursor") from e


@dataclass
class Activity:
    """Page of an activity request, and the cursors around it."""

    rows: DataFrame
    next_cursor: str | None
    prev_cursor: str | None
    index_used: str


def activity(
    account_actions: DataFrame,
    account: str,
    contract: str = "",
    action: str = "",
    limit: int = DEFAULT_LIMIT,
    order: str = "desc",
    cursor: str = "",
    date: str = "",
    start_date: str = "",
    end_date: str = "",
    hour_map: DataFrame | None = None,
) -> Activity:
    """The whole request: checks, access path, page, cursors.

    A cursor of another query is ignored. One whose order differs from the
    request's is read in its own order and the page turned round. A full page
    has a next cursor even if nothing follows.
    """
    if date and (start_date or end_date):
        raise ValueError("invalid_filter: date excludes start_date and end_date")
    if order not in ("asc", "desc"):
        raise ValueError("invalid_order")
    limit = min(MAX_LIMIT, limit if limit > 0 else DEFAULT_LIMIT)
    query = fingerprint(account, contract, action, date, start_date, end_date)
    rows = of_account(account_actions, account, contract, action)
    if date or start_date or end_date:
        first, last = (parse_date(date), parse_date(date, end=True)) if date else date_range(start_date or None, end_date or None)
        zone = hours_to_seqs(hour_map, first, last) if hour_map is not None else None
        rows = hours(rows, first, last, zone)
    at = Cursor.decode(cursor) if cursor else None
    if at and at.query != query:
        at = None
    newest = (at.order if at else order) == "desc"
    # the page, and whether anything stands on the other side of the cursor, in one job of limit + 1 rows at most
    wanted = page(rows, limit, newest, at.seq if at else None).withColumn("_page", F.lit(True))
    if at:
        beyond = rows.where(F.col("global_seq") >= at.seq if newest else F.col("global_seq") <= at.seq)
        wanted = wanted.union(beyond.limit(1).withColumn("_page", F.lit(False)))
    rows_ = wanted.toArrow()
    mine = rows_.filter(rows_["_page"]).drop(["_page"])
    seqs, before = mine["global_seq"].to_pylist(), len(mine) < len(rows_)
    got = rows.sparkSession.createDataFrame(mine, schema=rows.schema)
    low, high = (min(seqs), max(seqs)) if seqs else (0, 0)
    last, first_ = (low, high) if newest else (high, low)  # of the reading order
    next_cursor = Cursor(last, "desc" if newest else "asc", query).encode() if len(seqs) == limit else None
    prev_cursor = Cursor(first_, "asc" if newest else "desc", query).encode() if seqs and before else None
    shown = got.orderBy(F.desc("global_seq") if order == "desc" else F.asc("global_seq"))
    return Activity(shown, next_cursor, prev_cursor, index_used(contract, action))


def fetch(actions: DataFrame, seqs: list[int], strict: bool = False) -> DataFrame:
    """Actions of requested sequences in the order asked for, duplicates kept, with `pos`; strict: a missing one is an error."""
    if len(seqs) > MAX_LIMIT:
        raise ValueError(f"at most {MAX_LIMIT} sequences")
    asked = actions.sparkSession.createDataFrame(list(enumerate(seqs)), "pos int, global_seq long")
    found = actions.where(F.col("global_seq").isin(sorted(set(seqs))))  # as many rows as were asked for
    out = asked.join(F.broadcast(found), "global_seq", "left")
    if strict:
        out = out.withColumn("block_num", F.when(F.col("block_num").isNull(), F.raise_error(F.lit("sequence not found")).cast("long")).otherwise(F.col("block_num")))
    return out.orderBy("pos")


def project_log(actions: DataFrame) -> DataFrame:
    return actions.select("global_seq", "block_num", "block_time", "contract", "action", "trx_id")


def project_activity(actions: DataFrame) -> DataFrame:
    """Full trace rows; history has no forks, so every row is irreversible."""
    return actions.select("global_seq", "block_num", "block_time", "trx_id", "receiver", "contract", "action", "auths", "action_ordinal", "creator_ordinal", F.lit(True).alias("irreversible"), F.lit(0).alias("account_action_seq"))
