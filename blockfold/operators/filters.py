"""Predicates over actions, as columns that reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ignored(patterns: Sequence[str]) -> Column:
    """True for what patterns exclude: `contract`, `contract::*`, `*::action`, `contract::action`; `*::*` excludes nothing."""
    contracts, actions, pairs = [], [], []
    for p in patterns:
        contract, _, action = p.partition("::")
        if action in ("", "*"):
            if contract != "*":
                contracts.append(contract)
        elif contract == "*":
            actions.append(action)
        else:
            pairs.append((contract, action))
    out = F.col("contract").isin(contracts) | F.col("action").isin(actions)
    for c, a in pairs:
        out = out | ((F.col("contract") == c) & (F.col("action") == a))
    return out


def ignored_for_account(patterns: Sequence[str]) -> Column:
    """As `ignored`, with `account@...` patterns that hold for one account."""
    out = ignored([p for p in patterns if "@" not in p])
    for p in patterns:
        if "@" in p:
            account, _, rest = p.partition("@")
            own = F.lit(True) if rest in ("*", "*::*") else ignored([rest])
            out = out | ((F.col("account") == account) & own)
    return out


def included(contracts: Sequence[str]) -> Column:
    """True for contracts of an allow-list; an empty list allows all."""
    return F.col("contract").isin(list(contracts)) if contracts else F.lit(True)


def combined(excluded: Sequence[str], allowed: Sequence[str]) -> Column:
    """True for what stays."""
    return ~ignored(excluded) & included(allowed)


def stream_matches(contracts: Sequence[str] = (), actions: Sequence[str] = (), receivers: Sequence[str] = ()) -> Column:
    """A subscription's predicate; one without contracts and receivers matches nothing."""
    if not contracts and not receivers:
        return F.lit(False)
    out = F.lit(True)
    for name, values in (("contract", contracts), ("action", actions), ("receiver", receivers)):
        if values:
            out = out & F.col(name).isin(list(values))
    return out


def can_fulfill(wanted: Sequence[str], allowed: Sequence[str]) -> bool:
    return not allowed or set(wanted) <= set(allowed)


def seq_range(least: int = 0, most: int = 0, column: str = "global_seq") -> Column:
    """least <= sequence <= most; 0 is no bound."""
    out = F.lit(True)
    if least:
        out = out & (F.col(column) >= least)
    if most:
        out = out & (F.col(column) <= most)
    return out


def hours(df: DataFrame, first: int, last: int, zone: tuple[int, int] | None = None) -> DataFrame:
    """Rows of inclusive unix hours. `zone`: the hours' sequence range, an extra bound that prunes files; (0, 0) leaves nothing."""
    if zone == (0, 0):
        return df.where(F.lit(False))
    out = df.where(F.col("hour").between(first, last))
    return out.where(seq_range(*zone)) if zone else out


def account_in_block(actions: DataFrame, block: int, account: str) -> DataFrame:
    """Actions of a block that an account receives, contracts or authorizes, with a flag each."""
    flags = actions.where(F.col("block_num") == block).select(
        "global_seq",
        (F.col("receiver") == account).alias("is_receiver"),
        (F.col("contract") == account).alias("is_contract"),
        F.array_contains("auths", account).alias("is_authorizer"),
    )
    return flags.where("is_receiver or is_contract or is_authorizer")


def could_match(subscriptions: Sequence[tuple[Sequence[str], Sequence[str], Sequence[str]]]) -> Column:
    """Whether any live subscription (contracts, actions, receivers) could want an action, before its accounts are known.

    One without contracts and receivers wants nothing; one with contracts alone
    wants receipts of the contract itself.
    """
    out = F.lit(False)
    for contracts, actions, receivers in subscriptions:
        if not contracts and not receivers:
            continue
        own = F.lit(True)
        if contracts:
            own = own & F.col("contract").isin(list(contracts))
        if actions:
            own = own & F.col("action").isin(list(actions))
        own = own & (F.col("receiver").isin(list(receivers)) if receivers else F.col("receiver") == F.col("contract"))
        out = out | own
    return out


def query_allowed(params: Sequence[str], allowed: Sequence[str]) -> bool:
    """Whether a request has no parameters but allowed ones; an empty list allows all."""
    return not allowed or set(params) <= set(allowed)


def body_allowed(body: Column, allowed: Sequence[str]) -> Column:
    """Whether a JSON body has no top-level keys but allowed ones; an empty list allows all, and an empty body is allowed."""
    if not allowed:
        return F.lit(True)
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    return F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0
