"""From actions to one row per (account, action): who is told of an action, and which of these rows count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILY = ["block_num", "trx_index", "root", "data_index", "contract", "action"]


def _trees(actions: DataFrame, columns: list[str]) -> DataFrame:
    """Per transaction `_rows`: its actions (columns), each with its `root`, in sequence order. One shuffle; a transaction is one row."""
    item = F.struct(F.col("global_seq").alias("_seq"), *columns)
    empty = F.expr("cast(map() as map<bigint,bigint>)")
    fold = F.aggregate("_rows", empty, lambda m, x: F.map_concat(m, F.create_map(x["action_ordinal"], F.when(x["creator_ordinal"] == 0, x["action_ordinal"]).otherwise(F.element_at(m, x["creator_ordinal"])))))
    trees = actions.groupBy("block_num", "trx_index").agg(F.array_sort(F.collect_list(item)).alias("_rows")).withColumn("_roots", fold)
    rooted = F.transform("_rows", lambda x: x.withField("root", F.element_at(F.col("_roots"), x["action_ordinal"])))
    return trees.select("block_num", "trx_index", rooted.alias("_rows"))


def roots(actions: DataFrame) -> DataFrame:
    """actions with `root`: the ordinal a creator chain ends at. Folded over each transaction in order, without iteration or a join."""
    own = [c for c in actions.columns if c not in ("block_num", "trx_index", "root")]
    each = _trees(actions, own).select("block_num", "trx_index", F.explode("_rows").alias("_row"))
    return each.select(*(c if c in ("block_num", "trx_index") else F.col(f"_row.{c}") for c in actions.columns if c != "root"), "_row.root")


def notified(actions: DataFrame) -> DataFrame:
    """A row per action and account told of it: its receiver and its authorizers, each once."""
    accounts = F.array_distinct(F.concat(F.array("receiver"), "auths"))
    told = actions.withColumn("account", F.explode(accounts))
    return told.withColumn("is_recv", F.col("account") == F.col("receiver")).withColumn("is_auth", F.array_contains("auths", F.col("account")))


def canonical_actions(actions: DataFrame) -> DataFrame:
    """One row per (account, global_seq): receivers always, authorizers where they receive no action of the same family.

    A family lies within a transaction, so all is decided there: one shuffle.
    """
    family = FAMILY[2:]
    trees = _trees(actions, ["global_seq", "action_ordinal", "creator_ordinal", "receiver", "contract", "action", "data_index", "auths", "hour"])
    trees = trees.withColumn("_receives", F.array_distinct(F.transform("_rows", lambda x: F.struct(*(x[c].alias(c) for c in family), x["receiver"].alias("account")))))

    def alone(x: Column) -> Column:
        """Authorizers of an action that have no receipt in its family."""
        others = F.filter(F.array_distinct(x["auths"]), lambda a: a != x["receiver"])
        return F.filter(others, lambda a: ~F.array_contains("_receives", F.struct(*(x[c].alias(c) for c in family), a.alias("account"))))

    def told(x: Column) -> Column:
        own = F.struct(x["receiver"].alias("account"), F.array_contains(x["auths"], x["receiver"]).alias("is_auth"))
        return F.concat(F.array(own), F.transform(alone(x), lambda a: F.struct(a.alias("account"), F.lit(True).alias("is_auth"))))

    rows = F.transform("_rows", lambda x: F.struct(x["contract"].alias("contract"), x["action"].alias("action"), x["global_seq"].alias("global_seq"), x["hour"].alias("hour"), told(x).alias("told")))
    each = trees.select("block_num", "trx_index", F.explode(rows).alias("x")).select("block_num", "trx_index", "x.*")
    each = each.withColumn("t", F.explode("told"))
    return each.select("t.account", "contract", "action", "global_seq", "block_num", "hour", "trx_index", "t.is_auth")


def executions(actions: DataFrame) -> DataFrame:
    return actions.where(F.col("receiver") == F.col("contract"))


def notifications(actions: DataFrame) -> DataFrame:
    """account and its ascending sequences."""
    return notified(actions).groupBy("account").agg(F.array_sort(F.collect_set("global_seq")).alias("seqs"))


def discrepancy(actions: DataFrame, account_actions: DataFrame, account: str) -> DataFrame:
    """Sequences an account is told of that the canonical rows leave out."""
    raw = notified(actions).where(F.col("account") == account).select("account", "global_seq")
    return raw.join(account_actions.select("account", "global_seq"), ["account", "global_seq"], "left_anti")
