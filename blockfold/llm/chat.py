"""Chat formatting by schema fingerprints (native).

A record of any layout is a variant. The nested paths of its fields, without
their scalar types, are hashed to a fingerprint; a registry of declarative
layouts says which fingerprints it maps and how, and a record becomes canonical
turns (role, content). Formatting marks turns and escapes control strings in
texts reversibly, with the spans to train on.

    <turn ROLE>
    TEXT</turn>

In a text a backslash becomes \\b, and the < of <turn or </turn> becomes \\l;
in a role so do every < and, as \\g, every >. Nothing else changes, and an
unescaped < never follows from a text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURNS = "array<struct<role:string,content:string>>"
#: Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A declarative mapping of records.

    messages: the path of an array of turns ("" where the record is the array),
    with the fields `role` and `content`; without it and with `role` the record
    is one turn; else `parts` lists (role, fields), the fields' texts joined by
    a blank line. Fields in `optional` may be absent, those in `ignored` may be
    there.
    """

    name: str
    role: str = ""
    content: str = ""
    messages: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ("id",)

    def skeletons(self) -> Iterable[str]:
        """Field paths this layout maps, as the fingerprint sees them."""
        if self.messages is not None:
            lists = [f"ARRAY<{_object([self.role, self.content])}>", "ARRAY<*>"]
            if self.messages == "":
                return lists
            return [_object([f"{self.messages}: {x}", *more]) for x in lists for more in _subsets(self.ignored)]
        fixed = [f for _, fields in self.parts for f in fields if f not in self.optional] or [self.role, self.content]
        return [_object([*fixed, *more]) for more in _subsets(self.optional + self.ignored)]

    def turns(self, record: Column) -> Column:
        def text(field: str) -> Column:
            return F.try_variant_get(record, f"$.{field}", "string")

        if self.messages is not None:
            path = f"$.{self.messages}" if self.messages else "$"
            found = F.try_variant_get(record, path, f"array<struct<{self.role}:string,{self.content}:string>>")
            return F.transform(found, lambda m: _turn(m[self.role], m[self.content]))
        if not self.parts:
            return F.array(_turn(text(self.role), text(self.content)))
        made = [_turn(F.lit(role), F.concat_ws("\n\n", *(F.when(text(f) != "", text(f)) for f in fields))) for role, fields in self.parts]
        # an absent optional part makes no turn
        kept = [F.when(F.coalesce(*(text(f) for f in fields)).isNull(), F.array().cast(TURNS)).otherwise(F.array(m)) if set(fields) <= set(self.optional) else F.array(m) for m, (_, fields) in zip(made, self.parts, strict=True)]
        return F.concat(*kept)


def _subsets(names: tuple[str, ...]) -> list[tuple[str, ...]]:
    return [c for k in range(len(names) + 1) for c in combinations(names, k)]


def _object(fields: Iterable[str]) -> str:
    return "OBJECT<" + ", ".join(sorted(f if ":" in f else f"{f}: *" for f in fields)) + ">"


def _turn(role: Column, content: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    lower = F.lower(role)
    for other, name in ROLES.items():
        role = F.when(lower == other, F.lit(name)).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(content, F.lit("")).alias("content"))


LAYOUTS = (
    Layout("messages", "role", "content", "messages"),
    Layout("conversation", "from", "value", "conversations"),
    Layout("bare messages", "role", "content", ""),
    Layout("bare conversation", "from", "value", ""),
    Layout("turn", "role", "text", ignored=()),
    Layout("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt and response", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("prompt and completion", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question and answer", parts=(("user", ("question",)), ("assistant", ("answer",)))),
)


def skeleton(record: Column) -> Column:
    """Nested field paths of a variant; scalars of any type, null included, are alike."""
    return F.regexp_replace(F.schema_of_variant(record), r"\b[A-Z][A-Z_]*(\([0-9, ]+\))?(?=[,>]|$)", "*")


def canonical(df: DataFrame, record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """df with `fingerprint`, `layout` and `turns` of a variant record.

    A null record and one of unknown fingerprint have no layout and null turns,
    so that they can be told from conversations without turns. Columns of df
    with these names are replaced.
    """
    out = df.withColumn("_record", record).withColumn("fingerprint", F.xxhash64(skeleton(F.col("_record"))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        ours = F.col("fingerprint").isin([F.xxhash64(F.lit(s)) for s in x.skeletons()])
        layout = F.when(ours, F.lit(x.name)).otherwise(layout)
        turns = F.when(ours, x.turns(F.col("_record"))).otherwise(turns)
    known = F.col("_record").isNotNull()
    return out.withColumn("layout", F.when(known, layout)).withColumn("turns", F.when(known, turns)).drop("_record")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("</turn>"), F.lit("\\l/turn>")), F.lit("<turn"), F.lit("\\lturn"))


def escaped_role(role: Column) -> Column:
    role = F.replace(role, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(role, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def format_turns(df: DataFrame, key: str, order: list[str], trained: str = "assistant") -> DataFrame:
    """One row per key of df (key, order..., turns): key, formatted, loss_turns, and the pieces `_heads` and `_texts`.

    The turns of a key's rows follow each other in `order`, ties by content.
    loss_turns says of each turn whether its text is trained on; `with_spans`
    gives these texts' places. A null key is a key; rows without turns add
    none. A conversation is one string, so one task holds it whole.
    """
    at = F.posexplode("turns").alias("_n", "_turn")
    rows = df.select(key, *order, at).select(
        key,
        F.struct(*order, F.col("_n"), F.col("_turn.role").alias("role"), F.col("_turn.content").alias("content")).alias("_row"),
    )
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    end = F.lit("</turn>\n")
    made = grouped.withColumn("_heads", F.transform("_rows", lambda r: F.concat(F.lit("<turn "), escaped_role(r["role"]), F.lit(">\n"))))
    made = made.withColumn("_texts", F.transform("_rows", lambda r: escaped(r["content"])))
    made = made.withColumn("loss_turns", F.transform("_rows", lambda r: r["role"] == trained)).drop("_rows")
    made = made.withColumn("formatted", F.array_join(F.transform(F.arrays_zip("_heads", "_texts"), lambda z: F.concat(z["_heads"], z["_texts"], end)), ""))
    return made.select(key, "formatted", "loss_turns", "_heads", "_texts")


def with_spans(formatted: DataFrame, key: str) -> DataFrame:
    """key and loss_spans (sorted) of format_turns' result, from running lengths."""
    rows = formatted.select(key, F.posexplode(F.arrays_zip("_heads", "_texts", "loss_turns")).alias("n", "z"))
    size = F.length("z._heads") + F.length("z._texts") + len("</turn>\n")
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("z._heads")
    spans = rows.select(key, "z.loss_turns", F.struct(begin.alias("begin"), (begin + F.length("z._texts")).alias("end")).alias("span"))
    return spans.where("loss_turns").groupBy(key).agg(F.array_sort(F.collect_list("span")).alias("loss_spans"))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back."""
    parts = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.instr(p, ">\n")
        role = F.substring(p, F.lit(7), cut - 7)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(p, cut + 2, F.length(p))).alias("content"))

    return F.transform(parts, turn)


CONTROL_ID, CONTROL_TEXT = -7, r"\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    rows = table(spark, sf_dir, "conversations").select(*columns)
    probe = spark.createDataFrame([(CONTROL_ID, 0, "user", CONTROL_TEXT), (CONTROL_ID, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    records = canonical(rows.union(probe), F.to_variant_object(F.struct("role", "text")))
    out = format_turns(records, "conv_id", ["turn"]).withColumn("turns", parsed(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter(F.arrays_zip("turns", "loss_turns"), lambda z: z["loss_turns"]), lambda z: z["turns"]["content"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return out.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: DuckDB SQL for op4, from the rows themselves.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '</turn>', '\l/turn>'), '<turn', '\lturn') AS esc FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(6 + length(role) + 2 + length(esc) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
