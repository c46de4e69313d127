"""Quality rules: distribution divergence from language references (native).

A document is compared with the reference of its language by Jensen-Shannon
distance, over two histograms: character classes, and the language's common
words against all other words. Common words are the SLOTS most frequent ones,
in lower case, of all documents of the language; the references are the pooled
counts of its documents that pass the base rules. Every language has its own,
whatever its size; documents without a language have one together. Documents
too short for a distribution are not judged by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WHITE = " \t\n\x0b\x0c\r"
#: Character classes: white space, lower-case ASCII letters, those with a pattern of what does not belong to them, and all other ASCII.
PATTERNS = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "symbol": r"[^#*$%&|<>]+", "other": r"[\x00-\x7F]+"}
#: Common words of a language.
SLOTS = 10
#: For each histogram, words below which a document is not judged by it and the distance above which it is rejected.
MIN_CHAR_WORDS, MAX_CHAR_DISTANCE = 50, 0.25
MIN_WORD_WORDS, MAX_WORD_DISTANCE = 100, 0.25
#: Languages up to which the references are broadcast.
MAX_BROADCAST = 10_000

COUNTS = [f"c_{c}" for c in ("white", "lower", *PATTERNS, "punct")]
WORD_COUNTS = [*(f"w_{i}" for i in range(SLOTS)), "w_rest"]


def words_of(core: Column) -> Column:
    """The words of a text without white space around it."""
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))


def common_words(df: DataFrame) -> DataFrame:
    """_ref, _common: each language's SLOTS most frequent words (ties: least first) in df (_lang, _text).

    Counts are added up before the shuffle, and each partition sends SLOTS
    words of a language to the ranking at most.
    """
    each = df.select("_lang", F.explode(words_of(F.lower(F.trim("_text", F.lit(WHITE))))).alias("_word"))
    counts = each.groupBy("_lang", "_word").agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_n"), "_word"))
    top = counts.withColumn("_i", rank).where(F.col("_i") <= SLOTS)
    listed = F.array_sort(F.collect_list(F.struct("_i", "_word")))
    return top.groupBy(F.col("_lang").alias("_ref")).agg(F.transform(listed, lambda x: x["_word"]).alias("_common"))


def features(df: DataFrame, window: int = 5) -> DataFrame:
    """_row and _lang of df (_row, _lang, _text, _common) with base counts and histograms of its texts: native, in one pass.

    Each select uses the columns of the one before more than once, so that
    they are computed once and not put into each other.
    """
    keep = ["_row", "_lang"]
    out = df.select(*keep, "_common", "_text", F.trim("_text", F.lit(WHITE)).alias("_core"))
    out = out.select(
        *keep,
        "_common",
        F.length("_text").cast("long").alias("_chars"),
        words_of(F.col("_core")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    out = out.select("*", F.array_join("_words", "").alias("_joined"))
    out = out.select(*keep, "_common", "_chars", "_words", "_lines", F.length("_joined").cast("long").alias("word_chars"), F.regexp_replace("_joined", "[a-z]+", "").alias("_rest"))
    out = out.select("*", F.length("_rest").cast("long").alias("_left"), *(F.length(F.regexp_replace("_rest", p, "")).cast("long").alias(f"c_{c}") for c, p in PATTERNS.items()))

    # windows: a hash each; where some repeat, sorted beside their places, and the places' reach added up
    def gram(i: Column) -> Column:
        return F.xxhash64(*(F.get("_words", i + k) for k in range(window)))

    last = F.size("_words") - window
    out = out.select(
        *keep,
        "_common",
        (F.col("_chars") - F.col("word_chars")).alias("c_white"),
        (F.col("word_chars") - F.col("_left")).alias("c_lower"),
        *(f"c_{c}" for c in PATTERNS),
        (F.col("_left") - reduce(lambda a, b: a + b, (F.col(f"c_{c}") for c in PATTERNS))).alias("c_punct"),
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        F.col("c_symbol").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), gram)).alias("_grams"),
        # common words are what goes missing when one is taken out of the words set between two spaces
        F.concat(F.lit(" "), F.lower(F.array_join("_words", "  ")), F.lit(" ")).alias("_spaced"),
    )
    found = [*COUNTS, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    same = F.size(F.array_distinct("_grams")) == F.size("_grams")
    slots = []
    for i in range(SLOTS):
        word = F.get("_common", F.lit(i))
        gone = F.length("_spaced") - F.length(F.replace("_spaced", F.concat(F.lit(" "), word, F.lit(" ")), F.lit("")))
        slots.append(F.coalesce(F.floor(gone / (F.length(word) + 2)), F.lit(0)).cast("long").alias(f"w_{i}"))
    pairs = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.select(*keep, *found, *slots, F.when(~same, pairs).alias("_pairs"))

    def differs(p: Column, j: Column) -> Column:
        other = F.get("_pairs", j)["h"]
        return other.isNull() | (other != p["h"])

    twice = F.filter("_pairs", lambda p, j: ~(differs(p, j - 1) & differs(p, j + 1)))
    rest = F.col("n_words") - reduce(lambda a, b: a + b, (F.col(f"w_{i}") for i in range(SLOTS)))
    out = out.select(*keep, *found, *WORD_COUNTS[:-1], rest.alias("w_rest"), F.array_sort(F.transform(twice, lambda p: p["i"])).alias("_starts"))
    reach = F.transform("_starts", lambda s, k: F.least(F.lit(window), F.coalesce(F.get("_starts", k + 1), s + window) - s).cast("long"))
    covered = F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    out = out.select(*keep, *found, *WORD_COUNTS, covered.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; 0 where one is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(0.0)

    pairs = F.zip_with(own, reference, lambda a, b: F.struct((a / total(own)).alias("p"), (b / total(reference)).alias("q")))
    divergence = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + part(x["p"], x["q"]) + part(x["q"], x["p"])) / 2
    return F.when((total(own) > 0) & (total(reference) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(0.0)


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


def judge(df: DataFrame, keep_text: bool = True) -> DataFrame:
    """df with base counts, base_failed, char_distance, word_distance and kept.

    A null text has no words and fails; language names are matched without
    case; a null one is a language of its own, and so is every name, however
    few documents have it. Rows are judged one by one, so repeated rows fare
    alike; ties among common words go to the least. A text of any length is one
    row and takes memory in proportion to its words. An empty table stays
    empty. Columns of df that bear a result's name are replaced, all others
    stay; the text itself is dropped unless kept.
    """
    keep = [c for c in df.columns if c not in RESULTS and (keep_text or c != "text")]
    lang = F.lower(F.col("lang").cast("string")) if "lang" in df.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # df's own columns travel in one, so that no name of theirs can clash
    rows = df.select((F.struct(*keep) if keep else F.struct(F.lit(0).alias("_"))).alias("_row"), F.coalesce(lang, F.lit("")).alias("_lang"), text.alias("_text"))

    def with_lang(left: DataFrame, right: DataFrame) -> DataFrame:
        """left with the row of right of its language; a row per language is broadcast up to MAX_BROADCAST of them."""
        right = F.broadcast(right) if right.count() <= MAX_BROADCAST else right
        return left.join(right, F.col("_lang") == F.col("_ref"), "left")

    found = written(features(with_lang(rows, written(common_words(rows), "common"))), "features")
    sums = [F.sum(c).alias(f"r_{c}") for c in (*COUNTS, *WORD_COUNTS)]
    references = written(found.where(~F.col("base_failed")).groupBy(F.col("_lang").alias("_ref")).agg(*sums), "references")

    def compared(names: list[str]) -> Column:
        refs = [F.coalesce(f"r_{c}", F.lit(0).cast("long")).cast("double") for c in names]
        return distance(F.array(*(F.col(c).cast("double") for c in names)), F.array(*refs))

    out = with_lang(found, references).select("_row", *RESULTS[:6], compared(COUNTS).alias("char_distance"), compared(WORD_COUNTS).alias("word_distance"))
    fits = (F.col("n_words") < MIN_CHAR_WORDS) | (F.col("char_distance") <= MAX_CHAR_DISTANCE)
    fits = fits & ((F.col("n_words") < MIN_WORD_WORDS) | (F.col("word_distance") <= MAX_WORD_DISTANCE))
    out = out.withColumn("kept", ~F.col("base_failed") & fits)
    own = [F.col("_row").getField(c).alias(c) for c in keep]
    return out.select(*own, *RESULTS)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """DuckDB SQL for op1."""
    own = {"white": r"[^\x20\x09-\x0D]+", "lower": "[^a-z]+", **PATTERNS}
    classes = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g')) AS c_{c}" for c, p in own.items())
    rest = " - ".join(["length(t)", *(f"c_{c}" for c in own)])
    slots = ", ".join(f"len(list_filter(lw, lambda x: x = c[{i + 1}])) AS w_{i}" for i in range(SLOTS))
    w_rest = " - ".join(["n_words", *(f"w_{i}" for i in range(SLOTS))])
    every = [*COUNTS, *WORD_COUNTS]
    sums = ", ".join(f"sum({c}) AS r_{c}" for c in every)
    refs = ", ".join(f"coalesce(o.r_{c}, 0) AS r_{c}" for c in every)

    def js(names: list[str]) -> str:
        m, n = (" + ".join(f"{x}{c}" for c in names) for x in ("", "r_"))
        terms = []
        for c in names:
            p, q = f"({c} / m)", f"(r_{c} / n)"
            terms += [f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END" for x in (p, q)]
        return f"(SELECT CASE WHEN m > 0 AND n > 0 THEN sqrt(greatest(({' + '.join(terms)}) / 2, 0)) ELSE 0 END FROM (SELECT ({m})::DOUBLE AS m, ({n})::DOUBLE AS n))"

    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(lang, '')) AS lang FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
grams AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS i FROM again) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, t, len(w) AS n_words, list_transform(w, lambda x: lower(x)) AS lw, {classes},
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
ranked AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS i FROM (
  SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(lw) AS word FROM f) GROUP BY lang, word)),
common AS (SELECT lang, list(word ORDER BY i) AS c FROM ranked WHERE i <= {SLOTS} GROUP BY lang),
fc AS (SELECT f.*, c FROM f LEFT JOIN common ON f.lang = common.lang),
g AS (SELECT *, {rest} AS c_punct, {slots}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM fc),
h AS (SELECT *, {w_rest} AS w_rest FROM g),
o AS (SELECT lang, {sums} FROM h WHERE NOT base_failed GROUP BY lang),
j AS (SELECT h.*, {refs} FROM h LEFT JOIN o ON h.lang = o.lang)
SELECT doc_id, n_words, (length(t) - c_white)::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (n_words < {MIN_CHAR_WORDS} OR {js(COUNTS)} <= {MAX_CHAR_DISTANCE}) AND (n_words < {MIN_WORD_WORDS} OR {js(WORD_COUNTS)} <= {MAX_WORD_DISTANCE}) AS kept
FROM j"""
