"""Document quality rules: a table of thresholds compiled into one projection.

``measure`` adds the numbers, ``compiled`` turns a threshold table into one boolean column, and
``quality_rules`` joins the two. Everything is built-in SQL functions over the row's own text:
no user function, no shuffle, and no look at another row.

Words are maximal runs of characters other than 0x20 and 0x09-0x0D, unchanged. Repeated windows
are found within one text by 64-bit hashes of three words each (a false match needs two of one
text's windows to share a hash: under 1e-11 for a text of 20,000 words).

Defined results: a null text counts as an empty one, which fails the base rule for its length;
repeated rows give repeated results; the input's other columns are not carried on unless named
in ``keep``; a kept column that has an added one's name gets ``input_`` in front.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import SPACES, apart, text_column

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for as with on be by this are was from or an at a he".split(),
    "fr": "le la les de des du un une et en que qui dans pour par sur au est avec il elle se ne pas".split(),
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "es": "el la los las de que y en un una por con no su para es al lo como del se esta".split(),
}
#: Windows of a text that occur again are looked up in a list up to this many; beyond it they are found by sorting.
FEW = 48


@dataclass(frozen=True)
class Rule:
    """numerator <= or >= factor * denominator, in whole numbers, so no rounding decides."""

    name: str
    left: str
    op: str
    factor: tuple[int, int]  # as a fraction
    right: str


#: The production table: a ratio of measured columns against a bound.
TABLE = (
    Rule("enough_words", "n_words", ">=", (50, 1), "one"),
    Rule("not_endless", "n_words", "<=", (1_000_000, 1), "one"),
    Rule("words_not_short", "word_chars", ">=", (2, 1), "n_words"),
    Rule("words_not_long", "word_chars", "<=", (14, 1), "n_words"),
    Rule("few_symbols", "n_symbols", "<=", (1, 10), "n_words"),
    Rule("stop_words", "n_stop_words", ">=", (3, 100), "n_words"),
    Rule("lines_differ", "n_dup_lines", "<=", (1, 2), "n_lines"),
    Rule("few_bullets", "n_bullet_lines", "<=", (9, 10), "n_lines"),
    Rule("few_broken_lines", "n_ellipsis_lines", "<=", (3, 10), "n_lines"),
    Rule("little_shouting", "n_upper", "<=", (7, 10), "word_chars"),
)


def _long(c: Column) -> Column:
    return c.cast("long")


def measure(df: DataFrame, keep: list[str], column: str = "text") -> DataFrame:
    """keep columns plus the counts that the rules use."""
    zero = F.lit(0).cast("long")
    kept = [f"k{i}" for i in range(len(keep))]
    docs = df.select(*(df[c].alias(k) for c, k in zip(keep, kept, strict=True)), text_column(df, column).alias("_t"))
    trimmed = F.btrim("_t", F.lit(BLANKS))
    docs = docs.select(
        *kept,
        "_t",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_l"),
    )
    n = F.size("_w")
    hashes = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    )
    docs = docs.withColumn("_h", hashes)
    docs = docs.withColumn("_s", F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.array().cast("array<bigint>")).otherwise(F.sort_array("_h")))
    again = F.array_distinct(F.filter("_s", lambda x, i: F.get("_s", i - 1) == x))
    docs = docs.withColumn("_again", again)
    # Where repeated windows start: by look-up in a short list, or by sorting windows with their places.
    listed = F.filter(F.sequence(F.lit(0), n - 3), lambda i: F.array_contains("_again", F.get("_h", i)))
    placed = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    docs = docs.withColumn("_p", F.when(F.size("_again") > FEW, placed))
    sorted_out = F.sort_array(
        F.transform(
            F.filter("_p", lambda x, i: (F.get("_p", i - 1)["h"] == x["h"]) | (F.get("_p", i + 1)["h"] == x["h"])),
            lambda x: x["i"],
        )
    )
    starts = F.when(F.size("_again") == 0, F.array().cast("array<int>")).when(F.size("_again") <= FEW, listed).otherwise(sorted_out)
    docs = docs.withColumn("_at", starts)
    covered = F.aggregate(F.transform("_at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - x, F.lit(3)))), zero, lambda a, x: a + x)
    stop = sorted({w for words in STOP_WORDS.values() for w in words})
    # Adding nothing, this keeps the projection whole: without it, a filter on the counts would move
    # below it, where each column would be computed again for every mention of it.
    covered = covered + (F.spark_partition_id() * 0)
    counts = docs.select(
        *kept,
        _long(n).alias("n_words"),
        _long(F.length(F.array_join("_w", ""))).alias("word_chars"),
        _long(F.regexp_count("_t", F.lit(f"[{SYMBOLS}]"))).alias("n_symbols"),
        _long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _long(F.size(F.filter("_w", lambda w: F.lower(w).isin(*stop)))).alias("n_stop_words"),
        _long(F.size("_l")).alias("n_lines"),
        _long(F.size(F.filter("_l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")))).alias("n_bullet_lines"),
        _long(F.size(F.filter("_l", lambda x: x.endswith("...") | x.endswith("…")))).alias("n_ellipsis_lines"),
        _long(F.regexp_count("_t", F.lit("[A-Z]"))).alias("n_upper"),
        F.lit(1).cast("long").alias("one"),
    )
    added = [c for c in counts.columns if c not in kept] + ["base_failed", "kept"]
    return counts.withColumnsRenamed(dict(zip(kept, apart(keep, added), strict=True)))


def compiled(table: tuple[Rule, ...] = TABLE) -> Column:
    """One boolean column for the whole table; no rule gives true."""
    verdict = F.lit(True)
    for r in table:
        left, right = F.col(r.left) * r.factor[1], F.col(r.right) * r.factor[0]
        verdict = verdict & (left <= right if r.op == "<=" else left >= right)
    return verdict


def quality_rules(df: DataFrame, keep: list[str], column: str = "text", table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """keep columns, the counts, base_failed and kept."""
    measured = measure(df, keep, column)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(table)).drop("one")


def oracle(table: tuple[Rule, ...] = TABLE) -> str:
    """SQL for the same rows: windows are compared as words, without hashes."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    rules = " AND ".join(f"{r.left} * {r.factor[1]} {r.op} {r.right} * {r.factor[0]}" for r in table)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(regexp_split_to_array(t, '\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
k AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS key FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k),
c AS (SELECT doc_id, count(DISTINCT i + o) AS covered FROM r, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1 GROUP BY doc_id),
m AS (
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words,
       CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
       CAST(len(ls) AS BIGINT) AS n_lines,
       CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
       CAST(len(list_filter(ls, lambda x: x LIKE '%...' OR x LIKE '%…')) AS BIGINT) AS n_ellipsis_lines,
       CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper, 1 AS one
FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, n_bullet_lines,
       n_ellipsis_lines, n_upper, base_failed, (NOT base_failed AND {rules}) AS kept
FROM b
"""
