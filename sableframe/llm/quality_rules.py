"""Quality rules as a short-circuit cascade of native column expressions.

Every rule is a Boolean expression over one text. A sample of about
`SAMPLE_ROWS` rows gives each rule's measured cost and its rejection rate; the
cascade then tests the rules in order of rejection per cost, inside one CASE
expression, so that a rule is computed only for rows that the earlier ones kept.
The order changes the work, never the verdict. `rule_report` has to return some
measures of every row; those that only a rule needs are left to the cascade.

Nulls and empty texts have no words: every count is 0 and the base rule fails.
Repeated rows give repeated results, an empty table an empty one. Other columns
of the input are ignored by `rule_report` and kept untouched by `passing`.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed by the contract: words have none of these characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE = "[\\x20\\x09-\\x0D]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: The method's own rules.
MAX_SYMBOLS_PERCENT = 15
MIN_WORD_CHARS_X10, MAX_WORD_CHARS_X10 = 15, 200
MAX_DUP_LINES_PERCENT = 70
MAX_CAPITALS_PERCENT = 50
SAMPLE_ROWS = 400


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """Words in order; a text without any gives one empty string."""
    return F.split(F.btrim(text, F.lit(SPACES)), f"{SPACE}+")


def count_words(words: Column) -> Column:
    return F.when(F.get(words, F.lit(0)) == "", F.lit(0)).otherwise(F.size(words)).cast("long")


def count_repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are 64-bit hashes. If all differ, one hash set settles it. Else
    they are sorted with their places; those beside an equal one are kept and
    the union of the words under them is counted.
    """

    def from_places(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def from_sorted(s: Column) -> Column:
        again = F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]))
        return _let(F.sort_array(F.transform(again, lambda x: x["i"])), from_places)

    def from_hashes(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(placed, from_sorted))

    windows = F.transform(
        F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, from_hashes)).cast("long")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The plain counts by name, each from the whole text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    by_word = _let(word_array(t), lambda w: F.struct(count_words(w).alias("n_words"), count_repeated(w).alias("n_repeat_words")))
    by_line = _let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        ),
    )
    return {
        "by_word": by_word,
        "by_line": by_line,
        "word_chars": F.char_length(t).cast("long") - _count(t, SPACE),
        "n_symbols": _count(t, "[#*$%&|<>]"),
        "n_capitals": _count(t, "[A-Z]"),
    }


def rejections(m: dict[str, Column], n_words: Column) -> dict[str, Column]:
    """Rule name to an expression that is true where the rule rejects."""
    return {
        "repeats": m["by_word"]["n_repeat_words"] * 100 > n_words * MAX_REPEATED_PERCENT,
        "symbols": m["n_symbols"] * 100 > n_words * MAX_SYMBOLS_PERCENT,
        "word_length": ~(m["word_chars"] * 10).between(n_words * MIN_WORD_CHARS_X10, n_words * MAX_WORD_CHARS_X10),
        "dup_lines": m["by_line"]["n_dup_lines"] * 100 > m["by_line"]["n_lines"] * MAX_DUP_LINES_PERCENT,
        "capitals": m["n_capitals"] * 100 > m["word_chars"] * MAX_CAPITALS_PERCENT,
    }


def _short(text: Column) -> Column:
    return count_words(word_array(F.coalesce(text, F.lit("")))) < MIN_WORDS


def text_rules(text: Column) -> dict[str, Column]:
    """The same rules straight over a text, the base's two among them."""
    m = measures(text)
    n = count_words(word_array(F.coalesce(text, F.lit(""))))
    return {"short": _short(text), **rejections(m, n)}


def cascade_order(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejection per cost on a sample of about `rows` rows of the whole table, highest first.

    Cost is the time of the rule alone over the sample, less that of a test of
    nothing; a first run of each, which compiles it, doesn't count. Ties and an
    empty sample keep the order of the names.
    """
    share = rows / max(1, docs.count())
    some = docs.select(F.col(text).alias("t"))
    sample = (some.sample(share, seed=11) if share < 1 else some).collect()
    rules = text_rules(F.col("t"))
    if not sample:
        return sorted(rules)
    at = docs.sparkSession.createDataFrame([(r["t"],) for r in sample], "t string").coalesce(1)

    def tested(rejects: Column) -> tuple[int, float]:
        count = at.select(F.count_if(rejects).alias("n"))
        count.first()
        began = time.perf_counter()
        return count.first()["n"], time.perf_counter() - began

    nothing = tested(F.col("t") == "")[1]
    found = {}
    for name, rejects in rules.items():
        n, took = tested(rejects)
        found[name] = (n + 0.5) / len(sample) / max(took - nothing, 1e-3)
    return sorted(rules, key=lambda k: (-found[k], k))


def passing(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Rows that no rule rejects, all columns as they are."""
    rules = text_rules(F.col(text))
    verdict = F.lit(True)
    for name in reversed(order or cascade_order(docs, text)):
        verdict = F.when(rules[name], F.lit(False)).otherwise(verdict)
    return docs.where(verdict)


def rule_report(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): the counts and the verdicts."""
    order = order or cascade_order(docs)
    m = measures(F.col("text"))
    only_rules = ["n_capitals"]  # not returned, so computed where the cascade gets to its rule
    flat = docs.select("doc_id", "text", *(c.alias(k) for k, c in m.items() if k not in only_rules))
    n = F.col("by_word.n_words")
    rules = rejections({k: m[k] if k in only_rules else F.col(k) for k in m}, n)
    base = (n < MIN_WORDS) | rules["repeats"]
    verdict = F.lit(True)
    for name in reversed([k for k in order if k in rules]):
        verdict = F.when(rules[name], F.lit(False)).otherwise(verdict)
    return flat.select(
        "doc_id",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("by_line.n_dup_lines").alias("n_dup_lines"),
        F.col("by_word.n_repeat_words").alias("n_repeat_words"),
        base.alias("base_failed"),
        F.when(base, F.lit(False)).otherwise(verdict).alias("kept"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_report(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
a AS (
  SELECT doc_id, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t),
b AS (
  SELECT *, len(w) AS n,
    CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g
  FROM a),
places AS (SELECT doc_id, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM b),
again AS (SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
under AS (SELECT DISTINCT doc_id, i + k AS j FROM again, range(3) AS r(k)),
rep AS (SELECT doc_id, count(*) AS n_repeat FROM under GROUP BY doc_id),
c AS (
  SELECT doc_id, n AS n_words,
    length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words,
    len(lines) AS n_lines,
    length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS n_capitals
  FROM b LEFT JOIN rep USING (doc_id)),
d AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols * 100 > n_words * {MAX_SYMBOLS_PERCENT})
    AND word_chars * 10 BETWEEN n_words * {MIN_WORD_CHARS_X10} AND n_words * {MAX_WORD_CHARS_X10}
    AND NOT (n_dup_lines * 100 > n_lines * {MAX_DUP_LINES_PERCENT})
    AND NOT (n_capitals * 100 > word_chars * {MAX_CAPITALS_PERCENT}) AS kept
FROM d
"""
