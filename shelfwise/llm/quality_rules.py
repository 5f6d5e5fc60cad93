"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document by a condition on measures of its words. On a sample the cost of a
rule (time to evaluate it) and its selectivity (share it rejects) are estimated; the rules then
run in the order of rejection per cost, and a document that one rejects is not given to the
next. The order changes the work, never the verdict.

Words are ``[^\\x20\\x09-\\x0D]+``. Null text has no words and fails the base rule. Rows are
independent (repeated rows get equal results, extra columns are ignored); an empty table gives
no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
MIN_WORDS = 20
#: rows that costs and selectivities are estimated on; they decide the order only
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    """Rejects where ``rejects(measures)`` holds, given the measures named in ``needs``."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Column], Column]


#: besides the base rule; integer arithmetic, so that no rounding decides
RULES = (
    Rule("symbols", ("n_words", "n_symbols"), lambda m: m["n_symbols"] * 10 > m["n_words"]),
    Rule(
        "word_length",
        ("n_words", "word_chars"),
        lambda m: (m["word_chars"] > m["n_words"] * 15) | (m["word_chars"] < m["n_words"] * 2),
    ),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: m["n_dup_lines"] * 2 > m["n_lines"]),
    Rule("shouting", ("n_letters", "n_upper"), lambda m: m["n_upper"] * 2 > m["n_letters"]),
    Rule("few_letters", ("word_chars", "n_letters"), lambda m: m["n_letters"] * 10 < m["word_chars"] * 6),
    Rule("same_words", ("n_words", "n_distinct"), lambda m: m["n_distinct"] * 20 < m["n_words"]),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable is bound, an expression is copied."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more, the first included.

    Windows are compared by their 64-bit hashes. Only texts with a repeated window are sorted.
    """

    def covered(hashes: Column) -> Column:
        def spans(s: Column) -> Column:
            repeated = F.filter(
                s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"])
            )
            return F.aggregate(
                F.array_sort(F.transform(repeated, lambda x: x["i"])),
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
                lambda a, i: F.struct(
                    (a["n"] + (i + window - F.greatest(a["end"], i))).cast("long").alias("n"),
                    (i + window).cast("int").alias("end"),
                ),
            )["n"]

        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.lit(0).cast("long")
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(_let(keyed, spans))

    last = F.size(words) - (window - 1)
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(last < 2, F.lit(0).cast("long")).otherwise(_let(hashes, covered))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


#: measure -> Column, from the text and its words; one that a rule alone needs is computed when reached
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words),
    "word_chars": lambda text, words: F.length(F.regexp_replace(text, SPACE, "")),
    "n_symbols": lambda text, words: F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
    "n_dup_lines": lambda text, words: _let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_repeat_words": lambda text, words: repeated_words(words),
    "n_lines": lambda text, words: F.size(_lines(text)),
    "n_letters": lambda text, words: F.length(F.regexp_replace(text, "[^\\p{L}]+", "")),
    "n_upper": lambda text, words: F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")),
    "n_distinct": lambda text, words: F.size(F.array_distinct(words)),
}
#: measures that every document gets
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(name: str) -> Column:
    return MEASURES[name](F.col("text"), F.col("words")).cast("long")


def _rejects(rule: Rule, have: tuple[str, ...]) -> Column:
    """The rule's condition; measures that are not among the columns ``have`` are computed once, in it."""
    row = F.struct(*[(F.col(m) if m in have else _measure(m)).alias(m) for m in rule.needs])
    return _let(row, rule.rejects)


def _with_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col), text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))


def estimate(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[dict]:
    """Per rule: name, cost (seconds on the sample, above reading it) and rejected (share of the sample)."""
    sample = materialize(df.select(F.lit(0).alias("id"), text_col).limit(rows), "rule-sample")
    worded = _with_words(sample, "id", text_col)

    def run(condition: Column) -> tuple[float, int, int]:
        counted = worded.agg(F.count("*"), F.count_if(condition & (F.size("words") >= 0)))
        best = None
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            total, hit = counted.first()
            best = time.perf_counter() - start
        return best, total, hit

    floor = run(F.lit(True))[0]
    found = []
    for rule in rules:
        seconds, total, hit = run(_rejects(rule, ()))
        found.append({"name": rule.name, "cost": max(seconds - floor, 1e-4), "rejected": hit / max(total, 1)})
    return found


def ordered(rules: tuple[Rule, ...], estimates: list[dict]) -> list[Rule]:
    """Rules by rejection per cost, highest first; ties by cost, then as listed."""
    by = {e["name"]: e for e in estimates}
    return sorted(rules, key=lambda r: (-by[r.name]["rejected"] / by[r.name]["cost"], by[r.name]["cost"]))


def apply_rules(
    df: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    estimates: list[dict] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, measures, base_failed, kept, rejected_by): the cascade's verdict on every whole text.

    ``rejected_by`` names the first rule that rejected (``base`` for the base rule); which of
    several is named depends on the order, ``kept`` does not.
    """
    order = ordered(rules, estimate(df, rules, text_col) if estimates is None else estimates)
    measured = _with_words(df, id_col, text_col).select(id_col, "text", "words", *[_measure(m).alias(m) for m in SHOWN])
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    cascade = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:  # CASE stops at the first branch that holds
        cascade = cascade.when(_rejects(rule, SHOWN), F.lit(rule.name))
    verdict = measured.withColumn("base_failed", base).withColumn("rejected_by", cascade)
    return verdict.select(id_col, *SHOWN, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


#: the same verdicts in DuckDB: every rule on every document
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (
  SELECT rid, i, array_to_string(words[i : i + 7], ' ') AS g
  FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)
),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (
  SELECT rid, sum(least(8, nxt - i)) AS n
  FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 8) AS nxt FROM dup) GROUP BY rid
),
ln AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
),
m AS (
  SELECT w.doc_id, len(w.words)::BIGINT AS n_words,
    length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(ln.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(ln.n_lines, 0) AS n_lines,
    length(regexp_replace(w.text, '[^\p{L}]+', '', 'g')) AS n_letters,
    length(regexp_replace(w.text, '[^\p{Lu}]+', '', 'g')) AS n_upper,
    len(list_distinct(w.words)) AS n_distinct
  FROM w LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
    OR n_symbols * 10 > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
    OR n_dup_lines * 2 > n_lines OR n_upper * 2 > n_letters
    OR n_letters * 10 < 6 * word_chars OR n_distinct * 20 < n_words) AS kept
FROM m
"""
