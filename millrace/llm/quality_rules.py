"""Operator 2: quality rules as one Spark projection.

``measures`` adds whole-text counts, ``apply_rules`` compiles a table of (measure, ratio to, low, high) into one
boolean per rule and a verdict; both use built-in functions only.  Words are ``[^\\x20\\x09-\\x0D]+``.

Repeated three-word windows are found by their 64-bit hashes: the windows are sorted by hash only in texts where some
hash occurs twice, and the places of equal neighbours give the words they cover.  (Two different windows of one
text share a hash with probability below 1e-10 for a text of 40,000 words.)

A null text has no words: all counts are 0, it fails the base rule and is not kept.  Empty texts are the same.  A rule
whose denominator is 0 passes.  Repeated rows are judged alike, an empty table stays empty, and other columns
are untouched unless they bear the name of an added one, which is then replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on was as are at this by or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les en un du une que est pour qui dans par au y el los del se las con no su al"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``measure / per`` lies within [low, high]."""

    name: str
    measure: str
    per: str | None
    low: float | None
    high: float | None


RULES = (
    Rule("few_or_many_words", "n_words", None, 50, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 3, 10),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("shouting", "n_shouts", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def _repeated(h: str, n: str) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``h`` holds one hash per window."""
    placed = F.array_sort(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, i, k: F.get(s, i + F.lit(k))["h"].eqNullSafe(F.get(s, i)["h"])
    # The let-binding by a one-element array keeps the sorted array from being built again for every look.
    twice = F.flatten(F.transform(F.array(placed), lambda s: F.transform(
        F.filter(s, lambda x, i: same(s, i, -1) | same(s, i, 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.array_sort(twice), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"],
    )
    return F.when(F.col(n) > F.size(F.array_distinct(h)), covered).otherwise(F.lit(0).cast("bigint"))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts, n_stop_words, n_ellipsis_lines."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_stop_words", "n_ellipsis_lines"]
    docs = docs.drop(*[c for c in added if c != text_col], "_text", "_words", "_lines", "_hashes", "_windows")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim("_text", F.lit(BLANKS))
    split = docs.withColumn("_text", text).withColumns({
        "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""),
    })
    windows = F.size("_words") - 2
    hashed = split.withColumn("_hashes", F.when(windows > 0, F.transform(
        F.slice("_words", 1, F.greatest(windows, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)),
    )).otherwise(F.array().cast("array<bigint>"))).withColumn("_windows", F.size("_hashes"))
    long = lambda c: c.cast("bigint")
    return hashed.withColumns({
        "n_words": long(F.size("_words")),
        "word_chars": long(F.length("_text") - F.length(F.regexp_replace("_text", r"[^\x20\x09-\x0D]+", ""))),
        "n_symbols": long(F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", ""))),
        "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_repeat_words": _repeated("_hashes", "_windows"),
        "n_lines": long(F.size("_lines")),
        "n_shouts": long(F.regexp_count("_text", F.lit("[!?]{2,}"))),
        "n_stop_words": long(F.size(F.filter("_words", lambda x: F.lower(x).isin(STOP_WORDS)))),
        "n_ellipsis_lines": long(F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))),
    }).drop("_text", "_words", "_lines", "_hashes", "_windows")


def compiled(rule: Rule) -> Column:
    """The rule as a column: true when the text passes."""
    value = F.col(rule.measure).cast("double")
    if rule.per:
        value = value / F.nullif(F.col(rule.per).cast("double"), F.lit(0.0))
    passed = F.lit(True)
    if rule.low is not None:
        passed = passed & (value >= F.lit(float(rule.low)))
    if rule.high is not None:
        passed = passed & (value <= F.lit(float(rule.high)))
    return F.coalesce(passed, F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Add the measures, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    judged = measures(docs, text_col)
    names = F.array_compact(F.array(*[F.when(~compiled(r), F.lit(r.name)) for r in rules]))
    return judged.withColumns({"base_failed": base_failed(), "failed_rules": names}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns.

    The verdict is a column of its own before it selects: as a filter it would be pushed into the projection, with all measures
    written out again for every rule.
    """
    whole = docs.select(F.col(text_col).alias("_body"), F.struct(*[F.col(c) for c in docs.columns]).alias("_own"))
    judged = apply_rules(whole, rules, "_body")
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_own"))).alias("_own")).select("_own.*")
