"""Quality rules as a short-circuit cascade, in built-in column functions only."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import table

#: White space between words, and the characters counted as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rejecting rules beyond the base ones; a text is kept if none holds. They read the
#: text and the counts of quality_counts().
RULES = {
    "symbols": "n_symbols > 0.1 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": r"2 * regexp_count(text, '\\p{Lu}') > regexp_count(text, '\\p{L}')",
    "word_length": "word_chars > 20 * n_words OR word_chars < 2 * n_words",
    "no_letters": r"NOT text RLIKE '\\p{L}'",
}


def quality_counts(docs: DataFrame, passed: Column | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (longs).

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and
    carriage return. n_repeat_words counts the words inside windows of eight words that
    occur twice or more in the text, the first occurrence included; windows are compared
    by a 64-bit hash. A null or empty text has only zeros. Columns of docs that bear one
    of these names are replaced. With passed, a condition on the other counts, n_repeat_words
    is computed only where it holds and 0 elsewhere.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    hashed = F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))
    df = docs.withColumns({
        "word_chars": F.char_length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "__lines": lines,
        "__words": hashed,
    })
    # Each array is read more than once by the next projection, so it is kept as a column and not computed anew inside a lambda.
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    long_enough = F.size("__words") >= WINDOW
    windows = F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))
    df = df.withColumn("__windows", F.when(long_enough if passed is None else long_enough & passed, windows))
    df = df.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    again = F.filter(
        "__sorted",
        lambda x, k: (x["h"] == F.get(F.col("__sorted"), k - 1)["h"]) | (x["h"] == F.get(F.col("__sorted"), k + 1)["h"]),
    )
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__lines", "__words", "__windows", "__sorted")


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30 in 100 of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def order_rules(counted: DataFrame, rules: dict[str, str], repeat: int = 5) -> list[str]:
    """Names of the rules by rejected share per second on the rows of counted, a sample, best first.

    A rule's cost is the time of trying it repeat times on every row less that of a rule
    that costs nothing. The order decides how much work the cascade does, never its
    verdict. An empty sample leaves the given order.
    """
    sample = counted.persist()
    try:
        if not sample.count():
            return list(rules)
        many = sample.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

        def tried(rule: str) -> tuple[float, float]:
            began = time.perf_counter()
            share = many.agg(F.avg(F.expr(f"CASE WHEN {rule} THEN 1D ELSE 0D END + 0 * __turn"))).first()[0]
            return time.perf_counter() - began, share

        tried("false")
        nothing = min(tried("false")[0] for _ in range(2))
        worth = {}
        for name, rule in rules.items():
            seconds, share = tried(rule)
            worth[name] = share / max(seconds - nothing, 1e-3)
        return sorted(rules, key=lambda name: (-worth[name], name))
    finally:
        sample.unpersist()


def quality_verdict(docs: DataFrame, rules: dict[str, str] | None = None, sample_rows: int = 1000, whole: bool = True) -> DataFrame:
    """quality_counts() with base_failed and kept.

    kept is false if a base rule fails; else the rules are tried in the estimated order
    and the first that holds rejects (a rule that is null does not). The order is
    estimated on about sample_rows rows, drawn from all partitions. If not whole, the
    repeated windows, which cost most, are counted only for rows that no other rule
    rejects; n_repeat_words is 0 for the others and kept is the same. An empty table
    gives no rows.
    """
    rules = RULES if rules is None else rules
    n = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / max(n, 1)), seed=9) if n > sample_rows else docs.select("text")
    order = order_rules(quality_counts(sample), rules)
    few = F.col("n_words") < 20

    def tried(verdict: Column) -> Column:
        for name in order:
            verdict = verdict.when(F.expr(rules[name]), False)
        return verdict.otherwise(True)

    if whole:
        return quality_counts(docs).withColumn("base_failed", base_failed()).withColumn("kept", tried(F.when(F.col("base_failed"), False)))
    counted = quality_counts(docs, passed=tried(F.when(few, False)))
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", tried(F.when(F.col("base_failed"), False)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdict(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
