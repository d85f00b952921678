"""Profiles of tables: shares of known values, bands, time encodings, content ids, marked texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_shares(df: DataFrame) -> DataFrame:
    """Per column the share of rows in which it is not null, in one pass; null for an empty table."""
    one = df.agg(*(F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "column_name", "share")


def risk_bands(df: DataFrame, score: str, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Rows per band of score: high from high up, med from low up, low below; null scores are left out."""
    band = F.when(F.col(score) >= high, "high").when(F.col(score) >= low, "med").otherwise("low")
    return df.where(F.col(score).isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def time_encoding(df: DataFrame, time: str, steps: int = 4, longest: float = 10_000.0) -> DataFrame:
    """Columns sin_k and cos_k of time * 2 pi / longest ** (k / (steps - 1)) for k below steps; null times stay null."""
    out = {}
    for k in range(steps):
        angle = F.col(time) * (2 * math.pi / longest ** (k / max(1, steps - 1)))
        out |= {f"sin_{k}": F.sin(angle), f"cos_{k}": F.cos(angle)}
    return df.withColumns(out)


def content_ids(df: DataFrame, text: str = "text", digits: int = 10) -> DataFrame:
    """A column content_id from the SHA-256 of the text; null for a null text."""
    return df.withColumn("content_id", F.upper(F.substring(F.sha2(F.col(text), 256), 1, digits)))


def marked_texts(df: DataFrame, tokens: list[str], text: str = "text") -> DataFrame:
    """Per token the rows whose lower-case text holds it; all tokens in one pass."""
    one = df.select(F.lower(text).alias("t")).agg(*(F.count_if(F.col("t").contains(x)).alias(x) for x in tokens))
    return one.unpivot([], tokens, "token", "n")


def group_profile(df: DataFrame, group: str, flag: Column, year: str) -> DataFrame:
    """Rows, share of flagged ones and first and last year per group."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(flag.cast("int")).alias("share"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def year_coverage(df: DataFrame, group: str, year: str, flag: Column, years: list[int]) -> DataFrame:
    """Share of flagged rows by group (rows) and year (columns y<year>), null where there are none."""
    wide = df.groupBy(group).pivot(year, years).agg(F.avg(flag.cast("int")))
    return wide.withColumnsRenamed({str(y): f"y{y}" for y in years})


def pattern_counts(lines: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """How often the pattern's first group has each value in lines; lines that don't match are left out."""
    found = F.regexp_extract(column, pattern, 1)
    return lines.where(F.col(column).rlike(pattern)).groupBy(found.alias("pattern")).agg(F.count("*").alias("n"))


def expected_checks(actual: DataFrame, expected: dict[str, float], tolerance: float = 0.0) -> DataFrame:
    """Rows (check, expected, actual, ok) for a one-row table of figures."""
    tall = actual.select(*(F.col(c).cast("double").alias(c) for c in expected)).unpivot([], list(expected), "check", "actual")
    want = F.create_map(*(x for k, v in expected.items() for x in (F.lit(k), F.lit(float(v)))))
    df = tall.withColumn("expected", want[F.col("check")])
    return df.select("check", "expected", "actual", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.lit(False)).alias("ok"))
