"""Audits as text: Markdown tables, grouped reports, constraint checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Column) -> Column:
    """A table cell: bars escaped, line ends as spaces, a dash for null."""
    return F.coalesce(F.regexp_replace(F.replace(value.cast("string"), F.lit("|"), F.lit("\\|")), "\n", " "), F.lit("—"))


def markdown_rows(df: DataFrame, number: str, columns: Sequence[str]) -> DataFrame:
    """(number, line): one table line per row; rows keep their own numbers, so lines stay distributed."""
    line = F.concat(F.lit("| "), F.col(number).cast("string"), F.lit(" | "), F.concat_ws(" | ", *(cell(F.col(c)) for c in columns)), F.lit(" |"))
    return df.select(F.col(number), line.alias("line"))


def markdown_table(df: DataFrame, number: str, columns: Sequence[str], heads: Sequence[str], most: int = 400) -> str:
    """A report table of at most ``most`` rows (a report's sample limit) as text."""
    rows = markdown_rows(df, number, columns).orderBy(number).limit(most).collect()
    return "\n".join([f"| # | {' | '.join(heads)} |", "|---:|" + "---|" * len(heads), *(r["line"] for r in rows)])


def grouped_lines(df: DataFrame, group: str, title: str, order: str) -> DataFrame:
    """(group, order, line) of a plain-text report by group."""
    return df.select(F.col(group), F.col(order), F.concat(F.lit("- "), F.col(title)).alias("line"))


def constraints(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(name, failed): how many rows break each check, from one pass. Null breaks a check."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("failed")) for k in checks))).alias("c")).select("c.*")


def unique(df: DataFrame, key: str) -> DataFrame:
    """(name, failed): rows beyond the first of each non-null key."""
    return df.agg(F.lit(f"unique_{key}").alias("name"), (F.count(key) - F.count_distinct(key)).alias("failed"))
