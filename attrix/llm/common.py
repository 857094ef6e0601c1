"""Helpers shared by the text operators: word splitting and shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.session import shared_table  # noqa: F401  (used by the operators)

# A word is a maximal run of characters other than these six ASCII spaces.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Array of the words of a text (null text: empty array)."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def without_spaces(text: Column) -> Column:
    """The text with every word-separating character removed."""
    return F.translate(F.coalesce(text, F.lit("")), _SPACES, "")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other character is left alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
