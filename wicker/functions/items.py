"""Item lists of records: cleaning and one row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_item(c: Column) -> Column:
    """Lower case, white space (of any kind) made one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def clean_items(c: Column) -> Column:
    """The distinct clean items of a list; null and blank elements don't count, a null list has none."""
    cleaned = F.array_distinct(F.transform(c, clean_item))
    return F.coalesce(F.filter(cleaned, lambda x: x != ""), F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """The distinct lower-cased runs of letters and digits of a text; none for null."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def record_items(df: DataFrame, key: str, items: str) -> DataFrame:
    """key, items: one row per record with at least one item.

    Rows delivered again agree in their items, so any row of a key stands for it. Rows are moved once, by key, after
    cleaning and pruning; later stages by key find that partitioning in place.
    """
    narrow = df.select(F.col(key).cast("string").alias("key"), clean_items(F.col(items)).alias("items"))
    return narrow.where(F.size("items") > 0).dropDuplicates(["key"])
