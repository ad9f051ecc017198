"""Quantities recorded in different units, converted to the canonical unit of their dimension."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.functions.quantity import SPELLINGS, Converter, factor_rows
from wicker.operators.packed_values import explode_lines, known_values
from wicker.session import read_table

_AMOUNT = "base_unit string, amount_tenths long"


def unit_rows(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, float]]:
    """The factors of the unit symbols that the grammar can spell; their number bounds what is sent to the workers."""
    table = read_table(spark, sf_dir, "unit_factors").where(F.col("unit").isin(*SPELLINGS))
    return factor_rows(table.groupBy("unit").agg(F.min("base_unit").alias("base_unit"), F.min("factor").alias("factor")).collect())


def amount_of_text(factors: list[tuple[str, str, float]]):
    """Arrow UDF: free text -> (base_unit, amount_tenths), both null where the text has no amount."""

    @F.pandas_udf(_AMOUNT)
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        converter = Converter(factors)
        for texts in batches:
            yield _frame([converter.of_text(t) for t in texts])

    return convert


def _frame(found: list[tuple[str, int] | None]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "base_unit": pd.array([f and f[0] for f in found], dtype=pd.ArrowDtype(pa.string())),
            "amount_tenths": pd.array([f and f[1] for f in found], dtype=pd.ArrowDtype(pa.int64())),
        }
    )


def amounts_of_parts(df: DataFrame, factors: list[tuple[str, str, float]]) -> DataFrame:
    """recipe_id, line_no, base_unit, amount_tenths of parsed lines that have an amount.

    Quantity with unit counts first, then the unit alone, then the raw text. Null or NaN quantities and null units are
    missing; a unit that is no mass or volume falls through to the raw text.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        converter = Converter(factors)
        for batch in batches:
            keep, base, tenths = [], [], []
            quantity, unit, raw = (batch.column(i).to_pylist() for i in (2, 3, 4))
            for i, parts in enumerate(zip(quantity, unit, raw)):
                if (f := converter.of_parts(*parts)) is not None:
                    keep.append(i)
                    base.append(f[0])
                    tenths.append(f[1])
            rows = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(base, pa.string()), pa.array(tenths, pa.int64())],
                names=["recipe_id", "line_no", "base_unit", "amount_tenths"],
            )

    parts = df.select("recipe_id", "line_no", F.col("quantity").cast("double"), "unit", "raw")
    return parts.mapInArrow(convert, f"recipe_id string, line_no int, {_AMOUNT}")


def amounts_of_lists(df: DataFrame, key: str, lines: str, factors: list[tuple[str, str, float]]) -> DataFrame:
    """rec_id, line_no, base_unit, amount_tenths of the elements of an array of free texts that have an amount."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        converter = Converter(factors)
        for batch in batches:
            owner, number, base, tenths = [], [], [], []
            for i, texts in enumerate(batch.column(1).to_pylist()):
                for k, text in enumerate(texts or ()):
                    if (f := converter.of_text(text)) is not None:
                        owner.append(i)
                        number.append(k)
                        base.append(f[0])
                        tenths.append(f[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int32())),
                    pa.array(number, pa.int32()),
                    pa.array(base, pa.string()),
                    pa.array(tenths, pa.int64()),
                ],
                names=["rec_id", "line_no", "base_unit", "amount_tenths"],
            )

    narrow = df.select(F.col(key).cast("string").alias("rec_id"), F.col(lines).alias("_lines"))
    return narrow.mapInArrow(convert, f"rec_id string, line_no int, {_AMOUNT}")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rec_id, line_no, pos, base_unit, amount_tenths of every line with an amount of mass or volume.

    Parsing is a narrow stage that leaves only short typed rows; those are made distinct over the record key, so rows
    delivered again are reported once and no text is shuffled.
    """
    factors = unit_rows(spark, sf_dir)
    raw = amounts_of_lists(read_table(spark, sf_dir, "raw_recipes"), "raw_id", "ingredients", factors)
    raw = raw.select(F.lit(0).alias("src"), "rec_id", "line_no", F.lit(0).alias("pos"), "base_unit", "amount_tenths")
    parsed = amounts_of_parts(read_table(spark, sf_dir, "parsed_ingredients"), factors)
    parsed = parsed.select(
        F.lit(1).alias("src"), F.col("recipe_id").alias("rec_id"), "line_no", F.lit(0).alias("pos"), "base_unit", "amount_tenths"
    )
    values = explode_lines(
        read_table(spark, sf_dir, "source_recipes"), "recipe_id", "ingredient_lines", known_values(spark, sf_dir)
    )
    values = values.select("rec_id", "line_no", "pos", amount_of_text(factors)("val").alias("_f")).where("_f.base_unit is not null")
    values = values.select(F.lit(2).alias("src"), "rec_id", "line_no", "pos", "_f.base_unit", "_f.amount_tenths")
    names = F.array(*map(F.lit, ("raw_recipes.ingredients", "parsed_ingredients", "source_recipes.ingredient_lines")))
    rows = raw.unionByName(parsed).distinct().unionByName(values)
    return rows.withColumn("src", names[F.col("src")])
