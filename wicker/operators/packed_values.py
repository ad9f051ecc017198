"""Several values packed in one field, one value per row with its position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicker.functions.segment import FoundValues, ValueDictionary, split_line, split_names
from wicker.session import ensure_checkpoint_dir, read_table

#: Known values go to the Python workers in parts of at most so many, each held by a worker one after the other.
PART = 1_000_000
_STRINGS = T.ArrayType(T.StringType())
_SPAN = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("a", T.IntegerType())])
_FOUND = T.StructType([T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("heads", _STRINGS)])


def known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """val: the names of the reference table and the values of its synonyms, each once."""
    table = read_table(spark, sf_dir, "ingredients").select("name", "synonyms").distinct()
    every = F.concat(F.array(F.coalesce("name", F.lit(""))), _names_udf("synonyms"))
    return table.select(F.explode(every).alias("val")).where(F.trim("val") != "").distinct()


@F.pandas_udf(_STRINGS)
def _names_udf(texts: pd.Series) -> pd.Series:
    return texts.map(split_names)


def _splitter(values: list[str], split: Callable):
    @F.pandas_udf(_STRINGS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = ValueDictionary(values)
        for texts in batches:
            yield texts.map(lambda t: split(t, known))

    return run.asNondeterministic()  # else the filter on empty arrays runs it a second time


def _finder(values: list[str]):
    @F.pandas_udf(_FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = ValueDictionary(values)
        for texts in batches:
            texts = texts.fillna("")
            spans = [[(b, a) for a, b in known.spans(t)] for t in texts]
            yield pd.DataFrame({"spans": spans, "heads": [known.kinds(t) for t in texts]})

    return run


def _found_splitter(split: Callable):
    @F.pandas_udf(_STRINGS)
    def run(texts: pd.Series, spans: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([split(t, FoundValues([(s["a"], s["b"]) for s in f], h)) for t, f, h in zip(texts, spans, heads)])

    return run.asNondeterministic()


def split_values(df: DataFrame, text: str, values: DataFrame, split: Callable, part: int = PART) -> DataFrame:
    """``df`` with ``vals``, the array of values of each text, cut by ``split`` with the dictionary ``values`` (val).

    The automaton of a dictionary of up to ``part`` values is built once per Python worker. A larger one is searched for in
    parts, one after the other: what each part finds is kept with its text, and the cut is chosen over all of it, so
    the result is the same.
    """
    spark = df.sparkSession
    parts = -(-values.count() // part) or 1
    if parts == 1:
        return df.withColumn("vals", _splitter([r[0] for r in values.collect()], split)(text))
    ensure_checkpoint_dir(spark)
    values = values.withColumn("_part", F.pmod(F.xxhash64("val"), F.lit(parts))).checkpoint()
    rows = df.withColumn("_spans", F.array().cast(T.ArrayType(_SPAN))).withColumn("_heads", F.array().cast(_STRINGS))
    for k in range(parts):
        find = _finder([r[0] for r in values.where(F.col("_part") == k).select("val").collect()])
        rows = rows.withColumn("_f", find(text))
        rows = rows.withColumn("_spans", F.concat("_spans", "_f.spans")).withColumn("_heads", F.array_union("_heads", "_f.heads"))
        rows = rows.drop("_f").checkpoint()
    rows = rows.withColumn("vals", _found_splitter(split)(text, F.array_sort("_spans"), "_heads"))
    return rows.drop("_spans", "_heads")


def explode_names(df: DataFrame, text: str, keys: list[str], values: DataFrame, part: int = PART) -> DataFrame:
    """keys, pos, val: the names of a packed field.

    Null, empty and blank fields give no rows; positions count from 0 over the kept values. Repeated rows give
    repeated results. Other columns of ``df`` are not read, so their names cannot clash.
    """
    rows = df.select(*keys, F.col(text).alias("_text"))
    return split_values(rows, "_text", values, split_names, part).select(*keys, F.posexplode("vals").alias("pos", "val"))


def explode_lines(df: DataFrame, key: str, lines: str, values: DataFrame, part: int = PART) -> DataFrame:
    """rec_id, line_no, pos, val: the ingredients of every line of an array of free lines.

    ``line_no`` is the 0-based index in the array, null and empty lines counted; null arrays and null, empty or blank
    lines give no rows. Rows delivered again with the same lines are counted once.
    """
    exploded = df.select(F.col(key).alias("rec_id"), F.posexplode(F.col(lines)).alias("line_no", "_line"))
    exploded = exploded.where(F.trim("_line") != "").distinct()
    return split_values(exploded, "_line", values, split_line, part).select("rec_id", "line_no", F.posexplode("vals").alias("pos", "val"))


def found(spark: SparkSession, sf_dir: str, part: int = PART) -> DataFrame:
    """src, rec_id, line_no, pos, val over the synonyms of the reference table and the lines of source recipes."""
    values = known_values(spark, sf_dir)
    table = read_table(spark, sf_dir, "ingredients").select("id", "synonyms").distinct()
    names = explode_names(table, "synonyms", ["id"], values, part)
    names = names.select(
        F.lit("ingredients.synonyms").alias("src"), F.col("id").alias("rec_id"), F.lit(0).alias("line_no"), "pos", "val"
    )
    lines = explode_lines(read_table(spark, sf_dir, "source_recipes"), "recipe_id", "ingredient_lines", values, part)
    lines = lines.select(F.lit("source_recipes.ingredient_lines").alias("src"), "rec_id", "line_no", "pos", "val")
    return names.unionByName(lines)
