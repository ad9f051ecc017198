"""Baskets of lines, postings, document frequencies and candidates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.functions.items import clean_item, record_items
from wicker.session import read_table


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name (clean), staple of the reference table."""
    return read_table(spark, sf_dir, "ingredients").select("id", clean_item(F.col("name")).alias("name"), (F.col("staple") == "1").alias("staple")).distinct()


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, items: one row per recipe."""
    return record_items(read_table(spark, sf_dir, "recipes"), "recipe_id", "canonical")


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, line_no, options (array of ids), optional, read: one row per line of a recipe.

    A line whose name is not in the reference table (a fixed dimension, broadcast) is unread and has no options.
    """
    return _with_options(spark, sf_dir, _named_lines(spark, sf_dir).distinct()).drop("name")


#: Entries of the reference table go to every task; their number is checked.
MAX_ITEMS = 1_000_000


def entries(spark: SparkSession, sf_dir: str) -> pa.Table:
    """id, name, staple (whether the id is one) of the reference table, in order."""
    known = dimension(spark, sf_dir).limit(MAX_ITEMS + 1).collect()
    if len(known) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items in the reference table")
    staples = {r["id"] for r in known if r["staple"]}
    rows = sorted({(r["id"], r["name"]) for r in known if r["id"] is not None}, key=lambda x: (x[0], x[1] or ""))
    return pa.table({"id": pa.array([i for i, _ in rows], pa.string()), "name": pa.array([n for _, n in rows], pa.string()), "staple": pa.array([i in staples for i, _ in rows], pa.bool_())})


def line_codes(spark: SparkSession, sf_dir: str, known: pa.Table) -> DataFrame:
    """rid, read, rest: the lines of each basket, moved once, by basket. One that ``known`` names is a number in ``read``, of line_no,
    the place in ``known`` (31 bits) and whether it is optional (one bit); all others are structs in ``rest``, each once."""
    names = known.select(["name"]).append_column("code", pa.array(range(known.num_rows), pa.int64()))
    lines = _named_lines(spark, sf_dir).join(F.broadcast(spark.createDataFrame(names.to_pylist(), "name string, code long")), "name", "left")
    fits = F.coalesce(F.col("code").isNotNull() & (F.col("line_no") >= 0), F.lit(False))
    number = F.col("line_no").cast("long") * (1 << 32) + F.col("code") * 2 + F.col("optional").cast("long")
    rest = F.struct(F.col("line_no").cast("long").alias("line"), "name", "code", "optional")
    return lines.groupBy("rid").agg(F.collect_list(F.when(fits, number)).alias("read"), F.collect_set(F.when(~fits, rest)).alias("rest"))


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, id, n: the distinct items of each basket, and how many there are."""
    from wicker.operators import blocks

    return blocks.item_rows_of(blocks.gathered_items(spark, sf_dir))


def _named_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "parsed_ingredients").select(
        F.col("recipe_id").alias("rid"), "line_no", clean_item(F.col("canonical")).alias("name"), F.coalesce(F.col("raw").contains("(optional)"), F.lit(False)).alias("optional")
    )


def _with_options(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    ids = dimension(spark, sf_dir).select("name", "id")
    read = F.col("id").isNotNull()
    options = F.when(read, F.array("id")).otherwise(F.array().cast("array<string>"))
    return lines.join(F.broadcast(ids), "name", "left").select("rid", "line_no", "name", options.alias("options"), "optional", read.alias("read"))


def worth_keeping(lines: DataFrame, staples: DataFrame) -> DataFrame:
    """rid, n_needed: the baskets with at least one line that is neither optional nor covered by a staple (id).

    An unread line is needed. Staples are a part of the reference table; Spark picks the join by their size."""
    options = lines.select("rid", "line_no", "optional", F.explode_outer("options").alias("id")).join(staples.select("id", F.lit(1).alias("s")), "id", "left")
    per = options.groupBy("rid", "line_no").agg(F.max("s").alias("s"), F.max("optional").alias("optional"))
    return per.where("s is null and not optional").groupBy("rid").agg(F.count(F.lit(1)).alias("n_needed"))


def postings(lines: DataFrame) -> DataFrame:
    """id, rid, line_no: one row per option of a line."""
    return lines.select(F.explode(F.array_distinct("options")).alias("id"), "rid", "line_no")


def document_frequency(lines: DataFrame) -> DataFrame:
    """id, df: baskets that name an item in any line; a basket counts once."""
    return lines.select("rid", F.explode("options").alias("id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(df: DataFrame, n: int) -> DataFrame:
    """id, df, idf = log(1 + n / df)."""
    return df.withColumn("idf", F.log(1 + F.lit(float(n)) / F.col("df")))


def candidates(queries: DataFrame, post: DataFrame) -> DataFrame:
    """qid, rid, have: baskets that share an item with a query, with the number of lines it satisfies.

    ``queries`` holds qid, id. A batch of queries is one equi-join on the item with partial counts before the shuffle; skewed
    items are split by adaptive execution.
    """
    hits = queries.distinct().join(post, "id").select("qid", "rid", "line_no").distinct()
    return hits.groupBy("qid", "rid").agg(F.count(F.lit(1)).alias("have"))


def sized(items: DataFrame) -> DataFrame:
    """``items`` (rid, id, distinct) with n, the number of items of the basket."""
    return items.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rid")))


def candidate_pool(queries: DataFrame, items, cap: int) -> DataFrame:
    """qid, rid, matched, missing, rank: per query the first ``cap`` baskets by coverage, fewest missing, id.

    ``items`` holds rid, id (distinct), and n if it has been counted, or is packed. A cap below zero is an error, zero gives nothing. The baskets are searched block by
    block, and each block gives its own first ``cap``.
    """
    from wicker.operators import blocks

    if cap < 0:
        raise ValueError("cap must not be negative")
    found = blocks.pools(queries, items if isinstance(items, blocks.Packed) or "n" in items.columns else sized(items), cap)
    scored = found.withColumn("missing", F.col("n") - F.col("matched"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.col("matched") / F.col("n")), "missing", "rid")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("qid", "rid", "matched", "missing", "rank")


def pantry_queries(spark: SparkSession, sf_dir: str, column: str = "pantry") -> DataFrame:
    """qid, id: the ids of every pantry."""
    rows = read_table(spark, sf_dir, "eval_pantries")
    return rows.select(query_id().alias("qid"), F.explode(column).alias("id")).distinct()


def pantries(spark: SparkSession, sf_dir: str, column: str = "pantry") -> DataFrame:
    """qid, ids: the rows of ``pantry_queries`` by query, moved once; null ids are left out."""
    rows = read_table(spark, sf_dir, "eval_pantries").select(query_id().alias("qid"), column)
    every = rows.groupBy("qid").agg(F.flatten(F.collect_list(column)).alias("ids")).where(F.size("ids") > 0)
    return every.select("qid", F.array_compact(F.array_sort(F.array_distinct("ids"))).alias("ids"))


def query_id() -> Column:
    return F.concat_ws("#", "gold_id", "draw")
