"""How distinctive a term is per record: document frequencies, tf-idf and the rarest items of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.functions.items import record_items
from wicker.session import read_table, written

#: An item is heavy if it is more than this part of all item rows; there are then at most as many heavy items.
HEAVY_DEN = 2_000


def document_frequency(records: DataFrame) -> DataFrame:
    """item, df: in how many records each item stands (partial counts before the shuffle)."""
    return records.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("df"))


def weigh(spark: SparkSession, records: DataFrame) -> DataFrame:
    """key, item, df, n_items, n_all of ``records`` (key, items).

    The frequencies are joined back to the item rows: the heavy items, at most ``HEAVY_DEN`` of them, by a broadcast, so
    that no key of the shuffled join of the rest holds more than one of ``HEAVY_DEN`` rows.
    """
    records = written(records)  # read for the counts and again for the items
    counts = written(document_frequency(records))
    total = counts.agg(F.sum("df")).first()[0] or 0
    n_all = records.count()
    heavy = counts.where(F.col("df") * HEAVY_DEN > total)
    light = counts.where(F.col("df") * HEAVY_DEN <= total)
    items = records.select("key", F.size("items").alias("n_items"), F.explode("items").alias("item"))
    marked = items.join(F.broadcast(heavy), "item", "left")
    known = marked.where("df is not null")
    rest = marked.where("df is null").drop("df").join(light, "item")
    return known.unionByName(rest).withColumn("n_all", F.lit(n_all))


def _score(df: str = "df") -> F.Column:
    """Term frequency (an item counts once, so one of n) times the smoothed logarithm of the inverse frequency."""
    return (F.lit(1.0) / F.col("n_items")) * (F.log((F.col("n_all") + 1) / (F.col(df) + 1)) + 1)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recipe_id, item, df, tfidf of every item of every recipe.

    Null lists, null and blank items give no rows; an item counts once per recipe, a recipe delivered again once.
    """
    records = record_items(read_table(spark, sf_dir, "recipes"), "recipe_id", "canonical")
    return weigh(spark, records).select(F.col("key").alias("recipe_id"), "item", "df", F.round(_score(), 6).alias("tfidf"))


def found(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    """recipe_id, item_rank, item: the ``top`` items of each recipe that stand in the fewest recipes, ties by item."""
    records = record_items(read_table(spark, sf_dir, "recipes"), "recipe_id", "canonical")
    best = Window.partitionBy("key").orderBy("df", "item")
    ranked = weigh(spark, records).withColumn("item_rank", F.row_number().over(best)).where(F.col("item_rank") <= top)
    return ranked.select(F.col("key").alias("recipe_id"), "item_rank", "item")


_ITEMS = """
WITH rec AS (SELECT DISTINCT recipe_id, unnest(canonical) x FROM recipes),
it AS (SELECT DISTINCT recipe_id, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) item FROM rec
       WHERE trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''),
c AS (SELECT item, count(*) df FROM it GROUP BY 1)"""

SQL = {
    "p5_weights": _ITEMS
    + """, n AS (SELECT count(DISTINCT recipe_id) n FROM it), s AS (SELECT recipe_id, count(*) k FROM it GROUP BY 1)
SELECT recipe_id, item, df, round((1.0::DOUBLE / k) * (ln((n.n + 1)::DOUBLE / (df + 1)) + 1), 6) tfidf
FROM it JOIN c USING (item) JOIN s USING (recipe_id), n""",
    "p5_found": _ITEMS
    + """, r AS (SELECT recipe_id, item, row_number() OVER (PARTITION BY recipe_id ORDER BY df, item)::INT item_rank
FROM it JOIN c USING (item)) SELECT recipe_id, item_rank, item FROM r WHERE item_rank <= 3""",
}
