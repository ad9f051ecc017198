"""Command line: what can be made from held items, and what can stand in for an item.

    python -m wicker.cli cook --have "egg,milk" --k 5 --tables FOLDER
    python -m wicker.cli substitute butter --diet vegan --k 5 --tables FOLDER
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.functions.items import clean_item
from wicker.operators import answer, basket, ranking, substitution
from wicker.session import build_session, read_table


def cook(spark: SparkSession, tables: str, names: list[str], k: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(items, unlocks, unknown names) of one pantry; names that are no items are reported as typed."""
    typed = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "typed string, pos int").withColumn("name", clean_item(F.col("typed")))
    found = typed.join(basket.dimension(spark, tables), "name", "left")
    unknown = [r["typed"] for r in found.where("id is null").orderBy("pos").collect()]
    pack = answer.build_pack(spark, tables)
    held = answer.held_items(found.where("id is not null").select(F.lit("pantry").alias("qid"), "id"), pack)
    close = answer.near(held, pack)
    titles = read_table(spark, tables, "recipes").select(F.col("recipe_id").alias("rid"), "title").dropDuplicates(["rid"])
    items = close.join(titles, "rid").orderBy("missing", F.desc("score"), "total", "rid").limit(max(k, 0))
    open_ = close.where("missing = 1").join(pack.need.where("id is not null").select("rid", "id"), "rid").join(held.select("id"), "id", "left_anti")
    return items, open_.groupBy("id").count().orderBy(F.desc("count"), "id").limit(5), unknown


def substitutes(spark: SparkSession, tables: str, name: str, diet: str | None, k: int) -> DataFrame:
    """item, score: companions of an item in the context graph that the diet allows, the item itself left out."""
    records = basket.baskets(spark, tables)
    vocabulary = records.select(F.explode("items").alias("item")).groupBy("item").count().where("count >= 5").select("item")
    pairs = substitution.cooccurrence(records, vocabulary)
    near = substitution.graph_neighbors(substitution.l2_normalized(substitution.sppmi(pairs)), pairs, max(4 * k, 20))
    own = near.where(F.col("a") == name.strip().lower()).where(substitution.diet_allows(F.col("b"), diet))
    return own.orderBy("rank").limit(max(k, 0)).select(F.col("b").alias("item"), "score")


def line_status(optional: F.Column, staple: F.Column, read: F.Column, held: F.Column) -> F.Column:
    """optional, assumed (a staple), check (unread), have or missing: the first that holds."""
    return F.when(optional, "optional").when(staple, "assumed").when(~read, "check").when(held, "have").otherwise("missing")


def missing_text(options: F.Column) -> F.Column:
    return F.array_join(options, " or ")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wicker")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("cook")
    a.add_argument("--have", required=True)
    b = commands.add_parser("substitute")
    b.add_argument("ingredient")
    b.add_argument("--diet")
    for p in (a, b):
        p.add_argument("--k", type=int, default=5)
        p.add_argument("--tables", required=True)
    args = parser.parse_args(argv)
    if not os.path.isdir(args.tables):
        print(f"no tables in {args.tables}", file=sys.stderr)
        return 1
    spark = build_session()
    if args.command == "cook":
        items, unlocks, unknown = cook(spark, args.tables, [n for n in args.have.split(",") if n.strip()], args.k)
        for r in items.collect():
            print(f"{r['missing']} missing  {r['score']:.3f}  {r['title']}")
        for r in unlocks.collect():
            print(f"{r['id']} would complete {r['count']}")
        if unknown:
            print("unknown: " + ", ".join(unknown))
    else:
        for r in substitutes(spark, args.tables, args.ingredient, args.diet, args.k).collect():
            print(f"{r['score']:.4f}  {r['item']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
