"""Amounts joined with a food table: matching, grams, totals and honest coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grams of tiny units, densities in g/ml and grams per piece by food word.
TINY_GRAMS = {"pinch": 0.36, "dash": 0.6}
DENSITY = {
    "water": 1.0, "milk": 1.03, "juice": 1.05, "broth": 1.0, "stock": 1.0, "wine": 0.99, "vinegar": 1.01, "oil": 0.92, "honey": 1.42,
    "syrup": 1.37, "flour": 0.53, "sugar": 0.85, "salt": 1.22, "rice": 0.85, "butter": 0.96, "cream": 1.0, "sauce": 1.05,
}
PIECE_GRAMS = {"egg": 50.0, "clove": 3.0, "onion": 110.0, "tomato": 123.0, "apple": 182.0, "banana": 118.0, "carrot": 61.0, "potato": 213.0, "lemon": 58.0}
PORTION_UNITS = ("clove", "can", "slice", "stick")
LEAST_SIMILARITY = 0.34


def _literal(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def first_word(name: Column, values: dict[str, float]) -> Column:
    """The value of the first word of a name that has one."""
    table = _literal(values)
    return F.get(F.filter(F.transform(F.split(name, " "), lambda w: F.element_at(table, w)), lambda v: v.isNotNull()), F.lit(0))


def to_grams(quantity: Column, unit: Column, name: Column, unit_grams: Column, mass: dict[str, float], volume: dict[str, float]) -> Column:
    """Grams of an amount, null where it can't be told.

    Tiny units count once without a quantity; masses convert; volumes use the food's own portion, else the density of the
    name; pieces use the food's own unit, its "each", else the weight per piece of the name.
    """
    own = F.element_at(unit_grams, unit)
    pieces = F.coalesce(own, F.element_at(unit_grams, F.lit("each")), first_word(name, PIECE_GRAMS))
    return (
        F.when(unit.isin(*TINY_GRAMS), F.coalesce(quantity, F.lit(1.0)) * F.element_at(_literal(TINY_GRAMS), unit))
        .when(unit.isin(*mass), quantity * F.element_at(_literal(mass), unit))
        .when(unit.isin(*volume), quantity * F.coalesce(own, F.element_at(_literal(volume), unit) * first_word(name, DENSITY)))
        .when(unit.isNull() | unit.isin(*PORTION_UNITS), quantity * pieces)
    )


def food_table(foods: DataFrame, nutrients: DataFrame, portions: DataFrame, whitelist: DataFrame) -> DataFrame:
    """food_id, per100g (map), unit_grams (map).

    ``nutrients`` (food_id, nutrient_id, amount, ord): of several rows of a key the best priority in ``whitelist``
    (nutrient_id, key, priority; higher wins) counts, of those the last. ``portions`` (food_id, unit, amount, grams, ord):
    grams above 0, a missing or zero amount is 1, an unknown unit is "each", and the first row of a unit counts.
    """
    listed = nutrients.join(F.broadcast(whitelist), "nutrient_id").where("amount is not null")
    values = listed.groupBy("food_id", "key").agg(F.max_by("amount", F.struct("priority", "ord")).alias("v"))
    per = values.groupBy("food_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias("per100g"))
    amount = F.when(F.coalesce(F.col("amount"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("amount"))
    one = portions.where("grams > 0").select("food_id", F.coalesce("unit", F.lit("each")).alias("unit"), (F.col("grams") / amount).alias("g"), "ord")
    firsts = one.groupBy("food_id", "unit").agg(F.min_by("g", "ord").alias("g"))
    units = firsts.groupBy("food_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("unit", "g")))).alias("unit_grams"))
    empty = F.create_map().cast("map<string,double>")
    joined = foods.select("food_id").distinct().join(per, "food_id", "left").join(units, "food_id", "left")
    return joined.select("food_id", F.coalesce("per100g", empty).alias("per100g"), F.coalesce("unit_grams", empty).alias("unit_grams"))


def match_foods(names: DataFrame, foods: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, food_id, how: alias, else exact (description or its part before the comma, first food in order), else the most
    similar by words (Jaccard of at least 0.34, ties to the smaller id), else null.

    ``foods`` holds food_id, description (canonical), ord. Similarity is a join on shared words: without one it is zero.
    """
    head = F.trim(F.split(F.col("description"), ",")[0])
    exact = foods.select(F.explode(F.array_distinct(F.array("description", head))).alias("name"), "food_id", "ord")
    exact = exact.groupBy("name").agg(F.min_by("food_id", "ord").alias("exact_id"))
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(c, ",", " "), r"\s+"), lambda w: w != ""))
    a = names.select("name", tokens(F.col("name")).alias("ws")).select("name", F.size("ws").alias("na"), F.explode("ws").alias("w"))
    b = foods.select("food_id", tokens(F.col("description")).alias("ws")).select("food_id", F.size("ws").alias("nb"), F.explode("ws").alias("w"))
    shared = a.join(b, "w").groupBy("name", "food_id", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    score = F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 9)
    best = shared.withColumn("s", score).where(F.col("s") >= LEAST_SIMILARITY).groupBy("name").agg(F.min(F.struct((-F.col("s")).alias("ns"), "food_id")).alias("m"))
    joined = names.join(aliases.select("name", F.col("food_id").alias("alias_id")), "name", "left").join(exact, "name", "left").join(best, "name", "left")
    how = F.when(F.col("alias_id").isNotNull(), "alias").when(F.col("exact_id").isNotNull(), "exact").when(F.col("m").isNotNull(), "similar").otherwise("none")
    return joined.select("name", F.coalesce("alias_id", "exact_id", "m.food_id").alias("food_id"), how.alias("how"))


def recipe_totals(lines: DataFrame, named: list[str]) -> DataFrame:
    """rid, grams, n_lines, n_matched, n_massed and a column per named nutrient, null where no line has it.

    ``lines`` holds rid, food_id, grams, per100g; a nutrient adds up as per100g * grams / 100 over lines with grams.
    """
    base = lines.groupBy("rid").agg(
        F.coalesce(F.sum("grams"), F.lit(0.0)).alias("grams"), F.count(F.lit(1)).alias("n_lines"),
        F.count("food_id").alias("n_matched"), F.count("grams").alias("n_massed"),
    )
    parts = lines.where("grams is not null").select("rid", "grams", F.explode("per100g").alias("key", "v"))
    sums = parts.groupBy("rid").pivot("key", named).agg(F.sum(F.col("v") * F.col("grams") / 100))
    return base.join(sums, "rid", "left")


def coverage(totals: DataFrame, least: float = 0.5) -> DataFrame:
    """match, mass (both over all lines), share of recipes of at least ``least`` mass coverage, median unresolved part."""
    massed = F.try_divide(F.col("n_massed"), F.col("n_lines"))
    return totals.agg(
        F.round(F.coalesce(F.try_divide(F.sum("n_matched"), F.sum("n_lines")), F.lit(0.0)), 6).alias("match_coverage"),
        F.round(F.coalesce(F.try_divide(F.sum("n_massed"), F.sum("n_lines")), F.lit(0.0)), 6).alias("mass_coverage"),
        F.round(F.avg((massed >= least).cast("double")), 6).alias("covered_recipes"),
        F.round(F.median(1 - massed), 6).alias("median_unresolved"),
    )


def impute_gate(report: DataFrame, least_match: float, most_unresolved: float) -> DataFrame:
    """The coverage report with ``impute``: true where too few lines match a food, or too much mass is unresolved."""
    tripped = (F.col("match_coverage") < least_match) | (F.col("median_unresolved") > most_unresolved)
    return report.withColumn("impute", F.coalesce(tripped, F.lit(False)))
