"""Readers with fixed schemas: recipe CSV with JSON cells, JSON lines, packs, pair and label files, food tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())
RAW_CSV = "title string, ingredients string, directions string, link string, source string, NER string"
RECIPE_JSON = "recipe_id string, title string, canonical array<string>"
PACK_JSON = (
    "format int, info struct<version:string,commit:string,corpus_fingerprint:string,recipes:int>, "
    "ingredients array<struct<id:string,name:string,staple:boolean,idf:double>>, keys map<string,string>, "
    "recipes array<struct<id:string,title:string,page:string,rev:bigint,lines:array<struct<t:string,o:array<string>,opt:boolean,r:boolean>>>>"
)


def list_cell(c: Column) -> Column:
    """A JSON list of texts in a cell; empty where the cell is no such list."""
    return F.coalesce(F.from_json(c, _STRINGS), F.array().cast(_STRINGS))


def json_list(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, list_cell(F.col(column)))


def read_raw_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Raw recipes: quotes doubled inside quotes, cells over several lines, empty cells as "", lists decoded, titles trimmed.

    ``limit`` keeps the first rows in file order; 0 or less keeps none.
    """
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=RAW_CSV)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    if limit is not None:
        df = df.limit(max(limit, 0))
    return df.select(
        F.trim(text("title")).alias("title"), list_cell(F.col("ingredients")).alias("ingredients"), list_cell(F.col("directions")).alias("directions"),
        list_cell(F.col("NER")).alias("ner"), text("link").alias("link"), text("source").alias("source"),
    )


def read_recipes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Clean recipes from JSON lines; only the columns needed are decoded, blank lines are skipped."""
    df = spark.read.schema(RECIPE_JSON).json(path).where("recipe_id is not null")
    return df if limit is None else df.limit(max(limit, 0))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """pos, item of one JSON array."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", _STRINGS)).alias("pos", "item"))


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """id, name, synonyms (array), staple, provenance of the reference table."""
    df = spark.read.csv(path, header=True, schema="id string, name string, synonyms string, staple string, provenance string")
    parts = F.filter(F.transform(F.split(F.coalesce("synonyms", F.lit("")), r"[|]"), lambda s: F.trim(s)), lambda s: s != "")
    return df.select("id", "name", parts.alias("synonyms"), (F.col("staple") == "1").alias("staple"), "provenance")


def check_dimension(df: DataFrame, provenance: tuple[str, ...]) -> DataFrame:
    """The rows, with an error for a repeated or malformed id or an unknown provenance."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    bad = F.when(n > 1, "repeated id ").when(~F.col("id").rlike("^[a-z0-9_]+$"), "malformed id ").when(~F.col("provenance").isin(*provenance), "unknown provenance of ")
    checked = df.withColumn("_bad", bad)
    return checked.withColumn("id", F.when(F.col("_bad").isNull(), F.col("id")).otherwise(F.raise_error(F.concat("_bad", F.coalesce("id", F.lit("null")))))).drop("_bad")


def read_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ingredients, keys, lines) of a pack document, plain or gzipped."""
    doc = spark.read.schema(PACK_JSON).json(path, multiLine=True)
    ingredients = doc.select(F.inline("ingredients"))
    keys = doc.select(F.explode("keys").alias("key", "id"))
    recipes = doc.select(F.explode("recipes").alias("r")).select("r.id", "r.title", F.posexplode("r.lines").alias("line_no", "l"))
    lines = recipes.select(F.col("id").alias("rid"), "title", "line_no", F.col("l.t").alias("text"), F.coalesce("l.o", F.array().cast(_STRINGS)).alias("options"), F.col("l.opt").alias("optional"), F.col("l.r").alias("read"))
    return ingredients, keys, lines


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Wiki pages from (gzipped) JSON lines."""
    return spark.read.schema("page_id long, title string, revision_id long, timestamp string, wikitext string").json(path)


def read_pairs(spark: SparkSession, path: str, canonical) -> DataFrame:
    """source, targets: a CSV of pairs after ``canonical`` (a column function); empty ends are dropped."""
    df = spark.read.csv(path, header=True, schema="source string, target string")
    pairs = df.select(canonical(F.col("source")).alias("source"), canonical(F.col("target")).alias("target"))
    return pairs.where("source <> '' and target <> ''").groupBy("source").agg(F.sort_array(F.collect_set("target")).alias("targets"))


def canonical_pairs(df: DataFrame, source: str, target: str, canonical) -> DataFrame:
    """source, target: distinct pairs of two columns, without empty ends and pairs of a thing with itself, sorted."""
    pairs = df.select(canonical(F.col(source)).alias("source"), canonical(F.col(target)).alias("target"))
    return pairs.where("source <> '' and target <> '' and source <> target").distinct().orderBy("source", "target")


def read_curated(spark: SparkSession, path: str, canonical) -> DataFrame:
    """source, targets: a JSON map from a name to a list; anything but a list of texts is an error, of two equal sources the later."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", T.MapType(T.StringType(), _STRINGS), {"mode": "FAILFAST"})
    rows = whole.select(F.posexplode(F.map_entries(parsed)).alias("pos", "e")).select("pos", canonical(F.col("e.key")).alias("source"), "e.value")
    last = rows.groupBy("source").agg(F.max_by("value", "pos").alias("v"))
    targets = last.select("source", F.explode("v").alias("t")).select("source", canonical(F.col("t")).alias("target")).where("target <> ''")
    return targets.groupBy("source").agg(F.sort_array(F.collect_set("target")).alias("targets"))


def read_labels(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """line_id, groups (array of arrays), optional, not_an_ingredient; unknown, repeated, missing and contradictory rows are errors."""
    df = spark.read.csv(path, header=True, schema="line_id string, names string, optional string, not_an_ingredient string")
    parts = lambda c, sep: F.filter(F.transform(F.split(c, sep), lambda s: F.trim(s)), lambda s: s != "")
    groups = F.transform(parts(F.coalesce("names", F.lit("")), ";"), lambda g: parts(g, r"[|]"))
    flag = lambda c: F.coalesce(F.lower(F.trim(F.col(c))).isin("1", "true", "yes"), F.lit(False))
    rows = df.select("line_id", groups.alias("groups"), flag("optional").alias("optional"), flag("not_an_ingredient").alias("not_an_ingredient"))
    n = F.count(F.lit(1)).over(Window.partitionBy("line_id"))
    marked = rows.withColumn("n", n).join(expected.select("line_id", F.lit(True).alias("known")), "line_id", "full")
    bad = (
        F.when(F.col("known").isNull(), "unknown line ").when(F.col("n").isNull(), "no label for ").when(F.col("n") > 1, "repeated line ")
        .when(F.col("not_an_ingredient") & (F.size("groups") > 0), "contradictory label of ").when(~F.col("not_an_ingredient") & (F.size("groups") == 0), "blank label of ")
    )
    checked = F.when(bad.isNull(), F.col("line_id")).otherwise(F.raise_error(F.concat(bad, "line_id")))
    return marked.select(checked.alias("line_id"), "groups", "optional", "not_an_ingredient")


def read_food_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four CSV tables of a food database; numbers that can't be read are null."""
    read = lambda name, schema: spark.read.csv(f"{folder}/{name}.csv", header=True, schema=schema)
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    foods = read("food", "fdc_id string, data_type string, description string")
    nutrients = read("food_nutrient", "id string, fdc_id string, nutrient_id string, amount string")
    portions = read("food_portion", "id string, fdc_id string, amount string, measure_unit_id string, modifier string, gram_weight string")
    ids = lambda c: F.expr(f"try_cast(trim({c}) as int)")
    order = F.expr("try_cast(id as long)")
    return {
        "units": read("measure_unit", "id string, name string"),
        "foods": foods.select(ids("fdc_id").alias("food_id"), "data_type", "description"),
        "nutrients": nutrients.select(ids("fdc_id").alias("food_id"), ids("nutrient_id").alias("nutrient_id"), number("amount").alias("amount"), order.alias("ord")),
        "portions": portions.select(ids("fdc_id").alias("food_id"), "measure_unit_id", "modifier", number("amount").alias("amount"), number("gram_weight").alias("grams"), order.alias("ord")),
    }


def first_by_title(df: DataFrame, title: str, order: str) -> DataFrame:
    """The first row of each title (trimmed, lower case) by ``order``; rows without a title are dropped."""
    key = F.lower(F.trim(F.col(title)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.where(F.trim(F.col(title)) != "").withColumn("_r", rank).where("_r = 1").drop("_r")


def stable_id(*columns: str) -> Column:
    """An id that stays the same when other rows come or go."""
    return F.sha2(F.concat_ws("\u001f", *columns), 256)


def checked_files(spark: SparkSession, path: str, pinned: dict[str, str]) -> DataFrame:
    """name, sha256 of the files under ``path``; a file without its pinned digest is an error, and so is one never pinned."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    table = F.create_map(*[F.lit(x) for pair in pinned.items() for x in pair]) if pinned else F.create_map().cast("map<string,string>")
    digest = F.sha2("content", 256)
    wrong = F.coalesce(F.element_at(table, name) != digest, F.lit(True))
    return files.select(name.alias("name"), F.when(wrong, F.raise_error(F.concat(F.lit("digest of "), name))).otherwise(digest).alias("sha256"))
