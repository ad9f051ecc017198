"""Queries over text: normal forms, quantities, units, JSON cells, keys, addresses, wiki pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.functions import text as X
from wicker.functions.items import clean_item
from wicker.functions.quantity import GLYPHS
from wicker.plans.sqltext import SINGULAR, SPACE, clean, compose, plain, with_
from wicker.session import read_table
from wicker.sources import readers, wiki


def _names(spark, d):
    """Distinct clean item names."""
    items = read_table(spark, d, "raw_recipes").select(F.explode("ner").alias("x"))
    return items.select(clean_item(F.col("x")).alias("name")).where("name <> ''").distinct()


_NAMES = f"nm AS (SELECT DISTINCT {clean('x')} name FROM (SELECT unnest(ner) x FROM raw_recipes) WHERE {clean('x')} <> '')"
_SING = SINGULAR.replace("\n", " ")


def _singularize(spark, d):
    words = _names(spark, d).select(F.explode(F.split("name", " ")).alias("w")).distinct()
    plural = words.select("w").unionByName(words.select(F.concat("w", F.lit("s")).alias("w"))).unionByName(words.select(F.concat("w", F.lit("es")).alias("w"))).unionByName(words.select(F.concat("w", F.lit("ies")).alias("w"))).distinct()
    return plural.select("w", X.singularize(F.col("w")).alias("singular"))


def _canonicalize(spark, d):
    texts = read_table(spark, d, "realistic_inputs").select("text").where("text is not null").distinct()
    return texts.select("text", X.canonicalize(F.col("text")).alias("canonical"))


def _fold(spark, d):
    names = read_table(spark, d, "ingredients").select("name").distinct()
    return names.select("name", F.array_join(X.fold_tokens(F.col("name")), " ").alias("tokens"))


def _title_key(spark, d):
    rows = read_table(spark, d, "recipes").select("recipe_id", "title").distinct()
    return rows.select("recipe_id", X.title_key(F.col("title"), F.col("recipe_id")).alias("title_key"))


def _lines(spark, d):
    return read_table(spark, d, "parsed_ingredients").select("raw").where("raw is not null").distinct()


def _quantity(spark, d):
    q, rest = X.parse_quantity(F.col("raw"))
    return _lines(spark, d).select("raw", F.round(q, 9).alias("quantity"), rest.alias("rest"))


def _unit(spark, d):
    lines = read_table(spark, d, "parsed_ingredients").select(F.trim("unit").alias("text")).where("text is not null").distinct()
    unit, rest = X.parse_unit(F.col("text"))
    return lines.select("text", unit.alias("unit"), rest.alias("rest"))


def _json(spark, d):
    """Lists written to a cell as JSON, read back beside cells that hold other JSON or none."""
    lists = read_table(spark, d, "raw_recipes").select(F.concat(F.lit("r"), "raw_id").alias("key"), F.to_json("ner", {"ignoreNullFields": "false"}).alias("cell"))
    other = read_table(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("key"), F.col("props").alias("cell"))
    cells = readers.json_list(lists.unionByName(other).distinct(), "cell")
    return cells.select("key", F.size("cell").cast("long").alias("n"), F.array_join("cell", "|", "?").alias("items"))


def _dedupe(spark, d):
    rows = read_table(spark, d, "raw_recipes").select("title", "raw_id").distinct()
    return readers.first_by_title(rows, "title", "raw_id").select("title", "raw_id")


def _url(spark, d):
    rows = read_table(spark, d, "source_recipes").select("page").distinct()
    made = rows.select("page", X.page_url(F.col("page"), "https://wiki.invalid/").alias("url"))
    return made.select("page", "url", X.is_source_url(F.col("url"), "wiki.invalid").alias("ok"))


def _category(spark, d):
    texts = read_table(spark, d, "realistic_inputs").select(F.trim("text").alias("text")).where("text <> ''").distinct()
    return texts.select("text", X.phrase_category(F.col("text"), ["zuchini"], ["evoo"], ["minced beef", "double cream"]).alias("category"))


def _clean_markup(spark, d):
    pages = read_table(spark, d, "pages").select("page_id", "revision_id", "wikitext").where("wikitext is not null").distinct()
    return pages.select("page_id", "revision_id", wiki.clean_markup_udf("wikitext").alias("text"))


def _pages(spark, d):
    pages = read_table(spark, d, "pages").select("page_id", "title", "revision_id", "wikitext").distinct()
    return wiki.parse_pages(pages, prefix="Cookbook:")


def _normalize(spark, d):
    return _lines(spark, d).select("raw", X.normalize(F.col("raw")).alias("normal"))


_ASCII = "raw"
for _glyph, _value in GLYPHS.items():
    _ASCII = f"replace({_ASCII}, '{_glyph}', ' {_value.numerator}/{_value.denominator} ')"
_ASCII = f"replace({_ASCII}, '⁄', '/')"
_NUM = r"^(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)"

QUERIES = {
    "singularize": (
        _singularize,
        f"WITH {_NAMES}, b AS (SELECT DISTINCT unnest(string_split(name, ' ')) w FROM nm), a AS (SELECT w FROM b UNION SELECT w || 's' FROM b UNION SELECT w || 'es' FROM b UNION SELECT w || 'ies' FROM b) SELECT w, {_SING} singular FROM a",
    ),
    "normalize": (
        _normalize,
        f"SELECT DISTINCT raw, {plain(compose('raw'))} normal FROM parsed_ingredients WHERE raw IS NOT NULL",
    ),
    "canonicalize": (
        _canonicalize,
        f"""WITH t AS (SELECT DISTINCT text, {plain(compose("replace(text, '-', ' ')"))} n FROM realistic_inputs WHERE text IS NOT NULL)
        SELECT text, coalesce(array_to_string(list_transform(list_filter(string_split(n, ' '), lambda w: w <> ''), lambda w: {_SING}), ' '), '') canonical FROM t""",
    ),
    "fold_tokens": (
        _fold,
        f"""WITH t AS (SELECT DISTINCT name, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(name, '-', ' '))), '[^a-z0-9/.\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g')) n FROM ingredients)
        SELECT name, array_to_string(list_transform(string_split(n, ' '), lambda w: {_SING}), ' ') tokens FROM t""",
    ),
    "title_key": (
        _title_key,
        """SELECT DISTINCT recipe_id, CASE WHEN coalesce(k, '') = '' THEN 'id:' || recipe_id ELSE k END title_key FROM
        (SELECT recipe_id, trim(regexp_replace(regexp_replace(lower(title), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) k FROM recipes)""",
    ),
    "parse_quantity": (
        _quantity,
        f"""WITH t AS (SELECT DISTINCT raw, trim(regexp_replace(regexp_replace({_ASCII}, '[–—]', '-', 'g'), '{SPACE}+', ' ', 'g')) t FROM parsed_ingredients WHERE raw IS NOT NULL),"""
        """
        m AS (SELECT raw, t, regexp_matches(t, '^(?:(\\d+)\\s+)?(\\d+)\\s*/\\s*(\\d+)') f FROM t)
        SELECT raw, round(CASE WHEN f THEN coalesce(try_cast(regexp_extract(t, '^(?:(\\d+)\\s+)?(\\d+)\\s*/\\s*(\\d+)', 1) AS DOUBLE), 0)
          + try_cast(regexp_extract(t, '^(?:(\\d+)\\s+)?(\\d+)\\s*/\\s*(\\d+)', 2) AS DOUBLE) / nullif(try_cast(regexp_extract(t, '^(?:(\\d+)\\s+)?(\\d+)\\s*/\\s*(\\d+)', 3) AS DOUBLE), 0)
          ELSE try_cast(regexp_extract(t, '^(\\d+(?:\\.\\d+)?|\\.\\d+)', 1) AS DOUBLE) END, 9) quantity,
        trim(regexp_replace(trim(CASE WHEN f THEN regexp_replace(t, '^(?:(\\d+)\\s+)?(\\d+)\\s*/\\s*(\\d+)', '') ELSE regexp_replace(t, '^(\\d+(?:\\.\\d+)?|\\.\\d+)', '') END, ' '),
          '^\\s*(?:-|to\\b)\\s*(?:\\d+\\s+\\d+\\s*/\\s*\\d+|\\d+\\s*/\\s*\\d+|\\d+(?:\\.\\d+)?)', '')) rest FROM m""",
    ),
    "parse_unit": (
        _unit,
        "WITH m AS (SELECT map_from_entries([" + ", ".join(f"('{k}', '{v}')" for k, v in sorted(X.UNIT_WORDS.items())) + "]) u), "
        """t AS (SELECT DISTINCT trim(unit) text FROM parsed_ingredients WHERE unit IS NOT NULL),
        r AS (SELECT text, u[rtrim(regexp_extract(lower(text), '^(\\S+)', 1), '.')] unit FROM t, m)
        SELECT text, unit, CASE WHEN unit IS NULL THEN text ELSE trim(regexp_replace(text, '^\\S+\\s*', '')) END rest FROM r""",
    ),
    "json_list": (
        _json,
        """SELECT DISTINCT 'r' || raw_id AS key, coalesce(len(ner), 0)::BIGINT n, coalesce(array_to_string(list_transform(ner, lambda x: coalesce(x, '?')), '|'), '') items FROM raw_recipes
        UNION SELECT 'e' || event_id, 0, '' FROM events""",
    ),
    "dedupe_first": (
        _dedupe,
        """SELECT title, raw_id FROM (SELECT title, raw_id, row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY raw_id) r FROM (SELECT DISTINCT title, raw_id FROM raw_recipes)
        WHERE trim(title) <> '') WHERE r = 1""",
    ),
    "page_url": (
        _url,
        """SELECT DISTINCT page, 'https://wiki.invalid/' || replace(page, ' ', '_') url, true ok FROM source_recipes WHERE page IS NOT NULL AND regexp_matches(page, '^[A-Za-z:_ ]*$')
        UNION SELECT DISTINCT page, NULL, false FROM source_recipes WHERE page IS NULL""",
    ),
    "phrase_category": (
        _category,
        """SELECT DISTINCT t AS text, CASE WHEN lower(t) = 'zuchini' THEN 'typo' WHEN lower(t) = 'evoo' THEN 'abbreviation' WHEN lower(t) IN ('minced beef', 'double cream') THEN 'uk_us_synonym'
        WHEN regexp_matches(lower(t), '^[0-9]') OR starts_with(lower(t), 'a pinch') THEN 'with_quantity' WHEN contains(t, '/') OR contains(t, '&') THEN 'slash_or_symbol'
        WHEN len(list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda w: w <> '')) >= 2 THEN 'multiword' WHEN lower(t) LIKE '%s' THEN 'plural' ELSE 'plain' END category
        FROM (SELECT trim(text) t FROM realistic_inputs) WHERE t <> ''""",
    ),
    "clean_markup": (_clean_markup, None),
    "parse_pages": (_pages, None),
}
