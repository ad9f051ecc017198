"""Queries over co-occurrence, substitution, diets, nutrition and learned models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from wicker.functions.items import clean_item
from wicker.functions.text import parse_unit
from wicker.operators import basket, evaluation, learning, nutrition, ranking, substitution
from wicker.operators.unit_convert import unit_rows
from wicker.plans.sqltext import clean, with_
from wicker.session import read_table, written

#: Least number of baskets of a vocabulary item, whatever the number of baskets.
LEAST_BASKETS = 2


def _vocabulary(spark, d):
    records = basket.baskets(spark, d)
    counts = records.select(F.explode("items").alias("item")).groupBy("item").count()
    return records, counts.where(F.col("count") >= LEAST_BASKETS).select("item")


def _pairs(spark, d):
    """Pair counts over the vocabulary; written once, since several stages read them."""
    records, vocabulary = _vocabulary(spark, d)
    return written(substitution.cooccurrence(records, vocabulary))


def _sppmi(spark, d):
    return substitution.sppmi(_pairs(spark, d))


def _rounded(df):
    return df.withColumn("v", F.round("v", 6))


def _graph(spark, d, k=5):
    pairs = _pairs(spark, d)
    return substitution.graph_neighbors(substitution.l2_normalized(substitution.sppmi(pairs)), pairs, k)


def _neighbors(vectors, k):
    """qid, item, rank: the nearest items by their vectors (item, vector)."""
    named = vectors.select(F.col("item").alias("vec_id"), F.col("vector").alias("embedding"))
    return ranking.knn(named, named, k).select(F.col("query_id").alias("qid"), F.col("vec_id").alias("item"), "rank", "similarity")


def _vectors(spark, d, size=100, steps=5):
    """item, vector of the trained item vectors of the vocabulary; written once, since they are read for queries and rows."""
    records, vocabulary = _vocabulary(spark, d)
    vectors = learning.item_vectors(records, size=size, steps=steps).getVectors().select(F.col("word").alias("item"), vector_to_array("vector").alias("vector"))
    return written(vectors.join(vocabulary, "item"))


def _two_lists(spark, d, k=20):
    """Two ranked lists per item: by graph and by trained vectors, ``k`` each."""
    pairs = _pairs(spark, d)
    graph = substitution.graph_neighbors(substitution.l2_normalized(substitution.sppmi(pairs)), pairs, k)
    graph = graph.select(F.col("a").alias("qid"), F.col("b").alias("item"), "rank")
    return graph, _neighbors(_vectors(spark, d), k).select("qid", "item", "rank")


def substitute_ids(spark, d, k=10):
    """a, b, score: for each entry of the reference table the entries that can stand for it, by the graph."""
    ids = basket.dimension(spark, d).select("id", "name")
    named = lambda c, as_: ids.select(F.col("id").alias(as_), F.col("name").alias(c))
    graph = _graph(spark, d, k).select(F.col("a").alias("x"), F.col("b").alias("y"), "score")
    return graph.join(named("x", "a"), "x").join(named("y", "b"), "y").groupBy("a", "b").agg(F.max("score").alias("score"))


def _plain_lists(spark, d):
    """Companions ranked by count, and by count over frequency."""
    both = substitution.mirrored(_pairs(spark, d))
    total = both.groupBy("j").agg(F.sum("n").alias("r"))
    rank = lambda df, *o: df.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(*o))).where("rank <= 8").select(F.col("i").alias("qid"), F.col("j").alias("item"), "rank")
    return rank(both, F.desc("n"), F.col("j")), rank(both.join(total, "j"), F.desc(F.round(F.col("n") / F.col("r"), 9)), F.col("j"))


def _blend(spark, d):
    a, b = _plain_lists(spark, d)
    return ranking.rank_blend(a, b, 0.5, 5)


def _rrf(spark, d):
    return ranking.reciprocal_rank_fusion(list(_plain_lists(spark, d)), 5)


def _context(spark, d):
    a, _ = _plain_lists(spark, d)
    sim = substitution.mirrored(_pairs(spark, d)).select(F.col("i").alias("a"), F.col("j").alias("b"), (F.col("n") / 100.0).alias("sim"))
    context = a.where("rank <= 2").select("qid", "item")
    return ranking.context_rerank(a.select("qid", "item", (F.col("rank") - 1).alias("rank")), context, sim, 0.5, 5)


def _list_metrics(spark, d):
    a, b = _plain_lists(spark, d)
    gold = b.where("rank <= 3").select("qid", "item")
    return evaluation.list_metrics(a, gold, 5, pessimistic=True)


def _pair_coverage(spark, d):
    _, b = _plain_lists(spark, d)
    vocabulary = basket.dimension(spark, d).select(F.col("name").alias("item"))
    return evaluation.pair_coverage(b.select("qid", "item"), vocabulary)


def _knn(spark, d):
    vectors = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    return ranking.knn(vectors.where("vec_id % 20 = 0"), vectors, 5)


def _mine(spark, d):
    grp = F.element_at(F.split(F.lower(F.trim("title")), r"\s+"), 1)
    rows = read_table(spark, d, "recipes").select(F.col("recipe_id").alias("key"), grp.alias("grp"), "canonical")
    from wicker.functions.items import clean_items

    records = rows.select("key", "grp", clean_items(F.col("canonical")).alias("items")).dropDuplicates(["key"])
    return substitution.mine_pairs(records, 3)


def _ancestors(spark, d):
    rows = [(c, a) for c, chain in substitution.ancestors().items() for a in chain]
    return spark.createDataFrame(rows, "category string, ancestor string")


def _diet(spark, d):
    names = basket.dimension(spark, d).select("id", "name")
    tags = F.coalesce(F.array_join(substitution.diet_tags(F.col("name")), ","), F.lit("unknown"))
    return names.select("id", tags.alias("tags"), *[substitution.diet_allows(F.col("name"), x).alias(x) for x in sorted(substitution.DIETS)])


def _diet_coverage(spark, d):
    names = basket.dimension(spark, d).select("name")
    return names.agg(F.round(F.coalesce(F.avg(substitution.diet_tags(F.col("name")).isNotNull().cast("double")), F.lit(0.0)), 6).alias("coverage"))


def _validity(spark, d):
    """How many of the five graph neighbours of each item would keep each diet, without a mask."""
    return substitution.dietary_validity(_graph(spark, d), "b", sorted(substitution.DIETS))


def _diet_sql() -> str:
    """Common table expression tg (nm, tags): the categories of names, null where nothing is known."""
    up = substitution.ancestors()
    texts = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    words = ", ".join(f"('{w}', {texts(up[c])})" for c, ws in substitution.CATEGORY_WORDS.items() for w in ws.split())
    phrases = ", ".join(f"('{p}', {texts(sorted({u for c in cs for u in up[c]}))})" for p, cs in substitution.PHRASES.items())
    return f"""wt(w, tags) AS (VALUES {words}), ph(nm, tags) AS (VALUES {phrases}),
sw AS (SELECT nm, list_sort(list_distinct(flatten(list(tags)))) tags FROM (SELECT DISTINCT nm, unnest(string_split(nm, ' ')) w FROM names) JOIN wt USING (w) GROUP BY 1),
tg AS (SELECT nm, CASE WHEN ph.nm IS NOT NULL THEN ph.tags ELSE sw.tags END tags FROM names LEFT JOIN ph USING (nm) LEFT JOIN sw USING (nm))"""


def _allows(diet: str) -> str:
    return f"coalesce(NOT list_has_any(tags, [{', '.join(repr(x) for x in substitution.DIETS[diet])}]), false)"


def _substitutes(spark, d, diet="vegan"):
    """Blended substitutes of every vocabulary item under a diet, the item itself left out."""
    graph, plain = _two_lists(spark, d)
    fused = ranking.rank_blend(graph, plain, 0.5, 20).where("qid <> item").where(substitution.diet_allows(F.col("item"), diet))
    order = Window.partitionBy("qid").orderBy("rank")
    return fused.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("qid", "rank", "item", "score")


def _svd(spark, d):
    vectors = learning.svd_vectors(substitution.sppmi(_pairs(spark, d)), 8)
    named = written(vectors.select(F.col("item").alias("vec_id"), F.col("vector").alias("embedding")))
    return ranking.knn(named, named, 3)


def _word2vec(spark, d):
    """The five nearest items of each vocabulary item by its trained vector."""
    return _neighbors(_vectors(spark, d), 5).select("qid", "rank", "item", "similarity")


# --- nutrition: parts are the foods, order lines their amounts


def _foods(spark, d):
    part = read_table(spark, d, "part")
    nutrients = part.select(F.col("p_partkey").alias("food_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("nutrient_id"), F.col("p_retailprice").alias("amount"), F.col("p_size").alias("ord"))
    portions = part.select(F.col("p_partkey").alias("food_id"), F.when(F.col("p_size") % 3 == 0, F.lit("cup")).alias("unit"), (F.col("p_size") % 2).cast("double").alias("amount"), F.col("p_size").cast("double").alias("grams"), F.col("p_size").alias("ord"))
    whitelist = spark.createDataFrame([(1, "energy", 1), (2, "energy", 0)], "nutrient_id int, key string, priority int")
    return nutrition.food_table(part.select(F.col("p_partkey").alias("food_id")), nutrients, portions, whitelist)


def _food_query(spark, d):
    return _foods(spark, d).select("food_id", F.round(F.element_at("per100g", "energy"), 4).alias("energy"), F.element_at("unit_grams", "cup").alias("cup"), F.element_at("unit_grams", "each").alias("each"))


def _amounts(spark, d):
    rows = read_table(spark, d, "parsed_ingredients").select("recipe_id", "line_no", clean_item(F.col("canonical")).alias("name"), "quantity", parse_unit(F.trim("unit"))[0].alias("unit")).dropDuplicates(["recipe_id", "line_no"])
    factors = unit_rows(spark, d)
    mass = {u: f for u, b, f in factors if b == "g"}
    volume = {u: f for u, b, f in factors if b == "ml" and u != "fl oz"}
    none = F.create_map().cast("map<string,double>")
    grams = nutrition.to_grams(F.col("quantity"), F.col("unit"), F.coalesce("name", F.lit("")), none, mass, volume)
    return rows.withColumn("grams", grams)


def _grams(spark, d):
    return _amounts(spark, d).select("recipe_id", "line_no", F.round(F.col("grams") + 1e-7, 3).alias("grams"))


def _lines_with_foods(spark, d):
    foods = basket.dimension(spark, d).select("name", F.length("id").alias("food_id"), F.length("name").cast("double").alias("energy"))
    joined = _amounts(spark, d).join(foods, "name", "left")
    return joined.select(F.col("recipe_id").alias("rid"), "food_id", "grams", F.when(F.col("food_id").isNotNull(), F.create_map(F.lit("energy"), F.col("energy"))).alias("per100g"))


def _totals(spark, d):
    return nutrition.recipe_totals(_lines_with_foods(spark, d), ["energy"]).select("rid", F.round(F.col("grams") + 1e-6, 2).alias("grams"), "n_lines", "n_matched", "n_massed", F.round(F.col("energy") + 1e-6, 2).alias("energy"))


def _coverage(spark, d):
    return nutrition.coverage(nutrition.recipe_totals(_lines_with_foods(spark, d), ["energy"]))


def _match_foods(spark, d):
    names = read_table(spark, d, "realistic_inputs").select(clean_item(F.col("text")).alias("name")).where("name <> ''").distinct()
    dim = basket.dimension(spark, d)
    foods = dim.select(F.col("id").alias("food_id"), F.col("name").alias("description"), F.col("id").alias("ord"))
    aliases = spark.createDataFrame([("sugar", "white_sugar")], "name string, food_id string")
    return nutrition.match_foods(names, foods, aliases)


def _gate(spark, d):
    return nutrition.impute_gate(_coverage(spark, d), 0.9, 0.5)


def _imputer(spark, d):
    rows = _totals(spark, d).select(F.concat(F.lit("r "), F.col("rid")).alias("text"), "energy")
    titles = read_table(spark, d, "recipes").select(F.col("recipe_id").alias("rid"), "title").distinct()
    rows = _totals(spark, d).join(titles, "rid").select("rid", F.col("title").alias("text"), "energy")
    model = learning.text_imputer(rows, "text", "energy")
    return model.transform(rows.where("energy is null and text is not null")).select("rid", F.round("prediction", 4).alias("energy"))


_V = f"""v AS (SELECT item FROM it GROUP BY 1 HAVING count(*) >= {LEAST_BASKETS}),
iv AS (SELECT k, item FROM it JOIN v USING (item)),
pr AS (SELECT a.item i, b.item j, count(*) n FROM iv a JOIN iv b ON a.k = b.k AND a.item < b.item GROUP BY 1, 2),
mr AS (SELECT i, j, n FROM pr UNION ALL SELECT j, i, n FROM pr)"""
_S = _V + """,
rs AS (SELECT i, sum(n) r FROM mr GROUP BY 1),
sp AS (SELECT i, j, v FROM (SELECT mr.i, mr.j, ln(n * (SELECT sum(r) FROM rs)::DOUBLE / (a.r * b.r)) v FROM mr JOIN rs a ON a.i = mr.i JOIN rs b ON b.i = mr.j) WHERE v > 0),
un AS (SELECT i, j, v / sqrt(sum(v * v) OVER (PARTITION BY i)) v FROM sp)"""
SIMILAR = _S
NEIGHBORS = """(SELECT x.i a, y.i b, round(sum(x.v * y.v) * count(*) / (count(*) + 100.0) - 0.5 * coalesce(any_value(c), 0), 6) score FROM un x JOIN un y ON x.j = y.j AND x.i <> y.i
  LEFT JOIN (SELECT i, j, n / max(n) OVER (PARTITION BY i)::DOUBLE c FROM mr) m ON m.i = x.i AND m.j = y.i GROUP BY 1, 2)"""
_L = _V + """,
la AS (SELECT i qid, j item, row_number() OVER (PARTITION BY i ORDER BY n DESC, j) rank FROM mr QUALIFY rank <= 8),
tt AS (SELECT j, sum(n) r FROM mr GROUP BY 1),
lb AS (SELECT i qid, j item, row_number() OVER (PARTITION BY i ORDER BY round(n / r::DOUBLE, 9) DESC, j) rank FROM mr JOIN tt USING (j) QUALIFY rank <= 8)"""
_AM = """un(form, sym) AS (VALUES {forms}), dens(w, x) AS (VALUES {dens}), pieces(w, x) AS (VALUES {pieces}),
am AS (SELECT recipe_id, line_no, any_value({nm}) nm, any_value(quantity) q, any_value(sym) u FROM parsed_ingredients
  LEFT JOIN un ON form = rtrim(regexp_extract(lower(trim(unit)), '^(\\S+)', 1), '.') GROUP BY 1, 2),
wd AS (SELECT nm, w, i FROM (SELECT DISTINCT nm FROM am WHERE nm IS NOT NULL), unnest(string_split(nm, ' ')) WITH ORDINALITY t(w, i)),
dn AS (SELECT nm, arg_min(x, i) d FROM wd JOIN dens USING (w) GROUP BY 1), pn AS (SELECT nm, arg_min(x, i) p FROM wd JOIN pieces USING (w) GROUP BY 1),
gr AS (SELECT recipe_id, line_no, nm, CASE WHEN u = 'pinch' THEN coalesce(q, 1) * 0.36::DOUBLE WHEN u = 'dash' THEN coalesce(q, 1) * 0.6::DOUBLE WHEN f.base_unit = 'g' THEN q * factor
  WHEN f.base_unit = 'ml' THEN q * factor * d WHEN u IS NULL OR u IN ('clove', 'can', 'slice', 'stick') THEN q * p END grams
  FROM am LEFT JOIN dn USING (nm) LEFT JOIN pn USING (nm) LEFT JOIN unit_factors f ON f.unit = u AND f.unit <> 'fl oz')"""


def _amount_sql() -> str:
    from wicker.functions.text import UNIT_WORDS

    values = lambda m: ", ".join(f"('{k}', {f'{v}::DOUBLE' if isinstance(v, float) else repr(v)})" for k, v in m.items())
    return _AM.format(forms=values(UNIT_WORDS), dens=values(nutrition.DENSITY), pieces=values(nutrition.PIECE_GRAMS), nm=clean("canonical"))


_TOT = _amount_sql() + """,
tot AS (SELECT recipe_id rid, coalesce(sum(grams), 0) grams, count(*) n_lines, count(ing.nm) n_matched, count(grams) n_massed,
  sum(length(ing.nm)::DOUBLE * grams / 100) energy FROM gr LEFT JOIN ing USING (nm) GROUP BY 1)"""

QUERIES = {
    "cooccurrence": (_pairs, with_("it", more=_V) + "SELECT i, j, n FROM pr"),
    "sppmi": (lambda s, d: _rounded(_sppmi(s, d)), with_("it", more=_S) + "SELECT i, j, round(v, 6) v FROM sp"),
    "l2norm": (lambda s, d: _rounded(substitution.l2_normalized(_sppmi(s, d))), with_("it", more=_S) + "SELECT i, j, round(v, 6) v FROM un"),
    "graph_neighbors": (
        _graph,
        with_("it", more=_S) + """SELECT a, rank, b, score FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INT rank FROM
        """ + NEIGHBORS + ") WHERE rank <= 5",
    ),
    "rank_blend": (
        _blend,
        with_("it", more=_L) + """SELECT qid, rank, item, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, gap, best, item)::INT rank FROM
        (SELECT qid, item, round(1 / (0.5 * ra + 0.5 * rb), 6) score, abs(ra - rb) gap, least(ra, rb) best FROM
        (SELECT qid, item, coalesce(la.rank, na + 1) ra, coalesce(lb.rank, nb + 1) rb FROM la FULL JOIN lb USING (qid, item)
        JOIN (SELECT qid, count(*) na FROM la GROUP BY 1) USING (qid) JOIN (SELECT qid, count(*) nb FROM lb GROUP BY 1) USING (qid)))) WHERE rank <= 5""",
    ),
    "rrf": (
        _rrf,
        with_("it", more=_L) + """SELECT qid, rank, item, score FROM (SELECT qid, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) score,
        row_number() OVER (PARTITION BY qid ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, item)::INT rank FROM (FROM la UNION ALL FROM lb) GROUP BY qid, item) WHERE rank <= 5""",
    ),
    "context_rerank": (
        _context,
        with_("it", more=_L) + """SELECT qid, rank, item, score FROM (SELECT qid, item, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item)::INT rank FROM
        (SELECT l.qid, l.item, round(1.0::DOUBLE / l.rank + 0.5 * coalesce(avg(m.n / 100.0::DOUBLE), 0), 6) score FROM la l LEFT JOIN
        (SELECT c.qid, mr.i, mr.n FROM la c JOIN mr ON mr.j = c.item WHERE c.rank <= 2) m ON m.qid = l.qid AND m.i = l.item GROUP BY l.qid, l.item, l.rank)) WHERE rank <= 5""",
    ),
    "list_metrics": (
        _list_metrics,
        with_("it", more=_L) + """SELECT count(*) n_queries, round(avg(h / 5.0::DOUBLE), 6) AS "precision", round(avg(h / g::DOUBLE), 6) recall, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) mrr FROM
        (SELECT b.qid, count(*) g, count(*) FILTER (WHERE a.rank <= 5) h, min(a.rank) f FROM lb b LEFT JOIN la a USING (qid, item) WHERE b.rank <= 3 GROUP BY 1)""",
    ),
    "pair_coverage": (
        _pair_coverage,
        with_("it", "ing", more=_L) + """SELECT count(*) n_pairs, count(*) FILTER (WHERE qid IN (SELECT nm FROM ing) AND item IN (SELECT nm FROM ing)) covered_pairs,
        round(count(DISTINCT CASE WHEN qid IN (SELECT nm FROM ing) THEN qid END) / count(DISTINCT qid)::DOUBLE, 6) source_coverage,
        round(count(DISTINCT CASE WHEN item IN (SELECT nm FROM ing) THEN item END) / count(DISTINCT item)::DOUBLE, 6) target_coverage FROM lb""",
    ),
    "knn_cosine": (
        _knn,
        """SELECT query_id, rank, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT rank FROM
        (SELECT a.vec_id query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 20 = 0)) WHERE rank <= 5""",
    ),
    "mine_pairs": (
        _mine,
        with_("it", more="""g AS (SELECT DISTINCT recipe_id k, regexp_extract(lower(trim(title)), '^(\\S+)', 1) grp FROM recipes),
l AS (SELECT grp, k, list(item) s FROM it JOIN g USING (k) GROUP BY 1, 2)""")
        + """SELECT DISTINCT list_filter(a.s, lambda x: NOT list_contains(b.s, x))[1] source, list_filter(b.s, lambda x: NOT list_contains(a.s, x))[1] target
        FROM l a JOIN l b ON a.grp = b.grp AND a.k <> b.k AND len(a.s) = len(b.s) WHERE len(list_intersect(a.s, b.s)) >= 3 AND len(list_intersect(a.s, b.s)) = len(a.s) - 1""",
    ),
    "ancestors": (
        _ancestors,
        """WITH RECURSIVE p(c, up) AS (VALUES ('meat', 'animal_product'), ('fish', 'animal_product'), ('dairy', 'animal_product'), ('egg', 'animal_product'), ('honey', 'animal_product')),
        a AS (SELECT c category, c ancestor FROM (SELECT c FROM p UNION SELECT up FROM p UNION SELECT 'gluten') UNION SELECT category, up FROM a JOIN p ON c = ancestor) SELECT * FROM a""",
    ),
    "diet_mask": (
        _diet,
        with_("ing", more="names AS (SELECT DISTINCT nm FROM ing), " + _diet_sql())
        + "SELECT id, CASE WHEN tags IS NULL THEN 'unknown' ELSE coalesce(array_to_string(tags, ','), '') END tags, "
        + ", ".join(f"{_allows(x)} {x}" for x in sorted(substitution.DIETS)) + " FROM ing JOIN tg USING (nm)",
    ),
    "diet_coverage": (
        _diet_coverage,
        with_("ing", more="names AS (SELECT DISTINCT nm FROM ing), " + _diet_sql())
        + "SELECT round(coalesce(avg((tags IS NOT NULL)::INT), 0), 6) coverage FROM (SELECT id, tags FROM ing JOIN tg USING (nm))",
    ),
    "dietary_validity": (
        _validity,
        with_("it", more=_S + ", gn AS (SELECT b nm FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) r FROM " + NEIGHBORS + ") WHERE r <= 5), names AS (SELECT DISTINCT nm FROM gn), " + _diet_sql())
        + " UNION ALL ".join(
            f"SELECT '{x}' diet, count(*) n, coalesce(sum({_allows(x)}::INT), 0)::BIGINT n_valid, round(coalesce(avg({_allows(x)}::INT), 1), 6) rate FROM gn JOIN tg USING (nm)"
            for x in sorted(substitution.DIETS)
        ),
    ),
    "substitutes": (_substitutes, None),
    "svd_neighbors": (_svd, None),
    "word2vec": (_word2vec, None),
    "first_last_wins": (
        _food_query,
        """SELECT p_partkey food_id, round(p_retailprice, 4) energy, CASE WHEN p_size > 0 AND p_size % 3 = 0 THEN p_size::DOUBLE / CASE WHEN p_size % 2 = 0 THEN 1 ELSE 1 END END cup,
        CASE WHEN p_size > 0 AND p_size % 3 <> 0 THEN p_size::DOUBLE END AS each FROM part""",
    ),
    "jaccard_match": (
        _match_foods,
        with_("ing", more=f"""n AS (SELECT DISTINCT {clean('text')} name FROM realistic_inputs WHERE {clean('text')} <> ''),
tk AS (SELECT x, list_distinct(list_filter(string_split_regex(replace(x, ',', ' '), '\\s+'), lambda w: w <> '')) ws FROM (SELECT name x FROM n UNION SELECT nm FROM ing)),
f AS (SELECT id, nm FROM ing),
s AS (SELECT name, id, round(len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))::DOUBLE, 9) s FROM n JOIN tk a ON a.x = name
  JOIN (SELECT id, ws FROM f JOIN tk ON x = nm) b ON len(list_intersect(a.ws, b.ws)) > 0),
b AS (SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, id) r FROM s WHERE s >= 0.34) WHERE r = 1)""")
        + """SELECT name, CASE WHEN name = 'sugar' THEN 'white_sugar' ELSE coalesce(f.id, b.id) END food_id,
        CASE WHEN name = 'sugar' THEN 'alias' WHEN f.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'similar' ELSE 'none' END how FROM n LEFT JOIN f ON f.nm = name LEFT JOIN b USING (name)""",
    ),
    "to_grams": (_grams, "WITH " + _amount_sql() + " SELECT recipe_id, line_no, round(grams + 1e-7, 3) grams FROM gr"),
    "nutrient_totals": (_totals, with_("ing", more=_TOT) + "SELECT rid, round(grams + 1e-6, 2) grams, n_lines, n_matched, n_massed, round(energy + 1e-6, 2) energy FROM tot"),
    "coverage_median": (
        _coverage,
        with_("ing", more=_TOT) + """SELECT round(sum(n_matched) / sum(n_lines)::DOUBLE, 6) match_coverage, round(sum(n_massed) / sum(n_lines)::DOUBLE, 6) mass_coverage,
        round(avg((n_massed / n_lines::DOUBLE >= 0.5)::INT), 6) covered_recipes, round(median(1 - n_massed / n_lines::DOUBLE), 6) median_unresolved FROM tot""",
    ),
    "impute_gate": (_gate, "SELECT *, coalesce(match_coverage < 0.9 OR median_unresolved > 0.5, false) impute FROM (" + with_("ing", more=_TOT) + """SELECT round(sum(n_matched) / sum(n_lines)::DOUBLE, 6) match_coverage, round(sum(n_massed) / sum(n_lines)::DOUBLE, 6) mass_coverage,
        round(avg((n_massed / n_lines::DOUBLE >= 0.5)::INT), 6) covered_recipes, round(median(1 - n_massed / n_lines::DOUBLE), 6) median_unresolved FROM tot""" + ")"),
    "imputer": (_imputer, None),
}
