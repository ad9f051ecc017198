"""Queries over baskets: postings, candidates, answers, rankings, dictionary look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicker.functions.items import clean_item
from wicker.functions.segment import split_names
from wicker.operators import answer, basket, blocks, ranking, resolve
from wicker.plans.sqltext import SINGULAR, clean, plain, with_
from wicker.session import read_table


def _held(spark, d):
    """Pantries as they are (no basket needs a staple or an unknown item), and the pack."""
    pack = answer.build_pack(spark, d)
    return basket.pantries(spark, d), pack


def _best(spark, d, arm, k=10):
    held, pack = _held(spark, d)
    return blocks.best(held, pack.baskets, arm, k)


def _arm(arm):
    return lambda spark, d: ranking.top_of_arm(_best(spark, d, arm), arm, 10)


def _gold(spark, d):
    rows = read_table(spark, d, "eval_pantries")
    return rows.select(basket.query_id().alias("qid"), F.col("gold_id").alias("rid")).distinct()


def _gold_rank(spark, d):
    held, pack = _held(spark, d)
    return blocks.gold_ranks(held, pack.baskets, _gold(spark, d))


def _visible(spark, d, limit=10):
    held, pack = _held(spark, d)
    gold = _gold(spark, d)
    shown = blocks.shown_before(held, pack.baskets, gold, answer.MAX_MISSING).where(F.col("before") < limit)
    hit = gold.join(shown.select("qid", F.lit(1).alias("v")), "qid", "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("v", F.lit(0)).cast("double")), 6).alias("visible_rate"))


def _keep(spark, d):
    return basket.worth_keeping(basket.basket_lines(spark, d), basket.dimension(spark, d).where("staple").select("id"))


def _packed(spark, d):
    return blocks.Packed(blocks.gathered_items(spark, d))


def _pool(spark, d):
    return basket.candidate_pool(basket.pantries(spark, d), _packed(spark, d), 25)


def _overlap(spark, d):
    baskets, held = _packed(spark, d), basket.pantries(spark, d)
    pool = basket.candidate_pool(held, baskets, 5)
    joined = pool.join(held.withColumnRenamed("ids", "held"), "qid").join(baskets.table.select("rid", F.col("id").alias("own")), "rid")
    return joined.select(
        "qid", "rank", "rid", F.round(F.col("matched") / F.size("own"), 6).alias("coverage"),
        F.array_join(F.array_sort(F.array_intersect("held", "own")), "|").alias("matched"),
        F.array_join(F.array_sort(F.array_except("own", "held")), "|").alias("missing"),
    )


def _df(spark, d):
    items = basket.baskets(spark, d).select(F.explode("items").alias("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("df"))


def _idf(spark, d):
    n = basket.baskets(spark, d).count()
    return basket.inverse_frequency(_df(spark, d), n).withColumn("idf", F.round("idf", 6))


def _popular(spark, d):
    pack = answer.build_pack(spark, d)
    return ranking.popular(pack.idf, spark.createDataFrame([(i,) for i in pack.staples], "id string"), 20)


def _keys(spark, d):
    """key, id of names: names are unique, so no key has two owners."""
    return basket.dimension(spark, d).select(F.col("name").alias("key"), "id")


def _suggest(spark, d):
    typed = read_table(spark, d, "realistic_inputs").select(F.substring(clean_item(F.col("text")), 1, 3).alias("q")).where("length(q) = 3 and q rlike '^[a-z]+$'").distinct()
    return ranking.suggest(_keys(spark, d), typed, 8)


def _resolve_names(spark, d):
    names = read_table(spark, d, "realistic_inputs").select(F.col("input_id").alias("qid"), F.lit(0).alias("pos"), clean_item(F.col("text")).alias("name")).where("name <> ''").distinct()
    keys = resolve.canonical_keys(basket.dimension(spark, d).select("id", F.col("name").alias("form")))
    return resolve.resolve_names(names, keys).select("qid", "name", "id")


def _vocabulary(spark, d, least=2):
    items = read_table(spark, d, "raw_recipes").select("raw_id", F.posexplode("ner").alias("i", "x")).distinct()
    counts = items.select(clean_item(F.col("x")).alias("item")).where("item <> ''").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).select("item", "n", F.size(F.split("item", " ")).alias("words"))


def _entries(spark, d):
    return basket.dimension(spark, d).select(F.col("name").alias("entry"))


def _rarest(spark, d):
    return resolve.rarest_token(_entries(spark, d))


def _match(spark, d):
    phrases = read_table(spark, d, "realistic_inputs").select(clean_item(F.col("text")).alias("phrase")).where("phrase <> ''").distinct()
    return resolve.match_longest(phrases, _entries(spark, d))


def _to_recipe(spark, d):
    """Each raw line to its best dictionary entry; the distinct entries of a recipe in line order."""
    lines = read_table(spark, d, "parsed_ingredients").select("recipe_id", "line_no", clean_item(F.col("canonical")).alias("phrase")).where("phrase is not null").distinct()
    matched = lines.join(resolve.match_longest(lines.select("phrase").distinct(), _entries(spark, d)), "phrase")
    first = matched.groupBy("recipe_id", "entry").agg(F.min("line_no").alias("line_no"))
    ordered = first.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "entry"))).alias("l"))
    return ordered.select("recipe_id", F.array_join(F.transform("l", lambda x: x["entry"]), "|").alias("canonical"))


def _resolve_lines(spark, d):
    rows = read_table(spark, d, "ingredients").select("id", "name", "synonyms", "staple").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the dictionary is too large to send to the workers")
    keys = {tuple(resolve.simple_tokens(form)): r["id"] for r in rows for form in [*split_names(r["synonyms"]), r["name"]] if form}
    staples = frozenset(r["id"] for r in rows if r["staple"] == "1")
    lines = read_table(spark, d, "source_recipes").select("recipe_id", F.posexplode("ingredient_lines").alias("line_no", "text")).distinct()
    out = resolve.resolve_lines(lines, "text", keys, staples)
    return out.select("recipe_id", "line_no", F.array_join("options", "|").alias("options"), "optional", "read")


def _lookup(spark, d):
    """Point look-up: lines and provenance of a recipe; nothing where either is missing."""
    core = read_table(spark, d, "recipes").select(F.concat(F.lit("wb-"), F.regexp_replace("recipe_id", "^r", "")).alias("recipe_id"), F.size("canonical").alias("n_items")).distinct()
    text = read_table(spark, d, "source_recipes").select("recipe_id", "url", "licence").distinct()
    return core.join(text, "recipe_id")


def _blocked(spark, d):
    return answer.blockers(spark, d, basket.pantries(spark, d))


_TOP = "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY {o})::INT rank, rid FROM cand"


def _arm_sql(order):
    return with_("cand") + f"SELECT * FROM ({_TOP.format(o=order)}) WHERE rank <= 10"


QUERIES = {
    "answer_items": (
        answer.items,
        with_("cand") + """SELECT qid, missing, rank, rid, have, total, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, missing
        ORDER BY score DESC, total, rid)::INT rank FROM cand WHERE missing <= 2) WHERE rank <= 10""",
    ),
    "core_keep": (_keep, with_("need") + "SELECT rid, count(*) n_needed FROM need GROUP BY 1"),
    "answer_group_counts": (
        answer.group_counts,
        with_("cand") + """SELECT qid, coalesce(sum((missing = 0)::INT), 0)::BIGINT make_now, coalesce(sum((missing = 1)::INT), 0)::BIGINT one_away,
        coalesce(sum((missing = 2)::INT), 0)::BIGINT two_away FROM (SELECT DISTINCT qid FROM q) LEFT JOIN cand USING (qid) GROUP BY 1""",
    ),
    "answer_unlocks": (
        answer.unlocks,
        with_("cand") + """SELECT qid, rank, id, n FROM (SELECT qid, id, count(*) n, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, id)::INT rank
        FROM cand JOIN need USING (rid) WHERE missing = 1 AND id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.qid = cand.qid AND h.id = need.id)
        GROUP BY qid, id) WHERE rank <= 10""",
    ),
    "answer_blockers": (
        _blocked,
        with_("held", "tot", more="""h AS (SELECT qid, rid, count(*) have FROM held JOIN need USING (id) GROUP BY 1, 2),
b AS (SELECT DISTINCT qid FROM held WHERE qid NOT IN (SELECT qid FROM h JOIN tot USING (rid) WHERE total - have <= 2)),
g AS (SELECT rid, id, count(*) gain FROM need WHERE id IS NOT NULL GROUP BY 1, 2)""")
        + """SELECT qid, rank, id, n FROM (SELECT b.qid, g.id, count(*) n, row_number() OVER (PARTITION BY b.qid ORDER BY count(*) DESC, g.id)::INT rank
        FROM b CROSS JOIN g JOIN tot USING (rid) LEFT JOIN h ON h.qid = b.qid AND h.rid = g.rid
        WHERE total - coalesce(have, 0) - gain <= 2 AND NOT EXISTS (SELECT 1 FROM held x WHERE x.qid = b.qid AND x.id = g.id) GROUP BY b.qid, g.id) WHERE rank <= 5""",
    ),
    "arm_overlap": (_arm("overlap"), _arm_sql("have DESC, total, rid")),
    "arm_idf_flat": (_arm("idf_flat"), _arm_sql("score DESC, total, rid")),
    "arm_shipped": (_arm("shipped"), _arm_sql("missing, score DESC, total, rid")),
    "arm_random_hash": (_arm("random"), _arm_sql("sha256('42:' || qid || ':' || rid), rid")),
    "gold_rank": (
        _gold_rank,
        with_("cand", more="g AS (SELECT DISTINCT gold_id || '#' || draw qid, gold_id rid FROM eval_pantries)")
        + """SELECT g.qid, r.rank_overlap, r.rank_idf_flat FROM g LEFT JOIN (SELECT qid, rid,
        row_number() OVER (PARTITION BY qid ORDER BY have DESC, total, rid) rank_overlap, row_number() OVER (PARTITION BY qid ORDER BY score DESC, total, rid) rank_idf_flat
        FROM cand) r USING (qid, rid)""",
    ),
    "visible_rate": (
        _visible,
        with_("cand", more="g AS (SELECT DISTINCT gold_id || '#' || draw qid, gold_id rid FROM eval_pantries)")
        + """SELECT count(*) n, round(avg((coalesce(rank, 99) <= 10)::INT), 6) visible_rate FROM g LEFT JOIN (SELECT qid, rid,
        row_number() OVER (PARTITION BY qid, missing ORDER BY score DESC, total, rid) rank FROM cand WHERE missing <= 2) USING (qid, rid)""",
    ),
    "candidate_pool": (_pool, with_("pool") + "SELECT * FROM pool"),
    "overlap_top_k": (
        _overlap,
        with_("pool") + """SELECT qid, rank, rid, round(matched / (matched + missing)::DOUBLE, 6) coverage, coalesce(m, '') matched, coalesce(x, '') missing FROM pool
        LEFT JOIN (SELECT qid, rid, string_agg(id, '|' ORDER BY id) m FROM q JOIN items USING (id) GROUP BY 1, 2) USING (qid, rid)
        LEFT JOIN (SELECT p.qid, p.rid, string_agg(i.id, '|' ORDER BY i.id) x FROM pool p JOIN items i USING (rid)
          WHERE rank <= 5 AND NOT EXISTS (SELECT 1 FROM q WHERE q.qid = p.qid AND q.id = i.id) GROUP BY 1, 2) USING (qid, rid) WHERE rank <= 5""",
    ),
    "item_df": (_df, with_("it") + "SELECT item, count(*) df FROM it GROUP BY 1"),
    "item_idf": (
        _idf,
        with_("it") + "SELECT item, count(*) df, round(ln(1 + (SELECT count(DISTINCT k) FROM it) / count(*)::DOUBLE), 6) idf FROM it GROUP BY 1",
    ),
    "popular_items": (
        _popular,
        with_("idf") + """SELECT row_number() OVER (ORDER BY round(w, 6), id)::INT rank, id, round(w, 6) idf FROM idf
        WHERE w > 0 AND id NOT IN (SELECT id FROM ing WHERE st) ORDER BY round(w, 6), id LIMIT 20""",
    ),
    "suggest_prefix": (
        _suggest,
        with_("ing", more=f"""t AS (SELECT DISTINCT substr({clean('text')}, 1, 3) q FROM realistic_inputs),
tq AS (SELECT q FROM t WHERE regexp_matches(q, '^[a-z]{{3}}$')),
h AS (SELECT q, id, min((CASE WHEN starts_with(nm, q) THEN 0 ELSE 1 END) * 100000 + length(nm)) s FROM tq JOIN ing ON contains(' ' || nm, ' ' || q) GROUP BY 1, 2)""")
        + "SELECT q, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s, id)::INT rank FROM h) WHERE rank <= 8",
    ),
    "resolve_names": (
        _resolve_names,
        with_("ing", more=f"""fo AS (SELECT DISTINCT x, {plain("strip_accents(replace(x, '-', ' '))")} f FROM (SELECT nm x FROM ing UNION SELECT {clean('text')} FROM realistic_inputs) WHERE x <> ''),
sg AS (SELECT x, coalesce(array_to_string(list_transform(list_filter(string_split(f, ' '), lambda w: w <> ''), lambda w: {SINGULAR}), ' '), '') AS key FROM fo),
n AS (SELECT DISTINCT input_id qid, {clean('text')} x FROM realistic_inputs)""")
        + "SELECT qid, n.x AS name, k.id FROM n JOIN sg USING (x) LEFT JOIN (SELECT key, id FROM ing JOIN sg ON x = nm WHERE key <> '') k USING (key)",
    ),
    "vocabulary": (
        _vocabulary,
        f"""SELECT item, count(*) n, len(string_split(item, ' '))::INT words FROM (SELECT {clean('x')} item FROM (SELECT DISTINCT raw_id, unnest(ner) x, unnest(range(len(ner))) i FROM raw_recipes))
        WHERE item <> '' GROUP BY 1 HAVING count(*) >= 2""",
    ),
    "rarest_token": (
        _rarest,
        with_("ing", more="""w AS (SELECT DISTINCT nm, unnest(string_split(nm, ' ')) t FROM ing), c AS (SELECT t, count(*) df FROM w GROUP BY 1)""")
        + "SELECT nm entry, t token, df FROM (SELECT nm, t, df, row_number() OVER (PARTITION BY nm ORDER BY df, t) r FROM w JOIN c USING (t)) WHERE r = 1",
    ),
    "match_longest": (
        _match,
        with_("ing", more=f"""p AS (SELECT DISTINCT {clean('text')} phrase FROM realistic_inputs WHERE {clean('text')} <> ''),
m AS (SELECT phrase, nm, string_split(phrase, ' ') pt, string_split(nm, ' ') ws FROM p CROSS JOIN ing),
c AS (SELECT * FROM m WHERE len(list_filter(list_distinct(ws), lambda w: len(list_filter(pt, lambda x: x = w)) < len(list_filter(ws, lambda x: x = w)))) = 0)""")
        + """SELECT phrase, nm entry FROM (SELECT phrase, nm, row_number() OVER (PARTITION BY phrase ORDER BY len(ws) DESC,
        regexp_matches(' ' || phrase || ' ', ' ' || array_to_string(list_transform(ws, lambda w: regexp_escape(w)), ' (.* )?') || ' ') DESC, length(nm) DESC, nm DESC) r FROM c) WHERE r = 1""",
    ),
    "to_recipe": (
        _to_recipe,
        with_("ing", more=f"""l AS (SELECT DISTINCT recipe_id, line_no, {clean('canonical')} phrase FROM parsed_ingredients WHERE canonical IS NOT NULL),
m AS (SELECT p.phrase, nm, string_split(p.phrase, ' ') pt, string_split(nm, ' ') ws FROM (SELECT DISTINCT phrase FROM l) p CROSS JOIN ing),
c AS (SELECT phrase, nm, row_number() OVER (PARTITION BY phrase ORDER BY len(ws) DESC, length(nm) DESC, nm DESC) r FROM m WHERE list_has_all(pt, ws)),
f AS (SELECT recipe_id, nm, min(line_no) n FROM l JOIN c USING (phrase) WHERE r = 1 GROUP BY 1, 2)""")
        + "SELECT recipe_id, string_agg(nm, '|' ORDER BY n, nm) canonical FROM f GROUP BY 1",
    ),
    "resolve_lines": (_resolve_lines, None),
    "recipe_lookup": (
        _lookup,
        """SELECT DISTINCT s.recipe_id, len(canonical)::INT n_items, url, licence FROM recipes
        JOIN source_recipes s ON s.recipe_id = 'wb-' || regexp_replace(recipes.recipe_id, '^r', '')""",
    ),
}
