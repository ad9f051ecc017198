"""Co-occurrence, positive pointwise information, graph neighbours, mined pairs, and diet rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.operators.blocks import Groups, edges, first, numbers, spans
from wicker.session import SENT_ROWS, bounded, ensure_checkpoint_dir, written


def cooccurrence(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """i < j, n: baskets that hold both items, over records (key, items) and the items of ``vocabulary`` (item).

    Lists are cut to the vocabulary before pairs are made inside the row, so nothing is joined per pair.
    """
    kept = records.select("key", F.explode("items").alias("item")).join(bounded(vocabulary), "item", "left_semi")
    lists = kept.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("l"))
    first = lists.select("l", F.posexplode("l").alias("p", "i"))
    return first.select("i", F.explode(F.expr("slice(l, p + 2, size(l))")).alias("j")).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))


def sppmi(pairs: DataFrame, shift: float = 1.0) -> DataFrame:
    """i, j, v: max(ln(n T / (r_i r_j)) - ln(shift), 0) of the mirrored counts; zeros are left out, a shift below 1 is an error."""
    if shift < 1:
        raise ValueError("shift must be at least 1")
    both = mirrored(pairs)
    rows = bounded(both.groupBy("i").agg(F.sum("n").alias("r")))
    total = rows.agg(F.sum("r").alias("t"))
    joined = both.join(rows, "i").join(rows.select(F.col("i").alias("j"), F.col("r").alias("rj")), "j").crossJoin(F.broadcast(total))
    value = F.log(F.col("n") * F.col("t") / (F.col("r") * F.col("rj"))) - F.log(F.lit(float(shift)))
    return joined.select("i", "j", F.greatest(value, F.lit(0.0)).alias("v")).where("v > 0")


def l2_normalized(matrix: DataFrame) -> DataFrame:
    """i, j, v with rows of length one."""
    return matrix.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("i"))))


#: Rows of a matrix that one task scores, and rows they are held against, at most, up to the evenness of the hash.
SCORED_ROWS = 32_768
HELD_ROWS = 65_536


def numbered(names: DataFrame) -> DataFrame:
    """item, id: a long for each distinct item, in the order of the names; written once, so the numbers hold."""
    ensure_checkpoint_dir(names.sparkSession)
    ordered = names.distinct().repartitionByRange("item").sortWithinPartitions("item")
    return ordered.select("item", F.monotonically_increasing_id().alias("id")).checkpoint()


def graph_neighbors(unit: DataFrame, pairs: DataFrame, k: int, beta: float = 100.0, lam: float = 0.5) -> DataFrame:
    """a, rank, b, score: cosine of the rows of a normalised matrix, shrunk by overlap / (overlap + beta), minus lam times the
    share of the most frequent companion; the first k with anything in common, ties by name.

    The rows are cut into blocks by hash, and each pair of blocks is one group: the products of a row are added up in NumPy
    over the columns of the other block, and only the first k of a block are shuffled, never a product.
    """
    spark, unit = unit.sparkSession, written(unit)
    names = numbered(unit.select(F.col("i").alias("item")).unionByName(unit.select(F.col("j").alias("item"))))
    n = names.count()
    b_blocks = max(1, -(-n // HELD_ROWS))
    a_blocks = max(1, -(-n // SCORED_ROWS), min(-(-spark.sparkContext.defaultParallelism // b_blocks), -(-n // 64)))
    names = F.broadcast(names) if n <= SENT_ROWS else names
    named = lambda c: names.select(F.col("item").alias(c), F.col("id").alias(f"{c}_id"))
    # both lists of a row are gathered at one exchange on its number: its values and its companions with their shares
    both = mirrored(pairs)
    most = bounded(both.groupBy("i").agg(F.max("n").alias("most")))
    share = both.join(most, "i").select("i", "j", F.lit(None).cast("double").alias("v"), (F.col("n") / F.col("most")).alias("c"))
    entries = unit.select("i", "j", "v", F.lit(None).cast("double").alias("c")).unionByName(share).join(named("j"), "j").join(named("i"), "i").select("i_id", "j_id", "v", "c")
    values = F.collect_list(F.when(F.col("v").isNotNull(), F.struct("j_id", "v")))
    shares = F.collect_list(F.when(F.col("c").isNotNull(), F.struct("j_id", "c")))
    lists = entries.groupBy("i_id").agg(values.alias("l"), shares.alias("m")).where(F.size("l") > 0).join(named("i"), "i_id")
    column = lambda of, part: F.transform(of, lambda x: x[part])
    whole = written(lists.select(F.col("i").alias("name"), F.col("i_id").alias("id"), column("l", "j_id").alias("at"), column("l", "v").alias("v"), column("m", "j_id").alias("near"), column("m", "c").alias("c")))
    groups = Groups(spark, a_blocks * b_blocks)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda m: F.pmod(F.xxhash64("id"), F.lit(m))
    left = whole.withColumn("_a", block(a_blocks)).withColumn("_b", every(b_blocks)).select(groups.key(F.col("_a") * b_blocks + F.col("_b")), "name", "id", "at", "v", "near", "c")
    right = whole.withColumn("_b", block(b_blocks)).withColumn("_a", every(a_blocks)).select(groups.key(F.col("_a") * b_blocks + F.col("_b")), "name", "id", "at", "v")

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids, held = numbers(rows, "id"), rows.column("name").combine_chunks()
        sizes = pc.list_value_length(rows.column("at").combine_chunks()).to_numpy()
        columns, at = np.unique(numbers(rows, "at"), return_inverse=True)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(len(columns) + 1))
        row, value = np.repeat(np.arange(len(ids)), sizes)[order], numbers(rows, "v")[order]
        out: tuple[list, ...] = [], [], []
        if len(ids) and asked.num_rows:
            cut = {c: edges(asked, c) for c in ("at", "near")}
            flat = {c: numbers(asked, c) for c in ("at", "v", "near", "c")}
            place, known = _found(columns, flat["at"])
            beside, real = _found(ids, flat["near"])
            me, here = _found(ids, numbers(asked, "id"))
            for a in range(asked.num_rows):
                x, y = cut["at"][a], cut["at"][a + 1]
                kept = known[x:y]
                mine, weights = place[x:y][kept], flat["v"][x:y][kept]
                if not len(mine):
                    continue
                lengths = cuts[mine + 1] - cuts[mine]
                took = spans(cuts[mine], lengths)  # all entries of these columns
                shared = np.bincount(row[took], minlength=len(ids))
                dot = np.bincount(row[took], value[took] * np.repeat(weights, lengths), minlength=len(ids))
                if here[a]:
                    shared[me[a]] = 0
                x, y = cut["near"][a], cut["near"][a + 1]
                beyond = np.zeros(len(ids))
                beyond[beside[x:y][real[x:y]]] = flat["c"][x:y][real[x:y]]
                hit = np.flatnonzero(shared)
                score = dot[hit] * shared[hit] / (shared[hit] + beta) - lam * beyond[hit]
                score = np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6 + 0.0
                best = first(k, -score)
                for part, add in zip(out, (np.full(len(best), a), hit[best], score[best])):
                    part.append(add)
        a, b, score = (np.concatenate(part) if part else np.zeros(0, kind) for part, kind in zip(out, (np.int64, np.int64, float)))
        own = asked.column("name").combine_chunks()
        return pa.table({"a": own.take(pa.array(a)), "b": held.take(pa.array(b)), "score": pa.array(score)})

    scored = groups.cogroup(left, right).applyInArrow(run, "a string, b string, score double")
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "rank", "b", "score")


def _found(sorted_: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each number asked for, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_, asked), max(len(sorted_) - 1, 0))
    return at, sorted_[at] == asked if len(sorted_) else np.zeros(len(asked), bool)


def mine_pairs(records: DataFrame, least: int = 4) -> DataFrame:
    """source, target: items that alone set apart two baskets of one group with at least ``least`` shared items.

    ``records`` holds grp, key, items. A basket is filed under its items less one each; two baskets differ in one item on
    either side exactly if they share such a key, so the join is on equal keys and never within a whole group.
    """
    sized = records.where(F.size("items") > least).select("grp", "key", F.array_sort("items").alias("l"))
    less = sized.select("grp", "key", F.explode("l").alias("item"), "l").select("grp", "key", "item", F.md5(F.concat_ws("\u0001", F.array_remove("l", F.col("item")))).alias("rest"))
    other = less.select("grp", "rest", F.col("key").alias("key2"), F.col("item").alias("target"))
    return less.join(other, ["grp", "rest"]).where("key <> key2 and item <> target").select(F.col("item").alias("source"), "target").distinct()


#: Categories of food words, their parents, phrases that overrule the words, and what diets forbid.
PARENTS = {"meat": "animal_product", "fish": "animal_product", "dairy": "animal_product", "egg": "animal_product", "honey": "animal_product"}
CATEGORY_WORDS = {
    "meat": "beef pork chicken bacon ham sausage lamb turkey veal lard gelatin",
    "fish": "fish salmon tuna shrimp anchovy cod crab prawn",
    "dairy": "milk butter cheese cream yogurt ghee casein whey",
    "egg": "egg",
    "honey": "honey",
    "gluten": "wheat barley rye bread pasta flour couscous semolina",
}
PHRASES = {
    "worcestershire sauce": ["fish"], "fish sauce": ["fish"], "soy sauce": ["gluten"], "oat": [], "almond flour": [],
    "coconut flour": [], "rice flour": [], "olive oil": [], "tofu": [], "eggplant": [],
}
DIETS = {"vegan": ["animal_product"], "vegetarian": ["meat", "fish"], "gluten_free": ["gluten"], "dairy_free": ["dairy"]}


def ancestors(parents: dict[str, str] = PARENTS) -> dict[str, list[str]]:
    """Each category with all its ancestors; cycles end where they close."""
    out = {}
    for c in {*parents, *parents.values(), *CATEGORY_WORDS}:
        chain = [c]
        while (up := parents.get(chain[-1])) is not None and up not in chain:
            chain.append(up)
        out[c] = sorted(chain)
    return out


def diet_tags(name: Column) -> Column:
    """Categories with ancestors of a canonical name; null where nothing is known about it."""
    up = ancestors()
    words = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for c, ws in CATEGORY_WORDS.items() for w in ws.split() for x in (w, up[c])])
    no_tags = F.array().cast("array<string>")
    phrase = F.lit(None).cast("array<string>")
    for p, cs in PHRASES.items():
        tags = sorted({u for c in cs for u in up[c]})
        phrase = F.when(name == p, F.array(*map(F.lit, tags)) if tags else no_tags).otherwise(phrase)
    found = F.filter(F.transform(F.split(name, " "), lambda w: F.element_at(words, w)), lambda t: t.isNotNull())
    return F.coalesce(phrase, F.when(F.size(found) > 0, F.array_sort(F.array_distinct(F.flatten(found)))))


def diet_allows(name: Column, diet: str | None) -> Column:
    """No diet allows everything; a diet allows what is known to hold none of its forbidden categories."""
    if not diet:
        return F.lit(True)
    if diet not in DIETS:
        raise ValueError(f"unknown diet {diet!r}; one of {sorted(DIETS)}")
    return F.coalesce(~F.arrays_overlap(diet_tags(name), F.array(*map(F.lit, DIETS[diet]))), F.lit(False))


def dietary_validity(substitutes: DataFrame, name: str, diets: list[str]) -> DataFrame:
    """diet, n, n_valid, rate: how many of the given substitutes keep each diet; a rate of one where there are none."""
    flags = F.array(*[F.struct(F.lit(d).alias("diet"), diet_allows(F.col(name), d).alias("ok")) for d in diets])
    counts = substitutes.select(F.inline(flags)).groupBy("diet").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("n_valid"))
    asked = substitutes.sparkSession.createDataFrame([(d,) for d in diets], "diet string")
    rate = F.coalesce(F.try_divide(F.col("n_valid").cast("double"), F.col("n")), F.lit(1.0))
    every = asked.join(counts, "diet", "left").fillna(0, ["n", "n_valid"])
    return every.select("diet", "n", "n_valid", F.round(rate, 6).alias("rate"))
