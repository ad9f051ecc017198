"""Deterministic splits and samples, metrics over rankings, and paired bootstrap intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_mod(c: Column, n: int) -> Column:
    """The 128-bit number of the MD5 of a text, modulo n (up to 10,000), by 32-bit parts."""
    h = F.md5(c)
    part = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")
    out = F.lit(0).cast("long")
    for i in range(4):
        out = F.pmod(out * ((1 << 32) % n) + part(i), F.lit(n))
    return out


def is_train(record_id: Column, share: int = 80) -> Column:
    return md5_mod(record_id, 100) < share


def hash_order(seed: str, c: Column, kind: str = "md5") -> Column:
    text = F.concat(F.lit(f"{seed}:"), c)
    return F.md5(text) if kind == "md5" else F.sha2(text, 256)


def hash_sample(df: DataFrame, key: str, n: int, seed: str, kind: str = "md5") -> DataFrame:
    """The n keys that come first by hash; smaller samples are prefixes of larger ones."""
    return df.select(key).distinct().orderBy(hash_order(seed, F.col(key), kind), key).limit(max(n, 0))


def group_split(records: DataFrame, seed: str) -> DataFrame:
    """key, split: groups (key, grp) ordered by hash, the first half dev, the rest test.

    The place of a group is the number of groups in earlier hash buckets plus its place in its own, so no window runs over
    all groups.
    """
    groups = records.select("grp").distinct().withColumn("h", hash_order(seed, F.col("grp"), "sha256"))
    groups = groups.withColumn("b", F.substring("h", 1, 2))
    sizes = groups.groupBy("b").agg(F.count(F.lit(1)).alias("n"))  # at most 256 rows
    every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("b", F.coalesce(F.sum("n").over(every), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inner = F.row_number().over(Window.partitionBy("b").orderBy("h", "grp"))
    placed = groups.withColumn("i", inner).join(F.broadcast(offsets), "b")
    split = F.when(F.col("base") + F.col("i") <= F.floor(F.col("total") / 2), "dev").otherwise("test")
    return records.join(placed.select("grp", split.alias("split")), "grp").select("key", "split")


def alternate_split(inputs: DataFrame, seed: str) -> DataFrame:
    """text, split: inside the categories in order, by hash, dev and test in turn, the turn carried over categories."""
    h = hash_order(seed, F.col("text"), "sha256")
    sizes = inputs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("category", F.coalesce(F.sum("n").over(Window.orderBy("category").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    i = F.row_number().over(Window.partitionBy("category").orderBy(h, "text"))
    placed = inputs.withColumn("i", i).join(F.broadcast(base), "category")
    return placed.select("text", "category", F.when((F.col("base") + F.col("i")) % 2 == 1, "dev").otherwise("test").alias("split"))


def mask_count(total: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((total + 2) / 4)).cast("long")


def held_out_count(n: Column, part: float = 0.3) -> Column:
    """Items to hide of n: a part rounded half to even, at least one, and one stays."""
    return F.greatest(F.lit(1), F.least(n - 1, F.bround(n * part).cast("long")))


def mask_items(records: DataFrame, seed: str, least: int = 4) -> DataFrame:
    """key, held, hidden: the items of each record with at least ``least``, some of them hidden by hash."""
    kept = records.where(F.size("items") >= least).withColumn("n_hidden", held_out_count(F.size("items")))
    ranked = F.array_sort(F.transform("items", lambda x: F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), "key", F.lit(":"), x), 256).alias("h"), x.alias("x"))))
    order = F.transform(ranked, lambda r: r["x"])
    hidden = F.expr("slice(o, 1, int(n_hidden))")
    return kept.withColumn("o", order).withColumn("hidden", F.array_sort(hidden)).select("key", F.array_sort(F.array_except("items", "hidden")).alias("held"), "hidden")


def distractors(queries: DataFrame, items: DataFrame, d: int, seed: str, weighted: bool) -> DataFrame:
    """qid, rank, id: d items per query that are not its own, uniform or weighted by frequency, without replacement.

    ``queries`` holds qid and own (array). Every query looks at the whole item dimension (checked, fixed) with a hash-derived
    number u; the weighted draw orders by -ln(u) / df.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "qid", F.lit(":"), "id"), 256), 1, 12), 16, 10).cast("double")
    u = (h + 1) / float(1 << 48)
    key = -F.log(u) / F.col("df") if weighted else u
    pool = queries.crossJoin(F.broadcast(items)).where(~F.array_contains("own", F.col("id")))
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round(key, 12), "id")))
    return ranked.where(F.col("rank") <= d).select("qid", "rank", "id")


def recall_mrr(ranks: DataFrame, k: int) -> DataFrame:
    """n, recall and mrr at k over (qid, rank); a null rank is a miss."""
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    return ranks.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("recall"),
        F.round(F.avg(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"),
    )


def precision_recall_f1(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 (micro) over rows of two arrays, predicted and gold; 0 where undefined."""
    sums = pairs.agg(
        F.sum(F.size(F.array_intersect("predicted", "gold"))).alias("tp"), F.sum(F.size(F.array_except("predicted", "gold"))).alias("fp"),
        F.sum(F.size(F.array_except("gold", "predicted"))).alias("fn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def nearest_rank(values: DataFrame, group: str, value: str, parts: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """group, n, pNN, max: the value at index min(n - 1, floor(p n)) of the sorted values.

    Found by counting in a window of distinct values, so a group is not collected into an array.
    """
    counts = values.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    upto = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    index = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p))
    return upto.groupBy(group).agg(
        F.max("n").alias("n"),
        *[F.min(F.when(F.col("upto") > index(p), F.col(value))).alias(f"p{round(p * 100)}") for p in parts],
        F.max(value).alias("max"),
    )


def fingerprint(records: DataFrame, parts: int = 256) -> DataFrame:
    """n, digest: an order-sensitive digest of records (key, items): hashes per hash bucket in key order, then of the buckets."""
    row = F.sha2(F.concat_ws("\u001f", F.col("key"), F.concat_ws("\u001e", "items")), 256)
    hashed = records.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("b"), "key", row.alias("h"))
    bucket = hashed.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")).alias("x"), F.sum(F.conv(F.substring("h", 16, 8), 16, 10).cast("long")).alias("s"))
    lines = F.array_sort(F.collect_list(F.struct("b", "x", "s")))  # one entry per bucket
    text = F.array_join(F.transform(lines, lambda r: F.concat_ws(":", r["x"].cast("string"), r["s"].cast("string"))), ",")
    return bucket.agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("digest"))


def cluster_bootstrap(rows: DataFrame, resamples: int = 1_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """grp, mean, lo, hi, n_clusters of paired differences (grp, cluster, diff), clusters resampled with replacement.

    Clusters are summed before anything is gathered. Each partition of clusters draws Poisson(1) counts for every resample
    and sends one vector of sums and one of counts, so no group is collected, however many clusters it has.
    """
    sums = rows.groupBy("grp", "cluster").agg(F.sum("diff").alias("s"), F.count(F.lit(1)).alias("n"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, list] = {}
        for batch in batches:
            for grp, part in batch.groupby("grp", sort=True):
                t = total.setdefault(grp, [0.0, 0, 0, np.zeros(resamples), np.zeros(resamples)])
                t[0] += part["s"].sum()
                t[1] += int(part["n"].sum())
                t[2] += len(part)
                for cluster, s, n in zip(part["cluster"], part["s"], part["n"]):
                    key = hashlib.blake2b(f"{seed}:{grp}:{cluster}".encode(), digest_size=8).digest()
                    draws = np.random.default_rng(int.from_bytes(key, "little")).poisson(1.0, resamples)
                    t[3] += draws * s
                    t[4] += draws * n
        yield pd.DataFrame(
            [(g, t[0], t[1], t[2], t[3].tolist(), t[4].tolist()) for g, t in total.items()], columns=["grp", "s", "n", "clusters", "rs", "rn"]
        )

    parts = sums.mapInPandas(partial, "grp string, s double, n long, clusters long, rs array<double>, rn array<double>")
    wide = parts.select("grp", "s", "n", "clusters", F.posexplode(F.arrays_zip("rs", "rn")).alias("i", "r"))
    resample = wide.groupBy("grp", "i").agg(F.sum("r.rs").alias("rs"), F.sum("r.rn").alias("rn")).select("grp", F.try_divide("rs", "rn").alias("m"))
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    bounds = resample.groupBy("grp").agg(F.percentile("m", F.array(F.lit(low), F.lit(high))).alias("q"))
    whole = parts.groupBy("grp").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("clusters").alias("n_clusters"))
    return whole.join(bounds, "grp").select(
        "grp", F.round(F.col("s") / F.col("n"), 6).alias("mean"), F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"), "n_clusters"
    )


def list_metrics(ranked: DataFrame, gold: DataFrame, k: int, pessimistic: bool = False) -> DataFrame:
    """n_queries, precision, recall, mrr of ranked lists (qid, item, rank) against gold pairs (qid, item).

    Precision divides by k, recall by the gold of the query, mrr looks at the whole list. Queries without a list count as
    zeros if ``pessimistic``, else they are left out.
    """
    sizes = gold.distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("g"))
    hits = ranked.join(gold.distinct(), ["qid", "item"], "left_semi").groupBy("qid").agg(F.sum((F.col("rank") <= k).cast("long")).alias("h"), F.min("rank").alias("first"))
    queries = sizes if pessimistic else sizes.join(ranked.select("qid").distinct(), "qid", "left_semi")
    per = queries.join(hits, "qid", "left").fillna(0, ["h"])
    return per.agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(F.coalesce(F.avg(F.col("h") / k), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(F.avg(F.col("h") / F.col("g")), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
    )


def pair_coverage(gold: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """n_pairs, covered_pairs, source_coverage, target_coverage of gold pairs (qid, item) by a vocabulary (item)."""
    known = vocabulary.select("item").distinct()
    marked = gold.distinct().join(known.select(F.col("item").alias("qid"), F.lit(1).alias("s")), "qid", "left").join(known.select("item", F.lit(1).alias("t")), "item", "left")
    share = lambda key, flag: F.round(F.try_divide(F.countDistinct(F.when(F.col(flag) == 1, F.col(key))), F.countDistinct(key)), 6)
    return marked.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum(F.col("s") * F.col("t")), F.lit(0)).alias("covered_pairs"),
        share("qid", "s").alias("source_coverage"), share("item", "t").alias("target_coverage"),
    )


def pool_metrics(ranks: DataFrame, k: int) -> DataFrame:
    """n, ceiling (gold in the pool), recall and mrr at k over all queries and over those with their gold in the pool.

    ``ranks`` holds qid, rank (null where the gold was not in the pool).
    """
    inside = F.col("rank").isNotNull()
    hit = F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")
    value = F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)
    return ranks.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(inside.cast("double")), 6).alias("ceiling"), F.round(F.avg(hit), 6).alias("recall"), F.round(F.avg(value), 6).alias("mrr"),
        F.round(F.avg(F.when(inside, hit)), 6).alias("recall_in_pool"), F.round(F.avg(F.when(inside, value)), 6).alias("mrr_in_pool"),
    )


def group_scores(rows: DataFrame) -> DataFrame:
    """precision, recall, f1 of predicted groups against gold groups (arrays of arrays of ids).

    A predicted group is right if its ids lie inside one gold group, a gold group is found if any prediction touches it.
    """
    right = F.size(F.filter("predicted", lambda p: F.exists("gold", lambda g: F.size(F.array_except(p, g)) == 0)))
    touched = F.size(F.filter("gold", lambda g: F.exists("predicted", lambda p: F.arrays_overlap(p, g))))
    sums = rows.agg(F.sum(right).alias("r"), F.sum(F.size("predicted")).alias("np"), F.sum(touched).alias("t"), F.sum(F.size("gold")).alias("ng"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("r"), F.col("np")), ratio(F.col("t"), F.col("ng"))
    return sums.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def stratified_sheet(lines: DataFrame, size: int, seed: str) -> DataFrame:
    """line_id, stratum, split: ``size`` lines per stratum in the order hard, rare, random, none taken twice, half of each dev.

    ``lines`` holds line_id, hard (boolean), rarity (higher is rarer); inside a stratum lines come by hash.
    """
    h = hash_order(seed, F.col("line_id"), "sha256")
    taken, out = None, None
    for stratum, part in (("hard", lines.where("hard")), ("rare", lines.orderBy(F.desc("rarity"), h).limit(4 * size)), ("random", lines)):
        free = part if taken is None else part.join(taken, "line_id", "left_anti")
        picked = free.withColumn("h", hash_order(seed, F.col("line_id"), "sha256")).orderBy("h", "line_id").limit(size).select("line_id", "h", F.lit(stratum).alias("stratum"))
        taken = picked.select("line_id") if taken is None else taken.unionByName(picked.select("line_id"))
        out = picked if out is None else out.unionByName(picked)
    order = F.row_number().over(Window.partitionBy("stratum").orderBy("h", "line_id"))
    return out.withColumn("i", order).select("line_id", "stratum", F.when(F.col("i") <= size // 2, "dev").otherwise("test").alias("split"))


def sample_size(p: float, margin: float, z: float = 1.96) -> int:
    """Judgements needed to know a rate near p to within the margin."""
    return int(np.ceil(z * z * p * (1 - p) / (margin * margin)))
