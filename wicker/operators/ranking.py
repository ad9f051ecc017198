"""Rankings, rank fusion and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARMS = ("random", "overlap", "idf_flat", "shipped")


def arm_order(arm: str, seed: str = "42") -> list[Column]:
    """The sort keys of a ranking arm over (qid, rid, have, total, missing, score)."""
    if arm == "random":
        return [F.sha2(F.concat(F.lit(f"{seed}:"), "qid", F.lit(":"), "rid"), 256), F.col("rid")]
    if arm == "overlap":
        return [F.desc("have"), F.col("total"), F.col("rid")]
    if arm == "idf_flat":
        return [F.desc("score"), F.col("total"), F.col("rid")]
    if arm == "shipped":
        return [F.col("missing"), F.desc("score"), F.col("total"), F.col("rid")]
    raise ValueError(f"unknown arm {arm!r}; one of {ARMS}")


def top_of_arm(found: DataFrame, arm: str, k: int) -> DataFrame:
    """qid, rank, rid: the first k of each query."""
    order = Window.partitionBy("qid").orderBy(*arm_order(arm))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0)).select("qid", "rank", "rid")


def gold_ranks(found: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, rank_overlap, rank_idf_flat of the gold basket of each query: one more than the candidates before it.

    Counted by a join on the query with partial sums, without sorting the candidates. ``gold`` holds qid, rid; a gold
    basket that is no candidate has null ranks.
    """
    g = gold.join(found, ["qid", "rid"]).select("qid", F.struct("have", "total", "score", "rid").alias("g"))
    pairs = found.join(g, "qid")
    tie = (F.col("total") < F.col("g.total")) | ((F.col("total") == F.col("g.total")) & (F.col("rid") < F.col("g.rid")))
    before = lambda c: (F.col(c) > F.col(f"g.{c}")) | ((F.col(c) == F.col(f"g.{c}")) & tie)
    counted = pairs.groupBy("qid").agg(
        (F.sum(before("have").cast("long")) + 1).alias("rank_overlap"), (F.sum(before("score").cast("long")) + 1).alias("rank_idf_flat")
    )
    return gold.select("qid").join(counted, "qid", "left")


def rank_blend(left: DataFrame, right: DataFrame, alpha: float, k: int) -> DataFrame:
    """qid, rank, item, score: two ranked lists (qid, item, rank) blended by rank; an absent item ranks behind the list.

    Ties go to the smaller disagreement, the better single rank, then the name. alpha of 1 or more is the left list as it
    is, 0 or less the right one.
    """
    if alpha >= 1 or alpha <= 0:
        only = left if alpha >= 1 else right
        return only.where(F.col("rank") <= k).select("qid", "rank", "item", F.round(1.0 / F.col("rank"), 6).alias("score"))
    la, lb = (x.groupBy("qid").agg(F.count(F.lit(1)).alias(n)) for x, n in ((left, "na"), (right, "nb")))
    both = left.select("qid", "item", F.col("rank").alias("ra")).join(right.select("qid", "item", F.col("rank").alias("rb")), ["qid", "item"], "full")
    both = both.join(la, "qid", "left").join(lb, "qid", "left")
    ra, rb = F.coalesce("ra", F.coalesce("na", F.lit(0)) + 1), F.coalesce("rb", F.coalesce("nb", F.lit(0)) + 1)
    score = 1.0 / (alpha * ra + (1 - alpha) * rb)
    fused = both.select("qid", "item", F.round(score, 6).alias("score"), F.abs(ra - rb).alias("gap"), F.least(ra, rb).alias("best"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "gap", "best", "item")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "item", "score")


def reciprocal_rank_fusion(lists: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """qid, rank, item, score: sum of 1 / (c + rank) over the lists (qid, item, rank), ties by name."""
    union = lists[0].select("qid", "item", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("qid", "item", "rank"))
    scored = union.groupBy("qid", "item").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "item")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "item", "score")


def context_rerank(candidates: DataFrame, context: DataFrame, similarity: DataFrame, weight: float, k: int) -> DataFrame:
    """qid, rank, item, score: 1 / (rank + 1) of a list (qid, item, rank from 0) plus weight times the mean non-zero
    similarity (a, b, sim) to the distinct context items (qid, item)."""
    near = candidates.join(context.distinct().withColumnRenamed("item", "b"), "qid").join(similarity.withColumnRenamed("a", "item"), ["item", "b"])
    mean = near.where("sim <> 0").groupBy("qid", "item").agg(F.avg("sim").alias("m"))
    scored = candidates.join(mean, ["qid", "item"], "left").withColumn("score", F.round(1.0 / (F.col("rank") + 1) + weight * F.coalesce("m", F.lit(0.0)), 6))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "item")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "item", "score")


#: Query vectors of a block; a block goes to every task.
KNN_BLOCK = 2_000


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, similarity: the k nearest vectors by cosine, the query itself left out, ties to the smaller id.

    ``queries`` (vec_id, embedding) is a stated set held against all rows: blocks of about ``KNN_BLOCK`` query vectors go to
    all tasks, each batch of vectors is one matrix product with a block, and only what can be among the k nearest of a batch
    (ties included) is shuffled. Null vectors, those of length zero and those with NaN are near nothing.
    """
    spark = queries.sparkSession
    usable = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: ~F.isnan(x))
    queries, vectors = queries.where(usable).select("vec_id", "embedding"), vectors.where(usable).select("vec_id", "embedding")
    blocks = max(1, -(-queries.count() // KNN_BLOCK))
    numbered = queries.withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    kind = queries.schema["vec_id"].dataType.simpleString()

    def unit(table: pa.RecordBatch | pa.Table) -> np.ndarray:
        m = np.array(table.column("embedding").to_pylist(), dtype=np.float64).reshape(table.num_rows, -1)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def near(block: pa.Table):
        shared = spark.sparkContext.broadcast((block.column("vec_id").to_pylist(), unit(block)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            own = {name: i for i, name in enumerate(names)}
            for batch in batches:
                if not batch.num_rows or not names:
                    continue
                similar = np.round(asked @ unit(batch).T, 6)
                for j, name in enumerate(batch.column("vec_id").to_pylist()):
                    if name in own:
                        similar[own[name], j] = -np.inf
                least = np.partition(similar, -k, axis=1)[:, -k] if similar.shape[1] > k else np.full(len(names), -2.0)
                rows, columns = np.nonzero((similar >= least[:, None]) & (similar > -np.inf))
                found = [pa.array([names[i] for i in rows], batch.schema.field("vec_id").type), batch.column("vec_id").take(pa.array(columns)), pa.array(similar[rows, columns])]
                yield pa.RecordBatch.from_arrays(found, names=["query_id", "vec_id", "similarity"])

        return vectors.mapInArrow(run, f"query_id {kind}, vec_id {kind}, similarity double")

    out = None
    for b in range(blocks):
        part = near(numbered.where(F.col("_b") == b).select("vec_id", "embedding").toArrow())
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 0)).select("query_id", "rank", "vec_id", "similarity")


def popular(idf: DataFrame, staples: DataFrame, n: int) -> DataFrame:
    """rank, id, idf: the n most common items that are no staples."""
    rest = idf.where("idf > 0").join(staples, "id", "left_anti").select("id", F.round("idf", 6).alias("idf"))
    top = rest.orderBy("idf", "id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("idf", "id"))).select("rank", "id", "idf")


def suggest(keys: DataFrame, typed: DataFrame, limit: int = 8) -> DataFrame:
    """q, rank, id: completions of typed prefixes among keys (key, id): the key starts with it (0) or a word in it does (1).

    The best (rank, key length) of an item counts; order by that and the id. Joined on the first letter of the key's
    words, so no typed prefix meets all keys.
    """
    words = keys.select("key", "id", F.explode(F.array_distinct(F.transform(F.split("key", " "), lambda w: F.substring(w, 1, 1)))).alias("first"))
    queries = typed.where("q <> ''").select("q", F.substring("q", 1, 1).alias("first"))
    hit = words.join(queries, "first")
    kind = F.when(F.col("key").startswith(F.col("q")), 0).when(F.concat(F.lit(" "), "key").contains(F.concat(F.lit(" "), "q")), 1)
    best = hit.withColumn("kind", kind).where("kind is not null").groupBy("q", "id").agg(F.min(F.struct("kind", F.length("key").alias("len"))).alias("b"))
    order = Window.partitionBy("q").orderBy("b.kind", "b.len", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("q", "rank", "id")
