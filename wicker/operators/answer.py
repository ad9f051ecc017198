"""What can be made from held items: groups by missing lines, unlocks and blockers, for many queries in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.operators import basket, blocks
from wicker.session import ensure_checkpoint_dir, written

MAX_MISSING = 2


@dataclass(frozen=True)
class Pack:
    """The needed lines of a collection of baskets, one row per option, with what scoring needs beside them."""

    need: DataFrame  # rid, line_no, id (null for an unread line), w, total, den
    idf: DataFrame  # id, df, idf; at most as many rows as the reference table
    staples: list[str]
    packed: blocks.Packed | None = None  # the same lines by basket

    @property
    def baskets(self) -> DataFrame | blocks.Packed:
        return self.packed or self.need


def build_pack(spark: SparkSession, sf_dir: str) -> Pack:
    """Lines are gathered by basket once (a basket is one record), as numbers, and written; all else is counted inside the rows,
    and no row is moved again."""
    ensure_checkpoint_dir(spark)
    known = basket.entries(spark, sf_dir)
    staples = sorted({r["id"] for r in known.to_pylist() if r["staple"]})
    kept = written(basket.line_codes(spark, sf_dir, known))
    counts = blocks.counted_lines(kept, known).checkpoint()
    n = counts.where("id is null").first()
    idf = basket.inverse_frequency(counts.where("id is not null"), n["df"] if n else 0)
    baskets = blocks.Packed(blocks.weighed(kept, idf.select("id", "idf").toArrow(), known))
    return Pack(baskets.rows(), idf, staples, baskets)


def held_items(queries: DataFrame, pack: Pack) -> DataFrame:
    """qid, id of the known items that are no staples."""
    known = F.broadcast(pack.idf.where(~F.col("id").isin(pack.staples)).select("id"))
    return queries.join(known, "id", "left_semi").select("qid", "id").distinct()


def _scores(hits: DataFrame) -> DataFrame:
    """Both aggregations use the one shuffle by query and basket."""
    hits = hits.select("qid", "rid", "line_no", "w", "total", "den").repartition("qid", "rid")
    lines = hits.groupBy("qid", "rid", "line_no").agg(F.max("w").alias("w"), F.max("total").alias("total"), F.max("den").alias("den"))
    sums = lines.groupBy("qid", "rid").agg(F.count(F.lit(1)).alias("have"), F.sum("w").alias("num"), F.max("total").alias("total"), F.max("den").alias("den"))
    score = F.when(F.col("den") > 0, F.col("num") / F.sqrt("den")).otherwise(0.0)
    return sums.select("qid", "rid", "have", "total", (F.col("total") - F.col("have")).alias("missing"), F.round(score, 6).alias("score"))


def scored(held: DataFrame, pack: Pack) -> DataFrame:
    """qid, rid, have, total, missing, score of every basket with at least one satisfied line.

    A satisfied line counts once, whichever and however many of its options are held.
    """
    return _scores(held.join(pack.need, "id"))


def near(held: DataFrame, pack: Pack) -> DataFrame:
    """The rows of ``scored`` with at most two missing lines, found block by block, so that no other row is ever shuffled."""
    return blocks.within(held, pack.baskets, MAX_MISSING)


def items(spark: SparkSession, sf_dir: str, limit: int = 10, diet: str | None = None) -> DataFrame:
    """qid, missing, rank, rid, have, total, score: per query and group the first ``limit`` (negative counts as 0).

    Lines carry no diet, so asking for one is an error rather than an answer that ignores it."""
    if diet is not None:
        raise NotImplementedError("answers by diet are not supported")
    pack = build_pack(spark, sf_dir)
    close = blocks.within(basket.pantries(spark, sf_dir), pack.baskets, MAX_MISSING, max(limit, 0))
    order = Window.partitionBy("qid", "missing").orderBy(F.desc("score"), "total", "rid")
    ranked = close.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(limit, 0))
    return ranked.select("qid", "missing", "rank", "rid", "have", "total", "score")


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, make_now, one_away, two_away for every query, zeros included."""
    pack = build_pack(spark, sf_dir)
    queries = basket.pantries(spark, sf_dir)
    found = blocks.counts_within(queries, pack.baskets, MAX_MISSING)
    count = lambda k: F.coalesce(F.sum(F.when(F.col("missing") == k, F.col("n"))), F.lit(0))
    return queries.select("qid").join(found, "qid", "left").groupBy("qid").agg(
        count(0).alias("make_now"), count(1).alias("one_away"), count(2).alias("two_away")
    )


def unlocks(spark: SparkSession, sf_dir: str, top: int = 10) -> DataFrame:
    """qid, rank, id, n: the items that complete the most baskets one line away."""
    pack = build_pack(spark, sf_dir)
    counts = blocks.open_counts(basket.pantries(spark, sf_dir), pack.baskets, 1, top).groupBy("qid", "id").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("qid").orderBy(F.desc("n"), "id")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("qid", "rank", "id", "n")


def blockers(spark: SparkSession, sf_dir: str, queries: DataFrame, top: int = 5) -> DataFrame:
    """qid, rank, id, n: for queries without any basket in reach, the items that bring the most into reach.

    A basket comes into reach if held and new lines leave at most two missing. What an item brings to baskets the query
    doesn't touch is the same for every query, so it is counted once; only touched baskets are counted per query, which
    keeps the join on shared items. Which queries are blocked is counted block by block, so that the others never get that far.
    """
    pack = build_pack(spark, sf_dir)
    reached = blocks.counts_within(queries, pack.baskets, MAX_MISSING).select("qid").distinct()
    blocked = queries.join(reached, "qid", "left_anti")
    blocked = blocked.select("qid", F.explode("ids").alias("id")) if "ids" in queries.columns else blocked
    held = held_items(blocked, pack).checkpoint()  # of the blocked queries only
    if held.isEmpty():
        return spark.createDataFrame([], "qid string, rank int, id string, n long")
    found = scored(held, pack)
    gain = pack.need.where("id is not null").groupBy("rid", "id").agg(F.countDistinct("line_no").alias("gain"), F.first("total").alias("total"))
    alone = gain.where(F.col("total") - F.col("gain") <= MAX_MISSING)
    touched = found.select("qid", "rid", "have")
    satisfied = held.join(pack.need, "id").select("qid", "rid", "line_no").distinct()
    open_ = touched.join(pack.need.where("id is not null").select("rid", "line_no", "id"), "rid").join(satisfied, ["qid", "rid", "line_no"], "left_anti").join(held, ["qid", "id"], "left_anti")
    fresh = open_.groupBy("qid", "rid", "id").agg(F.countDistinct("line_no").alias("g"), F.first("have").alias("have"))
    delta = touched.select("qid", "rid").join(gain, "rid").join(held, ["qid", "id"], "left_anti").join(fresh, ["qid", "rid", "id"], "left")
    now = F.coalesce((F.col("total") - F.col("have") - F.col("g") <= MAX_MISSING).cast("long"), F.lit(0))
    was = (F.col("total") - F.col("gain") <= MAX_MISSING).cast("long")
    deltas = written(delta.groupBy("qid", "id").agg(F.sum(now - was).alias("d")).where("d <> 0"))
    base = alone.groupBy("id").agg(F.count(F.lit(1)).alias("b"))
    # only the first items of the common order can be among the best of a query: as many as it asks for, holds or has a difference for
    ordered = base.withColumn("place", F.row_number().over(Window.orderBy(F.desc("b"), "id")))
    own = held.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).unionByName(deltas.groupBy("qid").agg(F.count(F.lit(1)).alias("n")))
    places = own.groupBy("qid").agg((F.sum("n") + max(top, 0)).cast("int").alias("n")).select("qid", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("place"))
    static = places.join(ordered, "place").select("qid", "id", "b").join(held, ["qid", "id"], "left_anti")
    changed = deltas.join(base, "id", "left").select("qid", "id", "d", F.col("b").alias("all"))
    both = static.join(changed, ["qid", "id"], "full").select("qid", "id", (F.coalesce("b", "all", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n")).where("n > 0")
    order = Window.partitionBy("qid").orderBy(F.desc("n"), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("qid", "rank", "id", "n")
