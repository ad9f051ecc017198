"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over the training time t in [0, 1], ``w(t) = share * (1 + tilt * (2 t - 1))``, whose integral
is its share. The documents of a source stand in one order per pass over it; a document copy takes the place in training
time at which the integrated schedule of its source has asked for the tokens before it. The copies are then sorted by
that position over a range partitioning.

Cumulative token counts are taken in two steps, sums of hash-ordered buckets and a window inside each bucket, so the largest
source never lies in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.llm.tokenize import VOCABULARY, count_tokens
from wicker.session import ensure_checkpoint_dir, read_table

#: The table of targets goes to the driver; its size is checked.
MAX_SOURCES = 100_000
#: Documents of a bucket inside which one window adds up.
BUCKET_DOCUMENTS = 20_000


@dataclass(frozen=True)
class Plan:
    """What one source gives: its quota in tokens and how often its documents come at most."""

    source: str
    target: float
    max_repeats: int
    available: int
    quota: int
    passes: int
    tilt: float


def source_key(c: Column) -> Column:
    """Sources compare trimmed, in lower case, with ``-`` taken as ``_``."""
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


def plan_sources(
    targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None, slope: float = 0.5
) -> list[Plan]:
    """Quotas of the sources.

    A source without tokens can give nothing; the shares of the others are scaled to sum to one. Without a ``total`` the
    largest one is taken at which every source with tokens reaches its scaled share within its repeats. With a larger
    ``total`` a short source gives all its repeats and the report shows what it reached. Sources that may be
    repeated more often lean to the end of the training by up to ``slope``; tilts add up to zero over the shares.
    """
    live = {s: t for s, t, _ in targets if available.get(s, 0) > 0 and t > 0}
    scale = sum(live.values())
    caps = {s: available.get(s, 0) * max(0, r) for s, _, r in targets}
    if total is None:
        total = int(min((caps[s] * scale / t for s, t in live.items()), default=0))
    repeats = [r for s, _, r in targets if s in live]
    span = max(repeats, default=0) - min(repeats, default=0) or 1
    raw = {s: slope * (r - min(repeats)) / span for s, _, r in targets if s in live}
    mean = sum(raw[s] * live[s] / scale for s in raw)
    plans = []
    for s, t, r in sorted(targets):
        quota = min(caps[s], round(total * t / scale)) if s in live else 0
        passes = -(-quota // available[s]) if quota else 0
        plans.append(Plan(s, t, r, available.get(s, 0), quota, passes, raw.get(s, mean) - mean))
    return plans


def position(c: Column, tilt: Column) -> Column:
    """The time at which a schedule of this tilt has asked for the part c of its quota: the inverse of
    ``c = t + tilt * (t * t - t)``."""
    root = (F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * c) - (1 - tilt)) / (2 * tilt)
    return F.when(F.abs(tilt) < 1e-9, c).otherwise(root)


def place(spark: SparkSession, sizes: DataFrame, plans: list[Plan], buckets: int) -> DataFrame:
    """doc_id, source, copy, n_tokens, position of the copies that fill each quota, sorted by position.

    A copy is in if its middle token is within the quota, so a source misses it by at most half a document.
    """
    rows = [(p.source, p.quota, p.passes, float(p.tilt)) for p in plans if p.quota]
    table = spark.createDataFrame(rows, "source string, quota long, passes int, tilt double")
    copies = sizes.join(F.broadcast(table), "source")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    copies = copies.withColumn("h", F.xxhash64("doc_id", "copy"))
    copies = copies.withColumn("bucket", F.shiftright(F.shiftrightunsigned("h", 1), 62 - (buckets - 1).bit_length() + 1))
    bucket = ["source", "copy", "bucket"]
    sums = copies.groupBy(*bucket).agg(F.sum("n_tokens").alias("s"))
    before = Window.partitionBy("source").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*bucket, F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*bucket).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, bucket)
    start = F.col("base") + F.col("inner")
    placed = placed.withColumn("start", start).where(F.col("start") + F.col("n_tokens") / 2 <= F.col("quota"))
    part = F.least(F.lit(1.0), (F.col("start") + F.col("n_tokens") / 2) / F.col("quota"))
    placed = placed.select("doc_id", "source", "copy", "n_tokens", F.round(position(part, F.col("tilt")), 12).alias("position"))
    return placed.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def token_sizes(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens of the documents with tokens; written once, since three stages read it."""
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    docs = docs.where(F.col("source").isNotNull() & (F.length("text") > 0))
    return count_tokens(spark, docs, "text", vocabulary).where("n_tokens > 0").checkpoint()


def _planned(spark: SparkSession, sf_dir: str, sizes: DataFrame, total: int | None) -> tuple[list[Plan], int]:
    rows = read_table(spark, sf_dir, "mix_targets").select(
        source_key(F.col("source")).alias("source"), "target_share", "max_repeats"
    ).distinct().limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in rows]
    wanted = spark.createDataFrame([(t[0],) for t in targets], "source string")
    sums = sizes.join(F.broadcast(wanted), "source").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    found = {r["source"]: r for r in sums.collect()}
    plans = plan_sources(targets, {s: r["t"] for s, r in found.items()}, total)
    most = max((r["n"] for r in found.values()), default=0)
    return plans, 1 << max(2, (most // BUCKET_DOCUMENTS).bit_length())


def mix(spark: SparkSession, sf_dir: str, total: int | None = None) -> DataFrame:
    """doc_id, source, copy, n_tokens, position: the mixed corpus in training order.

    Null and empty texts have no tokens and are not used; neither are documents whose source has no target. No document
    has more than ``max_repeats`` copies.
    """
    sizes = token_sizes(spark, sf_dir)
    plans, buckets = _planned(spark, sf_dir, sizes, total)
    return place(spark, sizes, plans, buckets)


def shares(spark: SparkSession, sf_dir: str, total: int | None = None) -> DataFrame:
    """source, target_share, reached_share, reached_tokens, available_tokens, n_documents, most_copies, status.

    One row per target, also for sources without documents (status "no tokens"); "short" marks a source that ran out of
    repeats before it reached its scaled share.
    """
    sizes = token_sizes(spark, sf_dir)
    plans, buckets = _planned(spark, sf_dir, sizes, total)
    used = place(spark, sizes, plans, buckets).groupBy("source").agg(
        F.sum("n_tokens").alias("reached_tokens"), F.countDistinct("doc_id").alias("n_documents"), (F.max("copy") + 1).alias("most_copies")
    )
    live = sum(p.target for p in plans if p.available)
    quota = sum(p.quota for p in plans) or 1
    state = lambda p: "no tokens" if not p.available else "short" if p.quota < p.target / live * quota - 1 else "reached"
    table = spark.createDataFrame(
        [(p.source, float(p.target), int(p.available), state(p)) for p in plans],
        "source string, target_share double, available_tokens long, status string",
    )
    every = table.join(F.broadcast(used), "source", "left").fillna(0, ["reached_tokens", "n_documents", "most_copies"])
    whole = F.sum("reached_tokens").over(Window.partitionBy())
    return every.select(
        "source", "target_share", F.round(F.col("reached_tokens") / F.greatest(whole, F.lit(1)), 6).alias("reached_share"),
        "reached_tokens", "available_tokens", "n_documents", "most_copies", "status",
    )
