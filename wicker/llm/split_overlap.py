"""Same or near-same records across splits: an edit-distance segment join.

A record is a set of tokens. Written as the sequence of its tokens in one global order, the insertions and deletions
between two records are exactly the tokens they don't share, so a similarity of at least ``num / den`` allows at most
k = ``(den - num) / (den + num) * (n + m)`` edits between records of n and m tokens. For each size m of a partner an evaluation
record is cut into k + 1 segments, of which at least one stands untouched in any partner of that size; training records give
their substrings. Matches are kept only where the tokens left and right of them leave enough room, then verified by a
banded dynamic program.

The global order is a hash of the token, so common tokens are spread, and the cut of each evaluation record is the one whose
segments are rarest together. Identical sets are joined once, as a class, and expanded at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicker.functions.items import clean_items, words
from wicker.session import ensure_checkpoint_dir, read_table

NUM, DEN = 7, 10
#: Longest segment; a cut always exists, since a record of n tokens has more than 0.3 n segments.
LONGEST = 6
#: The part of the records that hold a token is known for tokens in more than one of so many records; there are at most
#: RARE_DEN * mean size of those. All others count as this rare.
RARE_DEN = 1_000
MAX_COMMON = 1_000_000
_MASK = (1 << 64) - 1
_SEGMENTS = T.ArrayType(
    T.StructType(
        [T.StructField("h", T.LongType()), T.StructField("p", T.IntegerType()), T.StructField("m", T.IntegerType())]
    )
)


def edits(n: int, m: int, num: int = NUM, den: int = DEN) -> int:
    """The most edits between records of n and m tokens that are similar enough."""
    return (den - num) * (n + m) // (den + num)


def partner_sizes(n: int, num: int = NUM, den: int = DEN) -> range:
    """The sizes that a similar enough partner of a record of n tokens can have."""
    return range(-(-n * num // den), n * den // num + 1)


def _mix(tokens: list[int]) -> int:
    """A signed 64-bit hash of a run of token hashes."""
    x = len(tokens)
    for v in tokens:
        x = ((x ^ (v & _MASK)) * 0x9E3779B97F4A7C15 + (x >> 31)) & _MASK
    return x - (1 << 64) if x >> 63 else x


def cuts(parts: list[float], most: int, longest: int = LONGEST) -> dict[int, list[int]]:
    """Start positions of the best cut into s segments, for every s up to ``most`` that is possible.

    ``parts`` holds for each token the part of the records that have it; the product over a segment estimates how many
    partners it meets. One dynamic program over (segments, tokens) minimises the sum of these products for all s.
    """
    n = len(parts)
    far = float("inf")
    cost = [[0.0] + [far] * n]
    back: list[list[int]] = [[0] * (n + 1)]
    for s in range(1, most + 1):
        row, origin, last = [far] * (n + 1), [0] * (n + 1), cost[-1]
        for j in range(s, n + 1):
            product = 1.0
            for i in range(j - 1, max(s - 2, j - longest - 1), -1):
                product *= parts[i]
                if last[i] + product < row[j]:
                    row[j], origin[j] = last[i] + product, i
        cost.append(row)
        back.append(origin)
    out = {}
    for s in range(1, most + 1):
        if cost[s][n] < far:
            starts, j = [], n
            for k in range(s, 0, -1):
                j = back[k][j]
                starts.append(j)
            out[s] = starts[::-1]
    return out


def _eval_segments(common: dict[int, float]):
    """Segments of a record for each size m of a partner, cut as finely as that size needs."""

    @F.pandas_udf(_SEGMENTS)
    def segments(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rare = 1.0 / RARE_DEN
        for records in batches:
            out = []
            for r in records:
                r = r.tolist()
                n = len(r)
                sizes = partner_sizes(n)
                best = cuts([common.get(v, rare) for v in r], edits(n, sizes[-1]) + 1)
                hashed = {s: [(_mix(r[a:b]), a) for a, b in zip(at, [*at[1:], n])] for s, at in best.items()}
                out.append([(h, a, m) for m in sizes for h, a in hashed[edits(n, m) + 1]])
            yield pd.Series(out)

    return segments


def _train_segments():
    @F.pandas_udf(_SEGMENTS)
    def segments(records: pd.Series) -> pd.Series:
        out = []
        for r in records:
            r = r.tolist()
            m = len(r)
            out.append([(_mix(r[a : a + w]), a, m) for w in range(1, LONGEST + 1) for a in range(m - w + 1)])
        return pd.Series(out)

    return segments


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Insertions and deletions between a[i] and b[i] for a whole batch; values above ``band`` only mean "more"."""
    n = np.array([len(x) for x in a])
    m = np.array([len(x) for x in b])
    rows, la, lb = len(a), int(n.max(initial=0)), int(m.max(initial=0))
    x = np.full((rows, la + 1), -1, np.int64)
    y = np.full((rows, lb + 2 * band + 2), -1, np.int64)
    for i, (p, q) in enumerate(zip(a, b)):
        x[i, 1 : len(p) + 1] = p
        y[i, band + 1 : band + 1 + len(q)] = q
    far = np.int32(10**6)
    width = 2 * band + 1
    offset = np.arange(width) - band
    prev = np.where(offset >= 0, offset, far).astype(np.int32)[None, :].repeat(rows, 0)
    inside = (m - n + band >= 0) & (m - n + band < width)
    at = np.clip(m - n + band, 0, width - 1)
    every = np.arange(rows)
    result = np.where((n == 0) & inside, prev[every, at], far)
    for i in range(1, la + 1):
        now = np.full((rows, width), far, np.int32)
        for k in range(width):
            j = i + k - band
            if j < 0 or j > lb:
                continue
            best = prev[:, k + 1] + 1 if k + 1 < width else np.full(rows, far, np.int32)
            if j > 0:
                same = (x[:, i] == y[:, band + j]) & (x[:, i] != -1)
                best = np.where(same, np.minimum(best, prev[:, k]), best)
                if k:
                    best = np.minimum(best, now[:, k - 1] + 1)
            now[:, k] = best
        result = np.where((n == i) & inside, now[every, at], result)
        prev = now
    return result


def _verify(pairs: DataFrame) -> DataFrame:
    """src, fe, ft of the pairs (src, fe, ft, e, t) that are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = [np.array(v, np.int64) for v in batch.column(3).to_pylist()]
            b = [np.array(v, np.int64) for v in batch.column(4).to_pylist()]
            total = np.array([len(p) + len(q) for p, q in zip(a, b)], np.int64)
            allowed = (DEN - NUM) * total // (DEN + NUM)
            keep = np.zeros(len(a), bool)
            for band in np.unique(allowed):  # one band per batch of equal room
                pick = np.nonzero(allowed == band)[0]
                keep[pick] = banded_distance([a[i] for i in pick], [b[i] for i in pick], int(band)) <= band
            yield batch.select([0, 1, 2]).filter(pa.array(keep))

    return pairs.select("src", "fe", "ft", "e", "t").mapInArrow(check, "src int, fe binary, ft binary")


def overlaps(spark: SparkSession, records: DataFrame) -> DataFrame:
    """src, key_a < key_b of ``records`` (src int, key string, train boolean, tokens array<string> of distinct tokens).

    Records without tokens match nothing; records repeated under one key count once; no pair is dropped, whatever the
    size of a class. Pairs are reported once, even where a key stands on both sides.
    """
    ensure_checkpoint_dir(spark)
    hashed = records.where(F.size("tokens") > 0).select(
        "src", "key", "train", F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t))).alias("r")
    )
    hashed = hashed.withColumn("f", F.unhex(F.md5(F.concat_ws(",", F.transform("r", lambda v: v.cast("string")))))).distinct()
    hashed = hashed.checkpoint()
    classes = hashed.select("src", "train", "f", "r").distinct()
    tokens = classes.select(F.explode("r").alias("v"))
    n = classes.count()
    common = tokens.groupBy("v").count().where(F.col("count") * RARE_DEN > n).limit(MAX_COMMON + 1).collect()
    if len(common) > MAX_COMMON:
        raise ValueError("the mean record has more tokens than this join is meant for")
    parts = {r["v"]: r["count"] / n for r in common}
    held = classes.where("not train").select("src", F.col("f").alias("fe"), F.col("r").alias("e"))
    base = classes.where("train").select("src", F.col("f").alias("ft"), F.col("r").alias("t"))
    left = held.select("src", "fe", F.size("e").alias("n"), F.explode(_eval_segments(parts)("e")).alias("s"))
    left = left.select("src", "fe", "n", F.col("s.h").alias("h"), F.col("s.p").alias("p"), F.col("s.m").alias("m"))
    right = base.select("src", "ft", F.explode(_train_segments()("t")).alias("s"))
    right = right.select("src", "ft", F.col("s.h").alias("h"), F.col("s.p").alias("q"), F.col("s.m").alias("m"))
    room = F.abs(F.col("p") - F.col("q")) + F.abs(F.col("n") - F.col("p") - F.col("m") + F.col("q"))
    fits = room * (DEN + NUM) <= (DEN - NUM) * (F.col("n") + F.col("m"))
    pairs = left.join(right, ["src", "m", "h"]).where(fits).select("src", "fe", "ft").distinct()
    close = _verify(pairs.join(held, ["src", "fe"]).join(base, ["src", "ft"]))
    members = hashed.select("src", "train", "f", "key")
    a = members.where("not train").select("src", F.col("f").alias("fe"), F.col("key").alias("x"))
    b = members.where("train").select("src", F.col("f").alias("ft"), F.col("key").alias("y"))
    found = close.join(a, ["src", "fe"]).join(b, ["src", "ft"]).where("x <> y")
    return found.select("src", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def _split(c: Column) -> Column:
    return F.lower(F.trim(c))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _split(F.col("split"))
    gold = read_table(spark, sf_dir, "eval_pantries").select(F.col("gold_id").alias("key"), split.alias("split")).distinct()
    recipes = read_table(spark, sf_dir, "recipes").select(
        F.col("recipe_id").alias("key"), F.array_union(words(F.col("title")), clean_items(F.col("canonical"))).alias("tokens")
    )
    pantries = gold.join(recipes, "key").select(F.lit(0).alias("src"), "key", "split", "tokens")
    lines = read_table(spark, sf_dir, "labels").select(
        F.lit(1).alias("src"), F.col("line_id").alias("key"), split.alias("split"), words(F.col("text")).alias("tokens")
    )
    both = pantries.unionAll(lines).where(F.col("split").isin("train", "dev", "test"))
    return both.withColumn("train", F.col("split") == "train")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, key_a, key_b: a training record and a dev or test record that share at least 0.7 of their elements."""
    src = F.array(F.lit("eval_pantries"), F.lit("labels"))[F.col("src")]
    return overlaps(spark, _records(spark, sf_dir)).withColumn("src", src)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, split, source, n_records, n_overlapping, n_pairs: the overlaps of the dev and test records.

    ``source`` is the source of a label (trimmed, lower case, ``-`` as ``_``, null as "unknown"); pantries have none.
    """
    pairs = found(spark, sf_dir)
    split = _split(F.col("split"))
    source = F.coalesce(F.regexp_replace(_split(F.col("source")), "-", "_"), F.lit("unknown"))
    lines = read_table(spark, sf_dir, "labels").groupBy(F.col("line_id").alias("key")).agg(
        F.max(split).alias("split"), F.max(source).alias("source")
    )
    gold = read_table(spark, sf_dir, "eval_pantries").groupBy(F.col("gold_id").alias("key")).agg(F.max(split).alias("split"))
    keys = lines.select(F.lit("labels").alias("src"), "key", "split", "source").unionByName(
        gold.select(F.lit("eval_pantries").alias("src"), "key", "split", F.lit("none").alias("source"))
    )
    keys = keys.where(F.col("split").isin("dev", "test"))
    ends = pairs.select("src", F.explode(F.array("key_a", "key_b")).alias("key")).groupBy("src", "key").agg(F.count(F.lit(1)).alias("n"))
    return keys.join(ends, ["src", "key"], "left").groupBy("src", "split", "source").agg(
        F.count(F.lit(1)).alias("n_records"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs")
    )


_FOUND_SQL = """
WITH g AS (SELECT DISTINCT gold_id k, lower(trim(split)) s FROM eval_pantries),
t AS (SELECT DISTINCT 'eval_pantries' src, k, s, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) x
      FROM g JOIN recipes ON k = recipe_id
  UNION SELECT DISTINCT 'eval_pantries', k, s, trim(regexp_replace(lower(i), '\\s+', ' ', 'g'))
      FROM (SELECT k, s, unnest(canonical) i FROM g JOIN recipes ON k = recipe_id) WHERE trim(regexp_replace(i, '\\s+', ' ', 'g')) <> ''
  UNION SELECT DISTINCT 'labels', line_id, lower(trim(split)), unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) FROM labels),
n AS (SELECT src, k, count(*) n FROM t GROUP BY 1, 2),
p AS (SELECT a.src, a.k ka, b.k kb, count(*) c FROM t a JOIN t b ON a.src = b.src AND a.x = b.x
      WHERE a.s IN ('dev', 'test') AND b.s = 'train' GROUP BY 1, 2, 3)
SELECT DISTINCT p.src, least(ka, kb) key_a, greatest(ka, kb) key_b
FROM p JOIN n na ON na.src = p.src AND na.k = ka JOIN n nb ON nb.src = p.src AND nb.k = kb
WHERE 10 * c >= 7 * (na.n + nb.n - c)"""

SQL = {
    "p7_found": _FOUND_SQL,
    "p7_report": f"""
WITH f AS ({_FOUND_SQL}),
k AS (SELECT 'labels' src, line_id k, max(lower(trim(split))) split,
             max(coalesce(replace(lower(trim(source)), '-', '_'), 'unknown')) source FROM labels GROUP BY 2
  UNION ALL SELECT 'eval_pantries', gold_id, max(lower(trim(split))), 'none' FROM eval_pantries GROUP BY 2),
e AS (SELECT src, k, count(*) n FROM (SELECT src, key_a k FROM f UNION ALL SELECT src, key_b FROM f) GROUP BY 1, 2)
SELECT src, split, source, count(*) n_records, count(n) n_overlapping, coalesce(sum(n), 0)::BIGINT n_pairs
FROM k LEFT JOIN e USING (src, k) WHERE split IN ('dev', 'test') GROUP BY 1, 2, 3""",
}
