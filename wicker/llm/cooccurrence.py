"""Items that appear together: exact pair counts by heavy-light decomposition, and lift.

A pair can only reach the support asked for if both its items do, so items below it are left out first. With a share as
support (``p2_found``) what remains is bounded by ``min_share_den`` times the mean number of items of a record, whatever
the size of the table; with a count alone (``p2_pairs``) it grows with the table. It is sent to the workers behind a check
of its size, beyond which the pairs are counted by a shuffle. Each partition counts its records in blocks: pairs of heavy items by popcounts of
a dense bit matrix, pairs of light items in a hash table, mixed pairs by probing the bit rows of the heavy items with the
record lists of the light ones. The union of the partial counts is summed by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.functions.items import record_items
from wicker.session import read_table, written

#: More eligible items than this are not sent to the workers; the pairs are then counted by a plain shuffle.
MAX_ITEMS = 200_000
BLOCK = 32_768
_PARTIAL = "src int, a int, b int, n long"


class _Counter:
    """Pair counts of one source over the records of one partition."""

    def __init__(self, heavy: int, light: int, flush: int = 1_000_000):
        self.h, self.l, self.flush = heavy, light, flush
        self.hh = np.zeros((heavy, heavy), np.int64)
        self.rows: list[np.ndarray] = []
        self.ll: dict[int, int] = {}
        self.hl: dict[int, int] = {}

    def add(self, ids: np.ndarray) -> None:
        self.rows.append(ids)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK

    def count_block(self) -> None:
        """Ids below ``h`` are heavy. Light and mixed counts stay in hash tables keyed by a * (h + l) + b."""
        if not self.rows:
            return
        n, h, m = len(self.rows), self.h, self.h + self.l
        owner = np.repeat(np.arange(n), [len(r) for r in self.rows])
        ids = np.concatenate(self.rows)
        self.rows = []
        heavy = ids < h
        dense = np.zeros((h, (n + 63) // 64 * 64), bool)
        dense[ids[heavy], owner[heavy]] = True
        bits = np.packbits(dense, axis=1).view(np.uint64)
        for i in range(h - 1):
            self.hh[i, i + 1 :] += np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
        lid, lown = ids[~heavy], owner[~heavy]
        if not len(lid):
            return
        order = np.argsort(lid, kind="stable")
        names, starts = np.unique(lid[order], return_index=True)
        for name, rows in zip(names, np.split(lown[order], starts[1:])):
            hits = dense[:, rows].sum(axis=1)
            for i in np.nonzero(hits)[0]:
                code = int(i) * m + int(name)
                self.hl[code] = self.hl.get(code, 0) + int(hits[i])
        order = np.lexsort((lid, lown))
        lid, lown = lid[order].astype(np.int64), lown[order]
        codes, gap = [], 1
        while gap < len(lid):
            same = lown[gap:] == lown[:-gap]
            if not same.any():
                break
            codes.append(lid[:-gap][same] * m + lid[gap:][same])
            gap += 1
        if codes:
            values, counts = np.unique(np.concatenate(codes), return_counts=True)
            for code, k in zip(values.tolist(), counts.tolist()):
                self.ll[code] = self.ll.get(code, 0) + k

    def large(self) -> bool:
        return len(self.ll) + len(self.hl) > self.flush

    def drain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = self.h + self.l
        i, j = np.nonzero(self.hh)
        codes = np.fromiter([*self.hl, *self.ll], np.int64)
        counts = np.fromiter([*self.hl.values(), *self.ll.values()], np.int64)
        out = np.concatenate([i, codes // m]), np.concatenate([j, codes % m]), np.concatenate([self.hh[i, j], counts])
        self.hh[:] = 0
        self.hl, self.ll = {}, {}
        return out


def _block_counts(records: DataFrame, codes: list[dict[str, int]], heavy: list[int]) -> DataFrame:
    """src, a, b, n: partial counts, a < b by code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_Counter(h, len(c) - h) for h, c in zip(heavy, codes)]

        def out(src: int) -> pa.RecordBatch:
            a, b, n = counters[src].drain()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), src, np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n)],
                names=["src", "a", "b", "n"],
            )

        for batch in batches:
            for src, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code = codes[src]
                ids = [code[i] for i in items if i in code]
                if len(ids) > 1:
                    counter = counters[src]
                    counter.add(np.array(ids, np.int32))
                    if counter.full():
                        counter.count_block()
                        if counter.large():
                            yield out(src)
        for src, counter in enumerate(counters):
            counter.count_block()
            yield out(src)

    return records.select("src", "items").mapInArrow(count, _PARTIAL)


def pair_counts(
    spark: SparkSession, sources: list[DataFrame], min_count: int = 5, min_share_den: int | None = 400, heavy_den: int = 64
) -> DataFrame:
    """src (index of the source), item_a < item_b, n_ab, n_a, n_b, n_all of every pair with n_ab >= min_count and, unless
    min_share_den is None, min_share_den * n_ab >= n_all.

    ``sources`` hold ``key`` and ``items`` (distinct items, one row per record). Items found in at least one of
    ``heavy_den`` records are heavy. Empty sources give no rows; ties don't matter, every pair is counted exactly.
    """
    records = sources[0].select(F.lit(0).alias("src"), "key", "items")
    for i, s in enumerate(sources[1:], 1):
        records = records.unionAll(s.select(F.lit(i).alias("src"), "key", "items"))
    records = written(records)  # read for the counts and again for the pairs
    # n_all rides along as a null item, so one aggregation gives both kinds of counts
    exploded = records.select("src", F.explode(F.concat(F.array(F.lit(None).cast("string")), "items")).alias("item"))
    counts = exploded.groupBy("src", "item").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.where("item is null").select("src", F.col("n").alias("n_all"))
    eligible = counts.where(F.col("item").isNotNull()).join(F.broadcast(totals), "src")
    eligible = eligible.where((F.col("n") >= min_count) & _share("n", min_share_den))
    rows = eligible.limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        return _shuffled_counts(records, eligible, min_count, min_share_den)
    per = [sorted(((r["n"], r["item"]) for r in rows if r["src"] == i), key=lambda x: (-x[0], x[1])) for i in range(len(sources))]
    n_all = {r["src"]: r["n_all"] for r in rows}
    codes = [{item: k for k, (_, item) in enumerate(p)} for p in per]
    heavy = [sum(n * heavy_den >= n_all[i] for n, _ in p) for i, p in enumerate(per)]
    partial = _block_counts(records, codes, heavy)
    pairs = partial.groupBy("src", "a", "b").agg(F.sum("n").alias("n_ab"))
    names = spark.createDataFrame(
        [(i, k, item, n, n_all[i]) for i, p in enumerate(per) for k, (n, item) in enumerate(p)],
        "src int, code int, item string, n long, n_all long",
    )
    share = _share("n_ab", min_share_den)
    left = names.select("src", F.col("code").alias("a"), F.col("item").alias("x"), F.col("n").alias("n_x"), "n_all")
    right = names.select("src", F.col("code").alias("b"), F.col("item").alias("y"), F.col("n").alias("n_y"))
    joined = pairs.where(F.col("n_ab") >= min_count).join(F.broadcast(left), ["src", "a"]).where(share).join(F.broadcast(right), ["src", "b"])
    return _ordered(joined)


def _shuffled_counts(records: DataFrame, eligible: DataFrame, min_count: int, min_share_den: int | None) -> DataFrame:
    """The same counts without any table on the driver: pairs of eligible items of a record, counted by a shuffle."""
    items = records.select("src", "key", F.explode("items").alias("item")).join(eligible, ["src", "item"])
    entry = F.struct("item", "n", "n_all")
    lists = items.groupBy("src", "key").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    first = lists.select("src", "l", F.posexplode("l").alias("i", "p"))
    pairs = first.select("src", "p", F.explode(F.expr("slice(l, i + 2, size(l))")).alias("q"))
    grouped = pairs.groupBy(
        "src", F.col("p.item").alias("x"), F.col("q.item").alias("y"), F.col("p.n").alias("n_x"), F.col("q.n").alias("n_y"), F.col("p.n_all").alias("n_all")
    ).agg(F.count(F.lit(1)).alias("n_ab"))
    return _ordered(grouped.where((F.col("n_ab") >= min_count) & _share("n_ab", min_share_den)))


def _share(n: str, min_share_den: int | None) -> Column:
    return F.lit(True) if min_share_den is None else F.col(n) * min_share_den >= F.col("n_all")


def _ordered(pairs: DataFrame) -> DataFrame:
    swap = F.col("x") > F.col("y")
    return pairs.select(
        "src",
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("item_a"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("item_b"),
        "n_ab",
        F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"),
        F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"),
        "n_all",
    )


def pairs(spark: SparkSession, sf_dir: str, min_share_den: int | None = None) -> DataFrame:
    """src, item_a, item_b, n_ab, n_a, n_b, lift of the pairs of ``raw_recipes.ner`` and ``recipes.canonical``.

    Every pair found in at least five records counts; a share of all records is asked for only by ``found``.
    """
    sources = [
        record_items(read_table(spark, sf_dir, "raw_recipes"), "raw_id", "ner"),
        record_items(read_table(spark, sf_dir, "recipes"), "recipe_id", "canonical"),
    ]
    counted = pair_counts(spark, sources, min_share_den=min_share_den)
    src = F.array(F.lit("raw_recipes.ner"), F.lit("recipes.canonical"))[F.col("src")]
    lift = F.col("n_ab") * F.col("n_all") / (F.col("n_a") * F.col("n_b"))
    return counted.select(src.alias("src"), "item_a", "item_b", "n_ab", "n_a", "n_b", "n_all", F.round(lift, 6).alias("lift"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, item_a, item_b of the pairs found at least four times as often as chance would have them."""
    often = F.col("n_ab") * F.col("n_all") >= 4 * F.col("n_a") * F.col("n_b")
    return pairs(spark, sf_dir, 400).where(often).select("src", "item_a", "item_b")


_PAIRS_SQL = """
WITH rec AS (
  SELECT DISTINCT 'raw_recipes.ner' src, raw_id::VARCHAR k, unnest(ner) x FROM raw_recipes
  UNION ALL SELECT DISTINCT 'recipes.canonical', recipe_id, unnest(canonical) FROM recipes),
it AS (SELECT DISTINCT src, k, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) item FROM rec
       WHERE trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''),
n AS (SELECT src, count(DISTINCT k) n_all FROM it GROUP BY 1),
c AS (SELECT src, item, count(*) n FROM it GROUP BY 1, 2),
p AS (SELECT a.src, a.item item_a, b.item item_b, count(*) n_ab
      FROM it a JOIN it b ON a.src = b.src AND a.k = b.k AND a.item < b.item GROUP BY 1, 2, 3 HAVING count(*) >= 5)
SELECT p.src, item_a, item_b, n_ab, ca.n n_a, cb.n n_b, n_all, round(n_ab * n_all / (ca.n * cb.n)::DOUBLE, 6) lift
FROM p JOIN n USING (src) JOIN c ca ON ca.src = p.src AND ca.item = item_a JOIN c cb ON cb.src = p.src AND cb.item = item_b
"""

SQL = {
    "p2_pairs": _PAIRS_SQL,
    "p2_found": f"SELECT src, item_a, item_b FROM ({_PAIRS_SQL}) WHERE 400 * n_ab >= n_all AND n_ab * n_all >= 4 * n_a * n_b",
}
