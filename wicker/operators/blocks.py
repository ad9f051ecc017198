"""A stated set of queries against all baskets, in blocks.

Queries and baskets are cut into blocks of bounded size by hash, and each pair of blocks is one group: no row of a query and a
basket is ever shuffled, only what a query keeps of a block. Inside a group each item is a bit vector over the baskets of the
block, the vectors of a query are added up as bits of a count, 64 baskets a word, and only baskets that a query may keep are
looked at one by one.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.session import written

#: Baskets and queries of a block at most, up to the evenness of the hash, and rows that a block of queries gives.
BASKETS = 262_144
QUERIES = 262_144
GIVEN = 2_000_000
#: Packed baskets that travel together, compressed.
BUNDLED = 50_000
#: Blocks of baskets that one task searches one after the other, at most, where it merges what a query keeps of each.
SPAN = 8
#: A query block is not cut smaller than this for the sake of parallel work.
LEAST_QUERIES = 256
#: Parts, a power of two, in which the weight that a score needs is counted.
PARTS = 16


class Groups:
    """So many groups, each on a partition of its own: their keys are numbers that hash to different partitions."""

    def __init__(self, spark: SparkSession, n: int):
        tried = spark.range(max(64, 32 * n), numPartitions=1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
        kept = dict(tried.groupBy("p").agg(F.min("id")).collect())
        free = iter(range(-1, -1 - n, -1))
        self.n, self.keys = n, [kept[p] if p in kept else next(free) for p in range(n)]

    def key(self, group: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.keys)), (group + 1).cast("int")).cast("long").alias("_g")

    def cogroup(self, left: DataFrame, right: DataFrame):
        return left.repartition(self.n, "_g").groupBy("_g").cogroup(right.repartition(self.n, "_g").groupBy("_g"))


def numbers(table: pa.Table, c: str) -> np.ndarray:
    """The numbers of a column, those of lists one after the other."""
    column = table.column(c).combine_chunks()
    return (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)


def edges(table: pa.Table, c: str) -> np.ndarray:
    """Where the lists of a column begin in ``numbers``, and the end."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(table.column(c).combine_chunks()).to_numpy())]).astype(np.int64)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of these spans, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def added(levels: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The bits of the sums, place by place, of bit vectors of which those of ``levels[k]`` count 2 ** k."""
    out, k, carry = [], 0, []
    while carry or k < len(levels):
        level, carry = carry + (levels[k] if k < len(levels) else []), []
        while len(level) > 2:
            x, y, z = level.pop(), level.pop(), level.pop()
            half = x ^ y
            carry.append((x & y) | (half & z))
            level.append(half ^ z)
        if len(level) == 2:
            x, y = level
            carry.append(x & y)
            level = [x ^ y]
        out.append(level[0] if level else None)
        k += 1
    some = next((x for x in out if x is not None), None)
    return [] if some is None else [np.zeros_like(some) if x is None else x for x in out]


class Block:
    """A block of baskets, in the order of their number of lines and rid. Those of each number begin at a multiple of 64.

    A line counts once for a query, whichever and however many of its options are held; where a line of the block has more
    than one option, or an item more than one weight, baskets are counted by postings and not by bits.
    """

    def __init__(self, table: pa.Table):
        table = table.sort_by([("total", "ascending"), ("rid", "ascending")])
        total = numbers(table, "total").astype(np.int64)
        self.sizes, first_, count = np.unique(total, return_index=True, return_counts=True)
        words = -(-count // 64)
        self.words = np.concatenate([[0], np.cumsum(words)])
        self.n = int(self.words[-1]) * 64
        place = np.arange(len(total)) + np.repeat(self.words[:-1] * 64 - first_, count)
        self.rids = np.full(self.n, None, dtype=object)
        self.rids[place] = table.column("rid").to_numpy()
        self.filled = np.stack([self.words[:-1] * 64, self.words[:-1] * 64 + count], axis=1)
        self.rank = np.zeros(self.n, np.int64)
        self.rank[place[pc.sort_indices(table.column("rid")).to_numpy()]] = np.arange(len(total))
        self.total, self.root = np.zeros(self.n, np.int64), np.zeros(self.n)
        self.total[place], self.root[place] = total, np.sqrt(np.maximum(numbers(table, "den"), 0.0))
        sizes = np.diff(edges(table, "line"))
        self.size, self.start = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.size[place], self.start[place] = sizes, np.cumsum(sizes) - sizes
        owner = np.repeat(place, sizes)
        ids = table.column("id").combine_chunks().flatten()
        ids = ids if pa.types.is_dictionary(ids.type) else ids.dictionary_encode()
        self.items = ids.dictionary
        self.code = pc.fill_null(ids.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        weight, self.line_weight = numbers(table, "w"), None
        known = self.code >= 0
        self.weight = np.zeros(len(self.items) + 1)
        self.weight[self.code[known]] = weight[known]
        self.plain = bool(pc.all(table.column("plain")).as_py()) and bool((self.weight[self.code[known]] == weight[known]).all())
        of_basket = np.bincount(owner, weights=np.where(known, weight, 0.0), minlength=self.n)
        # then no score is above the root of what is satisfied
        self.bounded = self.plain and bool((of_basket <= self.root**2 * (1 + 1e-9) + 1e-9).all())
        order = np.flatnonzero(known)[np.argsort(self.code[known], kind="stable")]
        self.posted = owner[order]
        self.cut = np.searchsorted(self.code[order], np.arange(len(self.items) + 1))
        self.kept: dict[int, list[np.ndarray]] = {}
        self.number = 0  # of the block
        self.fills: dict[str, tuple[np.ndarray, np.ndarray]] | None = None
        self.item_rank = np.argsort(pc.sort_indices(self.items).to_numpy())
        self.whole = False  # whether it has all baskets
        self.orders: dict[int, list] = {}
        self.planes: dict[int, list[np.ndarray]] = {}  # by missing lines, the bits of how many a basket then satisfies
        self.closed: dict[tuple[int, int], np.ndarray] = {}
        self.named: list[bytes] = []  # the rids, once they are asked for
        self.has = np.zeros(len(self.items) + 1, bool)
        if not self.plain:
            key = np.stack([owner, numbers(table, "line").astype(np.int64)])
            _, line = np.unique(key, axis=1, return_inverse=True)
            self.line = line.reshape(-1)  # of each row
            self.line_place, self.line_weight = np.zeros(self.line.max(initial=-1) + 1, np.int64), np.zeros(self.line.max(initial=-1) + 1)
            self.line_place[self.line], self.line_weight[self.line] = owner, weight
            self.line_of = self.line[order]

    def layers(self, code: int) -> list[np.ndarray]:
        """Bit vectors that add up to the lines of each basket that name this item; those of common items are kept."""
        if code in self.kept:
            return self.kept[code]
        at, out = self.posted[self.cut[code] : self.cut[code + 1]], []
        while len(at):
            again = np.concatenate([[False], at[1:] == at[:-1]])
            one = at[~again]
            bits = np.zeros(self.n // 64, np.uint64)
            if len(one) * 1024 > self.n:
                flags = np.zeros(self.n, np.uint8)
                flags[one] = 1
                bits = np.packbits(flags, bitorder="little").view(np.uint64)
            else:
                np.bitwise_or.at(bits, one >> 6, np.uint64(1) << (one & 63).astype(np.uint64))
            out.append(bits)
            at = at[again]
        if (self.cut[code + 1] - self.cut[code]) * 512 > self.n:
            self.kept[code] = out
        return out

    def needed(self, missing: int, levels: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The lowest ``levels`` bits of how many lines each basket satisfies if it lacks ``missing``, and the baskets for which that
        is nothing or takes more bits."""
        if missing not in self.planes:
            have = np.maximum(self.total - missing, 0)
            self.planes[missing] = [np.packbits(have >> k & 1 == 1, bitorder="little").view(np.uint64) for k in range(int(have.max(initial=0)).bit_length())]
        if (missing, levels) not in self.closed:
            have = self.total - missing
            self.closed[missing, levels] = np.packbits((have <= 0) | (have >> levels > 0), bitorder="little").view(np.uint64)
        return self.planes[missing][:levels], self.closed[missing, levels]

    def covering(self, most: int) -> list[tuple[int, int, int]]:
        """Index of a size, its number of lines and how many (not all) are satisfied, the best covered first, then the fewest
        missing."""
        if most not in self.orders:
            every = [(s, int(t), h) for s, t in enumerate(self.sizes) for h in range(1, min(int(t) - 1, most) + 1)]
            self.orders[most] = sorted(every, key=lambda x: (-(x[2] / x[1]), x[1] - x[2]))
        return self.orders[most]

    def before(self, total: int, rid: str) -> int:
        """The place where a basket of so many lines and this rid stands or would stand."""
        s = int(np.searchsorted(self.sizes, total))
        if s == len(self.sizes) or self.sizes[s] != total:
            return int(self.words[s]) * 64
        a, b = self.filled[s]
        return int(a + np.searchsorted(self.rids[a:b], rid))


def _places(words: np.ndarray, limit: int | None = None) -> np.ndarray:
    """The places of the bits that are set, those of the first ``limit`` words with any."""
    some = np.flatnonzero(words)[:limit]
    at = np.flatnonzero(np.unpackbits(words[some].view(np.uint8), bitorder="little").view(bool))
    return some[at >> 6] * 64 + (at & 63)


def _any(bits: list[np.ndarray]) -> np.ndarray:
    out = bits[0]
    for k, on in enumerate(bits[1:]):
        out = out | on if k == 0 else np.bitwise_or(out, on, out=out)
    return out


class Hits:
    """The baskets of a block by how many of their lines a query satisfies."""

    def __init__(self, block: Block, held: list[int]):
        self.block, self.held = block, held
        self.bits: list[np.ndarray] = []
        self.have, self.most = None, 0
        if not block.plain:
            lines = np.unique(np.concatenate([np.zeros(0, np.int64), *(block.line_of[block.cut[c] : block.cut[c + 1]] for c in self.held)]))
            at = block.line_place[lines]
            self.lines = lines
            self.have = np.bincount(at, minlength=block.n)
            self.sum = np.bincount(at, weights=block.line_weight[lines], minlength=block.n)
            self.most = int(self.have.max(initial=0))
            return
        level = [bits for c in self.held for bits in block.layers(c)]
        self.most = len(level)
        self.bits = added([level])
        self._unset: list[np.ndarray] | None = None

    @property
    def unset(self) -> list[np.ndarray]:
        if self._unset is None:
            self._unset = [~b for b in self.bits]
        return self._unset

    def number_touched(self) -> int:
        """How many baskets have something satisfied."""
        if self.have is not None:
            return int(np.count_nonzero(self.have))
        return int(np.bitwise_count(_any(self.bits)).sum())

    def highest(self) -> int:
        """The most lines that a basket has satisfied."""
        if self.have is not None:
            return self.most
        most, among = 0, None
        for k in reversed(range(len(self.bits))):
            on = self.bits[k] if among is None else among & self.bits[k]
            if on.any():
                most, among = most + (1 << k), on
        return most

    def _equal(self, have: int, a: int, b: int) -> np.ndarray:
        out = None
        for k, (on, off) in enumerate(zip(self.bits, self.unset)):
            part = (on if have >> k & 1 else off)[a:b]
            out = part if out is None else out & part
        return out

    def _possible(self, have: int) -> bool:
        return 0 < have <= self.most and (self.have is not None or have >> len(self.bits) == 0)

    def places(self, have: int, size: int | None = None, limit: int | None = None) -> np.ndarray:
        """Baskets with so many satisfied lines, of ``size`` (an index of the block's sizes) or all, in order; the first ``limit``."""
        a, b = (0, self.block.n // 64) if size is None else self.block.words[size : size + 2].tolist()
        if not self._possible(have) or a == b:
            return np.zeros(0, np.int64)
        if self.have is not None:
            return (np.flatnonzero(self.have[a * 64 : b * 64] == have) + a * 64)[:limit]
        return _places(self._equal(have, a, b), limit)[:limit] + a * 64

    def number(self, have: int, size: int | None = None, end: int | None = None) -> int:
        """How many baskets ``places`` has, those before the place ``end`` if given."""
        if end is not None or self.have is not None:
            if self.have is not None or not self._possible(have):
                at = self.places(have, size)
                return len(at) if end is None else int((at < end).sum())
            a, b = (0, self.block.n // 64) if size is None else self.block.words[size : size + 2].tolist()
            whole = min(max(end // 64, a), b)
            words = self._equal(have, a, min(whole + 1, b))
            n = int(np.bitwise_count(words[: whole - a]).sum())
            if whole < b and end % 64:
                n += (int(words[whole - a]) & ((1 << end % 64) - 1)).bit_count()
            return n
        if not self._possible(have):
            return 0
        a, b = (0, self.block.n // 64) if size is None else self.block.words[size : size + 2].tolist()
        return int(np.bitwise_count(self._equal(have, a, b)).sum())

    def _lacking(self, missing: int) -> np.ndarray:
        """Those of ``lacking`` as bits: where no bit of what is satisfied differs from what has to be."""
        planes, differ = self.block.needed(missing, len(self.bits))
        differ, own = differ.copy(), np.empty_like(differ)
        for bits, plane in zip(self.bits, planes):
            np.bitwise_or(differ, np.bitwise_xor(bits, plane, out=own), out=differ)
        for bits in self.bits[len(planes) :]:
            np.bitwise_or(differ, bits, out=differ)
        return np.bitwise_not(differ, out=differ)

    def lacking(self, missing: int) -> np.ndarray:
        """Baskets with something satisfied that lack so many lines, in order."""
        if self.have is None:
            return _places(self._lacking(missing))
        found = [self.places(int(t) - missing, s) for s, t in enumerate(self.block.sizes) if 0 < t - missing <= self.most]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def number_lacking(self, missing: int) -> int:
        if self.have is None:
            return int(np.bitwise_count(self._lacking(missing)).sum())
        return sum(self.number(int(t) - missing, s) for s, t in enumerate(self.block.sizes) if 0 < t - missing <= self.most)

    def _open(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of these baskets, and which of them are held."""
        b = self.block
        rows = spans(b.start[at], b.size[at])
        b.has[self.held] = True
        held = b.has[b.code[rows]]
        b.has[self.held] = False
        return rows, held

    def scores(self, at: np.ndarray) -> np.ndarray:
        b = self.block
        if self.have is not None:
            num = self.sum[at]
        else:
            num, byte, bit = np.zeros(len(at)), at >> 3, (at & 7).astype(np.uint8)
            for c in self.held if len(at) else []:
                for bits in b.layers(c):
                    num += b.weight[c] * (bits.view(np.uint8)[byte] >> bit & 1)
        root = b.root[at]
        return rounded(np.where(root > 0, num / np.where(root > 0, root, 1.0), 0.0))

    def satisfied(self, at: np.ndarray) -> np.ndarray:
        """How many lines of these baskets are satisfied."""
        if self.have is not None or not len(at):
            return self.have[at] if self.have is not None else np.zeros(0, np.int64)
        held = self._open(at)[1]
        return np.add.reduceat(held.astype(np.int64), np.cumsum(self.block.size[at]) - self.block.size[at])

    def touched(self) -> tuple[np.ndarray, np.ndarray]:
        """Every basket with something satisfied, and the scores."""
        b = self.block
        if self.have is not None:
            at = np.flatnonzero(self.have)
            return at, self.scores(at)
        posts = [b.posted[b.cut[c] : b.cut[c + 1]] for c in self.held]
        if not posts:
            return np.zeros(0, np.int64), np.zeros(0)
        num = np.bincount(np.concatenate(posts), weights=np.repeat(b.weight[self.held], [len(x) for x in posts]), minlength=b.n)
        at = _places(_any(self.bits))
        root = b.root[at]
        return at, rounded(np.where(root > 0, num[at] / np.where(root > 0, root, 1.0), 0.0))

    def reaching(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Every basket with at least this score (others may be among them), and the scores.

        A score is at most the root of the satisfied weight, so that weight is added up in bits, rounded up to parts of what is
        needed, and only baskets that reach it are looked at one by one."""
        b, needed = self.block, max(least - 1e-6, 0.0) ** 2
        if not b.bounded or needed <= 1e-9:
            return self.touched()
        if b.weight[self.held].max() > needed * 64:
            return self.touched()
        levels: list[list[np.ndarray]] = [[] for _ in range((PARTS * 65).bit_length())]
        for c in self.held:
            parts = int(np.ceil(b.weight[c] / needed * PARTS * (1 + 1e-9)))
            for bits in b.layers(c):
                for k in range(parts.bit_length()):
                    if parts >> k & 1:
                        levels[k].append(bits)
        sums = added(levels)
        if len(sums) < PARTS.bit_length():
            return np.zeros(0, np.int64), np.zeros(0)
        reached = sums[PARTS.bit_length() - 1]  # a power of two
        for bits in sums[PARTS.bit_length() :]:
            reached = reached | bits
        if int(np.bitwise_count(reached).sum()) * 20 > b.n:
            return self.touched()
        some = np.flatnonzero(reached)
        at = (some[:, None] * 64 + np.arange(64)).reshape(-1)[np.unpackbits(reached[some].view(np.uint8), bitorder="little").view(bool)]
        most = np.zeros(len(at), np.int64)
        for k, bits in enumerate(sums):
            most += (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << k
        at = at[most * (needed / PARTS) * (1 + 1e-9) >= (least - 1e-6) * b.root[at]]
        return at, self.scores(at)

    def open_items(self, at: np.ndarray) -> np.ndarray:
        """Codes of the options of unsatisfied lines of these baskets, once for each line."""
        b = self.block
        if self.have is None:
            rows, held = self._open(at)
            codes = b.code[rows[~held]]
        else:
            rows = spans(b.start[at], b.size[at])
            codes = b.code[rows[~np.isin(b.line[rows], self.lines)]]
        return codes[codes >= 0]


def first(k: int, *keys: np.ndarray) -> np.ndarray:
    """Places of the first k by these keys, ascending, the first key first (ties beyond them by place)."""
    if len(keys[0]) > k:
        least = np.partition(keys[0], k - 1)[k - 1] if k > 0 else -np.inf
        near = np.flatnonzero(keys[0] <= least)
    else:
        near = np.arange(len(keys[0]))
    return near[np.lexsort([key[near] for key in reversed(keys)])][: max(k, 0)]


def _packed(rows: DataFrame) -> DataFrame:
    """One row a basket of ``rows`` (rid, line_no, id, w, total, den); without line_no, each row is a line of its own."""
    lines = "line_no" in rows.columns
    line = F.collect_list(F.struct(*(["line_no"] if lines else []), "id", "w"))
    packed = rows.groupBy("rid").agg(F.first("total").alias("total"), F.first("den").alias("den"), line.alias("l"))
    part = lambda c: F.transform("l", lambda x: x[c])
    number = part("line_no") if lines else F.transform("l", lambda _, i: i)
    plain = F.size(F.array_distinct(number)) == F.size("l") if lines else F.lit(True)
    return packed.select("rid", "total", "den", number.alias("line"), part("id").alias("id"), part("w").alias("w"), plain.alias("plain"))


def _listed(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each value of the lists, and the values."""
    lists = lists.combine_chunks()
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten()


def _lines(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, place of the entry (-1 if unread) and whether it is optional, of each line of ``basket.line_codes``, once each."""
    owner, read = _listed(table.column("read"))
    read = read.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort([read, owner])
    owner, read = owner[order], read[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (read[1:] != read[:-1]))[: len(order)]
    owner, read = owner[new], read[new]
    parts = [owner], [read >> 32], [(read >> 1) & (2**31 - 1)], [read & 1]
    owner, rest = _listed(table.column("rest"))
    if len(rest):
        fields = rest.field("line"), pc.fill_null(rest.field("code"), -1), rest.field("optional").cast(pa.int64())
        for part, add in zip(parts, (owner, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in fields))):
            part.append(add)
        order = np.argsort(np.concatenate(parts[0]), kind="stable")
        owner, line, code, optional = (np.concatenate(part)[order] for part in parts)
        return owner, line, code, optional
    return tuple(part[0] for part in parts)


def _needed(table: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and entry of each line (as of ``_lines``), and which of them are needed: not optional and no staple."""
    owner, line, code, optional = _lines(table)
    staple = np.append(known.column("staple").to_numpy(), False)
    return owner, line, code, (optional == 0) & ~staple[code]


def _distinct_ids(owner: np.ndarray, code: np.ndarray, known: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The distinct ids of each row: the row and the place in the ids, and the ids."""
    ids = known.column("id").combine_chunks().dictionary_encode()
    at = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own, which = owner[code >= 0], at[code[code >= 0]]
    both = np.unique(own * max(len(ids.dictionary), 1) + which)
    return both // max(len(ids.dictionary), 1), both % max(len(ids.dictionary), 1), ids.dictionary


def counted_lines(baskets: DataFrame, known: pa.Table) -> DataFrame:
    """id, df: how many of the baskets (of ``basket.line_codes``) with a needed line name each item; the null id counts them all."""
    shared = baskets.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            owner, _, code, need = _needed(table, shared.value)
            kept = np.zeros(table.num_rows, bool)
            kept[owner[need]] = True
            own, which, ids = _distinct_ids(owner, code, shared.value)
            more = np.bincount(which[kept[own]], minlength=len(ids))
            counts, n = more if counts is None else counts + more, n + int(kept.sum())
        if counts is not None:
            some = np.flatnonzero(counts)
            names = pa.concat_arrays([ids.take(pa.array(some)), pa.array([None], pa.string())])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(counts[some], n), pa.int64())], names=["id", "n"])

    return baskets.mapInArrow(run, "id string, n long").groupBy("id").agg(F.sum("n").alias("df")).where("df > 0")


_PACKED = "rid string, total long, den double, line array<long>, id array<string>, w array<double>, plain boolean"


def gathered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct items of each basket, packed; they have no weight."""
    from wicker.operators import basket

    known = basket.entries(spark, sf_dir)
    lines, shared = basket.line_codes(spark, sf_dir, known), spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            owner, _, code, _ = _lines(table)
            own, which, ids = _distinct_ids(owner, code, shared.value)
            n = np.bincount(own, minlength=table.num_rows)
            some = np.flatnonzero(n)
            cut = pa.array(np.append(0, np.cumsum(n[some])), pa.int32())
            line = np.arange(len(own)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
            lists = [pa.ListArray.from_arrays(cut, x) for x in (pa.array(line, pa.int64()), ids.take(pa.array(which)), pa.array(np.zeros(len(own))))]
            rid = table.column("rid").combine_chunks().take(pa.array(some))
            columns = [rid, pa.array(n[some], pa.int64()), pa.array(np.zeros(len(some))), *lists, pa.array(np.ones(len(some), bool))]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "total", "den", "line", "id", "w", "plain"])

    return lines.mapInArrow(run, _PACKED)


def item_rows_of(packed: DataFrame) -> DataFrame:
    """rid, id, n of packed items."""
    return packed.select("rid", F.explode("id").alias("id"), F.col("total").alias("n"))


def weighed(baskets: DataFrame, idf: pa.Table, known: pa.Table) -> DataFrame:
    """The needed lines of baskets (of ``basket.line_codes``), packed: a place an option, with a null id for an unread line. The weight
    of a line is its best option's, and ``idf`` (id, idf) goes to every task."""
    shared = baskets.sparkSession.sparkContext.broadcast((idf, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, known = shared.value
        names, value = idf.column("id").combine_chunks(), np.append(numbers(idf, "idf"), 0.0)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            owner, line, code, need = _needed(table, known)
            owner, line, code = owner[need], line[need], code[need]
            n = np.bincount(owner, minlength=table.num_rows)
            some = np.flatnonzero(n)
            cut = pa.array(np.append(0, np.cumsum(n[some])), pa.int32())
            id_ = known.column("id").combine_chunks().take(pa.array(code, mask=code < 0))
            lists = [pa.ListArray.from_arrays(cut, pa.array(line, pa.int64())), pa.ListArray.from_arrays(cut, id_)]
            table = pa.table([table.column("rid").combine_chunks().take(pa.array(some)), pa.array(n[some], pa.int64()), *lists], names=["rid", "total", "line", "id"])
            cut, line = edges(table, "id"), numbers(table, "line").astype(np.int64)
            owner = np.repeat(np.arange(table.num_rows), np.diff(cut))
            code = pc.index_in(table.column("id").combine_chunks().flatten(), names, skip_nulls=True)
            w = value[pc.fill_null(code, -1).to_numpy(zero_copy_only=False)]
            order = np.lexsort([line, owner])
            new = np.append(True, (np.diff(owner[order]) != 0) | (np.diff(line[order]) != 0))[: len(order)]
            begin = np.flatnonzero(new)
            of, best = np.cumsum(new) - 1, np.maximum.reduceat(w[order], begin) if len(order) else w
            share = np.empty_like(w)
            w[order], share[order] = best[of], (best / np.diff(np.append(begin, len(order))))[of]
            den = np.bincount(owner, weights=share, minlength=table.num_rows)
            lines = np.bincount(owner[order][begin], minlength=table.num_rows)
            columns = [table.column(c).combine_chunks() for c in ("rid", "total")] + [pa.array(den), table.column("line").combine_chunks(), table.column("id").combine_chunks()]
            columns += [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(w)), pa.array(lines == np.diff(cut))]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "total", "den", "line", "id", "w", "plain"])

    return baskets.mapInArrow(run, _PACKED)


def _bundle(baskets: pa.Table) -> bytes:
    """Packed baskets compressed, each item and weight once: every block of queries gets its own copy of them."""
    for c in ("id", "w"):
        lists = baskets.column(c).combine_chunks()
        coded = pa.ListArray.from_arrays(pa.array(edges(baskets, c), pa.int32()), lists.flatten().dictionary_encode())
        baskets = baskets.set_column(baskets.schema.get_field_index(c), c, coded)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, baskets.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(baskets)
    return sink.getvalue().to_pybytes()


def _unbundled(bundles: list[bytes], coded: bool = False) -> pa.Table:
    """The baskets of all bundles; with ``coded``, ids as places in one dictionary."""
    parts = []
    for bundle in bundles:
        part = pa.ipc.open_stream(bundle).read_all()
        for c in ("w",) if coded else ("id", "w"):
            lists = part.column(c).combine_chunks()
            part = part.set_column(part.schema.get_field_index(c), c, pa.ListArray.from_arrays(lists.offsets, lists.values.dictionary_decode()))
        parts.append(part)
    whole = pa.concat_tables(parts)
    return whole.unify_dictionaries() if coded else whole


def _bundled(packed: DataFrame) -> DataFrame:
    """_b, bundle: the packed baskets of each block, in as few rows as may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.Table]] = defaultdict(list)

        def row(b: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([_bundle(pa.concat_tables(waiting.pop(b)))], pa.binary())], names=["_b", "bundle"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for b in pc.unique(table.column("_b")).to_pylist():
                waiting[b].append(table.filter(pc.equal(table.column("_b"), b)).drop_columns(["_b"]))
                if sum(part.num_rows for part in waiting[b]) >= BUNDLED:
                    yield row(b)
        for b in list(waiting):
            yield row(b)

    return packed.mapInArrow(run, "_b long, bundle binary")


class Packed:
    """Baskets packed and written once, for several searches. Their blocks are ranges of rid, so that ties by rid go to the
    first blocks."""

    def __init__(self, packed: DataFrame):
        self.table = written(packed)
        self.n = self.table.count()
        self.begin: list[str] = []
        if (blocks := -(-self.n // BASKETS)) > 1:
            placed = self.table.select("rid").where("rid is not null").repartitionByRange(blocks, "rid").withColumn("p", F.spark_partition_id())
            self.begin = sorted(r["rid"] for r in placed.groupBy("p").agg(F.min("rid").alias("rid")).collect())[1:]
        self.blocks = len(self.begin) + 1

    def block(self) -> Column:
        return F.coalesce(sum(((F.col("rid") >= F.lit(x)).cast("int") for x in self.begin), F.lit(0)), F.lit(0))

    def rows(self) -> DataFrame:
        """rid, line_no, id, w, total, den, as they were packed."""
        return self.table.select("rid", "total", "den", F.inline(F.arrays_zip("line", "id", "w"))).select("rid", F.col("line").alias("line_no"), "id", "w", "total", "den")


def search(queries: DataFrame, rows: DataFrame | Packed, pick: Callable[[Block, Hits, tuple], tuple], schema: str, given: int = 30, given_in_parts: int = 0, merge: Callable | None = None) -> DataFrame:
    """What ``pick`` gives for each query and block, as rows of ``schema`` with ``qid`` before them.

    ``queries`` holds qid, ids (an array) and further columns, given to ``pick`` as a tuple; ``rows`` holds rid, line_no, id,
    w, total, den, all rows of a basket (or has them packed). ``pick`` gives an array for each column of the schema, a rid as its place and an id
    as its code, about ``given`` rows a query. Queries without items and empty tables give no rows. With ``merge``, a task searches
    several blocks, in the order of rid, and only the rows that it chooses (of the query's number and columns by name) are kept.
    """
    spark = queries.sparkSession
    n_queries = queries.count()
    rows = rows if isinstance(rows, Packed) else Packed(_packed(rows))
    basket_blocks = rows.blocks
    span = SPAN if merge else 1
    lanes = -(-basket_blocks // span)
    wanted = -(-spark.sparkContext.defaultParallelism // lanes)
    given = max(given, given_in_parts) if basket_blocks > 1 else given
    given *= 1 if lanes == basket_blocks else 2  # two blocks' rows are there while they are merged
    query_blocks = max(1, -(-n_queries // QUERIES), -(-n_queries * given // GIVEN), min(wanted, -(-n_queries // LEAST_QUERIES)))
    groups = Groups(spark, lanes * query_blocks)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = queries.withColumn("_q", block("qid", query_blocks)).withColumn("_l", every(lanes))
    left = _bundled(rows.table.withColumn("_b", rows.block().cast("long"))).withColumn("_q", every(query_blocks))
    left = left.withColumn("_l", F.floor(F.col("_b") / span))
    group = F.col("_q") * lanes + F.col("_l")
    right = right.select(groups.key(group), *queries.columns)
    left = left.select(groups.key(group), "_b", "bundle")
    names, kinds = zip(*(part.split() for part in schema.split(", ")))
    rest_columns = [c for c in queries.columns if c not in ("qid", "ids")]

    def one(baskets: pa.Table, asked: pa.Table) -> pa.Table:
        """What one block gives, with the numbers of the queries."""
        who: list[np.ndarray] = []
        out: list[list[np.ndarray]] = [[] for _ in names]
        made = None
        if baskets.num_rows and asked.num_rows:
            made = Block(_unbundled(baskets.column("bundle").to_pylist(), True))
            made.whole, made.number = basket_blocks == 1, int(baskets.column("_b")[0].as_py())
            named = pa.array(made.rids, pa.string())
            more = [asked.column(c).to_pylist() for c in rest_columns]
            begin, codes = edges(asked, "ids"), pc.index_in(asked.column("ids").combine_chunks().flatten(), made.items)
            codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False)
            for q in range(asked.num_rows):
                held = codes[begin[q] : begin[q + 1]]
                held = held[held >= 0].tolist()
                if not held:
                    continue
                hits = Hits(made, held)
                found = pick(made, hits, tuple(c[q] for c in more))
                who.append(np.full(len(found[0]), q))
                for kept, column in zip(out, found):
                    kept.append(column)
        columns = {"_w": pa.array(np.concatenate(who) if who else np.zeros(0, np.int64))}
        for name, type_, kept in zip(names, kinds, out):
            values = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            if name == "rid":
                columns[name] = named.take(pa.array(values)) if made else pa.array([], pa.string())
            elif name == "id":
                columns[name] = made.items.take(pa.array(values)) if made else pa.array([], pa.string())
            else:
                columns[name] = pa.array(values, pa.float64() if type_ == "double" else pa.int64())
        return pa.table(columns)

    def run(baskets: pa.Table, asked: pa.Table) -> pa.Table:
        found = None
        for b in sorted(pc.unique(baskets.column("_b")).to_pylist()) or [None]:
            more = one(baskets.filter(pc.equal(baskets.column("_b"), pa.scalar(b, pa.int64()))), asked)
            if found is not None:
                more = pa.concat_tables([found, more])
                more = more.take(pa.array(merge(numbers(more, "_w"), {c: numbers(more, c) for c, type_ in zip(names, kinds) if type_ != "string"})))
            found = more
        qids = asked.column("qid").combine_chunks().take(found.column("_w").combine_chunks())
        return found.drop_columns(["_w"]).add_column(0, "qid", qids)

    kind = queries.schema["qid"].dataType.simpleString()
    return groups.cogroup(left, right).applyInArrow(run, f"qid {kind}, {schema}")


def as_queries(held: DataFrame) -> DataFrame:
    """qid, ids of queries given as qid, id; those given with ids stay as they are."""
    return held if "ids" in held.columns else held.groupBy("qid").agg(F.array_sort(F.collect_set("id")).alias("ids"))


_SCORED = "rid string, have long, total long, missing long, score double"


def _scored(hits: Hits, at: np.ndarray, have: np.ndarray, score: np.ndarray | None = None) -> tuple:
    total = hits.block.total[at]
    return at, have, total, total - have, hits.scores(at) if score is None else score


def _joined(parts: list[tuple], columns: int) -> tuple:
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * columns


def _merged(k: int, *keys: Callable[[dict], np.ndarray], apart: str | None = None) -> Callable:
    """Chooses the first k rows of each query, or of each query and value of ``apart``, by these keys, then in the order given."""

    def choose(who: np.ndarray, columns: dict[str, np.ndarray]) -> np.ndarray:
        part = columns[apart] if apart else np.zeros(len(who), np.int64)
        order = np.lexsort([*(key(columns) for key in reversed(keys)), part, who])
        who, part = who[order], part[order]
        new = np.append(True, (who[1:] != who[:-1]) | (part[1:] != part[:-1]))[: len(order)]
        begin = np.flatnonzero(new)
        return order[np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order)))) < k]

    return choose


#: The orders of the arms, before rid.
_SCORE, _TOTAL = lambda c: -c["score"], lambda c: c["total"]
ORDERS = {"overlap": (lambda c: -c["have"], _TOTAL), "idf_flat": (_SCORE, _TOTAL), "shipped": (lambda c: c["missing"], _SCORE, _TOTAL)}


def within(held: DataFrame, need: DataFrame | Packed, missing: int, k: int | None = None) -> DataFrame:
    """qid, rid, have, total, missing, score of every basket that lacks at most so many lines; with ``k``, a superset of the
    first k by score, fewest lines and rid of each number of missing lines, those of each block."""

    def pick(block: Block, hits: Hits, _: tuple) -> tuple:
        parts = []
        for m in range(missing + 1):
            at = hits.lacking(m)
            score = hits.scores(at)
            if k is not None:
                best_ = first(k, -score)
                at, score = at[best_], score[best_]
            parts.append(_scored(hits, at, block.total[at] - m, score))
        return _joined(parts, 5)

    if k is None:
        return search(as_queries(held), need, pick, _SCORED, 2_000)
    return search(as_queries(held), need, pick, _SCORED, (missing + 1) * k, merge=_merged(k, _SCORE, _TOTAL, apart="missing"))


def counts_within(held: DataFrame, need: DataFrame | Packed, missing: int) -> DataFrame:
    """qid, missing, n: how many baskets of each block lack so many lines, up to ``missing``; none where there are none."""

    def pick(block: Block, hits: Hits, _: tuple) -> tuple:
        n = np.array([hits.number_lacking(m) for m in range(missing + 1)])
        some = np.flatnonzero(n)
        return some, n[some]

    return search(as_queries(held), need, pick, "missing long, n long", missing + 1)


def open_counts(held: DataFrame, need: DataFrame | Packed, missing: int, top: int) -> DataFrame:
    """qid, id, n: the options of unsatisfied lines of the baskets that lack exactly so many lines, counted by block; where one
    block has all baskets, only the first ``top`` by number and id."""

    def pick(block: Block, hits: Hits, _: tuple) -> tuple:
        n = np.bincount(hits.open_items(hits.lacking(missing)), minlength=len(block.items))
        some = np.flatnonzero(n)
        if block.whole:
            some = some[first(top, -n[some], block.item_rank[some])]
        return some, n[some]

    return search(as_queries(held), need, pick, "id string, n long", top, 200)


def best(held: DataFrame, need: DataFrame | Packed, arm: str, k: int) -> DataFrame:
    """qid, rid, have, total, missing, score: a superset of the first k of an arm, the first k of each block."""

    def overlap(block: Block, hits: Hits, _: tuple) -> tuple:
        parts, left = [], k
        for have in range(hits.highest(), 0, -1):
            if left <= 0:
                break
            at = hits.places(have, limit=left)
            if len(at):
                parts.append((at, np.full(len(at), have)))
                left -= len(at)
        return _scored(hits, *_joined(parts, 2))

    def idf_flat(block: Block, hits: Hits, _: tuple) -> tuple:
        at, score = hits.touched()
        best_ = first(k, -score)
        return _scored(hits, at[best_], hits.satisfied(at[best_]), score[best_])

    def random(block: Block, hits: Hits, asked: tuple) -> tuple:
        start, at = f"42:{asked[0]}:".encode(), hits.touched()[0]
        if not block.named:
            block.named.extend("" if r is None else r.encode() for r in block.rids)
        drawn = heapq.nsmallest(max(k, 0), ((hashlib.sha256(start + block.named[p]).digest(), p) for p in at.tolist()))
        at = np.array([p for _, p in drawn], np.int64)
        return _scored(hits, at, hits.satisfied(at))

    def shipped(block: Block, hits: Hits, _: tuple) -> tuple:
        parts, left = [], k
        for m in range(int(block.sizes[-1])):
            if left <= 0:
                break
            at = hits.lacking(m)
            if len(at):
                score = hits.scores(at)
                best_ = first(left, -score)
                at, score, left = at[best_], score[best_], left - len(best_)
                parts.append(_scored(hits, at, block.total[at] - m, score))
        return _joined(parts, 5)

    asked = as_queries(held)
    if arm == "random":
        return search(asked.withColumn("q", F.col("qid")), need, random, _SCORED, k)
    return search(asked, need, {"overlap": overlap, "idf_flat": idf_flat, "shipped": shipped}[arm], _SCORED, k, merge=_merged(k, *ORDERS[arm]))


def _item_rows(items: DataFrame) -> DataFrame:
    return items.select("rid", "id", F.lit(0.0).alias("w"), F.col("n").alias("total"), F.lit(0.0).alias("den"))


def packed_items(items: DataFrame) -> Packed:
    """``items`` as for ``pools``, for several searches."""
    return Packed(_packed(_item_rows(items)))


def _first_pooled(block: Block, hits: Hits, cap: int, cut: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, shared items and sizes of the first ``cap`` baskets of a pool; with ``cut``, of all baskets before the class of
    so many shared items and so many items (0 and 0 for the complete ones), and so many of that class."""
    at = hits.lacking(0)  # those of all sizes are equal but for the rid
    here = cap
    if cut is not None:
        here = len(at) if cut[1] else cut[2]
    at = at[first(here, block.rank[at])]
    parts, left = [(at, block.total[at], block.total[at])], cap - len(at)
    if cut is not None and not cut[1]:
        return parts[0]
    last = cut and (-(cut[0] / cut[1]), cut[1] - cut[0])
    for s, t, have in block.covering(hits.most):
        if left <= 0 or (last and (-(have / t), t - have) > last):
            break
        at = hits.places(have, s, cut[2] if last and (have, t) == cut[:2] else left)
        if len(at):
            parts.append((at, np.full(len(at), have), np.full(len(at), t)))
            left -= len(at)
    return _joined(parts, 3)


def pools(queries: DataFrame, items: DataFrame | Packed, cap: int) -> DataFrame:
    """qid, rid, matched, n: a superset of the first ``cap`` baskets by coverage and fewest missing, those of each block.

    ``items`` holds rid, id (distinct) and n, the number of items of the basket, or has them packed."""

    def pick(block: Block, hits: Hits, _: tuple) -> tuple:
        return _first_pooled(block, hits, cap)

    return search(as_queries(queries), items if isinstance(items, Packed) else _item_rows(items), pick, "rid string, matched long, n long", cap, merge=_merged(cap, lambda c: -(c["matched"] / c["n"]), lambda c: c["n"] - c["matched"]))


def _cuts(asked: DataFrame, baskets: Packed, cap: int) -> DataFrame:
    """qid, n_pool and, for queries with more than ``cap`` baskets, the class that fills the pool: c_matched, c_total (0 for the
    complete ones), c_left (how many of it), c_blocks and c_counts (where they are)."""

    def pick(block: Block, hits: Hits, _: tuple) -> tuple:
        rows, left = [(0, 0, hits.number_lacking(0))], cap
        left -= rows[0][2]
        for s, t, have in block.covering(hits.most):
            if left <= 0:
                break
            rows.append((have, t, hits.number(have, s)))
            left -= rows[-1][2]
        matched, total, n = np.array(rows, np.int64).T
        some = np.flatnonzero(n)
        return np.full(len(some), block.number), matched[some], total[some], n[some]

    found = search(asked.select("qid", "ids"), baskets, pick, "block long, matched long, total long, n long", 20)
    classes = found.repartition("qid").groupBy("qid", "matched", "total").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("block", "n"))).alias("l"))
    coverage = F.when(F.col("total") == 0, 1.0).otherwise(F.col("matched") / F.col("total"))
    order = Window.partitionBy("qid").orderBy(F.desc("coverage"), F.col("total") - F.col("matched"))
    upto = classes.withColumn("coverage", coverage).withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("upto") - F.col("n")
    cut = F.when((before < cap) & (F.col("upto") >= cap), F.struct("matched", "total", (cap - before).alias("left"), "l"))
    per = upto.groupBy("qid").agg(F.least(F.max("upto"), F.lit(cap)).alias("n_pool"), F.max(cut).alias("c"))
    part = lambda c: F.transform("c.l", lambda x: x[c])
    return per.select("qid", "n_pool", F.col("c.matched").alias("c_matched"), F.col("c.total").alias("c_total"), F.col("c.left").alias("c_left"), part("block").alias("c_blocks"), part("n").alias("c_counts"))


def _fills(block: Block, subs: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each item with the codes of the block's items that it stands for, and the scores."""
    if block.fills is None:
        subs = subs.append_column("code", pc.index_in(subs.column("a").combine_chunks(), block.items))
        subs = subs.filter(pc.is_valid(subs.column("code"))).sort_by("b")
        names, code, score = subs.column("b").to_pylist(), numbers(subs, "code"), numbers(subs, "score")
        cuts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
        block.fills = {names[x]: (code[x:y], score[x:y]) for x, y in zip(cuts, [*cuts[1:], len(names)])}
    return block.fills


def featured_pools(queries: DataFrame, baskets: Packed, cap: int, subs: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """qid, rid, n_matched, n_items, n_held, sub_max, sub_sum, label, n_pool of exactly the first ``cap`` baskets of each query.

    A missing item is filled by its best held substitute, floor 0: sub_max and sub_sum are over the missing items of a basket.
    ``subs`` holds a, b, score (b stands for a) over the reference table, and goes to every task. The label is 1 for the
    basket that ``gold`` (qid, rid) has. With several blocks a first search counts the classes of equal coverage, so that no
    candidate beyond the pool is ever given, and none is shuffled.
    """
    asked = as_queries(queries).withColumn("own", F.col("ids"))
    golds = queries.select("qid").distinct().withColumn("gold", F.lit(None).cast("string")) if gold is None else gold.groupBy("qid").agg(F.first("rid").alias("gold"))
    asked = asked.join(golds, "qid", "left")
    if baskets.blocks > 1:
        asked = asked.join(_cuts(asked, baskets, cap), "qid", "left")
    shared = asked.sparkSession.sparkContext.broadcast(subs.select("a", "b", "score").toArrow())
    columns = asked.columns[2:]

    def pick(block: Block, hits: Hits, more: tuple) -> tuple:
        row, cut = dict(zip(columns, more)), None
        if row.get("c_left") is not None:
            earlier = sum(n for k, n in zip(row["c_blocks"], row["c_counts"]) if k < block.number)
            cut = row["c_matched"], row["c_total"], max(row["c_left"] - earlier, 0)
        at, matched, n = _first_pooled(block, hits, cap, cut)
        fill, by = np.zeros(len(block.items) + 1), _fills(block, shared.value)
        for item in row["own"]:
            if item in by:
                codes, scores = by[item]
                fill[codes] = np.maximum(fill[codes], scores)  # an item stands for another once
        if len(at):
            rows, held = hits._open(at)
            value, starts = np.where(held, 0.0, fill[block.code[rows]]), np.cumsum(block.size[at]) - block.size[at]
            most, total = np.maximum.reduceat(value, starts), np.add.reduceat(value, starts)
        else:
            most = total = np.zeros(0)
        label = block.rids[at] == row["gold"] if row["gold"] is not None else np.zeros(len(at))
        return at, matched, n, np.full(len(at), len(row["own"])), most, total, np.asarray(label, np.int64), np.full(len(at), row.get("n_pool") or len(at))

    schema = "rid string, n_matched long, n_items long, n_held long, sub_max double, sub_sum double, label long, n_pool long"
    return search(asked, baskets, pick, schema, 2 * cap)


def pool_ranks(queries: DataFrame, items: DataFrame | Packed, own: DataFrame, upto: int | None = None) -> DataFrame:
    """qid, rank: the place of the gold basket of each query in an unbounded pool; each block counts the baskets before it. With
    ``upto``, of places up to it: a block that has so many baskets before the gold counts no further.

    ``items`` as for ``pools``; ``own`` holds qid, g_rid, g_matched (at least one) and g_n, one basket a query."""

    def pick(block: Block, hits: Hits, asked: tuple) -> tuple:
        rid, matched, n = asked
        if matched == n:
            return (np.array([sum(hits.number(int(t), s, block.before(int(t), rid)) for s, t in enumerate(block.sizes) if t <= hits.most)]),)
        before = hits.number_lacking(0)
        if upto is not None and before >= upto:
            return (np.array([before]),)
        for s, t, have in block.covering(hits.most):
            if upto is not None and before >= upto:
                return (np.array([before]),)
            if (-(have / t), t - have) >= (-(matched / n), n - matched):
                break
            before += hits.number(have, s)
        s = int(np.searchsorted(block.sizes, n))
        if s < len(block.sizes) and block.sizes[s] == n:
            before += hits.number(matched, s, block.before(n, rid))
        return (np.array([before]),)

    asked = as_queries(queries).join(own.select("qid", "g_rid", "g_matched", "g_n"), "qid")
    ranks = search(asked, items if isinstance(items, Packed) else _item_rows(items), pick, "before long", 1).groupBy("qid").agg((F.sum("before") + 1).alias("rank"))
    return ranks if upto is None else ranks.where(F.col("rank") <= upto)


def makeable(held: DataFrame, need: DataFrame | Packed) -> DataFrame:
    """qid, complete, touched: baskets that lack nothing, and all that share something with the query, counted by block."""

    def pick(block: Block, hits: Hits, _: tuple) -> tuple:
        return np.array([hits.number_lacking(0)]), np.array([hits.number_touched()])

    return search(as_queries(held), need, pick, "complete long, touched long", 1).groupBy("qid").agg(F.sum("complete").alias("complete"), F.sum("touched").alias("touched"))


def _own(held: DataFrame, need: DataFrame | Packed, gold: DataFrame) -> DataFrame:
    """qid, g_rid, g_have, g_total, g_score of the gold basket of each query that shares something with it."""
    if isinstance(need, Packed) and "ids" in held.columns:  # rows only of lines that are held
        both = gold.join(need.table.drop("plain"), "rid").join(held, "qid")
        line = F.filter(F.arrays_zip("line", "id", "w"), lambda x: F.array_contains("ids", x["id"]))
        own = both.select("qid", "rid", "total", "den", F.inline(line)).withColumnRenamed("line", "line_no")
    else:
        own = gold.join(need.rows() if isinstance(need, Packed) else need, "rid").join(held, ["qid", "id"])
    own = own.groupBy("qid", "rid", "line_no").agg(F.max("w").alias("w"), F.max("total").alias("total"), F.max("den").alias("den"))
    own = own.groupBy("qid", "rid").agg(F.count(F.lit(1)).alias("g_have"), F.sum("w").alias("num"), F.max("total").alias("g_total"), F.max("den").alias("den"))
    score = F.when(F.col("den") > 0, F.col("num") / F.sqrt("den")).otherwise(0.0)
    return own.select("qid", F.col("rid").alias("g_rid"), "g_have", "g_total", F.round(score, 6).alias("g_score"))


def shown_before(held: DataFrame, need: DataFrame | Packed, gold: DataFrame, missing: int) -> DataFrame:
    """qid, before: for gold baskets that lack at most so many lines, the baskets before them among those that lack as many, by
    score, fewest lines and rid, counted by block."""
    own = _own(held, need, gold).where(F.col("g_total") - F.col("g_have") <= missing)

    def pick(block: Block, hits: Hits, asked: tuple) -> tuple:
        rid, have, total, score = asked
        at = hits.lacking(total - have)
        value = hits.scores(at)
        return (np.array([int(((value > score) | ((value == score) & (at < block.before(total, rid)))).sum())]),)

    return search(as_queries(held).join(own, "qid"), need, pick, "before long", 1).groupBy("qid").agg(F.sum("before").alias("before"))


def gold_ranks(held: DataFrame, need: DataFrame | Packed, gold: DataFrame) -> DataFrame:
    """qid, rank_overlap, rank_idf_flat of the gold basket of each query: one more than the baskets before it; null for a gold
    basket that shares nothing with its query. ``gold`` holds qid, rid.

    The gold is scored first, by a join on query and basket; then each block counts the baskets before it.
    """

    def pick(block: Block, hits: Hits, asked: tuple) -> tuple:
        rid, have, total, score = asked
        place = block.before(total, rid)
        more = sum(hits.number(h) for h in range(have + 1, hits.most + 1)) + hits.number(have, end=place)
        at, value = hits.reaching(score)
        higher = int(((value > score) | ((value == score) & (at < place))).sum())
        return np.array([more]), np.array([higher])

    counted = search(as_queries(held).join(_own(held, need, gold), "qid"), need, pick, "overlap long, idf_flat long", 1).groupBy("qid").agg(
        (F.sum("overlap") + 1).alias("rank_overlap"), (F.sum("idf_flat") + 1).alias("rank_idf_flat")
    )
    return gold.select("qid").join(counted, "qid", "left")
