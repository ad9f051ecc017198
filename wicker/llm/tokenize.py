"""Encoding of a whole corpus with a public byte-level tokenizer by merge replay.

Text is cut into words by the tokenizer's pattern, and the distinct words of the whole corpus are counted into one table. The
merges are replayed on that table, so every distinct word is encoded once, wherever it occurs: the words lie in a linked
list of symbols, an inverted index leads from each mergeable pair to its positions, every merge is applied in rank order
to all its positions at once, and only the pairs of touched neighbours are entered anew. No pair holds symbols of two
words, so the parts of the table are replayed apart.

The ids then return to the documents: those of words that make up a fixed share of the corpus, whose number the share bounds,
go to the workers as one table; the others are joined on the word, which by the same bound is never a hot key.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.session import read_table, written

#: Where the vocabulary files of the public tokenizers are; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that cuts text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern above knows it, and runs of the rest with the one blank before: no word reaches over two of these.
CHUNKS = r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+"
#: Words of at least this part of the corpus (one in so many) go to the workers as one table, if they aren't longer than that.
FREQUENT = 500_000
FREQUENT_LENGTH = 64
#: Cuts that a worker keeps; beyond, it starts anew, which changes no result.
KEPT_CHUNKS = 400_000


@dataclass(frozen=True)
class Merges:
    """ids of the 256 bytes, and for each mergeable pair of ids its rank and the id it becomes."""

    of_byte: tuple[int, ...]
    pairs: dict[tuple[int, int], tuple[int, int]]


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


@lru_cache(maxsize=4)
def load_merges(path: str = VOCABULARY) -> Merges:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = {}
    for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return Merges(tuple(vocab[c] for c in _byte_characters()), pairs)


def replay(words: list[str], merges: Merges) -> list[list[int]]:
    """The ids of each word."""
    sym: list[int] = []
    starts = []
    of_byte = merges.of_byte
    for w in words:
        starts.append(len(sym))
        sym.extend(of_byte[b] for b in w.encode("utf-8", "surrogatepass"))
        sym.append(-1)  # parts words; no pair holds it
    n = len(sym)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    table = merges.pairs
    index: dict[int, list[int]] = {}
    made: dict[int, tuple[int, int, int]] = {}
    for p in range(n - 1):
        hit = table.get((sym[p], sym[p + 1]))
        if hit is not None:
            if hit[0] not in index:
                index[hit[0]] = []
                made[hit[0]] = (sym[p], sym[p + 1], hit[1])
            index[hit[0]].append(p)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        positions = index.pop(rank)
        positions.sort()
        a, b, c = made[rank]
        for p in positions:
            if sym[p] != a:
                continue
            q = nxt[p]
            if q >= n or sym[q] != b:
                continue
            after, before = nxt[q], prv[p]
            sym[p] = c
            sym[q] = -2
            nxt[p] = after
            if after < n:
                prv[after] = p
                hit = table.get((c, sym[after]))
                if hit is not None:
                    r = hit[0]
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        made[r] = (c, sym[after], hit[1])
                        heapq.heappush(heap, r)
            if before >= 0:
                hit = table.get((sym[before], c))
                if hit is not None:
                    r = hit[0]
                    if r in index:
                        index[r].append(before)
                    else:
                        index[r] = [before]
                        made[r] = (sym[before], c, hit[1])
                        heapq.heappush(heap, r)
    out = []
    for p in starts:
        ids = []
        while sym[p] != -1:
            ids.append(sym[p])
            p = nxt[p]
        out.append(ids)
    return out


class Cutter:
    """Texts to words. White space parts chunks that are cut alone; the cuts of short chunks are kept."""

    def __init__(self) -> None:
        self.words = regex.compile(PATTERN).findall
        self.chunks = re.compile(CHUNKS).findall

    def count(self, texts: Iterable[str | None]) -> Counter:
        """How often each word stands in the texts."""
        chunks: Counter = Counter()
        for text in texts:
            if text:
                chunks.update(self.chunks(text))
        out: Counter = Counter()
        for chunk, n in chunks.items():
            for word in self.words(chunk):
                out[word] += n
        return out


class KnownIds(Cutter):
    """Texts to the ids of known words, and the other words with their places."""

    def __init__(self, table: Mapping[str, list[int]]):
        super().__init__()
        self.table = table
        self.known: dict[str, list[int] | None] = {}

    def pieces(self, text: str | None) -> tuple[list[tuple[int, list[int]]], list[tuple[int, str]]]:
        """(place, ids) of the runs of known words and (place, word) of the others, by their order."""
        chunks = self.chunks(text) if text else []
        known, table = self.known, self.table
        if len(known) > KEPT_CHUNKS:
            known.clear()
        for chunk in chunks:
            if chunk not in known:
                ids = [table.get(w) for w in self.words(chunk)]
                known[chunk] = None if None in ids else list(chain.from_iterable(ids))
        runs = [known[c] for c in chunks]
        if None not in runs:
            return [(0, list(chain.from_iterable(runs)))], []
        parts: list[tuple[int, list[int]]] = []
        rare: list[tuple[int, str]] = []
        for chunk, ids in zip(chunks, runs):
            for word_ids, word in [(ids, "")] if ids is not None else [(table.get(w), w) for w in self.words(chunk)]:
                at = len(parts) + len(rare)
                if word_ids is None:
                    rare.append((at, word))
                elif parts and parts[-1][0] == at - 1:
                    parts[-1][1].extend(word_ids)
                else:
                    parts.append((at, list(word_ids)))
        return parts, rare


def _blocks(texts: pa.Array, budget: int = 8_000_000) -> Iterator[list[str | None]]:
    """The texts of a batch in blocks of about ``budget`` bytes, so that long texts don't pile up in memory."""
    block: list[str | None] = []
    size = 0
    for t in texts:
        text = t.as_py()
        block.append(text)
        size += len(text or "")
        if size >= budget:
            yield block
            block, size = [], 0
    if block:
        yield block


def word_ids(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """word, n, ids: each distinct word of the corpus, how often it occurs, and its ids. A table in the shared folder."""
    spark = df.sparkSession
    merges = spark.sparkContext.broadcast(load_merges(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in batches:
            for block in _blocks(batch.column(0)):
                found = cutter.count(block)
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(0), 4_000_000):
                rows = batch.slice(at, len(block))
                at += len(block)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(replay(block, merges.value), pa.list_(pa.int32()))], names=["word", "n", "ids"])

    words = df.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(words.mapInArrow(merge, "word string, n long, ids array<int>"))


def _frequent(words: DataFrame) -> tuple[dict[str, list[int]], DataFrame]:
    """The ids of the words that are at least 1 / ``FREQUENT`` of the corpus each (so at most ``FREQUENT`` of them, each of
    at most ``FREQUENT_LENGTH`` characters), and the table of the others."""
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = (F.col("n") * FREQUENT >= total) & (F.length("word") <= FREQUENT_LENGTH)
    table = words.where(frequent).select("word", "ids").toArrow()
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist())), words.where(~frequent)


_PARTS = pa.list_(pa.struct([("at", pa.int32()), ("ids", pa.list_(pa.int32()))]))
_RARE = pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string())]))


def _nested(rows: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """A list array of structs with two fields, built from flat columns."""
    offsets = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    flat = list(chain.from_iterable(rows))
    fields = [pa.array([x[k] for x in flat], kind.value_type.field(k).type) for k in (0, 1)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))


def encode(spark: SparkSession, df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, ids (array<int>) of every row of ``df``; an empty list for an empty or null text.

    Strings of special tokens are ordinary text. Rows delivered twice come twice, and other columns are never read. The
    vocabulary (a fixed table) goes to the workers once.
    """
    words = word_ids(df, text, vocabulary)
    table, rest = _frequent(words)
    known = spark.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = KnownIds(known.value)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(2)):
                found = [cutter.pieces(t) for t in block]
                rows = batch.slice(at, len(block)).columns[:2]
                at += len(block)
                parts, rare = (_nested([f[k] for f in found], kind) for k, kind in enumerate((_PARTS, _RARE)))
                yield pa.RecordBatch.from_arrays([*rows, parts, rare], names=["row", "key", "parts", "rare"])

    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()
    schema = f"row long, key {kind}, parts array<struct<at int, ids array<int>>>, rare array<struct<at int, word string>>"
    rows = written(texts.mapInArrow(look_up, schema))
    whole = rows.where(F.size("rare") == 0).select("key", F.flatten("parts.ids").alias("ids"))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.at", "r.word")
    found = rare.join(rest.select("word", "ids"), "word").groupBy("row").agg(F.collect_list(F.struct("at", "ids")).alias("found"))
    mended = rows.where(F.size("rare") > 0).join(found, "row")
    ordered = F.array_sort(F.concat("parts", "found"))
    return whole.unionByName(mended.select("key", F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids")))


def count_tokens(spark: SparkSession, df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The other columns of ``df`` with ``n_tokens`` (long) instead of ``text``; 0 for an empty or null text."""
    words = word_ids(df, text, vocabulary)
    table, rest = _frequent(words)
    sizes = spark.sparkContext.broadcast({w: [len(ids)] for w, ids in table.items()})
    others = [c for c in df.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = KnownIds(sizes.value)
        for batch in batches:
            found = [cutter.pieces(t.as_py()) for t in batch.column(1)]
            sums = pa.array([sum(chain.from_iterable(ids for _, ids in parts)) for parts, _ in found], pa.int64())
            rare = pa.array([[w for _, w in words] for _, words in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), sums, rare], names=[*others, "_row", "_sum", "_rare"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in others)
    texts = df.select(F.monotonically_increasing_id().alias("_row"), text, *others)
    rows = written(texts.mapInArrow(count, f"{kinds}_row long, _sum long, _rare array<string>"))
    rare = rows.select("_row", F.explode("_rare").alias("word"))
    found = rare.join(rest.select("word", F.size("ids").alias("n")), "word").groupBy("_row").agg(F.sum("n").alias("_more"))
    whole = rows.where(F.size("_rare") == 0).select(*others, F.col("_sum").alias("n_tokens"))
    mended = rows.where(F.size("_rare") > 0).join(found, "_row")
    return whole.unionByName(mended.select(*others, (F.col("_sum") + F.col("_more")).alias("n_tokens")))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids of every document."""
    encoded = encode(spark, read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return encoded.select(F.col("key").alias("doc_id"), "ids")
