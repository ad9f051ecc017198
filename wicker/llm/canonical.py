"""Mapping freely typed values to a reference list: a prefix-filter set-similarity join.

A value is a set of tokens (the characters and character pairs of its letters). Tokens are ordered by their rarity in the
reference list; two values of similarity t can only be partners if they share a token among the rarest of each, so only
those prefixes are joined. Length, positional and bitmap filters cut the candidates, Jaccard similarity is verified exactly,
and a last exact check (edits, abbreviations, plurals) keeps what can be meant; the best cover of the typed words wins.

What may stand around a name is learned from the values themselves: words found beside entries of many kinds that stand letter
for letter in a fixed share of the values. ``FILLERS`` holds those known beforehand.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicker.functions.segment import split_names
from wicker.session import read_table, written

#: Least Jaccard similarity of a candidate.
SIMILARITY = 0.5
#: Tokens that are at least this part (one in so many) of all tokens of the reference list are ordered by their counts; the
#: others are rarer, and ordered among themselves by hash.
COUNTED = 20_000
#: A word is learned as a filler if it stands beside exact entries in one of so many values that have words beside one ...
FILLER_SHARE = 100
#: ... and beside at least so many different entries.
FILLER_ENTRIES = 3
#: Words known beforehand that may stand around a name and don't belong to it: articles, measures, containers, states.
FILLERS = frozenset(
    """a an the some any of for my our with and please little bit few more big small large fresh frozen organic leftover dried ripe raw
    chopped sliced diced minced grated whole half pack packs packet packets bag bags box boxes can cans tin tins jar jars bottle
    bottles bunch bunches piece pieces pinch dash handful cup cups tbsp tbsps tsp tsps tablespoon tablespoons teaspoon teaspoons g gr
    kg mg ml cl dl l lb lbs oz gram grams kilo kilos pound pounds ounce ounces liter liters litre litres x""".split()
)


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def tokens_of(compact: str) -> list[str]:
    """The distinct characters and padded character pairs."""
    padded = f"^{compact}$"
    return list({*compact, *(padded[i : i + 2] for i in range(len(padded) - 1))})


def typed_words(text: str | None) -> list[str]:
    """Words of a typed value; an abbreviation keeps its point."""
    return re.findall(r"[^\W_]+\.?", fold(text)) if text else []


class Fillers:
    """Which typed words may stand around a name: known or learned words, words with digits, and mistyped ones."""

    def __init__(self, learned: frozenset[str] = frozenset()):
        self.words = FILLERS | learned
        self.long = [w for w in self.words if len(w) > 2]
        self.seen: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        if word not in self.seen:
            if len(self.seen) > 1_000_000:
                self.seen.clear()
            w = word.rstrip(".")
            plain = w in self.words or any(c.isdigit() for c in w)
            self.seen[word] = plain or len(word) > 2 and any(distance(word, f, 1) <= 1 for f in self.long)
        return self.seen[word]


def distance(a: str, b: str, limit: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, or limit + 1 if there are more.

    Only the band of cells within ``limit`` of the diagonal is filled."""
    if a == b:
        return 0
    far = limit + 1
    if abs(len(a) - len(b)) > limit:
        return far
    width = len(b)
    before, last = None, [j if j <= limit else far for j in range(width + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - limit), min(width, i + limit)
        row = [far] * (width + 1)
        row[0] = i if i <= limit else far
        least = row[0]
        for j in range(low, high + 1):
            y = b[j - 1]
            d = last[j - 1] + (x != y)
            if last[j] < d:
                d = last[j] + 1
            if row[j - 1] < d:
                d = row[j - 1] + 1
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] < d:
                d = before[j - 2] + 1
            row[j] = d
            if d < least:
                least = d
        if least > limit:
            return far
        before, last = last, row
    return min(last[-1], far)


def _singular(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("ches", "shes", "sses", "xes", "oes")):
        return word[:-2]
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def misfit(words: list[str], entry: str) -> int | None:
    """How far typed words are from meaning an entry: 0 the same letters, more for abbreviations, plurals and typing
    errors; None if they don't mean it."""
    compact, goal = "".join(w.rstrip(".") for w in words), entry.replace(" ", "")
    if compact == goal:
        return 0
    parts = entry.split()
    if len(parts) == len(words) and any(w.endswith(".") and len(w) > 2 for w in words):
        short = [w.endswith(".") and p.startswith(w[:-1]) for w, p in zip(words, parts)]
        if all(s or w.rstrip(".") == p for s, w, p in zip(short, words, parts)):
            return 1
    limit = 0 if len(goal) < 4 else 1 if len(goal) < 8 else 2
    last = words[-1].rstrip(".")
    found = distance(compact, goal, limit)
    for single in {_singular(last), last.rstrip("s") if len(last) > 3 else last} - {last}:
        d = distance("".join([*(w.rstrip(".") for w in words[:-1]), single]), goal, limit)
        if d <= limit and d < found:  # a plural with at most as many typing errors
            found = d
    return None if found > limit else 1 + found


def reference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, id of names, ids and synonyms, also turned round: "iced water" as "water iced", "wild black tea" as "black
    tea wild" and as "tea wild black".

    A key of several entries belongs to the one that has it as its name, else to the smallest id.
    """

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, name, synonyms in zip(*(c.to_pylist() for c in batch.columns)):
                every = [(0, name or ""), (1, (id_ or "").replace("_", " ")), *((2, s) for s in split_names(synonyms))]
                for rank, form in every:
                    parts = form.split()
                    for k, ps in ((rank, parts), (3, parts[1:] + parts[:1]), (4, parts[-1:] + parts[:-1])):
                        key = " ".join(w.rstrip(".") for p in ps for w in typed_words(p))
                        if key:
                            rows.append({"key": key, "rank": k, "id": id_})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("rank", pa.int32()), ("id", pa.string())]))

    table = read_table(spark, sf_dir, "ingredients").select("id", "name", "synonyms").distinct()
    ranked = table.mapInArrow(forms, "key string, rank int, id string").groupBy("key").agg(F.min(F.struct("rank", "id")).alias("b"))
    return ranked.select("key", "b.id")


_TOKENS = T.StructType(
    [T.StructField("toks", T.ArrayType(T.LongType())), T.StructField("sig1", T.LongType()), T.StructField("sig2", T.LongType())]
)


def prefix_length(size: int, similarity: float = SIMILARITY) -> int:
    return size - math.ceil(similarity * size - 1e-9) + 1


def token_number(token: str) -> int:
    """A negative number for a token that isn't counted; all of these come first in the order."""
    return -1 - (xxhash.xxh64_intdigest(token) >> 1)


def _tokens_udf(rank: dict[str, int]):
    """Token numbers in the order of rarity, and a bitmap of the set in two words."""

    @F.pandas_udf(_TOKENS)
    def tokens(runs: pd.Series) -> pd.DataFrame:
        number = dict(rank)
        sets, first, second = [], [], []
        for run in runs:
            toks = []
            for t in tokens_of(run):
                n = number.get(t)
                if n is None:
                    n = number[t] = token_number(t)
                toks.append(n)
            toks.sort()
            bits = 0
            for n in toks:
                bits |= 1 << (n * 0x9E3779B1 >> 7) % 126
            sets.append(toks)
            first.append(bits & (1 << 63) - 1)
            second.append(bits >> 63)
        return pd.DataFrame({"toks": sets, "sig1": first, "sig2": second})

    return tokens.asNondeterministic()  # else filters made from it run it a second time


def token_ranks(keys: DataFrame) -> dict[str, int]:
    """The counted tokens of the keys with their ranks, the rarest first; ``COUNTED`` bounds their number."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda k: tokens_of(k.replace(" ", "")))

    counts = keys.select(F.explode(tokens("key")).alias("t")).groupBy("t").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    rows = counts.where(F.col("count") * COUNTED >= total).collect()
    return {r["t"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r["count"], r["t"])))}


def _sets(df: DataFrame, text: str, rank: dict[str, int]) -> DataFrame:
    """``df`` with toks, sig1, sig2, size and prefix of the letters in ``text``."""
    rows = df.withColumn("t", _tokens_udf(rank)(text)).select(*df.columns, "t.*").withColumn("size", F.size("toks"))
    length = F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9).cast("int") + 1
    return rows.withColumn("prefix", F.slice("toks", F.lit(1), length))


@lru_cache(maxsize=100_000)
def _token_set(compact: str) -> frozenset[str]:
    return frozenset(tokens_of(compact))


@F.pandas_udf(T.StructType([T.StructField("jaccard", T.DoubleType()), T.StructField("misfit", T.IntegerType())]))
def _verify_udf(words: pd.Series, keys: pd.Series) -> pd.DataFrame:
    """Jaccard similarity and misfit of each pair, both null where one fails."""
    known: dict[tuple[str, str], tuple[float | None, int | None]] = {}
    out = []
    for pair in zip(words, keys):
        fit = known.get(pair)
        if fit is None:
            a, b = (_token_set(x.replace(" ", "").replace(".", "")) for x in pair)
            jaccard = len(a & b) / len(a | b)
            wrong = misfit(pair[0].split(" "), pair[1]) if jaccard >= SIMILARITY else None
            fit = known[pair] = (None if wrong is None else jaccard, wrong)
        out.append(fit)
    return pd.DataFrame({"jaccard": pd.array([f[0] for f in out], "Float64"), "misfit": pd.array([f[1] for f in out], "Int32")})


def candidates(runs: DataFrame, keys: DataFrame, rank: dict[str, int]) -> DataFrame:
    """words, key, id, jaccard, misfit of the runs of typed words (words, compact) that are similar enough to a key and can mean it.

    A pair comes once for each token its prefixes share. Runs are spread over all tasks before they meet the keys; Spark
    sends the keys to every task if their measured size allows, else both sides are shuffled by token and oversized
    tokens are split.
    """
    spread = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # edits change the length by at most two, plurals by two and the repeats of a last s; abbreviations by any number
    longer = 4 + F.length("compact") - F.length(F.rtrim("compact", F.lit("s")))
    left = _sets(runs.repartition(spread, "words"), "compact", rank)
    left = left.withColumn("length", F.length("compact")).withColumn("slack", F.when(F.contains("words", F.lit(".")), 1 << 30).otherwise(longer))
    left = left.select("words", "sig1", "sig2", "size", "length", "slack", F.posexplode("prefix").alias("at", "tok"))
    right = _sets(keys.withColumn("letters", F.replace("key", F.lit(" "), F.lit(""))), "letters", rank)
    right = right.withColumn("length", F.length("letters")).select("key", "id", "sig1", "sig2", "size", "length", F.posexplode("prefix").alias("at", "tok"))
    right = written(right.select(*(F.col(c).alias("k_" + c) for c in right.columns)))
    total = F.col("size") + F.col("k_size")
    least = F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * total - 1e-9)
    length = F.abs(F.col("length") - F.col("k_length")) <= F.col("slack")
    sizes = (F.col("k_size") >= F.col("size") * SIMILARITY) & (F.col("size") >= F.col("k_size") * SIMILARITY)
    room = 1 + F.least(F.col("size") - F.col("at") - 1, F.col("k_size") - F.col("k_at") - 1) >= least
    differ = F.bit_count(F.col("sig1").bitwiseXOR(F.col("k_sig1"))) + F.bit_count(F.col("sig2").bitwiseXOR(F.col("k_sig2")))
    near = left.join(right, F.col("tok") == F.col("k_tok")).where(length & sizes & room & (total - differ >= 2 * least))
    pairs = near.select("words", F.col("k_key").alias("key"), F.col("k_id").alias("id"))
    return pairs.withColumn("fit", _verify_udf.asNondeterministic()("words", "key")).select("words", "key", "id", "fit.*").where("misfit is not null")


def _runs_of(words: list[str], longest: int) -> Iterator[tuple[int, int, str]]:
    """(first, end, letters) of the runs of typed words without digits, up to so many letters (a last s doesn't count)."""
    bare = [w.rstrip(".") for w in words]
    for a in range(len(words)):
        compact = ""
        for b in range(a, len(words)):
            if any(c.isdigit() for c in bare[b]):
                break
            compact += bare[b]
            if len(compact.rstrip("s")) > longest:
                break
            if len(compact) > 1:
                yield a, b + 1, compact


def typed_runs(texts: DataFrame, longest: int, fillers: Fillers | None) -> DataFrame:
    """tid, n, words, compact, outside: the runs of typed words that an entry could cover, with the words outside.

    With ``fillers``, only runs that leave none but these outside, and ``outside`` is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = typed_words(text)
                first, end = 0, len(words)
                if fillers is not None:  # the run has to hold every word that is no filler
                    strange = [i for i, w in enumerate(words) if w not in fillers]
                    first, end = (strange[0], strange[-1] + 1) if strange else (len(words), 0)
                    if strange and len("".join(words[first:end]).replace(".", "").rstrip("s")) > longest:
                        continue
                for a, b, compact in _runs_of(words, longest):
                    if fillers is None or a <= first and b >= end:
                        outside = [w.rstrip(".") for w in words[:a] + words[b:]] if fillers is None else []
                        rows.append({"tid": tid, "n": b - a, "words": " ".join(words[a:b]), "compact": compact, "outside": outside})
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("tid", pa.string()), ("n", pa.int32()), ("words", pa.string()), ("compact", pa.string()), ("outside", pa.list_(pa.string()))])
    return texts.select("tid", "text").mapInArrow(run, "tid string, n int, words string, compact string, outside array<string>")


def learn_fillers(texts: DataFrame, keys: DataFrame, longest: int) -> frozenset[str]:
    """Words found beside entries that stand letter for letter, in at least one of ``FILLER_SHARE`` of the values that have
    words beside one, and beside at least ``FILLER_ENTRIES`` of them: a bounded number, whatever the size."""
    letters = keys.select("id", F.replace("key", F.lit(" "), F.lit("")).alias("compact"))
    runs = typed_runs(texts, longest, None).join(letters, "compact")
    widest = runs.groupBy("tid").agg(F.max(F.struct("n", "id", "outside")).alias("b")).select("tid", "b.id", F.array_distinct("b.outside").alias("o"))
    beside = written(widest.where(F.size("o") > 0).select("tid", "id", "o"))
    n = beside.count()
    words = beside.select("id", F.explode("o").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("e"))
    rows = words.where((F.col("n") * FILLER_SHARE >= n) & (F.col("e") >= FILLER_ENTRIES) & ~F.col("w").rlike("[0-9]")).select("w").collect()
    return frozenset(r["w"] for r in rows)


def map_values(spark: SparkSession, texts: DataFrame, keys: DataFrame) -> DataFrame:
    """text, id, key, jaccard: the entry meant by each distinct ``text``; texts that mean none are left out.

    Null and blank texts mean none. An entry covers a run of the typed words; what stands around it must be fillers. Of
    several entries the one covering most words wins, then the better fit, the more similar, the longer, the smaller id.
    """
    keys = written(keys)
    longest = (keys.agg(F.max(F.length(F.replace("key", F.lit(" "), F.lit(""))))).first()[0] or -5) + 4
    texts = texts.where(F.col("text").isNotNull()).withColumn("tid", F.md5("text"))
    fillers = Fillers(learn_fillers(texts, keys, longest))
    runs = written(typed_runs(texts, longest, fillers).drop("outside"))
    fits = candidates(runs.select("words", "compact").distinct(), keys, token_ranks(keys))
    # one aggregate per run of words, then one per text, so no group of candidates is ever collected
    best = F.struct("misfit", -F.col("jaccard"), -F.length("key"), F.col("id"), F.col("key"), F.col("jaccard").alias("j"))
    of_words = fits.groupBy("words").agg(F.min(best).alias("b"))
    of_text = runs.join(of_words, "words").groupBy("tid").agg(F.min(F.struct(-F.col("n"), F.col("b"))).alias("t"))
    return texts.join(of_text, "tid").select("text", "t.b.id", "t.b.key", F.col("t.b.j").alias("jaccard"))


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    inputs = read_table(spark, sf_dir, "realistic_inputs").select("input_id", "text").distinct()
    texts = inputs.where(F.trim("text") != "").select("text").distinct()
    return inputs, map_values(spark, texts, reference_keys(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """input_id, ingredient_id: the entry meant, or the empty string."""
    inputs, mapped = _mapped(spark, sf_dir)
    joined = inputs.join(mapped, "text", "left")
    return joined.groupBy("input_id").agg(F.coalesce(F.max("id"), F.lit("")).alias("ingredient_id"))


def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text, n_inputs: the typed values that mean no entry, with the number of inputs (null and blank as "")."""
    inputs, mapped = _mapped(spark, sf_dir)
    left = inputs.join(mapped, "text", "left_anti")
    typed = F.coalesce(F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " ")), F.lit(""))
    return left.groupBy(typed.alias("text")).agg(F.countDistinct("input_id").alias("n_inputs"))
