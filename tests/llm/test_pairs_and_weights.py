import itertools
import random
from collections import Counter

import pytest

from wicker.functions.items import record_items
from wicker.llm import cooccurrence, distinctiveness, split_overlap


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def records(spark, data):
    return record_items(spark.createDataFrame(data, "k string, xs array<string>, items string"), "k", "xs")


def brute_pairs(sets, least, den):
    n, c = len(sets), Counter(i for s in sets for i in s)
    p = Counter(t for s in sets for t in itertools.combinations(sorted(s), 2))
    return {(a, b, k, c[a], c[b], n) for (a, b), k in p.items() if k >= least and k * den >= n}


@pytest.mark.parametrize(("seed", "heavy_den"), [(1, 2), (2, 5), (3, 64), (4, 1)])
def test_pairs_against_brute_force(spark, seed, heavy_den, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(cooccurrence, "BLOCK", 37)
    names = [f"i{k}" for k in range(25)]
    weights = [100 / (k + 1) for k in range(25)]
    sets = [set(rnd.choices(names, weights, k=rnd.randint(1, 8))) for _ in range(400)]
    data = [(str(k), [*s, " I0 " if "i0" in s else None, ""], "x") for k, s in enumerate(sets)]
    src = records(spark, data + data[:50])
    got = {tuple(r)[1:] for r in cooccurrence.pair_counts(spark, [src, src.limit(0)], 3, 50, heavy_den).collect()}
    assert got == brute_pairs(sets, 3, 50)
    monkeypatch.setattr(cooccurrence, "MAX_ITEMS", 2)
    assert {tuple(r)[1:] for r in cooccurrence.pair_counts(spark, [src], 3, 50, heavy_den).collect()} == got


def test_empty_and_odd_records(spark):
    src = records(spark, [("1", None, ""), ("2", [], ""), ("3", [None, " ", "\t"], ""), (None, ["a"], "")])
    assert [r["items"] for r in src.collect()] == [["a"]]
    assert cooccurrence.pair_counts(spark, [src], 1, 1).count() == 0


def test_rarest_items(spark, write):
    data = [("r1", ["Salt", "salt ", "b"], "t"), ("r2", ["salt", "b", "c", "d"], None), ("r2", ["salt", "b", "c", "d"], None), ("r3", None, None), ("r4", [""], None)]
    d = write("recipes", data, "recipe_id string, canonical array<string>, item string")
    assert rows(distinctiveness.found(spark, d)) == [("r1", 1, "b"), ("r1", 2, "salt"), ("r2", 1, "c"), ("r2", 2, "d"), ("r2", 3, "b")]
    w = {(r["recipe_id"], r["item"]): (r["df"], r["tfidf"]) for r in distinctiveness.weights(spark, d).collect()}
    assert w["r2", "c"][0] == 1 and w["r2", "c"][1] > w["r2", "salt"][1] and len(w) == 6


def test_no_recipes(spark, write):
    d = write("recipes", [], "recipe_id string, canonical array<string>")
    assert distinctiveness.found(spark, d).count() == 0


def test_cuts_cover_and_fit():
    rnd = random.Random(1)
    for n in range(1, 60):
        sizes = split_overlap.partner_sizes(n)
        best = split_overlap.cuts([rnd.random() for _ in range(n)], split_overlap.edits(n, sizes[-1]) + 1)
        for m in sizes:
            at = best[split_overlap.edits(n, m) + 1]
            assert at[0] == 0 and at == sorted(set(at)) and all(b - a <= split_overlap.LONGEST for a, b in zip(at, [*at[1:], n]))


def test_banded_distance():
    import numpy as np

    rnd = random.Random(2)
    a = [np.array(sorted(rnd.sample(range(30), rnd.randint(0, 12)))) for _ in range(200)]
    b = [np.array(sorted(rnd.sample(range(30), rnd.randint(0, 12)))) for _ in range(200)]
    d = split_overlap.banded_distance(a, b, 6)
    for x, y, v in zip(a, b, d):
        true = len(set(x.tolist()) ^ set(y.tolist()))
        assert v == true if true <= 6 else v > 6


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = [set(rnd.sample(range(40), rnd.randint(1, 14))) for _ in range(30)]
    data = []
    for k in range(240):
        s = set(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            s ^= {rnd.randrange(40)}
        data.append((k % 2, f"k{k}", rnd.random() < 0.6, sorted(map(str, s))))
    df = spark.createDataFrame(data, "src int, key string, train boolean, tokens array<string>")
    got = rows(split_overlap.overlaps(spark, df.union(df.limit(20))))
    expected = set()
    for x, y in itertools.combinations(data, 2):
        if x[0] == y[0] and x[2] != y[2]:
            a, b = set(x[3]), set(y[3])
            if a | b and 10 * len(a & b) >= 7 * len(a | b):
                expected.add((x[0], *sorted((x[1], y[1]))))
    assert got == sorted(expected, key=repr)
    assert split_overlap.overlaps(spark, df.limit(0)).count() == 0
