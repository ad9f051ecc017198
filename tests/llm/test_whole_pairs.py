"""Pairs that are rare in a large table, against brute force."""

import itertools
import random
from collections import Counter

from wicker.llm import cooccurrence


def test_pairs_of_rare_items(spark, write):
    rnd = random.Random(4)
    common, rare = [f"c{k}" for k in range(4)], [f"r{k}" for k in range(8)]
    sets = [set(rnd.sample(common, 2)) for _ in range(2100)]
    sets += [set(rnd.sample(rare, 3)) | set(rnd.sample(common, rnd.randint(0, 2))) for _ in range(100)]
    write("raw_recipes", [(k, sorted(s)) for k, s in enumerate(sets)], "raw_id long, ner array<string>")
    d = write("recipes", [(f"r{k}", sorted(s)) for k, s in enumerate(sets[-60:])], "recipe_id string, canonical array<string>")
    expected = set()
    for src, records in (("raw_recipes.ner", sets), ("recipes.canonical", sets[-60:])):
        n, c = len(records), Counter(i for s in records for i in s)
        for (a, b), k in Counter(p for s in records for p in itertools.combinations(sorted(s), 2)).items():
            if k >= 5:
                expected.add((src, a, b, k, c[a], c[b], n, round(k * n / (c[a] * c[b]), 6)))
    assert any(src == "raw_recipes.ner" and 400 * k < n for src, _, _, k, _, _, n, _ in expected)
    assert {tuple(r) for r in cooccurrence.pairs(spark, d).collect()} == expected
    often = {(s, a, b) for s, a, b, k, x, y, n, _ in expected if 400 * k >= n and k * n >= 4 * x * y}
    assert {tuple(r) for r in cooccurrence.found(spark, d).collect()} == often
