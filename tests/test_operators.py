"""Operators of the core against hand-made cases and plain-Python versions."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wicker.functions import text as X
from wicker.operators import answer, basket, evaluation, learning, nutrition, ranking, resolve, substitution


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_singularize(spark):
    words = {"glasses": "glasses", "glass": "glass", "berries": "berry", "pies": "py", "dishes": "dish", "boxes": "box", "potatoes": "potato", "leaves": "leave", "asparagus": "asparagu", "egg": "egg", "gas": "gas", "eggs": "egg"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.singularize(F.col("w")))
    assert dict(map(tuple, df.collect())) == words


def test_text_functions(spark):
    df = spark.createDataFrame([("Jalapeño-Peppers (hot), ½ Cups",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(X.canonicalize(F.col("t")), F.array_join(X.fold_tokens(F.col("t")), " ")).collect()]
    assert got[0][1] == "jalapeno pepper 1 2 cup" or got[0][1].startswith("jalapeno pepper")
    assert got[1][0] is None and got[2] == ("", "")


@pytest.mark.parametrize(("text", "q", "rest"), [("1 1/2 cups x", 1.5, "cups x"), ("3–4 red chiles", 3.0, "red chiles"), ("½ cup", 0.5, "cup"), ("2 to 3 eggs", 2.0, "eggs"), ("salt", None, "salt"), ("1/0 x", None, "x"), ("2.5 kg", 2.5, "kg")])
def test_parse_quantity(spark, text, q, rest):
    a, b = X.parse_quantity(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(a, b).first()) == (q, rest)


@pytest.mark.parametrize(("text", "unit", "rest"), [("cups flour", "cup", "flour"), ("Tbsp. oil", "tbsp", "oil"), ("(15 oz) can beans", "can", "beans"), ("(large) eggs", None, "(large) eggs"), ("eggs", None, "eggs")])
def test_parse_unit(spark, text, unit, rest):
    a, b = X.parse_unit(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(a, b).first()) == (unit, rest)


def test_strip_templates_and_urls(spark):
    assert X.strip_templates("a {{b {{c}} d}} e }} f {{g") == "a  e }} f "
    df = spark.createDataFrame([("https://w.org/a",), ("http://w.org/a",), ("https://u@w.org/a",), ("https://w.org:1/a",), (None,), ("junk",)], "u string")
    assert [r[0] for r in df.select(X.is_source_url(F.col("u"), "w.org")).collect()] == [True, False, False, False, False, False]
    assert spark.createDataFrame([("Book:Pie é",)], "t string").select(X.page_url(F.col("t"), "b/")).first()[0] == "b/Book:Pie_%C3%A9"


def pack_of(spark, recipes, staples):
    """recipes: rid -> list of lines, each a list of options (empty: unread)."""
    n = len(recipes)
    df = Counter(i for ls in recipes.values() for i in {o for line in ls for o in line})
    idf = {i: math.log(1 + n / c) for i, c in df.items()}
    out = []
    for rid, ls in recipes.items():
        needed = [(k, line) for k, line in enumerate(ls) if not set(line) & set(staples)]
        w = [max((idf[o] for o in line), default=0.0) for _, line in needed]
        for (k, line), x in zip(needed, w):
            for o in line or [None]:
                out.append((rid, k, o, x, len(needed), sum(w)))
    need = spark.createDataFrame(out, "rid string, line_no int, id string, w double, total long, den double")
    return answer.Pack(need, spark.createDataFrame([(i, c, idf[i]) for i, c in df.items()], "id string, df long, idf double"), sorted(staples)), idf


def test_scores_against_plain_python(spark):
    rnd = random.Random(3)
    names = [f"i{k}" for k in range(12)]
    recipes = {f"r{k}": [rnd.sample(names, rnd.choice([0, 1, 1, 1, 2])) for _ in range(rnd.randint(1, 7))] for k in range(50)}
    recipes = {r: ls for r, ls in recipes.items() if any("i0" not in line for line in ls)}
    pack, idf = pack_of(spark, recipes, ["i0"])
    queries = {f"q{k}": rnd.sample(names, rnd.randint(0, 7)) for k in range(15)}
    df = spark.createDataFrame([(q, i) for q, ids in queries.items() for i in ids], "qid string, id string")
    held = answer.held_items(df, pack)
    expected = set()
    for q, ids in queries.items():
        own = {i for i in ids if i in idf} - {"i0"}
        for rid, ls in recipes.items():
            need = [line for line in ls if "i0" not in line]
            got = [line for line in need if own & set(line)]
            if got:
                w = lambda x: sum(max((idf[o] for o in line), default=0.0) for line in x)
                expected.add((q, rid, len(got), len(need), len(need) - len(got), round(w(got) / math.sqrt(w(need)), 6)))
    assert set(rows(answer.scored(held, pack))) == expected
    assert set(rows(answer.near(held, pack))) == {e for e in expected if e[4] <= 2}


@pytest.mark.parametrize("cap", [0, 1, 3, 7, 200])
def test_candidate_pool_against_plain_python(spark, cap):
    rnd = random.Random(cap)
    names = [f"i{k}" for k in range(10)]
    items = {f"r{k}": set(rnd.sample(names, rnd.randint(1, 6))) for k in range(60)}
    queries = {f"q{k}": set(rnd.sample(names, rnd.randint(1, 6))) for k in range(8)}
    flat = lambda m, a: spark.createDataFrame([(k, i) for k, v in m.items() for i in sorted(v)], f"{a} string, id string")
    got = rows(basket.candidate_pool(flat(queries, "qid"), flat(items, "rid"), cap))
    expected = []
    for q, own in queries.items():
        c = sorted((-len(own & s) / len(s), len(s - own), r) for r, s in items.items() if own & s)
        expected += [(q, r, len(own & items[r]), m, k + 1) for k, (_, m, r) in enumerate(c[:cap])]
    assert got == sorted(expected, key=repr)
    with pytest.raises(ValueError):
        basket.candidate_pool(flat(queries, "qid"), flat(items, "rid"), -1)


def test_match_longest_against_plain_python(spark):
    rnd = random.Random(5)
    words = list("abcdef")
    entries = {" ".join(rnd.choices(words, k=rnd.randint(1, 3))) for _ in range(60)}
    phrases = {" ".join(rnd.choices(words, k=rnd.randint(1, 6))) for _ in range(80)}
    got = dict(map(tuple, resolve.match_longest(spark.createDataFrame([(p,) for p in phrases], "phrase string"), spark.createDataFrame([(e,) for e in entries], "entry string")).collect()))
    for p in phrases:
        have = Counter(p.split())
        best = None
        for e in entries:
            if not Counter(e.split()) - have:
                it = iter(p.split())
                key = (len(e.split()), all(w in it for w in e.split()), len(e), e)
                best = max(best or key, key)
        assert got.get(p) == (best and best[3])


def test_line_resolver():
    keys = {("salt",): "salt", ("black", "pepper"): "pepper", ("red", "onion"): "onion", ("milk",): "milk", ("cream",): "cream"}
    keys |= {("pepper", "sauce"): "sauce", ("clove",): "clove", ("oil", "and", "vinegar"): "dressing", ("oil",): "oil"}
    r = resolve.LineReader(keys, frozenset(["salt"]), frozenset(["chopped", "to", "taste"]), frozenset(["cup", "cups", "clove"]))
    ids = lambda t: [(x.options, x.optional, x.read) for x in r.read(t)]
    assert ids("salt and pepper") == [(("salt",), False, True), (("black_pepper",), False, True)] and ids("pepper") == [((), False, False)]
    assert ids("pepper to taste") == [(("black_pepper",), False, True)] and ids("2 cups pepper sauce") == [(("sauce",), False, True)]
    assert ids("1 clove") == [(("clove",), False, True)] and ids("oil and vinegar") == [(("dressing",), False, True)]
    assert ids("milk, cream, or oil") == [(("milk", "cream", "oil"), False, True)] and ids("milk/cream (cold)") == [(("milk", "cream"), False, True)]
    assert ids("milk and quux") == [((), False, False)] and ids("milk, quux") == [(("milk",), False, True)]
    assert ids("2 to 3 cups milk, for garnishing") == [(("milk",), True, True)] and ids("1 ½ cups cream, optional, salt") == [(("cream",), True, True), (("salt",), True, True)]
    assert ids("2 cups milk or cream") == [(("milk", "cream"), False, True)]
    assert ids("1 red onion, chopped and salt") == [(("onion",), False, True), (("salt",), False, True)]
    assert ids("salt to taste") == [(("salt",), True, True)]
    assert ids("quux") == [((), False, False)] and ids("For the sauce:") == [] and ids(None) == []


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "z", 3)], "qid string, item string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "w", 2)], "qid string, item string, rank int")
    assert [r["item"] for r in ranking.rank_blend(a, b, 0.5, 10).orderBy("rank").collect()] == ["y", "x", "z", "w"]
    assert [r["item"] for r in ranking.rank_blend(a, b, 1.0, 2).orderBy("rank").collect()] == ["x", "y"]
    assert [r["item"] for r in ranking.reciprocal_rank_fusion([a, b], 2).orderBy("rank").collect()] == ["y", "x"]
    with pytest.raises(ValueError):
        ranking.arm_order("nope")


def test_graph_pieces(spark):
    records = spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["a", "b"]), ("3", ["b", "c"]), ("4", [])], "key string, items array<string>")
    vocab = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    pairs = substitution.cooccurrence(records, vocab)
    assert rows(pairs) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 2)]
    t, r = 10, {"a": 3, "b": 4, "c": 3}
    expected = {(i, j): math.log(n * t / (r[i] * r[j])) for i, j, n in rows(substitution.mirrored(pairs))}
    got = {(x, y): v for x, y, v in rows(substitution.sppmi(pairs))}
    assert got == pytest.approx({k: v for k, v in expected.items() if v > 0})
    unit = substitution.l2_normalized(substitution.sppmi(pairs)).groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    assert all(abs(x["s"] - 1) < 1e-9 for x in unit.collect())
    with pytest.raises(ValueError):
        substitution.sppmi(pairs, 0.5)


def test_mined_pairs_against_plain_python(spark):
    rnd = random.Random(7)
    recs = [(f"g{rnd.randint(0, 2)}", f"k{k}", sorted(rnd.sample("abcdefg", rnd.randint(1, 5)))) for k in range(60)]
    got = set(rows(substitution.mine_pairs(spark.createDataFrame(recs, "grp string, key string, items array<string>"), 3)))
    expected = set()
    for (g, _, a), (h, _, b) in itertools.permutations(recs, 2):
        a, b = set(a), set(b)
        if g == h and len(a & b) >= 3 and len(a - b) == len(b - a) == 1:
            expected.add((*(a - b), *(b - a)))
    assert got == expected


def test_diets(spark):
    names = ["beef stew", "rice flour", "honey", "carrot", "soy sauce", "eggplant", "wheat bread"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: tuple(r[1:]) for r in df.select("n", substitution.diet_allows(F.col("n"), "vegan"), substitution.diet_allows(F.col("n"), "gluten_free"), substitution.diet_allows(F.col("n"), None)).collect()}
    assert got == {"beef stew": (False, True, True), "rice flour": (True, True, True), "honey": (False, True, True), "carrot": (False, False, True), "soy sauce": (True, False, True), "eggplant": (True, True, True), "wheat bread": (True, False, True)}
    with pytest.raises(ValueError):
        substitution.diet_allows(F.col("n"), "keto")
    assert substitution.ancestors({"a": "b", "b": "a"})["a"] == ["a", "b"]


def test_grams(spark):
    none = F.create_map().cast("map<string,double>")
    cases = [(None, "pinch", "salt", 0.36), (2.0, "kg", "x", 2000.0), (1.0, "cup", "flour", 236.588 * 0.53), (1.0, "cup", "x", None), (2.0, None, "egg", 100.0), (None, "kg", "x", None), (1.0, "package", "egg", None), (2.0, "cup", "rice vinegar", 2 * 236.588 * 0.85)]
    df = spark.createDataFrame([c[:3] for c in cases], "q double, u string, n string")
    got = [r[0] for r in df.select(nutrition.to_grams(F.col("q"), F.col("u"), F.col("n"), none, {"kg": 1000.0}, {"cup": 236.588})).collect()]
    assert [g and round(g, 6) for g in got] == [c[3] and round(c[3], 6) for c in cases]


def test_food_table(spark):
    foods = spark.createDataFrame([(1,), (2,)], "food_id int")
    nutrients = spark.createDataFrame([(1, 10, 5.0, 1), (1, 10, 6.0, 2), (1, 11, 9.0, 3), (1, 12, 1.0, 4)], "food_id int, nutrient_id int, amount double, ord long")
    portions = spark.createDataFrame([(1, "cup", 0.0, 200.0, 1), (1, "cup", 1.0, 300.0, 2), (1, None, 2.0, 80.0, 3), (1, "tbsp", 1.0, 0.0, 4)], "food_id int, unit string, amount double, grams double, ord long")
    white = spark.createDataFrame([(10, "kcal", 0), (11, "kcal", 1)], "nutrient_id int, key string, priority int")
    got = {r["food_id"]: (r["per100g"], r["unit_grams"]) for r in nutrition.food_table(foods, nutrients, portions, white).collect()}
    assert got == {1: ({"kcal": 9.0}, {"cup": 200.0, "each": 40.0}), 2: ({}, {})}


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"k{k}", f"g{k % 13}") for k in range(100)], "key string, grp string")
    one, many = (rows(evaluation.group_split(df.repartition(n), "s")) for n in (1, 7))
    assert one == many and Counter(s for _, s in one).keys() == {"dev", "test"}


def test_md5_mod(spark):
    import hashlib

    ids = [f"r{k}" for k in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "i string").select("i", evaluation.md5_mod(F.col("i"), 100))
    assert dict(map(tuple, df.collect())) == {i: int(hashlib.md5(i.encode()).hexdigest(), 16) % 100 for i in ids}


def test_bootstrap_holds_the_mean(spark):
    rnd = random.Random(1)
    data = [("a", f"c{k % 40}", rnd.gauss(1, 1)) for k in range(400)]
    r = evaluation.cluster_bootstrap(spark.createDataFrame(data, "grp string, cluster string, diff double"), 400).first()
    assert r["lo"] < r["mean"] < r["hi"] and r["n_clusters"] == 40 and 0.05 < r["hi"] - r["lo"] < 0.6


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 9)] + [("b", 5.0)], "g string, v double")
    assert rows(evaluation.nearest_rank(df, "g", "v")) == [("a", 4, 4.0, 9.0, 9.0), ("b", 1, 5.0, 5.0, 5.0)]


def test_rankers_find_the_gold(spark):
    rnd = random.Random(2)
    data = []
    for q in range(60):
        gold = rnd.randint(0, 4)
        for k in range(5):
            x = 1.0 if k == gold else rnd.random() * 0.8
            data.append((f"q{q}", f"r{k}", x, x, 1.0, 1.0, 1.0, 0.0, 0.0, float(k == gold)))
    df = spark.createDataFrame(data, ["qid", "rid", *learning.FEATURES, "label"])
    for fit in (learning.linear_ranker, learning.pairwise_ranker):
        top = learning.rank_with(fit(df), df, 1).join(df.where("label = 1").select("qid", "rid"), ["qid", "rid"])
        assert top.count() >= 57
    assert learning.rank_with(learning.linear_ranker(df), df, 0).count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1)], "qid string, item string, rank int")
    gold = spark.createDataFrame([("q1", "b"), ("q1", "x"), ("q3", "a")], "qid string, item string")
    assert tuple(evaluation.list_metrics(ranked, gold, 2).first()) == (1, 0.5, 0.5, 0.5)
    assert tuple(evaluation.list_metrics(ranked, gold, 2, pessimistic=True).first()) == (2, 0.25, 0.25, 0.25)
    ranks = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "qid string, rank int")
    assert tuple(evaluation.pool_metrics(ranks, 2).first()) == (3, 0.666667, 0.333333, 0.333333, 0.5, 0.5)
    groups = spark.createDataFrame([([["a"], ["x"]], [["a", "b"], ["c"]])], "predicted array<array<string>>, gold array<array<string>>")
    assert tuple(evaluation.group_scores(groups).first()) == (0.5, 0.5, 0.5)


def test_sheet_takes_no_line_twice(spark):
    df = spark.createDataFrame([(f"l{k}", k % 3 == 0, k) for k in range(90)], "line_id string, hard boolean, rarity int")
    out = evaluation.stratified_sheet(df, 10, "s").collect()
    assert len({r["line_id"] for r in out}) == 30 and Counter(r["stratum"] for r in out) == {"hard": 10, "rare": 10, "random": 10}


def test_streams(spark, tmp_path):
    from wicker.streaming import basket_stats

    folder = f"{tmp_path}/in"
    rows_ = [("k1", "2024-01-01 00:00:00", ["Salt", "b"]), ("k1", "2024-01-02 00:00:00", ["Salt", "b"]), ("k2", "2024-01-03 00:00:00", ["salt ", None])]
    df = spark.createDataFrame(rows_, "key string, t string, items array<string>").select("key", F.to_timestamp("t").alias("loaded_at"), "items")
    df.write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    query = basket_stats.upsert_frequencies(basket_stats.document_frequencies(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    assert rows(basket_stats.current(spark, f"{tmp_path}/out").select("item", "df")) == [("b", 1), ("salt", 2)]


def test_command_line(capsys):
    from wicker import cli

    assert cli.main(["cook", "--have", "egg", "--tables", "/no/such/folder"]) == 1


def test_blocks_agree_with_brute_force(spark, monkeypatch):
    import random

    from wicker.operators import blocks

    monkeypatch.setattr(blocks, "BASKETS", 20)
    monkeypatch.setattr(blocks, "LEAST_QUERIES", 8)
    rnd = random.Random(6)
    need, lines = [], {}
    for b in range(90):
        per = [rnd.sample("abcdefgh", rnd.randint(0, 2)) for _ in range(rnd.randint(1, 5))]  # a line may have options, or none
        lines[f"r{b}"] = per
        for k, ids in enumerate(per):
            need += [(f"r{b}", k, i, 0.5 + len(ids), len(per), 1.0 + b % 3) for i in ids or [None]]
    held = {f"q{k}": rnd.sample("abcdefghz", rnd.randint(1, 4)) for k in range(40)}
    n = spark.createDataFrame(need, "rid string, line_no int, id string, w double, total long, den double")
    h = spark.createDataFrame([(q, i) for q, ids in held.items() for i in ids], "qid string, id string")
    every = {}
    for q, ids in held.items():
        for b, (r, per) in enumerate(lines.items()):
            hit = [l for l in per if set(l) & set(ids)]
            if hit:
                every[q, r] = (len(hit), len(per), round(sum(0.5 + len(l) for l in hit) / math.sqrt(1.0 + b % 3) + 1e-12, 6))
    got = {(r["qid"], r["rid"]): (r["have"], r["total"], r["score"]) for r in blocks.within(h, n, 1).collect()}
    assert got == {k: v for k, v in every.items() if v[1] - v[0] <= 1}
    gold = {q: rnd.choice(list(lines)) for q in held}
    ranks = {r["qid"]: (r["rank_overlap"], r["rank_idf_flat"]) for r in blocks.gold_ranks(h, n, spark.createDataFrame(list(gold.items()), "qid string, rid string")).collect()}
    for q, g in gold.items():
        own = every.get((q, g))
        mine = {r: v for (x, r), v in every.items() if x == q}
        place = lambda c: 1 + sum((-v[c], v[1], r) < (-own[c], own[1], g) for r, v in mine.items())  # noqa: E731, B023
        assert ranks[q] == ((place(0), place(2)) if own else (None, None))
    top = ranking.top_of_arm(blocks.best(h, n, "shipped", 3), "shipped", 3).collect()
    for q in held:
        mine = sorted((v[1] - v[0], -v[2], v[1], r) for (x, r), v in every.items() if x == q)[:3]
        assert [r["rid"] for r in sorted((r for r in top if r["qid"] == q), key=lambda r: r["rank"])] == [m[3] for m in mine]
    assert blocks.within(h.limit(0), n, 1).count() == 0 and blocks.within(h, n.limit(0), 1).count() == 0
