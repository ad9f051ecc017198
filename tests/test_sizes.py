"""Queries that once shuffled or gathered more than they keep: their plans, and their results in small blocks."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from wicker.operators import substitution
from wicker.plans import catalog


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().toString()


def brute_neighbors(recipes, k):
    pairs = Counter(p for r in recipes for p in itertools.combinations(sorted(set(r)), 2))
    both = defaultdict(dict)
    for (i, j), n in pairs.items():
        both[i][j] = both[j][i] = n
    total = {i: sum(x.values()) for i, x in both.items()}
    whole = sum(total.values())
    unit = {}
    for i, x in both.items():
        v = {j: math.log(n * whole / (total[i] * total[j])) for j, n in x.items()}
        v = {j: y for j, y in v.items() if y > 0}
        unit[i] = {j: y / math.sqrt(sum(z * z for z in v.values())) for j, y in v.items()}
    out = {}
    for a, b in itertools.permutations(unit, 2):
        if shared := unit[a].keys() & unit[b].keys():
            dot, c = sum(unit[a][j] * unit[b][j] for j in shared), both[a].get(b, 0) / max(both[a].values())
            out.setdefault(a, []).append((-round(dot * len(shared) / (len(shared) + 100) - 0.5 * c, 6), b))
    return {(a, r + 1, b, -s) for a, x in out.items() for r, (s, b) in enumerate(sorted(x)[:k])}


@pytest.mark.parametrize("size", [7, 100_000])
def test_graph_neighbors_shuffle_no_product(spark, monkeypatch, size):
    monkeypatch.setattr(substitution, "SCORED_ROWS", size, raising=False)
    monkeypatch.setattr(substitution, "HELD_ROWS", size, raising=False)
    rnd = random.Random(size)
    names = [f"i{k:02}" for k in range(60)]
    recipes = [rnd.sample(names[: 20 + k % 41], 5) for k in range(200)]
    df = spark.createDataFrame([(str(k), r) for k, r in enumerate(recipes)], "key string, items array<string>")
    pairs = substitution.cooccurrence(df, spark.createDataFrame([(n,) for n in names], "item string")).cache()
    unit = substitution.l2_normalized(substitution.sppmi(pairs)).cache()
    found = substitution.graph_neighbors(unit, pairs, 4)
    got = set(rows(found))
    expected = {(a, r, b): s for a, r, b, s in brute_neighbors(recipes, 4)}
    assert {x[:3] for x in got} == expected.keys() and all(abs(x[3] - expected[x[:3]]) < 1.1e-6 for x in got)
    assert "FlatMapCoGroups" in plan(found)


def test_dietary_validity_of_many_neighbours(spark, write):
    recipes = [["hub", f"x{k:03}"] for k in range(120)] * 2 + [["beef", "milk", "x001"]] * 3 + [["tofu", "oat", "x002"]] * 3
    d = write("recipes", [(f"r{k}", r) for k, r in enumerate(recipes)], "recipe_id string, canonical array<string>")
    valid = catalog.queries()["dietary_validity"](spark, d)
    got = rows(valid)
    found = Counter(b for _, _, b, _ in brute_neighbors(recipes, 5))
    n = sum(found.values())
    assert [(x, m) for x, m, _, _ in got] == [(x, n) for x in ("dairy_free", "gluten_free", "vegan", "vegetarian")]
    vegan = sum(m for b, m in found.items() if b in ("tofu", "oat"))
    assert next(ok for x, _, ok, _ in got if x == "vegan") == vegan
    assert "FlatMapCoGroups" in plan(valid)  # 120 rows share the column hub: 14,400 products


def tables(write, seed, n_recipes=150, n_queries=60):
    """A folder of tables with recipes and pantries, and of each query its gold and the baskets it shares an item with, by rid."""
    rnd = random.Random(seed)
    names = [f"i{k}" for k in range(16)]
    recipes = {f"r{k}": [rnd.choice([*names, "unknown"]) for _ in range(rnd.randint(1, 6))] for k in range(n_recipes)}
    queries = {f"r{rnd.randrange(n_recipes)}": rnd.sample(names, rnd.randint(2, 6)) for _ in range(n_queries)}
    write("ingredients", [(n, n, "1" if n == "i0" else "0") for n in names], "id string, name string, staple string")
    write("parsed_ingredients", [(r, k, f"1 {n}", n) for r, ls in recipes.items() for k, n in enumerate(ls)], "recipe_id string, line_no int, raw string, canonical string")
    write("recipes", [(r, ls) for r, ls in recipes.items()], "recipe_id string, canonical array<string>")
    d = write("eval_pantries", [(q, 0, ids) for q, ids in queries.items()], "gold_id string, draw int, pantry array<string>")
    return d, recipes, queries


def found(recipes, queries):
    """query -> rid -> (missing, -score, total, have, open lines), as the arms see it."""
    need = {r: [n for n in ls if n != "i0"] for r, ls in recipes.items()}
    need = {r: ls for r, ls in need.items() if ls}
    df = Counter(n for r in need for n in set(recipes[r]) if n != "unknown")
    w = {n: math.log(1 + len(need) / c) for n, c in df.items()}
    out = {}
    for q, ids in queries.items():
        own = {i for i in ids if i in df} - {"i0"}
        out[q] = {}
        for r, ls in need.items():
            hit = [n for n in ls if n in own]
            if hit:
                score = sum(w[n] for n in hit) / math.sqrt(sum(w.get(n, 0.0) for n in ls))
                out[q][r] = (len(ls) - len(hit), -round(score, 6), len(ls), len(hit), [n for n in ls if n not in own])
    return out


def covered(recipes, queries):
    """query -> baskets by coverage, fewest missing and rid, with the number shared."""
    sets = {r: {n for n in ls if n != "unknown"} for r, ls in recipes.items()}
    out = {}
    for q, ids in queries.items():
        own = set(ids)
        out[q] = [(r, len(own & s)) for _, _, r, s in sorted((-len(own & s) / len(s), len(s - own), r, s) for r, s in sets.items() if own & s)]
    return out


def run(spark, d, name):
    from wicker.plans import catalog

    df = catalog.queries()[name](spark, d)
    return df, {tuple(r) for r in df.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    from wicker.operators import blocks

    monkeypatch.setattr(blocks, "BASKETS", 40)
    monkeypatch.setattr(blocks, "LEAST_QUERIES", 8)


def counted_by_bits(df):
    """Groups of Arrow tables: no row of a line is ever made a pandas row, no basket that a query doesn't keep is given."""
    return "FlatMapCoGroupsInArrow" in plan(df)


def test_leave_one_out_counts_places(spark, write, small_blocks):
    d, recipes, _ = tables(write, 2)
    df, got = run(spark, d, "leave_one_out")
    places = []
    for r, ls in recipes.items():
        if len(items := set(ls)) >= 3:
            gone = min(items, key=lambda x: hashlib.sha256(f"42:{r}:{x}".encode()).hexdigest())
            own = items - {gone}
            order = sorted((-len(own & set(x)) / len(set(x)), len(set(x) - own), k) for k, x in recipes.items() if own & set(x))
            places.append([k for _, _, k in order].index(r) + 1)
    hit = [1 / p for p in places if p <= 10]
    assert got == {(len(places), round(len(hit) / len(places), 6), round(sum(hit) / len(places), 6))}
    assert counted_by_bits(df)


def test_unlocks_are_counted_in_blocks(spark, write, small_blocks):
    d, recipes, queries = tables(write, 4)
    df, got = run(spark, d, "answer_unlocks")
    expected = set()
    for q, baskets in found(recipes, queries).items():
        n = Counter(open_[0] for m, _, _, _, open_ in baskets.values() if m == 1 and open_[0] != "unknown")
        expected |= {(f"{q}#0", k + 1, i, c) for k, (i, c) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:10])}
    assert got == expected and counted_by_bits(df)


def test_gold_places_by_bits(spark, write, small_blocks):
    d, recipes, queries = tables(write, 9)
    df, got = run(spark, d, "recall_mrr")
    expected = set()
    for arm, key in (("overlap", lambda x: (-x[3], x[2])), ("idf_flat", lambda x: (x[1], x[2]))):
        places = [sorted(b, key=lambda r: (*key(b[r]), r)).index(q) + 1 for q, b in found(recipes, queries).items() if q in b]  # noqa: B023
        hit = [1 / p for p in places if p <= 10]
        expected.add((len(queries), round(len(hit) / len(queries), 6), round(sum(hit) / len(queries), 6), arm))
    assert got == expected and counted_by_bits(df)


def test_visible_gold_is_counted(spark, write, small_blocks):
    d, recipes, queries = tables(write, 11)
    df, got = run(spark, d, "visible_rate")
    seen = 0
    for q, b in found(recipes, queries).items():
        if q in b and b[q][0] <= 2:
            seen += sum((*x[1:3], r) < (*b[q][1:3], q) for r, x in b.items() if x[0] == b[q][0]) < 10
    assert 0 < seen < len(queries)
    assert got == {(len(queries), round(seen / len(queries), 6))} and counted_by_bits(df)


def test_groups_are_counted(spark, write, small_blocks):
    d, recipes, queries = tables(write, 12)
    df, got = run(spark, d, "answer_group_counts")
    assert got == {(f"{q}#0", *(sum(x[0] == m for x in b.values()) for m in range(3))) for q, b in found(recipes, queries).items()}
    assert counted_by_bits(df)


@pytest.mark.parametrize("arm,key", [("arm_shipped", lambda x: x[:3]), ("arm_overlap", lambda x: (-x[3], x[2]))])
def test_arms_by_bits(spark, write, small_blocks, arm, key):
    d, recipes, queries = tables(write, 13)
    df, got = run(spark, d, arm)
    assert got == {(f"{q}#0", k + 1, r) for q, b in found(recipes, queries).items() for k, r in enumerate(sorted(b, key=lambda r: (*key(b[r]), r))[:10])}  # noqa: B023
    assert counted_by_bits(df)


def test_pools_by_bits(spark, write, small_blocks):
    d, recipes, queries = tables(write, 14)
    df, got = run(spark, d, "candidate_pool")
    size = {r: len({n for n in ls if n != "unknown"}) for r, ls in recipes.items()}
    pools = covered(recipes, queries)
    assert got == {(f"{q}#0", r, n, size[r] - n, k + 1) for q, b in pools.items() for k, (r, n) in enumerate(b[:25])}
    assert counted_by_bits(df)
    df, got = run(spark, d, "overlap_top_k")
    assert {x[:3] for x in got} == {(f"{q}#0", k + 1, r) for q, b in pools.items() for k, (r, _) in enumerate(b[:5])} and counted_by_bits(df)


def test_pool_metrics_count_places(spark, write, small_blocks):
    d, recipes, queries = tables(write, 16)
    df, got = run(spark, d, "pool_metrics")
    places = [[r for r, _ in b].index(q) + 1 for q, b in covered(recipes, queries).items() if q in dict(b)]
    inside, hit, n = [p for p in places if p <= 25], [1 / p for p in places if p <= 10], len(queries)
    assert got == {(n, *(round(x, 6) for x in (len(inside) / n, len(hit) / n, sum(hit) / n, len(hit) / len(inside), sum(hit) / len(inside))))}
    assert counted_by_bits(df)


def test_answers_give_the_first_of_each_block(spark, write, small_blocks):
    d, recipes, queries = tables(write, 19)
    df, got = run(spark, d, "answer_items")
    expected = set()
    for q, b in found(recipes, queries).items():
        for m in range(3):
            group = sorted((x[1], x[2], r, x[3]) for r, x in b.items() if x[0] == m)[:10]
            expected |= {(f"{q}#0", m, k + 1, r, have, total, -s) for k, (s, total, r, have) in enumerate(group)}
    assert got == expected and counted_by_bits(df)


def test_makeable_is_counted(spark, write, small_blocks):
    d, recipes, queries = tables(write, 21)
    df, got = run(spark, d, "makeable")
    per = [(sum(x[0] == 0 for x in b.values()), len(b)) for b in found(recipes, queries).values()]
    share = sum(min(c, 10) / min(t, 10) for c, t in per if t) / len(per)
    assert got == {(len(queries), round(share, 6), round(sum(c > 0 for c, _ in per) / len(per), 6))} and counted_by_bits(df)


def test_random_arm_draws_inside_blocks(spark, write, small_blocks):
    d, recipes, queries = tables(write, 5)
    df, got = run(spark, d, "arm_random_hash")
    draw = lambda q, r: hashlib.sha256(f"42:{q}#0:{r}".encode()).hexdigest()
    assert got == {(f"{q}#0", k + 1, r) for q, b in found(recipes, queries).items() for k, r in enumerate(sorted(b, key=lambda r: draw(q, r))[:10])}  # noqa: B023
    assert counted_by_bits(df)


def test_sessions_are_written_not_gathered(spark, write):
    rows_ = [(k, f"2024-01-0{1 + k % 3} 0{k % 7}:{10 * (k % 6):02}:00", k % 5, "click", 1.0) for k in range(60)]
    df = spark.createDataFrame(rows_, "event_id long, t string, user_id long, event_type string, value double")
    d = write("events", [tuple(r) for r in df.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value").collect()], "event_id long, ts timestamp, user_id long, event_type string, value double")
    out, got = run(spark, d, "stream_sessions")
    expected = {}
    for user in range(5):
        times = sorted(r[1] for r in rows_ if r[2] == user)
        minutes = [int(t[8:10]) * 1440 + int(t[11:13]) * 60 + int(t[14:16]) for t in times]
        lengths = [1]
        for a, b in itertools.pairwise(minutes):
            lengths = [*lengths, 1] if b - a >= 30 else [*lengths[:-1], lengths[-1] + 1]
        expected[user] = (len(lengths), len(times), max(lengths))
    assert got == {(u, *x) for u, x in expected.items()}
    assert "MemoryPlan" not in plan(out) and "parquet" in plan(out)


def test_blocked_queries_are_told_by_counts(spark, monkeypatch, small_blocks):
    from wicker.operators import blocks

    rnd = random.Random(3)
    lines = {f"r{k}": rnd.sample("abcdefghij", rnd.randint(2, 7)) for k in range(90)}
    held = {f"q{k}": rnd.sample("abcdefghij", rnd.randint(1, 3)) for k in range(40)}
    need = [(r, k, i, 1.0, len(ls), float(len(ls))) for r, ls in lines.items() for k, i in enumerate(ls)]
    n = spark.createDataFrame(need, "rid string, line_no int, id string, w double, total long, den double")
    h = spark.createDataFrame([(q, i) for q, ids in held.items() for i in ids], "qid string, id string")
    got = Counter()
    for r in blocks.counts_within(h, n, 2).collect():
        got[r["qid"], r["missing"]] += r["n"]
    assert got == Counter((q, len(set(ls) - set(ids))) for q, ids in held.items() for ls in lines.values() if set(ls) & set(ids) and len(set(ls) - set(ids)) <= 2)


def ranked_pools(recipes, queries, subs, cap):
    """(query, basket) -> shared items, items, best fill, sum of fills and place in the pool."""
    out = {}
    for q, b in covered(recipes, queries).items():
        for place, (r, n) in enumerate(b[:cap]):
            lacking = {i for i in recipes[r] if i != "unknown"} - set(queries[q])
            fill = [max([0.0, *(s for (a, with_), s in subs.items() if a == i and with_ in queries[q])]) for i in lacking]
            out[q, r] = n, n + len(lacking), max(fill, default=0.0), sum(fill), place
    return out


@pytest.mark.parametrize("baskets", [40, 1000])
def test_features_are_made_in_blocks(spark, write, monkeypatch, baskets):
    from wicker.operators import blocks
    from wicker.plans import evaluation_queries

    monkeypatch.setattr(blocks, "BASKETS", baskets)
    monkeypatch.setattr(blocks, "LEAST_QUERIES", 8)
    monkeypatch.setattr(evaluation_queries, "POOL", 23)
    d, recipes, queries = tables(write, 6)
    rnd = random.Random(6)
    subs = {(f"i{a}", f"i{b}"): round(rnd.uniform(-0.3, 0.9), 6) for a in range(16) for b in rnd.sample(range(16), 4) if a != b}
    monkeypatch.setattr(evaluation_queries, "substitute_ids", lambda s, _: s.createDataFrame([(*k, v) for k, v in subs.items()], "a string, b string, score double"))
    df, got = run(spark, d, "candidate_features")
    expected = ranked_pools(recipes, queries, subs, 23)
    got = {(r[0], r[1]): r[2:] for r in got}
    assert got.keys() == {(f"{q}#0", r) for q, r in expected}
    for (q, r), (n, size, most, total, _) in expected.items():
        assert got[f"{q}#0", r] == pytest.approx((n / size, n / len(queries[q]), most, n, size - n, size, total * 1e6), abs=1.1e-6)
    assert counted_by_bits(df) and "Join" not in plan(df).split("FlatMapCoGroupsInArrow")[0]


@pytest.mark.parametrize("kind", ["linear", "pairwise", "boosted"])
def test_rankers_over_pools_in_blocks(spark, write, small_blocks, monkeypatch, kind):
    from wicker.operators import evaluation
    from wicker.plans import evaluation_queries

    monkeypatch.setattr(evaluation_queries, "POOL", 40)
    d, recipes, queries = tables(write, 8)
    seen = []
    made = evaluation_queries._featured
    monkeypatch.setattr(evaluation_queries, "_featured", lambda *x: seen.append(made(*x)) or seen[0])
    _, got = run(spark, d, f"ranker_{kind}")
    train = {r["qid"] for r in spark.createDataFrame([(f"{q}#0",) for q in queries], "qid string").where(evaluation.is_train(F.col("qid"))).collect()}
    inside = {f"{q}#0" for q, r in ranked_pools(recipes, queries, {}, 40) if q == r}
    rows_ = seen[0].collect()
    assert {r["qid"] for r in rows_} == inside == {r["qid"] for r in rows_ if r["label"] == 1 and r["rid"] == r["qid"][:-2]}
    assert len(rows_) == sum(f"{q}#0" in inside for q, _ in ranked_pools(recipes, queries, {}, 40))
    (n, recall, mrr, model, share), = got
    assert n == len(queries) - len(train) and model == kind and 0 <= mrr <= recall <= share == round(len(inside - train) / n, 6)


def test_scores_are_bounded_by_bits(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from wicker.operators import blocks

    rnd = random.Random(9)
    w = {f"i{k}": rnd.uniform(0.1, 8) for k in range(40)}
    baskets = [[rnd.choice([*w, None, None]) for _ in range(rnd.randint(1, 9))] for _ in range(700)]
    weights = [[w.get(i, 0.0) for i in ls] for ls in baskets]
    block = blocks.Block(pa.table({
        "rid": [f"r{k}" for k in range(700)], "total": [len(ls) for ls in baskets], "den": [sum(x) for x in weights],
        "line": pa.array([list(range(len(ls))) for ls in baskets], pa.list_(pa.int32())), "id": pa.array(baskets, pa.list_(pa.string())), "w": weights, "plain": [True] * 700,
    }))
    names, looked = block.items.to_pylist(), 0
    for _ in range(60):
        hits = blocks.Hits(block, [names.index(i) for i in rnd.sample(names, rnd.randint(1, 12))])
        every = dict(zip(*map(list, hits.touched())))
        for least in [0.0, *rnd.sample(sorted(every.values()), 3), max(every.values()), 99.0]:
            at, value = hits.reaching(least)
            got = dict(zip(at.tolist(), value.tolist()))
            assert {p for p, x in every.items() if x >= least} <= got.keys() and all(abs(every[p] - x) < 1.1e-6 for p, x in got.items())
            looked += len(got) / len(every)
    assert np.isfinite(looked) and looked < 0.7 * 360


def test_packs_are_written_once_and_travel_compressed(spark, write, small_blocks):
    from wicker.operators import answer

    d, recipes, queries = tables(write, 23)
    pack = answer.build_pack(spark, d)
    assert "parquet" in plan(pack.need) and not {"Exchange", "ExistingRDD", "Window"} & set(plan(pack.need).replace(" ", "\n").replace("(", "\n").split("\n"))
    need = {r: [n for n in ls if n != "i0"] for r, ls in recipes.items()}
    assert Counter((r["rid"], r["id"] or "unknown", r["total"]) for r in pack.need.collect()) == Counter((r, n, len(ls)) for r, ls in need.items() for n in ls)
    for name in ("answer_group_counts", "candidate_pool"):
        assert "MapInArrow" in plan(run(spark, d, name)[0]).replace("FlatMapCoGroupsInArrow", "")


def test_lacking_baskets_are_told_from_all_at_once():
    import pyarrow as pa
    from wicker.operators import blocks

    rnd = random.Random(24)
    names = [f"i{k}" for k in range(30)]
    baskets = [[rnd.choice([*names, None]) for _ in range(rnd.randint(1, 20))] for _ in range(500)]
    whole = pa.table({
        "rid": [f"r{k:03}" for k in range(500)], "total": [len(ls) for ls in baskets], "den": [1.0] * 500,
        "line": pa.array([list(range(len(ls))) for ls in baskets], pa.list_(pa.int64())), "id": pa.array(baskets, pa.list_(pa.string())),
        "w": [[1.0 if i else 0.0 for i in ls] for ls in baskets], "plain": [True] * 500,
    })
    sent = blocks._unbundled([blocks._bundle(whole[:200]), blocks._bundle(whole[200:])])
    assert sent.to_pylist() == whole.to_pylist()
    block = blocks.Block(sent)
    code = {i: k for k, i in enumerate(block.items.to_pylist())}
    for _ in range(40):
        held = rnd.sample(names, rnd.randint(1, 28))
        hits = blocks.Hits(block, [code[i] for i in held])
        have = [sum(i in held for i in ls) for ls in baskets]
        assert hits.highest() == max(have)
        for m in range(5):
            expected = {f"r{k:03}" for k, ls in enumerate(baskets) if have[k] and len(ls) - have[k] == m}
            at = hits.lacking(m)
            assert set(block.rids[at]) == expected and hits.number_lacking(m) == len(expected) == len(at) and (at[1:] > at[:-1]).all()
            assert [round(x * len(p), 6) for x, p in zip(hits.scores(at), at[:, None])] == [have[int(block.rids[p][1:])] for p in at]


def test_names_go_to_every_task_instead_of_rows_to_names(spark, write):
    """Pairs are moved by key and by row, never to meet the totals, shares or numbers of their names."""
    from wicker.plans import graph_queries

    rnd = random.Random(25)
    recipes = [rnd.sample([f"i{k:02}" for k in range(40)], 4) for _ in range(120)]
    d = write("recipes", [(f"r{k}", r) for k, r in enumerate(recipes)], "recipe_id string, canonical array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = graph_queries._pairs(spark, d)
        assert "parquet" in plan(pairs)
        values = substitution.sppmi(pairs)
        assert "SortMergeJoin" not in plan(values) and "BroadcastHashJoin" in plan(values)
        got = {x[:3]: x[3] for x in rows(graph_queries._graph(spark, d))}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = {(a, r, b): s for a, r, b, s in brute_neighbors(recipes, 5)}
    assert got.keys() == expected.keys() and all(abs(got[x] - expected[x]) < 1.1e-6 for x in got)


def test_lines_are_gathered_as_numbers(spark, write):
    """Repeated rows count once, unread lines by name; lines without a number and names with two entries stay apart."""
    from wicker.operators import basket, blocks

    ingredients = [("salt", "salt", "", "1"), ("a", "apple", "", "0"), ("b", "bean", "", "0"), ("c", "twice", "", "0"), ("d", "twice", "", "0")]
    d = write("ingredients", ingredients, "id string, name string, synonyms string, staple string")
    lines = [("r1", 0, "Apple"), ("r1", 0, "apple "), ("r1", 1, "bean"), ("r1", 1, "strange"), ("r1", 1, "odd"), ("r1", 2, "salt"), ("r2", 0, "salt"), ("r2", 1, None), ("r3", 3, "twice"), ("r3", -1, "bean"), ("r4", 0, "salt")]
    d = write("parsed_ingredients", [(r, n, "raw", x) for r, n, x in lines], "recipe_id string, line_no int, raw string, canonical string")
    known = basket.entries(spark, d)
    codes = basket.line_codes(spark, d, known)
    assert dict(codes.dtypes)["read"] == "array<bigint>"
    counts = {r["id"]: r["df"] for r in blocks.counted_lines(codes, known).collect()}
    assert counts == {"a": 1, "b": 2, "c": 1, "d": 1, "salt": 2, None: 3}
    packed = blocks.weighed(codes, spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, idf double").toArrow(), known)
    got = {r["rid"]: (r["total"], sorted(zip(r["line"], map(str, r["id"]))), r["plain"]) for r in packed.collect()}
    assert got == {
        "r1": (4, [(0, "a"), (1, "None"), (1, "None"), (1, "b")], False), "r2": (1, [(1, "None")], True), "r3": (3, [(-1, "b"), (3, "c"), (3, "d")], False),
    }
    assert {(r["rid"], r["id"], r["n"]) for r in basket.item_rows(spark, d).collect()} == {
        (r, i, n) for r, ids in {"r1": ["a", "b", "salt"], "r2": ["salt"], "r3": ["b", "c", "d"], "r4": ["salt"]}.items() for i, n in zip(ids, [len(ids)] * 9)
    }


def test_tasks_merge_what_blocks_give(spark, write, small_blocks):
    """No more rows leave the search than a query asked for, though there are several blocks."""
    from wicker.operators import answer, basket, blocks

    d, recipes, queries = tables(write, 26)
    pack, held = answer.build_pack(spark, d), basket.pantries(spark, d)
    assert pack.baskets.blocks > 2
    most = Counter((r["qid"], r["missing"]) for r in blocks.within(held, pack.baskets, 2, 3).collect())
    assert most and max(most.values()) == 3
    for arm in ("overlap", "idf_flat", "shipped"):
        assert max(Counter(r["qid"] for r in blocks.best(held, pack.baskets, arm, 4).collect()).values()) == 4
    packed = blocks.Packed(blocks.gathered_items(spark, d))
    assert max(Counter(r["qid"] for r in blocks.pools(held, packed, 6).collect()).values()) == 6


def test_places_are_counted_only_as_far_as_asked(spark, write, small_blocks):
    from wicker.operators import blocks

    d, recipes, queries = tables(write, 28)
    packed = blocks.Packed(blocks.gathered_items(spark, d))
    held = spark.createDataFrame([(q, sorted(set(ids))) for q, ids in queries.items()], "qid string, ids array<string>")
    order = {q: pool for q, pool in covered(recipes, queries).items() if pool}
    sizes = {r: len({n for n in ls if n != "unknown"}) for r, ls in recipes.items()}
    own = [(q, *pool[k], sizes[pool[k][0]], k + 1) for q, pool in order.items() for k in [len(pool) // 2 % 9]]
    asked = spark.createDataFrame([x[:4] for x in own], "qid string, g_rid string, g_matched long, g_n long")
    every = {r["qid"]: r["rank"] for r in blocks.pool_ranks(held, packed, asked).collect()}
    assert every == {x[0]: x[4] for x in own}
    assert {r["qid"]: r["rank"] for r in blocks.pool_ranks(held, packed, asked, 4).collect()} == {q: k for q, k in every.items() if k <= 4}


def test_without_blocked_queries_nothing_is_joined(spark, write, small_blocks):
    d, _, _ = tables(write, 29)
    read = lambda name, kept: spark.read.parquet(f"{d}/{name}.parquet").where(kept).collect()
    lines = [r for r in read("parsed_ingredients", "recipe_id is not null")]
    some = next(r["recipe_id"] for r in lines)
    items = sorted({r["id"] for r in read("ingredients", "id is not null")})
    schema = spark.read.parquet(f"{d}/eval_pantries.parquet").schema
    row = {f.name: None for f in schema.fields} | {"gold_id": some, "draw": 0, "pantry": items}
    write("eval_pantries", [tuple(row[f.name] for f in schema.fields)], schema)
    df, got = run(spark, d, "answer_blockers")
    assert not got and "Join" not in plan(df)
