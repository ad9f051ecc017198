"""Queries that once worked on a part of their input, against plain Python over all of it."""

import itertools
import random
import re
import unicodedata
from collections import Counter

from wicker.functions.quantity import GLYPHS
from wicker.plans import catalog


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_blockers_of_whole_pantries(spark, write):
    rnd = random.Random(11)
    names = [f"i{k}" for k in range(14)]
    recipes = {f"r{k}": [rnd.choice([*names, "unknown"]) for _ in range(rnd.randint(4, 8))] for k in range(25)}
    pantries = {f"q{k}": rnd.sample(names, rnd.randint(1, 4)) for k in range(30)}
    write("ingredients", [(n, n, "1" if n == "i0" else "0") for n in names], "id string, name string, staple string")
    write("parsed_ingredients", [(r, k, f"1 {n}", n) for r, ls in recipes.items() for k, n in enumerate(ls)], "recipe_id string, line_no int, raw string, canonical string")
    d = write("eval_pantries", [(q, 0, ids) for q, ids in pantries.items()], "gold_id string, draw int, pantry array<string>")
    used = {n for ls in recipes.values() for n in ls}
    expected = set()
    for q, ids in pantries.items():
        own = (set(ids) & used) - {"i0"}
        need = [[n for n in ls if n != "i0"] for ls in recipes.values()]
        if not own or any(own & set(ls) and sum(n not in own for n in ls) <= 2 for ls in need):
            continue
        gains = Counter()
        for ls in need:
            open_ = Counter(n for n in ls if n not in own)
            gains.update(n for n, g in open_.items() if n != "unknown" and sum(open_.values()) - g <= 2)
        top = sorted(gains.items(), key=lambda x: (-x[1], x[0]))[:5]
        expected |= {(f"{q}#0", k + 1, i, n) for k, (i, n) in enumerate(top)}
    assert any(len(pantries[q[:-2]]) > 1 for q, *_ in expected)
    assert set(rows(catalog.queries()["answer_blockers"](spark, d))) == expected


_NUMBER = r"(?:\d+\s+)?\d+\s*/\s*\d+|\d+\.\d+|\.\d+|\d+"


def plain_quantity(raw):
    """(quantity, rest) of a line, by one regular expression over the line with its marks spelled out."""
    for glyph, v in GLYPHS.items():
        raw = raw.replace(glyph, f" {v.numerator}/{v.denominator} ")
    t = " ".join(raw.replace("\u2044", "/").replace("\u2013", "-").replace("\u2014", "-").split())
    m = re.match(_NUMBER, t, re.ASCII)
    if not m:
        return None, t
    *whole, last = re.sub(r"\s*/\s*", "/", m[0]).split()
    top, _, below = last.partition("/")
    q = None if below and not int(below) else sum(map(float, whole)) + float(top) / float(below or 1)
    tail = r"\s*(?:-|to\b)\s*(?:\d+\s+\d+\s*/\s*\d+|\d+\s*/\s*\d+|\d+(?:\.\d+)?)"
    return q if q is None else round(q, 9), re.sub("^" + tail, "", t[m.end() :], flags=re.ASCII).strip()


def test_quantities_of_every_line(spark, write):
    starts = ["", "1", "1¼", "½", "2–3", "2 to 3 1/2", "2.5", "1 1/2", "1⁄4", "1/0", ".5", "3—4", "10-12", "¾ -1"]
    rests = [" cups x", "dL crème fraîche, sifted", " (15 oz) can x", ", a-b", "", " x 2"]
    lines = [a + b for a in starts for b in rests] + ["jalapeño, 2", "  salt\tto taste ", "(2) eggs"]
    d = write("parsed_ingredients", [(x,) for x in [*lines, None]], "raw string")
    got = {r["raw"]: (r["quantity"], r["rest"]) for r in catalog.queries()["parse_quantity"](spark, d).collect()}
    assert got == {x: plain_quantity(x) for x in lines}
    assert got["1¼ cups x"] == (1.25, "cups x") and got["2–3, a-b"] == (2.0, ", a-b") and got["(2) eggs"] == (None, "(2) eggs")


def test_rare_items_have_pairs_and_neighbours(spark, write):
    rare = [["x", "y", "a"], ["y", "x", "w"], ["x", "y", "w"], ["x", "z", "b"], ["once", "a"]]
    recipes = rare + [["a", "b"]] * 450
    d = write("recipes", [(f"r{k}", items) for k, items in enumerate(recipes)], "recipe_id string, canonical array<string>")
    count = Counter(i for r in recipes for i in r)
    expected = Counter(p for r in recipes for p in itertools.combinations(sorted(i for i in r if count[i] >= 2), 2))
    assert set(rows(catalog.queries()["cooccurrence"](spark, d))) == {(*p, n) for p, n in expected.items()}
    assert ("x", "y", 3) in {(*p, n) for p, n in expected.items()}
    for name, key in (("sppmi", "i"), ("graph_neighbors", "a"), ("rank_blend", "qid"), ("svd_neighbors", "query_id")):
        assert {"x", "y"} <= {r[key] for r in catalog.queries()[name](spark, d).collect()}, name


def plain_normal(t):
    t = re.sub(r"\([^)]*\)", " ", unicodedata.normalize("NFKC", t).lower().strip())
    return " ".join(re.sub(r"[^a-z0-9/.\-\s]", " ", t).split())


def plain_singular(w):
    if len(w) <= 3 or w.endswith("ss") or w.endswith("sses"):
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    return w[:-2] if w.endswith(("ches", "shes", "ses", "xes", "zes", "oes")) else w.removesuffix("s")


def plain_key(t):
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return " ".join(map(plain_singular, plain_normal(t.replace("-", " ")).split()))


def test_texts_of_any_characters(spark, write):
    names = ["jalapeño", "crème fraîche", "7-up", "half & half", "salt"]
    typed = ["Jalapeños", "creme fraiche", "7 up", "Crème Fraîche (cold), 2", "½ salt", "salt", "ﬁgs", "half & half", "naïve, x"]
    write("ingredients", [(f"i{k}", n, "0") for k, n in enumerate(names)], "id string, name string, staple string")
    write("realistic_inputs", [(k, t) for k, t in enumerate([*typed, None, " "])], "input_id long, text string")
    write("parsed_ingredients", [(t,) for t in typed], "raw string")
    d = write("raw_recipes", [(1, [*typed, None])], "raw_id long, ner array<string>")
    clean = {t: " ".join(t.lower().split()) for t in typed}
    q = catalog.queries()
    assert dict(rows(q["normalize"](spark, d))) == {t: plain_normal(t) for t in typed}
    got = dict(map(tuple, q["canonicalize"](spark, d).collect()))
    assert {t: got[t] for t in typed} == {t: " ".join(map(plain_singular, plain_normal(t.replace("-", " ")).split())) for t in typed}
    words = {w + e for t in clean.values() for w in t.split() for e in ("", "s", "es", "ies")}
    assert dict(rows(q["singularize"](spark, d))) == {w: plain_singular(w) for w in words}
    ids = {plain_key(n): f"i{k}" for k, n in enumerate(names)}
    assert set(rows(q["resolve_names"](spark, d))) == {(k, clean[t], ids.get(plain_key(clean[t]))) for k, t in enumerate(typed)}
    foods = {r["name"]: (r["food_id"], r["how"]) for r in q["jaccard_match"](spark, d).collect()}
    assert set(foods) == set(clean.values()) and foods["half & half"] == ("i3", "exact") and foods["½ salt"] == ("i4", "similar")
