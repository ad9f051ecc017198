import pytest

from wicker.llm import canonical


@pytest.mark.parametrize(
    ("typed", "entry", "fits"),
    [
        ("red onion", "red onion", True), ("redonion", "red onion", True), ("red onions", "red onion", True), ("red onoin", "red onion", True), ("flapi. jelly", "flapioth jelly", True),
        ("berries", "berry", True), ("eg", "egg", False), ("green onion", "red onion", False), ("salt", "malt", True), ("mum", "rum", False),
    ],
)
def test_misfit(typed, entry, fits):
    assert (canonical.misfit(canonical.typed_words(typed), entry) is not None) == fits


def test_distance():
    assert canonical.distance("abcd", "abdc", 2) == 1 and canonical.distance("abcd", "acbde", 2) == 2 and canonical.distance("a", "abcd", 2) == 3


def test_prefix_filter_never_loses_a_partner():
    import itertools
    import random

    rnd = random.Random(4)
    sets = [sorted(rnd.sample(range(20), rnd.randint(1, 10))) for _ in range(80)]
    for a, b in itertools.product(sets, sets):
        if len(set(a) & set(b)) >= canonical.SIMILARITY * len(set(a) | set(b)):
            assert set(a[: canonical.prefix_length(len(a))]) & set(b[: canonical.prefix_length(len(b))])


@pytest.fixture
def folder(write):
    d = write(
        "ingredients",
        [("red_onion", "red onion", "onion|\"onion, purple\""), ("white_sugar", "white sugar", "sugar"), ("brown_sugar", "brown sugar", "muscovado"), ("creme_fraiche", "crème fraîche", None)],
        "id string, name string, synonyms string",
    )
    texts = ["Onion", "500g red onion", "  purple onion ", "brown sugra x2", "a little muscovado please", "creme fraiche", "red onyx", "paper towels", "zorblax sugar", "", "  ", None, "sugar, brown", "12345", "x" * 5000]
    data = [(k, t, "c") for k, t in enumerate(texts)]
    write("realistic_inputs", data + data[:4], "input_id long, text string, key string")
    return d


def test_found(spark, folder):
    got = {r["input_id"]: r["ingredient_id"] for r in canonical.found(spark, folder).collect()}
    assert got == dict(enumerate(["red_onion", "red_onion", "red_onion", "brown_sugar", "brown_sugar", "creme_fraiche", "", "", "", "", "", "", "brown_sugar", "", ""]))


def test_unmatched(spark, folder):
    got = {r["text"]: r["n_inputs"] for r in canonical.unmatched(spark, folder).collect()}
    assert got[""] == 3 and got["paper towels"] == 1 and "onion" not in got


def test_empty_reference(spark, write):
    d = write("ingredients", [], "id string, name string, synonyms string")
    write("realistic_inputs", [(1, "salt")], "input_id long, text string")
    assert [tuple(r) for r in canonical.found(spark, d).collect()] == [(1, "")]


def test_fillers_are_learned_and_long_entries_match(spark, write):
    d = write(
        "ingredients",
        [("apricot", "apricot", "apricots"), ("dried_apricot", "dried apricot", None), ("leek", "leek", None), ("millet", "millet", None), ("long", "one very long name of seven words", None)],
        "id string, name string, synonyms string",
    )
    typed = ["zesty leek", "millet zesty", "zesty apricot", "ZESTY dried  apricots", "zesty dried apricto", "dried apricots", "leek towel", "one very long naem of seven wrods", "apricot dried fresh", "zesty", "leek leek leek"]
    write("realistic_inputs", list(enumerate(typed)), "input_id long, text string")
    got = {r["input_id"]: r["ingredient_id"] for r in canonical.found(spark, d).collect()}
    assert got == dict(enumerate(["leek", "millet", "apricot", "dried_apricot", "dried_apricot", "dried_apricot", "", "long", "dried_apricot", "", ""]))


def test_candidates_agree_with_brute_force(spark):
    import random

    rnd = random.Random(8)
    keys = sorted({"".join(rnd.choices("abcde ", k=rnd.randint(4, 14))).strip() for _ in range(120)} - {""})
    keys = [" ".join(k.split()) for k in keys if len(k.replace(" ", "")) > 1]
    typed = sorted({k if rnd.random() < 0.3 else "".join(c if rnd.random() > 0.1 else rnd.choice("abcdes") for c in k) for k in keys * 3})
    typed = [" ".join(t.split()) for t in typed if len(t.replace(" ", "")) > 1]
    table = spark.createDataFrame([(k, k) for k in keys], "key string, id string")
    runs = spark.createDataFrame([(t, t.replace(" ", "")) for t in typed], "words string, compact string").distinct()
    got = {(r["words"], r["key"], r["misfit"]) for r in canonical.candidates(runs, table, canonical.token_ranks(table)).collect()}
    wanted = set()
    for t in typed:
        for k in keys:
            a, b = (set(canonical.tokens_of(x.replace(" ", ""))) for x in (t, k))
            wrong = canonical.misfit(t.split(" "), k)
            if len(a & b) / len(a | b) >= canonical.SIMILARITY and wrong is not None:
                wanted.add((t, k, wrong))
    assert got == wanted and len(wanted) > 100
