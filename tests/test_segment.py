import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wicker.functions.segment import ValueDictionary, clean, protected, split_line, split_names
from wicker.operators import packed_values

KNOWN = ValueDictionary(["salt", "wheat flour", "flour, white", "olive oil", "red onion"])


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (None, []), ("", []), ("  ", []), ("a|b", ["a", "b"]), ("a||b|", ["a", "b"]), ("a; b\tc\nd", ["a", "b", "c", "d"]),
        ('"flour, white"|x', ["flour, white", "x"]), ('"""gold"" onion"', ['"gold" onion']), ("a, b / c", ["a", "b", "c"]),
        ("baker's sugar / x", ["baker's sugar", "x"]), ("a (b, c)|d", ["a (b, c)", "d"]), ('5" pan|x', ['5" pan', "x"]), ('""|a', ["a"]),
    ],
)
def test_names(text, names):
    assert split_names(text) == names


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("2 cups salt, melted", ["2 cups salt, melted"]),
        ("2 cups salt, 3 g wheat flour", ["2 cups salt", "3 g wheat flour"]),
        ("2 cups salt,three tbsp olive oil , 1,5 kg red onion", ["2 cups salt", "three tbsp olive oil", "1,5 kg red onion"]),
        ("2 cups salt, 3 g wheat flour; 1 red onion", ["2 cups salt, 3 g wheat flour", "1 red onion"]),
        ("2 cups salt, 2 at a time", ["2 cups salt, 2 at a time"]),
        ("2 cups flour, white, 3 salt", ["2 cups flour, white", "3 salt"]),
        ("salt, 3 g", ["salt, 3 g"]),
        ("• 1 salt • 2 olive oil", ["1 salt", "2 olive oil"]),
        ('"2 c. salt | house brand"; 1 red onion', ["2 c. salt | house brand", "1 red onion"]),
        ("1 cup / 240 ml salt (rinsed; drained), 2 red onion", ["1 cup / 240 ml salt (rinsed; drained)", "2 red onion"]),
        (None, []), (" ", []), (";;", []),
    ],
)
def test_lines(text, values):
    assert split_line(text, KNOWN) == values


def test_dictionary_decides():
    """Without the dictionary a list is no list, and a mark inside a known value is a boundary."""
    nothing = ValueDictionary([])
    assert split_line("2 cups salt, 3 g wheat flour", nothing) == ["2 cups salt, 3 g wheat flour"]
    assert split_line("1 black | white flour; 2 salt", KNOWN) == ["1 black", "white flour", "2 salt"]
    assert split_line("1 black | white flour; 2 salt", ValueDictionary(["black | white flour"])) == ["1 black | white flour", "2 salt"]
    assert split_line("1 flour, white, 2 salt, 3 salt, white", KNOWN) == ["1 flour, white, 2 salt, 3 salt, white"]
    assert split_names("flour, white, salt") == ["flour", "white", "salt"]
    assert split_names("flour, white, salt; sea salt/flour, white", KNOWN) == ["flour, white", "salt", "sea salt", "flour, white"]
    assert split_names("oat flour, white, salt", KNOWN) == ["oat flour", "white", "salt"]


def test_parts_of_a_large_dictionary_change_nothing(spark, write):
    values = ["salt", "wheat flour", "flour, white", "olive oil", "red onion", "black | white flour"]
    d = write("ingredients", [(f"i{k}", v, "flour, white, salt; oat/x") for k, v in enumerate(values)], "id string, name string, synonyms string")
    lines = ["2 cups flour, white, 3 salt", "1 black | white flour; 2 salt", "1 oil, 2 onion, 3 flour", "salt, 3 g", None, "", "1 salt, 2 at a time"]
    write("source_recipes", [("r1", lines), ("r2", None)], "recipe_id string, ingredient_lines array<string>")
    whole = sorted(map(tuple, packed_values.found(spark, d).collect()))
    assert whole == sorted(map(tuple, packed_values.found(spark, d, part=2).collect()))
    assert ("source_recipes.ingredient_lines", "r1", 2, 2, "3 flour") in whole


def test_cover_takes_most_characters():
    d = ValueDictionary(["ab", "b c d", "c", "ab b"])
    assert [("ab b c d"[a:b]) for a, b in d.cover("ab b c d")] == ["ab", "b c d"]
    assert ValueDictionary([]).cover("x") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab,;"| ', min_size=1, max_size=8).filter(lambda s: s.strip(' "') and s == s.strip()), min_size=1, max_size=5))
def test_quoted_values_come_back(values):
    values = [v for v in values if clean(v) == v]
    packed = "|".join('"' + v.replace('"', '""') + '"' for v in values)
    assert split_names(packed) == values


def test_protection_covers_pairs_only():
    assert not any(protected("a ( b | c"))
    assert list(protected("a (b) c")) == [0, 0, 1, 1, 1, 0, 0]


def test_tables(spark, write):
    d = write("ingredients", [("i1", "salt", "sea salt|table salt"), ("i2", "oil", None), ("i3", "x", "")], "id string, name string, synonyms string")
    write(
        "source_recipes",
        [("r1", ["1 salt; 2 oil", None, "", "3 oil"], "x"), ("r1", ["1 salt; 2 oil", None, "", "3 oil"], "y"), ("r2", None, "z")],
        "recipe_id string, ingredient_lines array<string>, pos string",
    )
    rows = sorted(map(tuple, packed_values.found(spark, d).collect()))
    assert rows == [
        ("ingredients.synonyms", "i1", 0, 0, "sea salt"), ("ingredients.synonyms", "i1", 0, 1, "table salt"),
        ("source_recipes.ingredient_lines", "r1", 0, 0, "1 salt"), ("source_recipes.ingredient_lines", "r1", 0, 1, "2 oil"),
        ("source_recipes.ingredient_lines", "r1", 3, 0, "3 oil"),
    ]


def test_very_long_line():
    random.seed(1)
    parts = [f"{random.randint(1, 9)} cups salt" for _ in range(20_000)]
    assert split_line("; ".join(parts), KNOWN) == parts
