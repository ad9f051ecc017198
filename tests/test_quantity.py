from fractions import Fraction

import pytest

from wicker.functions.quantity import Converter, UnitSystem, exact, find_amount, number, unit_symbol
from wicker.operators import unit_convert

FACTORS = [("g", "g", 1.0), ("kg", "g", 1000.0), ("mg", "g", 0.001), ("oz", "g", 28.3495), ("lb", "g", 453.592), ("ml", "ml", 1.0), ("cup", "ml", 236.588), ("tsp", "ml", 4.929), ("tbsp", "ml", 14.787), ("fl oz", "ml", 29.574), ("l", "ml", 1000.0), ("pint", "ml", 473.176)]


@pytest.mark.parametrize(
    ("text", "amount"),
    [
        ("2 ½ cups x", (Fraction(5, 2), "cup")), ("1 1/2 lb. x", (Fraction(3, 2), "lb")), ("1⁄4 tsp x", (Fraction(1, 4), "tsp")), ("0,75 Kg x", (Fraction(3, 4), "kg")),
        ("5-6 tbsp x", (5, "tbsp")), ("10 – 12 g x", (10, "g")), ("2 to 3 oz x", (2, "oz")), ("225 g (8 oz) x", (225, "g")), ("x, approx. 1 ½ Tbsp", (Fraction(3, 2), "tbsp")),
        ("3/4 heaped tsps x", (Fraction(3, 4), "tsp")), ("half a cup of x", (Fraction(1, 2), "cup")), ("Two cups of x", (2, "cup")), ("12 fl. oz. x", (12, "fl oz")), ("x (2 Cups)", (2, "cup")),
        ("60ml x", (60, "ml")), (".5 oz x", (Fraction(1, 2), "oz")), ("one and a half cups x", (Fraction(3, 2), "cup")), ("1,000 g x", (1000, "g")),
        ("1 (15 oz) can x", None), ("2 (380 g) tins x", None), ("2 cloves x", None), ("1 stick x", None), ("a pinch of x", None), ("4-5 small x", None), ("3 lemons", None),
        ("4-5 small flour", None), ("", None), (None, None), ("salt to taste", None), ("1/0 cup x", None),
    ],
)
def test_amounts(text, amount):
    assert find_amount(text) == amount


def test_units_and_numbers():
    assert unit_symbol(" TSP. ") == "tsp" and unit_symbol("fl.oz") == "fl oz" and unit_symbol("can") is None
    assert number("1 1/2") == Fraction(3, 2) and exact(0.6666666666666666) == Fraction(2, 3) and exact(0.005) == Fraction(1, 200)


def test_tenths():
    c = Converter(FACTORS)
    assert c.of_text("1 cup x") == ("ml", 2366)
    assert c.of_parts(500.0, " G ", "0,5 kg x") == ("g", 5000)
    assert c.of_parts(None, "75 g", "about 75 grams x") == ("g", 750)
    assert c.of_parts(float("nan"), "cup", "2 cups x") == ("ml", 4732)
    assert c.of_parts(1.0, "can", "1 (15 oz) can x") is None
    assert c.of_parts(2.0, None, "2 cups x") == ("ml", 4732)
    assert c.of_parts(None, None, None) is None


def test_unit_expressions():
    s = UnitSystem(FACTORS)
    assert s.expression("kg/l").dimension == (1, -3, 0) and s.expression("kg/l").scale == 1
    assert s.expression("l^2").dimension == (0, 6, 0) and s.to_canonical(Fraction(2), "lb") == ("g", Fraction("907.184"))


def test_tables(spark, write):
    d = write("unit_factors", FACTORS, "unit string, base_unit string, factor double")
    write("ingredients", [("i1", "salt", None)], "id string, name string, synonyms string")
    write("source_recipes", [("wb-1", ["1 g salt; 2 salt", None])], "recipe_id string, ingredient_lines array<string>")
    write("raw_recipes", [(1, ["2 cups x", None, "", "3 x"], "a"), (1, ["2 cups x", None, "", "3 x"], "b"), (2, None, "c")], "raw_id long, ingredients array<string>, base_unit string")
    write("parsed_ingredients", [("r1", 0, "1 kg x", None, None), ("r1", 0, "1 kg x", None, None), ("r1", 1, None, 3.0, "tsp"), ("r2", 0, "x", None, "odd")], "recipe_id string, line_no int, raw string, quantity double, unit string")
    rows = sorted(map(tuple, unit_convert.found(spark, d).collect()))
    assert rows == [
        ("parsed_ingredients", "r1", 0, 0, "g", 10000), ("parsed_ingredients", "r1", 1, 0, "ml", 148),
        ("raw_recipes.ingredients", "1", 0, 0, "ml", 4732), ("source_recipes.ingredient_lines", "wb-1", 0, 0, "g", 10),
    ]
