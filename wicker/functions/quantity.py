"""Amounts with units in free text: a small grammar, exact fractions, and units as exponent vectors."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

#: The spellings of each unit symbol, as people write them.
SPELLINGS: dict[str, tuple[str, ...]] = {
    "g": ("g", "gr", "grs", "gm", "gms", "gram", "grams", "gramme", "grammes"),
    "kg": ("kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes"),
    "mg": ("mg", "mgs", "milligram", "milligrams", "milligramme", "milligrammes"),
    "oz": ("oz", "ozs", "ounce", "ounces"),
    "lb": ("lb", "lbs", "pound", "pounds"),
    "ml": ("ml", "mls", "millilitre", "millilitres", "milliliter", "milliliters"),
    "cl": ("cl", "cls", "centilitre", "centilitres", "centiliter", "centiliters"),
    "dl": ("dl", "dls", "decilitre", "decilitres", "deciliter", "deciliters"),
    "l": ("l", "lt", "ltr", "ltrs", "litre", "litres", "liter", "liters"),
    "tsp": ("tsp", "tsps", "teaspoon", "teaspoons", "teaspoonful", "teaspoonfuls"),
    "tbsp": ("tbsp", "tbsps", "tbs", "tblsp", "tablespoon", "tablespoons", "tablespoonful", "tablespoonfuls"),
    "cup": ("cup", "cups", "c", "cupful", "cupfuls"),
    "fl oz": ("fl oz", "fluid oz", "fluid ounce", "fluid ounces"),
    "pint": ("pint", "pints", "pt", "pts"),
    "quart": ("quart", "quarts", "qt", "qts"),
    "gallon": ("gallon", "gallons", "gal", "gals"),
}
#: The Unicode fraction characters.
GLYPHS: dict[str, Fraction] = {
    "½": Fraction(1, 2), "⅓": Fraction(1, 3), "⅔": Fraction(2, 3), "¼": Fraction(1, 4), "¾": Fraction(3, 4),
    "⅕": Fraction(1, 5), "⅖": Fraction(2, 5), "⅗": Fraction(3, 5), "⅘": Fraction(4, 5), "⅙": Fraction(1, 6),
    "⅚": Fraction(5, 6), "⅐": Fraction(1, 7), "⅛": Fraction(1, 8), "⅜": Fraction(3, 8), "⅝": Fraction(5, 8),
    "⅞": Fraction(7, 8), "⅑": Fraction(1, 9), "⅒": Fraction(1, 10),
}
#: Numbers in words.
WORDS: dict[str, Fraction] = {
    "a": Fraction(1), "an": Fraction(1), "one": Fraction(1), "two": Fraction(2), "three": Fraction(3),
    "four": Fraction(4), "five": Fraction(5), "six": Fraction(6), "seven": Fraction(7), "eight": Fraction(8),
    "nine": Fraction(9), "ten": Fraction(10), "eleven": Fraction(11), "twelve": Fraction(12),
    "half": Fraction(1, 2), "quarter": Fraction(1, 4), "third": Fraction(1, 3),
}
#: Words that may stand between a number and its unit and change nothing.
LOOSE = frozenset("heaped heaping level levelled scant rounded generous good full large small big metric packed about approx".split())
CONTAINERS = "cans?|tins?|jars?|packs?|packages?|packets?|pkgs?\\.?|box(?:es)?|bottles?|bags?|cartons?|containers?|tubs?|pouch(?:es)?|sachets?"

_GLYPH = "[" + "".join(GLYPHS) + "]"
_DIGITS = (
    rf"(?:\d+\s*{_GLYPH}|{_GLYPH}|\d+\s+\d+\s*[/⁄]\s*\d+|\d+\s*[/⁄]\s*\d+|\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?(?!\d)|\d+[.,]\d+|[.,]\d+|\d+)"
)
_WORD = (
    r"(?:half\s+an?|half|(?:a\s+)?quarter(?:\s+of)?(?:\s+an?)?|an?|(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
    r"(?:\s+and\s+(?:a\s+half|a\s+quarter|one\s+half|\d\s*[/⁄]\s*\d))?)"
)
_DASH = r"\s*(?:[-–—‒−~]|\b(?:to|or)\b)\s*"
_DIGIT_NUMBER = re.compile(rf"(?<![\w.,/⁄])({_DIGITS})(?:{_DASH}(?:{_DIGITS}))?[\s-]*")
_WORD_NUMBER = re.compile(rf"(?<![^\W_])({_WORD})(?:\s+(?:to|or)\s+{_WORD})?\s+", re.IGNORECASE)
_UNIT = re.compile(r"(fl(?:uid)?\.?\s*(?:oz|ounces?)|[a-z]+)(?![^\W_])(\.?[\s-]*)", re.IGNORECASE)
_SIZE = re.compile(rf"(?:{_DIGITS}|\b{_WORD})\s*\([^()]*\)\s*(?:{CONTAINERS})(?![^\W_])", re.IGNORECASE)
_DIGIT = re.compile(rf"(?:[.,](?=\d)|[\d{''.join(GLYPHS)}])[\d.,/⁄]*")
_SIZED = re.compile(rf"\)\s*(?:{CONTAINERS})(?![^\W_])", re.IGNORECASE)
_WORD_SET = frozenset(WORDS)
_WORD_START = re.compile(rf"(?<![^\W_]){_WORD}(?=\s)", re.IGNORECASE)
_BY_SPELLING = {form: symbol for symbol, forms in SPELLINGS.items() for form in forms}

Dimension = tuple[int, int, int]
#: Exponents of (mass, length, temperature) of the canonical units.
BASES: dict[str, Dimension] = {"g": (1, 0, 0), "ml": (0, 3, 0), "cm": (0, 1, 0), "K": (0, 0, 1)}


@dataclass(frozen=True)
class Unit:
    """canonical value = value * scale + offset, in the canonical unit of the same dimension."""

    dimension: Dimension
    scale: Fraction
    offset: Fraction = Fraction(0)


class UnitSystem:
    """Unit symbols with their dimension as an exponent vector, and expressions over them (``kg*cm^2/ml``)."""

    def __init__(self, rows: Iterable[tuple[str, str, float]]):
        self.units = {symbol: Unit(BASES[base], Fraction(repr(float(factor)))) for symbol, base, factor in rows}
        self.canonical = {dim: base for base, dim in BASES.items()}

    def expression(self, text: str) -> Unit:
        """Products, quotients and whole powers; an offset only survives in a single bare unit."""
        parts = re.findall(r"([*/]?)\s*([A-Za-z]+(?: oz)?)\s*(?:\^\s*(-?\d+))?", text)
        if len(parts) == 1 and not parts[0][2]:
            return self.units[parts[0][1]]
        dim, scale = [0, 0, 0], Fraction(1)
        for op, name, power in parts:
            unit, p = self.units[name], int(power or 1) * (-1 if op == "/" else 1)
            dim = [a + b * p for a, b in zip(dim, unit.dimension)]
            scale *= unit.scale**p
        return Unit(tuple(dim), scale)

    def to_canonical(self, value: Fraction, text: str) -> tuple[str, Fraction] | None:
        unit = self.expression(text)
        base = self.canonical.get(unit.dimension)
        return None if base is None else (base, value * unit.scale + unit.offset)


def unit_symbol(text: str) -> str | None:
    """The unit symbol that a spelling stands for, or None."""
    if text in _BY_SPELLING:
        return _BY_SPELLING[text]
    key = " ".join(text.lower().replace(".", " ").split())
    if key in _BY_SPELLING:
        return _BY_SPELLING[key]
    return "fl oz" if re.fullmatch(r"fl(?:uid)? ?(?:oz|ounces?)", key) else None


@lru_cache(maxsize=65536)
def number(text: str) -> Fraction | None:
    """The exact value of a number: digits, decimals with point or comma, fractions, mixed numbers, words."""
    text = text.strip().lower()
    if text in WORDS:
        return WORDS[text]
    if text[:1].isalpha():
        total, words = Fraction(0), text.split()
        if words[0] == "half" or "quarter" in words[:2]:
            return WORDS["half" if words[0] == "half" else "quarter"]
        for w in words:
            if w in ("a", "an", "and", "of"):
                continue
            value = WORDS.get(w) or number(w)
            if value is None:
                return None
            total = total / 2 if w == "half" and words[-2] == "one" and total == 1 and len(words) == 2 else total + value
        return total or None
    glyph = text[-1]
    if glyph in GLYPHS:
        return GLYPHS[glyph] + (int(text[:-1]) if text[:-1].strip() else 0)
    text = text.replace("⁄", "/")
    if "/" in text:
        whole, _, rest = re.sub(r"\s*/\s*", "/", text).rpartition(" ")
        top, bottom = rest.split("/")
        return Fraction(int(top), int(bottom)) + int(whole or 0) if int(bottom) else None
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", text):
        return Fraction(text.replace(",", ""))
    return Fraction(text.replace(",", "."))


def find_amount(text: str | None) -> tuple[Fraction, str] | None:
    """The first amount with a unit of mass or volume: (number, unit symbol).

    Of a range the first number counts. A size in brackets between a count and a container is no amount, and nothing
    behind it is looked at as one of the same count.
    """
    if not text:
        return None
    for amount, unit in _amounts(text):
        value, symbol = number(amount), unit_symbol(unit)
        if value is not None and symbol is not None:
            return value, symbol
    return None


def _amounts(text: str) -> Iterator[tuple[str, str]]:
    """(number, unit spelling) of the amounts, in order; patterns are only tried where a number can start."""
    if "(" in text and _SIZED.search(text):
        text = _SIZE.sub(" ", text)
    starts = [(m.start(), _DIGIT_NUMBER) for m in _DIGIT.finditer(text)]
    if not _WORD_SET.isdisjoint(text.lower().split()):
        starts = sorted(starts + [(m.start(), _WORD_NUMBER) for m in _WORD_START.finditer(text)], key=lambda s: s[0])
    done = 0
    for start, pattern in starts:
        if start < done or not (m := pattern.match(text, start)):
            continue
        at = m.end()
        while u := _UNIT.match(text, at):
            word = u[1].lower()
            if word in LOOSE:
                at = u.end()
                continue
            if unit_symbol(word) is not None:
                done = u.end()
                yield m[1], word
            break


class Converter:
    """Amounts to tenths of the canonical unit, as whole numbers; (number, unit) pairs are computed once."""

    def __init__(self, factors: Iterable[tuple[str, str, float]]):
        self.system = UnitSystem(factors)
        self.texts: dict[tuple[str, str], tuple[str, int] | None] = {}
        self.parts: dict[tuple[float | None, str], tuple[str, int] | None] = {}

    def tenths(self, found: tuple[Fraction, str] | None) -> tuple[str, int] | None:
        if found is None or found[1] not in self.system.units:
            return None
        base, value = self.system.to_canonical(*found)
        return base, round(value * 10)

    def of_text(self, text: str | None) -> tuple[str, int] | None:
        if not text:
            return None
        for key in _amounts(text):
            if key not in self.texts:
                if len(self.texts) > 200_000:
                    self.texts.clear()
                value, symbol = number(key[0]), unit_symbol(key[1])
                self.texts[key] = None if value is None or symbol is None else self.tenths((value, symbol))
            if self.texts[key] is not None:
                return self.texts[key]
        return None

    def of_parts(self, quantity: float | None, unit: str | None, raw: str | None) -> tuple[str, int] | None:
        """A parsed line: quantity with unit, else the unit alone, else the raw text."""
        if unit is not None:
            key = (None if quantity is None or quantity != quantity else quantity, unit)
            if key not in self.parts:
                if len(self.parts) > 200_000:
                    self.parts.clear()
                symbol = unit_symbol(unit)
                if symbol is None:
                    self.parts[key] = self.of_text(unit)
                else:
                    self.parts[key] = None if key[0] is None else self.tenths((exact(quantity), symbol))
            if self.parts[key] is not None:
                return self.parts[key]
        return self.of_text(raw)


@lru_cache(maxsize=65536)
def exact(value: float) -> Fraction:
    """The short decimal or small fraction that a double stands for (0.333… is a third)."""
    short = Fraction(repr(value))
    near = short.limit_denominator(64)
    return near if abs(near - short) < Fraction(1, 10**12) else short


def factor_rows(table: Mapping | Iterable) -> list[tuple[str, str, float]]:
    return [(r["unit"], r["base_unit"], r["factor"]) for r in table]
