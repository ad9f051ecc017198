"""Text normalisation as column expressions; the only Python hop is Unicode normalisation, which Spark lacks."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicker.functions.quantity import GLYPHS, SPELLINGS


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def strip_marks(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return text.map(
        lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    )


def _plain(c: Column) -> Column:
    c = F.regexp_replace(F.trim(F.lower(c)), r"\([^)]*\)", " ")
    c = F.regexp_replace(c, r"(?U)[^a-z0-9/.\-\s]", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """NFKC, lower case, bracketed notes dropped, other characters than a-z 0-9 / . - made blanks, blanks collapsed."""
    return _plain(nfkc(c))


def singularize(w: Column) -> Column:
    """English plural endings, by ordered rules; words up to three letters and words in -ss and -sses stay."""
    return (
        F.when(F.length(w) <= 3, w)
        .when(w.rlike("(ss|sses)$"), w)
        .when(w.rlike("ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(ches|shes|ses|xes|zes|oes)$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def singular_words(c: Column) -> Column:
    """A normalised text with every word made singular."""
    return F.array_join(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), singularize), " ")


def canonicalize(c: Column) -> Column:
    """The one surface form of names: hyphens as blanks, normalised, every word singular."""
    return singular_words(normalize(F.regexp_replace(c, "-", " ")))


def fold_tokens(c: Column) -> Column:
    """Canonical tokens without accents."""
    folded = singular_words(_plain(F.regexp_replace(strip_marks(c), "-", " ")))
    return F.filter(F.split(folded, " "), lambda w: w != "")


def title_key(title: Column, record_id: Column) -> Column:
    """Lower case without bracketed notes, runs of other characters than a-z 0-9 as one blank; ``id:`` and the id if empty."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"\([^)]*\)", " "), "[^a-z0-9]+", " "))
    return F.when(F.coalesce(key, F.lit("")) == "", F.concat(F.lit("id:"), record_id)).otherwise(key)


def ascii_fractions(c: Column) -> Column:
    """Fraction characters as " 1/2 " and the fraction slash as "/"."""
    for glyph, value in GLYPHS.items():
        c = F.replace(c, F.lit(glyph), F.lit(f" {value.numerator}/{value.denominator} "))
    return F.replace(c, F.lit("⁄"), F.lit("/"))


_MIXED = r"^(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)"
_DECIMAL = r"^(\d+(?:\.\d+)?|\.\d+)"


def parse_quantity(c: Column) -> tuple[Column, Column]:
    """(quantity, rest): the leading number, of a range the first; (null, trimmed text) without one, null for x/0."""
    t = F.trim(F.regexp_replace(F.regexp_replace(ascii_fractions(c), "[–—]", "-"), r"(?U)\s+", " "))
    mixed = t.rlike(_MIXED)
    whole = F.coalesce(F.regexp_extract(t, _MIXED, 1).try_cast("double"), F.lit(0.0))
    fraction = F.try_divide(F.regexp_extract(t, _MIXED, 2).try_cast("double"), F.regexp_extract(t, _MIXED, 3).try_cast("double"))
    number = F.when(mixed, whole + fraction).otherwise(F.regexp_extract(t, _DECIMAL, 1).try_cast("double"))
    rest = F.when(mixed, F.regexp_replace(t, _MIXED, "")).otherwise(F.regexp_replace(t, _DECIMAL, ""))
    tail = r"^\s*(?:-|to\b)\s*(?:\d+\s+\d+\s*/\s*\d+|\d+\s*/\s*\d+|\d+(?:\.\d+)?)"
    return number, F.trim(F.regexp_replace(rest, tail, ""))


#: Unit spellings of recipe lines: those of mass and volume, and the containers and portions that count as units.
UNIT_WORDS: dict[str, str] = {form: symbol for symbol, forms in SPELLINGS.items() for form in forms if " " not in form} | {
    "clove": "clove", "cloves": "clove", "can": "can", "cans": "can", "package": "package", "packages": "package",
    "pkg": "package", "slice": "slice", "slices": "slice", "stick": "stick", "sticks": "stick", "pinch": "pinch",
    "pinches": "pinch", "dash": "dash", "dashes": "dash",
}


def unit_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(UNIT_WORDS.items()) for x in pair])


def parse_unit(c: Column) -> tuple[Column, Column]:
    """(unit, rest): the first word if it spells a unit; one leading bracketed note is skipped only before a unit."""
    units = unit_map()
    first = lambda t: F.element_at(units, F.rtrim(F.regexp_extract(F.lower(t), r"^(\S+)", 1), F.lit(".")))
    rest = lambda t: F.trim(F.regexp_replace(t, r"^\S+\s*", ""))
    t = F.trim(c)
    skipped = F.regexp_replace(t, r"^\([^)]*\)\s*", "")
    noted = t.startswith("(") & first(skipped).isNotNull()
    unit = F.when(noted, first(skipped)).otherwise(first(t))
    return unit, F.when(noted, rest(skipped)).when(unit.isNotNull(), rest(t)).otherwise(t)


def page_url(title: Column, base: str) -> Column:
    """The address of a wiki page: blanks as underscores, other characters percent-encoded but for / : ( ) , ' ! * ; @."""
    encoded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    safe = {"%2F": "/", "%3A": ":", "%28": "(", "%29": ")", "%2C": ",", "%27": "'", "%21": "!", "%3B": ";", "%40": "@"}
    return F.concat(F.lit(base), reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), safe.items(), encoded))


def is_source_url(url: Column, host: str) -> Column:
    """https, exactly this host, no user and no port."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return F.coalesce(
        (part("PROTOCOL") == "https") & (part("AUTHORITY") == host) & part("USERINFO").isNull(), F.lit(False)
    )


def phrase_category(text: Column, typos: list[str], abbreviations: list[str], synonyms: list[str]) -> Column:
    """First rule that holds: known typo, abbreviation, synonym; quantity, slash or symbol, several words, plural, plain."""
    low = F.lower(text)
    return (
        F.when(low.isin(typos), "typo")
        .when(low.isin(abbreviations), "abbreviation")
        .when(low.isin(synonyms), "uk_us_synonym")
        .when(low.rlike(r"^\d") | low.startswith("a pinch"), "with_quantity")
        .when(low.contains("/") | low.contains("&"), "slash_or_symbol")
        .when(F.size(F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")) >= 2, "multiword")
        .when(low.endswith("s"), "plural")
        .otherwise("plain")
    )


_TEMPLATE = re.compile(r"\{\{|\}\}")


def strip_templates(text: str) -> str:
    """Text without balanced {{...}}; one never closed takes the rest, a stray closing mark stays."""
    out, depth, at = [], 0, 0
    for m in _TEMPLATE.finditer(text):
        if m[0] == "{{":
            if depth == 0:
                out.append(text[at : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                at = m.end()
    if depth == 0:
        out.append(text[at:])
    return "".join(out)
