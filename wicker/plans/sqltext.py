"""Common table expressions of the SQL checks."""

from __future__ import annotations

from wicker.functions.quantity import GLYPHS

#: White space of any kind: RE2 knows only the ASCII ones by itself.
SPACE = "[\\s\\x0B\\x{85}\\p{Z}]"
W = "trim(regexp_replace(lower({}), '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def clean(c: str) -> str:
    return W.format(c)


def compose(c: str) -> str:
    """NFKC as far as the texts need it: fraction characters, the ellipsis, wide forms of blanks; accents composed."""
    for glyph, value in GLYPHS.items():
        c = f"replace({c}, '{glyph}', '{value.numerator}⁄{value.denominator}')"
    return f"nfc_normalize({c})"


def plain(c: str) -> str:
    """Lower case without bracketed notes, other characters than a-z 0-9 / . - and white space made blanks."""
    return f"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({c})), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9/.\\-\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


CTE = {
    "it": f"it AS (SELECT DISTINCT k, {clean('x')} item FROM (SELECT DISTINCT recipe_id k, unnest(canonical) x FROM recipes) WHERE {clean('x')} <> '')",
    "ing": f"ing AS (SELECT DISTINCT id, {clean('name')} nm, staple = '1' st FROM ingredients)",
    "ln": f"""ln AS (SELECT rid, line_no, opt, id, coalesce(st, false) st FROM
  (SELECT DISTINCT recipe_id rid, line_no, {clean('canonical')} nm, coalesce(raw LIKE '%(optional)%', false) opt FROM parsed_ingredients)
  LEFT JOIN ing USING (nm))""",
    "need": "need AS (SELECT rid, line_no, id FROM ln WHERE NOT opt AND NOT st)",
    "idf": """idf AS (SELECT id, count(DISTINCT rid) df, ln(1 + (SELECT count(DISTINCT rid) FROM need) / count(DISTINCT rid)::DOUBLE) w
  FROM ln WHERE id IS NOT NULL AND rid IN (SELECT rid FROM need) GROUP BY 1)""",
    "q": "q AS (SELECT DISTINCT gold_id || '#' || draw qid, gold_id, unnest(pantry) id FROM eval_pantries)",
    "held": "held AS (SELECT DISTINCT qid, id FROM q JOIN idf USING (id) WHERE id NOT IN (SELECT id FROM ing WHERE st))",
    "tot": "tot AS (SELECT rid, count(*) total, sum(coalesce(w, 0)) den FROM need LEFT JOIN idf USING (id) GROUP BY 1)",
    "cand": """cand AS (SELECT qid, rid, have, total, total - have missing, CASE WHEN den > 0 THEN round(num / sqrt(den), 6) ELSE 0 END score FROM
  (SELECT qid, rid, count(*) have, sum(w) num FROM held JOIN need USING (id) JOIN idf USING (id) GROUP BY 1, 2) JOIN tot USING (rid))""",
    "items": "items AS (SELECT DISTINCT rid, id FROM ln WHERE id IS NOT NULL)",
    "pool": """pool AS (SELECT qid, rid, matched, n - matched missing, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid
  ORDER BY matched / n::DOUBLE DESC, n - matched, rid)::INT rank FROM (SELECT qid, rid, count(*) matched FROM q JOIN items USING (id) GROUP BY 1, 2)
  JOIN (SELECT rid, count(*) n FROM items GROUP BY 1) USING (rid)) WHERE rank <= 25)""",
}
_NEEDS = {
    "ln": ["ing"], "need": ["ln"], "idf": ["need"], "held": ["q", "idf"], "tot": ["need", "idf"], "cand": ["held", "tot"], "items": ["ln"],
    "pool": ["q", "items"],
}


def with_(*names: str, more: str = "") -> str:
    """WITH clause of these expressions and all they need, in order."""
    seen: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in seen:
            seen.append(n)

    for n in names:
        add(n)
    parts = [CTE[n] for n in seen] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n"


#: singular of a word w, as the ordered rules of ``wicker.functions.text.singularize``
SINGULAR = """CASE WHEN length(w) <= 3 OR w LIKE '%ss' OR w LIKE '%sses' THEN w
 WHEN w LIKE '%ies' THEN w[:-4] || 'y'
 WHEN regexp_matches(w, '(ches|shes|ses|xes|zes|oes)$') THEN w[:-3]
 WHEN w LIKE '%s' THEN w[:-2] ELSE w END"""
