"""Wiki pages: cleaning of wiki text, recipe pages to source records, and a page source over an injected transport."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wicker.functions.text import page_url, strip_templates

_STEPS = (
    (re.compile(r"<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<!--.*?-->", re.DOTALL | re.IGNORECASE), ""),
    (re.compile(r"<br\s*/?>", re.IGNORECASE), "; "),
)
_FILE = re.compile(r"\[\[(?:File|Image):(?:[^\[\]]|\[\[[^\]]*\]\])*\]\]", re.IGNORECASE)


def clean_markup(text: str | None) -> str | None:
    """One line of plain text: references, templates, files and tags dropped, links by their label, entities decoded."""
    if text is None:
        return None
    for pattern, by in _STEPS:
        text = pattern.sub(by, text)
    text = _FILE.sub("", strip_templates(text))
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+\s*([^\]]*)\]", r"\1", text)
    text = html.unescape(re.sub(r"'{2,}", "", re.sub(r"<[^>]+>", "", text)))
    return re.sub(r"\s+", " ", text).strip(" ;")


@F.pandas_udf(T.StringType())
def clean_markup_udf(texts: pd.Series) -> pd.Series:
    return texts.map(clean_markup)


def sections(wikitext: str) -> dict[str, list[str]]:
    """Lines below each heading of level two, by lower-cased title; repeated titles are continued, deeper headings dropped."""
    found: dict[str, list[str]] = {}
    current: list[str] | None = None
    for line in wikitext.replace("\r\n", "\n").split("\n"):
        if m := re.match(r"\s*==([^=].*?)==\s*$", line):
            current = found.setdefault(clean_markup(m[1]).lower(), [])
        elif re.match(r"\s*={3,}", line):
            continue
        elif current is not None:
            current.append(line)
    return found


def summary_fields(wikitext: str) -> dict[str, str]:
    """key=value fields of the first {{recipe summary ...}}, split at bars outside links and templates; the last value of a key counts."""
    start = re.search(r"\{\{\s*recipe ?summary\s*\|?", wikitext, re.IGNORECASE)
    if not start:
        return {}
    depth, i, parts = 0, start.end(), [""]
    while i < len(wikitext):
        two = wikitext[i : i + 2]
        if two in ("[[", "{{"):
            depth, i, parts[-1] = depth + 1, i + 2, parts[-1] + two
        elif two == "}}" and depth == 0:
            break
        elif two in ("]]", "}}"):
            depth, i, parts[-1] = max(depth - 1, 0), i + 2, parts[-1] + two
        elif wikitext[i] == "|" and depth == 0:
            parts.append("")
            i += 1
        else:
            parts[-1] += wikitext[i]
            i += 1
    fields = {}
    for p in parts:
        key, eq, value = p.partition("=")
        if eq:
            fields[key.strip().lower()] = clean_markup(value)
    return fields


_STEP_TITLES = ("procedure", "method", "directions", "preparation", "instructions")
_PAGE = T.StructType(
    [
        T.StructField("ingredient_lines", T.ArrayType(T.StringType())), T.StructField("steps", T.ArrayType(T.StringType())),
        T.StructField("category", T.StringType()), T.StructField("servings", T.StringType()), T.StructField("time", T.StringType()),
    ]
)


def parse_page(wikitext: str | None) -> tuple | None:
    """Lines, steps and summary of a recipe page; None without a list of ingredients."""
    if not wikitext or re.match(r"\s*#redirect", wikitext, re.IGNORECASE):
        return None
    parts = sections(wikitext)
    bullets = lambda lines: [t for line in lines if re.match(r"\s*[*#]", line) and (t := clean_markup(re.sub(r"^\s*[*#:;]+\s*", "", line)))]
    lines = bullets(parts.get("ingredients", []))
    if not lines:
        return None
    steps = next((s for title in _STEP_TITLES if (s := bullets(parts.get(title, [])))), [])
    fields = summary_fields(wikitext)
    return lines, steps, fields.get("category"), fields.get("servings"), fields.get("time")


@F.pandas_udf(_PAGE)
def _parse_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [parse_page(t) or (None, None, None, None, None) for t in texts]
    return pd.DataFrame(rows, columns=_PAGE.fieldNames())


def parse_pages(pages: DataFrame, prefix: str, base: str = "https://wiki.invalid/") -> DataFrame:
    """Source records of the pages whose title starts with ``prefix``; pages without a list of ingredients are dropped."""
    parsed = pages.where(F.col("title").startswith(prefix)).withColumn("p", _parse_udf("wikitext")).where("p.ingredient_lines is not null")
    return parsed.select(
        F.concat(F.lit("wb-"), "page_id").alias("recipe_id"), F.regexp_replace("title", "^" + re.escape(prefix), "").alias("title"), "revision_id",
        page_url(F.col("title"), base).alias("url"), F.array_join("p.ingredient_lines", "\n").alias("ingredient_lines"),
        F.array_join("p.steps", "\n").alias("steps"), "p.category", "p.servings", "p.time",
    )


Transport = Callable[[dict[str, str]], dict]


def category_pages(call: Transport, root: str, batch: int = 50, retries: int = 5) -> Iterator[dict]:
    """Pages of a category and its subcategories, each once, with their text; calls are made one after another.

    ``call`` takes the parameters of a request and returns the decoded answer; answers may be continued, and an answer that
    says the server lags is asked for again.
    """

    def ask(params: dict[str, str]) -> Iterator[dict]:
        more: dict[str, str] = {}
        while True:
            for _ in range(retries):
                answer = call({**params, **more})
                if answer.get("error", {}).get("code") != "maxlag":
                    break
            else:
                raise RuntimeError("the server keeps lagging")
            if "error" in answer:
                raise RuntimeError(str(answer["error"]))
            yield answer
            more = answer.get("continue", {})
            if not more:
                return

    seen, queue, ids = {root}, [root], set()
    while queue:
        category = queue.pop(0)
        for answer in ask({"action": "query", "list": "categorymembers", "cmtitle": category}):
            for member in answer["query"]["categorymembers"]:
                if member["title"].startswith("Category:"):
                    if member["title"] not in seen:
                        seen.add(member["title"])
                        queue.append(member["title"])
                else:
                    ids.add(member["pageid"])
    ordered = sorted(ids)
    for i in range(0, len(ordered), batch):
        for answer in ask({"action": "query", "prop": "revisions", "pageids": "|".join(map(str, ordered[i : i + batch]))}):
            yield from sorted(answer["query"]["pages"], key=lambda p: p["pageid"])


class WikiPages(DataSource):
    """``spark.read.format("wiki_pages")`` with options root and transport ("module:function"); one partition, serial calls."""

    @classmethod
    def name(cls) -> str:
        return "wiki_pages"

    def schema(self) -> str:
        return "page_id long, title string, revision_id long, timestamp string, wikitext string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _WikiReader(self.options)


class _WikiReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.transport = options["root"], options["transport"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.transport.partition(":")
        call = getattr(importlib.import_module(module), name)
        for p in category_pages(call, self.root):
            r = p["revisions"][0]
            yield p["pageid"], p["title"], r["revid"], r["timestamp"], r["text"]
