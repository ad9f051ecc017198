"""Markup residue in text documents: pages to clean blocks of headings, items, paragraphs, code and formulas.

A page is cut into flat text blocks by the lines, tags and environments of its markup language. Each block is described by
its word count, its link density, those of its neighbours, its share of formula and the mark it was opened by, and a decision
tree trained on a small labelled table of pages (``LABELLED``) says what it is, or that it is to be left out: empty blocks,
rows of links for navigation, and the short lines that close a page behind them. The cells of tables are blocks of their own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm.decision_tree import Node, train
from wicker.session import read_table

_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_HOLD = re.compile(f"{_OPEN}(\\d+){_CLOSE}")
_SPACE = re.compile(r"\s+")
_TAG = re.compile(r"""<[/!]?[A-Za-z](?:"[^"<]*"|'[^'<]*'|[^'"<>])*>""")
_BREAK = re.compile(r"<br\b[^<>]*>", re.IGNORECASE)
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_BLOCK_NAMES = (
    "p div ul ol li h1 h2 h3 h4 h5 h6 table tr td th thead tbody blockquote section article header footer nav main body html head "
    "dl dt dd hr center figure figcaption"
).split()
_BLOCK_TAG = re.compile(
    r"""<(/?)(%s)\b(?:"[^"<]*"|'[^'<]*'|[^'"<>])*>""" % "|".join(sorted(_BLOCK_NAMES, key=len, reverse=True)), re.IGNORECASE
)


@dataclass
class Block:
    """A flat block: the mark that opened it and its raw text, with held pieces (code, formulas, literals) as references."""

    mark: str
    raw: str


class Page:
    """The pieces of one page that are taken out before its markup is read."""

    def __init__(self) -> None:
        self.held: list[tuple[str, str]] = []
        self.references: set[str] = set()  # labels of Markdown link definitions

    def hold(self, kind: str, text: str) -> str:
        self.held.append((kind, text))
        return f"{_OPEN}{len(self.held) - 1}{_CLOSE}"

    def restore(self, text: str) -> str:
        return _HOLD.sub(lambda m: self.held[int(m[1])][1], text)

    def only(self, text: str) -> str | None:
        """The kind of the held piece that is all there is in ``text``."""
        m = _HOLD.fullmatch(text.strip())
        return self.held[int(m[1])][0] if m else None


def unescape(text: str) -> str:
    return _ENTITY.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text


def code_text(text: str) -> str:
    return "\n".join(line.rstrip() for line in text.split("\n")).strip()


def language(text: str) -> str:
    """The main markup language of a page."""
    if re.search(r"\\(?:documentclass|begin\{|(?:sub)*section\*?\{|item\b|textbf\{|emph\{)", text):
        return "latex"
    if re.match(r"\s*(?:<!--.*?-->\s*)*<(?:!doctype|html|body|div|head)\b", text, re.IGNORECASE | re.DOTALL):
        return "html"
    wiki = len(re.findall(r"^=+[^=\n].*=+\s*$|\{\{|\[\[|'''|^__[A-Z]+__", text, re.MULTILINE))
    tags = len(re.findall(r"<(?:h[1-6]|p|li)\b", text, re.IGNORECASE))
    mark = len(re.findall(r"^#{1,6} +\S|^(?:-{3,}|={3,}) *$|^```|^\$\$|\]\([^)\s]+|^[-+] |^\d+[.)] |\*\*\S|__\w|`[^`]+`", text, re.MULTILINE))
    if wiki and wiki >= mark:
        return "wiki"
    if mark and mark >= tags:
        return "markdown"
    if tags:
        return "html"
    return "wiki" if re.search(r"^[*#:;]+|''", text, re.MULTILINE) else "markdown"


# --- flat blocks -----------------------------------------------------------------------------------------------------


def _paragraphs(lines: list[str], mark: str = "plain") -> Iterator[Block]:
    rows: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            rows.append(line)
        elif rows:
            yield Block(mark, "\n".join(rows))
            rows = []


def _balanced(text: str, opening: str, closing: str, start: re.Pattern[str] | None = None) -> str:
    """``text`` without its balanced pieces; what is never closed stays."""
    out, i = [], 0
    while (a := text.find(opening, i)) >= 0:
        if start is not None and not start.match(text, a):
            out.append(text[i : a + len(opening)])
            i = a + len(opening)
            continue
        depth, j = 0, a
        for m in re.compile(re.escape(opening) + "|" + re.escape(closing)).finditer(text, a):
            depth += 1 if m[0] == opening else -1
            if depth == 0:
                j = m.end()
                break
        if j == a:
            out.append(text[i : a + len(opening)])
            i = a + len(opening)
            continue
        out.append(text[i:a])
        i = j
    out.append(text[i:])
    return "".join(out)


def _html_blocks(page: Page, text: str, mark: str = "plain") -> Iterator[Block]:
    stack: list[str] = []
    at = 0
    for m in [*_BLOCK_TAG.finditer(text), None]:
        piece = text[at : m.start()] if m else text[at:]
        if piece.strip():
            inner = next((n for n in reversed(stack) if n[0] == "h" and n[1:].isdigit() or n in ("li", "dd", "dt")), None)
            yield from _alone(page, piece, "li" if inner in ("li", "dd", "dt") else "h" if inner else "p" if "p" in stack else mark)
        if m is None:
            return
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name in stack:
                while stack.pop() != name:
                    pass
        elif name != "hr" and not m[0].endswith("/>"):
            if name in ("p", "li") and stack and stack[-1] == name:
                stack.pop()
            stack.append(name)


def _alone(page: Page, piece: str, mark: str) -> Iterator[Block]:
    """A piece, with the code blocks in it as blocks of their own."""
    rest = re.split(f"({_OPEN}\\d+{_CLOSE})", piece)
    text = ""
    for part in rest:
        if page.only(part) == "code":
            if text.strip():
                yield Block(mark, text)
            text = ""
            yield Block("code", part)
        else:
            text += part
    if text.strip():
        yield Block(mark, text)


_WIKI_HELD = re.compile(
    r"<!--.*?(?:-->|\Z)|<nowiki\s*/>|<nowiki>(?P<nowiki>.*?)</nowiki>|<(?P<tag>pre|syntaxhighlight|source|math|ref|script|style|gallery|references)\b"
    r"""(?P<attr>(?:"[^"]*"|'[^']*'|[^'">])*?)(?:/>|>(?P<body>.*?)</(?P=tag)\s*>)""",
    re.IGNORECASE | re.DOTALL,
)


def _strip_code_tag(body: str) -> str:
    return re.sub(r"\A\s*<code\b[^>]*>|</code>\s*\Z", "", body, flags=re.IGNORECASE)


def _hold_tags(page: Page, m: re.Match[str]) -> str:
    if m["nowiki"] is not None:
        return page.hold("literal", unescape(m["nowiki"]))
    tag = (m["tag"] or "").lower()
    if tag in ("pre", "syntaxhighlight", "source") and m["body"] is not None:
        body = m["body"] if tag != "pre" else unescape(_TAG.sub("", m["body"]) if "<code" in m["body"].lower() else m["body"])
        return page.hold("code", code_text(_strip_code_tag(body) if tag != "pre" else body))
    if tag == "math" and m["body"] is not None:
        return page.hold("math", _SPACE.sub(" ", m["body"]).strip())
    return ""


def wiki_blocks(page: Page, text: str) -> Iterator[Block]:
    text = _WIKI_HELD.sub(lambda m: _hold_tags(page, m), text)
    text = _balanced(text, "{{", "}}")
    text = _balanced(text, "[[", "]]", re.compile(r"\[\[\s*(?:file|image|category|media)\s*:", re.IGNORECASE))
    text = re.sub(r"__[A-Z]+__", "", text)
    rows: list[str] = []
    tables = 0

    def flush() -> Iterator[Block]:
        if rows:
            raw = "\n".join(rows)
            rows.clear()
            if _BLOCK_TAG.search(raw):
                yield from _html_blocks(page, raw)
            else:
                yield from _alone(page, raw, "plain")

    for line in text.split("\n"):
        start = line.lstrip(" \t:")
        if start.startswith("{|"):
            yield from flush()
            tables += 1
        elif tables and start.startswith("|}"):
            yield from flush()
            tables -= 1
        elif tables and start[:1] in ("|", "!"):
            yield from flush()
            if start[:2] == "|-":
                continue
            parts = re.split(r"\|\||!!" if start[0] == "!" else r"\|\|", start[1:].removeprefix("+"))
            for k, cell in enumerate(parts):
                if k:
                    yield from flush()
                rows.append(re.sub(r"^[^\[\]{}|]*\|", "", cell))
        elif not line.strip():
            yield from flush()
        elif m := re.match(r"(={1,6})(.+?)\1\s*$", line):
            yield from flush()
            yield Block("h", m[2])
        elif m := re.match(r"[*#:;]+(.*)", line):
            yield from flush()
            yield from _alone(page, m[1], "li")
        elif re.match(r"-{4,}\s*$", line):
            yield from flush()
        else:
            rows.append(line)
    yield from flush()


_HTML_HELD = re.compile(
    r"<!--.*?(?:-->|\Z)|<!doctype[^>]*>|<(?P<tag>pre|script|style|title|math)\b"
    r"""(?:"[^"]*"|'[^']*'|[^'">])*>(?P<body>.*?)</(?P=tag)\s*>|\\\[(?P<display>.*?)\\\]|\\\((?P<inline>.*?)\\\)|\$\$(?P<dollar>.*?)\$\$""",
    re.IGNORECASE | re.DOTALL,
)


def html_blocks(page: Page, text: str) -> Iterator[Block]:
    def held(m: re.Match[str]) -> str:
        formula = next((m[g] for g in ("display", "inline", "dollar") if m[g] is not None), None)
        if formula is not None:
            return page.hold("math", _SPACE.sub(" ", unescape(formula)).strip())
        tag = (m["tag"] or "").lower()
        if tag == "pre":
            return page.hold("code", code_text(unescape(_TAG.sub("", m["body"]))))
        return page.hold("math", _SPACE.sub(" ", unescape(_TAG.sub("", m["body"]))).strip()) if tag == "math" else ""

    yield from _html_blocks(page, _HTML_HELD.sub(held, text))


_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")


_DEFINITION = re.compile(r"""^[ ]{0,3}\[([^\[\]\n]+)\]:[ \t]*\S+(?:[ \t]+(?:"[^"\n]*"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*$\n?""", re.MULTILINE)
_TABLE_LINE = re.compile(r"[ ]{0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*")


def _indented_code(page: Page, text: str) -> str:
    """Lines indented by four behind a blank line, but not under a list item, are code."""
    if "\n    " not in text and "\n\t" not in text and not text.startswith(("    ", "\t")):
        return text
    out: list[str] = []
    code: list[str] = []
    blank, listed = True, False

    def close() -> None:
        while code and not code[-1].strip():
            code.pop()
        if code:
            out.extend(("", page.hold("code", code_text("\n".join(code))), ""))
            code.clear()

    for line in text.split("\n"):
        deep = line.startswith(("    ", "\t"))
        if code and (deep or not line.strip()):
            code.append(line[1:] if line[:1] == "\t" else line[4:])
            continue
        close()
        if not line.strip():
            blank = True
        elif deep and blank and not listed:
            code.append(line[1:] if line[0] == "\t" else line[4:])
            continue
        else:
            listed = bool(_ITEM.match(line)) or listed and (deep or not blank or line[0] == " ")
            blank = False
        out.append(line)
    close()
    return "\n".join(out)


def markdown_blocks(page: Page, text: str) -> Iterator[Block]:
    fence = re.compile(r"^[ ]{0,3}(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<body>.*?)(?:\n?^[ ]{0,3}(?P=f)[`~]*[ \t]*$|\Z)", re.MULTILINE | re.DOTALL)
    text = fence.sub(lambda m: "\n\n" + page.hold("code", code_text(m["body"])) + "\n\n", text)
    text = _indented_code(page, text)
    text = _DEFINITION.sub(lambda m: page.references.add(m[1].strip().lower()) or "", text)
    text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.DOTALL)
    text = re.sub(r"(?<!`)(`+)(?!`)((?:(?!\n[ \t]*\n).)+?)(?<!`)\1(?!`)", lambda m: page.hold("literal", m[2]), text, flags=re.DOTALL)
    text = re.sub(r"\$\$(.+?)\$\$", lambda m: page.hold("math", _SPACE.sub(" ", m[1]).strip()), text, flags=re.DOTALL)
    text = re.sub(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?)(?<=[^\s\\])\$(?![\d$])", lambda m: page.hold("math", m[1].strip()), text)
    rows: list[str] = []
    mark = "plain"

    def flush() -> Iterator[Block]:
        nonlocal mark
        if rows:
            raw = "\n".join(rows)
            rows.clear()
            yield from _alone(page, raw, mark)
        mark = "plain"

    lines = text.split("\n")
    table = False
    for i, line in enumerate(lines):
        if not line.strip():
            yield from flush()
            table = False
        elif table or not rows and "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] and _TABLE_LINE.fullmatch(lines[i + 1]):
            table = True
            if not _TABLE_LINE.fullmatch(line):
                for cell in re.split(r"(?<!\\)\|", line):
                    if cell.strip():
                        yield from _alone(page, cell.replace("\\|", "|"), "plain")
        elif m := re.match(r"[ ]{0,3}#{1,6}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", line):
            yield from flush()
            yield Block("h", m[1])
        elif rows and mark == "plain" and re.match(r"[ ]{0,3}(?:=+|-+)[ \t]*$", line):
            mark = "h"
            yield from flush()
        elif re.match(r"[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", line):
            yield from flush()
        elif m := _ITEM.match(line):
            yield from flush()
            mark = "li"
            rows.append(line[m.end() :])
        elif re.match(r"[ ]{0,3}>", line):
            rows.append(re.sub(r"^[ ]{0,3}>[ ]?", "", line))
        else:
            rows.append(line.strip() + ("\n" if line.endswith("  ") else ""))
    yield from flush()


_LATEX_HELD = re.compile(
    r"\\begin\{(?P<env>verbatim\*?|lstlisting|minted|alltt|comment)\}(?:\[[^\]]*\]|(?<=minted\})\{[^}]*\})?(?P<body>.*?)\\end\{(?P=env)\}"
    r"|\\begin\{(?P<tabular>tabular[x*]?|longtable)\}(?:\[[^\]]*\])?(?:\{(?:[^{}]|\{[^{}]*\})*\}){1,2}(?P<cells>.*?)\\end\{(?P=tabular)\}"
    r"|\\verb\*?(?P<d>[^A-Za-z\s*])(?P<verb>.*?)(?P=d)|(?P<escaped>\\[\\%$&#_{}])|%[^\n]*(?:\n[ \t]*(?=\S)|$)?"
    r"|\\begin\{(?P<math>(?:equation|align|gather|multline|displaymath|math|eqnarray)\*?)\}(?P<formula>.*?)\\end\{(?P=math)\}"
    r"|\\\[(?P<display>.*?)\\\]|\$\$(?P<dollars>.*?)\$\$|\\\((?P<inline>.*?)\\\)|\$(?P<dollar>[^$]*?)\$",
    re.DOTALL,
)
_LATEX_SYMBOLS = {"textdegree": "°", "degree": "°", "ldots": "…", "dots": "…", "textellipsis": "…", "textbackslash": "\\",
                  "textasciitilde": "~", "copyright": "©", "pounds": "£", "euro": "€", "ss": "ß", "ae": "æ", "oe": "œ", "o": "ø", "aa": "å"}
#: Commands that stand for nothing, with all their arguments.
_LATEX_SILENT = (
    "documentclass usepackage title author date maketitle tableofcontents label ref cite citep citet footnote pagestyle thispagestyle "
    "vspace hspace includegraphics caption bibliography bibliographystyle input include newcommand renewcommand setlength centering index "
    "newpage clearpage pagebreak noindent bigskip medskip smallskip"
).split()


def _latex_held(page: Page, m: re.Match[str]) -> str:
    if m["env"] is not None:
        return "" if m["env"] == "comment" else "\n\n" + page.hold("code", code_text(m["body"])) + "\n\n"
    if m["cells"] is not None:
        cells = re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b|\\cline\{[^}]*\}", "", m["cells"])
        return "\n\n" + "\n\n".join(_LATEX_HELD.sub(lambda c: _latex_held(page, c), c.strip()) for c in re.split(r"(?<!\\)&|\\\\(?:\[[^\]]*\])?", cells)) + "\n\n"
    if m["verb"] is not None:
        return page.hold("literal", m["verb"])
    if m["escaped"] is not None:
        return " " if m["escaped"] == "\\\\" else page.hold("literal", m["escaped"][1:])
    for group in ("formula", "display", "dollars"):
        if m[group] is not None:
            body = re.sub(r"\\label\{[^}]*\}", "", m[group])
            return "\n\n" + page.hold("math", _SPACE.sub(" ", body).strip()) + "\n\n"
    for group in ("inline", "dollar"):
        if m[group] is not None:
            return page.hold("math", _SPACE.sub(" ", m[group]).strip())
    return ""


def _argument(text: str, i: int) -> tuple[str, int]:
    """The {...} argument at i and the place behind it; ("", i) if there is none."""
    if text[i : i + 1] != "{":
        return "", i
    depth = 0
    for j in range(i, len(text)):
        depth += (text[j] == "{") - (text[j] == "}")
        if depth == 0:
            return text[i + 1 : j], j + 1
    return text[i + 1 :], len(text)


def latex_blocks(page: Page, text: str) -> Iterator[Block]:
    text = _LATEX_HELD.sub(lambda m: _latex_held(page, m), text)
    if (m := re.search(r"\\begin\{document\}", text)) is not None:
        text = text[m.end() :]
    text = text.split("\\end{document}")[0]
    at, mark, depth = 0, "plain", 0
    pattern = re.compile(r"\\(?:(?:sub)*section|chapter|part|paragraph|subparagraph)\*?(?:\[[^\]]*\])?(?=\{)|\\item\b(?:\[[^\]]*\])?|\\(begin|end)\{([a-zA-Z]+\*?)\}(?:\[[^\]]*\])?")
    for m in [*pattern.finditer(text), None]:
        if m is not None and m.start() < at:
            continue
        piece = text[at : m.start()] if m else text[at:]
        for k, block in enumerate(_paragraphs(piece.split("\n"), mark)):
            yield from _alone(page, block.raw, mark if k == 0 or depth else "plain")
        if m is None:
            return
        at = m.end()
        if m[1]:
            listing = m[2].rstrip("*") in ("itemize", "enumerate", "description")
            depth += listing * (1 if m[1] == "begin" else -1)
            mark = "plain" if depth <= 0 else mark
        elif m[0].startswith("\\item"):
            mark = "li"
        else:
            title, at = _argument(text, m.end())
            yield Block("h", title)
            mark = "plain"


# --- clean text ------------------------------------------------------------------------------------------------------


def _wiki_link(m: re.Match[str]) -> str:
    target, _, label = m[1].partition("|")
    label = label.rpartition("|")[2]
    if label.strip():
        return label
    if "|" in m[1]:
        return re.sub(r"^[^:]*:|\s*\([^)]*\)$", "", target)
    return target.lstrip(":")


def wiki_text(raw: str) -> str:
    text = re.sub(r"\[\[([^\[\]]*)\]\]", _wiki_link, raw)
    text = re.sub(r"\[((?:https?:|ftp:|mailto:)?//\S+|mailto:\S+?)(?:\s+([^\]\n]*))?\]", lambda m: (m[2] or "").strip() or m[1], text)
    text = re.sub(r"'{2,5}", "", text)
    return tag_text(text)


def tag_text(text: str) -> str:
    text = _BREAK.sub(" ", text) if "<" in text else text
    return unescape(_TAG.sub("", text) if "<" in text else text)


def _html_link_labels(text: str) -> str:
    return re.sub(r"""<a\b[^<>]*?href\s*=\s*["']?([^"'\s>]*)[^<>]*>\s*</a>""", lambda m: m[1], text, flags=re.IGNORECASE)


def markdown_text(page: Page, raw: str) -> str:
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: page.hold("literal", m[1]), raw)
    text = text.replace("\\\n", " ")
    text = re.sub(r"!\[[^\[\]]*\]\([^()]*\)", "", text)
    text = re.sub(r"""\[([^\[\]]*)\]\(\s*<?([^()\s<>]*(?:\([^()]*\)[^()\s]*)?)>?(?:\s+(?:"[^"]*"|'[^']*'))?\s*\)""", lambda m: m[1].strip() or m[2], text)
    if page.references:
        named = lambda m: m[1] if (m[2] or m[1]).strip().lower() in page.references else m[0]
        text = re.sub(r"\[([^\[\]]+)\](?:[ ]?\[([^\[\]]*)\])?(?!\()", named, text)
    text = re.sub(r"<((?:https?|ftp|mailto):[^<>\s]+)>", lambda m: page.hold("literal", m[1]), text)
    before = None
    while before != text:
        before = text
        text = re.sub(r"(?<!\*)(\*{1,3})(?=[^\s*])((?:[^*]|(?<=\s)\*(?=\s))*?[^\s*])\1(?!\*)", r"\2", text)
        text = re.sub(r"(?<![\w_])(_{1,3})(?=[^\s_])((?:[^_]|(?<=\w)_(?=\w))*?[^\s_])\1(?![\w_])", r"\2", text)
        text = re.sub(r"~~(?=\S)(.*?\S)~~", r"\1", text)
    return tag_text(text)


def latex_text(raw: str) -> str:
    out, i = [], 0
    for m in iter(lambda: re.compile(r"\\([A-Za-z]+)\*?|\\(.)|[{}~]|---?|``|''", re.DOTALL).search(raw, i), None):
        out.append(raw[i : m.start()])
        i = m.end()
        name = m[1]
        if name is None:
            accent = m[2]
            if accent and accent in "'`^\"~c" and raw[i : i + 1].isalpha():
                continue
            out.append({"~": " ", "---": "—", "--": "–", "``": "“", "''": "”"}.get(m[0], " " if accent and accent.isspace() else ""))
        elif name == "href":
            target, i = _argument(raw, i)
            label, i = _argument(raw, i)
            out.append(latex_text(label) if label.strip() else target)
        elif name == "url":
            target, i = _argument(raw, i)
            out.append(target)
        elif name in _LATEX_SYMBOLS:
            if raw[i : i + 2] == "{}":
                i += 2
            elif raw[i : i + 1] == " ":
                i += 1
            out.append(_LATEX_SYMBOLS[name])
        elif name in _LATEX_SILENT:
            while raw[i : i + 1] in ("{", "["):
                i = _argument(raw, i)[1] if raw[i] == "{" else raw.find("]", i) + 1 or len(raw)
        elif name in ("newline", "linebreak", "quad", "qquad", "par"):
            out.append(" ")
        elif raw[i : i + 1] == " ":
            i += 1
    out.append(raw[i:])
    return "".join(out)


_CLEANERS = {
    "wiki": lambda page, raw: wiki_text(raw), "html": lambda page, raw: tag_text(_html_link_labels(raw)),
    "latex": lambda page, raw: latex_text(raw), "markdown": markdown_text,
}


def clean(page: Page, kind: str, raw: str) -> str:
    """The text of a block without its markup, with held pieces as references."""
    return _CLEANERS[kind](page, raw)


def final(page: Page, text: str) -> str:
    return _SPACE.sub(" ", page.restore(text)).strip()


# --- classification --------------------------------------------------------------------------------------------------

_MARKS = ("h", "li", "code")
_LINKS = re.compile(r"\[\[[^\]]*\]\]|\[https?:[^\]]*\]|\]\([^)]*\)|\]\[[^\]]*\]|<a\b|\\href\{", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
FEATURES = (*_MARKS, "formula", "words", "links", "bars", "words before", "links before", "bars before", "words after", "links after", "bars after")


def features(page: Page, kind: str, blocks: list[Block], texts: list[str] | None = None) -> list[list[float]]:
    """The opening mark of each block, its share of formula, and word count, link density (links to words) and the bars
    that part its links (words without a letter or digit, to links) of it and its neighbours. ``texts`` are the clean texts of the blocks."""
    own = []
    for b, text in zip(blocks, texts or [clean(page, kind, b.raw) for b in blocks]):
        held = [page.held[int(m[1])] for m in _HOLD.finditer(text)]
        bare = _HOLD.sub(lambda m: "" if page.held[int(m[1])][0] == "math" else page.held[int(m[1])][1], text)
        words = len(bare.split())
        links = len(_LINKS.findall(b.raw))
        formulas = sum(piece[0] == "math" for piece in held)
        density = links / (len(_WORD.findall(bare)) + 1) if links else 0.0
        bars = sum(not _WORD.search(w) for w in bare.split()) / (links + 1) if links > 1 else 0.0
        own.append((float(words), density, bars, formulas / (words + formulas) if formulas else 0.0, [float(b.mark == m) for m in _MARKS]))
    none = (0.0, 0.0, 0.0, 0.0, [])
    rows = []
    for i, (words, links, bars, formula, marks) in enumerate(own):
        before, after = own[i - 1] if i else none, own[i + 1] if i + 1 < len(own) else none
        rows.append([*marks, formula, words, links, bars, *before[:3], *after[:3]])
    return rows


def _contrasts() -> Iterator[tuple[str, str, list[str]]]:
    """Pages with rows of links in changing places and sizes: only rows parted by bars are for navigation, and only a short
    last line behind one closes a page."""
    words = "stir the warm oats with milk and honey until they are soft".split()
    for n in (2, 3, 4, 6):
        links = [f"[[{w}]]" for w in words[:n]]
        bar, row = f" {'|/·•'[n % 4]} ".join(links), " ".join(links)
        for size in (1, 2, 3, 5, 8, 12):
            line = " ".join(words[:size])
            short = size <= 3
            if n > 2:
                yield "wiki", f"{bar}\n\n{line}\n\nMore of it\n\n* {row}\n\n{line}", ["", "para", "para", "item", "para"]
                yield "wiki", f"{line}\n\n{bar}\n\n{line}", ["para", "", "" if short else "para"]
                yield "wiki", f"A line\n\n{line}\n\n{bar}", ["para", "para", ""]
            yield "wiki", f"{row}\n\n{line}\n\n{' '.join(words)} {bar}\n\n{line}", ["para", "para", "para", "para"]


_SPLITTERS = {"wiki": wiki_blocks, "html": html_blocks, "markdown": markdown_blocks, "latex": latex_blocks}

#: The labelled table: flat blocks of small pages in each language with what they are ("" for blocks to leave out).
LABELLED: list[tuple[str, str, list[str]]] = [
    ("wiki", "{{note}}\n== Soup ==\n\nA [[good]] soup needs time.\n\n* [[Leek]]\n* 2 carrots and salt\n\n<math>a = b</math>\n\n<pre>\nstir()\n</pre>", ["heading", "para", "item", "item", "formula", "code"]),
    ("wiki", "===[[Book:X|Steps]]===\n# Boil <math>x^2</math> cups\n# Serve\n<ul>\n<li>Salt</li>\n<li><b>Oil</b> of any kind</li>\n</ul>\n\n[[Stock]]\n\n<math display=\"block\">\\frac{a}{b}</math>\n\n{{end}}\n\n<br>", ["heading", "item", "item", "item", "item", "para", "formula", ""]),
    ("wiki", "Text with <math>e</math> inside it.\n\n<syntaxhighlight>\nx = 1\n</syntaxhighlight>\n== End ==\n''Fine''\n\n''''\n\n<span></span>", ["para", "code", "heading", "para", "", ""]),
    ("html", "<html><body><h1>Stew</h1><p>Cook it <a href='u'>slowly</a>.</p><ul><li>Beans</li><li></li></ul><p>\\[a + b\\]</p><pre><code>go</code></pre><p>&nbsp;</p></body></html>", ["heading", "para", "item", "formula", "code", ""]),
    ("html", "<div><h2></h2><ol><li><a href='u'>One</a></li></ol>Loose words<p>\\(x\\) is here</p><h3>Last part of it</h3><p><a href='u'>Link</a></p></div>", ["item", "para", "para", "heading", "para"]),
    ("markdown", "# Pie\n\nCut the *fat* in.\n\n- flour\n- [butter](u)\n\n1. mix\n2. rest\n\n$$x = y$$\n\n```\nbake()\n```\n\n![photo](p.png)\n\nSteps\n-----\n\nUse $k$ eggs.", ["heading", "para", "item", "item", "item", "item", "formula", "code", "", "heading", "para"]),
    ("markdown", "A first line\nand its second line\n\n## Notes\n* one\n* `two`\n\n[Only](u)\n\n$$\\frac{a}{b}$$", ["para", "heading", "item", "item", "para", "formula"]),
    ("latex", "\\documentclass{article}\n\\begin{document}\n\\section{Bread}\n\nMix \\emph{well} and wait.\n\n\\begin{itemize}\n\\item flour\n\\item \\href{u}{water}\n\\end{itemize}\n\n\\begin{equation}\na = b\n\\end{equation}\n\n\\begin{verbatim}\nfold()\n\\end{verbatim}\n\n\\label{x}\n\nAdd $n$ spoons.\n\\end{document}", ["heading", "para", "item", "item", "formula", "code", "", "para"]),
    ("latex", "\\begin{document}\n\\subsection{Rest of the day}\n\\begin{enumerate}\n\\item Let it $x$ stand\n\\end{enumerate}\n\n\\[ y^2 \\]\n\n\\href{u}{Source}\n\\end{document}", ["heading", "item", "formula", "para"]),
    ("wiki", "[[Home]] | [[Recipes]] | [[Index]]\n\n== Oats ==\n\nSoak them.\n\nThen cook them slowly in milk.\n\n[[Milk]]\n\n[[Terms]] · [[Privacy]] · [[Contact]]\n\nPage last checked", ["", "heading", "para", "para", "para", "", ""]),
    ("wiki", "[[Soups]] / [[Stews]] / [[Roasts]] / [[Salads]]\n\nStir well.\n\n* [[Leek]]\n* [[Oil]]\n* [[Salt]]\n\nGood\n\n[[Salt]] and [[oil]] go in at the end.\n\n[[Back]] | [[Next]] | [[Up]]\n\nMade by cooks", ["", "para", "item", "item", "item", "para", "para", "", ""]),
    ("html", "<body><div><a href='u'>Home</a> | <a href='u'>Search</a> | <a href='u'>Help</a></div><h1>Rye</h1><p>Short one.</p><p>Knead it for a while and wait.</p><p><a href='u'>Flour</a></p><div><a href='u'>Terms</a> · <a href='u'>Privacy</a> · <a href='u'>Press</a></div><div>All rights kept</div></body>", ["", "heading", "para", "para", "para", "", ""]),
    ("wiki", "[[Mix]] [[oats]] [[with]] [[milk]]\n\nSalt | pepper | oil\n\nStir [[salt]] - or [[oil]] - in at the very end.\n\n[[Rest]] [[it]] [[well]]\n\nEat warm", ["para", "para", "para", "para", "para"]),
    ("markdown", "Salt | pepper | oil\n\n[Mix](u) [it](u) [well](u)\n\nLet it rest\n\nUse [rye](u) | [oats](u) | [corn](u) as you please, all of them soaked well.\n\nServe it", ["para", "para", "para", "para", "para"]),
    ("html", "<body><p><a href='u'>Peel</a> <a href='u'>all</a> <a href='u'>pears</a></p><p>Keep cool</p><p>- * - 5 - *</p><p>Done now</p></body>", ["para", "para", "para", "para"]),
    ("latex", "\\begin{document}\n\\href{u}{Boil} \\href{u}{the} \\href{u}{eggs}\n\nThen peel\n\nOne | two | three\n\nThe end\n\\end{document}", ["para", "para", "para", "para"]),
    ("html", "<body><p>First line.</p><p>Use <a href='u'>rye</a> or <a href='u'>wheat</a> of your choice here.</p><p>The end</p></body>", ["para", "para", "para"]),
    ("markdown", "[Home](u) | [Search](u) | [Help](u)\n\n# Figs\n\nPeel them.\n\nHalve them with a small knife.\n\n[Honey](u)\n\n[Terms](u) | [Privacy](u) | [Press](u)\n\nBuilt by hand", ["", "heading", "para", "para", "para", "", ""]),
    ("latex", "\\begin{document}\n\\href{u}{Home} | \\href{u}{Search} | \\href{u}{Help}\n\n\\section{Plums}\n\nStone them.\n\nSimmer them until they are soft.\n\n\\href{u}{Sugar}\n\n\\href{u}{Terms} | \\href{u}{Privacy} | \\href{u}{Press}\n\nSet by hand\n\\end{document}", ["", "heading", "para", "para", "para", "", ""]),
    *_contrasts(),
]


@lru_cache(maxsize=1)
def classifier() -> Node:
    """The tree trained on ``LABELLED`` (a few dozen rows)."""
    rows, labels = [], []
    for kind, text, wanted in LABELLED:
        page = Page()
        blocks = list(_SPLITTERS[kind](page, text))
        if len(blocks) != len(wanted):
            raise ValueError(f"{len(blocks)} blocks, {len(wanted)} labels: {[b.raw for b in blocks]}")
        rows += features(page, kind, blocks)
        labels += wanted
    return train(rows, labels)


def page_blocks(text: str | None, tree: Node | None = None) -> list[tuple[str, str]]:
    """(kind, block_text) of the blocks of a page in their order; none for redirects, null, empty and blank texts."""
    if not text or not text.strip() or re.match(r"\s*#\s*redirect\b", text, re.IGNORECASE):
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(_OPEN, "").replace(_CLOSE, "")
    kind, page = language(text), Page()
    blocks = list(_SPLITTERS[kind](page, text))
    tree = tree or classifier()
    out = []
    texts = [clean(page, kind, block.raw) for block in blocks]
    for block, text, row in zip(blocks, texts, features(page, kind, blocks, texts)):
        label = tree.predict(row)
        if not label:
            continue
        content = page.restore(block.raw).strip() if label == "code" else final(page, text)
        if content:
            out.append((label, content))
    return out


def blocks(df: DataFrame) -> DataFrame:
    """page_id, revision_id, block_no, kind, block_text of the page revisions of ``df``.

    Rows repeated exactly are read once. Whole texts are parsed, each in one task, whatever their length; pages without
    blocks give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = classifier()
        for batch in batches:
            owner, number, kinds, texts = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                for k, (kind, content) in enumerate(page_blocks(text.as_py(), tree)):
                    owner.append(i)
                    number.append(k)
                    kinds.append(kind)
                    texts.append(content)
            rows = batch.select([0, 1]).take(pa.array(owner, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(number, pa.int32()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())],
                names=["page_id", "revision_id", "block_no", "kind", "block_text"],
            )

    pages = df.select("page_id", "revision_id", "wikitext").where(F.col("wikitext").isNotNull()).distinct()
    return pages.mapInArrow(run, "page_id long, revision_id long, block_no int, kind string, block_text string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, revision_id, block_no, kind, block_text of every page revision."""
    return blocks(read_table(spark, sf_dir, "pages"))
