"""Splitting one string that holds several values, guided by a dictionary of known values.

The unit of work is one string; the Spark side is ``wicker.operators.packed_values``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

import ahocorasick

#: Marks that set names apart in a field of names.
NAME_MARKS = frozenset("|;\t\n\r,/•·")
#: Marks that set ingredients apart in a free line; the comma is decided by ``split_line``.
LINE_MARKS = frozenset("|;\t\n\r•·")

_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}
_NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|half|quarter|dozen"
_OWN_AMOUNT = re.compile(
    rf"\s*(?:about|approx\.?|around|ca\.?|~)?\s*(?:[.,]?\d|[½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞]|(?:{_NUMBER_WORDS})\b"
    r"|an?\s+(?:pinch|handful|dash|cup|dozen|half|quarter|few|couple|little|bunch|clove|stick|slice)\b)",
    re.IGNORECASE,
)


class FoundValues:
    """Known values already found in one text: their (start, stop) by stop, and the kinds of thing it names."""

    def __init__(self, spans: Iterable[tuple[int, int]] = (), heads: Iterable[str] = ()):
        self.found = list(spans)
        self.heads = set(heads)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.found

    def cover(self, text: str) -> list[tuple[int, int]]:
        """The non-overlapping known values that cover the most characters."""
        best: list[tuple[int, int]] = [(0, 0)]  # (covered characters, -values) up to each match end
        chosen: list[tuple[int, tuple[int, int] | None]] = [(0, None)]
        ends = [0]
        for start, stop in self.spans(text):
            if stop > ends[-1]:
                ends.append(stop)
                best.append(best[-1])
                chosen.append((len(ends) - 2, None))
            j = bisect_right(ends, start) - 1
            option = (best[j][0] + stop - start, best[j][1] - 1)
            if option > best[-1]:
                best[-1], chosen[-1] = option, (j, (start, stop))
        out, i = [], len(ends) - 1
        while i > 0:
            i, span = chosen[i]
            if span:
                out.append(span)
        return out[::-1]


class ValueDictionary(FoundValues):
    """Known whole values in a multi-pattern automaton.

    ``cover`` picks, by dynamic programming over the match ends, the set of non-overlapping whole-word matches that
    covers the most characters (fewest values on a tie). ``heads`` are the last words of values of several words: the kinds
    of thing that are named.
    """

    def __init__(self, values: Iterable[str]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for value in values:
            key = value.strip().lower()
            if not key:
                continue
            self.automaton.add_word(key, len(key))
            head = re.findall(r"[^\W\d_]+", key)
            if len(head) > 1 and "," not in key:
                self.heads.add(head[-1])
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, stop) of every whole-word occurrence of a known value, by stop."""
        if self.empty:
            return []
        low = text.lower()
        if len(low) != len(text):  # a character whose lower form is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = []
        for end, length in self.automaton.iter(low):
            start, stop = end - length + 1, end + 1
            if not (start and low[start - 1].isalnum() or stop < len(low) and low[stop].isalnum()):
                out.append((start, stop))
        return out

    def kinds(self, text: str) -> list[str]:
        return sorted({w for w in re.findall(r"[^\W_]+", text.lower()) if w in self.heads})


def protected(text: str) -> bytearray:
    """1 for every character inside (and including) quotes or round brackets.

    A quote opens only at the start or after a blank, a mark or a bracket, and a doubled quote inside quotes is a
    character of the value. A quote or bracket that is never closed protects nothing.
    """
    mask = bytearray(len(text))
    i, n = 0, len(text)
    brackets: list[int] = []
    while i < n:
        c = text[i]
        close = _QUOTES.get(c)
        if close and (i == 0 or not text[i - 1].isalnum()):
            j = i + 1
            while j < n:
                if text[j] == close:
                    if close == '"' and j + 1 < n and text[j + 1] == '"':
                        j += 2
                        continue
                    break
                j += 1
            if j < n:
                mask[i : j + 1] = b"\x01" * (j + 1 - i)
                i = j + 1
                continue
        elif c == "(":
            brackets.append(i)
        elif c == ")" and brackets:
            start = brackets.pop()
            mask[start : i + 1] = b"\x01" * (i + 1 - start)
        i += 1
    return mask


def clean(piece: str) -> str:
    """Trim; take quotes around the whole value off and make doubled quotes inside single."""
    piece = piece.strip()
    if len(piece) >= 2 and piece[0] == '"' and piece[-1] == '"':
        inner = piece[1:-1]
        if not inner.replace('""', "").count('"'):
            return inner.replace('""', '"').strip()
    elif len(piece) >= 2 and piece[0] in "“„«" and piece[-1] == _QUOTES[piece[0]] and piece.count(piece[-1]) == 1:
        return piece[1:-1].strip()
    return piece


def _cut(text: str, at: list[int]) -> list[str]:
    edges = [-1, *at, len(text)]
    return [text[a + 1 : b] for a, b in zip(edges, edges[1:])]


def _values(pieces: Iterable[str]) -> list[str]:
    return [v for v in map(clean, pieces) if v]


def split_names(text: str | None, known: FoundValues | None = None) -> list[str]:
    """The names of a field of names.

    A dynamic program chooses the boundaries among the marks outside quotes and brackets: a name may hold a mark only if it
    is a known value as a whole, and of all ways to cut the one that covers the most characters with known values is taken,
    then the one with most names. Without a dictionary every such mark is a boundary.
    """
    if not text:
        return []
    if not any(c in NAME_MARKS for c in text):
        return _values([text])
    mask = protected(text)
    marks = [i for i, c in enumerate(text) if c in NAME_MARKS and not mask[i]]
    spans: dict[int, list[int]] = {}
    for start, stop in known.spans(text) if known else ():
        spans.setdefault(start, []).append(stop)
    edges = [-1, *marks, len(text)]
    best: list[tuple[int, int, int]] = [(0, 0, -1)] + [(-1, 0, -1)] * (len(edges) - 1)  # covered characters, names, last edge
    for a in range(len(edges) - 1):
        covered, names, _ = best[a]
        first = edges[a] + 1
        while first < edges[a + 1] and text[first].isspace():
            first += 1
        reach = {a + 1: 0}
        for stop in spans.get(first, ()):
            b = bisect_right(edges, stop - 1)
            if b < len(edges) and not text[stop : edges[b]].strip():
                reach[b] = max(reach.get(b, 0), stop - first)
        for b, gain in reach.items():
            option = (covered + gain, names + 1, a)
            if option[:2] > best[b][:2]:
                best[b] = option
    cuts, at = [], len(edges) - 1
    while at > 0:
        at = best[at][2]
        if at > 0:
            cuts.append(edges[at])
    return _values(_cut(text, cuts[::-1]))


_AMOUNT, _NAMED = range(2)
_TOKEN = re.compile(r"[^\W_]+|.", re.DOTALL)


def _comma_cuts(text: str, mask: bytearray, spans: dict[int, list[int]], heads: set[str]) -> list[int] | None:
    """The commas that set ingredients apart, or None if the line is no list.

    A path reads the line as known values, fillers and boundaries. Every comma outside quotes, brackets and numbers is
    either inside a known value on the path or a boundary, and a boundary needs a piece that opened with its own amount and
    has named an ingredient: by a known value or by the last word of one. The path that covers the most characters with
    known values wins, then the one with fewest values.
    """
    n = len(text)
    # at each place two readings: an amount and no name yet, or a name as well; (covered, -values, place and reading before)
    best: dict[tuple[int, int], tuple[int, int, tuple[int, int] | None]] = {}

    def reach(to: tuple[int, int], covered: int, values: int, before: tuple[int, int] | None) -> None:
        if to not in best or best[to][:2] < (covered, values):
            best[to] = (covered, values, before)

    if not _OWN_AMOUNT.match(text):
        return None
    reach((0, _AMOUNT), 0, 0, None)
    for token in _TOKEN.finditer(text):
        at, end = token.span()
        for state in (_AMOUNT, _NAMED):
            here = best.get((at, state))
            if here is None:
                continue
            covered, values, _ = here
            for stop in spans.get(at, ()):
                reach((stop, _NAMED), covered + stop - at, values - 1, (at, state))
            digits = text[at - 1 : at].isdigit() and text[end : end + 1].isdigit()
            if text[at] == "," and not mask[at] and not digits:
                if state == _NAMED and _OWN_AMOUNT.match(text, end):
                    reach((end, _AMOUNT), covered, values, (at, state))
            else:
                kind = token[0].lower() in heads
                reach((end, _NAMED if kind else state), covered, values, (at, state))
    at = (n, _NAMED)
    if at not in best:
        return None
    cuts = []
    while (before := best[at][2]) is not None:
        if before[1] == _NAMED and at[1] == _AMOUNT:
            cuts.append(before[0])
        at = before
    return cuts[::-1]


def split_line(text: str | None, known: FoundValues) -> list[str]:
    """The ingredients of a free line, cut by the best cover with known values, fillers and boundaries.

    A mark of ``LINE_MARKS`` outside quotes and brackets is a boundary unless the cover puts it inside a known value. A comma
    is one only in a line without such a mark, and only if every piece starts with its own amount and names an ingredient;
    commas inside a known value, between digits (decimal commas), in quotes and in brackets never count.
    """
    if not text:
        return []
    hard = [i for i, c in enumerate(text) if c in LINE_MARKS]
    if not hard and "," not in text:  # nothing to choose
        return _values([text])
    mask = protected(text)
    hard = [i for i in hard if not mask[i]]
    if hard:
        inside = iter([*known.cover(text), (len(text), len(text))])
        a, b = next(inside)
        cuts = []
        for i in hard:
            while b <= i:
                a, b = next(inside)
            if not a < i:
                cuts.append(i)
        if cuts:
            return _values(_cut(text, cuts))
    spans: dict[int, list[int]] = {}
    for start, stop in known.spans(text):
        spans.setdefault(start, []).append(stop)
    return _values(_cut(text, _comma_cuts(text, mask, spans, known.heads) or []))
