"""Sentence boundaries across languages and scripts: a hidden-event n-gram model.

Between the tokens of a text stands a hidden event, a boundary (S) or none (N). Where the annotated text (``SEED``) never shows a
boundary, between words without a mark, its probability is zero, so events are looked for behind end marks with their
closing quotes and brackets, and at blanks in scripts that part sentences by blanks. There the model multiplies the
probability of an event after its left context (the word with its mark, whether it stands alone since the event before,
and that event) with that of the token that follows; both are counted on the annotated text and smoothed by backing off to
shorter contexts. Posteriors from a forward-backward pass over each paragraph decide the boundaries.

The corpus adds what the annotated text can't know: a point before a lower-case word is an unambiguous label, so pointed words
that mostly stand so are counted as abbreviations; short capitalised words that also stand without a point are
names or words, others that open a sentence may be titles; capitalised words that also occur in lower case open sentences.

Blank lines always end a sentence, single line breaks are blanks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.session import read_table, written

#: The annotated text the model is counted on: ‖ marks a boundary, every other place is none. One paragraph per line.
SEED = """
The soup was hot. ‖ We ate it at once. ‖ Nobody spoke! ‖ Was it good? ‖ Yes, it was. ‖ The bread rose in 40 minutes. ‖ It smelled fine.
Anna cut the onion. ‖ "Is the rice done?" asked Tom. ‖ (Keep the lid on.) ‖ Stir it well. ‖ He said, "Never wash the pan." ‖ Nobody argued.
Mr. Hall met Mrs. Page and Dr. Stone in St. Ives. ‖ Prof. Lane, Ph.D., wrote in Jan. 1920 and in Sept. 1931. ‖ Ms. Reed left on Dec. 5 or Feb. 6.
J. K. Marsh and M. Cole met A. B. Dunn. ‖ T. Ford wrote to R. Ames in the U.S. and the U.K. market. ‖ D. Price waited.
Add 2.5 cups of milk, approx. 90 g, i.e. a bowl. ‖ See p. 12 of vol. 3. ‖ The chart (see fig. 7) is on pp. 4 to 9. ‖ It ends with ch. 8. ‖ Look at vol. 2. ‖ See no. 4.
Bring salt, oil, etc. ‖ Leave the rest. ‖ Apples, pears, etc. are sold. ‖ Bring plates, cups, etc. ‖ The guests eat with forks, etc. and spoons.
Use .5 oz. or 3.4 tbsp. of oil, 2 tsp. of salt and 1 lb. of flour. ‖ We bought 3 lb. of rice. ‖ It took 9 oz. ‖ Then we left. ‖ It needs 2 tbsp. ‖ Stir it. ‖ He had 4 lb. ‖ She had none.
Cook it for 20 min. ‖ The rice should rest. ‖ Wait 5 min. or so. ‖ Bake it 30 min. ‖ Let it cool. ‖ It takes 2 hr. ‖ Then eat. ‖ It ran 3 sec. and stopped.
At 6 a.m. Mrs. Page lit the stove. ‖ We ate at 7 p.m. ‖ Nobody left early. ‖ At 9 a.m. Dr. Stone came. ‖ We slept at 11 p.m. ‖ The night was cold. ‖ At 5 p.m. he left. ‖ He rose at 4 a.m. ‖ The sun was up.
It came from Reed & Sons Ltd. in the town and from Hill Inc. of York. ‖ Smith Co. makes pans. ‖ He works for Gray Ltd. ‖ They sell tea. ‖ She left Brown Inc. ‖ It failed.
Mix tea vs. milk, e.g. for a cake. ‖ No. 5 on the list was rice, no. 6 was oil. ‖ Did he stay? ‖ No. ‖ He left. ‖ It was No. 7. ‖ The list was long.
The file notes.v2.txt and www.Home.example/a.html hold 3.1 kg. ‖ See www.Page.example for more. ‖ Version 2.10 of it is out. ‖ It is on www.Pans.example. ‖ Look there.
Wait... then stir it. ‖ Well... it was fine. ‖ He paused... ‖ Then he spoke. ‖ And so… on it went. ‖ It stopped… ‖ Nobody knew why. ‖ Hm... maybe.
The pot (it was new!) broke. ‖ Really?! ‖ Yes, it did. ‖ What?! ‖ No! ‖ The pan (was it old?) held. ‖ "Stop!" he said. ‖ "Why?" she asked. ‖ "Go!" ‖ They went. ‖ "Now?" ‖ Tom nodded.
1. Peel the pears. ‖ 2. Cut them. ‖ 3. Boil the syrup. ‖ 10. Serve it. ‖ Then rest. ‖ 4. Next, wash up. ‖ It is in batches of 8. ‖ 5. Dry the pan.
12. Whisk the eggs. ‖ There were 5 of 9. ‖ It was in 1962. ‖ The year was 1871. ‖ They cooked 33. ‖ (See the note.) ‖ They had 12. ‖ "Is it done?" asked Tom. ‖ 7. Stir it.
The cook left.‖The guests ate.‖Then it rained. ‖ It was in batches of 6.‖We waited.‖ He laughed!‖She did not. ‖ Was it so?‖Yes. ‖ They ate at 8 p.m.‖Nobody spoke. ‖ It ended.‖"Why?" he asked. ‖ Done.‖(See below.)
It was late. ‖ 5 guests came. ‖ We sat down. ‖ 12 plates broke! ‖ 3 cups held. ‖ Was it bad? ‖ 20 spoons fell. ‖ The bill came (see below). ‖ It was high (see fig. 2). ‖ We paid.
Man braucht z. B. 2 kg Mehl, d. h. viel, u. a. Salz. ‖ Das Brot ca. 50 Min. backen. ‖ Nr. 3 im Heft von Dr. Maier nennt Salz usw. als Beilage. ‖ Es gibt Reis usw. ‖ Danach ruhen.
Am 3. Tag ist es gut. ‖ Am 12. Mai kam er. ‖ Vom 4. Juni bis zum 9. Juli war er da. ‖ Im 2. Jahr schmeckt es. ‖ Der 1. Gang war Suppe. ‖ Am 5. Abend ging sie. ‖ Ist es gut? ‖ „Nicht jetzt!“, rief Frau Kurz. ‖ Fertig! ‖ „Warum?“, fragte er. ‖ „Gut.“ ‖ Er ging. ‖ Etwa ca. 3 Std. warten. ‖ Es dauert 20 Min. ‖ Dann essen.
M. Petit et Mme Grand sont venus. ‖ M. Leroy préfère le thé. ‖ Laissez reposer, p. ex. une nuit. ‖ Ajoutez env. 20 g de sel. ‖ « Ne touchez pas ! » dit Paul. ‖ C'est prêt ! ‖ Est-ce cuit ? ‖ « Qui est là ? » demanda Luc. ‖ Il faut 1,5 litres d'eau. ‖ « Bien. » ‖ Il part.
El Dr. Ruiz y la Sra. Vega usan sal. ‖ El Sr. Gil come. ‖ La Srta. Paz bebe. ‖ La Dra. Sol lee. ‖ Añade sal, p. ej. con agua. ‖ «Basta», dijo Ana. ‖ ¿Está listo? ‖ ¡No! ‖ Usa 2,5 kg. ‖ «Ya está.» ‖ Se fue. ‖ Come desde 1950. ‖ ¿Por qué? ‖ Bebe agua. ‖ ¡Ven! ‖ Sal. ‖ «No», dijo. ‖ Fin desde 1901. ‖ «Vale», dijo.
В 1950 г. Иван записал рецепт. ‖ Добавьте 5 г соли и т. д. в миску. ‖ Варите ок. 3 мин. на огне. ‖ «Стойте!» — сказала Анна. ‖ Готово ли? ‖ Берите соль и т. п. из шкафа. ‖ Он жил в 1901 г. в доме. ‖ В 1920 г. Анна ушла. ‖ «Где?» — спросил он. ‖ «Хорошо». ‖ Он ушёл. ‖ Ждите 5 мин. ‖ Затем ешьте. ‖ На ул. Мира был дом, т. е. дача.
Βράστε 5 λεπτά, π.χ. σε νερό. ‖ Είναι έτοιμο; ‖ Σερβίρετε ζεστό! ‖ Βάλτε 2,5 κιλά. ‖ Πού είναι; ‖ Ο κ. Νίκος ήρθε.
डॉ. मीरा ने कहा। ‖ पानी उबल गया? ‖ 5 ग्राम नमक डालें। ‖ आटा 2.5 घंटे रखें। ‖ गरम परोसें! ‖ डॉ. राम आए। ‖ 20 लोग थे। ‖ क्या हुआ? ‖ श्री. लाल गए। ‖ डॉ. सीता बोलीं।
أضف 5 غرام من الملح. ‖ هل غلى الماء؟ ‖ قدّمه ساخنا! ‖ اتركه 2.5 ساعة. ‖ ثم قسّمه. ‖ 7 ضيوف جاؤوا. ‖ هل تأكل؟ ‖ نعم.
آہستہ ہلائیں۔ ‖ کیا آٹا تیار ہے؟ ‖ 5 گرام نمک ڈالیں۔ ‖ پانی گرم ہے۔ ‖ کیوں؟ ‖ ہاں۔
ውሃውን አፍላ። ‖ ጨው ጨምር። ‖ ተዘጋጅቷል? ‖ 5 ደቂቃ ጠብቅ። ‖ ጥሩ ነው።
鍋に水を入れます。‖塩は3.5gで十分です。‖「混ぜないで！」と父は言った。‖できましたか？‖はい！‖「いいえ。」と答えた。‖5人が来た。‖「なぜ？」と聞いた。‖「はい」と言った。‖雨です。 ‖ 寒い！ ‖ 「待って！」と叫んだ。
水开了吗？‖他说：“别急！”然后走了。‖真香！‖加热到3.5度。‖面团要静置5分钟；再分开。‖她问：“为什么？”他没有回答。‖“好。”她说。‖5个人来了。‖下雨了。 ‖ 天冷！ ‖ “等等！”他喊道。
ទឹកពុះ។ ‖ ដាក់អំបិល។ ‖ ឆ្អិនឬនៅ? ‖ បាទ។
ရေဆူပြီ။ ‖ ဆားထည့်ပါ။ ‖ ကျက်ပြီလား? ‖ ဟုတ်ကဲ့။
ཆུ་ཁོལ་སོང་། ‖ ཚྭ་བླུགས། ‖ ཁ་ལག་ཟ།
ต้มน้ำ ‖ ใส่เกลือ5กรัม ‖ คนช้าๆ ‖ พักแป้ง ‖ เสิร์ฟตอนร้อน
물을 끓인다. ‖ 소금을 넣는다. ‖ 다 됐나요? ‖ 네! ‖ 5명이 왔다. ‖ 비가 온다.
"""

_ENDS = ".!?…。！？｡．؟۔।॥།။។։።፧;\u037e"
_CLOSERS = "\"'”’“»)]」』】）›"
#: Scripts written without blanks between words: Thai, Lao, Myanmar, Khmer.
_JOINED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_CANDIDATE = re.compile(rf"[{_ENDS}]+|(?<=[{_JOINED}])[ \t ]+(?=[{_JOINED}])")
_GREEK = re.compile("[\u0370-\u03ff\u1f00-\u1fff]")
_BLANK_LINE = re.compile(r"(?:\r\n|\r(?!\n)|(?<!\r)\n)[^\S\r\n]*(?:\r\n|\r(?!\n)|(?<!\r)\n)\s*")
_BEFORE_WORD = "([{\"'“„«‘¿¡「『（【"
_HOST = re.compile(
    r"(?:https?://|www\.)[^\s<>\"']*[\w/]|[\w.-]*\w/[\w./]*|(?:[\w-]+\.)+(?:txt|html?|md|csv|json|pdf|py|xml|jpg|png|com|org|net|invalid|example)\b",
    re.IGNORECASE,
)
_SPACE = re.compile(r"\s")
_OPENERS = "\"“„«‘([{¿¡「『（【‹'"
#: Longest capitalised word that may be a title.
TITLE_LENGTH = 5
#: Words rarer than this part of the corpus (one in so many), or longer, are not learned from it.
SHARE = 100_000
SHARE_LENGTH = 40
#: How many annotated places the label of a learned abbreviation counts for.
LEARNED_WEIGHT = 4
Context = tuple[str, str, str]


class Lexicon:
    """What is known of words: abbreviations, words that make a number behind them an ordinal, words that stand without a
    point, and words that occur in lower case."""

    def __init__(self, known: Iterable[str] = (), plain: Iterable[str] = (), common: Iterable[str] = ()):
        self.known = frozenset(w for w in known if not w.startswith("#"))
        self.before = frozenset(w[1:] for w in known if w.startswith("#"))
        self.plain, self.common = frozenset(plain), frozenset(common)
        self.longest = max(map(len, self.known), default=0)
        self.longest_before = max(map(len, self.before), default=0)

    def maybe_title(self, word: str) -> bool:
        return 2 <= len(word) <= TITLE_LENGTH and word.istitle() and word.isalpha() and word.lower() not in self.plain


def _closing(text: str, at: int, quotes: int, german: bool) -> tuple[int, bool]:
    """The end of the closing quotes and brackets at ``at``, and whether a straight quote was closed.

    ``quotes`` counts the straight quotes before; one that follows an even number opens, unless a blank stands behind it.
    “ closes only where „ opens."""
    i, straight = at, False
    while i < len(text):
        c = text[i]
        if c in _CLOSERS:
            if c == '"':
                if quotes % 2 == 0 and text[i + 1 : i + 2].strip():
                    break
                quotes, straight = quotes + 1, True
            elif c == "“" and not german or c == "'" and text[i + 1 : i + 2].isalnum():
                break
            i += 1
        elif c in "   " and text[i + 1 : i + 2] == "»":
            i += 2
        else:
            break
    return i, straight


def _right(text: str, at: int, words: Lexicon) -> tuple[str, int]:
    """The class of the token that follows, and where it starts."""
    i, n = at, len(text)
    while i < n and text[i].isspace():
        i += 1
    if i == n:
        return "END", i
    gap = "" if i > at else "-"
    c = text[i]
    if c.isalpha():
        if c.isupper():
            word = text[i : i + words.longest + 2].split(maxsplit=1)[0]  # a longer token is none of the known words
            if gap:
                return ("-U" if len(word) > 1 and word[1] != "." else "-u"), i
            title = len(word) > 2 and word.endswith(".") and word[:-1].lower() in words.known
            return ("TITLE" if title else "U"), i
        return gap + ("l" if c.islower() else "A"), i
    if c.isdigit():
        return gap + "D", i
    if c in "—–-―":
        return gap + "DASH", i
    if c in ",;:，；：、،":
        return gap + "COMMA", i
    return gap + ("OPEN" if c in _OPENERS else "SYM"), i


_LETTERS = re.compile(r"[^\W\d_]+")


def title_right(text: str, right: str, at: int, words: Lexicon) -> str:
    """Behind a word that may be a title, a capitalised word counts by whether it occurs in lower case."""
    if right == "U":
        m = _LETTERS.match(text, at)
        return "UC" if m and m[0].lower() in words.common else "UP"
    return right


def contexts(text: str, words: Lexicon | frozenset[str]) -> list[tuple[int, str, str, str]]:
    """(end, left class, right class, link) of each place in a paragraph where an event may stand.

    ``link`` is "ADJ" where only one word stands between this place and the one before (or the start), as with the number of
    a step, a title or an answer of one word. Time and memory grow with the text alone, whatever its words are like.
    """
    words = words if isinstance(words, Lexicon) else Lexicon(words)
    out = []
    quotes, counted, seen, last = 0, 0, 0, 0
    blank, begin = -1, 0  # the last blank before, and where the word at ``seen`` starts
    hosts: dict[int, int] = {}
    german = "„" in text
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        if end <= last:
            continue
        run = m[0]
        quotes += text.count('"', counted, start)
        counted = start
        if run[0] not in _ENDS:
            out.append((start, "THAI", "THAI", ""))
            last = end
            continue
        while run and run[0] == ";" and not _GREEK.match(text[start - 1 : start]):
            start, run = start + 1, run[1:]
        if not run:
            continue
        stop, _ = _closing(text, end, quotes, german)
        closed = text[end:stop].strip()
        link = "" if _SPACE.search(text, _skip(text, last), start) else "ADJ"
        title = False
        if run == ".":
            # the word before: behind the last blank, quote or bracket
            low, seen = seen, start
            at = start
            while at > low and text[at - 1].isalnum():
                at -= 1
            if at > low:
                gap = text.rfind(" ", low, at)
                rest = text[max(gap + 1, low) : at]
                cut = len(rest) - 1
                while cut >= 0 and not rest[cut].isspace():
                    cut -= 1
                if cut >= 0 or gap >= low:
                    blank = max(gap + 1, low) + cut if cut >= 0 else gap
                edge = max((rest.rfind(c, cut + 1) for c in _BEFORE_WORD), default=-1) if rest[cut + 1 :] else -1
                if edge >= 0:
                    begin = max(gap + 1, low) + edge + 1
                elif blank >= low:
                    begin = blank + 1
            inner = text.rfind(".", begin, start)
            word = text[begin:start].lower() if start - begin <= words.longest else ""
            if word not in words.known:  # a sentence may have ended inside, without a blank
                word = text[max(begin, inner + 1) : start].lower()
            follows = text[stop : stop + 1]
            if closed:
                left = "DOT"
            elif follows.isdigit() and (not word or word[-1].isdigit() or not text[start - 1 : start].isspace()):
                left = "INNER" if word else "LEAD"
            elif not word:
                left = "BARE"
            elif word in words.known:
                left = word
            else:
                left = _word_class(text, word, begin, start, blank, link if begin > inner else "", words, hosts)
                title = left == "TITLED"
        elif set(run) <= {".", "…"}:
            left = "ELLIPSIS"
        elif run[0] in ";\u037e":
            left = "ASK"
        elif run[0] in "。｡．！？":
            left = "WIDE"
        elif run[0] in "؟۔།။។։።॥।፧":
            left = "STOP"
        else:
            left = "MARK"
        if closed:
            left += "+Q" if any(c in "\"'”’“»」』›" for c in closed) else "+B"
        right, at = _right(text, stop, words)
        if right == "END":
            continue
        out.append((stop, left, title_right(text, right, at, words) if title else right, link))
        last = stop
    return out


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _word_class(text: str, word: str, begin: int, start: int, blank: int, link: str, words: Lexicon, hosts: dict[int, int]) -> str:
    bare = word.strip("()[]")
    if bare.isdigit():
        i = start - len(word)
        while i > 0 and text[i - 1].isspace():
            i -= 1
        j = i
        while j > 0 and i - j <= words.longest_before and not text[j - 1].isspace():
            j -= 1
        return "NUM|ord" if text[j:i].lower() in words.before else "NUM"
    if text[start + 1 : start + 2].strip():  # the word goes on behind the point
        if blank + 1 not in hosts:
            host = _HOST.match(text, blank + 1)
            hosts[blank + 1] = host.end() if host else -1
        if hosts[blank + 1] > start:
            return "HOST"
    if len(bare) == 1 and bare.isalpha() and bare != bare.upper() and text[start - 1].isupper():
        return "INITIAL"
    return "TITLED" if link and words.maybe_title(text[start - len(word) : start]) else "WORD"


@dataclass(frozen=True)
class Evidence:
    """What a corpus tells of its words: how many of the points behind a word (of all) stand before a lower-case word, words
    that stand without a point, and words that occur in lower case."""

    pointed: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    plain: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()


class HiddenEventModel:
    """Counts of (left context, event) and (left class, event, right class), smoothed by back-off."""

    def __init__(self, seed: str = SEED, evidence: Evidence | None = None):
        evidence = evidence or Evidence()
        lines = [_unmark(line) for line in seed.strip().split("\n")]
        known = self._abbreviations(lines)
        bare = [w for text, _ in lines for w in re.findall(r"(?<![^\W\d_])[^\W\d_]+(?![^\W\d_]|\.)", text)]
        plain = evidence.plain | {w.lower() for w in bare}
        common = evidence.common | {w for w in bare if w.islower()}
        self.events: dict[Context, Counter] = defaultdict(Counter)
        self.rights: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.classes = set()
        # words of the annotated text also count as if they were unknown, for those that are
        blind = Lexicon((w for w in known if w.startswith("#") or not 2 <= len(w) <= TITLE_LENGTH), (), common)
        for words, titles in ((Lexicon(known, plain, common), False), (blind, True)):
            for text, marks in lines:
                before = "S"
                for end, left, right, link in contexts(text, words):
                    event = "S" if end in marks else "N"
                    if (left == "TITLED") == titles:
                        for key in self._lefts(left, link, before):
                            self.events[key][event] += 1
                        for key in self._sides(left, event):
                            self.rights[key][right] += 1
                        self.classes.add(right)
                    before = event
        for word, (low, n) in evidence.pointed.items():
            if word not in known and 2 * low >= n:
                known |= {word}
                self.events[word, "", "*"]["N"] += LEARNED_WEIGHT * low / n
        self.known = known
        self.lexicon = Lexicon(known, plain, common)
        self.cache: dict[tuple[str, str, str, str], tuple[float, float]] = {}

    @staticmethod
    def _abbreviations(lines: list[tuple[str, set[int]]]) -> frozenset[str]:
        """Words whose point ends nothing at least once, and words before a number whose point ends nothing."""
        found = set()
        for text, marks in lines:
            for m in re.finditer(r"\.(?=\s)(?!\s»)", text):
                if m.end() in marks or text[m.start() - 1] == ".":
                    continue
                word = re.search(rf"[^\s{re.escape(_BEFORE_WORD)}]+$", text[: m.start()])
                if not word:
                    continue
                if word[0].isdigit():
                    before = text[: word.start()].split()
                    if before and text[m.end() :].strip()[:1].isalpha():
                        found.add("#" + before[-1].lower())
                elif len(word[0]) > 1 or word[0].islower() or not word[0].isascii():
                    found.add(word[0].lower())
        return frozenset(w for w in found if not w.startswith("#") or not w.endswith((".", "!", "?")))

    @staticmethod
    def _lefts(left: str, link: str, before: str) -> list[Context]:
        base = "" if left in ("THAI",) or left.isupper() or "+" in left or left.startswith("NUM") else "ABBREVIATION"
        chain = [(left, link, before if link else ""), (left, "", "*")]
        return [*chain, (base, "", "*")] if base else chain

    @staticmethod
    def _sides(left: str, event: str) -> list[tuple[str, str]]:
        base = "ABBREVIATION" if left != left.upper() and not left.startswith("NUM") else "ANY"
        return [(left, event), (base, event), ("", event)]

    def probability(self, left: str, right: str, link: str, before: str) -> tuple[float, float]:
        """P(event | left context) * P(right | left, event), for S and N."""
        key = (left, right, link, before if link else "")
        if key not in self.cache:
            p = {"S": 0.5, "N": 0.5}
            for context in reversed(self._lefts(left, link, before)):
                counts = self.events.get(context)
                if counts:
                    n, kinds = sum(counts.values()), 0.5 * len(counts)
                    p = {e: (counts[e] + kinds * p[e]) / (n + kinds) for e in p}
            result = []
            for e in "SN":
                q = 1.0 / (len(self.classes) + 1)
                for context in reversed(self._sides(left, e)):
                    counts = self.rights.get(context)
                    if counts:
                        n, kinds = sum(counts.values()), 0.5 * len(counts)
                        q = (counts[right] + kinds * q) / (n + kinds)
                result.append(p[e] * q)
            self.cache[key] = (result[0], result[1])
        return self.cache[key]

    def posteriors(self, places: list[tuple[int, str, str, str]]) -> list[float]:
        """P(S) at each place, by forward-backward over the two events."""
        steps = [[self.probability(left, right, link, before) for before in "SN"] for _, left, right, link in places]
        forward, alpha = [], (1.0, 0.0)
        for step in steps:
            s, n = (alpha[0] * step[0][k] + alpha[1] * step[1][k] for k in (0, 1))
            total = s + n or 1.0
            alpha = (s / total, n / total)
            forward.append(alpha)
        out, beta = [0.0] * len(steps), (1.0, 1.0)
        for i in range(len(steps) - 1, -1, -1):
            s, n = forward[i][0] * beta[0], forward[i][1] * beta[1]
            out[i] = s / (s + n) if s + n else 0.0
            step = steps[i]
            beta = tuple(step[k][0] * beta[0] + step[k][1] * beta[1] for k in (0, 1))
            top = max(beta) or 1.0
            beta = (beta[0] / top, beta[1] / top)
        return out

    def boundaries(self, text: str) -> list[int]:
        places = contexts(text, self.lexicon)
        return [place[0] for place, p in zip(places, self.posteriors(places)) if p > 0.5]


def _unmark(line: str) -> tuple[str, set[int]]:
    """A line without its marks, and the places (behind the end marks and closers) where one stood."""
    text, marks = "", set()
    for k, part in enumerate(line.split("‖")):
        if k:
            marks.add(len(text.rstrip()))
            if part[:1] == " " and text[-1:] == " ":
                text = text[:-1]
        text += part
    return text, marks


@lru_cache(maxsize=1)
def model() -> HiddenEventModel:
    return HiddenEventModel()


def sentences(text: str | None, events: HiddenEventModel | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, in characters, without white space at the ends.

    Null, empty and blank texts have none. Together the sentences cover all visible characters.
    """
    if not text:
        return []
    events = events or model()
    out, at = [], 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        stop = m.start() if m else len(text)
        paragraph = text[at:stop]
        if paragraph and not paragraph.isspace():
            edges = [0, *events.boundaries(paragraph), len(paragraph)]
            for a, b in zip(edges, edges[1:]):
                piece = paragraph[a:b]
                bare = piece.strip()
                if bare:
                    start = at + a + len(piece) - len(piece.lstrip())
                    out.append((start, start + len(bare)))
        at = m.end() if m else stop
    return out


def corpus_evidence(df: DataFrame, text: str) -> Evidence:
    """Counts over all texts. Only words of at least one in ``SHARE`` of all words are kept, so at most so many."""
    words = df.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+\.?"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    lows = df.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+(?=\.\s\p{Ll})"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("l"))
    pointed = F.endswith("w", F.lit("."))
    words = words.select(F.lower(F.rtrim("w", F.lit("."))).alias("word"), pointed.alias("pointed"), (~pointed & (F.lower("w") == F.col("w"))).alias("low"), "n", F.lit(0).alias("l"))
    lows = lows.select(F.lower("w").alias("word"), F.lit(True).alias("pointed"), F.lit(False).alias("low"), F.lit(0).alias("n"), "l")
    counts = words.unionByName(lows).groupBy("word").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("pointed"), F.col("n"))).alias("p"), F.sum("l").alias("l"), F.sum(F.when(F.col("low"), F.col("n"))).alias("c")
    )
    counts = written(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("n") * SHARE >= total) & (F.length("word") <= SHARE_LENGTH)).collect()
    enough = lambda n: n is not None and n * SHARE >= total
    return Evidence(
        {r["word"]: (r["l"], r["p"]) for r in rows if enough(r["p"]) and 2 * r["l"] >= r["p"]},
        frozenset(r["word"] for r in rows if r["n"] > (r["p"] or 0)),
        frozenset(r["word"] for r in rows if r["c"]),
    )


def split(df: DataFrame, key: str, text: str, evidence: Evidence | None = None) -> DataFrame:
    """doc_id, start_char, end_char of the sentences of every text; a narrow stage over whole texts.

    Without ``evidence`` of the corpus only the annotated text counts."""
    shared = df.sparkSession.sparkContext.broadcast(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = HiddenEventModel(evidence=shared.value)
        for batch in batches:
            owner, starts, ends = [], [], []
            for i, value in enumerate(batch.column(1)):
                for a, b in sentences(value.as_py(), events):
                    owner.append(i)
                    starts.append(a)
                    ends.append(b)
            ids = batch.column(0).take(pa.array(owner, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start_char", "end_char"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, start_char long, end_char long")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_char, end_char of every sentence of every document."""
    documents = read_table(spark, sf_dir, "documents")
    return split(documents, "doc_id", "text", corpus_evidence(documents, "text"))
