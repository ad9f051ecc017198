import os
import random

import pytest

from wicker.llm import decision_tree, markup, mixture, sentences, tokenize

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenize.VOCABULARY), reason="no vocabulary file")
TEXTS = ["", None, "Hello  world!", " don't WE'LL 12 345\n\n  x", "日本語のテキスト、😀👩‍🍳", "<|endoftext|> a", "aaaaaaaaaaaaaaaaaaaaaaa" * 40, "a\x00b\tc ", "crème ﬁne Ｆｕｌｌ"]


@needs_vocabulary
def test_ids_agree_with_the_public_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.VOCABULARY)
    t.encode_special_tokens = True
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choices("ab e\n'ü9漢.-", k=rnd.randint(0, 60))) for _ in range(400)]
    wanted = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    words = sorted(tokenize.Cutter().count(texts))
    table = dict(zip(words, tokenize.replay(words, tokenize.load_merges())))
    for known in (table, {w: i for w, i in table.items() if len(w) < 4}, {}):
        encoder, got = tokenize.KnownIds(known), []
        for text in texts:
            parts, rare = encoder.pieces(text)
            ordered = sorted([*parts, *((at, table[w]) for at, w in rare)])
            assert [at for at, _ in ordered] == list(range(len(ordered)))
            got.append([i for _, ids in ordered for i in ids])
        assert got == wanted
    cut = tokenize.Cutter()
    blanks = ["".join(rnd.choices("a.\u00a0\x1c\x1f \n\u3000'", k=9)) for _ in range(2000)]
    assert [[w for c in cut.chunks(x) for w in cut.words(c)] for x in blanks] == [cut.words(x) for x in blanks]


@needs_vocabulary
@pytest.mark.parametrize("frequent", [10**6, 5, 1])
def test_corpus_words_return_to_their_documents(spark, monkeypatch, frequent):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenize, "FREQUENT", frequent)
    t = Tokenizer.from_file(tokenize.VOCABULARY)
    t.encode_special_tokens = True
    texts = [*TEXTS, "stir the soup, the hot soup " * 30, "the soup", "the soup"]
    df = spark.createDataFrame([(k // 2, x) for k, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    wanted = sorted((k // 2, t.encode(x or "", add_special_tokens=False).ids) for k, x in enumerate(texts))
    assert sorted((r["key"], r["ids"]) for r in tokenize.encode(spark, df, "doc_id", "text").collect()) == wanted
    sizes = tokenize.count_tokens(spark, df, "text").collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in sizes) == sorted((k, len(i)) for k, i in wanted)
    words = {r["word"]: r["n"] for r in tokenize.word_ids(df, "text").collect()}
    assert words[" soup"] == 62 and tokenize.word_ids(df.limit(0), "text").count() == 0
    assert tokenize.encode(spark, df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_encoding_rows(spark):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["key"]: r["ids"] for r in tokenize.encode(spark, df, "doc_id", "text").collect()}
    assert got[0] == [] and got[1] == [] and len(got) == len(TEXTS)
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokenize.count_tokens(spark, df, "text").collect()}
    assert sizes == {k: len(v) for k, v in got.items()}


def test_plan_keeps_shares_and_caps():
    plans = mixture.plan_sources([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2)], {"a": 1000, "b": 100})
    quota = {p.source: p.quota for p in plans}
    assert quota["c"] == 0 and quota["b"] == 400 and abs(quota["a"] / sum(quota.values()) - 0.625) < 0.01
    assert abs(sum(p.tilt * p.target for p in plans if p.available)) < 1e-9
    assert {p.source: p.quota for p in mixture.plan_sources([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 10, "b": 10}, total=100)} == {"a": 10, "b": 20}
    assert all(p.quota == 0 for p in mixture.plan_sources([("a", 1.0, 1)], {}))


def test_position_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(c / 10, g) for c in range(11) for g in (-0.5, 0.0, 0.3)], "c double, g double")
    for r in df.withColumn("t", mixture.position(F.col("c"), F.col("g"))).collect():
        assert abs(r["t"] + r["g"] * (r["t"] ** 2 - r["t"]) - r["c"]) < 1e-9


@needs_vocabulary
def test_mix(spark, write):
    rnd = random.Random(3)
    docs = [(k, "word " * rnd.randint(1, 30), rnd.choice(["Big-One", " big_one ", "small", None])) for k in range(300)] + [(900, None, "small"), (901, "", "small")]
    d = write("documents", docs, "doc_id long, text string, source string")
    write("mix_targets", [("big_one", 0.7, 1), ("small", 0.25, 3), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    shares = {r["source"]: r for r in mixture.shares(spark, d).collect()}
    assert shares["none"]["status"] == "no tokens" and abs(shares["big_one"]["reached_share"] - 0.7 / 0.95) < 0.02
    rows = mixture.mix(spark, d).collect()
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and max(r["copy"] for r in rows) <= 2
    assert all(0 <= r["position"] <= 1 for r in rows) and not {900, 901} & {r["doc_id"] for r in rows}


def test_tree():
    tree = decision_tree.train([[0, 1], [1, 1], [0, 5], [1, 5]], ["a", "b", "a", "b"])
    assert [tree.predict(r) for r in ([0, 3], [1, 3])] == ["a", "b"]
    assert decision_tree.train([[1.0]], ["x"]).predict([9]) == "x"


def test_tree_on_held_out_pages():
    """Train on all labelled pages but one, and ask for that one."""
    right = total = 0
    for left_out in range(len(markup.LABELLED)):
        rows, labels, test = [], [], None
        for k, (kind, text, wanted) in enumerate(markup.LABELLED):
            page = markup.Page()
            features = markup.features(page, kind, list(markup._SPLITTERS[kind](page, text)))
            if k == left_out:
                test = (features, wanted)
            else:
                rows += features
                labels += wanted
        tree = decision_tree.train(rows, labels)
        right += sum(tree.predict(f) == w for f, w in zip(*test))
        total += len(test[1])
    assert right / total > 0.9


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, []), ("", []), (" \n", []), ("#REDIRECT [[x]]", []),
        ("== '''A''' ==\r\n* [[B:c|d]] &amp; ''e''<ref>x</ref>\r\n<pre>\r\n a\r\n  b \r\n</pre>\r\n", [("heading", "A"), ("item", "d & e"), ("code", "a\n  b")]),
        ("{{t|{{u}}}}\ntext <nowiki>''x''</nowiki> [http://y z]<br>w\n\n<math>a_b</math>\n[[Category:x]]", [("para", "text ''x'' z w"), ("formula", "a_b")]),
        ("<html><body><h2>A &lt; b</h2><ul><li>x <i title=\"a > b\">y</i></li></ul><script>no</script></body></html>", [("heading", "A < b"), ("item", "x y")]),
        ("Head\n----\n\n- a *b* 2_c 5 * 3 `d_e`\n1. [f](u \"t\")\n\n```\n# g\n```\n\n$$h$$", [("heading", "Head"), ("item", "a b 2_c 5 * 3 d_e"), ("item", "f"), ("code", "# g"), ("formula", "h")]),
        ("\\documentclass{a}\n% no\n\\begin{document}\n\\section{A \\& b}\n\\begin{itemize}\n\\item \\textbf{c} $d_e$ 5{\\textdegree}C\n\\end{itemize}\n\\[ f \\]\nx\\_y\n\\end{document}", [("heading", "A & b"), ("item", "c d_e 5°C"), ("formula", "f"), ("para", "x_y")]),
    ],
)
def test_pages(text, expected):
    assert markup.page_blocks(text) == expected


def test_page_rows(spark, write):
    d = write("pages", [(1, 1, "== A ==", "x"), (1, 1, "== A ==", "x"), (1, 2, None, "x"), (2, 1, "a " * 50_000, "x")], "page_id long, revision_id long, wikitext string, kind string")
    rows = sorted((r["page_id"], r["revision_id"], r["block_no"], r["kind"], len(r["block_text"])) for r in markup.found(spark, d).collect())
    assert rows == [(1, 1, 0, "heading", 1), (2, 1, 0, "para", 99_999)]


@pytest.mark.parametrize(
    "marked",
    [
        "Dr. Vale met Mrs. Moss at 6 a.m. and left.|Then it rained.", "Add 3.5 cups, etc. and stir.|Was it good?|\"Is it done?\" asked Kim.", "He said, \"Never do that.\"|Nobody argued.",
        "1. Peel it.|2. Boil the rice in batches of 7.|Serve.", "See www.Some.invalid/a.html for notes.v3.txt now.|Done.", "Am 5. Tag kocht er z. B. 3 kg.|„Nein!“, rief sie.|Gut.",
        "« Non ! » dit Luc.|C'est tout !|Oui.", "В 1999 г. Вера пришла.|«Нет!» — сказала она.", "他说：“好！”然后走了。|下雨了。", "「はい！」と言った。|終わり！", "Είναι έτοιμο;|Ναι.", "Wait... then go; or stay.|End.",
        "गरम है।|डॉ. मीरा आईं।", "یہ گرم ہے۔|کیوں؟", "ต้มน้ำ| คนช้าๆ| เสิร์ฟ", "One.\n\nTwo", "a line\nbroken here.|Next", "It ended.|Then more.", "- - -", "Left.|\"Why?\" he asked.",
    ],
)
def test_sentences(marked):
    if "\n\n" in marked:
        assert [marked[a:b] for a, b in sentences.sentences(marked)] == marked.split("\n\n")
        return
    for gap in (" ", "  ") if "ต" not in marked else ("",):
        text = marked.replace("|", "" if any(c in marked for c in "。") else gap)
        assert [text[a:b] for a, b in sentences.sentences(text)] == [s.strip() for s in marked.split("|")]


def test_missing_blank_and_line_ends():
    for text in ("It ended.Then more.", "a b.\r\nC d."):
        assert len(sentences.sentences(text)) == 2
    assert len(sentences.sentences("one\r\ntwo")) == 1 and len(sentences.sentences("one\r\n\r\ntwo")) == 2


def test_sentences_cover_the_text():
    rnd = random.Random(5)
    for _ in range(300):
        t = "".join(rnd.choices("aB .!?\n\r\t\"'«»。」1…ก ", k=rnd.randint(0, 80)))
        s = sentences.sentences(t)
        assert "".join("".join(t[a:b].split()) for a, b in s) == "".join(t.split())
        assert all(t[a:b] == t[a:b].strip() and a < b for a, b in s)


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, " "), (4, "x. Y " * 20_000)], "doc_id long, text string")
    rows = sentences.split(df, "doc_id", "text").collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and not {2, 3} & {r["doc_id"] for r in rows} and len(rows) > 20_000


def test_posteriors_are_probabilities():
    m = sentences.model()
    places = sentences.contexts("Dr. Vale left. 5. Then he ate.", m.known)
    assert all(0 <= p <= 1 for p in m.posteriors(places))


HELD_OUT = [
    "Gen. Smith left. ‖ Capt. Roe sat. ‖ They rested.", "It held 9 of 12. ‖ 7. Rinse the rice. ‖ 8. Drain it.", "She was born in 1950. ‖ The town was small.",
    "1. Mix. ‖ 2. Bake. ‖ 3. Eat it warm.", "No. ‖ She stayed. ‖ Look at no. 9 there.", "See https://www.example.org/aaaaa/b.Html for it. ‖ Go on.",
    "ទឹកពុះ។ ‖ ដាក់អំបិល។", "ရေဆူပြီ။ ‖ ဆားထည့်ပါ။", "ဆားထည့်ပါ ‖ ရေဆူပြီ", "ཆུ་ཁོལ་སོང་། ‖ ཚྭ་བླུགས།", "Lt. Marsh saw it. ‖ Done. ‖ They left.",
]


def _f1(events, decide):
    right = wrong = missed = 0
    for line in HELD_OUT:
        text, marks = sentences._unmark(line)
        places = sentences.contexts(text, events.lexicon)
        got = {p[0] for p, s in zip(places, decide(places)) if s > 0.5}
        right, wrong, missed = right + len(got & marks), wrong + len(got - marks), missed + len(marks - got)
    return 2 * right / (2 * right + wrong + missed)


def test_forward_backward_decides():
    """Without the event before, titles and step numbers are cut or joined wrongly."""
    m = sentences.model()

    def alone(places):
        return [s / (s + n) for s, n in (m.probability(left, right, "", "") for _, left, right, _ in places)]

    assert _f1(m, m.posteriors) == 1 > _f1(m, alone)


def test_the_corpus_teaches_abbreviations(spark):
    texts = ["He ate with Brg. and left. They saw 4 grb. of rice, 5 grb. of oil. He took 6 grb. Then he ate. It was grb. Smith."] * 3 + [None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    evidence = sentences.corpus_evidence(df, "text")
    assert evidence.pointed["grb"] == (6, 12) and "ate" in evidence.plain and "they" not in evidence.common
    text = "We had 7 grb. Oil was there."
    assert len(sentences.sentences(text)) == 2 and len(sentences.sentences("They had Tsp. Oil.", sentences.HiddenEventModel(evidence=evidence))) == 1
    assert len(sentences.sentences("It needs grb. 5 cups.", sentences.HiddenEventModel(evidence=evidence))) == 1
    assert sentences.corpus_evidence(df.limit(0), "text") == sentences.Evidence()


def test_time_grows_with_the_text():
    for text in ("a." * 200_000, "a" * 200_000 + "(" + "b" * 200_000 + ". C", "1. " * 100_000, "http://" + "a.b/" * 100_000):
        covered = sentences.sentences(text)
        assert "".join("".join(text[a:b].split()) for a, b in covered) == "".join(text.split())


def _held_out_accuracy(without=()):
    right = total = 0
    for left_out in range(len(markup.LABELLED)):
        rows, labels, test = [], [], None
        for k, (kind, text, wanted) in enumerate(markup.LABELLED):
            page = markup.Page()
            features = markup.features(page, kind, list(markup._SPLITTERS[kind](page, text)))
            features = [[0.0 if n in without else x for n, x in zip(markup.FEATURES, f)] for f in features]
            if k == left_out:
                test = (features, wanted)
            else:
                rows += features
                labels += wanted
        tree = decision_tree.train(rows, labels)
        right += sum(tree.predict(f) == w for f, w in zip(*test))
        total += len(test[1])
    return right / total


def test_links_and_neighbours_are_needed():
    used, nodes = set(), [markup.classifier()]
    while nodes:
        node = nodes.pop()
        if node.low is not None:
            used.add(markup.FEATURES[node.feature])
            nodes += [node.low, node.high]
    neighbours = {n for n in markup.FEATURES if n.endswith(("before", "after"))}
    assert "links" in used and "words" in used and used & neighbours
    whole = _held_out_accuracy()
    of_links = {n for n in markup.FEATURES if n.startswith(("links", "bars"))}  # bars are those between links
    assert whole > _held_out_accuracy(neighbours) and whole > _held_out_accuracy(of_links) and whole > 0.95


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{| class="wikitext"\n|+ Cap\n|-\n! A !! B\n|-\n| style="x" | c || [[d|e]]\n|}\nText', [("para", x) for x in ("Cap", "A", "B", "c", "e", "Text")]),
        ("# T\n\n| a | b |\n|---|---|\n| c | `x|y` |\n\nEnd", [("heading", "T"), *(("para", x) for x in ("a", "b", "c", "x|y", "End"))]),
        ("# T\n\nAfter\n\n    code  here\n\n    more\n\n- a\n\n    under a\n", [("heading", "T"), ("para", "After"), ("code", "code  here\n\nmore"), ("item", "a"), ("para", "under a")]),
        ("# T\n\nsee [q][a], [b] and [c].\n\n[a]: http://x\n[b]: <u> \"t\"\n", [("heading", "T"), ("para", "see q, b and [c].")]),
        ("\\begin{document}\n\\begin{tabular}{l|p{2cm}}\n\\hline\na & $b$ \\\\ \\hline\nc \\& e & d\n\\end{tabular}\n\\end{document}", [("para", "a"), ("formula", "b"), ("para", "c & e"), ("para", "d")]),
        ("<body><p><a href='u'>One</a> | <a href='u'>Two</a> | <a href='u'>Three</a></p><h1>A</h1><p>Words of a page.</p></body>", [("heading", "A"), ("para", "Words of a page.")]),
    ],
)
def test_tables_code_references_and_navigation(text, expected):
    assert markup.page_blocks(text) == expected
