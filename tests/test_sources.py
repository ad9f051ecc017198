import gzip
import json

import pytest
from pyspark.sql import functions as F

from wicker.sources import readers, sinks, wiki


def test_raw_csv(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text('title,ingredients,directions,link,source,NER\n" Pie ","[""1 egg"",\n""2 cups milk""]",[not valid,,,"""egg"""\nSoup,,"[""boil""]",l,s,"[""a""]"\n', encoding="utf8")
    rows = [tuple(r) for r in readers.read_raw_csv(spark, str(p)).collect()]
    assert rows == [("Pie", ["1 egg", "2 cups milk"], [], [], "", ""), ("Soup", [], ["boil"], ["a"], "l", "s")]
    assert readers.read_raw_csv(spark, str(p), 0).count() == 0 and readers.read_raw_csv(spark, str(p), -1).count() == 0


def test_pack(spark, tmp_path):
    doc = {"format": 1, "ingredients": [{"id": "a", "name": "A", "staple": True, "idf": 1.0}], "keys": {"a": "a"}, "recipes": [{"id": "r", "title": "T", "page": "p", "rev": 1, "lines": [{"t": "x", "o": ["a"], "opt": False, "r": True}]}]}
    (tmp_path / "core.json.gz").write_bytes(gzip.compress(json.dumps(doc).encode()))
    ing, keys, lines = readers.read_pack(spark, str(tmp_path / "core.json.gz"))
    assert ing.count() == 1 and keys.first()["id"] == "a" and tuple(lines.first()) == ("r", "T", 0, "x", ["a"], False, True)


def test_labels(spark, tmp_path):
    ids = spark.createDataFrame([("l1",), ("l2",)], "line_id string")
    good = tmp_path / "good.csv"
    good.write_text("line_id,names,optional,not_an_ingredient\nl1,a|b; c,1,\nl2,,,yes\n")
    rows = {r["line_id"]: r for r in readers.read_labels(spark, str(good), ids).collect()}
    assert rows["l1"]["groups"] == [["a", "b"], ["c"]] and rows["l1"]["optional"] and rows["l2"]["not_an_ingredient"]
    for text in ("l1,a,,\n", "l1,a,,\nl2,b,,\nl3,c,,\n", "l1,a,,\nl1,a,,\nl2,b,,\n", "l1,a,,yes\nl2,b,,\n", "l1,,,\nl2,b,,\n"):
        bad = tmp_path / "bad.csv"
        bad.write_text("line_id,names,optional,not_an_ingredient\n" + text)
        with pytest.raises(Exception, match="label|line"):
            readers.read_labels(spark, str(bad), ids).collect()


def test_dimension_checks(spark):
    df = spark.createDataFrame([("a", "hand"), ("a", "hand")], "id string, provenance string")
    with pytest.raises(Exception, match="repeated id"):
        readers.check_dimension(df, ("hand",)).collect()
    assert readers.check_dimension(df.limit(1), ("hand",)).count() == 1


def test_curated_and_pairs(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"A": ["x", ""], "a": ["y"]}')
    got = readers.read_curated(spark, str(tmp_path / "c.json"), F.lower).collect()
    assert [(r["source"], r["targets"]) for r in got] == [("a", ["y"])]
    (tmp_path / "p.csv").write_text("source,target\nA,B\na,b\n,c\n")
    assert [(r["source"], r["targets"]) for r in readers.read_pairs(spark, str(tmp_path / "p.csv"), F.lower).collect()] == [("a", ["b"])]


def test_checked_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"x")
    good = {"a.txt": hashlib.sha256(b"x").hexdigest()}
    assert readers.checked_files(spark, str(tmp_path), good).count() == 1
    for pinned in ({"a.txt": "0"}, {}):
        with pytest.raises(Exception, match="digest of"):
            readers.checked_files(spark, str(tmp_path), pinned).collect()


def test_wiki_page():
    text = "{{recipe summary|category=[[C:Pie|Pies]]|servings=4|time=1 h<br>2 h}}\n== Ingredients ==\n* [[Salt]] and ''oil''<ref>n</ref>\n\n== Procedure ==\n# Stir.\n"
    assert wiki.parse_page(text) == (["Salt and oil"], ["Stir."], "Pies", "4", "1 h; 2 h")
    assert wiki.parse_page("#REDIRECT [[x]]") is None and wiki.parse_page("no list") is None and wiki.parse_page(None) is None


PAGES = {1: "Pie", 2: "Soup"}


def transport(params):
    if params.get("list") == "categorymembers":
        if params["cmtitle"] == "Category:Root":
            if "cmcontinue" not in params:
                return {"query": {"categorymembers": [{"title": "Pie", "pageid": 1}]}, "continue": {"cmcontinue": "x"}}
            return {"query": {"categorymembers": [{"title": "Category:Sub", "pageid": 9}]}}
        return {"query": {"categorymembers": [{"title": "Soup", "pageid": 2}, {"title": "Category:Root", "pageid": 8}]}}
    ids = [int(i) for i in params["pageids"].split("|")]
    return {"query": {"pages": [{"pageid": i, "title": PAGES[i], "revisions": [{"revid": 10 * i, "timestamp": "t", "text": "x"}]} for i in ids]}}


def test_wiki_walk():
    assert [p["pageid"] for p in wiki.category_pages(transport, "Category:Root")] == [1, 2]
    with pytest.raises(RuntimeError):
        list(wiki.category_pages(lambda p: {"error": {"code": "maxlag"}}, "Category:Root"))


def test_bundle_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    sinks.write_bundle({"a": a, "b": a.limit(1)}, str(tmp_path / "b"), {"of": "test"})
    back = sinks.read_bundle(spark, str(tmp_path / "b"), verify=True)
    assert sorted(map(tuple, back["a"].collect()), key=repr) == [(1, "x"), (2, None)]
    assert sinks.content_digest(a.repartition(3)).first() == sinks.content_digest(a).first()
    assert sinks.content_digest(a.union(a)).first()["digest"] != sinks.content_digest(a).first()["digest"]


def test_result_document(spark):
    rows = spark.createDataFrame([("g", "dev", "a", "recall", 0.5, 10), ("g", "dev", "b", "recall", 0.25, 10)], "group string, split string, arm string, name string, value double, n int")
    registry = {"recall": {"role": "selection", "features": ["overlap"]}}
    doc = sinks.result_document(rows, registry)
    assert [m["role"] for m in doc["metrics"]] == ["selection", "selection"]
    assert "| b | 0.2500 |" in sinks.markdown_table(rows, ["recall"])
    with pytest.raises(ValueError):
        sinks.assert_selectable("recall", {"a": {"overlap"}}, registry)
    with pytest.raises(ValueError):
        sinks.validate_document({**doc, "schema_version": 2})
    assert sinks.below_floor(rows.withColumn("value", F.lit(0.3)), sinks.floors(rows)).count() == 1


def test_gzip_is_deterministic(tmp_path):
    import gzip

    from wicker.sources import sinks

    a, b = (sinks.write_gzip(str(tmp_path / n), "crème\n" * 50) for n in ("a.gz", "x/b.gz"))
    assert a == b and gzip.decompress((tmp_path / "a.gz").read_bytes()).decode() == "crème\n" * 50
