"""Hand-written cases of the registry of selections."""

import hashlib

import pytest

from siltstone.operators import registry as G

SELECTED = "pack int, step int, path string, mode string, content string, summary string, score double, reasons array<string>"
OMITTED = "pack int, step int, path string, mode string, score double, reasons array<string>, reason string, tokens int"
FILES = "path string, hash string, text string, tokens int"
REQUESTS = "id int, pack int, path string, block_id string, mode string, allow_stale boolean"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def saved(spark, tmp_path):
    selected = spark.createDataFrame([(1, 1, "a/x.py", "full", "def f(): pass", None, 9.0, ["phrase"]), (1, 2, "b.md", "summary", None, "about b", 8.0, []), (1, 3, "c", "summary", None, None, 7.0, None), (2, 1, "a/x.py", "skeleton", "", "def f()", 1.0, [])], SELECTED)
    omitted = spark.createDataFrame([(1, 1, "d.py", "skeleton", 3.0, [], "budget", 50), (1, 2, "gone.py", "summary", 2.5, [], "cap", 7)], OMITTED)
    files = spark.createDataFrame([(p, sha(t), t, len(t) // 4) for p, t in [("a/x.py", "def f(): pass"), ("b.md", "about b\nmore"), ("c", "text of c"), ("d.py", "import os\ny = 1")]], FILES)
    symbols = spark.createDataFrame([(1, "a/x.py", 1, "f", "def f(): pass"), (1, "a/x.py", 2, "g", None), (1, "none.py", 1, "h", "x")], "pack int, path string, n int, name string, body string")
    found, kept = G.records(selected, omitted, files, symbols), G.contents(selected, symbols)
    G.save(found, kept, str(tmp_path), "1")
    return str(tmp_path), files, found, kept


def test_records_in_order(spark, saved):
    _, _, found, _ = saved
    rows = found.filter("pack = 1").orderBy("place").collect()
    assert [(r.path, r.kind, r["mode"], r.symbol) for r in rows] == [
        ("a/x.py", "selected", "full", None), ("a/x.py", "selected", "symbol", "f"), ("a/x.py", "selected", "symbol", "g"), ("b.md", "selected", "summary", None), ("c", "selected", "summary", None), ("d.py", "omitted", "skeleton", None), ("gone.py", "omitted", "summary", None),
    ]
    assert rows[0].block_id == "a__x.py:" + sha("def f(): pass")[:12] and rows[1].block_id == "a__x.py::f:" + sha("a/x.py:f:def f(): pass")[:12]
    assert rows[4].content_hash == sha("c") and rows[4].tokens == 0 and rows[3].stored is None
    # what isn't among the files is told by its score, and keeps its own tokens
    assert rows[6].content_hash == sha("gone.py:2.5:cap") and (rows[5].tokens, rows[6].tokens) == (3, 7)


def test_contents_are_kept_once(spark, saved):
    folder, _, found, kept = saved
    assert sorted(r.content for r in kept.collect()) == ["def f()", "def f(): pass", "g"]
    G.save(found, kept, folder, "2")
    assert spark.read.parquet(f"{folder}/contents").count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        G.save(found, kept, folder, "2")
    assert G.load(spark, folder)[0].count() == G.load(spark, folder, "1")[0].count() == 8


def test_retrieval(spark, saved):
    folder, files, _, _ = saved
    found, kept = G.load(spark, folder)
    secret = "import os\ntoken = '" + "a1B2" * 12 + "'\n"
    now = [("a/x.py", "def f(): return 1"), ("c", "text of c"), ("d.py", secret)]
    files = spark.createDataFrame([(p, sha(t), t) for p, t in now], "path string, hash string, text string")
    g = [r.block_id for r in found.filter("symbol = 'g'").collect()][0]
    asked = [
        (1, 1, "a/x.py", None, "as_stored", None), (2, 1, "a/x.py", None, "full", None), (3, 1, "a/x.py", None, "full", True), (4, 1, "b.md", None, "as_stored", False), (5, 1, "b.md", None, "full", True), (6, 1, "c", None, "as_stored", False),
        (7, 1, "d.py", None, "skeleton", True), (8, 1, None, g, "as_stored", False), (9, 1, "nowhere", "x:1", "full", False), (10, 1, "c", g, "as_stored", False), (11, 3, "c", None, "full", False), (12, 2, "a/x.py", None, "as_stored", False),
        (13, 1, "d.py", None, "full", True), (14, None, None, None, None, None),
    ]
    got = {r.id: r for r in G.retrieve(found, kept, spark.createDataFrame(asked, REQUESTS), files, 30).collect()}
    assert {k: r.status for k, r in got.items()} == {
        1: "stored", 2: "stale", 3: "stale-current", 4: "stored", 5: "gone", 6: "current", 7: "stale-current", 8: "stored", 9: "no record", 10: "stored", 11: "no record", 12: "stored", 13: "stale-current", 14: "no record",
    }
    # of a path and a block that name two records the first of the pack counts
    assert (got[1].content, got[3].content, got[4].content, got[6].content, got[8].content, got[10].content, got[12].content) == ("def f(): pass", "def f(): return 1", "about b", "text of c", "g", "g", "def f()")
    assert (got[7].content, got[7].truncated, got[7].warnings) == ("import os", False, ["api-key (line 2)"])
    assert (got[13].content, got[13].truncated) == ("import os\ntoken = '[REDACTED:a", True) and got[2].content is None
    assert G.retrieve(found, kept, spark.createDataFrame([], REQUESTS), files).count() == 0
