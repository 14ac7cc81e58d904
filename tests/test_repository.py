"""Hand-written cases of paths, tasks, scoring, selection, histories and provenance."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions import source as C
from siltstone.functions import tasks as K
from siltstone.operators import boosts as B
from siltstone.operators import evaluation as V2
from siltstone.operators import history as H
from siltstone.operators import imports as M
from siltstone.operators import overview as O
from siltstone.operators import phrases as PH
from siltstone.operators import provenance as V
from siltstone.operators import relations as R
from siltstone.operators import scoring as G
from siltstone.operators import selector as L
from siltstone.operators import skills as S
from siltstone.operators import snapshots as N


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_path_parts(spark):
    paths = ["a/b.test.ts", ".env", "x", "src/.hidden/y.tar.gz", "api/[id]/route.ts", "app/api/users/[id]/views.py"]
    assert column(spark, paths, P.stem) == ["b.test", ".env", "x", "y.tar", "route", "views"]
    assert column(spark, paths, P.suffix) == [".ts", "", "", ".gz", ".ts", ".py"]
    assert column(spark, paths, P.api_key) == [None, None, None, None, "/api/id", "/api/users/id"]


@pytest.mark.parametrize(
    "kind, yes, no",
    [
        ("test_file", ["test_a.py", "a_test.go", "a.test.ts", "a.spec.js", "tests/a", "x/__tests__/y"], ["attest.py", "a_test.d.ts", "test.py", "x.test", "latest/a"]),
        ("test_path", ["Tests/a.py", "x/test/a", "a_test.go", "x/tests/y"], ["testing/a.py", "contest.py"]),
        ("config_file", ["a.toml", "x/.env", "Dockerfile", "my-config.ts", "conf.d", "package.json", "go.mod"], ["configure.py", "reconfig.ts", "gopher.go"]),
        ("knowledge_file", ["docs/adr/x.md", "ARCHITECTURE.md", "adr-12.txt"], ["adr.txt", "design.py", "docs/x.md"]),
        ("lock_or_generated", ["yarn.lock", "a/dist/x.js", "x.snap"], ["distance/x.js", "lock.py"]),
        ("skipped", [".git/x", "a/.claude"], ["git/x", ".github/x"]),
    ],
)
def test_kinds_of_paths(spark, kind, yes, no):
    assert column(spark, yes + no, lambda c: P.is_kind(c, kind)) == [True] * len(yes) + [False] * len(no)


def test_ignore_rules_and_globs(spark):
    paths = ["dist/a", "a/dist/b", "x.lock", "docs/a/b", "docs/adr/b", "a/docs/b", "distx"]
    assert column(spark, paths, lambda c: P.ignored(c, ["# no", "dist/", "*.lock", "docs/**", "!docs/adr/"])) == [True, True, True, True, False, False, False]
    assert column(spark, ["src/a.py", "src/b/c.py", "lib/a.py"], lambda c: P.allowed(c, ["src/*"], ["*c.py"])) == [True, False, False]


def test_task_terms_and_phrases(spark):
    tasks = ["fix(userAuth): login of `rate limits` fails", "Update the docs", "", "look at src/app_main.py"]
    assert column(spark, tasks, K.terms) == [["fix", "user", "auth", "login", "rate", "limits", "fails"], ["update", "docs"], [], ["look", "src", "app", "main"]]
    assert column(spark, tasks, K.literal_phrases) == [["rate limits"], [], [], ["src app main"]]
    assert column(spark, ["a b", "a"], lambda c: K.phrases(F.split(c, " "))) == [["a b"], []]
    assert column(spark, ["queries", "classes", "boxes", "status", "tests", "users", "bus"], K.singular) == ["query", "class", "boxe", None, None, "user", None]


def test_classes_and_references(spark):
    assert [r.kind for r in column(spark, ["fix the broken test", "hello", "new docs guide"], K.classes)] == ["bugfix", "general", "docs"]
    assert column(spark, ["security review of prs", "map repo", "repair"], K.intent) == ["audit", "repo_overview", "coding_task"]
    assert column(spark, ["see #12, GH-3 and ABC-7. also abc#9 gh-3", None], K.issue_references) == [["#12", "GH-3", "ABC-7"], []]
    assert [[tuple(x)[0:1] + (x["first"], x["last"]) for x in r] for r in column(spark, ["a.py:3-5 b:0 c:7-2 <d e>:4"], K.locations)] == [[("a.py", 3, 5), ("d e", 4, 4)]]


def test_incremental_scan_reuses_and_drops(spark):
    old = spark.createDataFrame([("a", "1", 9), ("d/x", "1", 9), ("d/y", "1", 9), ("gone", "1", 9), ("b", "1", 9)], "path string, hash string, tokens long")
    now = spark.createDataFrame([("a", "2", 1), ("d/x", "1", 1), ("d/new", "5", 1), ("b", "9", 1)], "path string, hash string, tokens long")
    changed = spark.createDataFrame([("a",), ("d",), ("gone",)], "path string")
    got = {r.path: (r.hash, r.tokens, r.reused) for r in N.incremental(old, now, changed).collect()}
    # b is not named, so its old row stays; d/y lies below a changed folder but is still in the old state alone
    assert got == {"a": ("2", 1, False), "d/x": ("1", 9, True), "d/new": ("5", 1, False), "b": ("1", 9, True), "d/y": ("1", 9, True)}


def test_literals_of_any_length(spark):
    docs = spark.createDataFrame([(1, "a foo bar baz end"), (2, "xfoo barx"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(0, "foo"), (1, "foo bar"), (2, "foo bar baz"), (3, None)], "item_id long, text string")
    assert {tuple(r) for r in R.holds(docs, items).collect()} == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)}


def test_links_resolve_or_keep_their_name(spark):
    pages = spark.createDataFrame(
        [(1, "https://h.org/en/a?x=1", '<a href="/en/b"><a href="c"><a href="#top"><a href="https://o.org/z/"><a href="/en/a">'), (2, "http://h.org/en/b", '<a href="a"><a href="a">'), (3, "https://h.org/en/c/", "")],
        "page_id long, url string, html string",
    )
    assert {tuple(r) for r in R.links(pages).collect()} == {(1, "h.org/en/b", 2), (1, "h.org/en/c", 3), (1, "o.org/z", -1), (2, "h.org/en/a", 1)}


def test_rank_of_a_group_is_spread_over_its_values(spark):
    rows = spark.createDataFrame([("g", v, i) for i, v in enumerate([5, 7, 5, 1, 7])] + [("h", 1, 9)], "g string, v long, i long")
    assert {(r.g, r.i): r["rank"] for r in R.ranked_within(rows, "g", "v", "i").collect()} == {("g", 1): 1, ("g", 4): 2, ("g", 0): 3, ("g", 2): 4, ("g", 3): 5, ("h", 9): 1}


def scored(spark, rows):
    return spark.createDataFrame([(1, p, float(s), r) for p, s, r in rows], "task_id int, path string, score double, reasons array<string>")


def test_pairs_of_tests(spark):
    rows = scored(spark, [("src/user.py", 50, []), ("src/low.py", 10, []), ("tests/test_user.py", 5, []), ("tests/test_low.py", 5, [])])
    got = {r.path: (r.score, r.reasons) for r in B.paired_tests(rows).collect()}
    assert got["tests/test_user.py"] == (40.0, ["test for src/user.py"]) and got["tests/test_low.py"] == (5.0, [])


def test_score_adds_evidence_in_order(spark):
    tasks = spark.createDataFrame([(1, "repair checkout totals")], "task_id int, task string")
    base = (False, False, False, False, 0, False, False, None, None)
    files = spark.createDataFrame(
        [("src/checkout_totals.py", "checkout adds totals", *base), ("src/other.py", "nothing here", *base), ("lib/checkout.py", "plain", True, *base[1:])],
        "path string, text string, changed boolean, staged boolean, recent boolean, churn_high boolean, co_changed int, too_large boolean, has_tests boolean, changed_dependency boolean, dependent boolean",
    )
    fields = spark.createDataFrame([], "path string, field string, pos int, value string")
    imports = spark.createDataFrame([], "src string, dst string")
    got = {r.path: (r.score, r.reasons) for r in G.score(G.evidence(tasks, files, fields, imports, F.lit(False))).collect()}
    assert "src/other.py" not in got
    assert got["src/checkout_totals.py"][1] == ["filename", "path phrase", "multi-term path", "content", "phrase"] and "modified" in got["lib/checkout.py"][1]
    assert got["src/checkout_totals.py"][0] > got["lib/checkout.py"][0] > 100


FIELDS = "task_id int, path string, score double, reasons array<string>, hits long, tokens long, summary_tokens long, skeleton_tokens long, changed boolean, secret boolean"


def receipts(spark, rows, **rules):
    out = L.select_files(spark.createDataFrame(rows, FIELDS), L.Rules(**rules))
    return out, [(r.path, r.action, r["mode"], r.tokens, r.reason) for r in out.orderBy("step").collect()]


def test_selection_modes_and_downgrade(spark):
    rows = [
        (1, "src/a.py", 300.0, ["symbol", "calls"], 5, 500, 50, 90, True, False), (1, "src/b.py", 200.0, ["calls", "symbol"], 4, 900, 60, 120, False, False), (1, "src/c.py", 100.0, ["calls"], 3, 900, 60, None, False, False),
        (1, "src/d.py", 0.0, ["calls"], 3, 10, 5, None, False, False), (1, "docs/x.md", 90.0, ["calls"], 3, 10, 5, None, False, False), (1, "src/e.py", 150.0, ["calls"], 3, 20, 15, None, False, True),
    ]
    _, got = receipts(spark, rows, budget=700)
    assert got[0] == ("src/a.py", "included", "full", 500, "symbol, calls")
    by_path = {p: (a, m, t) for p, a, m, t, _ in got}
    assert by_path["src/b.py"] == ("summarized", "skeleton", 120) and by_path["src/c.py"] == ("summarized", "summary", 60) and by_path["src/e.py"] == ("included", "full", 20)
    assert by_path["src/d.py"][0] == by_path["docs/x.md"][0] == "excluded"
    # a file that doesn't fit whole comes as its cheaper form
    _, tight = receipts(spark, [rows[0]], budget=100)
    assert tight == [("src/a.py", "summarized", "summary", 50, "symbol, calls")]


def test_selection_displaces_weaker_files(spark):
    weak = (1, "src/app/weak.py", 400.0, ["secret", "implementation"], 0, 400, 100, None, False, False)
    strong = (1, "src/app/strong.py", 90.0, ["calls", "symbol", "phrase", "direct content"], 6, 400, 80, None, False, False)
    out, got = receipts(spark, [weak, strong], summaries=1)
    assert [(p, a) for p, a, *_ in got] == [("src/app/weak.py", "summarized"), ("src/app/weak.py", "excluded"), ("src/app/strong.py", "summarized")]
    assert {r.path for r in L.selected(out).collect()} == {"src/app/strong.py"}
    assert [tuple(r) for r in L.handoff(out).select("bucket", "n").collect()] == [("marginal_slot_replaced", 1)]


def test_selection_caps_families_and_the_budget(spark):
    rows = [(1, f"config/c{i}.toml", 100.0 - i, ["config", "dependency"], 3, 300, 40, None, False, False) for i in range(5)] + [(2, f"src/f{i}.py", 100.0 - i, ["calls"], 3, 300, 40, None, False, False) for i in range(40)]
    out, got = receipts(spark, rows, budget=200, summaries=0)
    taken = {(r.task_id, r.path) for r in L.selected(out).collect()}
    assert {p for t, p in taken if t == 1} == {"config/c0.toml"} and len([p for t, p in taken if t == 2]) == 5
    assert sum(r.action == "excluded" for r in out.collect()) == 39 and L.select_files(spark.createDataFrame(rows, FIELDS).limit(0)).count() == 0


def test_boosts_of_a_path_are_summed_and_capped(spark):
    tasks = spark.createDataFrame([(1, t) for t in "abcde"], "task_id int, term string")
    records = spark.createDataFrame([(r, t) for r in range(3) for t in "abcde"] + [(9, "z")], "record int, term string")
    paths = spark.createDataFrame([(0, "p"), (1, "p"), (2, "p"), (0, "q"), (9, "r")], "record int, path string")
    assert {r.path: r.boost for r in H.feedback_boosts(tasks, records, paths).collect()} == {"p": 60.0, "q": 30.0}
    files = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, hash string")
    touched = spark.createDataFrame([(0, "p", "1"), (1, "q", "old"), (2, "q", None)], "record int, path string, hash string")
    assert {r.path: r.boost for r in H.episode_boosts(tasks, records, touched, files).collect()} == {"p": 12.0, "q": 12.0}


def test_done_rows_are_passed_over(spark):
    rows = spark.createDataFrame([("a", 1, "work", "2024-01-01 10:00:00"), ("a", 2, "done", "2024-01-01 11:00:00"), ("b", 3, "work", "2023-12-30 10:00:00"), (None, 4, "work", "2024-01-01 10:00:00")], "thread string, id int, status string, t string")
    rows = rows.withColumn("ts", F.to_timestamp("t")).drop("t")
    assert [(r.thread, r.id) for r in H.active_threads(rows, F.to_timestamp(F.lit("2024-01-01 12:00:00"))).collect()] == [("a", 1)]


def test_progress_equals_a_plain_fold(spark):
    import random

    r = random.Random(3)
    rows = [(k, i, "t", r.choice((0, 5, 40, 90))) for k in range(6) for i in range(r.randint(1, 25))]
    want = {}
    for k, _, _, x in sorted(rows):
        n, c = want.get(k, (0, 0))
        n += 1
        want[k] = (n, min(100, x) if not c else min(100, max(c, x) + min(10, n)))
    got = {s.skill: (s.tasks, s.confidence) for s in H.skill_progress(spark.createDataFrame(rows, "skill int, at int, task string, confidence int")).collect()}
    assert got == want


def test_diverse_picks(spark):
    scored_ = spark.createDataFrame([(1, "a", 90.0), (1, "b", 85.0), (1, "c", 60.0), (2, "a", 1.0)], "task_id int, skill string, score double")
    profiles = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "y"]), ("c", ["z"])], "skill string, terms array<string>")
    got = sorted((r.task_id, r.place, r.skill) for r in S.diverse(scored_, profiles, 2).collect())
    assert got == [(1, 1, "a"), (1, 2, "c"), (2, 1, "a")]


def test_redaction_of_every_kind(spark):
    a, mixed = "a1B2" * 10, "a1/B" * 10
    text = f"x\nAKIA{'A1B2' * 4} and ghp_{a}\ntoken = {'ghp_' + a}\nAWS_SECRET_ACCESS_KEY = '{mixed}'\napi_key = \"your_api_key_here\"\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")
    got = {r.doc_id: r for r in V.redact_secrets(df).collect()}
    assert got[1].text == 'x\n[REDACTED:aws-access-key] and [REDACTED:github-token]\ntoken = [REDACTED:github-token]\nAWS_SECRET_ACCESS_KEY = \'[REDACTED:aws-secret-key]\'\napi_key = "your_api_key_here"\n'
    assert got[1].warnings == ["aws-access-key (line 2)", "aws-secret-key (line 4)", "github-token (line 2)", "github-token (line 3)"]
    assert got[2].text is None and got[3].text == "plain" and got[3].warnings == []


def test_ranges_of_a_diff(spark):
    lines = ["+++ b/x", "+lost", "@@ -1,2 +10,3 @@", " a", "+b", "+c", "-d", "+e", "\\ No newline", "@@ -9 +40 @@", "+f"]
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(lines)], "path string, line int, value string")
    assert sorted((r["first"], r["last"], r.n) for r in V.changed_ranges(df).collect()) == [(11, 12, 2), (13, 13, 1), (40, 40, 1)]


def test_symbols_and_imports(spark):
    go = "package x\nimport (\n  \"fmt\"\n)\nfunc (r *R) Run(a int) {\nfunc main() {\ntype T struct {"
    js = "import a from './a'\nexport const f = (x) => 1\nclass K {\nconst y = require(\"y\")\nexport async function g(a) {"
    df = spark.createDataFrame([("a.go", go)], "path string, text string")
    assert sorted((s.line, s.name, s.kind) for s in C.symbols(df, "go").collect()) == [(5, "Run", "method"), (6, "main", "function"), (7, "T", "class")]
    assert {s.name for s in C.imports(df, "go").collect()} == {"fmt"}
    df = spark.createDataFrame([("a.ts", js)], "path string, text string")
    assert sorted((s.line, s.name, s.kind) for s in C.symbols(df, "javascript").collect()) == [(2, "f", "function"), (2, "f", "variable"), (3, "K", "class"), (5, "g", "function")]
    assert {s.name for s in C.imports(df, "javascript").collect()} == {"./a", "y"}


def test_relative_imports_resolve_at_any_depth(spark):
    paths = ["src/a.ts", "src/b.js", "src/b.ts", "src/c/index.tsx", "top.js", "src/a/b/c.ts", "src/x.ts", "pkg/__init__.py", "pkg/util.py", "pkg/sub/mod.py", "pkg/sub/__init__.py", "index.js"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    wanted = {
        ("src/a.ts", "./b", "javascript"): "src/b.ts", ("src/a.ts", "./c", "javascript"): "src/c/index.tsx", ("src/a.ts", "../top", "javascript"): "top.js", ("src/a.ts", "./none", "javascript"): None, ("src/a.ts", "react", "javascript"): "react",
        ("src/a/b/c.ts", "../../x", "javascript"): "src/x.ts", ("src/a/b/c.ts", "../../../top", "javascript"): "top.js", ("src/a/b/c.ts", "../../../../top", "javascript"): None, ("src/a.ts", "..", "javascript"): "index.js", ("src/a.ts", "./c/../b.js", "javascript"): "src/b.ts",
        ("pkg/sub/mod.py", "..util", "python"): "pkg/util.py", ("pkg/sub/mod.py", ".", "python"): "pkg/sub/__init__.py", ("pkg/util.py", ".sub.mod", "python"): "pkg/sub/mod.py", ("pkg/util.py", ".sub", "python"): "pkg/sub/__init__.py", ("pkg/util.py", ".....pkg.util", "python"): "pkg/util.py",
        ("pkg/util.py", ".gone", "python"): None, ("pkg/util.py", "os", "python"): "os",
    }
    found = spark.createDataFrame(list(wanted), "path string, name string, language string")
    resolved = M.resolve(found, files)
    assert {(r.path, r.name, r.language): r.target for r in resolved.collect()} == wanted
    nodes = {r.path: (r.imports, r.packages, r.missing, r.imported_by) for r in M.nodes(files, resolved).collect()}
    assert nodes["src/a.ts"] == (4, 1, 1, 0) and nodes["top.js"] == (0, 0, 0, 2) and nodes["pkg/util.py"] == (3, 1, 1, 2) and nodes["src/b.js"] == (0, 0, 0, 0)


def test_what_imports_reach(spark):
    own = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("f",)], "path string")
    assert {(r.seed, r.path, r.hops) for r in M.reached(own, seeds, 3).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("f", "f", 0)}


def test_a_line_of_python_imports_several(spark):
    text = "import os, sys as s, a.b\nfrom ..pkg.m import (x, y)\nfrom . import z\n  import one  # two, three\nimportant = 1"
    df = spark.createDataFrame([("a.py", text)], "path string, text string")
    assert {s.name for s in C.imports(df, "python").collect()} == {"os", "sys", "a.b", "..pkg.m", ".", "one"}


def test_lessons_by_terms(spark):
    rows = spark.createDataFrame([(1, "Use Caching and caching", 10, True, False), (2, "mute caching", 90, False, True), (3, None, 5, False, False), (4, "help", 5, False, True)], "id long, rule string, confidence int, accepted boolean, evidenced boolean")
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    assert [tuple(r) for r in H.lessons(rows, terms("CACHING", "use"), terms("help"), terms("mute"), 9).collect()] == [(1, 60), (4, 40), (3, 5)]


def test_phrases_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(PH, "BLOCK", 4)
    texts = spark.createDataFrame([(1, "one", "accurate limits two"), (2, "a b", "c"), (3, None, None), (4, "", "x")], "id int, head string, text string")
    phrases = spark.createDataFrame([(p,) for p in ("rate lim", "one acc", "one", "two", "b c", "x", "", "none", "one")], "phrase string")
    assert {(r.id, r.phrase, r.in_head) for r in PH.contained(texts, phrases, "head").collect()} == {(1, "rate lim", False), (1, "one acc", False), (1, "one", True), (1, "two", False), (2, "b c", False), (4, "x", False)}
    assert PH.contained(texts, phrases.limit(0), "head").count() == 0


def test_workspaces(spark):
    paths = spark.createDataFrame([("packages/a/package.json",), ("packages/a/b/package.json",), ("apps/x/y.py",), ("package.json",)], "path string")
    assert [tuple(r) for r in O.workspace_roots(paths, ["packages/*"], ["package.json"]).collect()] == [("packages/a", 2)]


def test_branch_lines(spark):
    got = column(spark, ["main...origin/main [ahead 2, behind 1]", "HEAD (no branch)", "topic"], C.branch_status)
    assert [tuple(r) for r in got] == [("main", "origin/main", 2, 1), (None, None, 0, 0), ("topic", None, 0, 0)]


def test_selection_under_many_changed_files(spark):
    rows = [(1, f"src/f{i}.py", 100.0 - i, ["modified"], 0, 300, 40, None, True, False) for i in range(9)] + [(1, "src/task.py", 300.0, ["modified", "symbol"], 3, 700, 40, None, True, False)]
    _, got = receipts(spark, rows, budget=20_000)
    by_path = {p: (a, m, why) for p, a, m, _, why in got}
    assert [a for p, (a, _, _) in by_path.items() if p != "src/task.py"].count("excluded") == 6 and by_path["src/f8.py"][2] == "unrelated changed-file cap"
    assert by_path["src/task.py"][1] == "symbols"  # under pressure, however large the budget
    _, few = receipts(spark, rows[:5], budget=20_000)
    assert all(a == "included" for _, a, *_ in few)
    _, bare = receipts(spark, [(1, "src/x.py", 50.0, [], 9, 30, 5, None, True, False)])
    assert bare[0][4] == "changed"


def test_a_phrase_alone_brings_a_file_and_scopes_dampen(spark):
    tasks = spark.createDataFrame([(1, 'fix(web-shop): the "rate lim" case'), (2, "other words entirely")], "task_id int, task string")
    base = (False, False, False, False, 0, False, False, None, None)
    files = spark.createDataFrame([("x/one.py", "accurate limits", *base), ("packages/web-shop/two.py", "accurate limits", *base), ("x/none.py", "nothing", *base)], "path string, text string, changed boolean, staged boolean, recent boolean, churn_high boolean, co_changed int, too_large boolean, has_tests boolean, changed_dependency boolean, dependent boolean")
    fields = spark.createDataFrame([], "path string, field string, pos int, value string")
    imports = spark.createDataFrame([], "src string, dst string")
    score = lambda roots: {(r.task_id, r.path): (r.score, r.reasons) for r in G.score(G.evidence(tasks, files, fields, imports, F.lit(False), roots)).collect()}
    plain = score(None)
    assert "literal" in plain[1, "x/one.py"][1] and (1, "x/none.py") not in plain and not [k for k in plain if k[0] == 2]
    rooted = score(spark.createDataFrame([("packages/web-shop",), ("packages/web",)], "root string"))
    assert rooted[1, "x/one.py"][0] == round(plain[1, "x/one.py"][0] * 0.62, 2) and "scope mismatch" in rooted[1, "x/one.py"][1]
    assert rooted[1, "packages/web-shop/two.py"] == plain[1, "packages/web-shop/two.py"]


def test_only_what_misses_is_made(spark):
    made = []
    make = lambda df: made.append(df.count()) or df.select("path", F.length("hash").alias("size"))
    files = lambda *rows: spark.createDataFrame(rows, "path string, hash string")
    none = spark.createDataFrame([], "path string, size int, key string")
    first, _ = N.refreshed(files(("a", "1"), ("b", "22")), none, make)
    second, _ = N.refreshed(files(("a", "1"), ("b", "333"), ("c", "4")), first.unionByName(first), make)
    third, new = N.refreshed(files(("a", "1"), ("b", "333"), ("c", "4")), second, make)
    assert made == [2, 2, 0] and new.count() == 0
    assert sorted((r.path, r["size"]) for r in third.collect()) == [("a", 1), ("b", 3), ("c", 1)]


def test_strata_do_not_depend_on_partitions(spark):
    cases = spark.createDataFrame([(s, k) for s in ("x", "y") for k in range(300)] + [("x", 7)] * 3, "stratum string, id int")
    one, two = (sorted(map(tuple, V2.stratified(cases.repartition(n), ["stratum"], "id", {"x": 5}, 9).collect())) for n in (1, 7))
    assert one == two and len(one) == 14


def test_hunks_within_a_budget(spark):
    hunks = ["@@ -1 +1 @@\n+plain change", "@@ -9 +9 @@\n-old limiter\n+new limiter\n+more", "@@ -20 +20 @@\n" + "+long " * 60, "@@ -40 +40 @@\n context"]
    diff = "--- a\n+++ b\n" + "\n".join(hunks)
    df = spark.createDataFrame([("p", diff), ("bare", "--- a\n+++ b"), ("big", hunks[2]), ("null", None)], "path string, text string")
    words = spark.createDataFrame([("LIMITER",), ("of",)], "term string")
    got = {r.path: (r.text, r.kept, r.omitted) for r in V.hunks_within(df, words, 28).collect()}
    assert got["p"] == ("--- a\n+++ b\n... 1 less relevant diff hunk(s) omitted ...\n" + "\n".join([hunks[0], hunks[1], hunks[3]]), 3, 1)
    assert got["bare"] == ("--- a\n+++ b", 0, 0) and got["big"] == ("@@ -20 +20 @@", 1, 0)
    whole = {r.path: r.kept for r in V.hunks_within(df, words, 5000).collect()}
    assert whole["p"] == 4 and whole["big"] == 1
