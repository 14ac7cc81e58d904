"""Work that must grow with the input and not with pairs of its rows, and the results that must stay the same."""

import itertools

from pyspark.sql import functions as F

from siltstone.operators import boosts as B
from siltstone.operators import facts as A
from siltstone.operators import history as H
from siltstone.operators import relations as R
from siltstone.operators import scoring as S
from siltstone.operators import skills as K


def moved(spark, df):
    """Rows of the frame, and how many rows its run has handed on in shuffles."""
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = df.collect()
    return rows, written() - before


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_boosts_by_hot_terms_make_no_pairs(spark):
    """Every task shares a term with every record: the cap is known from counts."""
    n = 1000
    tasks = spark.range(n).select(F.col("id").alias("task_id"), F.lit("hot").alias("term"))
    records = spark.range(n).select(F.col("id").alias("record"), F.lit("hot").alias("term"))
    paths = spark.range(n).select(F.col("id").alias("record"), F.concat(F.lit("f"), F.col("id") % 5).alias("path"))
    rows, shuffled = moved(spark, H.feedback_boosts(tasks, records, paths))
    assert len(rows) == n * 5 and {r["boost"] for r in rows} == {60.0}
    assert shuffled < n * n / 10


def test_boosts_equal_sums_over_pairs(spark):
    terms = {t: [f"w{t * k % 11}" for k in (1, 3, 4)] + (["rare"] if t % 9 == 0 else []) for t in range(40)}
    terms[40], terms[41] = ["alone"], ["alone", "w1", "w2"]
    held = {r: [f"w{r * 5 % 13}", f"w{r % 17}"] + (["alone"] if r == 3 else []) for r in range(12)}
    where = [(r, f"f{r % 4}") for r in held] + [(3, "f9"), (5, "f9"), (5, None)]
    want = {}
    for (t, mine), (r, path) in itertools.product(terms.items(), where):
        if n := len(set(mine) & set(held[r])):
            want[t, path] = want.get((t, path), 0.0) + 18.0 + min(12.0, 3.0 * n)
    tasks = frame(spark, [(t, w) for t, ws in terms.items() for w in ws], "task_id long, term string")
    records = frame(spark, [(r, w) for r, ws in held.items() for w in ws], "record long, term string")
    got = H.feedback_boosts(tasks, records, frame(spark, where, "record long, path string")).collect()
    assert {(r["task_id"], r["path"]): r["boost"] for r in got} == {k: min(60.0, v) for k, v in want.items()} and len(got) == len(want)


def _matching(spark, n_tasks, n_skills):
    words = ["test", "src", "api", "users", "alpha", "beta", "gamma", "delta"]
    pick = lambda i, *ks: [words[i * k % 8] for k in ks]
    tasks = [(t, [*pick(t, 1, 3), f"own{t}"] if t else None, [["docs"], ["test"]][t % 2], ["src", "api"]) for t in range(n_tasks)]
    skills = [(s, None if s == 7 else [*pick(s, 1, 5), str(s)], [["docs"], ["test"], ["other"]][s % 3], [["users"], ["zz"]][s % 2], [None, "none", "command", "external"][s % 4], None if s == 5 else s * 37 % 130) for s in range(n_skills)]
    history = [(s, (s % 11 - 3) / 5.0) for s in range(0, n_skills, 7)] + [(1, None)]
    return (
        frame(spark, tasks, "task_id long, terms array<string>, kinds array<string>, path_terms array<string>"),
        frame(spark, skills, "skill long, terms array<string>, kinds array<string>, anti array<string>, side_effect string, priority int"), frame(spark, history, "skill long, success double"),
    ), tasks, skills, dict(history)


def test_skill_pairs_are_not_shuffled(spark):
    frames, tasks, skills, history = _matching(spark, 120, 240)
    rows, shuffled = moved(spark, K.match_skills(*frames))
    want = {}
    for t, terms, kinds, paths in tasks:
        for s, held, own, anti, effect, priority in skills:
            both, near, typed = set(terms or []) & set(held or []), set(paths) & set(held or []), set(kinds) & set(own)
            if both or near or typed:
                score = 35 * bool(typed) + 10 * min(8, len(both)) + 6 * min(6, len(near)) + 18 * ("test" in both) - 35 * bool({*(terms or []), *paths} & set(anti))
                score += {"none": 4, "command": -4, "external": -10, None: 0}[effect]
                want[t, s] = round(score + max(0.0, min(1.0, history.get(s) or 0.0) * 15) + min(100, 100 if priority is None else priority) / 10, 4)
    assert {(r["task_id"], r["skill"]): r["score"] for r in rows} == want and len(rows) == len(want)
    assert shuffled < 1000 < len(rows)


def test_diverse_matches_equal_picks_among_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 16)
    monkeypatch.setattr(K, "BLOCK", 8)
    frames, *_ = _matching(spark, 30, 90)
    want = K.diverse(K.match_skills(*frames), frames[1], 3).collect()
    assert sorted(map(tuple, K.diverse_matches(*frames, 3).collect())) == sorted(map(tuple, want)) and len(want) == 90


def test_names_are_taken_apart_once_for_all_tasks(spark):
    """Tests meet sources by parts of their names, which don't depend on the task."""
    n, tasks = 12, 50
    rows = [(t, f"src/module_{i}_{'x' * 12}.py", 50.0 + i, ["filename"]) for t in range(tasks) for i in range(n)] + [(t, f"tests/test_module_{i}_{'x' * 12}.py", 5.0, []) for t in range(tasks) for i in range(n)]
    scored = frame(spark, rows, "task_id long, path string, score double, reasons array<string>")
    got, shuffled = moved(spark, B.paired_tests(scored))
    raised = {(r["task_id"], r["path"]) for r in got if r["score"] == 40.0}
    assert raised == {(t, f"tests/test_module_{i}_{'x' * 12}.py") for t in range(tasks) for i in range(n // 2, n)}
    assert len(got) == len(rows) and shuffled < 40_000


def test_pairs_of_changes_are_dealt_over_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(R, "DEALT", 100)
    rows = [(c, f) for c in range(300) for f in (c % 7, c % 5 + 10, c % 7)] + [(None, 1), (None, 2), (1, None)]
    got = R.co_change(frame(spark, rows, "commit int, file int"))
    want = {}
    for c in range(300):
        want[c % 7, c % 5 + 10] = want.get((c % 7, c % 5 + 10), 0) + 1
    assert {(r.a, r.b): r.commits for r in got.collect()} == want
    assert got.rdd.getNumPartitions() == 10


def test_pairs_of_tasks_and_files_are_not_shuffled(spark, monkeypatch):
    """Every task shares a term with every file; blocks of tasks and chunks of files give the same points."""
    n = 60
    tasks = spark.range(n).select("id", F.format_string("repair checkout totals of word%d", "id").alias("task")).select(F.col("id").alias("task_id"), "task")
    flags = dict.fromkeys(("changed", "staged", "recent", "churn_high", "too_large", "has_tests"), F.lit(False)) | {"co_changed": F.lit(0), "changed_dependency": F.lit(None).cast("boolean"), "dependent": F.lit(None).cast("boolean")}
    files = spark.range(n).select(F.format_string("src/f%d_checkout.py", "id").alias("path"), F.format_string("Totals and word%d, rateLimit", "id").alias("text")).withColumns(flags)
    fields = files.select("path", F.lit("calls").alias("field"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")).withColumn("value", F.concat(F.lit("repair v"), "pos"))
    imports = frame(spark, [("src/f1_checkout.py", "src/f2_checkout.py")], "src string, dst string")
    points = lambda: moved(spark, S.score(S.evidence(tasks, files, fields, imports, F.lit(False))))
    rows, shuffled = points()
    assert len(rows) == n * n and shuffled < n * n
    got = {(r.task_id, r.path): (r.score, r.reasons) for r in rows}
    assert "multi-term path" not in got[5, "src/f5_checkout.py"][1] and got[5, "src/f5_checkout.py"][0] > got[5, "src/f6_checkout.py"][0] and "dependency" in got[5, "src/f1_checkout.py"][1] and "calls" in got[5, "src/f1_checkout.py"][1]
    monkeypatch.setattr(A, "BLOCK", 50)
    monkeypatch.setattr(A, "CELLS", 64)
    assert {(r.task_id, r.path): (r.score, r.reasons) for r in points()[0]} == got


def test_paths_are_made_of_the_texts_once(spark):
    """What follows the paths of imports reads no texts."""
    from siltstone.plans.imports import found

    rows, own = found(spark, "/root/testdata/sf0.001")
    assert not [f for df in (rows, own) for f in df.inputFiles() if "documents.parquet" in f] and own.count() == 200


def test_only_parts_of_names_that_a_source_may_have_are_handed_on(spark):
    names = ["", "a", "ser", "üs", "user", "users_1", "9", "x.y", "test_user"]
    stems = ["users_12", "test_user", "üser", "x.y.z", "", *(f"longer_name_of_module_{i}" for i in range(200))]
    tests = frame(spark, [(f"t{i}/{s}.py",) for i, s in enumerate(stems)] + [(None,)], "test string")
    sources = frame(spark, [(f"s{i}/{s}.py",) for i, s in enumerate(names)] + [("s0/.py",), (None,)], "source string")
    stem = lambda path: path.split("/")[1][:-3] or ".py"
    rows, shuffled = moved(spark, B.pair_tests(tests, sources))
    assert sorted(map(tuple, rows)) == sorted({(t, s) for t, in tests.collect() if t for s, in sources.collect() if s and stem(s) in stem(t)}) and len(rows) > 200
    assert shuffled < 5000


def test_texts_are_not_shuffled_to_choose_a_pack(spark):
    """Records and contents are chosen in place; every secret of a column is redacted and other columns stay."""
    from siltstone.operators.provenance import redact_secrets
    from siltstone.plans.packs import _inputs

    _, taken, _, _ = _inputs(spark, "/root/testdata/sf0.001")
    assert "SortMergeJoin" not in taken._jdf.queryExecution().executedPlan().toString()
    key = "password:　" + "k3" * 20
    rows = frame(spark, [(1, "x", key), (2, "y", None), (3, "z", "plain")], "id int, other string, body string")
    got = {r.id: (r.other, r.body, r.warnings) for r in redact_secrets(rows, "body").collect()}
    assert got == {1: ("x", "password:　[REDACTED:api-key]", ["api-key (line 1)"]), 2: ("y", None, []), 3: ("z", "plain", [])}


def test_values_of_texts_are_found_where_they_are_counted(spark):
    """No list of a text's values is made for the pass that counts them; finders find what their patterns do, and counts are those of the files' rows."""
    from siltstone.plans import scoring as Q

    odd = ["", ",", ",,abcd", "abc,abcd,Xabcd, éabcd,ab\ncd ef gh,", "\nAb Cd\nab  cd\n\nQw er", "Ab Cd,\r\nno way\x00\nßa b", "x abcdE,efgh\u2028ij kl,\U0001f600mnop,", "camelCase Words,\nfoo bar baz,,word,", "\n", "a b\n"]
    rows = frame(spark, [(i, x) for i, x in enumerate(odd)], "i int, text string")
    for field, pattern in (("defines", Q.DEFINES), ("calls", Q.CALLS)):
        assert {r.i: r.found for r in rows.select("i", F.regexp_extract_all("text", F.lit(pattern), 1).alias("found")).collect()} == {i: Q.FINDERS[field](x) for i, x in enumerate(odd)}
    texts = S._ready(Q.texts(spark, "/root/testdata/sf0.001"), None)
    assert "regexp_extract_all" not in texts._jdf.queryExecution().executedPlan().toString()
    own = frame(spark, [(None, "lost words,", []), ("src/fooBar_baz.py", "Foo bar\nfixed,foo,word,word,", [("role", 0, "sourceFile"), ("domain", 0, None)]), ("tests/word_foo.py", None, None), ("..", "\nFoo bar", [])], "path string, text string, values array<struct<field:string,pos:int,value:string>>")
    terms, phrases = ["bar", "fixed", "foo", "source", "word"], ["foo bar", "source file", "word foo"]
    count = lambda ready, *known: {r.i: r.n for r in A.occurring(ready, *known, Q.FINDERS).groupBy("i").agg(F.sum("n").alias("n")).collect()}
    assert count(S._ready(own, None), terms, phrases) == {-1: 2, 0: 2, 1: 1, 2: 3, 3: 1, 4: 2, 5: 2, 6: 1, 7: 1}
    for ready, known in ((S._ready(own, None), (terms, phrases)), (texts, S.wanted(Q.item_tasks(spark, "/root/testdata/sf0.001")))):
        held = A.held(ready, *known, S.NAMES, Q.FINDERS).select(F.explode("held").alias("i")).groupBy("i").count()
        assert count(ready, *known) == {r["i"]: r["count"] for r in held.collect()}


def test_boosts_are_asked_for_by_every_task(spark):
    """No task that has a term is left out, neither by the code nor by the SQL."""
    import duckdb

    from siltstone.plans import history as Q
    from siltstone.plans.registry import ORACLES

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.sql(f"create view conversations as from '{sf}/conversations.parquet'")
    asked = {r.task_id for r in Q.tasks(spark, sf).select("task_id", F.explode(Q.K.episode_terms(F.col("task")))).collect()}
    assert any(t % 20 for t in asked)
    assert {r.task_id for r in Q.missed_boosts(spark, sf).collect()} == asked == {t for t, in con.sql(f"select distinct task_id from ({ORACLES['missed_boosts']})").fetchall()}


def test_cells_of_skills_and_tasks_are_dealt_over_spark_tasks(spark, monkeypatch):
    """Chunks of skills don't end up in a few of Spark's tasks; cells of any size give the same pairs."""
    frames, *_ = _matching(spark, 30, 240)
    want = sorted(map(tuple, K.match_skills(*frames).collect()))
    monkeypatch.setattr(K, "CHUNK", 16)
    monkeypatch.setattr(K, "BLOCK", 8)
    got = K.match_skills(*frames)
    assert got.rdd.getNumPartitions() >= 240 // 16
    assert sorted(map(tuple, got.collect())) == want


def test_picks_are_dealt_over_spark_tasks(spark, monkeypatch):
    """Each pick is a pass over as many partitions as there are chunks of skills."""
    monkeypatch.setattr(K, "CHUNK", 16)
    seen, grid = [], K._grid
    monkeypatch.setattr(K, "_grid", lambda *args: seen.append(grid(*args)) or seen[-1])
    K.diverse_matches(*_matching(spark, 20, 160)[0], 2)
    assert len(seen) == 2 and min(df.rdd.getNumPartitions() for df in seen) >= 10


def test_shared_terms_are_counted_alike_whether_frequent_or_rare(monkeypatch):
    import pyarrow as pa

    left = [["a", "b", "b", None, f"r{i % 3}"] if i % 4 else None for i in range(20)]
    right = [["b", "c", "r1"], [], None, ["a", "b", "r0", "r2"]]
    want = [[len({*(x or [])} & {*(y or [])} - {None}) for y in right] for x in left]
    column = lambda rows: [pa.array(rows, pa.list_(pa.string()))]
    for dense in (0, 2, 64):
        monkeypatch.setattr(K, "DENSE", dense)
        a, b = K._held(column(left), column(right))
        assert K._meet(a, b).tolist() == want and K._meet(a.rows(5, 11), b).tolist() == want[5:11]
    assert a.sizes.tolist() == [3 if i % 4 else 0 for i in range(20)] and b.sizes.tolist() == [3, 0, 0, 4]


def test_sums_are_rounded_as_columns_are(spark):
    import numpy as np

    odd = [0.0, -0.0, 0.00005, -0.00005, 0.00004, -0.00001, 1.00005, 2.67495, 1.00015, 45.12345, -7.12345, 0.1 + 0.2, 1e15 / 3, 3.0e17, 12345.678949999999, 99.99995]
    want = [r[0] for r in frame(spark, [(x,) for x in odd], "x double").select(F.round("x", 4)).collect()]
    assert K._rounded(np.array([odd])).tolist() == [want]


def _candidates(spark, n_tasks, n_files, seed):
    import random

    from siltstone.operators import selector as L

    pick = random.Random(seed)
    words = [*L.DIRECT, *L.ACTIONABLE, *L.SUPPORTING, *L.EXPANSION, *L.STANDING_ONLY, "config", "knowledge", "test for a.py", "neighbour of x", "multi-term path", "role", "cross-layer", "test asked for"]
    places = ["src/api/f{}.py", "tests/test_f{}.py", "docs/f{}.md", "config/f{}.yml", "examples/f{}.py", "f{}.go", "packages/web/src/pages/f{}.tsx", "package-lock{}.json", "deploy/manifest{}.yml", "CHANGELOG{}.md", "playground/p{}/f.py", "packages/a/src/b/c/f{}.ts"]
    maybe = lambda x: None if pick.random() < 0.3 else x
    rows = []
    for t in range(n_tasks):
        many = pick.choice([0.0, 0.002, 0.2])  # of changed files
        for f in range(n_files):
            tokens = pick.choice([0, 20, 90, 300, 900, 5000])
            rows.append((t, pick.choice(places).format(f), pick.choice([-5.0, 0.0]) if pick.random() < 0.05 else round(pick.random() * pick.choice([50, 200, 700]), 1), pick.sample(words, pick.randint(0, 5)), pick.choice([None, 0, 1, 3, 9]), tokens, maybe(min(tokens, 60)), maybe(tokens // 4), pick.random() < many, pick.random() < 0.02))
    return frame(spark, rows, "task_id long, path string, score double, reasons array<string>, hits long, tokens long, summary_tokens long, skeleton_tokens long, changed boolean, secret boolean")


def test_chosen_files_are_those_of_the_receipts(spark, monkeypatch):
    """The fold that passes over rows takes the same files in the same modes, under any rules."""
    from siltstone.operators import selector as L

    rows = _candidates(spark, 24, 300, 7).cache()
    total = 0
    for rules in (L.Rules(budget=8000), L.Rules(budget=900), L.Rules(budget=150), L.Rules(mode="deep", budget=4000), L.Rules(strict=False), L.Rules(summaries=0, budget=3000), L.Rules(summaries=-1), L.Rules(summaries=3, weak_signals=-1), L.Rules(least_score=90.0, weak_signals=0, most_tokens=200)):
        want = sorted(map(tuple, L.selected(L.select_files(rows, rules)).collect()), key=str)
        assert sorted(map(tuple, L.chosen(rows, rules).collect()), key=str) == want, rules
        total += len(want)
    assert total > 300
    assert L.chosen(rows.limit(0)).count() == 0


def test_few_rows_are_looked_at_one_by_one(monkeypatch):
    """A row that can't displace what is selected is passed over."""
    import numpy as np

    from siltstone.operators import selector as L

    n, seen, take = 5000, [], L.Choice.take
    monkeypatch.setattr(L.Choice, "take", lambda self, r: seen.append(r["path"]) or take(self, r))
    flags = {f: np.zeros(n, bool) for f in L._FLAGS} | {"support": np.ones(n, bool), "signal": np.ones(n, bool)}
    numbers = {"score": np.linspace(900, 100, n), "hits": np.ones(n, int), "tokens": np.full(n, 100), "evidence": np.full(n, 200.0), "summary_tokens": np.full(n, 50), "skeleton_tokens": np.full(n, -1), "cap": np.full(n, -1)}
    more = {"no_summary_tokens": np.zeros(n, bool), "no_skeleton_tokens": np.ones(n, bool), "no_cap": np.ones(n, bool), "families": [], "family": np.full(n, -1), "cheapest": np.full(n, 50), "whole": np.zeros(n, bool), "most": np.full(n, 224.0)}
    more |= {k: __import__("pyarrow").array([f"f{i}" if k == "path" else None for i in range(n)]) for k in ("path", "scope")}
    choice = L.Choice(L.Rules(budget=8000), False)
    choice.take_all(flags | numbers | more, 0, n)
    assert seen == [f"f{i}" for i in range(8)] == [p["path"] for p in choice.picked]


def test_rows_without_gains_are_not_shuffled_for_them(spark):
    """Medians are told from counts; tests and what is near a seed are looked up where the rows are."""
    tasks, n = 20, 600
    rows = [(t, f"src/m{i}_q.py", 20.0 + i % 10, ["filename"]) for t in range(tasks) for i in range(n)] + [(t, f"tests/test_m{i}_q.py", 5.0, []) for t in range(tasks) for i in (3, 9)]
    scored = frame(spark, rows, "task_id long, path string, score double, reasons array<string>")
    got, shuffled = moved(spark, B.paired_tests(scored))
    raised = {(r["task_id"], r["path"], r["reasons"][0]) for r in got if r["path"].startswith("tests/") and r["score"] == 40.0}
    assert raised == {(t, "tests/test_m9_q.py", "test for src/m9_q.py") for t in range(tasks)} and len(got) == len(rows)
    assert shuffled < len(rows) / 2
    edges = frame(spark, [("src/m599_q.py", "src/m1_q.py"), ("src/m1_q.py", "src/m2_q.py")], "src string, dst string")
    strong = scored.withColumn("score", F.when(F.col("path") == "src/m599_q.py", 500.0).otherwise(F.col("score")))
    got, shuffled = moved(spark, B.second_pass(strong, edges, frame(spark, [(t, "src") for t in range(0, tasks, 2)], "task_id long, term string")))
    assert {(r["task_id"], r["path"]) for r in got if "second pass" in r["reasons"]} <= {(t, "src/m2_q.py") for t in range(tasks)} and len(got) == len(rows)
    assert shuffled < len(rows) / 2


def test_a_task_is_one_stream_whatever_the_join_becomes(spark):
    """Where a join by task is planned with a shuffle and run as a broadcast, a task still has one budget."""
    from siltstone.operators import selector as L

    rows = spark.range(0, 4000, 1, 4).select(
        (F.col("id") % 2).alias("task_id"), F.format_string("src/f%d.py", "id").alias("path"), (F.lit(500.0) - F.col("id") % 400).alias("score"), F.array(F.lit("calls"), F.lit("symbol")).alias("reasons"), F.lit(3).cast("long").alias("hits"),
        F.lit(100).cast("long").alias("tokens"), F.lit(50).cast("long").alias("summary_tokens"), F.lit(None).cast("long").alias("skeleton_tokens"), (F.col("id") % 50 < 2).alias("changed"), F.lit(False).alias("secret"),
    )
    settings = {"spark.sql.autoBroadcastJoinThreshold": "1b", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for f in (lambda *x: L.selected(L.select_files(*x)), lambda *x: L.chosen(*x)):
            used = {r.task_id: r.s for r in f(rows, L.Rules(budget=1000)).groupBy("task_id").agg(F.sum("tokens").alias("s")).collect()}
            assert used == {0: 1000, 1: 1000}
    finally:
        for name in settings:
            spark.conf.unset(name)
