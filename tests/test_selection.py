"""Hand-written cases of selection, evaluation and provenance."""

from pyspark.sql import functions as F

from siltstone.operators import selection as S


def test_smaller_candidates_still_fit(spark):
    rows = [("t", "a", 9, 60), ("t", "b", 8, 50), ("t", "c", 7, 40), ("t", "d", 0, 1), ("t", "e", -1, 1), ("t", "f", None, 1), ("u", "a", 1, 101), ("v", "b", 5, 100), ("v", "a", 5, 100), (None, "a", 1, 1)]
    df = spark.createDataFrame(rows, "task string, path string, score int, tokens int")
    got = {(r.task, r.path): r.selected for r in S.select_under_budget(df, 100, 10).collect()}
    assert got == {("t", "a"): True, ("t", "b"): False, ("t", "c"): True, ("u", "a"): False, ("v", "a"): True, ("v", "b"): False}
    assert {(r.task, r.path) for r in S.select_under_budget(df, 100, 1).collect()} == {("t", "a"), ("u", "a"), ("v", "a")}
    assert S.select_under_budget(df.limit(0), 100, 10).count() == 0


def test_candidates_after_many_large_ones_are_tried(spark):
    rows = [("t", i, 1000 - i, 601) for i in range(100)] + [("t", 100 + i, 500 - i, 7) for i in range(100)]
    df = spark.createDataFrame(rows, "task string, path int, score int, tokens int")
    got = {r.path: (r.rank, r.selected) for r in S.select_under_budget(df, 600).collect()}
    # 85 times 7 is 595
    assert got == {i: (i + 1, 100 <= i < 185) for i in range(200)}


def test_select_greedy_tries_every_turn(spark, tmp_path):
    from siltstone.plans.selection import select_greedy

    rows = [(1, i, "user", "x" * 2404) for i in range(70)] + [(1, 70, "user", "short")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.path: (r["rank"], r.selected) for r in select_greedy(spark, str(tmp_path)).collect()}
    assert len(got) == 71 and got[70] == (71, True) and not any(s for p, (_, s) in got.items() if p < 70)


def test_expected_ranks_pick_halves_to_even(spark):
    df = spark.createDataFrame([("x", i, i in (1, 3, 4, 30)) for i in range(1, 31)] + [("none", 1, False)], "g string, rank int, expected boolean")
    (r,) = S.expected_ranks(df, "g").collect()
    # places 1.5 and 2.7 of four
    assert (r.g, r.expected, r.all_at, r.median_rank, r.p90_rank, r.recall_20, r.recall_50) == ("x", 4, 30, 4, 30, 0.75, 1.0)


def test_accuracy_without_rows_to_divide_by(spark):
    df = spark.createDataFrame([("a", True, True, 10), ("a", True, False, 30), ("a", False, True, 5), ("b", False, False, 5)], "g string, selected boolean, expected boolean, tokens int")
    got = {r.g: tuple(r)[1:] for r in S.token_accuracy(df, "g").collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 0.25), "b": (0.0, 0.0, 0.0, 0.0)}


def test_delta(spark):
    old = spark.createDataFrame([("a", "full"), ("b", "full"), ("c", None), ("d", "full")], "path string, mode string")
    new = spark.createDataFrame([("a", "full"), ("b", "summary"), ("c", None), ("e", "full")], "path string, mode string")
    assert dict(S.delta(old, new).collect()) == {"b": "mode", "d": "removed", "e": "added"}


def test_longest_prefix_ends_at_a_part(spark):
    paths = spark.createDataFrame([("app/web/x",), ("app/website",), ("app",), ("lib/x",)], "path string")
    roots = spark.createDataFrame([("app",), ("app/web",), ("app",)], "root string")
    assert dict(S.longest_prefix(paths, roots).collect()) == {"app/web/x": "app/web", "app/website": "app", "app": "app"}


def test_citations_fail_in_order(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "")], "doc_id long, text string")
    now = {r.doc_id: r.h for r in docs.select("doc_id", F.sha2("text", 256).alias("h")).collect()}
    cited = [(1, 1, 2, now[1]), (1, 1, 3, now[1]), (1, 2, 1, now[1]), (1, 0, 9, "old"), (2, 1, 1, now[2]), (3, 1, 1, "x"), (1, None, 1, now[1]), (1, 1, 1, None)]
    rows = spark.createDataFrame(cited, "doc_id long, first int, last int, hash string")
    got = sorted((r.doc_id, str(r["first"]), str(r["last"]), r.status) for r in S.check_citations(rows, docs).collect())
    assert got == [(1, "0", "9", "stale"), (1, "1", "1", "stale"), (1, "1", "2", "valid"), (1, "1", "3", "lines"), (1, "2", "1", "lines"), (1, "None", "1", "lines"), (2, "1", "1", "valid"), (3, "1", "1", "missing")]


def test_neighbours_of_the_most_changed(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (4, "d"), (4, None), (1, "b")], "commit int, file string")
    assert {(r.file, r.boost, r.links) for r in S.neighbour_boosts(rows, seeds=1).collect()} == {("b", 24, 2), ("c", 24, 1)}
