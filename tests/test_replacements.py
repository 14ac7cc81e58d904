"""Replacement diagnostics against a plain comparison of all pairs, and hand-written cases."""

import random

from pyspark.sql import functions as F

from siltstone.operators import replacements as R

SCHEMA = "g string, path string, rank int, score double, hits int, reasons array<string>, tokens int, selected boolean, expected boolean, why string"


def related(a, b):
    return a == b or (a != "" and b != "" and (a.startswith(b + "/") or b.startswith(a + "/")))


def test_scopes_and_packages(spark):
    cases = {
        "src/a/b/c/x.py": ("src/a/b", "src"), "web/src/x.py": ("web/src", "web"), "Packages\\Web\\lib/x.ts": ("packages/web/lib", "packages/web"), "packages/web/x.ts": ("packages/web/x.ts", "packages/web"),
        "packages/x.ts": ("packages", "packages/x.ts"), "tests/a/b/x.py": ("tests/a", "tests"), "docs/a/b.md": ("docs/a", "docs"), "docs/b.md": ("docs", "docs"), "": ("", ""), "playground/p/x.js": ("playground/p", "playground/p"),
        "apps/one/y.go": ("apps/one", "apps/one"), "a//src": ("a/src", "a"),
    }
    rows = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r.path: (r.s, r.w) for r in rows.select("path", R.diagnostic_scope(F.col("path")).alias("s"), R.workspace_package(F.col("path")).alias("w")).collect()}
    assert got == cases | {"packages/web/x.ts": ("packages/web/x.ts", "packages/web")}


def test_best_exchanges_are_those_of_all_pairs(spark):
    draw = random.Random(5)
    folders = ["src", "src/a", "src/a/b", "docs", "lib/x/y", "lib", "tests/t", "x", ""]
    rows = []
    for i in range(900):
        state = draw.choice([(False, True, "budget exhausted"), (True, False, None), (True, True, None), (False, True, "score too low")])
        reasons = draw.choice([[], ["phrase"], ["filename", "recent"], None])
        path = "/".join(x for x in (draw.choice(folders), f"f{draw.randrange(400)}.py") if x)
        rows.append((draw.choice("aaab"), path, draw.randrange(1, 40), float(draw.randrange(-10, 40)) * 10, draw.choice([None, 0, 3, 9]), reasons, draw.randrange(0, 30), *state))
    rows += [("a", None, 1, 1.0, 1, [], 5, True, False, None), ("a", "src/n.py", 1, None, 1, [], 5, True, False, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    seen = df.dropna(subset=["path", "score"]).select("*", R.diagnostic_scope(F.col("path")).alias("s"), R.evidence(F.col("path"), F.col("score"), F.coalesce("hits", F.lit(0)), F.coalesce("reasons", F.array().cast("array<string>"))).alias("e")).collect()
    for n in (1, 7, 20):
        want = {}
        for g in "ab":
            pairs = []
            for m in (x for x in seen if x.g == g and x.expected and not x.selected and x.why == "budget exhausted" and x.tokens > 0):
                for s in (x for x in seen if x.g == g and x.selected and not x.expected):
                    if m.tokens <= s.tokens and related(m.s, s.s) and m.e - s.e >= 25000:
                        pairs.append((s.e - m.e, m.tokens - s.tokens, m["rank"], s["rank"], m.path, s.path))
            want[g] = sorted(pairs)[:n]
        got = {g: sorted((-r.gain, r.missed_tokens - r.noise_tokens, r.missed_rank, r.noise_rank, r.missed, r.noise) for r in R.opportunities(df, "g", n).collect() if r.g == g) for g in "ab"}
        assert got == want and len(want["a"]) == n
    assert R.opportunities(df.limit(0), "g").count() == 0


def test_evidence_by_hand(spark):
    rows = spark.createDataFrame([("src/x.py", 1000.0, 9, ["phrase", "filename", "recent", "role"]), ("docs/x.md", -5.0, 0, []), ("src/x.py", 0.5, 1, ["calls"])], "path string, score double, hits int, reasons array<string>")
    got = [r.e for r in rows.select(R.evidence(F.col("path"), F.col("score"), F.col("hits"), F.col("reasons")).alias("e")).collect()]
    assert got == [(75 + 108 + 55 + 12 + 5) * 1000, -25000, 125 + 73000]


def test_ranks_by_distinct_scores(spark):
    rows = spark.createDataFrame([("a", 5.0, 10), ("a", 5.0, 1), ("a", 7.0, 2), ("a", 1.0, 3), ("b", 1.0, 4)], "g string, score double, tokens int")
    assert sorted((r.g, r.score, r["rank"], r.used) for r in R.standing(rows, "g").collect()) == [("a", 1.0, 4, 16), ("a", 5.0, 2, 13), ("a", 5.0, 2, 13), ("a", 7.0, 1, 2), ("b", 1.0, 1, 4)]


def test_displaced(spark):
    receipts = [(1, 1, "x", "summarized", 40, "symbol"), (1, 2, "x", "excluded", 0, "replaced by replaced by y"), (1, 3, "replaced by y", "included", 9, "phrase"), (1, 4, "z", "excluded", 0, "budget exhausted")]
    frame = spark.createDataFrame(receipts, "task_id int, step int, path string, action string, tokens int, reason string")
    scored = spark.createDataFrame([(1, "x", 3.0, 2), (2, "replaced by y", 9.0, 1)], "task_id int, path string, score double, rank int")
    (r,) = R.displaced(frame, scored).collect()
    assert (r.displaced, r.challenger, r.displaced_tokens, r.displaced_score, r.displaced_rank, r.challenger_score) == ("x", "replaced by y", 40, 3.0, 2, None)


def test_audit(spark):
    rows = [("a", "src/a/x.py", [], 10, False, True), ("a", "src/y.py", [], 20, True, False), ("a", "web/z.py", ["phrase"], 30, True, False), ("a", "web/z.md", ["phrase"], 40, True, False), ("b", "q", None, 5, True, True), ("c", "q", None, 5, False, True)]
    df = spark.createDataFrame(rows, "g string, path string, reasons array<string>, tokens int, selected boolean, expected boolean")
    # src holds src/a; z.py is of an expected file's family and has strong evidence, z.md is of another
    assert {r.g: (r.packed, r.noise, r.noise_tokens, r.useful, r.useful_tokens, r.audited_tokens, r.adjusted_precision) for r in R.label_audit(df, "g").collect()} == {"a": (90, 3, 90, 2, 50, 40, 0.556), "b": (5, 0, 0, 0, 0, 0, 1.0)}
