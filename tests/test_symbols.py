"""Extents of symbols against Python's own parser and hand-written cases; callers and touched symbols."""

import ast
import time
from pathlib import Path

from pyspark.sql import functions as F
from test_growth import moved

from siltstone.functions import source as C
from siltstone.operators import symbols as Y
from siltstone.plans.source import _in_languages, call_sites, code

JS = """// class No {
class Box {
  open() { return "}" }
}
export const f = (x) => 1
export async function g(
  a,
) {
  const h = (y) => {
    return `{`
  }
}
const one = () => { return 1 }
"""
GO = """package x
/* func no() { */
func (r *Repo) Run(a int) error {
\tif a > 0 {
\t\tprintln("{")
\t}
\treturn nil
}
type T struct {
\tA int
}
func last() {
"""


def found(spark, *files):
    df = spark.createDataFrame(files, "path string, text string, language string")
    return df, Y.extents(df)


def test_braces(spark):
    rows = found(spark, ("a.js", JS, "javascript"), ("a.go", GO, "go"), ("n.js", None, "javascript"), ("e.py", "", "python"), ("x.rb", "class A\nend", "ruby"))[1].collect()
    got = {(r.path, r.name, r["first"], r["last"], r.owner) for r in rows}
    assert got == {
        ("a.js", "Box", 2, 4, None), ("a.js", "f", 5, 5, None), ("a.js", "g", 6, 12, None), ("a.js", "h", 9, 11, "g"), ("a.js", "one", 13, 13, None),
        ("a.go", "Run", 3, 8, None), ("a.go", "T", 9, 11, None), ("a.go", "last", 12, 13, None),
    }


def test_python_as_its_parser_sees_it(spark):
    paths = sorted(Path(Y.__file__).parent.glob("*.py"))
    files, rows = found(spark, *[(p.name, p.read_text(), "python") for p in paths], ("bad.py", "def f(:", "python"))
    want = set()
    for p in paths:
        tree = ast.parse(p.read_text())
        for n in ast.walk(tree):
            if isinstance(n, ast.ClassDef):
                want.add((p.name, n.name, n.lineno, n.end_lineno, None))
                want |= {(p.name, f"{n.name}.{m.name}", m.lineno, m.end_lineno, n.name) for m in n.body if isinstance(m, ast.FunctionDef)}
        want |= {(p.name, n.name, n.lineno, n.end_lineno, None) for n in tree.body if isinstance(n, ast.FunctionDef)}
    assert {(r.path, r.name, r["first"], r["last"], r.owner) for r in rows.collect()} == want and len(want) > 100
    text = {p.name: p.read_text().split("\n") for p in paths}
    for r in Y.bodies(files, rows).collect():
        assert r.body == "\n".join(text[r.path][r["first"] - 1 : r["last"]])


def test_names_and_changed_lines(spark):
    symbols = spark.createDataFrame([("a", "Box", 1, 10), ("a", "Box.open", 3, 4), ("a", "far", 60, 200), ("b", "other", 1, 1)], "path string, name string, first int, last int")
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    assert {r.name for r in Y.named(symbols, terms("OPEN", "oth")).collect()} == {"Box.open", "other"}
    assert Y.named(symbols, terms().limit(0)).count() == 4
    ranges = spark.createDataFrame([("a", 4, 5), ("a", 9, 70), ("a", 130, 500), ("c", 1, 1)], "path string, start int, stop int")
    assert {(r.name, r.lines) for r in Y.touched(symbols, ranges).collect()} == {("Box", 4), ("Box.open", 1), ("far", 82)}


def test_callers_gain(spark):
    files = spark.createDataFrame([("a.js", "run(); obj.stop(1); if (x) return (y)"), ("b.js", "run()"), ("c.js", None), ("s.js", "run()")], "path string, text string")
    called = Y.calls(files)
    assert {(r.path, r.base) for r in called.collect()} == {("a.js", "run"), ("a.js", "stop"), ("b.js", "run"), ("s.js", "run")}
    scored = spark.createDataFrame([(1, p, 10.0, ["x"]) for p in ("a.js", "b.js", "c.js", "s.js")], "task_id int, path string, score double, reasons array<string>")
    chosen = spark.createDataFrame([(1, "s.js")], "task_id int, path string")
    symbols = spark.createDataFrame([("s.js", "run"), ("s.js", "K.stop"), ("c.js", "none")], "path string, name string")
    got = {r.path: (r.score, r.reasons) for r in Y.callers(scored, chosen, symbols, called).collect()}
    assert got == {"a.js": (190.0, ["x", "caller of run"]), "b.js": (100.0, ["x", "caller of run"]), "c.js": (10.0, ["x"]), "s.js": (10.0, ["x"])}


ODD = (
    None, "", "\n", "  class A(B):\n\ndef f (x): g.h(1); g . k (2)\n\tasync def q(", "export class K{} class L\nconst a = async (b\n) => 1; var c = d => e\nexport let z: T = f(g(h( i", "func (r *R) Run(a) {\nfunc main() {\ntype T struct\nif (x) return(y) $v.w( (", "a.b.c (x)\nclass\nZ",
)


def test_names_of_one_pass_equal_lines_and_calls(spark):
    rows = [(f"{i}.{n}", t, n) for i, t in enumerate(ODD) for n in ("python", "javascript", "go", "other", None)]
    files = spark.createDataFrame(rows, "path string, text string, language string")
    want = {(r.path, r.line, r.name, r.kind, n) for n in ("python", "javascript", "go") for r in C.symbols(files.filter(F.col("language") == n), n).collect()}
    assert {tuple(r) for r in Y.line_symbols(files).collect()} == want and len(want) >= 10
    got, called = Y.names(files).collect(), {tuple(r) for r in Y.calls(files).collect()}
    assert {(r.path, r.name) for r in got if r.defined} == {(path, name) for path, _, name, _, _ in want} and {(r.path, r.name) for r in got if r.called} == called
    assert len(got) == len({(r.path, r.name) for r in got}) and ("6.go", "c") in called


def test_call_sites_hand_on_each_name_of_a_file_once(spark):
    here = "/root/testdata/sf0.001"
    rows, shuffled = moved(spark, call_sites(spark, here))
    names = Y.names(_in_languages(code(spark, here)))
    # names of files once, then counts of each name from each of four partitions at most
    assert shuffled <= names.count() + 4 * names.select("name").distinct().count() and len(rows) > 100


def test_bodies_in_the_same_pass(spark):
    files = spark.createDataFrame([("a.js", JS, "javascript"), ("a.go", GO, "go"), ("a.py", "class A:\n  def f(self):\n    pass\n", "python"), ("n.go", None, "go"), ("x", "class A {", None)], "path string, text string, language string")
    rows, shuffled = moved(spark, Y.extents(files, bodies=True))
    assert shuffled == 0 and sorted(map(str, rows)) == sorted(map(str, Y.bodies(files, Y.extents(files)).select(*Y.extents(files, bodies=True).columns).collect())) and len(rows) == 11


def test_open_braces_make_no_pairs_of_symbols(spark):
    """Each function holds all that follow: owners and ends don't take pairs of them, nor heads with open brackets all lines."""
    n = 30_000
    began = time.process_time()
    got = Y._braced("\n".join(["function f() {"] * n), [(i + 1, f"f{i}", "function") for i in range(n)])
    assert got[0] == ("f0", "function", 1, n, None) and got[-1] == (f"f{n - 1}", "function", n, n, f"f{n - 2}") and all(s[3] == n for s in got)
    assert len(Y._braced("function f(\n" * n + "{", [(i + 1, "f", "function") for i in range(n)])) == n
    assert time.process_time() - began < 10
