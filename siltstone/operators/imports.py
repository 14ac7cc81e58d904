"""Imports between files: relative names of any depth resolved to files, the graph in both directions, and what is reached in steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shared import written

#: Extensions that a relative JavaScript import may stand for, in the order in which they are tried (fixed values).
SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: What a path becomes that leaves the root.
OUTSIDE = "!"


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normal(path: Column) -> Column:
    """The path without ".", ".." and empty parts; OUTSIDE where it leaves the root."""
    up = lambda a: F.when(a == "", OUTSIDE).otherwise(folder(a))
    step = lambda a, x: F.when(a == OUTSIDE, a).when(x == "..", up(a)).when(x.isin(".", ""), a).when(a == "", x).otherwise(F.concat(a, F.lit("/"), x))
    return F.aggregate(F.split(path, "/"), F.lit(""), step)


def script_targets(path: Column, name: Column) -> Column:
    """Paths that a relative import in a script may mean, the first that exists counts: the name with each extension instead of its own, then index files."""
    whole = normal(F.concat_ws("/", folder(path), name))
    bare = F.regexp_replace(whole, r"([^/])\.[^./]+$", "$1")
    return F.when(whole != OUTSIDE, F.array(*[F.concat(bare, F.lit(e)) for e in SCRIPT], *[normal(F.concat(whole, F.lit(f"/index{e}"))) for e in SCRIPT]))


def python_targets(path: Column, name: Column) -> Column:
    """Paths that a relative import in Python may mean: each dot after the first goes up one package, at most to the root."""
    dots = F.length(name) - F.length(F.regexp_replace(name, r"^\.+", ""))
    parts = F.filter(F.split(folder(path), "/"), lambda x: x != "")
    base = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - dots + 1))
    module = F.array_join(F.concat(base, F.filter(F.split(F.regexp_replace(name, r"^\.+", ""), r"\."), lambda x: x != "")), "/")
    return F.array(F.concat(module, F.lit(".py")), F.when(module == "", "__init__.py").otherwise(F.concat(module, F.lit("/__init__.py"))))


def resolve(found: DataFrame, files: DataFrame) -> DataFrame:
    """found (path, name, language) with `target`: the file of a relative import, null if none is there; a package's own name otherwise."""
    targets = F.when(F.col("language") == "python", python_targets(F.col("path"), F.col("name"))).when(F.col("language") == "javascript", script_targets(F.col("path"), F.col("name")))
    relative = found.filter(F.col("name").startswith(".")).distinct()
    tried = relative.select("path", "name", "language", F.posexplode(targets).alias("pos", "target"))
    there = tried.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    first = there.groupBy("path", "name", "language").agg(F.min_by("target", "pos").alias("file"))
    out = found.join(first, ["path", "name", "language"], "left")
    return out.select("path", "name", "language", F.when(F.col("name").startswith("."), F.col("file")).otherwise(F.col("name")).alias("target"))


def edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): imports of files by files, each once."""
    known = files.select(F.col("path").alias("target")).distinct()
    return resolved.filter("target is not null").join(known, "target", "left_semi").select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def nodes(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, imports, packages, missing, imported_by) of every file: numbers of its imports by kind, and of the files that import it."""
    own = edges(resolved, files)
    out = own.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("imports"))
    back = own.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("imported_by"))
    other = resolved.join(own.select(F.col("src").alias("path"), F.col("dst").alias("target")), ["path", "target"], "left_anti").groupBy("path").agg(
        F.count_distinct(F.when(F.col("target").isNotNull(), F.col("name"))).alias("packages"), F.count_distinct(F.when(F.col("target").isNull(), F.col("name"))).alias("missing")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = files.select("path").distinct().join(out, "path", "left").join(other, "path", "left").join(back, "path", "left")
    return joined.select("path", *map(zero, ("imports", "packages", "missing", "imported_by")))


def reached(own: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """(seed, path, hops): what each seed (path) reaches along edges (src, dst) in up to `steps` steps, at the fewest.

    A step joins only what was new in the step before, with the sources that have edges; what has been seen leaves.  Each step is
    written, so the plan doesn't grow.  Hot nodes are split by Spark's skew join, since the join's rows need not stand together.
    """
    frontier = seeds.select(F.col("path").alias("seed"), "path", F.lit(0).alias("hops")).distinct()
    seen = written(frontier, "reached")
    frontier = seen
    for k in range(1, steps + 1):
        near = frontier.join(own.select(F.col("src").alias("path"), "dst"), "path").select("seed", F.col("dst").alias("path")).distinct()
        frontier = written(near.join(seen.select("seed", "path"), ["seed", "path"], "left_anti").withColumn("hops", F.lit(k)), "reached")
        seen = seen.unionByName(frontier)
    return seen
