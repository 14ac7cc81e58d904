"""Overviews of a repository and of runs: modules, clusters, inventories, workspaces and their needs, summaries of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(rows: DataFrame, group: str, order: list[Column], n: int, value: str, name: str) -> DataFrame:
    """(group, name): the first n values of each group, joined with commas; only n rows of a group are put together."""
    w = Window.partitionBy(group).orderBy(*order)
    first = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda x: x[value]), ",").alias(name))


def modules(files: DataFrame) -> DataFrame:
    """(module, files, tokens, score, languages, key_files, roles) of files (path, module, tokens, score, language, role).

    score: the twenty best files' and a point for each file up to twenty; languages: the first six by name;
    key_files: the eight best; roles: the distinct ones of the twelve best, three at most.
    """
    order = [F.desc("score"), F.col("path")]
    w = Window.partitionBy("module").orderBy(*order)
    placed = files.withColumn("k", F.row_number().over(w))
    sums = placed.groupBy("module").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.round(F.sum(F.when(F.col("k") <= 20, F.col("score"))) + F.least(F.count("*"), F.lit(20)), 4).alias("score"))
    languages = best_of(files.filter("language is not null").select("module", "language").distinct(), "module", [F.col("language")], 6, "language", "languages")
    roles = placed.filter("k <= 12 and role is not null").groupBy("module", "role").agg(F.min("k").alias("at"))
    roles = best_of(roles, "module", [F.col("at")], 3, "role", "roles")
    keys = best_of(files, "module", order, 8, "path", "key_files")
    return sums.join(languages, "module", "left").join(keys, "module", "left").join(roles, "module", "left")


def clusters(files: DataFrame, labels: int = 12, members: int = 6) -> DataFrame:
    """(label, n, paths): the labels with most shown members; a label shows its six best files."""
    w = Window.partitionBy("label").orderBy(F.desc("score"), "path")
    shown = files.filter("label is not null").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= members)
    grouped = shown.groupBy("label").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]), ",").alias("paths"))
    return grouped.orderBy(F.desc("n"), "label").limit(labels)


def inventory(files: DataFrame, most: int = 25) -> DataFrame:
    """(category, k, path): the first files of each category by score; the rest is only counted, in row 0."""
    w = Window.partitionBy("category").orderBy(F.desc("score"), "path")
    first = files.withColumn("k", F.row_number().over(w).cast("long")).filter(F.col("k") <= most).select("category", "k", "path")
    counts = files.groupBy("category").agg(F.count("*").alias("n"))
    return first.unionByName(counts.select("category", F.lit(0).cast("long").alias("k"), F.concat(F.lit("files: "), "n").alias("path")))


def workspace_edges(manifests: DataFrame) -> DataFrame:
    """(workspace, needs): workspaces whose manifest asks for another's package; manifests: (workspace, package, dependencies)."""
    asked = manifests.select("workspace", F.explode("dependencies").alias("package"))
    return asked.join(manifests.select(F.col("workspace").alias("needs"), "package"), "package").filter("workspace != needs").select("workspace", "needs").distinct()


def workspace_roots(paths: DataFrame, globs: list[str], markers: list[str]) -> DataFrame:
    """(root, depth): folders that a workspace pattern names and that hold a marker file; by depth, then name."""
    folder, name = F.regexp_replace("path", "/[^/]*$", ""), F.element_at(F.split("path", "/"), -1)
    pattern = "^(" + "|".join(g.replace(".", r"\.").replace("**", "@").replace("*", "[^/]+").replace("@", ".+") for g in globs) + ")$"
    roots = paths.filter(name.isin(*markers) & F.col("path").contains("/")).select(folder.alias("root")).filter(F.col("root").rlike(pattern)).distinct()
    return roots.withColumn("depth", F.size(F.split("root", "/")))


def group_means(rows: DataFrame, group: str, values: list[str]) -> DataFrame:
    """Per group the number of rows, the mean of each value over rows where all are known, and the index percentiles of the first."""
    known = F.lit(True)
    for v in values:
        known = known & F.col(v).isNotNull()
    return rows.groupBy(group).agg(F.count("*").alias("n"), *[F.round(F.avg(F.when(known, F.col(v))), 3).alias(f"avg_{v}") for v in values], F.count(F.when(known, 1)).alias("complete"))


def intents(tasks: DataFrame, words: dict[str, dict[str, int]]) -> DataFrame:
    """(task_id, intent, weight): the intent with most weighted words in a task's terms; the first by name of equals.  tasks: (task_id, terms)."""
    spark = tasks.sparkSession
    table = spark.createDataFrame([(i, t, w) for i, all_ in words.items() for t, w in all_.items()], "intent string, term string, w int")
    met = tasks.select("task_id", F.explode(F.array_distinct("terms")).alias("term")).join(F.broadcast(table), "term").groupBy("task_id", "intent").agg(F.sum("w").alias("weight"))
    best = met.groupBy("task_id").agg(F.max("weight").alias("weight"))
    chosen = met.join(best, ["task_id", "weight"]).groupBy("task_id", "weight").agg(F.min("intent").alias("intent"))
    return tasks.select("task_id").join(chosen, "task_id", "left").select("task_id", F.coalesce("intent", F.lit("general")).alias("intent"), F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
