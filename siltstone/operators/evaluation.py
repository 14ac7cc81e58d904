"""Judging selections: recall by family and mode, misses and the noise above them, strategies, diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("full", "symbols", "skeleton", "summary")


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _share(part: Column, whole: Column, places: int = 3) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), places)


def family_recall(rows: DataFrame, group: str) -> DataFrame:
    """Per group of (group, selected, expected, mode): expected rows, hits by mode, recall, and the rate of hits that show code."""
    e, hit = F.col("expected"), F.col("expected") & F.col("selected")
    by_mode = [_n(hit & (F.col("mode") == m)).alias(f"n_{m}") for m in MODES]
    return rows.groupBy(group).agg(_n(e).alias("expected"), _n(hit).alias("hit"), _share(_n(hit), _n(e)).alias("recall"), *by_mode, _share(_n(hit & (F.col("mode") != "summary")), _n(e)).alias("actionable_rate"))


def owner_recall(rows: DataFrame, group: str, order: dict[str, int]) -> DataFrame:
    """(group, family, owners, selected, recall): recall on the expected rows of the family that comes first, per group."""
    rank = F.when(F.lit(False), 0)
    for name, k in order.items():
        rank = rank.when(F.col("family") == name, k)
    known = rows.filter("expected").withColumn("rank", rank.otherwise(max(order.values()) + 1))
    first = known.groupBy(group).agg(F.min("rank").alias("rank"))
    owners = known.join(first, [group, "rank"])
    return owners.groupBy(group).agg(F.min("family").alias("family"), F.count("*").alias("owners"), _n(F.col("selected")).alias("selected"), _share(_n(F.col("selected")), F.count("*")).alias("recall"))


def misses(ranked: DataFrame, group: str) -> DataFrame:
    """(group, path, rank, failure, delta, one_more, noise): expected rows that were not selected.

    delta: to the score of the last selected row; one_more: whether one more place would take it; noise: the
    first selected row above it that isn't expected, else the first of at least its score.
    ranked: (group, path, rank, score, selected, expected).
    """
    chosen = ranked.filter("selected")
    last = chosen.groupBy(group).agg(F.max_by("score", "rank").alias("last"), F.count("*").alias("n"))
    noise = chosen.filter("not expected").groupBy(group).agg(F.min_by(F.struct("path", "rank", "score"), "rank").alias("first"))
    missed = ranked.filter("expected and not selected").join(last, group, "left").join(noise, group, "left")
    n = F.coalesce("n", F.lit(0))
    failure = F.when((F.col("score") <= 0) | (F.col("rank") > F.greatest(F.lit(50), n * 4)), "RANKED_LOW").when(F.col("rank") <= n + 1, "SKIPPED").otherwise("NOISE_ABOVE")
    above = F.when((F.col("first.rank") < F.col("rank")) | (F.col("first.score") >= F.col("score")), F.col("first.path"))
    return missed.select(group, "path", "rank", failure.alias("failure"), F.round(F.col("score") - F.col("last"), 1).alias("delta"), (F.col("rank") <= n + 1).alias("one_more"), above.alias("noise"))


def last_summary_waste(selected: DataFrame, group: str) -> DataFrame:
    """(group, waste, change): tokens of the last summary if it isn't expected, and what precision would gain without it.

    selected: (group, pos, mode, tokens, expected).
    """
    good = F.sum(F.when(F.col("expected"), F.col("tokens")).otherwise(0))
    per = selected.groupBy(group).agg(F.sum("tokens").alias("all"), good.alias("good"), F.max_by(F.struct("tokens", "expected"), F.when(F.col("mode") == "summary", F.col("pos"))).alias("last"), _n(F.col("mode") == "summary").alias("summaries"))
    fit = per.filter((F.col("summaries") > 0) & (F.col("last.tokens") > 0) & (F.col("all") > F.col("last.tokens")))
    without = (F.col("good") - F.when(F.col("last.expected"), F.col("last.tokens")).otherwise(0)) / (F.col("all") - F.col("last.tokens"))
    return fit.select(group, F.when(F.col("last.expected"), 0).otherwise(F.col("last.tokens")).cast("long").alias("waste"), F.round(without - F.col("good") / F.col("all"), 4).alias("change"))


def shuffled(rows: DataFrame, group: str, item: str, seed: str) -> DataFrame:
    """rows with a score that falls along an order drawn by a seeded hash: a baseline that knows nothing."""
    w = Window.partitionBy(group).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(item).cast("string")), 256))
    return rows.withColumn("score", 1.0 / F.row_number().over(w))


def strategies(records: DataFrame, base: str) -> DataFrame:
    """(strategy, runs, success, tokens, calls, success_gain, tokens_saved): rates and means, and their distance from the base's."""
    rates = records.groupBy("strategy").agg(F.count("*").alias("runs"), F.avg(F.col("success").cast("double")).alias("s"), F.avg("tokens").alias("t"), F.avg("calls").alias("c"))
    bottom = rates.filter(F.col("strategy") == base).select(F.col("s").alias("s0"), F.col("t").alias("t0"))
    both = rates.join(F.broadcast(bottom), how="left")
    r = lambda c, k=4: F.round(c, k)
    return both.select("strategy", "runs", r(F.col("s")).alias("success"), r(F.col("t"), 2).alias("tokens"), r(F.col("c"), 2).alias("calls"), r(F.col("s") - F.col("s0")).alias("success_gain"), r(F.col("t0") - F.col("t"), 2).alias("tokens_saved"))


def boundaries(rows: DataFrame, group: str) -> DataFrame:
    """(group, inside, across, match_rate): selected rows within packages of expected ones, and others.  rows: (group, package, selected, expected)."""
    wanted = rows.filter("expected and package is not null").select(group, "package").distinct().withColumn("wanted", F.lit(True))
    chosen = rows.filter("selected and package is not null").join(wanted, [group, "package"], "left")
    inside = _n(F.coalesce("wanted", F.lit(False)))
    return chosen.groupBy(group).agg(inside.alias("inside"), (F.count("*") - inside).alias("across"), _share(inside, F.count("*")).alias("match_rate"))


def consumers(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n files that use most tokens over all runs, with their share."""
    sums = rows.groupBy("path").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("runs"))
    total = rows.agg(F.sum("tokens").alias("total"))
    return sums.join(F.broadcast(total)).select("path", "tokens", "runs", F.round(F.col("tokens") / F.col("total"), 4).alias("share")).orderBy(F.desc("tokens"), "path").limit(n)


def checks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(case, required_missing, forbidden_hit, too_many_files, too_many_lines, passed) of changed files held against a case's rules.

    results: (case, path, lines); cases: (case, required, forbidden, most_files, most_lines), patterns as regular expressions.
    """
    joined = cases.join(results, "case", "left").groupBy("case", "required", "forbidden", "most_files", "most_lines").agg(
        F.coalesce(F.bool_or(F.rlike("path", "required")), F.lit(False)).alias("has_required"), F.coalesce(F.bool_or(F.rlike("path", "forbidden")), F.lit(False)).alias("forbidden_hit"),
        F.count("path").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
    )
    missing = F.col("required").isNotNull() & ~F.col("has_required")
    many, long = F.coalesce(F.col("files") > F.col("most_files"), F.lit(False)), F.coalesce(F.col("lines") > F.col("most_lines"), F.lit(False))
    return joined.select("case", missing.alias("required_missing"), "forbidden_hit", many.alias("too_many_files"), long.alias("too_many_lines"), (~(missing | F.col("forbidden_hit") | many | long)).alias("passed"))


def stratified(cases: DataFrame, stratum: list[str], key: str, quotas: dict[str, int], default: int) -> DataFrame:
    """cases of each stratum up to its quota (by the first column's value): those with the least digests of their key.

    The choice depends on keys alone, not on how rows are dealt; a partition passes on no more than a stratum's quota.  Equal
    keys stand together in it, ties in the order of all columns.
    """
    most = max([default, *quotas.values()])
    order = [F.md5(F.col(key).cast("string")), *[F.col(c) for c in cases.columns]]
    ranked = cases.withColumn("place", F.row_number().over(Window.partitionBy(*stratum).orderBy(*order))).filter(F.col("place") <= most)
    quota = F.lit(default)
    for value, n in quotas.items():
        quota = F.when(F.col(stratum[0]) == value, n).otherwise(quota)
    return ranked.filter(F.col("place") <= quota)
