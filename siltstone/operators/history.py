"""What earlier runs tell: windows of the last rows, learned terms, boosts from feedback and episodes, active threads, skills."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.phrases import contained


def last_rows(log: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key (of the whole log without keys), with `k`, the place from the end."""
    if not keys:
        top = log.orderBy(*[F.desc(c) for c in order]).limit(n)
        return top.withColumn("k", F.row_number().over(Window.orderBy(*[F.desc(c) for c in order])))  # n rows
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n)


def noise_counts(log: DataFrame, keys: list[str], order: list[str], window: int = 20) -> DataFrame:
    """(keys, path, n): how often a path was noise in the last raw rows; rows that don't parse use up the window.

    log: keys, order, ok, noise (array of paths).
    """
    last = last_rows(log, keys, order, window).filter("ok")
    return last.select(*keys, F.explode("noise").alias("path")).groupBy(*keys, "path").agg(F.count("*").alias("n"))


def co_change_filter(counts: DataFrame, noise: DataFrame, least: int = 2, most_noise: int = 4) -> DataFrame:
    """counts (path, n) that are repeated and not of paths that were noise too often."""
    seen = noise.select("path", F.col("n").alias("noisy"))
    return counts.join(seen, "path", "left").filter((F.col("n") >= least) & (F.coalesce("noisy", F.lit(0)) <= most_noise)).select("path", "n")


def recent_mean(log: DataFrame, key: str, order: list[str], value: str, window: int = 10) -> DataFrame:
    """(key, mean, rows) over the last known values; 1.0 and 0 for keys without any."""
    known = last_rows(log.filter(F.col(value).isNotNull()), [key], order, window)
    means = known.groupBy(key).agg(F.round(F.avg(value), 4).alias("mean"), F.count("*").alias("rows"))
    return log.select(key).distinct().join(means, key, "left").select(key, F.coalesce("mean", F.lit(1.0)).alias("mean"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def signal_terms(runs: DataFrame, order: list[str], window: int = 40) -> DataFrame:
    """(term, good, bad) over the last runs (terms, precision, noisy): a run is bad at 0.2 or with noise, good from 0.45; it can be both."""
    last = last_rows(runs, [], order, window)
    bad, good = F.coalesce(F.col("precision") <= 0.2, F.lit(False)) | F.col("noisy"), F.coalesce(F.col("precision") >= 0.45, F.lit(False))
    each = last.select(F.explode("terms").alias("term"), good.cast("long").alias("g"), bad.cast("long").alias("b"))
    return each.groupBy("term").agg(F.sum("g").alias("good"), F.sum("b").alias("bad")).filter("good > 0 or bad > 0")


def learned(signals: DataFrame, least_good: int = 2, least_bad: int = 2) -> DataFrame:
    """signals with kind: positive, ambiguous or neither (null)."""
    good, bad = F.col("good"), F.col("bad")
    kind = F.when((good >= least_good) & (good >= F.greatest(F.lit(2), bad * 2)), "positive").when((bad >= least_bad) & (bad > F.greatest(F.lit(1), good * 2)), "ambiguous")
    return signals.withColumn("kind", kind)


def newest_cases(log: DataFrame, case: str, order: str, n: int) -> DataFrame:
    """The n cases that were seen last, each once."""
    return log.filter(F.col(case).isNotNull()).groupBy(case).agg(F.max(order).alias(order)).orderBy(F.desc(order), case).limit(n)


def active_threads(log: DataFrame, now: Column | DataFrame, hours: int = 24) -> DataFrame:
    """The last row of each thread (thread, ts, id, status, ...) within some hours; done rows are passed over, so an older one may count."""
    live = log.filter(~F.col("status").eqNullSafe("done") & F.col("thread").isNotNull())
    live = live.join(F.broadcast(now)) if isinstance(now, DataFrame) else live.withColumn("now", now)
    live = live.filter(F.col("ts") >= F.col("now") - F.make_interval(hours=F.lit(hours))).drop("now")
    rest = [c for c in live.columns if c != "thread"]
    return live.groupBy("thread").agg(F.max_by(F.struct(*rest), F.struct("ts", "id")).alias("r")).select("thread", "r.*")


def conflicts(active: DataFrame, asking: DataFrame) -> DataFrame:
    """(thread, other, overlap): other active threads on the branch of an asking one that touch the same files.

    active: (thread, branch, files); asking: the threads that are looked up, a query set.
    """
    rows = active.select("thread", "branch", F.explode("files").alias("file")).distinct()
    mine = rows.join(asking.select("thread").distinct(), "thread", "left_semi")
    met = mine.join(rows.select(F.col("thread").alias("other"), "branch", "file"), ["branch", "file"]).filter("thread != other")
    return met.groupBy("thread", "other").agg(F.count("*").alias("overlap"))


def overlap_boosts(tasks: DataFrame, records: DataFrame, paths: DataFrame, base: float, each: float, most_each: float, cap: float) -> DataFrame:
    """(task_id, path, boost): a record that shares terms with a task adds base and `each` for every shared term, up to `most_each`; a path's sum is capped.

    tasks: (task_id, term); records: (record, term); paths: (record, path).  Any record that shares a term adds base + each at
    least, so a path has its cap for every task with a term that enough of its records hold: such terms are counted, not paired.
    For all other paths of a task, each term has fewer records than that, which are paired and added up exactly.
    """
    least = base + min(each, most_each)
    enough = max(1, ceil(cap / least))
    asked = tasks.distinct()
    held = records.distinct().join(asked.select("term").distinct(), "term", "left_semi").join(paths.distinct(), "record").select("term", "path", "record")
    counts = held.groupBy("term", "path").agg(F.count("*").alias("n"))
    full = asked.join(counts.filter(F.col("n") >= enough), "term").select("task_id", "path").distinct()
    few = counts.filter(F.col("n") < enough).select(F.col("term").alias("t"), F.col("path").alias("p"))
    rare = held.join(few, (F.col("term") == F.col("t")) & F.col("path").eqNullSafe(F.col("p")), "left_semi")
    shared = asked.join(rare, "term").groupBy("task_id", "path", "record").agg(F.count("*").alias("overlap"))
    gain = F.lit(base) + F.least(F.lit(most_each), F.col("overlap") * each)
    done = full.select(F.col("task_id").alias("t"), F.col("path").alias("p"))
    rest = shared.join(done, F.col("task_id").eqNullSafe(F.col("t")) & F.col("path").eqNullSafe(F.col("p")), "left_anti").groupBy("task_id", "path").agg(F.least(F.lit(cap), F.sum(gain)).alias("boost"))
    return full.withColumn("boost", F.lit(cap)).unionByName(rest)


def feedback_boosts(tasks: DataFrame, records: DataFrame, missed: DataFrame) -> DataFrame:
    """Files that similar tasks missed before: 18 and 3 for each shared term up to 12, at most 60 for a path."""
    return overlap_boosts(tasks, records, missed, 18.0, 3.0, 12.0, 60.0)


def episode_boosts(tasks: DataFrame, episodes: DataFrame, touched: DataFrame, files: DataFrame, cap: float = 12.0) -> DataFrame:
    """Files that similar episodes changed and that still are as they were: 4 and 2 for each shared term, at most `cap`.

    episodes: (record, term) of those that did not fail; touched: (record, path, hash); files: (path, hash).
    """
    current = touched.join(files.select("path", F.col("hash").alias("now")), "path").filter(F.col("hash").isNull() | (F.col("hash") == F.col("now"))).select("record", "path")
    return overlap_boosts(tasks, episodes, current, 4.0, 2.0, cap - 4.0, cap)


def skill_success(feedback: DataFrame) -> DataFrame:
    """(skill, success): mean feedback between -1 and 1; zeros say nothing."""
    known = feedback.filter(F.col("value").isNotNull() & (F.col("value") != 0))
    return known.groupBy("skill").agg(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "value"))))), 4).alias("success"))


def skill_status(feedback: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(skill, status): the weightiest status of a skill, the latest of equals."""
    rank = F.when(F.lit(False), 0)
    for status, weight in ranks.items():
        rank = rank.when(F.col("status") == status, weight)
    return feedback.withColumn("rank", rank.otherwise(0)).groupBy("skill").agg(F.max_by("status", F.struct("rank", "at")).alias("status"))


def skill_progress(evidence: DataFrame) -> DataFrame:
    """(skill, tasks, confidence, last_task, first_seen, last_seen): evidence (skill, at, task, confidence) in its order.

    The first piece sets the confidence; each further one, the j-th, gives the greater of both and min(10, j)
    more, up to 100.  So the last value is the greatest of what each piece and all gains since add up to,
    which is an aggregate: no skill's evidence is collected.
    """
    order = Window.partitionBy("skill").orderBy("at", "task")
    rows = evidence.dropna(subset=["skill", "at"]).withColumn("i", F.row_number().over(order).cast("long")).withColumn("x", F.coalesce("confidence", F.lit(0)).cast("long"))
    gains = lambda j: F.when(j <= 10, (j * (j + 1) / 2 - 1).cast("long")).otherwise(54 + 10 * (j - 10))  # noqa: E731  (of the pieces 2 to j)
    first = F.min(F.when(F.col("x") > 0, F.col("i"))).over(Window.partitionBy("skill"))
    rows = rows.withColumn("first", first)
    net = F.when(F.col("i") == F.col("first"), F.col("x") - gains(F.col("i"))).when(F.col("i") > F.col("first"), F.col("x") - gains(F.col("i") - 1))
    grouped = rows.groupBy("skill").agg(F.count("*").alias("tasks"), F.max(net).alias("net"), F.max_by("task", "i").alias("last_task"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    sure = F.when(F.col("net").isNotNull(), F.least(F.lit(100), F.col("net") + gains(F.col("tasks")))).otherwise(0).cast("long")
    return grouped.select("skill", "tasks", sure.alias("confidence"), "last_task", "first_seen", "last_seen")


def drills(progress: DataFrame, n: int = 5) -> DataFrame:
    """The skills to practise: least sure, then fewest tasks, then longest ago."""
    return progress.orderBy("confidence", "tasks", "last_seen", "skill").limit(n)


def feedback_maps(signals: DataFrame) -> DataFrame:
    """(old, new): renames and merges of concepts; the later entry of a name counts.  signals: (at, target) such as "rename:a => b"."""
    parts = signals.withColumn("kind", F.regexp_extract("target", "^(rename|merge):", 1)).filter("kind != ''")
    old, new = F.trim(F.regexp_extract("target", "^[a-z]+:([^=]*)=>", 1)), F.trim(F.regexp_extract("target", "=>(.*)$", 1))
    rows = parts.select("at", old.alias("old"), new.alias("new")).filter("old != '' and new != ''")
    return rows.groupBy(F.lower("old").alias("old")).agg(F.max_by("new", "at").alias("new"))


def apply_feedback(concepts: DataFrame, maps: DataFrame, suppressed: DataFrame) -> DataFrame:
    """concepts (item, concept) renamed, without suppressed ones (concept), each once for an item."""
    renamed = concepts.withColumn("old", F.lower("concept")).join(maps, "old", "left").select("item", F.coalesce("new", "concept").alias("concept"))
    gone = suppressed.select(F.lower("concept").alias("low")).distinct()
    return renamed.withColumn("low", F.lower("concept")).join(gone, "low", "left_anti").select("item", "concept").distinct()


def lessons(rows: DataFrame, concepts: DataFrame, helpful: DataFrame, muted: DataFrame, most: int) -> DataFrame:
    """The best lessons (id, rule, confidence, accepted, evidenced): points for acceptance, evidence, and terms in the rule; muted terms remove."""
    kinds = (("concepts", concepts), ("helpful", helpful), ("muted", muted))
    terms = reduce(DataFrame.unionByName, [df.select(F.lower("term").alias("phrase"), F.lit(name).alias("kind")).distinct() for name, df in kinds])
    found = contained(rows.select("id", F.lower("rule").alias("text")), terms).join(terms, "phrase")
    hits = found.groupBy("id").agg(*[F.count_distinct(F.when(F.col("kind") == name, F.col("phrase"))).alias(name) for name, _ in kinds])
    met, n = rows.join(hits, "id", "left"), lambda name: F.coalesce(name, F.lit(0))
    score = F.col("confidence") + F.when(F.col("accepted"), 30).otherwise(0) + F.when(F.col("evidenced"), 15).otherwise(0) + 10 * n("concepts") + 20 * n("helpful")
    return met.filter(n("muted") == 0).select("id", score.cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(most)
