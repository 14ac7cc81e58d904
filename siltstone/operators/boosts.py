"""Second passes over scored files (task_id, path, score, reasons): neighbours gain, weak or out-of-scope ones lose.

Each function returns the same rows with points added and a reason appended.  Reasons are short names,
as scoring gives them; a file keeps one row for each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.operators.scoring import Weights
from siltstone.sources.shared import written

#: Reasons that carry a file by themselves, in the penalties for scope, history and missing changes (fixed values).
SUPPORT = ("modified", "staged", "dependency", "dependent", "neighbour", "co-changed", "tests", "test for", "workspace")
STRONG = ("symbol", "content", "domain", "dependency", "dependent", "tests", "test for", "config", "release metadata", "knowledge", "co-changed")
META = ("role", "defines")
WEAK = ("filename", "symbol", "role", "defines", "calls")
FRONTEND = "component components frontend landing layout page pages preview previews public seo signup tool tools ui web".split()
BACKEND = "api backend controller controllers cron database db job jobs queue schema schemas service services worker workers".split()
FRONTEND_PATHS, BACKEND_PATHS = "^(src/(app|components|pages|data)|frontend|apps/web|web)/", "^(backend|server|apps/api)/"


def _has(reasons: tuple[str, ...] | list[str], column: str = "reasons") -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, reasons)))


def _add(scored: DataFrame, gains: DataFrame, keys: list[str]) -> DataFrame:
    """scored with gains (keys, amount, reason) added, where there are any; other columns stay."""
    rows, rest = scored.join(gains, keys, "left"), [c for c in scored.columns if c not in ("task_id", "path", "score", "reasons")]
    reasons = F.when(F.col("amount").isNull(), F.col("reasons")).otherwise(F.array_append("reasons", F.col("reason")))
    return rows.select("task_id", "path", (F.col("score") + F.coalesce("amount", F.lit(0.0))).alias("score"), reasons.alias("reasons"), *rest)


def _kind(scored: DataFrame, kind: str) -> Column:
    """Whether a path is of a kind: the column of that name, where scored brings it."""
    return F.col(kind) if kind in scored.columns else P.is_kind(F.col("path"), kind)


#: Bits of the table that tells which stems no source has.
BITS = 1 << 27


def _spots(stems: DataFrame) -> bytes:
    """A table of bits, of a size that doesn't grow: one is set for each stem that is there, by its checksum."""
    spot = F.crc32(F.col("stem").cast("binary")) % BITS + 1
    out, size = bytearray(BITS // 8), 4096  # bytes in one of Spark's bitmaps
    for b, bits in stems.filter("stem is not null").groupBy(F.bitmap_bucket_number(spot)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot))).collect():
        out[(b - 1) * size : b * size] = bits
    return bytes(out)


def _parts(tests: DataFrame, stems: DataFrame) -> DataFrame:
    """tests (test, stem) with each distinct part of its stem that may be one of stems: others, nearly all, are left out where they are made."""
    block = tests.sparkSession.sparkContext.broadcast(_spots(stems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, last = block.value, BITS - 1
        for batch in batches:
            rows, parts = [], []
            for k, text in enumerate(batch.column("stem").to_pylist()):
                n = len(text)
                for part in {"", *(text[i:j] for i in range(n) for j in range(i + 1, n + 1))}:
                    h = crc32(part.encode()) & last
                    if bits[h >> 3] >> (h & 7) & 1:
                        rows.append(k)
                        parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column("test").take(pa.array(rows, pa.int64())), pa.array(parts, pa.string())], ["test", "stem"])

    return tests.filter("stem is not null").mapInArrow(run, "test string, stem string")


def pair_tests(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(test, source): the source's stem is part of the test's.  An equality join on those parts of a test's stem that some source may have; sources are read twice."""
    stems = sources.select("source", P.stem(F.col("source")).alias("stem"))
    parts = _parts(tests.select("test", P.stem(F.col("test")).alias("stem")), stems)
    return parts.join(stems, "stem").select("test", "source").distinct()


#: Where a test of {stem} in the folder {parent} is by custom (fixed values).
TEST_PLACES = ("tests/{parent}/test_{stem}.py", "test_{stem}.py", "tests/test_{stem}.py", "{stem}.test.ts", "{stem}.spec.ts", "{stem}.test.js", "{stem}.spec.js", "__tests__/{stem}.test.ts", "__tests__/{stem}.test.js")


def related_tests(paths: DataFrame) -> DataFrame:
    """(source, test): the usual places of a source's test, of those that are there."""
    parent = F.coalesce(F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2), F.lit(""))
    fill = lambda place: F.replace(F.replace(F.lit(place), F.lit("{parent}"), parent), F.lit("{stem}"), P.stem(F.col("path")))
    wanted = paths.select(F.col("path").alias("source"), F.explode(F.array(*map(fill, TEST_PLACES))).alias("test"))
    return wanted.join(paths.select(F.col("path").alias("test")), "test", "left_semi").select("source", "test").distinct()


def _upper_median(rows: DataFrame) -> DataFrame:
    """(task_id, threshold): the score at the half of a task's scores, from below; told from counts, so that no task's rows are sorted."""
    counts = rows.groupBy("task_id", "score").agg(F.count("*").alias("n"))
    task = Window.partitionBy("task_id")
    placed = counts.withColumn("upto", F.sum("n").over(task.orderBy("score"))).withColumn("half", F.floor(F.sum("n").over(task) / 2))
    return placed.filter((F.col("upto") - F.col("n") <= F.col("half")) & (F.col("half") < F.col("upto"))).select("task_id", F.col("score").alias("threshold"))


def paired_tests(scored: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Tests of sources that score at least the upper median of a task's positive sources; the first source by path is named."""
    test = _kind(scored, "test_file")
    threshold = _upper_median(scored.filter(~test & (F.col("score") > 0)).select("task_id", "score"))
    sources = scored.filter(~test & ~_kind(scored, "config_file")).join(F.broadcast(threshold), "task_id").filter("score >= threshold").select("task_id", F.col("path").alias("source"))
    tests = scored.filter(test & ~F.exists("reasons", lambda r: r.contains("test for"))).select("task_id", F.col("path").alias("test"))
    # parts of names are taken once for each file, whatever the number of tasks
    pairs = written(pair_tests(tests.select("test").distinct(), sources.select("source").distinct()), "test-pairs")
    # few files are of a pair: others leave before the rows of tasks meet
    met = tests.join(pairs, "test").join(sources.join(pairs.select("source").distinct(), "source", "left_semi"), ["task_id", "source"])
    gains = met.groupBy("task_id", F.col("test").alias("path")).agg(F.concat(F.lit("test for "), F.min("source")).alias("reason")).withColumn("amount", F.lit(w.tests))
    return _add(scored, written(gains, "test-gains"), ["task_id", "path"])


def cross_layer(scored: DataFrame, terms: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Parts of a system that share a subject word with the task, or with an entry point among its five best files."""
    best = scored.filter("score > 0").withColumn("k", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "path")))
    threshold = best.filter("k <= 5").groupBy("task_id").agg(F.min("score").alias("threshold"))
    path = F.col("path")
    seeds = scored.filter(P.has_role(path, P.ENTRY_WORDS)).join(F.broadcast(threshold), "task_id").filter("score >= threshold")
    words = seeds.select("task_id", F.explode(P.domain_tokens(path)).alias("term")).unionByName(terms.select("task_id", "term")).filter(~F.col("term").isin(*P.NOISE_WORDS)).distinct()
    parts = scored.filter(P.has_role(path, P.ROLE_WORDS) & ~_has(["cross-layer"])).select("task_id", "path", F.explode(P.domain_tokens(path)).alias("term"))
    gains = parts.join(words, ["task_id", "term"], "left_semi").select("task_id", "path").distinct().join(threshold.select("task_id"), "task_id", "left_semi")
    return _add(scored, gains.select("task_id", "path", F.lit(w.cross_layer).alias("amount"), F.lit("cross-layer").alias("reason")), ["task_id", "path"])


def api_pairs(scored: DataFrame, terms: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Endpoints of the family of a strong one: families are the first part of the API path, the best endpoint is the seed."""
    own = scored.withColumn("key", P.api_key(F.col("path"))).filter("key is not null").withColumn("parts", F.split(F.expr("substring(key, 6)"), "/")).withColumn("family", F.col("parts")[0])
    asked = own.select("task_id", "path", F.explode("parts").alias("term")).join(terms.filter(~F.col("term").isin(*P.NOISE_WORDS)).select("task_id", "term"), ["task_id", "term"], "left_semi").select("task_id", "path").distinct().withColumn("asked", F.lit(True))
    rows = own.join(asked, ["task_id", "path"], "left").withColumn("asked", F.coalesce("asked", F.lit(False))).withColumn("owner", _has(["API owner"]))
    enough = rows.groupBy("task_id").count().filter("count >= 2").select("task_id")
    fit = rows.join(enough, "task_id", "left_semi").filter((F.col("score") >= 90) | F.col("owner")).filter(F.col("owner") | F.col("asked"))
    best = fit.groupBy("task_id", "family").agg(F.max("score").alias("top"))
    seeds = fit.join(best, ["task_id", "family"]).filter("score = top").groupBy("task_id", "family").agg(F.min_by(F.struct("path", "key"), "path").alias("seed"))
    gain = F.lit(min(85.0, w.cross_layer + 15.0)) + F.when(F.col("asked"), 25.0).otherwise(0.0)
    gains = rows.join(seeds, ["task_id", "family"]).filter("path != seed.path").select("task_id", "path", gain.alias("amount"), F.concat(F.lit("API pair with "), F.col("seed.key")).alias("reason"))
    return _add(scored, gains, ["task_id", "path"])


def api_consumers(scored: DataFrame, calls: DataFrame, terms: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Files that own an API path which a positive front-end file calls; calls: (path, key).  The last owner by path has a key."""
    owners = scored.select("task_id", F.col("path").alias("owner"), P.api_key(F.col("path")).alias("key")).filter("key is not null").groupBy("task_id", "key").agg(F.max("owner").alias("owner"))
    path = F.col("path")
    front = path.rlike(r"(?i)\.(tsx|jsx)$") | P.has_role(path, ["component", "components", "page", "pages", "client", "dashboard"])
    used = scored.filter(front & (F.col("score") > 0)).select("task_id", "path").join(calls, "path").join(owners, ["task_id", "key"]).filter("owner != path")
    known = terms.filter(~F.col("term").isin(*P.NOISE_WORDS)).groupBy("task_id").agg(F.collect_set("term").alias("known"))
    used = used.join(known, "task_id", "left")
    hit = F.coalesce(F.arrays_overlap(F.split(F.expr("substring(key, 6)"), "/"), "known"), F.lit(False))
    gain = F.lit(min(150.0, 90.0 + w.cross_layer * 0.6)) + F.when(hit, 45.0).otherwise(0.0)
    best = used.withColumn("amount", gain).groupBy("task_id", "owner").agg(F.max("amount").alias("amount"))
    gains = best.select("task_id", F.col("owner").alias("path"), "amount", F.lit("API producer").alias("reason"))
    return _add(scored, gains, ["task_id", "path"])


def _seeds(scored: DataFrame, fits: Column, order: list[Column], limit: int) -> DataFrame:
    return scored.filter(fits).withColumn("k", F.row_number().over(Window.partitionBy("task_id").orderBy(*order))).filter(F.col("k") <= limit)


def recall_neighbours(scored: DataFrame, edges: DataFrame, changed: DataFrame, w: Weights = Weights(), limit: int = 8) -> DataFrame:
    """Neighbours (src, dst in either direction) of a task's eight strongest seeds: changed files first, then scores of 120 or more."""
    marked = scored.join(changed.select("path").distinct().withColumn("is_changed", F.lit(True)), "path", "left").withColumn("is_changed", F.coalesce("is_changed", F.lit(False)))
    seeds = _seeds(marked, F.col("is_changed") | (F.col("score") >= 120), [F.desc("is_changed"), F.desc("score"), F.col("path")], limit)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = seeds.select("task_id", F.col("path").alias("src"), "is_changed", "k").join(both, "src").filter("src != dst")
    amount = w.neighbour + F.when(F.col("is_changed"), 8.0).otherwise(0.0)
    best = near.withColumn("amount", amount).groupBy("task_id", F.col("dst").alias("path")).agg(F.max_by(F.struct("amount", "src"), F.struct("amount", -F.col("k"))).alias("b"))
    gains = best.select("task_id", "path", "b.amount", F.concat(F.lit("neighbour of "), F.col("b.src")).alias("reason"))
    return _add(scored, gains, ["task_id", "path"])


def second_pass(scored: DataFrame, edges: DataFrame, terms: DataFrame, w: Weights = Weights(), limit: int = 10, most: int = 32) -> DataFrame:
    """Files two steps from one of a task's ten best that share a subject word, or are configuration: at most 32 gain."""
    carried = _has(["modified", "staged", "workspace", "cross-layer", "neighbour", "co-changed"])
    seeds = _seeds(scored, (F.col("score") >= 100) | carried, [F.desc("score"), F.col("path")], limit).select("task_id", F.col("path").alias("seed"), "k")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().filter("src != dst")
    # what is near is little and written, so that it needn't be sorted with all rows to be looked up among them
    seeds = written(seeds, "seeds")
    there = lambda near, name: written(near, name).join(scored.select("task_id", "path"), ["task_id", "path"])
    first = written(there(seeds.join(both, F.col("seed") == F.col("src")).select("task_id", "seed", "k", F.col("dst").alias("path")), "near"), "first")
    step = first.select("task_id", "seed", "k", F.col("path").alias("src")).join(both, "src").select("task_id", "seed", "k", F.col("dst").alias("path")).distinct().filter("path != seed")
    second = written(there(step.join(first.select("task_id", "seed", "path"), ["task_id", "seed", "path"], "left_anti"), "steps"), "second")
    subject = seeds.select("task_id", "seed", F.explode(P.domain_tokens(F.col("seed"))).alias("term")).unionByName(seeds.join(terms.filter(~F.col("term").isin(*P.NOISE_WORDS)), "task_id").select("task_id", "seed", "term")).distinct()
    shares = second.select("task_id", "seed", "path", F.explode(P.domain_tokens(F.col("path"))).alias("term")).join(subject, ["task_id", "seed", "term"], "left_semi").select("task_id", "seed", "path").distinct().withColumn("shares", F.lit(True))
    rows = second.join(shares, ["task_id", "seed", "path"], "left").withColumn("shares", F.coalesce("shares", F.lit(False)))
    fit = rows.filter(F.col("shares") | P.is_kind(F.col("path"), "config_file")).withColumn("amount", w.neighbour * 0.5 + F.when(F.col("shares"), 4.0).otherwise(0.0))
    best = fit.groupBy("task_id", "path").agg(F.max("amount").alias("amount"))
    kept = best.withColumn("j", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("amount"), "path"))).filter(F.col("j") <= most)
    return _add(scored, written(kept.select("task_id", "path", "amount", F.lit("second pass").alias("reason")), "second-gains"), ["task_id", "path"])


def workspaces(scored: DataFrame, places: DataFrame, active: DataFrame, edges: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Files of a task's active workspaces, of those these depend on, and of those that depend on them.

    places: (path, workspace); active: (task_id, workspace); edges: (workspace, needs).
    """
    role = active.select("task_id", "workspace", F.lit(1).alias("role"))
    needs = active.join(edges, "workspace").select("task_id", F.col("needs").alias("workspace"), F.lit(2).alias("role"))
    needed = active.join(edges.select("workspace", F.col("needs").alias("w")), F.col("w") == active["workspace"]).select("task_id", edges["workspace"], F.lit(3).alias("role"))
    roles = role.unionByName(needs).unionByName(needed).groupBy("task_id", "workspace").agg(F.min("role").alias("role"))
    met = scored.select("task_id", "path").join(places, "path").join(roles, ["task_id", "workspace"])
    amount = F.when(F.col("role") == 1, w.workspace).when(F.col("role") == 2, w.neighbour).otherwise(w.neighbour * 0.5)
    name = F.when(F.col("role") == 1, "workspace").when(F.col("role") == 2, "workspace dependency").otherwise("workspace dependent")
    return _add(scored, met.select("task_id", "path", amount.alias("amount"), name.alias("reason")), ["task_id", "path"])


def _settle(scored: DataFrame, cases: list[tuple[Column, Column, str]], free: Column | None = None) -> DataFrame:
    """The first case that holds gives the new score and a reason; rows that are `free` stay as they are."""
    score, reason = F.when(F.lit(False), 0.0), F.when(F.lit(False), "")
    for holds, value, name in cases:
        holds = holds if free is None else holds & ~free
        score, reason = score.when(holds, value), reason.when(holds, name)
    score = score.otherwise(F.col("score"))
    return scored.select("task_id", "path", score.alias("score"), F.when(reason.isNull(), F.col("reasons")).otherwise(F.array_append("reasons", reason)).alias("reasons"))


def scope_of(words: Column, frontend_changed: Column, backend_changed: Column) -> Column:
    """frontend_only, backend_only or mixed: by what has changed, else by the words of the task."""
    front, back = F.size(F.array_intersect(words, F.array(*map(F.lit, FRONTEND)))) > 0, F.size(F.array_intersect(words, F.array(*map(F.lit, BACKEND)))) > 0
    changed = F.when((frontend_changed > 0) & (backend_changed == 0), "frontend_only").when((backend_changed > 0) & (frontend_changed == 0), "backend_only")
    return F.coalesce(changed, F.when(front & ~back, "frontend_only").when(back & ~front, "backend_only").otherwise("mixed"))


def scope_penalties(scored: DataFrame, scopes: DataFrame, changed: DataFrame) -> DataFrame:
    """Files of the other side lose; weak ones of a generic task, or without changes, lose all.  scopes: (task_id, scope, generic_share, live)."""
    rows = scored.join(scopes, "task_id", "left").join(changed.select("path").distinct().withColumn("is_changed", F.lit(True)), "path", "left")
    path, score = F.col("path"), F.col("score")
    out = ((F.col("scope") == "frontend_only") & path.rlike(BACKEND_PATHS)) | ((F.col("scope") == "backend_only") & path.rlike(FRONTEND_PATHS))
    support = _has(SUPPORT)
    gone = out & ~support & ~_has(["content"]) & (~F.col("live") | (F.col("generic_share") >= 0.35))
    loss = F.greatest(F.lit(25.0), score * F.when(support, 0.45).otherwise(0.6))
    return _settle(rows, [(gone, F.lit(0.0), "scope suppressed"), (out, F.greatest(F.lit(0.0), score - loss), "scope dampened")], F.coalesce("is_changed", F.lit(False)))


def history_penalties(scored: DataFrame, noise: DataFrame, shares: DataFrame, changed: DataFrame) -> DataFrame:
    """Files that were noise before lose; noise: (path, n), shares: (task_id, generic_share)."""
    rows = scored.join(noise, "path", "left").join(shares, "task_id", "left").join(changed.select("path").distinct().withColumn("is_changed", F.lit(True)), "path", "left")
    n, strong = F.coalesce("n", F.lit(0)), _has(STRONG)
    loss = F.least(F.lit(45.0), n * 6.0 + F.greatest(F.lit(0), n - 2) * 4.0)
    cases = [
        ((n > 0) & (F.col("generic_share") >= 0.35) & (n >= 4) & ~strong, F.lit(0.0), "repeat noise"), ((n >= 6) & ~strong & _has(WEAK), F.lit(0.0), "repeat weak noise"),
        (n > 0, F.greatest(F.lit(0.0), F.col("score") - loss), "history noise"),
    ]
    return _settle(rows, cases, F.coalesce("is_changed", F.lit(False)))


def quiet_guard(scored: DataFrame, shares: DataFrame) -> DataFrame:
    """Where nothing has changed, files that only their name or summary brings lose; more so for generic tasks."""
    rows = scored.join(shares, "task_id", "left")
    broad, name, strong, score = F.col("generic_share") >= 0.3, _has(["filename"]), _has(STRONG), F.col("score")
    cases = [
        (broad & name & ~strong, F.least(score, F.greatest(F.lit(0.0), score * 0.2)), "broad weak signal"), (name & ~strong, F.least(score, F.greatest(F.lit(0.0), score * 0.35)), "name only"),
        (broad & _has(META) & ~strong, F.greatest(F.lit(0.0), score * 0.45 - 15), "broad summary"),
    ]
    return _settle(rows, cases)


def memory_boosts(scored: DataFrame, feedback: DataFrame, episodes: DataFrame, changed: DataFrame) -> DataFrame:
    """The greater of what feedback and earlier episodes add, (task_id, path, boost) each; changed files need none."""
    both = feedback.select("task_id", "path", F.col("boost").alias("f")).join(episodes.select("task_id", "path", F.col("boost").alias("e")), ["task_id", "path"], "full")
    both = both.join(changed.select("path").distinct(), "path", "left_anti")
    amount = F.greatest(F.coalesce("f", F.lit(0.0)), F.coalesce("e", F.lit(0.0)))
    gains = both.select("task_id", "path", amount.alias("amount"), F.when(F.col("e").isNotNull(), "similar episode").otherwise("missed before").alias("reason")).filter("amount > 0")
    return _add(scored, gains, ["task_id", "path"])


def requested(scored: DataFrame, paths: DataFrame) -> DataFrame:
    """Files that a request names score 1,000 at least; the reason comes first and once."""
    rows = scored.join(paths.select("path").distinct().withColumn("named", F.lit(True)), "path", "left")
    reasons = F.when(F.col("named") & ~_has(["requested"]), F.array_prepend("reasons", F.lit("requested"))).otherwise(F.col("reasons"))
    return rows.select("task_id", "path", F.when(F.col("named"), F.greatest("score", F.lit(1000.0))).otherwise(F.col("score")).alias("score"), reasons.alias("reasons"))
