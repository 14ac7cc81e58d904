"""What a selection could have taken in the place of what it took: better files of the same scope, displaced files, and noise that may be useful."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import paths as P

#: Folders that a scope begins at, in the order in which they are looked for, with the parts below them that count (fixed values).
MARKERS = (("src", 2), ("lib", 2), ("app", 2), ("packages", 1), ("tests", 1), ("test", 1), ("integration", 1))
#: Reasons by what they add to a file's evidence, and why a file that was left out could have been taken (fixed values).
STRONG = "^(direct content|dependency|dependent|tests|test for|co-changed|phrase|literal|calls|defines|entrypoint|env read|external system|side effect|multi-term|release metadata|workspace)"
NAMED, FRESH = "^(filename|symbol)", "^(recent|churn)"
LEFT_FOR_ROOM = "(?i)budget|cap|compressed|summarized|stronger support"
IDLE_FAMILIES = ("examples", "fixtures", "generated", "docs")
#: Evidence is counted in thousandths, so that sums of it are exact.
UNIT = 1000


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda p: p != "")


def diagnostic_scope(path: Column) -> Column:
    """The folders from the root to a marker and a little below it; two parts of deep paths without one, else the first."""
    parts = _parts(path)
    n, out = F.size(parts), None
    first = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    for marker, depth in MARKERS:
        at = F.array_position(parts, marker).cast("int")
        length = at + F.least(F.lit(depth), F.greatest(F.lit(0), n - at - 1))
        if marker == "packages":
            length = F.when(n > at + 1, at + 2).otherwise(length)
        out = F.when(at > 0, first(length)) if out is None else out.when(at > 0, first(length))
    return out.when(n > 2, first(F.lit(2))).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))


def workspace_package(path: Column) -> Column:
    """The package or application that a path is in, two parts of the usual containers, else its first part."""
    parts = _parts(path)
    n, out = F.size(parts), None
    first = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    for container in ("packages", "apps"):
        at = F.array_position(parts, container).cast("int")
        inside = (at > 0) & (n > at)
        out = F.when(inside, first(at + 1)) if out is None else out.when(inside, first(at + 1))
    head = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return out.when(head.isin("integration", "examples", "playground") & (n > 1), first(F.lit(2))).otherwise(head)


def strong(reasons: Column) -> Column:
    return F.exists(reasons, lambda r: r.rlike(STRONG))


def evidence(path: Column, score: Column, hits: Column, reasons: Column) -> Column:
    """What speaks for a file, in thousandths: a quarter of its score up to 300, its hits up to six, its reasons, less for idle families."""
    points = F.aggregate(reasons, F.lit(0), lambda a, r: a + F.when(r.rlike(STRONG), 55).when(r.rlike(NAMED), 12).when(r.rlike(FRESH), 5).otherwise(0))
    whole = F.least(hits, F.lit(6)) * 18 + points - F.when(P.family(path).isin(*IDLE_FAMILIES), 25).otherwise(0)
    return (F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(300.0)) * (UNIT // 4)) + whole * UNIT).cast("long")


def by_score(rows: DataFrame, group: str) -> DataFrame:
    """(group, score, rank, used) for each distinct score: `rank` from 1, and `used`, the tokens of all rows of at least that score.

    The sums are made before the shuffle; no group is sorted row by row.
    """
    sums = rows.groupBy(group, "score").agg(F.count("*").alias("_n"), F.sum("tokens").alias("_t"))
    w = Window.partitionBy(group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return sums.select(group, "score", (F.sum("_n").over(w) - F.col("_n") + 1).alias("rank"), F.sum("_t").over(w).alias("used"))


def standing(rows: DataFrame, group: str) -> DataFrame:
    """rows (group, score, tokens, ...) with the `rank` and the `used` of their score."""
    return rows.join(by_score(rows, group), [group, "score"])


def _upward(scope: Column) -> Column:
    """A scope and those it lies in."""
    parts = F.split(scope, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def opportunities(rows: DataFrame, group: str, n: int = 20, least_gain: int = 25) -> DataFrame:
    """The n best exchanges of each group: a missed file for a selected one of no fewer tokens in a related scope, by the gain in evidence.

    rows: (group, path, rank, score, hits, reasons, tokens, selected, expected, why).  Missed files are expected and were left out for want of
    room (`why`); scopes are related if equal or if one lies in the other.  Order: gain, tokens saved, ranks, paths.  Rows with a null in what decides
    are left out, null hits and reasons are none; a path that comes twice in a group counts twice.

    Not all pairs are made.  Each pair meets in one cell, that of the outer scope.  A row of a cell for which n others of its side are at least
    as good in evidence and in tokens can be in none of the n best pairs, and goes before the shuffle (each partition) already; what is left of a
    cell is one stream by tokens, of which the n best missed files so far and the n best pairs are kept.
    """
    c = F.col
    rows = rows.dropna(subset=[group, "path", "rank", "score", "tokens"]).filter("tokens > 0")
    missed = c("expected") & ~c("selected") & F.coalesce(c("why").rlike(LEFT_FOR_ROOM), F.lit(False))
    side = F.when(missed, 0).when(c("selected") & ~c("expected"), 1)
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    kept = rows.withColumn("side", side).filter("side is not null").select(
        group, "side", "path", c("rank").cast("long").alias("rank"), c("tokens").cast("long").alias("tokens"), diagnostic_scope(c("path")).alias("scope"),
        evidence(c("path"), c("score"), F.coalesce("hits", F.lit(0)), reasons).alias("evidence"),
    )
    up = _upward(c("scope"))
    tagged = lambda tag, scopes: F.transform(scopes, lambda s: F.concat(F.lit(tag), s))
    own = F.array(c("scope"))
    # "o" cells: the selected file's scope holds the missed one's or is the same; "i" cells: it lies in the missed one's
    cells = F.when(c("side") == 0, F.concat(tagged("o", up), tagged("i", own))).otherwise(F.concat(tagged("o", own), tagged("i", F.slice(up, F.lit(1), F.size(up) - 1))))
    met = kept.withColumn("cell", F.explode(cells))
    sign = F.when(c("side") == 0, 1).otherwise(-1)
    met = met.withColumns({"worse": -sign * c("evidence"), "cost": sign * c("tokens")})
    columns = [group, "cell", "side", "path", "rank", "tokens", "scope", "evidence", "cost"]
    thin = met.sortWithinPartitions(group, "cell", "side", "worse", "cost", "rank", "path").select(*columns).mapInArrow(_thinner(n), met.select(*columns).schema)
    streams = thin.repartition(group, "cell").sortWithinPartitions(group, "cell", "tokens", "side", "path")
    kinds = [("missed", "string"), ("noise", "string"), ("scope", "string"), ("missed_rank", "long"), ("noise_rank", "long"), ("missed_tokens", "long"), ("noise_tokens", "long"), ("missed_evidence", "long"), ("noise_evidence", "long"), ("gain", "long")]
    schema = T.StructType([rows.schema[group], *[T.StructField(k, T.LongType() if t == "long" else T.StringType()) for k, t in kinds]])
    pairs = streams.mapInArrow(_pairer(group, n, least_gain * UNIT, schema.names), schema)
    order = Window.partitionBy(group).orderBy(F.desc("gain"), c("missed_tokens") - c("noise_tokens"), "missed_rank", "noise_rank", "missed", "noise")
    return pairs.withColumn("place", F.row_number().over(order)).filter(c("place") <= n)


def _thinner(n: int):
    """Keeps the rows of a cell's side before which, in their order, fewer than n stand that cost no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        least: list[int] = []
        for batch in batches:
            keep = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for i, (key, cost) in enumerate(zip(keys, batch.column("cost").to_pylist(), strict=True)):
                if key != now:
                    now, least = key, []
                if len(least) < n or least[-1] > cost:
                    keep.append(i)
                    insort(least, cost)
                    del least[n:]
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def _pairer(group: str, n: int, least_gain: int, names: list[str]):
    """The n best pairs of each cell, from a stream by tokens in which missed files come before selected ones of as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        best: list[tuple] = []
        pairs: list[tuple] = []
        kind: pa.DataType | None = None

        def cell() -> pa.RecordBatch:
            rows = [(now[0], m, o, scope, mr, nr, mt, nt, me, ne, me - ne) for _, _, mr, nr, m, o, scope, mt, nt, me, ne in sorted(pairs)[:n]]
            kinds = [kind, *[pa.string()] * 3, *[pa.int64()] * 7]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field(group).type
            for r in batch.to_pylist():
                if (r[group], r["cell"]) != now:
                    if pairs:
                        yield cell()
                    now, best, pairs = (r[group], r["cell"]), [], []
                if r["side"] == 0:
                    insort(best, (-r["evidence"], r["tokens"], r["rank"], r["path"], r["scope"]))
                    del best[n:]
                    continue
                for worse, tokens, rank, path, scope in best:
                    if -worse - r["evidence"] < least_gain:
                        break
                    pairs.append((worse + r["evidence"], tokens - r["tokens"], rank, r["rank"], path, r["path"], scope, tokens, r["tokens"], -worse, r["evidence"]))
                if len(pairs) > 50 * n:
                    pairs = sorted(pairs)[:n]
        if pairs:
            yield cell()

    return run


def displaced(receipts: DataFrame, scored: DataFrame) -> DataFrame:
    """(task_id, displaced, challenger, scores, ranks, displaced_tokens): who took whose place, by the receipts of a selection.

    receipts: (task_id, step, path, action, tokens, reason); scored: (task_id, path, score, rank).  The tokens are those that the displaced file had
    when it was last taken; files that aren't scored have null scores.
    """
    taken = F.when(F.col("action") != "excluded", F.col("tokens"))
    before = Window.partitionBy("task_id", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    gone = receipts.withColumn("displaced_tokens", F.last(taken, ignorenulls=True).over(before)).filter(F.col("reason").startswith("replaced by ") & (F.col("action") == "excluded"))
    gone = gone.select("task_id", "step", F.col("path").alias("displaced"), F.substring("reason", F.lit(13), F.length("reason")).alias("challenger"), "displaced_tokens")
    for side in ("displaced", "challenger"):
        gone = gone.join(scored.select("task_id", F.col("path").alias(side), F.col("score").alias(f"{side}_score"), F.col("rank").alias(f"{side}_rank")), ["task_id", side], "left")
    return gone


def label_audit(rows: DataFrame, group: str) -> DataFrame:
    """Per group: selected files that weren't expected, those of them that may be useful all the same, and precision by tokens without the rest.

    rows: (group, path, reasons, tokens, selected, expected).  Useful may be what lies in a scope related to an expected file's, in a package of one, or, with
    strong evidence, in a family of one.  Expected files are brought to distinct keys, so a selected file meets a few rows, however many are expected.
    """
    c = F.col
    scope, package, family = diagnostic_scope(c("path")), workspace_package(c("path")), P.family(c("path"))
    tagged = lambda tag, values: F.transform(values, lambda s: F.concat(F.lit(tag), s))
    rows = rows.dropna(subset=[group, "path", "tokens"])
    named = F.concat(tagged("package ", F.filter(F.array(package), lambda p: p != "")), tagged("family ", F.array(family)))
    wanted = rows.filter("expected").select(group, F.explode(F.concat(tagged("holds ", _upward(scope)), tagged("in ", F.array(scope)), named)).alias("key")).distinct()
    useful = F.filter(F.concat(tagged("holds ", F.array(scope)), tagged("in ", _upward(scope)), named), lambda k: ~k.startswith("family ") | F.coalesce(strong(c("reasons")), F.lit(False)))
    noise = rows.filter("selected and not expected").select(group, "path", "tokens", useful.alias("keys"))
    hit = noise.select(group, "path", F.explode("keys").alias("key")).join(wanted, [group, "key"], "left_semi").select(group, "path").distinct()
    judged = noise.drop("keys").join(hit.withColumn("_useful", F.lit(True)), [group, "path"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    per = judged.groupBy(group).agg(F.count("*").alias("noise"), F.sum("tokens").alias("noise_tokens"), F.count("_useful").alias("useful"), F.sum(F.when(c("_useful"), c("tokens"))).alias("useful_tokens"))
    packed = rows.filter("selected").groupBy(group).agg(F.sum("tokens").alias("packed"))
    out = packed.join(per, group, "left").select(group, "packed", *[zero(c(k)).alias(k) for k in ("noise", "noise_tokens", "useful", "useful_tokens")])
    out = out.withColumn("audited_tokens", c("noise_tokens") - c("useful_tokens"))
    return out.withColumn("adjusted_precision", F.round(1 - c("audited_tokens") / F.nullif("packed", F.lit(0)), 3))
