"""Quality rules: statistics of a text in Spark's own functions, and a learned decision list over them.

The list is learned on the driver from the statistics of a bounded sample of
labelled rows by sequential covering: conditions are added to a rule while they
gain (grow), dropped again while that helps on rows set aside (prune), and a
rule is kept if it is precise there; the rows that it covers are then left out.
The rules become one ordered CASE expression, so no Python runs on the data.

Words are runs of anything but space and \\t to \\r.  Nulls are empty texts.
A statistic that can't be computed (no words) is 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.labels import sample

#: Labelled rows for learning, at most.
SAMPLE = 4_000
#: A rule must be so precise on rows set aside, and cover so many of the grown ones.
PRECISION, SUPPORT = 0.9, 5
_WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: What conditions of the list may test.
MEASURES = ("symbol_share", "repeat_share", "dup_share", "upper_share", "mark_share", "mean_word", "n_words")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with the base statistics and the MEASURES derived from them.

    Repeats are found inside the row: the hashes of its three-word windows are
    sorted, equal neighbours give the windows that occur twice or more, and the
    distances of their places give the words covered.  Lambdas see nothing but
    their own variables, so no array is built anew for each element.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select(*keep, text.alias("t"))
    d = d.select(*keep, "t", F.filter(F.split("t", _WORD_BREAK), lambda w: w != "").alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    d = d.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("[!?]")).cast("long").alias("n_marks"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _windows(),
    )
    d = d.withColumn("w", F.sort_array("w"))
    neighbours = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    d = d.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(neighbours, lambda x: x.isNotNull()))))).drop("w")
    steps = F.zip_with(F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
    repeated = F.when(F.size("at") > 0, F.aggregate(steps, F.lit(3), lambda a, x: a + x)).otherwise(0).cast("long")
    d = d.withColumn("n_repeat_words", repeated).drop("at")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_repeat_words", "n_words").alias("repeat_share"), share("n_dup_lines", "n_lines").alias("dup_share"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_marks", "word_chars").alias("mark_share"), share("word_chars", "n_words").alias("mean_word"),
    )


def _windows() -> Column:
    n = F.greatest(F.size("words") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    hashes = F.zip_with(pairs, F.slice("words", F.lit(3), n), lambda h, c: F.xxhash64(h, c))
    return F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))).alias("w")


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.measure] > self.threshold if self.above else row[self.measure] <= self.threshold

    def column(self) -> Column:
        return F.col(self.measure) > self.threshold if self.above else F.col(self.measure) <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _candidates(rows: list[dict]) -> list[Condition]:
    """For each measure, thresholds at up to 24 places of its order."""
    out = []
    for m in MEASURES:
        values = sorted({r[m] for r in rows})
        cuts = {(values[i] + values[i - 1]) / 2 for k in range(1, 25) if 0 < (i := k * len(values) // 25) < len(values)}
        out += [Condition(m, above, c) for c in sorted(cuts) for above in (True, False)]
    return out


def _grow(rows: list[dict]) -> Rule:
    """Add the condition with the highest gain in information on bad rows, until none gains or all covered are bad."""
    rule: list[Condition] = []
    while len(rule) < 4:
        p = sum(r["bad"] for r in rows)
        if not p or p == len(rows):
            break
        best, gain = None, 1e-6
        for c in _candidates(rows):
            inside = [r["bad"] for r in rows if c.holds(r)]
            q = sum(inside)
            if q >= SUPPORT and (g := q * (math.log2(q / len(inside)) - math.log2(p / len(rows)))) > gain:
                best, gain = c, g
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if best.holds(r)]
    return tuple(rule)


def _worth(rule: Rule, rows: list[dict]) -> float:
    inside = [r["bad"] for r in rows if _covers(rule, r)]
    return (2 * sum(inside) - len(inside)) / len(inside) if inside else -1.0


def learn(rows: list[dict]) -> list[Rule]:
    """The decision list: rules for bad rows in the order they were found; each row has the MEASURES and `bad`."""
    rules: list[Rule] = []
    order = sorted(rows, key=lambda r: tuple(r[m] for m in MEASURES))
    grow, prune = [r for i, r in enumerate(order) if i % 3], order[::3]
    while any(r["bad"] for r in grow) and len(rules) < 20:
        rule = _grow(grow)
        while len(rule) > 1:
            shorter = max((rule[:k] for k in range(1, len(rule))), key=lambda x: _worth(x, prune))
            if _worth(shorter, prune) < _worth(rule, prune):
                break
            rule = shorter
        if not rule or _worth(rule, prune) < 2 * PRECISION - 1:
            break
        rules.append(rule)
        grow, prune = [r for r in grow if not _covers(rule, r)], [r for r in prune if not _covers(rule, r)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> list[Rule]:
    """Learn from the statistics of at most `limit` labelled rows; no rows, no rules."""
    rows = statistics(sample(docs, labels, label, limit), keep=("label",)).collect()
    return learn([{m: float(r[m]) for m in MEASURES} | {"bad": int(r.label == 0)} for r in rows])


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule of the list holds, tried in order."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition &= c.column()
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with the base statistics, base_failed, and kept: not base_failed and the list's verdict."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs, keep).select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
