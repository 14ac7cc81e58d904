"""Selecting scored files under a budget of tokens: include modes, downgrades, caps for families, displacement, receipts.

What a decision depends on is computed as columns (`prepared`); the choice itself is one ordered fold for
each task, over a sorted stream.  Its state is what is selected, which the budget bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import paths as P
from siltstone.sources.shared import written

#: Reasons by what they prove (fixed values).
DIRECT = ("symbol", "domain", "defines", "calls", "phrase", "path phrase")
ACTIONABLE = ("direct content", "dependency", "co-changed", "phrase", "path phrase", "literal definition", "calls", "defines", "literal", "release metadata", "dependent", "workspace", "build metadata", "tests")
SUPPORTING = ("dependency", "dependent", "co-changed", "tests", "release metadata", "build metadata", "secret", "domain", "calls")
EXPANSION = ("workspace", "large supported", "second pass")
WEAK_SIGNAL = ("broad weak signal", "name only", "broad summary")
STANDING_ONLY = ("modified", "staged", "recent", "churn", "large unrelated", *WEAK_SIGNAL)
INFRA = "(?i)alb|aws|cfn|cloud|copilot|deploy|ecs|iam|infra|lambda|manifest|override|pipeline|rollback|security|waf|workflow"
#: Headings of omitted files by what their first reason says, in order; the rest keeps its own name (fixed values).
BUCKETS = (
    ("related_test", "^test for|^tests$"), ("caller_or_reverse_dependency", "^dependent"), ("direct_evidence", "^(dependency|direct content)"), ("literal_or_phrase_match", "phrase|^literal"),
    ("symbol_or_entrypoint_match", "^(calls|defines|symbol)"), ("side_effect_or_external_match", "^secret"), ("multi_term_path_match", "^multi-term"), ("api_route_owner_match", "^API owner"),
    ("api_endpoint_pair", "^API pair"), ("api_producer_for_frontend_call", "^API producer"), ("weak_filename_only_match", "^weak filename"), ("broad_keyword_match", "^(domain|role)"),
    ("repo_metadata_match", "^(workspace|release|build)"), ("budget", "^budget"), ("marginal_slot_replaced", "^replaced by"),
)
#: Families of reasons, in order (fixed values).
REASON_FAMILIES = (
    ("filename", "^(filename|weak filename)"), ("symbol", "^(symbol|defines)"), ("content", "^(content|phrase|path phrase|literal)"), ("semantic", "^(calls|domain)"), ("graph", "^(dependency|dependent|tests|test for)"),
    ("history", "^(recent|co-changed|churn)"), ("metadata", "^(config|release|knowledge)"), ("summary", "^role"),
)


def _has(reasons: tuple[str, ...]) -> Column:
    return F.arrays_overlap("reasons", F.array(*map(F.lit, reasons)))


def _any(pattern: str) -> Column:
    return F.exists("reasons", lambda r: r.rlike(pattern))


def labelled(reason: Column, cases: tuple[tuple[str, str], ...], other: Column) -> Column:
    out = F.when(F.lit(False), "")
    for label, pattern in cases:
        out = out.when(reason.rlike(pattern), label)
    return out.otherwise(other)


def omitted_bucket(reason: Column) -> Column:
    return labelled(reason, BUCKETS, reason)


def reason_family(reason: Column) -> Column:
    return labelled(reason, REASON_FAMILIES, F.lit("other"))


#: What a decision depends on of a path alone, by the name of its column: rows may bring these columns, made once for each file.
PATH_FACTS: dict[str, Callable[[Column], Column]] = {
    **{f"path_{k}": lambda p, k=k: P.is_kind(p, k) for k in ("test_path", "docs_path", "example_path", "lock_or_generated", "deploy_config", "release_primary")},
    "path_source": P.source_path, "path_infra": lambda p: p.rlike(INFRA), "path_root_go": lambda p: ~p.contains("/") & p.rlike(r"(?i)\.go$"), "path_scope": P.replacement_scope,
    "path_high": lambda p: F.lower(p).rlike("^tests?/|/tests/|route|controller|api/|schema|migration|model"), "path_medium": lambda p: F.lower(p).rlike(r"config|\.env|deploy|settings"),
}


def path_facts(files: DataFrame) -> DataFrame:
    """files (path, ...) with the columns of PATH_FACTS."""
    return files.withColumns({name: fact(F.col("path")) for name, fact in PATH_FACTS.items()})


def omission_risk(score: Column) -> Column:
    """high, medium or low: what a reader would miss with the file."""
    high = _any("^(dependent|test for|tests$)") | F.col("path_high")
    medium = _any("^dependency$|config") | F.col("path_medium") | (score > 150)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def bucket(changed: Column) -> Column:
    """changed, docs, tests, deps or other: the first of each is put ahead when files have changed."""
    docs = F.col("path_docs_path") | _has(("knowledge",))
    tests = F.col("path_test_path") | F.col("_test_for")
    return F.when(changed, "changed").when(docs, "docs").when(tests, "tests").when(_has(("dependency", "dependent", "cross-layer", "tests")), "deps").otherwise("other")


def family_cap() -> Column:
    """struct(family, cap) of compressed files that only so many are taken of; null for files that need no cap."""
    of = lambda name, cap: F.struct(F.lit(name).alias("family"), F.lit(cap).alias("cap"))
    c, direct = F.col, F.col("path_source") & ~F.col("_config") & F.col("_direct")
    return (
        F.when(c("path_lock_or_generated"), F.when(c("_release"), of("lock-release", 1)).otherwise(of("lock-generated", 0))).when(c("_release"), of("release-metadata", 2))
        .when(c("path_test_path"), F.when(c("_asked"), of("tests", 4)).otherwise(of("tests", 2))).when(c("_config"), F.when(_has(("multi-term path",)), of("config", 2)).otherwise(of("config", 1)))
        .when(c("path_docs_path"), of("docs", 1)).when(c("path_example_path"), of("examples", 1)).when(direct, F.lit(None)).when(_has(EXPANSION) | F.exists("reasons", lambda r: r.startswith("neighbour")), of("expansion", 1))
    )


def prepared(rows: DataFrame, most_tokens: int = 4000) -> DataFrame:
    """rows (task_id, path, score, reasons, hits, tokens, summary_tokens, skeleton_tokens, changed, secret) with the columns of a decision.

    Missing hits are none; rows without task, path, score or tokens are left out.
    """
    c = F.col
    rows = rows.dropna(subset=["task_id", "path", "score", "tokens"]).withColumn("hits", F.coalesce("hits", F.lit(0)))
    own = rows.columns
    rows = rows if "path_test_path" in own else path_facts(rows)
    # each is used several times
    rows = rows.withColumns({"_test_for": F.exists("reasons", lambda r: r.startswith("test for")), "_config": _has(("config",)), "_direct": _has(DIRECT), "_release": _has(("release metadata",)), "_asked": _has(("test asked for",)), "_weak": _has(WEAK_SIGNAL), "_supporting": _has(SUPPORTING), "_backed": _has(ACTIONABLE)})
    test, config, direct, test_for, source, asked = c("path_test_path"), c("_config"), c("_direct"), c("_test_for"), c("path_source"), c("_asked")
    actionable = c("_backed") | test_for | (_has(("symbol", "multi-term path")) & (c("hits") >= 1)) | (_has(("role",)) & (c("hits") >= 4))
    rows = rows.withColumns({"_actionable": actionable, "_support": c("_supporting") | test_for, "_infra": c("path_infra") & (config | c("path_deploy_config")), "_primary": c("_release") & c("path_release_primary")})
    actionable, support, infra, primary = c("_actionable"), c("_support"), c("_infra"), c("_primary")
    role = (
        F.when(primary, 180.0).when(asked, 45.0).when(infra, 170.0).when(c("path_root_go") & source & direct & ~config, 230.0)
        .when(source & direct & ~config, 125.0).when(test_for, 30.0).otherwise(0.0)
    )
    value = F.least(F.lit(60.0), c("score") / F.greatest(F.lit(1), F.least("tokens", F.lit(most_tokens))) * 120.0)
    evidence = (
        F.least("score", F.lit(220.0)) * 0.25 + F.least("hits", F.lit(6)) * 18.0 + F.when(direct, 130.0).otherwise(0.0) + F.when(actionable, 95.0).otherwise(0.0) + F.when(support, 65.0).otherwise(0.0)
        + F.when(config & (c("hits") >= 2), 45.0).otherwise(0.0) + F.when(infra, 80.0).otherwise(0.0) + F.when(_has(("dependency", "dependent")), 60.0).otherwise(0.0) + F.when(_has(("workspace",)), 25.0).otherwise(0.0)
        - F.when(test & ~asked, 55.0).otherwise(0.0) - F.when(c("path_example_path"), 45.0).otherwise(0.0) - F.when(c("path_docs_path"), 40.0).otherwise(0.0)
        - F.when(c("_weak"), 60.0).otherwise(0.0) - F.when(source & (c("hits") <= 1) & ~_has(("direct content", "phrase", "path phrase", "calls")), 70.0).otherwise(0.0)
    )
    cap = family_cap()
    signal = F.exists("reasons", lambda r: ~r.isin(*STANDING_ONLY))
    return rows.select(
        *own, infra.cast("int").alias("infra"), signal.cast("int").alias("signal"), (c("score") + role + F.when(config, 25.0).otherwise(0.0) + value).alias("priority"), bucket(c("changed")).alias("bucket"),
        cap["family"].alias("family"), cap["cap"].alias("cap"), evidence.alias("evidence"), c("path_scope").alias("scope"), c("_weak").alias("weak"), support.alias("support"),
        (test & ~asked & ~actionable).alias("idle_test"), test.alias("test"), (source & (direct | actionable)).alias("owner"), primary.alias("primary"), (c("_release") & ~primary).alias("secondary"),
        omission_risk(c("score")).alias("risk"),
    )


#: With more changed files than this a task is under pressure, and takes so many of those without a signal of the task (fixed values).
MANY_CHANGED, UNRELATED = 5, 3


@dataclass(frozen=True)
class Rules:
    """How a selection is made: the mode, the budget and the caps; a cap of -1 allows none, 0 sets none."""

    mode: str = "balanced"
    budget: int = 6000
    most_tokens: int = 4000
    summaries: int = 8
    weak_signals: int = 2
    least_score: float = 0.0
    strict: bool = True


class Choice:
    """The fold over one task's candidates, best first."""

    def __init__(self, rules: Rules, many_changed: bool) -> None:
        self.rules, self.many_changed = rules, many_changed
        self.picked: list[dict] = []
        self.used = self.weak = self.unrelated = 0
        self.families: dict[str, int] = {}
        self.primary = False

    def _mode(self, r: dict) -> tuple[str, int]:
        """Include mode and its tokens, before the budget is looked at."""
        rules, short = self.rules, min(r["tokens"], 200) if r["summary_tokens"] is None else r["summary_tokens"]
        if r["changed"]:
            small = r["tokens"] <= min(600, rules.most_tokens)
            pressed = rules.budget < 12_000 or self.many_changed
            if r["tokens"] <= rules.most_tokens and (small or (r["signal"] and not pressed)):
                return "full", r["tokens"]
            if r["signal"]:
                return "symbols", min(r["tokens"], rules.most_tokens // 2)
            return ("skeleton", r["skeleton_tokens"]) if r["skeleton_tokens"] is not None else ("summary", short)
        if r["tokens"] <= rules.most_tokens and (r["secret"] or (rules.mode == "deep" and r["score"] >= 120)):
            return "full", r["tokens"]
        if not r["weak"] and r["skeleton_tokens"] is not None and r["score"] >= 160:
            return "skeleton", r["skeleton_tokens"]
        return "summary", short

    def _fallback(self, r: dict, mode: str) -> tuple[str, int] | None:
        """The cheaper of skeleton and summary that fits, for files that don't fit as they are."""
        if mode == "summary":
            return None
        short = min(r["tokens"], 200) if r["summary_tokens"] is None else r["summary_tokens"]
        options = [("summary", short)] + ([("skeleton", r["skeleton_tokens"])] if r["skeleton_tokens"] is not None else [])
        fits = [o for o in sorted(options, key=lambda o: o[1]) if self.used + o[1] <= self.rules.budget]
        return fits[0] if fits else None

    @staticmethod
    def _worth(r: dict, tokens: int) -> float:
        return r["evidence"] + (min(35.0, 1200.0 / max(tokens, 40)) if tokens > 0 else 0.0)

    def _weaker(self, r: dict, tokens: int, extra: int, family: str | None = None) -> int | None:
        """The selected compressed file that gives most when it makes room, if the gain is enough."""
        best, at = 0.0, None
        for i, other in enumerate(self.picked):
            if other["mode"] not in ("summary", "skeleton") or (family is not None and other["family"] != family):
                continue
            if other["scope"] is not None and other["scope"] != r["scope"]:
                inside = r["scope"] is not None and r["scope"].startswith(other["scope"] + "/")
                if not (inside and other["hits"] < 3):
                    continue
            delta = tokens - other["cost"]
            if delta > extra or (r["test"] and r["idle_test"] and (delta > 0 or other["owner"])):
                continue
            need = 70.0 + max(0, delta) * 0.15
            if delta <= 0 and r["owner"] and not other["owner"] and not other["primary"] and not other["test"]:
                need = 45.0
            gain = self._worth(r, tokens) - self._worth(other, other["cost"])
            if gain >= need and gain > best:
                best, at = gain, i
        return at

    def _displace(self, at: int, path: str) -> dict:
        gone = self.picked.pop(at)
        self.used -= gone["cost"]
        if gone["family"] is not None:
            self.families[gone["family"]] = max(0, self.families.get(gone["family"], 0) - 1)
        return {"path": gone["path"], "action": "excluded", "mode": None, "cost": 0, "why": f"replaced by {path}", "risk": gone["risk"]}

    def take(self, r: dict) -> list[dict]:
        """The receipts that a candidate brings about: of those it displaces, and its own last."""
        rules, out = self.rules, []
        no = lambda why: [*out, {"path": r["path"], "action": "excluded", "mode": None, "cost": 0, "why": why, "risk": r["risk"]}]
        if r["score"] <= 0:
            return no("score too low")
        if r["changed"] and not r["signal"] and self.many_changed:
            if self.unrelated >= UNRELATED:
                return no("unrelated changed-file cap")
            self.unrelated += 1
        if not r["changed"]:
            if rules.mode != "deep" and r["bucket"] == "docs":
                return no("docs disabled by mode")
            if r["weak"] and rules.weak_signals >= 0 and self.weak >= rules.weak_signals:
                return no("weak-signal cap")
            if self.primary and r["secondary"]:
                return no("secondary release metadata")
            full = rules.mode == "deep" and r["tokens"] <= rules.most_tokens
            if not full and r["score"] < rules.least_score and not r["secret"]:
                return no("score below floor")
        mode, cost = self._mode(r)
        if self.used + cost > rules.budget and (other := self._fallback(r, mode)):
            mode, cost = other
        if mode == "summary" and rules.summaries < 0:
            return no("summaries disabled")
        compressed = mode in ("summary", "skeleton") and not r["changed"]
        if compressed and rules.mode == "balanced" and r["idle_test"]:
            return no("test without direct evidence")
        if compressed and rules.strict and not r["support"] and not r["owner"]:
            return no("needs stronger support")
        extra = min(120, max(0, rules.budget - self.used))
        capped = compressed and rules.strict and rules.mode == "balanced" and r["family"] is not None
        if capped and self.families.get(r["family"], 0) >= r["cap"]:
            if (at := self._weaker(r, cost, extra, r["family"])) is None:
                return no(f"{r['family']} cap")
            out.append(self._displace(at, r["path"]))
        if compressed and rules.summaries > 0 and sum(p["mode"] in ("summary", "skeleton") for p in self.picked) >= rules.summaries:
            if (at := self._weaker(r, cost, extra)) is None:
                return no("compressed context cap")
            out.append(self._displace(at, r["path"]))
        if self.used + cost > rules.budget:
            if (at := self._weaker(r, cost, 0)) is None:
                return no("budget exhausted")
            out.append(self._displace(at, r["path"]))
            if self.used + cost > rules.budget:
                return no("budget exhausted")
        self.used += cost
        self.weak += r["weak"] and not r["changed"]
        self.primary |= r["primary"]
        if capped:
            self.families[r["family"]] = self.families.get(r["family"], 0) + 1
        self.picked.append({**r, "mode": mode, "cost": cost, "family": r["family"] if capped else None})
        return [*out, {"path": r["path"], "action": "included" if mode == "full" else "summarized", "mode": mode, "cost": cost, "why": r["why"], "risk": r["risk"]}]


    def _may_act(self, c: dict[str, np.ndarray], start: int, stop: int) -> np.ndarray:
        """Which of the rows from start to stop could change the choice as it stands; take() of any other would only exclude it.

        A row that meets a cap or the budget has to displace a selected one, whose worth it must exceed by 45 at least, 70 if it owns nothing.
        """
        rules, at = self.rules, slice(start, stop)
        whole, changed, many = c["whole"][at], c["changed"][at], self.many_changed
        compressed = [p for p in self.picked if p["mode"] in ("summary", "skeleton")]
        counts = np.array([self.families.get(f, 0) for f in c["families"]] + [0])
        met = self.used + c["cheapest"][at] > rules.budget
        if rules.summaries > 0 and len(compressed) >= rules.summaries:
            met |= ~whole
        if rules.strict and rules.mode == "balanced":
            met |= ~whole & (c["family"][at] >= 0) & (counts[c["family"][at]] >= c["cap"][at])
        worst = min((self._worth(p, p["cost"]) for p in compressed), default=np.inf)
        act = ~met | (c["most"][at] >= worst + np.where(c["owner"][at], 45.0, 70.0) - 1e-6)
        if rules.weak_signals >= 0 and self.weak >= rules.weak_signals:
            act &= ~c["weak"][at] | changed
        if self.primary:
            act &= ~c["secondary"][at] | changed
        if many:
            unrelated = changed & ~c["signal"][at]
            act = act & ~unrelated if self.unrelated >= UNRELATED else act | unrelated
        return act

    def take_all(self, c: dict[str, np.ndarray], start: int, stop: int) -> None:
        """take() of the rows from start to stop, in their order; those that can't change the choice are passed over."""
        while start < stop:
            end = min(stop, start + WINDOW)
            for i in start + np.flatnonzero(self._may_act(c, start, end)):
                before = self.unrelated
                *gone, own = self.take(_row(c, i))
                if gone or own["action"] != "excluded" or self.unrelated != before:
                    start = i + 1
                    break
            else:
                start = end


_COLUMNS = "task_id path score hits tokens summary_tokens skeleton_tokens changed secret signal bucket family cap evidence scope weak support idle_test test owner primary secondary risk n_changed".split()


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with each task in one partition.  Not by the task itself: Spark leaves that out after a join by task, which it may then run as a broadcast that keeps no task together."""
    return rows.repartition(F.xxhash64("task_id"))


def select_files(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(task_id, step, path, action, mode, tokens, reason, risk): a receipt for each decision, in their order.

    rows: see prepared(); n_changed counts a task's changed files.  One stream for each task, by nature: what a file
    brings depends on all that were taken before it.  The order is by infrastructure, change, signal, priority, score and path.  A
    displaced file has a second receipt that excludes it, so its last receipt counts; `selected` keeps those.
    """
    why = F.when(F.size("reasons") > 0, F.array_join(F.slice("reasons", 1, 2), ", ")).when(F.col("changed"), "changed").otherwise("score")
    ready = prepared(rows, rules.most_tokens).withColumn("why", why)
    # few rows a task are changed; their number is known before the fold begins
    counted = ready.filter("changed").groupBy("task_id").agg(F.count("*").alias("n_changed"))
    ready = ready.join(counted, "task_id", "left").withColumn("n_changed", F.coalesce("n_changed", F.lit(0)))
    ordered = _dealt(ready).sortWithinPartitions("task_id", F.desc("infra"), F.desc("changed"), F.desc("signal"), F.desc("priority"), F.desc("score"), "path").select(*_COLUMNS, "why")
    schema = T.StructType([rows.schema["task_id"], T.StructField("step", T.LongType()), rows.schema["path"], *[T.StructField(n, T.StringType()) for n in ("action", "mode")], T.StructField("tokens", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("reason", "risk")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice, now, step = None, None, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if choice is None or r["task_id"] != now:
                    choice, now, step = Choice(rules, r["n_changed"] > MANY_CHANGED), r["task_id"], 0
                for receipt in choice.take(r):
                    step += 1
                    out.append((now, step, receipt["path"], receipt["action"], receipt["mode"], receipt["cost"], receipt["why"], receipt["risk"]))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [batch.schema.field("task_id").type, pa.int64(), batch.schema.field("path").type, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

    return ordered.mapInArrow(run, schema)


#: Rows that are looked at at once; flags of a row that are handed on in one number.
WINDOW = 4096
_FLAGS = "changed secret signal docs weak support idle_test test owner primary secondary".split()
_NUMBERS, _MAYBE = ("score", "hits", "tokens", "evidence"), ("summary_tokens", "skeleton_tokens", "cap")


def _arrays(batch: pa.RecordBatch, rules: Rules) -> dict[str, np.ndarray]:
    """The columns of a batch, and what _may_act asks of each row."""
    flags = batch.column("flags").to_numpy()
    c = {name: (flags >> k & 1).astype(bool) for k, name in enumerate(_FLAGS)}
    c |= {name: batch.column(name).to_numpy(zero_copy_only=False) for name in _NUMBERS}
    c |= {name: pc.fill_null(batch.column(name).cast(pa.int64()), -1).to_numpy(zero_copy_only=False) for name in _MAYBE}
    c |= {f"no_{name}": batch.column(name).is_null().to_numpy(zero_copy_only=False) for name in _MAYBE}
    c |= {name: batch.column(name) for name in ("path", "scope")}
    family = batch.column("family").dictionary_encode()
    c["families"], c["family"] = family.dictionary.to_pylist(), pc.fill_null(family.indices, -1).to_numpy(zero_copy_only=False)
    tokens, none = c["tokens"], np.iinfo(np.int64).max
    options = [tokens, np.minimum(tokens, rules.most_tokens // 2), *(np.where(c[f"no_{name}"], none, c[name]) for name in ("summary_tokens", "skeleton_tokens")), np.where(c["no_summary_tokens"], np.minimum(tokens, 200), none)]
    c["cheapest"] = np.minimum.reduce(options)
    c["whole"] = c["changed"] | ((tokens <= rules.most_tokens) & (c["secret"] | ((rules.mode == "deep") & (c["score"] >= 120))))
    c["most"] = c["evidence"] + 1200.0 / np.maximum(c["cheapest"], 40)
    return c


def _row(c: dict[str, np.ndarray], i: int) -> dict:
    """One row, as take() wants it."""
    r = {name: c[name][i].item() for name in (*_FLAGS, *_NUMBERS)}
    r |= {name: None if c[f"no_{name}"][i] else c[name][i].item() for name in _MAYBE}
    family = c["family"][i]
    return r | {"path": c["path"][int(i)].as_py(), "scope": c["scope"][int(i)].as_py(), "family": None if family < 0 else c["families"][family], "bucket": "docs" if r["docs"] else "other", "why": None, "risk": None}


def chosen(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """What selected(select_files(rows, rules)) gives, without receipts: (task_id, path, mode, tokens); rows: one for each task and path.

    Rows that no state of the fold would take leave before they are sorted, and the fold passes over those that could not change
    what is selected so far: only the others are looked at one by one.
    """
    c = F.col
    ready = prepared(rows, rules.most_tokens).withColumn("docs", c("bucket") == "docs").withColumns({f: F.coalesce(c(f).cast("boolean"), F.lit(False)) for f in _FLAGS})
    counted = written(rows.filter("changed").dropna(subset=["path", "score", "tokens"]).groupBy("task_id").agg((F.count("*") > MANY_CHANGED).alias("many_changed")), "changed")
    whole = c("changed") | ((c("tokens") <= rules.most_tokens) & (c("secret") | (F.lit(rules.mode == "deep") & (c("score") >= 120))))
    never = ~whole & ((F.lit(rules.mode == "balanced") & c("idle_test")) | (F.lit(rules.strict) & ~c("support") & ~c("owner")))
    never = never | (~c("changed") & F.lit(rules.mode != "deep") & c("docs")) | (c("score") <= 0)
    flags = sum(c(f).cast("int") * (1 << k) for k, f in enumerate(_FLAGS))
    lead = F.coalesce("infra", F.lit(0)) * 4 + c("changed").cast("int") * 2 + c("signal").cast("int")
    kept = ready.filter(~never).select("task_id", "path", lead.alias("lead"), c("priority"), c("score").cast("double").alias("score"), c("hits").cast("long").alias("hits"), c("tokens").cast("long").alias("tokens"), "evidence", *_MAYBE, "family", "scope", flags.alias("flags"))
    ordered = _dealt(kept.join(counted, "task_id", "left")).sortWithinPartitions("task_id", F.desc("lead"), F.desc("priority"), F.desc("score"), "path")
    schema = T.StructType([rows.schema["task_id"], rows.schema["path"], T.StructField("mode", T.StringType()), T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice, now = None, None

        def out(schema: pa.Schema) -> pa.RecordBatch:
            picked = [] if choice is None else choice.picked
            columns = [[now] * len(picked), *([p[k] for p in picked] for k in ("path", "mode", "cost"))]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (schema.field("task_id").type, schema.field("path").type, pa.string(), pa.int64()))], ["task_id", "path", "mode", "tokens"])

        for batch in batches:
            if not len(batch):
                continue
            columns, task = _arrays(batch, rules), batch.column("task_id").dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(batch)]
            for start, stop in zip(cuts, cuts[1:]):
                if choice is None or batch.column("task_id")[start].as_py() != now:
                    yield out(batch.schema)
                    choice, now = Choice(rules, bool(batch.column("many_changed")[start].as_py())), batch.column("task_id")[start].as_py()
                choice.take_all(columns, start, stop)
        if choice is not None:
            yield out(batch.schema)

    return ordered.mapInArrow(run, schema)


def selected(receipts: DataFrame) -> DataFrame:
    """The files whose last receipt takes them: (task_id, path, mode, tokens)."""
    last = receipts.groupBy("task_id", "path").agg(F.max_by(F.struct("action", "mode", "tokens"), "step").alias("r"))
    return last.filter("r.action != 'excluded'").select("task_id", "path", "r.mode", "r.tokens")


def handoff(receipts: DataFrame) -> DataFrame:
    """(task_id, bucket, risk, n) of what was left out, with a heading for each reason."""
    last = receipts.groupBy("task_id", "path").agg(F.max_by(F.struct("action", "reason", "risk"), "step").alias("r")).filter("r.action = 'excluded'")
    return last.groupBy("task_id", omitted_bucket(F.col("r.reason")).alias("bucket"), F.col("r.risk").alias("risk")).agg(F.count("*").alias("n"))
