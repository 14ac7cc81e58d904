"""Queries of the selector: its columns with DuckDB's SQL; the choice itself is a fold, with hand-written cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions import tasks as K
from siltstone.operators import selector as L
from siltstone.plans.boosts import BASE, base
from siltstone.plans.files import FAMILY, SCOPE, SOURCE, is_kind
from siltstone.plans.registry import QUERIES, query
from siltstone.plans.tasks import words

# more reasons, by the length of a path, than the base has
_MORE = (("config", is_kind("config_file")), ("domain", "length(path) % 9 = 4"), ("calls", "length(path) % 13 = 5"), ("multi-term path", "length(path) % 8 = 1"), ("release metadata", is_kind("release_name")), ("test asked for", "length(path) % 31 = 7"), ("name only", "length(path) % 12 = 2"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, path = F.length("path"), F.col("path")
    more = [("config", P.is_kind(path, "config_file")), ("domain", n % 9 == 4), ("calls", n % 13 == 5), ("multi-term path", n % 8 == 1), ("release metadata", P.is_kind(path, "release_name")), ("test asked for", n % 31 == 7), ("name only", n % 12 == 2)]
    rows = base(spark, sf_dir).withColumn("reasons", F.concat("reasons", F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in more]))))
    tokens = (n * 37 % 900 + 20).cast("long")
    return rows.select(
        "task_id", "path", "score", "reasons", (n % 5).cast("long").alias("hits"), tokens.alias("tokens"), F.when(n % 2 == 0, F.least(F.lit(60), tokens)).cast("long").alias("summary_tokens"),
        F.when(n % 3 == 0, F.least(F.lit(110), tokens)).cast("long").alias("skeleton_tokens"), (n % 29 == 3).alias("changed"), (n % 41 == 5).alias("secret"),
    )


def _has(reasons: tuple[str, ...]) -> str:
    return f"list_has_any(reasons, {words(reasons)})"


def _any(pattern: str) -> str:
    return f"len(list_filter(reasons, lambda r: regexp_matches(r, '{pattern}'))) > 0"


def _case(column: str, cases: tuple[tuple[str, str], ...], other: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '{p}') then '{label}'" for label, p in cases) + f" else {other} end"


_CAND = f"""{BASE}, cand as (select task_id, path, score, reasons || list_filter([{', '.join(f"case when {c} then '{r}' end" for r, c in _MORE)}], lambda x: x is not null) reasons, length(path) % 5 hits, length(path) * 37 % 900 + 20 tokens, length(path) % 29 = 3 changed from base)"""
_FLAGS = f"""flags as (select *, {is_kind('test_path')} test, {_has(('config',))} config, {_has(L.DIRECT)} direct, {_has(L.SUPPORTING)} support, {SOURCE} source, {_has(('release metadata',))} rel, {_has(('test asked for',))} asked,
  {_has(L.ACTIONABLE)} or ({_has(('symbol', 'multi-term path'))} and hits >= 1) or ({_has(('role',))} and hits >= 4) actionable, {is_kind('docs_path')} docs, {is_kind('example_path')} example, {is_kind('lock_or_generated')} lock,
  regexp_matches(path, '{L.INFRA}') and ({_has(('config',))} or {is_kind('deploy_config')}) infra, {_has(('release metadata',))} and {is_kind('release_primary')} prim from cand)"""


@query(
    f"""with {_CAND}, {_FLAGS} select task_id, path, infra::int infra, (len(list_filter(reasons, lambda r: not list_contains({words(L.STANDING_ONLY)}, r))) > 0)::int signal,
round(score + case when prim then 180.0 when asked then 45.0 when infra then 170.0 when not contains(path, '/') and regexp_matches(path, '(?i)\\.go$') and source and direct and not config then 230.0 when source and direct and not config then 125.0 else 0 end
  + case when config then 25 else 0 end + least(60.0::double, score / greatest(1, least(tokens, 4000)) * 120.0::double), 4) priority,
case when changed then 'changed' when docs or {_has(('knowledge',))} then 'docs' when test then 'tests' when {_has(('dependency', 'dependent', 'cross-layer', 'tests'))} then 'deps' else 'other' end bucket,
case when lock then case when rel then 'lock-release' else 'lock-generated' end when rel then 'release-metadata' when test then 'tests' when config then 'config' when docs then 'docs' when example then 'examples' when source and direct then null when {_has(L.EXPANSION)} then 'expansion' end family,
coalesce(case when lock then rel::int when rel then 2 when test then case when asked then 4 else 2 end when config then case when {_has(('multi-term path',))} then 2 else 1 end when docs or example then 1 when source and direct then null when {_has(L.EXPANSION)} then 1 end, -1) cap,
round(least(score, 220) * 0.25 + least(hits, 6) * 18 + case when direct then 130 else 0 end + case when actionable then 95 else 0 end + case when support then 65 else 0 end + case when config and hits >= 2 then 45 else 0 end + case when infra then 80 else 0 end
  + case when {_has(('dependency', 'dependent'))} then 60 else 0 end + case when {_has(('workspace',))} then 25 else 0 end - case when test and not asked then 55 else 0 end - case when example then 45 else 0 end - case when docs then 40 else 0 end - case when {_has(L.WEAK_SIGNAL)} then 60 else 0 end
  - case when source and hits <= 1 and not {_has(('direct content', 'phrase', 'path phrase', 'calls'))} then 70 else 0 end, 4) evidence, {SCOPE} scope,
case when {_any('^(dependent|test for|tests$)')} or regexp_matches(lower(path), '^tests?/|/tests/|route|controller|api/|schema|migration|model') then 'high' when {_any('^dependency$|config')} or regexp_matches(lower(path), 'config|\\.env|deploy|settings') or score > 150 then 'medium' else 'low' end risk
from flags"""
)
def selection_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders, groups and weighs the candidates of a selection."""
    ready = L.prepared(candidates(spark, sf_dir))
    return ready.select("task_id", "path", "infra", "signal", F.round("priority", 4).alias("priority"), "bucket", "family", F.coalesce("cap", F.lit(-1)).alias("cap"), F.round("evidence", 4).alias("evidence"), "scope", "risk")


def select_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of a balanced selection for each of five tasks."""
    return L.select_files(candidates(spark, sf_dir))


QUERIES["select_files"] = select_files


def ranked_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to a selection for every item: evidence and points of all files, then tests of strong sources, a second pass over imports, and the choice under a budget."""
    from siltstone.operators import boosts as B
    from siltstone.plans import scoring as S
    from siltstone.sources.shared import written

    own, imports = S.facts(spark, sf_dir)
    # what depends on a file alone is made once for it and goes along
    own = L.path_facts(own.withColumn("tokens", F.col("tokens").cast("long")))
    scored = S.scored(spark, sf_dir, (own, imports), ("tokens", *L.PATH_FACTS), ("changed", "secret", "test_file", "config_file"))
    scored = written(scored.filter("score > 0"), "scored")  # read by every pass below
    terms = S.item_tasks(spark, sf_dir).select("task_id", F.explode(F.array_distinct(K.terms(F.col("task")))).alias("term"))
    raised = B.second_pass(B.paired_tests(scored), imports, terms)
    content = F.size(F.filter("reasons", lambda r: r.isin("content", "direct content", "phrase", "literal"))).cast("long")
    short = F.least(F.lit(200), F.col("tokens")).cast("long")
    rows = raised.withColumns({"hits": content, "summary_tokens": short, "skeleton_tokens": F.when(F.col("tokens") > 400, (F.col("tokens") / 4).cast("long"))}).drop("test_file", "config_file")
    return L.chosen(rows, L.Rules(budget=8000))


QUERIES["ranked_selection"] = ranked_selection


@query(
    f"""with {_CAND}, r as (select path, unnest(reasons) reason from cand)
select {_case('reason', L.REASON_FAMILIES, "'other'")} family, {_case('reason', L.BUCKETS, 'reason')} bucket, count(*) n, count(distinct path) files from r group by 1, 2"""
)
def reason_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by family and heading."""
    rows = candidates(spark, sf_dir).select("path", F.explode("reasons").alias("reason"))
    return rows.groupBy(L.reason_family(F.col("reason")).alias("family"), L.omitted_bucket(F.col("reason")).alias("bucket")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query(
    f"""with {_CAND}, s as (select path, length(path) % 4 = 1 selected, length(path) % 3 = 0 expected, case length(path) % 5 when 0 then 'full' when 1 then 'symbols' when 2 then 'skeleton' else 'summary' end "mode" from base),
f as (select *, {FAMILY} family from s)
select family, count(*) filter (expected) expected, count(*) filter (expected and selected) hit, round(count(*) filter (expected and selected) / nullif(count(*) filter (expected), 0), 3) recall,
 count(*) filter (expected and selected and "mode" = 'full') n_full, count(*) filter (expected and selected and "mode" = 'symbols') n_symbols, count(*) filter (expected and selected and "mode" = 'skeleton') n_skeleton, count(*) filter (expected and selected and "mode" = 'summary') n_summary,
 round(count(*) filter (expected and selected and "mode" <> 'summary') / nullif(count(*) filter (expected), 0), 3) actionable_rate from f group by 1"""
)
def family_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and include modes of expected files by their family."""
    from siltstone.operators.evaluation import family_recall as recall

    n = F.length("path") % 5
    mode = F.when(n == 0, "full").when(n == 1, "symbols").when(n == 2, "skeleton").otherwise("summary")
    rows = base(spark, sf_dir).select("path", (F.length("path") % 4 == 1).alias("selected"), (F.length("path") % 3 == 0).alias("expected"), mode.alias("mode"))
    return recall(rows.withColumn("family", P.family(F.col("path"))), "family")
