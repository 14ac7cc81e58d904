"""Queries about what a selection could have taken instead, with DuckDB's SQL.  Files are ranked within their source by length, as a plain search does; their texts and paths give reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import replacements as R
from siltstone.operators.selector import Rules, select_files
from siltstone.plans.files import FAMILY
from siltstone.plans.registry import QUERIES, query
from siltstone.plans.selector import candidates
from siltstone.sources.repository import FILES, files
from siltstone.sources.tables import table

#: Tokens that a source's selection may take.
BUDGET = 8000
_COUNT = "(length(text) - length(replace(text, 'by ', ''))) div 3"
_WHY = (("phrase", "contains(text, ' of the ')"), ("direct content", "contains(text, ' que ')"), ("filename", "contains(path, 'api')"), ("recent", "contains(text, '|')"))

_PARTS = "list_filter(string_split(lower(replace(path, chr(92), '/')), '/'), x -> x <> '')".replace("x -> ", "lambda x: ")
_AT = "list_position(p, '{0}')"
_MARKED = " ".join(
    f"when {_AT.format(m)} > 0 then array_to_string(p[1:{f'case when len(p) > {_AT.format(m)} + 1 then {_AT.format(m)} + 2 else ' if m == 'packages' else ''}{_AT.format(m)} + least({d}, greatest(0, len(p) - {_AT.format(m)} - 1)){' end' if m == 'packages' else ''}], '/')"
    for m, d in R.MARKERS
)
_SCOPE = f"case {_MARKED} when len(p) > 2 then p[1] || '/' || p[2] else coalesce(p[1], '') end"
_PACKAGE = (
    f"case when {_AT.format('packages')} > 0 and len(p) > {_AT.format('packages')} then array_to_string(p[1:{_AT.format('packages')} + 1], '/') when {_AT.format('apps')} > 0 and len(p) > {_AT.format('apps')} then array_to_string(p[1:{_AT.format('apps')} + 1], '/')"
    " when p[1] in ('integration', 'examples', 'playground') and len(p) > 1 then p[1] || '/' || p[2] else coalesce(p[1], '') end"
)
_REASONS = "list_filter([" + ", ".join(f"case when {cond} then '{r}' end" for r, cond in _WHY) + "], lambda x: x is not null)"
_JUDGED = f"""{FILES}, facts as (select path, source, tokens, n_chars / 20.0::double score, {_COUNT.replace('div', '//')} hits, {_REASONS} reasons, coalesce(l.quality, 0) = 1 expected, {_PARTS} p from files left join (select doc_id, max(quality) quality from labels group by 1) l using (doc_id) where text is not null and source is not null and n_chars is not null),
ranked as (select *, rank() over (partition by source order by score desc) rank, sum(tokens) over (partition by source order by score desc) used from facts),
judged as (select *, used <= {BUDGET} selected, case when score > 5 then 'budget exhausted' else 'score too low' end why, {_SCOPE} scope, {_PACKAGE} package, {FAMILY} family, len(list_filter(reasons, lambda r: regexp_matches(r, '{R.STRONG}'))) strong from ranked),
weighed as (select *, (round(least(greatest(score, 0), 300) * 250) + 1000 * (least(hits, 6) * 18 + strong * 55 + 12 * len(list_filter(reasons, lambda r: r = 'filename')) + 5 * len(list_filter(reasons, lambda r: r = 'recent'))
  - case when family in {R.IDLE_FAMILIES} then 25 else 0 end))::bigint evidence from judged)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files with a rank within their source, what of it fits the budget, and what the labels ask for."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    own = files(spark, sf_dir).filter("text is not null and source is not null and n_chars is not null")
    facts = own.select(
        "doc_id", "path", "source", "tokens", (F.col("n_chars") / 20.0).alias("score"), F.expr(_COUNT).alias("hits"), F.array_compact(F.array(*[F.when(F.expr(cond), F.lit(r)) for r, cond in _WHY])).alias("reasons"),
    ).join(labels, "doc_id", "left").withColumn("expected", F.coalesce("quality", F.lit(0)) == 1)
    ranked = R.standing(facts, "source")
    return ranked.withColumns({"selected": F.col("used") <= BUDGET, "why": F.when(F.col("score") > 5, "budget exhausted").otherwise("score too low")})


@query(
    f"""with {_JUDGED}, m as (select * from weighed where expected and not selected and regexp_matches(why, '{R.LEFT_FOR_ROOM}')), s as (select * from weighed where selected and not expected),
pairs as (select source, m.path missed, s.path noise, m.scope, m.rank missed_rank, s.rank noise_rank, m.tokens missed_tokens, s.tokens noise_tokens, m.evidence missed_evidence, s.evidence noise_evidence, m.evidence - s.evidence gain
  from m join s using (source) where m.tokens <= s.tokens and (m.scope = s.scope or (m.scope <> '' and s.scope <> '' and (starts_with(m.scope, s.scope || '/') or starts_with(s.scope, m.scope || '/')))) and m.evidence - s.evidence >= 25000),
placed as (select *, row_number() over (partition by source order by gain desc, missed_tokens - noise_tokens, missed_rank, noise_rank, missed, noise) place from pairs)
select * from placed where place <= 20"""
)
def replacement_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best exchanges of a missed file for a selected one, for each source."""
    return R.opportunities(judged(spark, sf_dir), "source")


@query(
    f"""with {_JUDGED}, e as (select distinct source, scope, package, family from judged where expected),
n as (select j.source, j.path, j.tokens, coalesce(bool_or(e.scope = j.scope or (e.scope <> '' and j.scope <> '' and (starts_with(e.scope, j.scope || '/') or starts_with(j.scope, e.scope || '/'))) or (j.package <> '' and j.package = e.package) or (j.strong > 0 and j.family = e.family)), false) useful
  from judged j left join e using (source) where j.selected and not j.expected group by all),
a as (select source, count(*) noise, sum(tokens) noise_tokens, count(*) filter (useful) useful, coalesce(sum(tokens) filter (useful), 0) useful_tokens from n group by 1), t as (select source, sum(tokens) packed from judged where selected group by 1),
o as (select source, packed::bigint packed, coalesce(noise, 0)::bigint noise, coalesce(noise_tokens, 0)::bigint noise_tokens, coalesce(useful, 0)::bigint useful, coalesce(useful_tokens, 0)::bigint useful_tokens from t left join a using (source))
select *, noise_tokens - useful_tokens audited_tokens, round(1 - (noise_tokens - useful_tokens) / packed, 3) adjusted_precision from o"""
)
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected files that no label asks for, and those of them that stand near one that a label does."""
    return R.label_audit(judged(spark, sf_dir), "source")


def displaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who took whose place in the selections of five tasks, under a budget low enough that files are displaced in small tables too."""
    rows = candidates(spark, sf_dir)
    return R.displaced(select_files(rows, Rules(budget=1500)), R.standing(rows, "task_id"))


QUERIES["displaced_files"] = displaced_files
