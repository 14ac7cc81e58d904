"""Queries that judge selections, with DuckDB's SQL.  Documents are ranked by length within their source; quality labels say what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.operators import evaluation as V
from siltstone.operators.relations import ranked_within
from siltstone.operators.selection import select_under_budget
from siltstone.plans.files import FAMILY, leading
from siltstone.plans.registry import query
from siltstone.sources.repository import FILES, files
from siltstone.sources.tables import table

_RANKED = f"""{FILES}, ranked as (select path, doc_id, source, n_chars score, tokens, rank, rank <= 10 selected, coalesce(l.quality, 0) = 1 expected, {FAMILY} family, {leading('src|packages|lib|app|services')} package, case doc_id % 3 when 0 then 'full' else 'summary' end "mode"
  from (select *, row_number() over (partition by source order by n_chars desc, doc_id) rank from files) left join (select doc_id, max(quality) quality from labels group by 1) l using (doc_id))"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, ranked; what has no label isn't expected."""
    own = files(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = ranked_within(own.drop("text"), "source", "n_chars", "doc_id").join(labels, "doc_id", "left")
    path = F.col("path")
    package = F.when(path.rlike("^(src|packages|lib|app|services)/"), F.array_join(F.slice(F.split(path, "/"), 1, 2), "/"))
    return rows.select("path", "doc_id", "source", F.col("n_chars").alias("score"), "tokens", "rank", (F.col("rank") <= 10).alias("selected"), (F.coalesce("quality", F.lit(0)) == 1).alias("expected"), P.family(path).alias("family"), package.alias("package"), F.when(F.col("doc_id") % 3 == 0, "full").otherwise("summary").alias("mode"))


@query(
    f"""with {_RANKED}, c as (select source, max_by(score, rank) last, count(*) n from ranked where selected group by 1), z as (select source, min_by(struct_pack(path, rank, score), rank) f from ranked where selected and not expected group by 1)
select source, path, rank, case when score <= 0 or rank > greatest(50, coalesce(n, 0) * 4) then 'RANKED_LOW' when rank <= coalesce(n, 0) + 1 then 'SKIPPED' else 'NOISE_ABOVE' end failure, round(score - last, 1)::double delta, rank <= coalesce(n, 0) + 1 one_more, case when f.rank < ranked.rank or f.score >= score then f.path end noise
from ranked left join c using (source) left join z using (source) where expected and not selected"""
)
def missed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why expected documents were missed, and what stood above them."""
    out = V.misses(ranked(spark, sf_dir), "source")
    return out.withColumn("delta", F.col("delta").cast("double"))


@query(
    f"""with {_RANKED}, o as (select *, case family when 'source' then 0 when 'config' then 1 when 'test' then 2 when 'docs' then 3 else 4 end k from ranked where expected), m as (select source, min(k) k from o group by 1)
select source, min(family) family, count(*) owners, count(*) filter (selected) selected, round(count(*) filter (selected) / count(*), 3) recall from o join m using (source, k) group by 1"""
)
def owner_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.owner_recall(ranked(spark, sf_dir), "source", {"source": 0, "config": 1, "test": 2, "docs": 3})


@query(
    f"""with {_RANKED}, p as (select source, sum(tokens) a, coalesce(sum(tokens) filter (expected), 0) g, max_by(tokens, rank) filter ("mode" = 'summary') lt, max_by(expected, rank) filter ("mode" = 'summary') le from ranked where selected group by 1)
select source, case when le then 0 else lt end::bigint waste, round((g - case when le then lt else 0 end) / (a - lt) - g / a, 4)::double change from p where lt > 0 and a > lt"""
)
def summary_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last summary of a selection costs."""
    return V.last_summary_waste(ranked(spark, sf_dir).filter("selected").withColumn("pos", F.col("rank")), "source")


@query(
    f"""with {_RANKED}, w as (select distinct source, package from ranked where expected and package is not null)
select source, count(*) filter (w.package is not null) inside, count(*) filter (w.package is null) across, round(count(*) filter (w.package is not null) / count(*), 3) match_rate from ranked r left join w using (source, package) where selected and r.package is not null group by 1"""
)
def package_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.boundaries(ranked(spark, sf_dir), "source")


@query(
    """with recursive c as (select conv_id task, turn path, greatest(1, length(text) // 4) tokens, row_number() over (partition by conv_id order by sha256('seed|' || turn)) rank from conversations where text is not null),
g as (select *, tokens <= 600 selected, case when tokens <= 600 then tokens else 0 end used from c where rank = 1 union all
  select c.*, g.used + c.tokens <= 600, g.used + case when g.used + c.tokens <= 600 then c.tokens else 0 end from g join c on c.task = g.task and c.rank = g.rank + 1)
select task, path, rank, tokens::bigint tokens, selected from g"""
)
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in an order drawn by a seed, into the budget."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    rows = turns.select(F.col("conv_id").alias("task"), F.col("turn").alias("path"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"))
    return select_under_budget(V.shuffled(rows, "task", "path", "seed"), 600)


@query(
    """with r as (select event_type strategy, value > 10 success, floor(value * 10)::bigint tokens, event_id % 7 calls from events), m as (select strategy, count(*) runs, avg(success::int) s, avg(tokens) t, avg(calls) c from r group by 1), b as (select s s0, t t0 from m where strategy = 'view')
select strategy, runs, round(s, 4) success, round(t, 2) tokens, round(c, 2) calls, round(s - s0, 4) success_gain, round(t0 - t, 2) tokens_saved from m, b"""
)
def strategy_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies (types of events) against the base."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), (F.col("value") > 10).alias("success"), F.floor(F.col("value") * 10).alias("tokens"), (F.col("event_id") % 7).alias("calls"))
    return V.strategies(rows, "view")


@query("""select path, tokens, runs, round(tokens / total, 4)::double share from (select l_partkey path, sum(l_quantity)::bigint tokens, count(*) runs, (select sum(l_quantity) from lineitem) total from lineitem group by 1) order by tokens desc, path limit 10""")
def top_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that take most."""
    return V.consumers(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("tokens")))


@query(
    f"""with {FILES}, c as (select o_orderkey "case", case when o_orderkey % 3 = 0 then '^src/' end required, case when o_orderkey % 2 = 0 then '[.](json|lock)$' else '^never' end forbidden, 4 most_files, 120 most_lines from orders),
r as (select l_orderkey "case", f.path, l_quantity::bigint lines from lineitem join files f on f.doc_id = l_partkey % 200), j as (select c.*, r.path, r.lines from c left join r using ("case")),
k as (select "case", any_value(required) required, coalesce(bool_or(regexp_matches(path, required)), false) hr, coalesce(bool_or(regexp_matches(path, forbidden)), false) forbidden_hit, count(path) > 4 too_many_files, coalesce(sum(lines), 0) > 120 too_many_lines from j group by 1)
select "case", required is not null and not hr required_missing, forbidden_hit, too_many_files, too_many_lines, not ((required is not null and not hr) or forbidden_hit or too_many_files or too_many_lines) passed from k"""
)
def eval_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes (lines of orders) held against the rules of their case."""
    k = F.col("o_orderkey")
    cases = table(spark, sf_dir, "orders").select(k.alias("case"), F.when(k % 3 == 0, "^src/").alias("required"), F.when(k % 2 == 0, "[.](json|lock)$").otherwise("^never").alias("forbidden"), F.lit(4).alias("most_files"), F.lit(120).alias("most_lines"))
    own = files(spark, sf_dir).select("doc_id", "path")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), (F.col("l_partkey") % 200).alias("doc_id"), F.col("l_quantity").cast("long").alias("lines"))
    return V.checks(lines.join(own, "doc_id").select("case", "path", "lines"), cases)


@query(
    """with r as (select o_orderstatus status, o_orderpriority priority, o_orderkey "case", row_number() over (partition by o_orderstatus, o_orderpriority order by md5(o_orderkey::varchar), o_orderkey) place from orders)
select status, priority, "case", place::int place from r where place <= case status when 'F' then 20 when 'P' then 5 else 10 end"""
)
def stratified_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of each status and priority by quota; which ones doesn't depend on partitions."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("case"))
    return V.stratified(cases, ["status", "priority"], "case", {"F": 20, "P": 5}, 10)
