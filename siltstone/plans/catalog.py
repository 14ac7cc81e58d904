"""The queries of the library and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import relations as R
from siltstone.operators.history import feedback_boosts as feedback
from siltstone.operators.ranking import rank_for_tasks
from siltstone.plans import boosts as _boosts  # noqa: F401
from siltstone.plans import evaluation as _evaluation  # noqa: F401
from siltstone.plans import files as _files  # noqa: F401  (these register their queries)
from siltstone.plans import history as _history  # noqa: F401
from siltstone.plans import imports as _imports  # noqa: F401
from siltstone.plans import overview as _overview  # noqa: F401
from siltstone.plans import packs as _packs  # noqa: F401
from siltstone.plans import replacements as _replacements  # noqa: F401
from siltstone.plans import roles as _roles  # noqa: F401
from siltstone.plans import scoring as _scoring  # noqa: F401
from siltstone.plans import selection  # noqa: F401
from siltstone.plans import selector as _selector  # noqa: F401
from siltstone.plans import source as _source  # noqa: F401
from siltstone.plans import tasks as _tasks  # noqa: F401
from siltstone.plans.boosts import BASE
from siltstone.plans.boosts import edges as import_edges
from siltstone.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from siltstone.sources.tables import files, table
from siltstone.streaming.events import windowed_counts

_TOKENS = "list_filter(string_split_regex(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-zA-Z0-9]+'), lambda t: t <> '')"
_PLACE = "regexp_replace(regexp_replace({}, '^https?://|[?#].*$', '', 'g'), '/+$', '')"
_HREFS = "own_ as (select page_id src, " + _PLACE.format("url") + """ own, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) href from pages)"""
_TARGET = _PLACE.format("case when regexp_matches(href, '^https?://') then href when starts_with(href, '/') then regexp_extract(own, '^[^/]*') || href else regexp_replace(own, '/[^/]*$', '') || '/' || href end")
_EDGES = f"""{_HREFS}, t as (select distinct src, {_TARGET} target from own_ where href <> '' and not starts_with(href, '#') and {_TARGET} <> own),
links as (select src, target, coalesce(dst, -1) dst from t left join (select {_PLACE.format("url")} target, min(page_id) dst from pages group by 1) using (target))"""


@query(f"""
with wanted as (select distinct item_id, unnest({_TOKENS}) term from benchmark),
held as (select doc_id, term from (select doc_id, unnest(list_distinct({_TOKENS})) term from documents) where term in (select term from wanted where length(term) >= 3)),
w as (select term, round(least(1, greatest(0, ln(((select count(*) from documents) + 1) / (count(*) + 1)) / ln((select count(*) from documents) + 1.0))) * 1000)::bigint points from held group by term),
c as (select item_id, doc_id, least(60000, sum(points) * 10) content from held join w using (term) join wanted using (term) group by 1, 2),
s as (select item_id, doc_id, content + case when contains(d.text, b.text) then 360000 else 0 end score, greatest(1, length(d.text) // 4)::bigint tokens from c join documents d using (doc_id) join benchmark b using (item_id)),
r as (select item_id, doc_id, score / 1000.0::double score, row_number() over w rank, tokens, (sum(tokens) over w)::bigint running from s where score > 0 window w as (partition by item_id order by score desc, doc_id))
select *, running <= 50000 selected from r where running - tokens <= 50000""")
def doc_rank_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item the documents that its budget reaches."""
    return rank_for_tasks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""select case when source in ('src1') then 'ignored' when greatest(1, length(text) // 4) > 4000 then 'too_large' else 'packable' end bucket, count(*) n, sum(greatest(1, length(text) // 4))::bigint tokens from documents group by 1""")
def scan_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(table(spark, sf_dir, "documents"), ("src1",)).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query("select lang, count(*) n, round(count(*) / (select count(*) from documents)::double, 4) share from documents group by lang")
def language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shares(table(spark, sf_dir, "documents"), "lang")


@query("select sha256(text) hash, min(doc_id) first_id, count(*) n from documents group by 1 having count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


@query(f"""select term, count(*) df, round(least(1, greatest(0, ln(((select count(*) from documents) + 1) / (count(*) + 1)) / ln((select count(*) from documents) + 1.0))), 6) rarity
from (select doc_id, unnest(list_distinct({_TOKENS})) term from documents) where length(term) >= 3 group by term""")
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.document_frequency(table(spark, sf_dir, "documents"))


@query("select doc_id, item_id from documents d, benchmark b where contains(d.text, b.text)")
def literal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.holds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""select lang, count(*) n, count(*) filter (regexp_matches(text, '(?i)(api_?key|token|secret|password)[ ]*[=:][ ]*["''][A-Za-z0-9_-]{16,}["'']')) secrets from documents group by lang""")
def secret_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(R.secret_flag(F.col("text")).cast("long")).alias("secrets"))


@query("""with o as (select doc_id, case when doc_id % 5 = 0 then sha256(upper(text)) else sha256(text) end h from documents where doc_id % 7 <> 0), n as (select doc_id, sha256(text) h from documents where doc_id % 11 <> 0)
select status, count(*) n from (select case when o.h is null then 'added' when n.h is null then 'deleted' when o.h = n.h then 'unchanged' else 'modified' end status from o full join n using (doc_id)) group by 1""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against an earlier snapshot derived from the table: every fifth text in capitals, every seventh not there yet; now every eleventh is gone."""
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 7 != 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")), 256).alias("hash"))
    new = docs.filter("doc_id % 11 != 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return R.snapshot_diff(old, new).groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {_EDGES} select * from links")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.links(table(spark, sf_dir, "pages"))


@query(f"with {_EDGES} select page_id, (select count(*) from links where src = page_id) n_out, (select count(*) from links where dst = page_id) n_in, (select count(*) from links where src = page_id and target in (select target from links group by 1 having count(*) > 1)) n_shared from pages")
def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    edges = R.links(pages)
    out, into = edges.groupBy(F.col("src").alias("page_id")).agg(F.count("*").alias("o")), edges.groupBy(F.col("dst").alias("page_id")).agg(F.count("*").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    common = edges.groupBy("target").agg(F.count("*").alias("n")).filter("n > 1").select("target")
    shared = edges.join(common, "target", "left_semi").groupBy(F.col("src").alias("page_id")).agg(F.count("*").alias("s"))
    joined = pages.select("page_id").join(out, "page_id", "left").join(into, "page_id", "left").join(shared, "page_id", "left")
    return joined.select("page_id", zero("o").alias("n_out"), zero("i").alias("n_in"), zero("s").alias("n_shared"))


_NODES = f"n as (select distinct {_PLACE.format('url')} src, target dst from links join pages on page_id = links.src)"


@query(f"with {_EDGES}, {_NODES}, b as (select src, dst, 1 h from n union all select a.src, b.dst, 2 from n a join n b on a.dst = b.src where a.src <> b.dst) select src, dst, min(h)::int hops from b group by 1, 2")
def link_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at one or two steps from each page."""
    pages = table(spark, sf_dir, "pages")
    named = R.links(pages).join(pages.select(F.col("page_id").alias("src"), R.page_key(F.col("url")).alias("own")), "src")
    return R.hops(named.select(F.col("own").alias("src"), F.col("target").alias("dst")).distinct())


@query(f"with {BASE}, b as (select src, dst, 1 h from edges union all select a.src, b.dst, 2 from edges a join edges b on a.dst = b.src where a.src <> b.dst) select src, dst, min(h)::int hops from b group by 1, 2")
def import_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at one or two steps along imports."""
    return R.hops(import_edges(spark, sf_dir))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))


@query("select l_partkey file, count(distinct l_orderkey) commits from lineitem group by 1")
def file_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.churn(_changes(spark, sf_dir))


@query("with d as (select distinct l_orderkey c, l_partkey f from lineitem) select x.f a, y.f b, count(*) commits from d x join d y on x.c = y.c and x.f < y.f group by 1, 2 having count(*) >= 2")
def co_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.co_change(_changes(spark, sf_dir))


@query("select event_type, count(*) n, round(sum(value), 2) total, round(sum(greatest(0, value - 10)), 2) saved, count(distinct user_id) users from events group by 1")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.sum(F.greatest(F.lit(0.0), F.col("value") - 10)), 2).alias("saved"), F.countDistinct("user_id").alias("users"))


@query("select user_id, round(avg(value), 4) mean, count(*) n from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k <= 10 group by 1")
def last_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_n(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


@query("with l as (select user_id, max_by(event_type, (ts, event_id)) event_type, max(ts) ts from events group by 1) select user_id, event_type, ts >= (select max(ts) from events) - interval 24 hours active from l")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    last = R.latest(events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    return last.join(F.broadcast(now)).select("user_id", "event_type", (F.col("ts") >= F.col("now") - F.expr("interval 24 hours")).alias("active"))


@query("""with m as (select user_id, event_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w > 1800000000, true)::int f from events window w as (partition by user_id order by ts, event_id)),
s as (select *, (sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding))::bigint session from m)
select user_id, session, count(*) n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) secs from s group by 1, 2""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sessions(table(spark, sf_dir, "events"))


@query("select date_trunc('hour', ts) start, event_type, count(*) n from events group by 1, 2")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(table(spark, sf_dir, "events"))


@query("with c as (select event_type, floor(value)::bigint v, row_number() over (partition by event_type order by floor(value)) - 1 k, count(*) over (partition by event_type) n from events) select event_type, min(v) filter (k = n // 2) p50, min(v) filter (k = (n - 1) * 95 // 100) p95 from c group by 1")
def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.index_percentiles(table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("v")), "event_type", "v")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = R.ranked_within(docs, "source", "n_chars", "doc_id").join(labels, "doc_id", "left")
    return rows.select("source", "rank", (F.coalesce("quality", F.lit(0)) == 1).alias("expected"))


_RANKED = "r as (select source, row_number() over (partition by source order by n_chars desc, doc_id) k, coalesce(quality, 0) = 1 e from documents left join (select doc_id, max(quality) quality from labels group by 1) using (doc_id)), m as (select source, round(count(*) filter (e and k <= 10) / least(10, count(*)), 4) \"precision\", round(coalesce(count(*) filter (e and k <= 10) / nullif(count(*) filter (e), 0), 0), 4) recall, round(coalesce(1 / (min(k) filter (e)), 0), 4) rr from r group by source)"


@query(f"with {_RANKED} select * from m")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranking_metrics(_ranked(spark, sf_dir), "source", 10)


@query(f"with {_RANKED} select count(*) cases, round(avg(\"precision\"), 3) avg_precision, round(avg(recall), 3) avg_recall, round(avg(rr), 3) mrr, avg(recall) >= 0.6 and avg(\"precision\") >= 0.5 passed from m")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.ranking_metrics(_ranked(spark, sf_dir), "source", 10)
    return m.agg(F.count("*").alias("cases"), F.round(F.avg("precision"), 3).alias("avg_precision"), F.round(F.avg("recall"), 3).alias("avg_recall"), F.round(F.avg("rr"), 3).alias("mrr"), ((F.avg("recall") >= 0.6) & (F.avg("precision") >= 0.5)).alias("passed"))


@query("select doc_id, line, count(*) n from (select doc_id, unnest(string_split(text, chr(10))) line from documents) where trim(line) <> '' group by 1, 2 having count(*) >= 2")
def line_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeated_lines(table(spark, sf_dir, "documents"))


_GENERIC = ", ".join(f"'{g}'" for g in X.GENERIC)
_TERMS = f"list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 3 and not list_contains([{_GENERIC}], t))"


@query(f"""with t as (select distinct conv_id * 1000 + turn task_id, unnest({_TERMS}) term from conversations where role = 'user'), f as (select distinct item_id, unnest({_TERMS}) term from benchmark),
o as (select task_id, item_id, count(*) overlap from t join f using (term) group by 1, 2)
select task_id, 'p' || (item_id % 7) path, least(60.0, sum(18.0 + least(12, 3 * overlap)))::double boost from o group by 1, 2""")
def feedback_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that similar tasks missed: summed for a file over the records, then capped."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    tasks = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), F.explode(F.array_distinct(X.task_terms(F.col("text")))).alias("term"))
    items = table(spark, sf_dir, "benchmark")
    records = items.select(F.col("item_id").alias("record"), F.explode(F.array_distinct(X.task_terms(F.col("text")))).alias("term"))
    return feedback(tasks, records, items.select(F.col("item_id").alias("record"), F.concat(F.lit("p"), (F.col("item_id") % 7).cast("string")).alias("path")))


@query("""with l as (select user_id, event_type, max_by(value, (ts, event_id)) v from events group by 1, 2), p as (select user_id, max(v) filter (event_type = 'view') a, max(v) filter (event_type = 'click') b from l group by 1)
select case when a is null or b is null then 'incomplete' when b > a then 'improved' when b < a then 'regressed' else 'unchanged' end outcome, count(*) n from p group by 1""")
def variant_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = R.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])
    side = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    pairs = last.groupBy("user_id").agg(side("view").alias("a"), side("click").alias("b"))
    outcome = F.when(F.col("a").isNull() | F.col("b").isNull(), "incomplete").when(F.col("b") > F.col("a"), "improved").when(F.col("b") < F.col("a"), "regressed").otherwise("unchanged")
    return pairs.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""select p_brand module, round(sum(p_retailprice) filter (k <= 20) + least(count(*), 20), 2) score, count(*) members, sum(p_size)::bigint tokens
from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) k from part) group by 1""")
def module_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    parts = table(spark, sf_dir, "part").withColumn("k", F.row_number().over(w))
    top = F.sum(F.when(F.col("k") <= 20, F.col("p_retailprice")))
    return parts.groupBy(F.col("p_brand").alias("module")).agg(F.round(top + F.least(F.count("*"), F.lit(20)), 2).alias("score"), F.count("*").alias("members"), F.sum("p_size").cast("long").alias("tokens"))
