"""Queries over logs of earlier runs, with DuckDB's SQL.  An event is a run: of a user's project, with k as its path and its value as a measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import tasks as K
from siltstone.operators import history as H
from siltstone.plans.registry import query
from siltstone.plans.tasks import WORDS
from siltstone.sources.repository import FILES, files, tasks
from siltstone.sources.tables import table

_K = "json_extract(props, '$.k')::bigint"
_LOG = f"log as (select user_id project, event_id, ts, event_type, value, {_K} k from events)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("project"), "event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    f"""with {_LOG}, l as (select *, row_number() over (partition by project order by ts desc, event_id desc) j from log)
select project, k path, count(*) n from l where j <= 20 and event_type <> 'error' group by 1, 2"""
)
def noise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a project's last twenty rows, among which those of type error don't parse."""
    rows = log(spark, sf_dir).withColumn("ok", F.col("event_type") != "error").withColumn("noise", F.array("k"))
    return H.noise_counts(rows, ["project"], ["ts", "event_id"])


@query(
    f"""with {_LOG}, d as (select distinct project, k from log where k % 4 <> 0), s as (select k from d group by 1 order by count(*) desc, k limit 8),
c as (select k path, count(*) n from d where project in (select project from d where k in (from s)) and k not in (from s) group by 1), l as (select *, row_number() over (order by ts desc, event_id desc) j from log),
z as (select k path, count(*) n from l where j <= 200 and event_type <> 'error' group by 1)
select path, c.n from c left join z using (path) where c.n >= 2 and coalesce(z.n, 0) <= 4"""
)
def co_changed_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files changed together with the eight most frequent ones, without those that were noise more than four times lately."""
    from siltstone.operators.selection import neighbour_boosts

    rows = log(spark, sf_dir)
    counts = neighbour_boosts(rows.filter("k % 4 != 0").select(F.col("project").alias("commit"), F.col("k").alias("file"))).select(F.col("file").alias("path"), F.col("links").alias("n"))
    noise = H.noise_counts(rows.withColumn("ok", F.col("event_type") != "error").withColumn("noise", F.array("k")), [], ["ts", "event_id"], 200)
    return H.co_change_filter(counts, noise)


@query(
    f"""with {_LOG}, l as (select *, row_number() over (partition by project order by ts desc, event_id desc) j from log where event_type = 'view')
select project, coalesce(round(avg(value), 4), 1.0) mean, count(value) as "rows" from (select distinct project from log) left join (select * from l where j <= 10) using (project) group by 1"""
)
def recent_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each project's last ten views."""
    rows = log(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "view", F.col("value")))
    return H.recent_mean(rows, "project", ["ts", "event_id"], "v")


_RUNS = f"""{_LOG}, r as (select l.*, w.w terms, (value * 7 % 10) / 10.0::double precision_ from log l join words w on w.task_id = k * 1000 order by ts desc, event_id desc limit 200)"""


@query(
    f"""with {WORDS}, {_RUNS}, e as (select unnest(list_distinct(terms)) term, precision_ >= 0.45 g, precision_ <= 0.2 or event_type = 'error' b from r), s as (select term, count(*) filter (g) good, count(*) filter (b) bad from e group by 1)
select term, good, bad, case when good >= 2 and good >= greatest(2, bad * 2) then 'positive' when bad >= 2 and bad > greatest(1, good * 2) then 'ambiguous' end kind from s where good > 0 or bad > 0"""
)
def learned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the last two hundred runs that went well, or did not."""
    words = tasks(spark, sf_dir).select("task_id", F.array_distinct(K.terms(F.col("task"))).alias("terms"))
    runs = log(spark, sf_dir).join(words, F.col("task_id") == F.col("k") * 1000)
    runs = runs.withColumn("precision", (F.col("value") * 7 % 10) / 10.0).withColumn("noisy", F.col("event_type") == "error")
    return H.learned(H.signal_terms(runs, ["ts", "event_id"], 200))


@query(f"with {_LOG} select k, max(ts) ts from log group by 1 order by 2 desc, 1 limit 20")
def newest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.newest_cases(log(spark, sf_dir), "k", "ts", 20)


_THREADS = f"""{_LOG}, live as (select * from log where event_type <> 'purchase' and ts >= (select max(ts) from log) - interval 24 hours)"""


def _live(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = log(spark, sf_dir).select(F.col("project").alias("thread"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "done").otherwise(F.col("event_type")).alias("status"), "k")
    return rows, rows.agg(F.max("ts").alias("now"))


@query(f"with {_THREADS} select project thread, max(ts) ts, max_by(event_id, (ts, event_id)) id, max_by(event_type, (ts, event_id)) status, max_by(k, (ts, event_id)) k from live group by 1")
def active_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last unfinished row of each thread within a day; purchases finish a thread's step and are passed over."""
    rows, now = _live(spark, sf_dir)
    return H.active_threads(rows, now)


@query(
    f"""with {_THREADS}, f as (select distinct project thread, project % 5 branch, k file from live)
select a.thread, b.thread other, count(*) overlap from f a join f b on a.branch = b.branch and a.file = b.file and a.thread <> b.thread where a.thread % 20 = 0 group by 1, 2"""
)
def thread_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth thread, others of its branch that touch the same files."""
    rows, now = _live(spark, sf_dir)
    recent = rows.filter("status != 'done'").join(F.broadcast(now)).filter(F.col("ts") >= F.col("now") - F.expr("interval 24 hours"))
    active = recent.groupBy("thread").agg(F.collect_set("k").alias("files")).withColumn("branch", F.col("thread") % 5)
    return H.conflicts(active, active.filter("thread % 20 = 0"))


_RECORDS = "records as (select task_id, list_distinct(regexp_extract_all(lower(task), '[a-zA-Z][a-zA-Z0-9_]{2,}')) t from tasks), terms as (select task_id, unnest(list_filter(t, lambda x: not list_contains(['the', 'and', 'for', 'with', 'this', 'that', 'from', 'into'], x))) term from records)"
_SHARED = "shared as (select a.task_id, b.task_id record, count(*) overlap from terms a join terms b using (term) where a.task_id % 20 = 0 group by 1, 2)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, term) of all tasks."""
    return tasks(spark, sf_dir).select("task_id", F.explode(K.episode_terms(F.col("task"))).alias("term"))


@query(
    f"""with {WORDS}, {_RECORDS}, shared as (select a.task_id, b.task_id record, count(*) overlap from terms a join terms b using (term) group by 1, 2), m as (select distinct task_id record, 'f' || (task_id % 37) path from tasks)
select task_id, path, least(60.0, sum(18.0 + least(12, 3 * overlap)))::double boost from shared join m using (record) group by 1, 2"""
)
def missed_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What feedback on similar tasks adds to files, summed for a file and capped: for every task, against all."""
    asked = _terms(spark, sf_dir)
    missed = tasks(spark, sf_dir).select(F.col("task_id").alias("record"), F.concat(F.lit("f"), F.col("task_id") % 37).alias("path"))
    return H.feedback_boosts(asked, asked.withColumnRenamed("task_id", "record"), missed)


@query(
    f"""with {WORDS}, {_RECORDS}, {_SHARED}, {FILES}, t as (select t.task_id record, f.path, case when t.task_id % 4 = 0 then 'old' when t.task_id % 4 = 1 then null else f.hash end h, f.hash from tasks t join files f on f.doc_id = t.task_id % 200)
select task_id, path, least(12.0, sum(4.0 + least(8, 2 * overlap)))::double boost from shared join (select distinct record, path from t where h is null or h = hash) using (record) group by 1, 2"""
)
def episode_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What similar episodes add, for each twentieth task, to files that are as they were then."""
    terms = _terms(spark, sf_dir)
    own = files(spark, sf_dir)
    t = F.col("task_id") % 4
    old = tasks(spark, sf_dir).select("task_id", (F.col("task_id") % 200).alias("doc_id")).join(own, "doc_id")
    touched = old.select(F.col("task_id").alias("record"), "path", F.when(t == 0, "old").when(t != 1, F.col("hash")).alias("hash"))
    return H.episode_boosts(terms.filter("task_id % 20 = 0"), terms.withColumnRenamed("task_id", "record"), touched, own.select("path", "hash"))


_RANKS = {"click": 2, "error": 4, "login": 1, "purchase": 3, "view": 0}


@query(
    f"""with {_LOG}, f as (select k skill, event_id "at", event_type status, (k % 7 - 3 + (value > 20)::int) / 3.0::double v, case event_type {" ".join(f"when '{s}' then {r}" for s, r in _RANKS.items())} else 0 end r from log)
select skill, case when count(*) filter (v <> 0) > 0 then round(greatest(-1, least(1, avg(greatest(-1, least(1, v))) filter (v <> 0))), 4) end success, max_by(status, (r, "at")) status from f group by 1"""
)
def skill_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean feedback on each skill, and its weightiest status."""
    rows = log(spark, sf_dir).select(F.col("k").alias("skill"), F.col("event_id").alias("at"), F.col("event_type").alias("status"), ((F.col("k") % 7 - 3 + (F.col("value") > 20).cast("int")) / 3.0).alias("value"))
    return H.skill_status(rows, _RANKS).join(H.skill_success(rows), "skill", "left")


_PROGRESS = f"""with recursive {_LOG}, o as (select k skill, event_id "at", project task, (20 + floor(value))::bigint c, row_number() over (partition by k order by event_id) i, event_type source from log),
g as (select skill, i, least(100, c) conf from o where i = 1 union all select o.skill, o.i, least(100, greatest(g.conf, o.c) + least(10, o.i)) from g join o on o.skill = g.skill and o.i = g.i + 1),
p as (select o.skill, max(o.i)::bigint tasks, max_by(g.conf, g.i)::bigint confidence, max_by(task, o.i) last_task, min("at") first_seen, max("at") last_seen from o join g on g.skill = o.skill and g.i = o.i group by 1)"""


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = log(spark, sf_dir).select(F.col("k").alias("skill"), F.col("event_id").alias("at"), F.col("project").alias("task"), (F.floor("value") + 20).alias("confidence"), F.col("event_type").alias("source"))
    return H.skill_progress(evidence)


@query(f"{_PROGRESS} select * from p")
def skill_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each skill is, evidence after evidence."""
    return _progress(spark, sf_dir)


@query(f"{_PROGRESS} select skill, confidence, tasks from p order by confidence, tasks, last_seen, skill limit 5")
def practice_drills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.drills(_progress(spark, sf_dir)).select("skill", "confidence", "tasks")


_SIGNALS = '''signals as (select event_id "at", case when event_id % 3 = 0 then 'rename:' else 'merge:' end || user_id || ' => ' || (user_id * 7 + event_id % 5) target from events where event_type = 'error')'''


@query(
    f"""with {_SIGNALS}, m as (select trim(regexp_extract(target, ':([^=]*)=>', 1)) old, max_by(trim(regexp_extract(target, '=>(.*)$', 1)), "at") new from signals group by 1), c as (select distinct event_type item, user_id::varchar concept from events where event_type <> 'error')
select distinct item, coalesce(m.new, concept) concept from c left join m on m.old = concept where coalesce(m.new, concept) not in (select user_id::varchar from events where user_id % 10 = 3)"""
)
def feedback_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts after renames and merges, without suppressed ones."""
    events = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    kind = F.when(F.col("event_id") % 3 == 0, "rename:").otherwise("merge:")
    signals = events.filter("event_type = 'error'").select(F.col("event_id").alias("at"), F.concat(kind, user, F.lit(" => "), (F.col("user_id") * 7 + F.col("event_id") % 5).cast("string")).alias("target"))
    concepts = events.filter("event_type != 'error'").select(F.col("event_type").alias("item"), user.alias("concept")).distinct()
    return H.apply_feedback(concepts, H.feedback_maps(signals), events.filter("user_id % 10 = 3").select(user.alias("concept")))


@query(
    """with r as (select doc_id id, text rule, n_chars % 100 c, doc_id % 4 = 0 a, doc_id % 3 = 0 e from documents)
select id, (c + case when a then 30 else 0 end + case when e then 15 else 0 end + 10 * (contains(lower(rule), 'tion')::int + contains(lower(rule), 'der')::int) + 20 * contains(lower(rule), 'ing')::int)::bigint score from r where not contains(lower(rule), 'ment') order by 2 desc, 1 limit 25"""
)
def best_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons (documents) by what speaks for them."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("rule"), (F.col("n_chars") % 100).alias("confidence"), (F.col("doc_id") % 4 == 0).alias("accepted"), (F.col("doc_id") % 3 == 0).alias("evidenced"))
    one = lambda *terms: spark.createDataFrame([(t,) for t in terms], "term string")
    return H.lessons(rows, one("tion", "der"), one("ing"), one("ment"), 25)
