"""Queries of selection, evaluation and provenance, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import selection as S
from siltstone.operators.relations import ranked_within
from siltstone.plans.registry import query
from siltstone.sources.tables import table

_COST = "greatest(1, length(text) // 4)"
BUDGET = 600


@query(f"""
with recursive c as (select conv_id task, turn path, length(text) score, {_COST} tokens from conversations where text <> ''),
r as (select *, row_number() over (partition by task order by score desc, path) rank from c),
g as (
  select task, rank, tokens, path, tokens <= {BUDGET} selected, case when tokens <= {BUDGET} then tokens else 0 end used from r where rank = 1
  union all
  select r.task, r.rank, r.tokens, r.path, g.used + r.tokens <= {BUDGET}, g.used + case when g.used + r.tokens <= {BUDGET} then r.tokens else 0 end from g join r on r.task = g.task and r.rank = g.rank + 1)
select task, path, rank, tokens::bigint tokens, selected from g""")
def select_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation, longest first, into a budget of tokens."""
    turns = table(spark, sf_dir, "conversations")
    return S.select_under_budget(turns.select(F.col("conv_id").alias("task"), F.col("turn").alias("path"), F.length("text").alias("score"), X.estimate_tokens(F.col("text")).alias("tokens")), BUDGET)


_JUDGED = f"j as (select doc_id, source, n_chars, {_COST} tokens, coalesce(quality, 0) = 1 expected, row_number() over (partition by source order by n_chars desc, doc_id) rank from documents left join (select doc_id, max(quality) quality from labels group by 1) using (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", X.estimate_tokens(F.col("text")).alias("tokens"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("expected"))
    return ranked_within(docs, "source", "n_chars", "doc_id").join(labels, "doc_id", "left").withColumn("expected", F.coalesce("expected", F.lit(False)))


@query(f"""with {_JUDGED}, e as (select source, rank, row_number() over (partition by source order by rank) - 1 k, count(*) over (partition by source) n from j where expected)
select source, count(*) expected, max(rank) all_at, max(rank) filter (k = round_even((n - 1) * 0.5, 0)) median_rank, max(rank) filter (k = round_even((n - 1) * 0.9, 0)) p90_rank,
round(avg((rank <= 20)::int), 4) recall_20, round(avg((rank <= 50)::int), 4) recall_50, round(avg((rank <= 100)::int), 4) recall_100 from e group by 1""")
def rank_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expected_ranks(_judged(spark, sf_dir), "source")


@query(f"""with {_JUDGED}, c as (select source, count(*) filter (expected and rank <= 10) hit, count(*) filter (rank <= 10) s, count(*) filter (expected) e, sum(tokens) filter (expected and rank <= 10) ht, sum(tokens) filter (rank <= 10) st from j group by 1)
select source, round(coalesce(hit / nullif(s, 0), 0), 4)::double "precision", round(coalesce(hit / nullif(e, 0), 0), 4)::double recall, round(coalesce(2 * hit / nullif(s + e, 0), 0), 4)::double f1, round(coalesce(ht / nullif(st, 0), 0), 4)::double token_precision from c""")
def selection_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.token_accuracy(_judged(spark, sf_dir).withColumn("selected", F.col("rank") <= 10), "source")


@query(f"""with {_JUDGED} select status, count(*) n from (select case when rank <= 10 then 'selected' when tokens > 4000 then 'too_large' when n_chars < 200 then 'too_small' when rank <= 50 then 'ranked_below' else 'not_ranked' end status from j where expected) group by 1""")
def miss_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why expected documents were not among a source's first ten."""
    status = F.when(F.col("rank") <= 10, "selected").when(F.col("tokens") > 4000, "too_large").when(F.col("n_chars") < 200, "too_small").when(F.col("rank") <= 50, "ranked_below").otherwise("not_ranked")
    return _judged(spark, sf_dir).filter("expected").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_FAMILIES = {"link": "https?://", "address": "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.]", "licence": "(?i)licen[sc]e", "number": "[0-9]{4}", "plain": "^[^0-9@]*$"}


@query(
    "with f as (select doc_id, family from (" + " union all ".join(f"select doc_id, '{k}' family, regexp_matches(text, '{v}') fits from documents" for k, v in _FAMILIES.items()) + ") where fits)"
    " select family, count(*) n, count(*) filter (quality = 1) expected, round(count(*) filter (quality = 1) / count(*), 4)::double \"precision\" from f left join (select doc_id, max(quality) quality from labels group by 1) using (doc_id) group by 1"
)
def family_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each family of evidence are labelled good; a document counts once in each of its families."""
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(v), F.lit(k)) for k, v in _FAMILIES.items()]))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).cast("long").alias("good"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.explode(found).alias("family"), F.coalesce("good", F.lit(0)).alias("good"))
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.sum("good").alias("expected"), F.round(F.sum("good") / F.count("*"), 4).alias("precision"))


@query("""with a as (select l_partkey path, case when sum(l_quantity) > 30 then 'full' else 'summary' end mode from lineitem where l_shipdate < timestamp '1996-01-01' group by 1), b as (select l_partkey path, case when sum(l_quantity) > 30 then 'full' else 'summary' end mode from lineitem where l_shipdate >= timestamp '1996-01-01' group by 1)
select change, count(*) n from (select case when a.path is null then 'added' when b.path is null then 'removed' when a.mode <> b.mode then 'mode' end change from a full join b using (path)) where change is not null group by 1""")
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts picked before and from 1996, each by mode."""
    lines, turn = table(spark, sf_dir, "lineitem"), F.lit("1996-01-01").cast("timestamp")
    mode = F.when(F.sum("l_quantity") > 30, "full").otherwise("summary").alias("mode")
    side = lambda c: lines.filter(c).groupBy(F.col("l_partkey").alias("path")).agg(mode)
    return S.delta(side(F.col("l_shipdate") < turn), side(F.col("l_shipdate") >= turn)).groupBy("change").agg(F.count("*").alias("n"))


_URL = "regexp_replace(url, '^https?://|[?].*$', '', 'g')"


@query(f"""with p as (select distinct {_URL} path from pages), r as (select distinct string_split(path, '/')[1] root from p union select distinct string_split(path, '/')[1] || '/' || string_split(path, '/')[2] from p where string_split(path, '/')[2] in ('en', 'de'))
select path, max_by(root, length(root)) root from p join r on path = root or starts_with(path, root || '/') group by 1""")
def workspace_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's longest root, of hosts and of their English and German parts."""
    paths = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://|[?].*$", "").alias("path")).distinct()
    parts = F.split("path", "/")
    roots = paths.select(F.explode(F.array_compact(F.array(parts[0], F.when(F.get(parts, F.lit(1)).isin("en", "de"), F.concat_ws("/", parts[0], F.get(parts, F.lit(1))))))).alias("root"))
    return S.longest_prefix(paths, roots)


@query("""with d as (select distinct l_orderkey c, l_partkey f from lineitem), s as (select f from d group by 1 order by count(*) desc, f limit 8)
select f file, 24::bigint boost, count(*) links from d where c in (select c from d where f in (from s)) and f not in (from s) group by 1""")
def recall_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbour_boosts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")))


@query("""with c as (select doc_id, 1 + quality f, 2 + toxic * 3 l, quality + toxic h from labels), d as (select doc_id, len(string_split(text, chr(10))) n from documents)
select status, count(*) n from (select case when d.doc_id is null then 'missing' when h = 2 then 'stale' when l > n then 'lines' else 'valid' end status from c left join d using (doc_id)) group by 1""")
def citations_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations derived from labels: their lines depend on the label, and those with both marks carry the digest of another text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = labels.join(docs.select("doc_id", F.sha2("text", 256).alias("hash")), "doc_id", "left")
    hashed = F.when(F.col("quality") + F.col("toxic") == 2, F.lit("0")).otherwise(F.col("hash"))
    cited = seen.select("doc_id", (F.col("quality") + 1).alias("first"), (F.col("toxic") * 3 + 2).alias("last"), hashed.alias("hash"))
    return S.check_citations(cited, docs).groupBy("status").agg(F.count("*").alias("n"))


#: Terms of each domain (fixed values).
DOMAINS = {"legal": ("license", "licensed", "public", "copyright"), "contact": ("mail", "email", "phone", "call", "contact"), "network": ("http", "https", "www", "server", "address"), "secret": ("password", "token", "secret", "key")}
_VOCABULARY = ", ".join(f"('{d}', '{t}')" for d, terms in DOMAINS.items() for t in terms)
_SPLIT = "string_split_regex(lower(text), '[^a-z0-9]+')"


@query(f"""with v(domain, term) as (values {_VOCABULARY}), c as (select doc_id, term, count(*) tf from (select doc_id, unnest({_SPLIT}) term from documents) where term in (select term from v) group by 1, 2),
i as (select term, ln(1 + ((select count(*) from documents) - count(*) + 0.5::double) / (count(*) + 0.5::double)) idf from c group by 1)
select doc_id, domain, round(sum(idf * 2.2::double * tf / (tf + 1.2::double)), 4) score from c join i using (term) join v using (term) group by 1, 2 having round(sum(idf * 2.2::double * tf / (tf + 1.2::double)), 4) >= 1""")
def bm25_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = spark.createDataFrame([(d, t) for d, terms in DOMAINS.items() for t in terms], "domain string, term string")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t.isin(*[t for terms in DOMAINS.values() for t in terms]))
    counts = docs.select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return S.saturated_scores(counts, vocabulary, docs.agg(F.count("*").alias("n")))


_GENERIC = ", ".join(f"'{g}'" for g in X.GENERIC)
_LONG = f"list_filter({_SPLIT}, lambda t: length(t) >= 3)"


@query(f"select conv_id, turn, len({_LONG})::bigint terms, round(coalesce(len(list_filter({_LONG}, lambda t: list_contains([{_GENERIC}], t))) / nullif(len({_LONG}), 0), 0), 4)::double generic_ratio from conversations where role = 'user' and text is not null")
def generic_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a task's terms that say little."""
    terms = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    rows = table(spark, sf_dir, "conversations").filter("role = 'user' and text is not null").select("conv_id", "turn", terms.alias("t"))
    ratio = F.coalesce(F.size(F.filter("t", lambda x: x.isin(*X.GENERIC))) / F.nullif(F.size("t"), F.lit(0)), F.lit(0.0))
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("terms"), F.round(ratio, 4).alias("generic_ratio"))


@query(f"select conv_id, term, min(turn) first_turn, count(*) n from (select conv_id, turn, unnest({_LONG}) term from conversations) group by 1, 2")
def ordered_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms of a conversation with the turn that brings each first."""
    terms = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(terms).alias("term")).groupBy("conv_id", "term").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents), k as (select doc_id, line, regexp_matches(line, '(?i)error|warn|fail|licen|[0-9]{3}') important, length(line) n from l),
d as (select doc_id, line, min(n) n from k where important group by 1, 2), a as (select doc_id, count(*) lines, sum(n)::bigint chars from k group by 1), b as (select doc_id, count(*) kept, sum(n)::bigint kept_chars from d group by 1)
select doc_id, lines, coalesce(kept, 0) kept, coalesce(kept > 0 and kept_chars < chars, false) compressed from a left join b using (doc_id)""")
def compress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that matter, each once; a text is only replaced by them when that is shorter."""
    lines = F.split("text", "\n")
    kept = F.array_distinct(F.filter(lines, lambda x: x.rlike("(?i)error|warn|fail|licen|[0-9]{3}")))
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(lines).cast("long").alias("lines"), (F.length("text") - F.size(lines) + 1).alias("chars"), kept.alias("k"))
    shorter = (F.size("k") > 0) & (F.length(F.array_join("k", "")) < F.col("chars"))
    return rows.select("doc_id", "lines", F.size("k").cast("long").alias("kept"), shorter.alias("compressed"))


@query("""with m as (select p_brand module, p_type role, count(*) n, max(p_retailprice) top from part group by 1, 2), r as (select module, role, n, row_number() over (partition by module order by n desc, role) k, max(top) over (partition by module) score from m),
t as (select p_brand module, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) k from part)
select module, role, score, members from r join (select module, string_agg(p_partkey::varchar, ',' order by k) members from t where k <= 4 group by 1) using (module) where k = 1""")
def repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module's best score, commonest role and four best members."""
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "module")
    roles = parts.groupBy("module", F.col("p_type").alias("role")).agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top"))
    role = roles.groupBy("module").agg(F.min_by("role", F.struct(-F.col("n"), "role")).alias("role"), F.max("top").alias("score"))
    w = Window.partitionBy("module").orderBy(F.desc("p_retailprice"), "p_partkey")
    best = parts.withColumn("k", F.row_number().over(w)).filter("k <= 4").groupBy("module").agg(F.array_sort(F.collect_list(F.struct("k", "p_partkey"))).alias("m"))
    return role.join(best, "module").select("module", "role", "score", F.array_join(F.transform("m", lambda x: x["p_partkey"].cast("string")), ",").alias("members"))


@query("""select k, count(*) users, max(ts) last_ts from (select json_extract(max_by(props, (ts, event_id)), '$.k')::bigint k, max(ts) ts from events group by user_id) where ts >= (select max(ts) from events) - interval 24 hours group by 1 having count(*) >= 2""")
def thread_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the last events of several active users share; a conflict is a group, not its pairs."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("props"), F.max("ts").alias("ts"))
    now = events.agg(F.max("ts").alias("now"))
    active = last.join(F.broadcast(now)).filter(F.col("ts") >= F.col("now") - F.expr("interval 24 hours"))
    return active.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("users"), F.max("ts").alias("last_ts")).filter("users >= 2")
