"""Scoring of files for tasks, with DuckDB's SQL: tasks are the benchmark's items, opened as tasks of a repository are."""

from __future__ import annotations

import re
from string import ascii_lowercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions import tasks as K
from siltstone.operators import scoring as G
from siltstone.operators.relations import secret_flag
from siltstone.plans.files import API_KEY, FAMILY, NAME, PATH_TOKENS, RELEASE, TOKENS, is_kind
from siltstone.plans.registry import query
from siltstone.plans.tasks import LITERALS, PHRASES, WEIGHTS, words
from siltstone.sources.repository import FILES, OPENINGS, TASKS, files
from siltstone.sources.shared import written
from siltstone.sources.tables import table

TASK = f"concat(split_part('{'|'.join(OPENINGS)}', '|', cast(item_id % {len(OPENINGS)} as int) + 1), text)"
ITEM_TASKS = f"tasks as (select item_id task_id, {TASK} task from benchmark)"
TOO_LARGE, TOP = 4000, 50
DEFINES, CALLS = "(?:^|\\n)([A-Za-z]+ [A-Za-z]+)", "([a-z]{4,}),"
_DEFINES = re.compile(DEFINES.replace("(?:^|\\n)", "\n"))


def item_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), F.expr(TASK).alias("task"))


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files with what is known of them, and imports; flags and imports follow the number of the document.  The paths are made once, of the texts."""
    d = F.col("doc_id")
    own = written(files(spark, sf_dir).select("doc_id", "path", "tokens"), "paths")
    counted = own.groupBy((d % 23).alias("churn")).agg(F.count("*").alias("n")).collect()
    # the value at a tenth of the rows, from above: running counts of the distinct values
    place, before, threshold = max(0, sum(r["n"] for r in counted) // 10 - 1), 0, None
    for r in sorted((r for r in counted if r["churn"] is not None), key=lambda r: -r["churn"]):
        threshold = r["churn"] if before <= place < before + r["n"] else threshold
        before += r["n"]
    imports = own.select(F.col("path").alias("src"), F.explode(F.array(d + 3, d * 2)).alias("to")).join(own.select(F.col("doc_id").alias("to"), F.col("path").alias("dst")), "to").filter("src != dst").select("src", "dst").distinct()
    imports = written(imports, "imports")
    flagged = own.select(
        "path", (d % 10 == 1).alias("changed"), (d % 30 == 1).alias("staged"), (d % 9 == 2).alias("recent"), (d % 23 >= threshold).alias("churn_high"),
        F.when(d % 11 == 5, d % 6).otherwise(0).alias("co_changed"), (F.col("tokens") > TOO_LARGE).alias("too_large"), (d % 8 == 3).alias("has_tests"), "tokens",
    )
    changed = flagged.filter("changed").select("path")
    uses = imports.join(changed.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path")).distinct().withColumn("changed_dependency", F.lit(True))
    used = imports.join(changed.withColumnRenamed("path", "src"), "src", "left_semi").select(F.col("dst").alias("path")).distinct().withColumn("dependent", F.lit(True))
    return flagged.join(uses, "path", "left").join(used, "path", "left"), imports


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text and the values of its summary that the text does not give."""
    value = lambda f, v: F.struct(F.lit(f).alias("field"), F.lit(0).alias("pos"), v.alias("value"))
    return files(spark, sf_dir).select("path", "text", F.array(value("role", P.family(F.col("path"))), value("domain", F.col("source"))).alias("values"))


def _defines(text: str) -> list[str]:
    """The groups of DEFINES: a line's start is looked for as a plain character."""
    return _DEFINES.findall(f"\n{text}")


def _calls(text: str) -> list[str]:
    """The groups of CALLS: small letters, four at least, before each comma."""
    parts = text.split(",")[:-1]
    return [w for p in parts if len(w := p[len(p.rstrip(ascii_lowercase)) :]) >= 4]


#: The values of a summary that stand in its text.
FINDERS = {"defines": _defines, "calls": _calls}


_RARITY = "case when n <= 1 then 1.0 else least(1.0, greatest(0.0, ln((n + 1.0::double) / (coalesce(df, 0) + 1)) / ln(n + 1.0::double))) end"
_KIND = f"case when regexp_matches(task, '{K.COMMIT}') then lower(regexp_extract(task, '{K.COMMIT}', 1)) end"
_SCOPE = f"case when regexp_matches(task, '{K.COMMIT}') then {TOKENS.format(f'''regexp_extract(task, '{K.COMMIT}', 2)''')} else [] end"
_GENERIC, _AMBIGUOUS = words(K.GENERIC_WORDS), words(K.AMBIGUOUS_WORDS)
_PAIRS = lambda tokens: PHRASES.replace("len(w)", f"len({tokens})").replace("w[i", f"{tokens}[i")

#: CTEs from files to the plan: f, fields, imports, docs, terms, phrases.
PLAN = f"""{WEIGHTS.replace(TASKS, ITEM_TASKS)}, {FILES},
th as (select churn from (select doc_id % 23 churn, row_number() over (order by doc_id % 23 desc) - 1 k, count(*) over () n from files) where k = greatest(0, n // 10 - 1)),
imports as (select distinct a.path src, b.path dst from files a join files b on b.doc_id = a.doc_id + 3 or b.doc_id = a.doc_id * 2 where a.path <> b.path),
f as (select path, text, doc_id % 10 = 1 changed, doc_id % 30 = 1 staged, doc_id % 9 = 2 recent, doc_id % 23 >= (select churn from th) churn_high, case when doc_id % 11 = 5 then doc_id % 6 else 0 end co_changed,
  tokens > {TOO_LARGE} too_large, doc_id % 8 = 3 has_tests, path in (select src from imports where dst in (select path from files where doc_id % 10 = 1)) changed_dependency,
  path in (select dst from imports where src in (select path from files where doc_id % 10 = 1)) dependent from files),
fields as (select path, 'role' field, 0 pos, {FAMILY} "value" from files union all select path, 'domain', 0, source from files union all
  select path, 'defines', unnest(range(len(x))), unnest(x) from (select path, regexp_extract_all(text, '{DEFINES.replace(chr(92) + "n", chr(10))}', 1) x from files) union all
  select path, 'calls', unnest(range(len(x))), unnest(x) from (select path, regexp_extract_all(text, '{CALLS}', 1) x from files)),
fw as (select path, field, pos, "value", {TOKENS.format('"value"')} w from fields),
pw as (select path, {TOKENS.format("replace(path, '/', ' ')")} w from files),
tokens as (select distinct path, t from (select path, unnest({PATH_TOKENS}) t from files union all select path, unnest(w) t from fw) x where length(t) >= 3 or t in (select unnest({PATH_TOKENS}) from files q where q.path = x.path)),
pairs as (select distinct path, p from (select path, unnest({PHRASES}) p from fw union all select path, unnest({PHRASES}) from pw)),
n as (select count(distinct path) n from tokens),
terms as (select task_id, term, case when list_contains({_GENERIC}, term) or term is not distinct from k then 'generic' when list_contains({_AMBIGUOUS}, term) then 'ambiguous' else 'concrete' end kind,
  round(case when list_contains({_AMBIGUOUS}, term) then least(c, 0.45) else c end, 3) weight from
  (select task_id, term, k, case when term is not distinct from k then least(c, 0.25) else c end c from
  (select task_id, term, {_KIND} k, weight * (0.55::double + 0.7::double * ({_RARITY})) c from weights join tasks using (task_id) left join (select t term, count(*) df from tokens group by 1) using (term), n))),
ph as (select task_id, phrase, bool_or(l) "literal" from (select task_id, unnest({PHRASES}) phrase, false l from words union all select task_id, unnest({LITERALS}), true from tasks) group by 1, 2),
pb as (select task_id, phrase, avg(coalesce(weight, 1.0)) base, bool_or(coalesce(kind = 'ambiguous', false)) vague from (select task_id, phrase, unnest(string_split(phrase, ' ')) term from ph) left join terms using (task_id, term) group by 1, 2),
phrases as (select task_id, phrase, "literal", case when "literal" then greatest(c, 1.6) else c end weight from
  (select task_id, phrase, "literal", round(case when vague then base * (0.75::double + 0.45::double * ({_RARITY})) else least(1.25, base * (0.75::double + 0.45::double * ({_RARITY})) + 0.12::double) end, 3) c
  from ph join pb using (task_id, phrase) left join (select p phrase, count(*) df from pairs group by 1) using (phrase), n))"""


@query(f"with {PLAN} select task_id, term item, kind, weight from terms union all select task_id, phrase, case when \"literal\" then 'literal' else 'phrase' end, weight from phrases")
def keyword_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted terms and phrases of each task."""
    terms, phrases = G.plan(item_tasks(spark, sf_dir), texts(spark, sf_dir), FINDERS)
    kind = F.when(F.col("literal"), "literal").otherwise("phrase")
    return terms.select("task_id", F.col("term").alias("item"), "kind", "weight").unionByName(phrases.select("task_id", F.col("phrase").alias("item"), kind.alias("kind"), "weight"))


def _fields(sql: str) -> str:
    return ", ".join(sql.format(f) for f, _ in G.FIELDS)


_SUM = " + ".join(f"({f}_weight > 0)::int" for f in ("role", "domain"))
#: CTEs from the plan to (task_id, path, score).
SCORED = f"""{PLAN},
pt as (select task_id, path, max(weight) path_weight, list(distinct term) filter (kind = 'concrete') pc, list(distinct term) filter (kind = 'ambiguous') pa, list(distinct term) pall from (select path, unnest({PATH_TOKENS}) term from files) join terms using (term) where length(term) >= 3 group by 1, 2),
ct as (select task_id, path, count(*) content_hits, sum(round(weight * 1000)::bigint)::bigint content_weight, list(distinct term) filter (kind = 'concrete') tc, list(distinct term) filter (kind = 'ambiguous') ta, list(distinct term) tall
  from (select distinct path, unnest({TOKENS.format('text')}) term from files) join terms using (term) where length(term) >= 3 group by 1, 2),
fv as (select task_id, path, field, pos, "value", max(weight) weight, count(*) filter (kind = 'concrete') hits from (select distinct path, field, pos, "value", unnest(w) term from fw) join terms using (term) where length(term) >= 3 group by 1, 2, 3, 4, 5),
dp as (select distinct phrase from phrases),
vp as (select task_id, path, field, pos, "value", max(weight) pw from (select path, field, pos, "value", phrase from (select distinct path, field, pos, "value", array_to_string(w, ' ') normal from fw) join dp on contains(normal, phrase)) join phrases using (phrase) group by 1, 2, 3, 4, 5),
fp as (select task_id, path, field, pos, "value", greatest(coalesce(weight, 0), coalesce(pw, 0)) best, coalesce(hits, 0) hits from fv full join vp using (task_id, path, field, pos, "value")),
hp as (select task_id, path, max(weight) filter (contains(np, phrase)) ppw, max(weight) apw, bool_or("literal") has_literal, list(phrase) filter ("literal") lits
  from (select path, np, phrase from (select path, array_to_string({TOKENS.format('path')}, ' ') np, array_to_string({TOKENS.format('path')}, ' ') || ' ' || array_to_string({TOKENS.format("coalesce(text, '')")}, ' ') na from f) join dp on contains(na, phrase)) join phrases using (phrase) group by 1, 2),
roots as (select distinct {TOKENS.format("replace(regexp_replace(path, '/?[^/]*$', ''), '/', '-')")} names from files),
rooted as (select distinct task_id, true rooted from (select task_id, {_SCOPE} scope from tasks) join roots on len(scope) > 0 and list_has_all(names, scope)),
fb as (select task_id, path, field, max_by(struct_pack(v := "value", w := best, h := hits), (best, -pos)) b from fp group by 1, 2, 3),
fx as (select task_id, path, {_fields("max(b.v) filter (field = '{0}') {0}, max(b.w) filter (field = '{0}') {0}_weight, max(b.h) filter (field = '{0}') {0}_hits")} from fb group by 1, 2),
nd as (select distinct task_id, src path, true named_dependency from pt join imports on path = dst),
ap as (select task_id, path, count(distinct term) api_hits from (select path, unnest(string_split(substr(api_key, 6), '/')) term from (select path, {API_KEY} api_key from files) where api_key is not null) join terms using (term) where length(term) >= 3 group by 1, 2),
met as (select * from pt full join ct using (task_id, path) full join fx using (task_id, path) full join nd using (task_id, path) full join hp using (task_id, path)),
asks as (select task_id, bool_or(term in ('test', 'tests', 'spec', 'specs')) asks_test, bool_or(list_contains({words(G.RELEASE_TERMS)}, term)) asks_release, bool_or(list_contains({words(G.BUILD_TERMS)}, term)) asks_build from terms group by 1),
x as (select task_id, path, coalesce(path_weight, 0) path_weight, coalesce(pc, []) pc, coalesce(pa, []) pa, coalesce(tc, []) tc, coalesce(ta, []) ta, list_distinct(coalesce(pall, []) || coalesce(tall, [])) matched, coalesce(content_hits, 0) hits, coalesce(content_weight, 0) content_weight,
  {_fields("coalesce({0}_weight, 0) {0}_weight, coalesce({0}_hits, 0) {0}_hits")}, coalesce(defines, '') defines, coalesce(named_dependency, false) or changed_dependency dependency, coalesce(api_hits, 0) api_hits,
  changed, staged, recent, churn_high, co_changed, too_large, has_tests, dependent, {is_kind('test_file')} test_file, regexp_matches(path, '(?i)(^|/)e2e(/|$)') e2e, {is_kind('config_file')} config_file, {is_kind('build_metadata')} build_file,
  {RELEASE} release_file, {is_kind('release_primary')} release_primary, lower({NAME}) = 'gradle.properties' gradle, {is_kind('knowledge_file')} knowledge, list_has_any({PATH_TOKENS}, {words(P.ROLE_WORDS)}) role_file, {is_kind('agent_artifact')} artifact,
  {PATH_TOKENS} path_tokens, {API_KEY} api_key, ppw, apw, coalesce(has_literal, false) has_literal, coalesce(lits, []) lits, coalesce(rooted, false) rooted,
  {_KIND} kind, {_SCOPE} scope, asks_test, asks_release, asks_build, regexp_matches(text, '(?i)(api_?key|token|secret|password)[ ]*[=:][ ]*["''][A-Za-z0-9_-]{{16,}}["'']') secret
  from met join f using (path) join tasks using (task_id) left join asks using (task_id) left join rooted using (task_id) left join ap using (task_id, path)),
y as (select x.*, len(list_filter(lits, lambda p: contains(array_to_string({TOKENS.format('x.defines')}, ' '), p))) > 0 and defines_weight > 0 defined, (select coalesce(bool_or("literal"), false) from phrases p where p.task_id = x.task_id) has_literals from x),
z as (select *, greatest(path_weight, coalesce(ppw, 0)) filename, len(list_filter(pc, lambda t: not list_contains({_GENERIC}, t))) ph, apw is not null has_phrase, len(pc) + len(tc) + defines_hits plain, list_distinct(pa || ta) vague,
  dependency or dependent or co_changed > 0 or has_tests graph from y),
e as (select *, case when ph >= 2 and not (test_file and coalesce(kind, '') <> 'test') then least(case when config_file then 210.0 else 150.0 end, 70.0 + 35.0 * least(2, ph - 2) + case when config_file then 105.0 else 0 end) else 0 end path_bonus,
  len(scope) > 0 and kind <> 'test' and list_has_all(path_tokens, scope) scoped, hits >= 2 and filename = 0 and defines_weight = 0 and (has_phrase or calls_weight > 0) direct, len(vague) > 0 and plain = 0 unclear,
  filename > 0 or defines_weight > 0 or hits > 0 signal, asks_release and release_file release, asks_build and build_file build from z),
g as (select *, unclear and hits >= 1 and (defines_weight > 0 or role_file) restored, unclear and hits = 0 and filename > 0 and defines_weight = 0 capped, asks_test and not test_file and not config_file damped_test,
  asks_release and not release and len(matched) > 0 and list_has_all({words(G.RELEASE_TERMS)}, matched) and not graph and not has_phrase and defines_weight = 0 only_release,
  filename > 0 and not (changed or staged or defines_weight > 0 or hits > 0 or graph or config_file or knowledge or (role_file and signal) or recent or role_weight > 0 or domain_weight > 0 or calls_weight > 0) weak,
  hits >= 2 or calls_weight > 0 or defines_weight > 0 or has_phrase or dependency or dependent or co_changed > 0 supported,
  not test_file and not (graph or has_phrase or has_literal or config_file or knowledge or release or build or api_hits > 0 or defines_weight > 0 or calls_weight > 0 or direct) and (filename > 0)::int + (hits > 0)::int + {_SUM} >= 2 and api_key is null false_hit from e),
s1 as (select *, 0.0::double + case when changed then 100 else 0 end + case when staged then 90 else 0 end + 80 * filename + case when ppw is not null then least(28.0::double, 18.0::double * ppw) else 0 end + case when scoped then 160 else 0 end + path_bonus + 70 * defines_weight
  + 56.0 * role_weight + 50.0 * domain_weight + case when defines_weight > 0 then 42.0 * defines_weight + case when defines_hits >= 2 then least(120.0, 55.0 * (defines_hits - 1)) else 0 end else 0 end + 26.0 * calls_weight
  + case when defined then 150 else 0 end + case when api_hits > 0 then 170.0 + 35.0 * least(2, api_hits - 1) else 0 end + case when hits > 0 then least(60.0::double, content_weight / 1000::double * 10) else 0 end + case when has_literal then 360 else 0 end s from g),
s2 as (select * replace (s * case when not has_literal and kind = 'chore' and has_literals and (filename > 0 or defines_weight > 0) then 0.55 else 1 end + case when apw is not null then least(20.0::double, 14.0::double * apw) else 0 end + case when direct then least(270.0, 120.0 + 50.0 * least(3, hits - 2)) else 0 end
  + case when restored then least(24.0, 10.0 + 6.0 * least(hits, 3)) else 0 end as s) from s1),
s3 as (select * replace ((case when capped then greatest(s - 8, 0) else s end + case when signal and role_file then 35 else 0 end + case when asks_test and test_file then 95 + case when e2e then 35 else 0 end else 0 end) as s) from s2),
s4 as (select * replace (case when damped_test then greatest(s * 0.72::double, 0) else s end + case when dependency then 50 else 0 end + case when dependent then 40 else 0 end + case when has_tests then 35 else 0 end + case when config_file then 25 else 0 end
  + case when build then 190 + case when gradle then 35 else 90 end else 0 end + case when release then 110 + case when release_primary then 70 else 0 end else 0 end + case when secret then 100 else 0 end + case when knowledge then 30 else 0 end
  + case when recent then 20 else 0 end + case when churn_high then 15 else 0 end + case when co_changed > 0 then 28 * least(1.0::double, 0.5::double + co_changed / 4::double) else 0 end as s) from s3),
s4a as (select * replace (case when only_release then greatest(s * 0.35::double, 0) else s end as s) from s4),
s4b as (select * replace (case when rooted and coalesce(kind, '') <> 'test' and not list_has_all(path_tokens, scope) then greatest(s * 0.62::double, 0) else s end as s) from s4a),
s5 as (select * replace (case when weak then greatest(s - 45, 1) else s end as s) from s4b),
s6 as (select * replace (s + case when too_large and supported then 120 when too_large and s < 50 then -50 else 0 end as s) from s5),
s7 as (select * replace (case when false_hit then greatest(0, s * 0.72::double) else s end as s) from s6),
scored as (select task_id, path, round(case when artifact then case when changed then least(s, 160) else least(s * 0.25, 80) end else s end, 2) score from s7)"""


def scored(spark: SparkSession, sf_dir: str, known: tuple[DataFrame, DataFrame] | None = None, keep: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """Points of all files; known: what facts() gives, with more columns of files of which `keep` stay, as do columns of the evidence in `also`."""
    own, imports = known or facts(spark, sf_dir)
    roots = own.select(F.concat(F.lit("packages/"), F.regexp_replace(F.regexp_replace("path", "/?[^/]*$", ""), "/", "-")).alias("root")).distinct()
    return G.score(G.evidence(item_tasks(spark, sf_dir), own, None, imports, secret_flag(F.col("text")), roots, texts(spark, sf_dir), FINDERS, keep), keep=keep + also)


@query(f"with {SCORED} select task_id, path, score, rank from (select *, row_number() over (partition by task_id order by score desc, path) rank from scored) where rank <= {TOP}")
def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fifty files of each task by all evidence."""
    return G.top(scored(spark, sf_dir).select("task_id", "path", "score"), TOP)
