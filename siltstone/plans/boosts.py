"""Second passes over scored files, with DuckDB's SQL.  The scored files are the repository's, five tasks, by the number of the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.operators import boosts as B
from siltstone.plans.files import API_KEY, DOMAIN, NOISE, PATH_TOKENS, STEM, is_kind
from siltstone.plans.registry import query
from siltstone.plans.tasks import words
from siltstone.sources.repository import FILES, files
from siltstone.sources.shared import written

_REASONS = (
    ("filename", "doc_id % 2 = 0"), ("content", "doc_id % 3 = 0 and doc_id % 4 <> 0"), ("role", "doc_id % 5 = 2"), ("defines", "doc_id % 7 = 3"), ("API owner", "doc_id % 32 = 1"), ("symbol", "doc_id % 19 = 4"),
    ("co-changed", "doc_id % 23 = 9"),
)
_LIST = "list_filter([" + ", ".join(f"case when {c} then '{r}' end" for r, c in _REASONS) + "], lambda x: x is not null)"
#: files, base (task_id, path, score, reasons), edges, changed, terms.
BASE = f"""{FILES}, base as (select doc_id % 5 task_id, path, (n_chars % 300 - 20)::double score, {_LIST} reasons from files union all
  select doc_id % 5, 'tests/test_' || {STEM} || '.py', 10, [] from files where doc_id % 6 = 0),
edges as (select distinct a.path src, b.path dst from files a join files b on b.doc_id = a.doc_id + 5 or b.doc_id = a.doc_id * 6 where a.path <> b.path),
changed as (select path from files where doc_id % 40 = 1), both_ways as (select src, dst from edges union select dst, src from edges),
terms as (select distinct doc_id % 5 task_id, unnest({DOMAIN}) term from files where doc_id % 50 = 3)"""
_OUT = "select task_id, path, round(score, 4) score, array_to_string(reasons, ';') reasons from"
_ADDED = "(select b.task_id, b.path, b.score + coalesce(g.amount, 0) score, case when g.amount is null then b.reasons else list_append(b.reasons, g.reason) end reasons from base b left join gains g on g.task_id = b.task_id and g.path = b.path)"
ROLE, ENTRY = words(P.ROLE_WORDS), words(P.ENTRY_WORDS)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir)
    reasons = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(r)) for r, c in _REASONS]))
    rows = own.select((F.col("doc_id") % 5).alias("task_id"), "path", (F.col("n_chars") % 300 - 20).cast("double").alias("score"), reasons.alias("reasons"))
    tests = own.filter("doc_id % 6 = 0").select((F.col("doc_id") % 5).alias("task_id"), F.concat(F.lit("tests/test_"), P.stem(F.col("path")), F.lit(".py")).alias("path"), F.lit(10.0).alias("score"), F.array().cast("array<string>").alias("reasons"))
    return rows.unionByName(tests)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).select("doc_id", "path")
    to = own.select(F.col("path").alias("src"), F.explode(F.array(F.col("doc_id") + 5, F.col("doc_id") * 6)).alias("to"))
    return to.join(own.select(F.col("doc_id").alias("to"), F.col("path").alias("dst")), "to").filter("src != dst").select("src", "dst").distinct()


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter("doc_id % 40 = 1").select("path")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter("doc_id % 50 = 3").select((F.col("doc_id") % 5).alias("task_id"), F.explode(P.domain_tokens(F.col("path"))).alias("term")).distinct()


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("task_id", "path", F.round("score", 4).alias("score"), F.array_join("reasons", ";").alias("reasons"))


@query(
    f"""with {BASE}, t as (select task_id, score threshold from (select task_id, score, row_number() over (partition by task_id order by score, path) - 1 k, count(*) over (partition by task_id) n from base where score > 0 and not {is_kind('test_file')}) where k = n // 2),
s as (select task_id, path source, {STEM} stem from base join t using (task_id) where not {is_kind('test_file')} and not {is_kind('config_file')} and score >= threshold),
gains as (select b.task_id, b.path, 35.0 amount, 'test for ' || min(source) reason from base b join s on s.task_id = b.task_id and contains({STEM.replace('path', 'b.path')}, stem) where {is_kind('test_file').replace('path', 'b.path')} group by 1, 2)
{_OUT} {_ADDED}"""
)
def boost_paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(B.paired_tests(base(spark, sf_dir)))


@query(
    f"""with {BASE}, t as (select task_id, min(score) threshold from (select task_id, score, row_number() over (partition by task_id order by score desc, path) k from base where score > 0) where k <= 5 group by 1),
w as (select task_id, term from (select task_id, unnest({DOMAIN}) term from base join t using (task_id) where list_has_any({PATH_TOKENS}, {ENTRY}) and score >= threshold union select * from terms) where not list_contains({NOISE}, term)),
gains as (select distinct task_id, path, 30.0 amount, 'cross-layer' reason from (select task_id, path, unnest({DOMAIN}) term from base where list_has_any({PATH_TOKENS}, {ROLE})) join w using (task_id, term) join t using (task_id))
{_OUT} {_ADDED}"""
)
def boost_cross_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(B.cross_layer(base(spark, sf_dir), terms(spark, sf_dir)))


_API = f"a as (select *, {API_KEY} \"key\", string_split(substr({API_KEY}, 6), '/') parts from base), o as (select * from a where \"key\" is not null)"


@query(
    f"""with {BASE}, {_API}, x as (select *, parts[1] family, list_has_any(parts, coalesce((select list(term) from terms t where t.task_id = o.task_id and not list_contains({NOISE}, term)), [])) asked, list_contains(reasons, 'API owner') own from o),
f as (select *, row_number() over (partition by task_id, family order by score desc, path) k from x where (score >= 90 or own) and (own or asked) and task_id in (select task_id from x group by 1 having count(*) >= 2)),
gains as (select x.task_id, x.path, 45.0 + case when x.asked then 25 else 0 end amount, 'API pair with ' || f."key" reason from x join f using (task_id, family) where f.k = 1 and f.path <> x.path)
{_OUT} {_ADDED}"""
)
def boost_api_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(B.api_pairs(base(spark, sf_dir), terms(spark, sf_dir)))


@query(
    f"""with {BASE}, {_API}, c as (select a.path, {API_KEY.replace('path', 'b.path')} "key" from files a join files b on b.doc_id = a.doc_id + 10), w as (select task_id, "key", max(path) owner from o group by 1, 2),
u as (select b.task_id, w.owner path, list_has_any(string_split(substr(c."key", 6), '/'), coalesce((select list(term) from terms t where t.task_id = b.task_id and not list_contains({NOISE}, term)), [])) hit
  from base b join c on c.path = b.path join w on w.task_id = b.task_id and w."key" = c."key" where b.score > 0 and w.owner <> b.path and (regexp_matches(b.path, '(?i)\\.(tsx|jsx)$') or list_has_any({PATH_TOKENS.replace('path', 'b.path')}, ['component', 'components', 'page', 'pages', 'client', 'dashboard']))),
gains as (select task_id, path, max(108.0 + case when hit then 45 else 0 end) amount, 'API producer' reason from u group by 1, 2)
{_OUT} {_ADDED}"""
)
def boost_api_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = files(spark, sf_dir).select("doc_id", "path")
    calls = own.join(own.select((F.col("doc_id") - 10).alias("doc_id"), P.api_key(F.col("path")).alias("key")), "doc_id").filter("key is not null").select("path", "key")
    return _out(B.api_consumers(base(spark, sf_dir), calls, terms(spark, sf_dir)))


@query(
    f"""with {BASE}, s as (select task_id, path src, c, k from (select *, row_number() over (partition by task_id order by c desc, score desc, path) k from (select *, path in (from changed) c from base) where c or score >= 120) where k <= 8),
gains as (select task_id, dst path, max(24.0 + case when c then 8 else 0 end) amount, 'neighbour of ' || max_by(src, (24.0 + case when c then 8 else 0 end, -k)) reason from s join both_ways using (src) group by 1, 2)
{_OUT} {_ADDED}"""
)
def boost_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(B.recall_neighbours(base(spark, sf_dir), edges(spark, sf_dir), changed(spark, sf_dir)))


@query(
    f"""with {BASE}, s as (select task_id, path seed from (select *, row_number() over (partition by task_id order by score desc, path) k from base where score >= 100 or list_has_any(reasons, ['modified', 'staged', 'workspace', 'cross-layer', 'neighbour', 'co-changed'])) where k <= 10),
h1 as (select distinct task_id, seed, dst path from s join both_ways on seed = src where exists (select 1 from base b where b.task_id = s.task_id and b.path = dst)),
h2 as (select distinct h.task_id, h.seed, e.dst path from h1 h join both_ways e on e.src = h.path where e.dst <> h.seed and exists (select 1 from base b where b.task_id = h.task_id and b.path = e.dst) and not exists (select 1 from h1 x where x.task_id = h.task_id and x.seed = h.seed and x.path = e.dst)),
g as (select *, list_has_any({DOMAIN}, {DOMAIN.replace('path', 'seed')} || coalesce((select list(term) from terms t where t.task_id = h2.task_id and not list_contains({NOISE}, term)), [])) shares from h2),
b2 as (select task_id, path, max(12.0 + case when shares then 4 else 0 end) amount from g where shares or {is_kind('config_file')} group by 1, 2),
gains as (select *, 'second pass' reason from (select *, row_number() over (partition by task_id order by amount desc, path) j from b2) where j <= 32)
{_OUT} {_ADDED}"""
)
def boost_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(B.second_pass(base(spark, sf_dir), edges(spark, sf_dir), terms(spark, sf_dir)))


_NEEDS = "needs(workspace, needs) as (values ('src', 'lib'), ('packages', 'src'), ('app', 'packages'), ('lib', 'config'))"


@query(
    f"""with {BASE}, {_NEEDS}, p as (select distinct path, string_split(path, '/')[1] workspace from base), a as (select distinct doc_id % 5 task_id, string_split(path, '/')[1] workspace from files where doc_id % 40 = 1),
r as (select task_id, workspace, min(r) r from (select *, 1 r from a union all select task_id, needs, 2 from a join needs using (workspace) union all select task_id, n.workspace, 3 from a join needs n on n.needs = a.workspace) group by 1, 2),
gains as (select b.task_id, b.path, case r when 1 then 32.0 when 2 then 24.0 else 12.0 end amount, case r when 1 then 'workspace' when 2 then 'workspace dependency' else 'workspace dependent' end reason from base b join p using (path) join r using (task_id, workspace))
{_OUT} {_ADDED}"""
)
def boost_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = base(spark, sf_dir), files(spark, sf_dir)
    first = F.split("path", "/")[0].alias("workspace")
    active = own.filter("doc_id % 40 = 1").select((F.col("doc_id") % 5).alias("task_id"), first).distinct()
    needs = spark.createDataFrame([("src", "lib"), ("packages", "src"), ("app", "packages"), ("lib", "config")], "workspace string, needs string")
    return _out(B.workspaces(rows, rows.select("path", first).distinct(), active, needs))


_LIVE = "doc_id % 5 in (0, 1)"
_SCOPES = "scopes as (select task_id, case task_id when 0 then 'frontend_only' when 1 then 'backend_only' when 2 then 'frontend_only' else 'mixed' end scope, task_id * 0.15::double generic_share, task_id < 2 live from (select distinct task_id from base))"
# the sides of a repository: the same files under other roots
_SIDES = "base as (select task_id, case when length(path) % 3 = 0 then 'backend/' || path when length(path) % 3 = 1 then 'src/app/' || path else path end path, score, reasons from all_base), changed as (select path from base where length(path) % 13 = 1)"
_SIDED = BASE.replace("base as", "all_base as").split("edges as")[0] + _SIDES


def _sided(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = F.length("path") % 3
    rows = rows.withColumn("path", F.when(n == 0, F.concat(F.lit("backend/"), "path")).when(n == 1, F.concat(F.lit("src/app/"), "path")).otherwise(F.col("path")))
    return rows, rows.filter(F.length("path") % 13 == 1).select("path")


def _scopes(rows: DataFrame) -> DataFrame:
    t = F.col("task_id")
    scope = F.when(t.isin(0, 2), "frontend_only").when(t == 1, "backend_only").otherwise("mixed")
    return rows.select("task_id").distinct().select("task_id", scope.alias("scope"), (t * F.lit(0.15)).alias("generic_share"), (t < 2).alias("live"))


_SUPPORT = f"list_has_any(reasons, {words(B.SUPPORT)})"
_OUTSIDE = f"((scope = 'frontend_only' and regexp_matches(path, '{B.BACKEND_PATHS}')) or (scope = 'backend_only' and regexp_matches(path, '{B.FRONTEND_PATHS}')))"


@query(
    f"""with {_SIDED}, {_SCOPES}, x as (select *, path in (from changed) c, {_OUTSIDE} o, {_SUPPORT} su from base join scopes using (task_id)),
y as (select *, case when not c and o then case when not su and not list_contains(reasons, 'content') and (not live or generic_share >= 0.35) then 'scope suppressed' else 'scope dampened' end end r from x)
{_OUT} (select task_id, path, case r when 'scope suppressed' then 0 when 'scope dampened' then greatest(0, score - greatest(25, score * case when su then 0.45::double else 0.6::double end)) else score end score, case when r is null then reasons else list_append(reasons, r) end reasons from y)"""
)
def penalty_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, now = _sided(base(spark, sf_dir))
    return _out(B.scope_penalties(rows, _scopes(rows), now))


@query(
    f"""with {_SIDED}, {_SCOPES}, x as (select *, length(path) % 9 n, list_has_any(reasons, {words(B.STRONG)}) st, list_has_any(reasons, {words(B.WEAK)}) we, path in (from changed) c from base join scopes using (task_id)),
y as (select *, case when not c and n > 0 then case when generic_share >= 0.35 and n >= 4 and not st then 'repeat noise' when n >= 6 and not st and we then 'repeat weak noise' else 'history noise' end end r from x)
{_OUT} (select task_id, path, case when r is null then score when r = 'history noise' then greatest(0, score - least(45, n * 6.0 + greatest(0, n - 2) * 4.0)) else 0 end score, case when r is null then reasons else list_append(reasons, r) end reasons from y)"""
)
def penalty_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, now = _sided(base(spark, sf_dir))
    noise = rows.select("path", (F.length("path") % 9).alias("n")).distinct()
    return _out(B.history_penalties(rows, noise, _scopes(rows).select("task_id", "generic_share"), now))


@query(
    f"""with {_SIDED}, {_SCOPES}, x as (select *, list_contains(reasons, 'filename') fn, list_has_any(reasons, {words(B.STRONG)}) st, list_has_any(reasons, ['role', 'defines']) me from base join scopes using (task_id)),
y as (select *, case when st then null when fn and generic_share >= 0.3 then 'broad weak signal' when fn then 'name only' when me and generic_share >= 0.3 then 'broad summary' end r from x)
{_OUT} (select task_id, path, case r when 'broad weak signal' then least(score, greatest(0, score * 0.2::double)) when 'name only' then least(score, greatest(0, score * 0.35::double)) when 'broad summary' then greatest(0, score * 0.45::double - 15) else score end score, case when r is null then reasons else list_append(reasons, r) end reasons from y)"""
)
def penalty_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _sided(base(spark, sf_dir))
    return _out(B.quiet_guard(rows, _scopes(rows).select("task_id", "generic_share")))


@query(
    f"""with {_SIDED}, f as (select task_id, path, 18.0 boost from base where length(path) % 4 = 0), e as (select task_id, path, 12.0 + length(path) % 20 boost from base where length(path) % 6 = 0),
gains as (select task_id, path, greatest(coalesce(f.boost, 0), coalesce(e.boost, 0)) amount, case when e.boost is not null then 'similar episode' else 'missed before' end reason from f full join e using (task_id, path) where path not in (from changed)),
named as (select path from base where length(path) % 37 = 0), s as (select * from {_ADDED})
{_OUT} (select task_id, path, case when path in (from named) then greatest(score, 1000) else score end score, case when path in (from named) then list_prepend('requested', reasons) else reasons end reasons from s)"""
)
def boost_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What feedback and episodes add, then the files that a request names."""
    rows, now = _sided(base(spark, sf_dir))
    n = F.length("path")
    feedback = rows.filter(n % 4 == 0).select("task_id", "path", F.lit(18.0).alias("boost"))
    episodes = rows.filter(n % 6 == 0).select("task_id", "path", (n % 20 + 12.0).alias("boost"))
    return _out(B.requested(B.memory_boosts(rows, feedback, episodes, now), rows.filter(n % 37 == 0).select("path")))


@query(
    f"""with {BASE}, p as (select path, case when len(string_split(path, '/')) > 1 then string_split(path, '/')[-2] else '' end parent, {STEM} stem from base),
c as (select path source, unnest([{', '.join("'" + t.replace('{parent}', "' || parent || '").replace('{stem}', "' || stem || '") + "'" for t in B.TEST_PLACES)}]) test from p)
select distinct source, test from c where test in (select path from base)"""
)
def related_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.related_tests(base(spark, sf_dir).select("path"))


@query(f"with {FILES}, s as (select path, {STEM} stem from files), t as (select 'tests/test_' || stem || '.py' test, 'test_' || stem tstem from s) select distinct test, path source from t join s on contains(tstem, stem)")
def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests whose name holds a source's: no pairs are tried but those that share a part."""
    own = written(files(spark, sf_dir).select("path"), "paths")
    stem = P.stem(F.col("path"))
    tests = own.select(F.concat(F.lit("tests/test_"), stem, F.lit(".py")).alias("test"))
    return B.pair_tests(tests, own.select(F.col("path").alias("source")))
