"""Queries over paths and the scan of a repository, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.operators import snapshots as N
from siltstone.plans.registry import query
from siltstone.sources.repository import FILES, files

#: SQL of the same parts that functions.paths gives as columns.
NAME = "split_part(path, '/', -1)"
STEM = f"regexp_replace({NAME}, '^(.+)\\.[^.]+$', '\\1')"
SUFFIX = f"regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1)"
SPLIT = "string_split(path, '/')"
TOKENS = "list_filter(string_split_regex(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-zA-Z0-9]+'), lambda t: t <> '')"
def distinct(values: str) -> str:
    """First occurrences, in order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


PATH_TOKENS = distinct(TOKENS.format("regexp_replace(path, '([^/])\\.[^./]+$', '\\1')"))
NOISE = "[" + ", ".join(f"'{w}'" for w in P.NOISE_WORDS) + "]"
DOMAIN = f"list_filter({PATH_TOKENS}, lambda t: length(t) >= 3 and not list_contains({NOISE}, t))"


def is_kind(kind: str) -> str:
    return f"regexp_matches(path, '{P.KINDS[kind]}')"


SOURCE = f"(not ({is_kind('test_path')} or {is_kind('docs_path')} or {is_kind('example_path')} or {is_kind('lock_or_generated')}) and {is_kind('code')} and {is_kind('source_place')})"
RELEASE = f"({is_kind('release_name')} and not {is_kind('release_excluded')})"


def first_of(cases: tuple[tuple[str, str], ...], other: str) -> str:
    return "case " + " ".join(f"when regexp_matches(path, '{p}') then '{label}'" for label, p in cases) + f" else '{other}' end"


def leading(roots: str) -> str:
    return f"case when regexp_matches({SPLIT}[1], '^({roots})$') and len({SPLIT}) > 1 then {SPLIT}[1] || '/' || {SPLIT}[2] end"


BALANCE = f"coalesce({leading('packages|playground')}, {leading('src|lib|app|apps')})"
DEEP = "regexp_extract(path, '^(.+)/[^/]+$', 1)"
SCOPE = (
    f"coalesce({leading('playground|integration')}, case when {SOURCE} and len({SPLIT}) >= 5 and {SPLIT}[1] = 'packages' and {SPLIT}[3] = 'src' then {DEEP} end,"
    f" case when {is_kind('test_path')} and len({SPLIT}) >= 3 then {DEEP} end, {BALANCE})"
)

FAMILY = first_of(P.FAMILIES, "other")


@query(
    f"with {FILES} select path, " + ", ".join(f"{is_kind(k)} {k}" for k in P.KINDS)
    + f", {SOURCE} source_path, ({SOURCE} or {is_kind('code_place')}) and {is_kind('code')} source_like, {RELEASE} release_metadata,"
    f" case when {is_kind('release_primary')} then 70.0::double else 0 end release_bonus, case when lower({NAME}) = 'gradle.properties' then 35.0::double else 90 end build_bonus,"
    f" {FAMILY} family, {first_of(P.CATEGORIES, 'file')} category from files"
)
def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of file each path names."""
    path = F.col("path")
    more = {
        "source_path": P.source_path(path), "source_like": P.source_like(path), "release_metadata": P.release_metadata(path), "release_bonus": P.release_bonus(path),
        "build_bonus": P.build_bonus(path), "family": P.family(path), "category": P.category(path),
    }
    return files(spark, sf_dir).select("path", *[P.is_kind(path, k).alias(k) for k in P.KINDS], *[c.alias(k) for k, c in more.items()])


@query(
    f"with {FILES} select path, {NAME} name, {STEM} stem, {SUFFIX} suffix, array_to_string({PATH_TOKENS}, ' ') tokens, array_to_string({DOMAIN}, ' ') domain,"
    f" coalesce({leading('src|tests|docs|apps|packages|services|libs')}, {SPLIT}[1]) module, coalesce({leading('src|app|lib|tests|test')}, {SPLIT}[1]) \"group\","
    f" {leading('packages')} package, {BALANCE} balance_scope, {SCOPE} scope from files"
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, tokens, modules and scopes of paths."""
    path = F.col("path")
    return files(spark, sf_dir).select(
        "path", P.name(path).alias("name"), P.stem(path).alias("stem"), P.suffix(path).alias("suffix"), F.array_join(P.path_tokens(path), " ").alias("tokens"),
        F.array_join(P.domain_tokens(path), " ").alias("domain"), P.module(path).alias("module"), P.group(path).alias("group"), P.package_root(path).alias("package"),
        P.balance_scope(path).alias("balance_scope"), P.replacement_scope(path).alias("scope"),
    )


_AFTER = "regexp_replace(regexp_extract(lower(path), '(?:^|/)api/(.+)$', 1), '(^|/)(routes?|urls|views|controller)(\\.[^./]+)?$', '')"
_API_PARTS = f"list_filter(list_transform(string_split({_AFTER}, '/'), lambda p: regexp_replace(p, '^[\\[\\](){{}}]+|[\\[\\](){{}}]+$', '', 'g')), lambda p: p <> '' and not starts_with(p, '_'))"
_API_TERMS = distinct(f"list_filter(flatten(list_transform({_API_PARTS}, lambda p: {TOKENS.format('p')})), lambda t: not list_contains({NOISE}, t))")
API_KEY = f"case when len({_API_TERMS}) > 0 then '/api/' || array_to_string({_API_TERMS}, '/') end"


@query(
    f"""with {FILES}, k as (select path, {API_KEY} owner from files where contains(path, 'api/')), u as (select *, regexp_extract('fetch(/' || path || '?page=1)', '/api/[A-Za-z0-9_./${{}}\\[\\]-]+', 0) raw from k)
select path, owner, regexp_replace(regexp_replace(raw, '/\\[[^\\]]+\\]', '', 'g'), '[/,;)]+$', '') called from u"""
)
def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API path that a file owns by its place, and the one that a call of it names."""
    path = F.col("path")
    rows = files(spark, sf_dir).filter(path.contains("api/"))
    return rows.select("path", P.api_key(path).alias("owner"), P.url_api_key(F.concat(F.lit("fetch(/"), path, F.lit("?page=1)"))).alias("called"))


#: Rules of an ignore file and shell patterns (parameters of the queries).
RULES = ["# generated", "dist/", "*.lock", "docs/**", "!docs/adr/", "vendor/", "/config/*.json", "test_*"]
INCLUDE, EXCLUDE = ["src/*", "packages/*", "*/[a-f]*.go"], ["*.json", "*_test.?s"]


@query(
    f"""with {FILES}, h as (select path, greatest({", ".join(f"case when regexp_matches(path, '{P.ignore_regex(r.removeprefix('!'))}') then {2 * i + (not r.startswith('!'))} else 0 end" for i, r in enumerate(RULES) if not r.startswith('#'))}) last from files)
select path, last % 2 = 1 ignored, not {is_kind("vendored")} and ({" or ".join(f"path glob '{g}'" for g in INCLUDE)}) and not ({" or ".join(f"path glob '{g}'" for g in EXCLUDE)}) allowed from h"""
)
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths an ignore file leaves out, and which a list of shell patterns lets in."""
    path = F.col("path")
    return files(spark, sf_dir).select("path", P.ignored(path, RULES).alias("ignored"), P.allowed(path, INCLUDE, EXCLUDE).alias("allowed"))


@query(f"with {FILES} select {FAMILY} family, count(*) n, sum(tokens)::bigint tokens from files group by 1")
def family_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy(P.family(F.col("path")).alias("family")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


# the former state: every fifth text longer, every seventh not there yet, every thirteenth since gone
_OLD = "(select path, case when doc_id % 5 = 0 then sha256(text || '!') else hash end hash, tokens + 1 tokens from files where doc_id % 7 <> 0 union all select 'gone/' || doc_id, hash, tokens from files where doc_id % 13 = 0)"


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    now = files(spark, sf_dir)
    before = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("hash"))
    old = now.filter("doc_id % 7 != 0").select("path", before.alias("hash"), (F.col("tokens") + 1).alias("tokens"))
    gone = now.filter("doc_id % 13 = 0").select(F.concat(F.lit("gone/"), "doc_id").alias("path"), "hash", "tokens")
    return old.unionByName(gone), now


@query(
    f"""with {FILES}, o as {_OLD}, c as (select path from files where doc_id % 3 = 0 union select 'gone/' || doc_id from files where doc_id % 13 = 0 union select 'docs/adr'),
again as (select f.path, f.hash, case when o.hash = f.hash then o.tokens else f.tokens end tokens, o.hash is not distinct from f.hash kept from files f left join o using (path)
  where f.path in (from c) or exists (select 1 from c where starts_with(f.path, c.path || '/')))
select path, hash, tokens, true reused from o where path not in (from c) and path not in (select path from again)
union all select path, hash, tokens, kept from again"""
)
def scan_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incremental scan: rows of the former state but for changed paths and what lies below them, which are read anew."""
    old, now = _states(spark, sf_dir)
    changed = now.filter("doc_id % 3 = 0").select("path").unionByName(old.filter(F.col("path").startswith("gone/")).select("path"))
    changed = changed.unionByName(spark.createDataFrame([("docs/adr",)], "path string"))
    return N.incremental(old, now.select("path", "hash", "tokens"), changed)


@query(
    f"""with {FILES}, o as {_OLD}, m as (select list(path || ':' || hash order by path) l from (select path, hash from files)), n as (select list(path || ':' || hash order by path) l from o)
select 'now' state, sha256(array_to_string(l, '')) root from m union all select 'before', sha256(array_to_string(l, '')) from n"""
)
def root_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of each state."""
    old, now = _states(spark, sf_dir)
    return N.root_hash(now.select(F.lit("now").alias("state"), "path", "hash").unionByName(old.select(F.lit("before").alias("state"), "path", "hash")), "state")


@query(
    f"""with {FILES}, o as {_OLD}, s as (select coalesce(f.path, o.path) path from files f full join o using (path) where f.hash is distinct from o.hash),
g as (select path from files where doc_id % 17 = 0 union select 'outside/' || doc_id from files where doc_id % 17 = 0)
select path, bool_or(k = 's') by_snapshot, bool_or(k = 'g') by_log, path not in (select path from files) deleted from (select path, 's' k from s union all select path, 'g' from g where path in (select path from files)) group by path"""
)
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed paths: by comparing states, or named by a log and still there."""
    old, now = _states(spark, sf_dir)
    logged = now.filter("doc_id % 17 = 0")
    logged = logged.select("path").unionByName(logged.select(F.concat(F.lit("outside/"), "doc_id").alias("path")))
    return N.change_set(old, now, logged)


@query(
    f"""with {FILES}, c as (select distinct sha256(concat_ws('|', path, hash, 'offline', '2')) key from files where doc_id % 4 <> 0)
select count(*) files, count(*) filter (k.key is not null) hits, count(*) filter (k.key is null) misses from files left join c k on k.key = sha256(concat_ws('|', path, hash, 'offline', '2'))"""
)
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features of files are found in a cache that is keyed by what they were made of."""
    now = files(spark, sf_dir)
    cache = now.filter("doc_id % 4 != 0").select(N.cache_key(F.col("path"), F.col("hash")).alias("key"))
    found = N.probe(now, cache)
    hit = F.sum(F.col("cached").cast("long"))
    return found.agg(F.count("*").alias("files"), hit.alias("hits"), (F.count("*") - hit).alias("misses"))


@query(
    f"""with {FILES}, c as (select *, sha256(concat_ws('|', path, case when doc_id % 4 = 0 then 'old' else hash end, 'offline', '2')) key, length(text) - length(replace(text, chr(10), '')) + 1 lines from files where doc_id % 5 <> 0),
k as (select path, sha256(concat_ws('|', path, hash, 'offline', '2')) key, tokens, length(text) - length(replace(text, chr(10), '')) + 1 lines from files)
select k.path, k.tokens, k.lines::bigint lines, not exists (select 1 from c where c.key = k.key) made from k"""
)
def cache_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of files over a cache of four fifths of them, a fourth of which have changed: the rest alone is made."""
    now = files(spark, sf_dir)
    lines = F.size(F.split("text", "\n")).cast("long").alias("lines")
    make = lambda df: df.select("path", "tokens", lines)
    old = now.filter("doc_id % 5 != 0").withColumn("hash", F.when(F.col("doc_id") % 4 == 0, "old").otherwise(F.col("hash")))
    cache, _ = N.refreshed(old, spark.createDataFrame([], "path string, tokens long, lines long, key string"), make)
    features, made = N.refreshed(now, cache, make)
    return features.join(made.select("path", F.lit(True).alias("made")), "path", "left").select("path", "tokens", "lines", F.coalesce("made", F.lit(False)).alias("made"))
