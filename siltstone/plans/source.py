"""Queries over source-like texts, with DuckDB's SQL.  The sources are the documents, whose word pairs are written as definitions and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import source as C
from siltstone.functions.paths import path_tokens
from siltstone.operators import symbols as Y
from siltstone.operators.marks import marked
from siltstone.plans.files import PATH_TOKENS
from siltstone.plans.registry import QUERIES, query
from siltstone.sources.repository import FILES, files
from siltstone.sources.tables import table

_DEF = "\ndef {0}1_{0}2({0}2):\n  with open({0}1, \"w\") as f: logger.error(f)\n  except {0}1Error:\n"
_USE = "\nclass {0}2:\nimport {0}1, {0}2.y as z\nimport {0}2 from \"./{0}2\"\nfunc {0}2({0}1)\nuse {0}2::x;\nimport static {0}2.a.b;\nx = redis.get(os.getenv(\"{0}2\"))\nraise {0}2Error\nexport const {0}2 = ({0}1) => 1\n"


def _code(ref: str, flags: str, pair: str = "([A-Za-z]+) ([a-z]+)[.,]", joined: str = " (the|der|le|la|und|and) ([a-z]+) ") -> str:
    inner = f"regexp_replace(coalesce(text, ''), '{pair}', '{_DEF.format(ref)}'{flags})"
    return f"regexp_replace({inner}, '{joined}', '{_USE.format(ref)}'{flags})"


CODE = f"{FILES}, code as (select path, doc_id, {_code(chr(92), ', ' + chr(39) + 'g' + chr(39))} text from files)"


#: The same text as a column of Spark's SQL; words are tried from their first letter alone and not given back, which changes no match.
CODE_TEXT = _code("$", "", "(?<![A-Za-z])([A-Za-z]++) ([a-z]++)[.,]", " (the|der|le|la|und|and) ([a-z]++) ")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", "doc_id", F.expr(CODE_TEXT).alias("text"))


def _symbols(language: str, which: str) -> str:
    return " union all ".join(f"select path, line, regexp_extract(x, '{p}', 1) name, '{kind}' kind, '{language}' \"language\" from l where regexp_matches(x, '{p}') and {which}" for kind, p in C.SYMBOLS[language])


_LINES = f"{CODE}, l as (select path, doc_id, unnest(range(1, len(s) + 1)) line, unnest(s) x from (select path, doc_id, string_split(text, chr(10)) s from code))"
_LANGUAGES = ("python", "javascript", "go")


def _in_languages(rows: DataFrame) -> DataFrame:
    return rows.withColumn("language", F.get(F.array(*map(F.lit, _LANGUAGES)), (F.col("doc_id") % 3).cast("int")))


@query(f"with {_LINES}, r as ({' union all '.join(_symbols(n, f'doc_id % 3 = {i}') for i, n in enumerate(_LANGUAGES))}) select path, line::int line, name, kind, \"language\" from r")
def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by the lines of each file, in one of three languages."""
    return Y.line_symbols(_in_languages(code(spark, sf_dir)))


_IMPORT_LANGUAGES = ("python", "javascript", "go", "rust", "java", "kotlin")


def _imports(language: str, which: str) -> str:
    name = "unnest(flatten(list_transform(regexp_extract_all(x, '{0}', 1), lambda m: list_transform(string_split(m, ','), lambda q: regexp_extract(q, '[A-Za-z0-9_.]+', 0)))))" if language == "python" else "unnest(regexp_extract_all(x, '{0}', 1))"
    return " union ".join(f"select distinct path, {name.format(p.replace(chr(39), chr(39) * 2))} name, '{language}' \"language\" from l where {which}" for p in C.IMPORTS[language])


@query(f"with {_LINES}, r as ({' union all '.join(f'select * from ({_imports(n, f'doc_id % 6 = {i}')})' for i, n in enumerate(_IMPORT_LANGUAGES))}) select \"language\", name, count(*) files from r where name <> '' group by 1, 2")
def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is imported, in how many files of a language."""
    rows = code(spark, sf_dir)
    out = None
    for i, n in enumerate(_IMPORT_LANGUAGES):
        part = C.imports(rows.filter(F.col("doc_id") % 6 == i), n).withColumn("language", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("language", "name").agg(F.count("*").alias("files"))


def _named(text: str, cases: tuple[tuple[str, str], ...]) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}') then '{label}' end" for label, p in cases) + "], lambda z: z is not null)"


_ENV = " || ".join(f"regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in C.ENV_READS)
_SYS = _named("lower(text)", C.SYSTEMS)
_EFFECTS = (
    f"list_filter([case when len({_ENV}) > 0 then 'reads environment/config' end, " + ", ".join(f"case when regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') then '{label}' end" for label, p in (("possible filesystem read", C.READS), ("possible filesystem write", C.WRITES)))
    + ", " + ", ".join(f"case when list_has_any({_SYS}, [{', '.join(repr(n) for n in names)}]) then '{label}' end" for label, names in C.SYSTEM_EFFECTS) + f"], lambda z: z is not null) || {_named('lower(text)', C.OWN_EFFECTS)}"
)
_JOIN = "array_to_string({}, ';')"


@query(
    f"with {CODE} select path, len(list_distinct({_ENV}))::int env_names, {_JOIN.format(_SYS)} systems, {_JOIN.format(_EFFECTS)} effects, {_JOIN.format(_named('text', C.HINTS))} hints, {_JOIN.format(_named('lower(text)', C.CONCEPTS))} concepts,"
    f" coalesce({_named('lower(text)', C.FAILURES)}[1], 'unknown') failure from code"
)
def source_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file reads, touches and does, and how it fails."""
    out = lambda c: F.array_join(c, ";")
    rows = code(spark, sf_dir).select("path", "text", F.lower("text").alias("low"))
    found = marked(rows, {"systems": ("low", C.SYSTEMS), "access": ("text", C.ACCESS), "own": ("low", C.OWN_EFFECTS), "hints": ("text", C.HINTS), "concepts": ("low", C.CONCEPTS), "failures": ("low", C.FAILURES)}, ("text", "low"), {"env": ("text", C.ENV_READS)})
    effects = F.concat(C.env_effect(F.size("env") > 0), "access", C.system_effects(F.col("systems")), "own")
    return found.select("path", F.size("env").alias("env_names"), out("systems").alias("systems"), out(effects).alias("effects"), out("hints").alias("hints"), out("concepts").alias("concepts"), F.coalesce(F.get("failures", F.lit(0)), F.lit("unknown")).alias("failure"))


_SPLIT = "string_split(text, chr(10))"
_VIEW = "case when len(list_filter({0}, lambda x: regexp_matches(x, '{1}'))) > 0 then array_to_string(list_filter({0}, lambda x: regexp_matches(x, '{1}')), chr(10)) else substr(text, 1, 4000) end"


@query(
    f"""with {CODE} select path, greatest(1, (length(text) * 3) // 4)::bigint byte_tokens, (length(substr(text, 1, 200)) - length(replace(substr(text, 1, 200), chr(10), '')) + 1)::int line_200, sha256(case when greatest(1, length(text) // 4) <= 50 then text else substr(text, 1, 200) || chr(10) || '... truncated ...' end) cut,
sha256(array_to_string(case when len({_SPLIT}) <= 12 then {_SPLIT} else {_SPLIT}[:6] || ['... ' || (len({_SPLIT}) - 12) || ' line(s) omitted ...'] || {_SPLIT}[-6:] end, chr(10))) edges,
sha256({_VIEW.format(_SPLIT, C.VIEWS['skeleton'])}) skeleton, sha256({_VIEW.format(_SPLIT, C.VIEWS['symbols'])}) symbols, sha256(array_to_string(list_filter(list_transform({_SPLIT}, lambda x: trim(x)), lambda x: x <> '')[:40], chr(10))) summary,
greatest(1, (select count(*) from (select sum(greatest(1, length(y) // 4)) over (order by i) t from (select unnest({_SPLIT}) y, unnest(range(len({_SPLIT}))) i)) where t <= 100))::int fitting, left(sha256(path || '|' || text), 16) key from code"""
)
def text_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to a budget, by their edges and by their interface."""
    t, lines, sha = F.col("text"), F.split("text", "\n"), lambda c: F.sha2(c, 256)
    return code(spark, sf_dir).select(
        "path", C.bytes_tokens(F.length(t) * 3).alias("byte_tokens"), C.line_of(t, F.lit(200)).alias("line_200"), sha(C.cut(t, 50)).alias("cut"), sha(F.array_join(C.edges(lines, 12), "\n")).alias("edges"), sha(C.view(t, "skeleton")).alias("skeleton"),
        sha(C.view(t, "symbols")).alias("symbols"), sha(C.view(t, "summary")).alias("summary"), C.fitting_lines(lines, 100).alias("fitting"), F.left(sha(F.concat_ws("|", "path", "text")), F.lit(16)).alias("key"),
    )


_STATUS = "case o_orderkey % 4 when 0 then 'main' when 1 then 'main...origin/main [ahead ' || (o_custkey % 7) || ', behind ' || (o_custkey % 3) || ']' when 2 then 'topic...origin/topic' else 'HEAD (no branch)' end"


@query(
    f"""with s as (select o_orderkey k, {_STATUS} line, o_custkey c, o_orderstatus st from orders), p as (select *, contains(line, '...') t, coalesce(nullif(regexp_extract(line, '\\[.*ahead ([0-9]+)', 1), '')::bigint, 0) ahead, coalesce(nullif(regexp_extract(line, '\\[.*behind ([0-9]+)', 1), '')::bigint, 0) behind from s),
q as (select *, case when t then split_part(line, '...', 1) when line <> 'HEAD (no branch)' then line end branch, case when t then regexp_extract(line, '\\.\\.\\.([^ ]*)', 1) end upstream from p)
select branch, upstream, case when c % 5 = 0 then 'in_progress' when ahead > 0 then 'committed_not_pushed' when st <> 'P' then 'committed' else 'unknown' end state, case substr(st, 1, 1) when 'A' then 'added' when 'M' then 'modified' when 'D' then 'deleted' when 'R' then 'renamed' when 'C' then 'copied' else 'changed' end kind,
 count(*) n, sum(ahead)::bigint ahead, sum(behind)::bigint behind from q group by 1, 2, 3, 4"""
)
def branch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status lines (one for each order) by branch and state of the work."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = F.when(k % 4 == 0, "main").when(k % 4 == 1, F.concat(F.lit("main...origin/main [ahead "), (c % 7).cast("string"), F.lit(", behind "), (c % 3).cast("string"), F.lit("]"))).when(k % 4 == 2, "topic...origin/topic").otherwise("HEAD (no branch)")
    rows = table(spark, sf_dir, "orders").select(C.branch_status(line).alias("b"), c.alias("c"), F.col("o_orderstatus").alias("st"))
    dirty, none = F.when(F.col("c") % 5 == 0, 1).otherwise(0), F.lit(0)
    state = C.execution_status(dirty, none, none, F.col("b.ahead"), F.when(F.col("st") != "P", "sha"))
    return rows.groupBy(F.col("b.branch").alias("branch"), F.col("b.upstream").alias("upstream"), state.alias("state"), C.change_kind(F.col("st")).alias("kind")).agg(F.count("*").alias("n"), F.sum("b.ahead").alias("ahead"), F.sum("b.behind").alias("behind"))


@query(
    f"""with {FILES}, c as (select path, unnest({PATH_TOKENS}) t from files), d as (select t, count(*) n from c group by 1)
select t topic, n, row_number() over (order by n desc, t) place from d where length(t) >= 3 and not regexp_matches(t, '^[0-9]+$') order by n desc, t limit 25"""
)
def path_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest words of all paths: an overview, so the first twenty-five."""
    words = files(spark, sf_dir).select(F.explode(path_tokens(F.col("path"))).alias("topic")).filter("length(topic) >= 3 and not topic rlike '^[0-9]+$'")
    top = words.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(25)
    return top.select("topic", "n", F.expr("row_number() over (order by n desc, topic)").cast("long").alias("place"))


_CALL = Y.CALL.replace(chr(39), chr(39) * 2)


@query(
    f"""with {_LINES}, s as (select distinct name, path from ({' union all '.join(_symbols(n, f'doc_id % 3 = {i}') for i, n in enumerate(_LANGUAGES))})), c as (select distinct path, split_part(name, '.', -1) base from (select path, unnest(regexp_extract_all(text, '{_CALL}', 1)) name from code) where split_part(name, '.', 1) not in ({', '.join(repr(n) for n in Y.NO_CALLS)})),
d as (select name, count(*) definitions from s group by 1), u as (select base name, count(*) callers from c group by 1), own as (select name, count(*) n from s join c on c.path = s.path and c.base = s.name group by 1)
select name, definitions, callers, definitions * callers - coalesce(n, 0) pairs from d join u using (name) left join own using (name)"""
)
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that are called: files that define them, files that call them, and pairs of a caller and another file that defines; counts by name, so no hot name is paired."""
    each = Y.names(_in_languages(code(spark, sf_dir))).groupBy("path", "name").agg(F.max("defined").alias("d"), F.max("called").alias("c"))
    count = lambda flag: F.count(F.when(flag, 1))
    met = each.groupBy("name").agg(count(F.col("d")).alias("definitions"), count(F.col("c")).alias("callers"), count(F.col("d") & F.col("c") & F.col("path").isNotNull()).alias("own"))
    return met.filter("definitions > 0 and callers > 0").select("name", "definitions", "callers", (F.col("definitions") * F.col("callers") - F.col("own")).alias("pairs"))


def symbol_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, end, owner and the size of the body of each symbol; no SQL follows braces and indentation, so tests hold it against a parser."""
    return Y.extents(_in_languages(code(spark, sf_dir)), bodies=True).withColumn("body", F.sha2("body", 256))


QUERIES["symbol_extents"] = symbol_extents
