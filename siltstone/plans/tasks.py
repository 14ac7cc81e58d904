"""Queries over task texts, with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import tasks as K
from siltstone.plans.files import TOKENS, distinct
from siltstone.plans.registry import query
from siltstone.sources.repository import FILES, TASKS, files, tasks


def words(values: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


STOP, GENERIC, AMBIGUOUS = words(K.STOP_WORDS), words(K.GENERIC_WORDS), words(K.AMBIGUOUS_WORDS)
_PART = "regexp_extract(task, '{}', {{}})".format(K.COMMIT.replace("{", "{{").replace("}", "}}"))
_MATCH = f"case when regexp_matches(task, '{K.COMMIT}') then concat_ws(' ', lower({_PART.format(1)}), array_to_string({TOKENS.format(_PART.format(2))}, ' '), {_PART.format(3)}) else task end"
#: task_id, task and its terms w.
WORDS = f"{TASKS}, words as (select task_id, task, list_filter(string_split_regex(lower({_MATCH}), '[^a-zA-Z0-9]+'), lambda t: length(t) >= 3 and not list_contains({STOP}, t)) w from tasks)"
_PAIRS = f"list_filter(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]), lambda p: not (list_contains({GENERIC}, p[1]) and list_contains({GENERIC}, p[2])))"
PHRASES = distinct(f"list_transform({_PAIRS}, lambda p: p[1] || ' ' || p[2])")
_QUOTED = " || ".join([f"regexp_extract_all(task, '{q}([^{q}]{{3,120}}){q}', 1)".replace("'''", "''''") for q in ("`", '"')] + ["regexp_extract_all(task, '''([^'']{3,120})''', 1)", f"regexp_extract_all(task, '{K.COMPOUND}')"])
_LITERAL = f"list_filter(list_transform({_QUOTED}, lambda x: list_filter({TOKENS.format('x')}, lambda t: length(t) >= 2 and not list_contains({STOP}, t))), lambda l: len(l) between 2 and 8 and not list_bool_and(list_transform(l, lambda t: list_contains({GENERIC}, t))))"
LITERALS = distinct(f"list_transform({_LITERAL}, lambda l: array_to_string(l, ' '))")
_GEN = f"list_filter(w, lambda t: list_contains({GENERIC}, t))"
_AMB = f"list_filter(w, lambda t: list_contains({AMBIGUOUS}, t))"
_CONCRETE = f"list_filter(w, lambda t: not list_contains({GENERIC}, t) and not list_contains({AMBIGUOUS}, t))"


@query(
    f"with {WORDS} select task_id, array_to_string(w, ' ') terms, array_to_string({PHRASES}, '|') phrases, array_to_string({LITERALS}, '|') literals,"
    f" round(coalesce(len({_GEN}) / nullif(len(w), 0), 0), 4)::double generic_share from words"
)
def task_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    task, w = F.col("task"), K.terms(F.col("task"))
    return tasks(spark, sf_dir).select(
        "task_id", F.array_join(w, " ").alias("terms"), F.array_join(K.phrases(w), "|").alias("phrases"), F.array_join(K.literal_phrases(task), "|").alias("literals"),
        F.round(K.generic_share(task), 4).alias("generic_share"),
    )


_VARIANTS = ", ".join(f"('{a}', '{b}')" for a, b in K.VARIANTS.items())
_KIN = ", ".join(f"('{a}', '{b}')" for a, all_ in K.CONCEPTS.items() for b in all_)
_LIT = f"case when list_contains({GENERIC}, {{0}}) then 0.25 when list_contains({AMBIGUOUS}, {{0}}) then 0.45 else 1.0 end"
_SINGULAR = (
    f"case when length(term) >= 5 and not list_contains({GENERIC}, term) then case when ends_with(term, 'ies') and length(term) > 5 then term[:-4] || 'y'"
    " when regexp_matches(term, '(sses|xes|ches|shes)$') and length(term) > 5 then term[:-3] when regexp_matches(term, 's$') and not regexp_matches(term, '(ss|us|is)$') then term[:-2] end end"
)
#: task_id, term and weight.
WEIGHTS = f"""{WORDS}, forms(term, form) as (values {_VARIANTS}), kin(term, kin) as (values {_KIN}),
own as (select task_id, term, {_LIT.format('term')} weight from (select distinct task_id, unnest(w) term from words)),
base as (select task_id, term, max(weight) weight from (select * from own union all
  select task_id, form, case when list_contains({GENERIC}, form) then 0.25 when list_contains({AMBIGUOUS}, form) then least(0.45, weight) else least(0.75, weight) end from own join forms using (term) union all
  select task_id, s, least(0.85, weight) from (select *, {_SINGULAR} s from own) where s is not null and not list_contains({STOP}, s)) group by 1, 2),
near as (select task_id, kin term from base join kin using (term) where not list_contains({GENERIC}, term)),
weights as (select task_id, term, max(weight)::double weight from (select * from base union all select task_id, term, 0.35 from near union all select task_id, form, 0.35 from near join forms using (term)) group by 1, 2)"""


@query(f"with {WEIGHTS} select * from weights")
def task_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.weights(tasks(spark, sf_dir), "task_id")


_HITS = "[" + ", ".join(f"list_filter({words(s.split())}, lambda x: contains(lower(task), x))" for _, s in K.CLASSES) + "]"
_BEST = "list_position(list_transform(h, lambda x: len(x)), list_max(list_transform(h, lambda x: len(x))))"


def _intents() -> str:
    has = lambda k: f"regexp_matches(x, '(^|[^a-z0-9_])({'|'.join(K.INTENTS[k])})($|[^a-z0-9_])')"
    return f"case when {has('audit')} then 'audit' " + " ".join(f"when {has(k)} then '{k}'" for k in ("review", "share", "repo_overview")) + " else 'coding_task' end"


def _count(signs: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower(task), '{s}')::int" for s in signs) + ")"


_SHORT = "(len(list_filter(string_split_regex(translate(lower(task), '/.', '  '), '\\s+'), lambda w: w <> '')) <= 8 and regexp_matches(lower(task), 'fix|update|rename|remove|add'))"
_MODE = "case " + " ".join(f"when {_count(s)} > 0{' or ' + _SHORT if m == 'small_direct_edit' else ''} then '{m}'" for m, s in K.MODES) + " else 'broad_feature' end"
_SURE = "case " + " ".join(f"when {_count(s)} > 0{' or ' + _SHORT if m == 'small_direct_edit' else ''} then {'0.68' if m == 'small_direct_edit' else f'case when {_count(s)} >= 3 then 0.92 when {_count(s)} = 2 then 0.82 else 0.68 end'}" for m, s in K.MODES) + " else 0.35 end"


@query(
    f"""with {TASKS}, t as (select *, {_HITS} h, trim(regexp_replace(translate(lower(task), '_-', '  '), '\\s+', ' ', 'g')) x from tasks)
select task_id, case when list_max(list_transform(h, lambda x: len(x))) > 0 then {words([k for k, _ in K.CLASSES])}[{_BEST}] else 'general' end kind,
  case when list_max(list_transform(h, lambda x: len(x))) > 0 then round(least(0.95::double, 0.45::double + list_max(list_transform(h, lambda x: len(x)))::double / list_sum(list_transform(h, lambda x: len(x))) * 0.45::double), 2) else 0.2::double end confidence,
  array_to_string(h[{_BEST}][:5], ' ') signals, {_intents()} intent, {_MODE} "mode", ({_SURE})::double mode_confidence from t"""
)
def task_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of work a task is, what it intends, and in which mode it is done."""
    task = F.col("task")
    c, (m, sure) = K.classes(task), K.mode(task)
    return tasks(spark, sf_dir).select("task_id", c["kind"].alias("kind"), c["confidence"].alias("confidence"), F.array_join(c["signals"], " ").alias("signals"), K.intent(task).alias("intent"), m.alias("mode"), sure.alias("mode_confidence"))


_N_WORDS = "len(regexp_extract_all(task, '[A-Za-z0-9_#./:-]+'))"
_LETTERS = "regexp_replace(task, '[^\\p{L}]', '', 'g')"
_RULES = (
    ("no_file", f"""not (contains(lower(task), '#file') or regexp_matches(task, '(^|\\s)[\\w./-]+\\.(py|ts|tsx|js|jsx|go|rs|java|rb|md|json|toml|ya?ml|css|scss)($|[\\s:,])')) and ({_MODE}) not in ('pr_review', 'runtime_debugging', 'integration_readiness')"""),
    ("vague", f"{_N_WORDS} <= 5 or trim(lower(task)) = 'can you fix these gaps'"),
    ("no_output_limit", f"{_N_WORDS} <= 35 and not regexp_matches(lower(task), 'concise|one[- ]line|no commentary|brief|max |bullets|json only|short')"),
    ("no_spec", f"not regexp_matches(lower(task), 'acceptance|criteria|requirements|constraints|validation|must|ensure|spec|plan:') and ({_MODE}) in ('broad_feature', 'runtime_debugging', 'integration_readiness', 'release_docs')"),
    ("question", f"{_N_WORDS} <= 14 and not regexp_matches(lower(task), 'fix|edit|change|implement|add |remove|update|release|run ') and regexp_matches(trim(lower(task)), '\\?$|^(what|why|how|can|should|is|does|do) ')"),
    ("frustrated", f"regexp_matches(task, '!!!|\\?\\?\\?') or (length({_LETTERS}) >= 10 and length(regexp_replace({_LETTERS}, '[^\\p{{Lu}}]', '', 'g')) >= 0.65 * length({_LETTERS}))"),
    ("drift", " + ".join(f"regexp_matches(lower(task), '{p}')::int" for p in ("review|pr ", "debug|log|runtime", "release|publish|changelog", "docs|readme", "feature|implement|build")) + " >= 3"),
)


@query(
    f"""with {WORDS} select task_id, concat_ws(' ', {', '.join(f"case when {c} then '{k}' end" for k, c in _RULES)}) warnings,
concat(case when list_has_any(w, {words('frontend page pages component components seo signup public'.split())}) then 'frontend page/component work only' when list_has_any(w, {words('backend api service services job jobs'.split())}) then 'backend service/route work only' else 'focus exact subsystem only' end, ': ',
  case when len({_CONCRETE}) > 0 then array_to_string({_CONCRETE}[:4], ' + ') else 'exact file, route, or failing symptom' end,
  case when list_has_any(w, {words('frontend page pages component components seo signup public'.split())}) then '; no backend service or analysis changes' when list_has_any(w, {words('backend api service services job jobs'.split())}) then '; no frontend page or component changes' else '' end,
  case when len({_GEN}) + len({_AMB}) > 0 then '; avoid vague terms like ' || array_to_string({_GEN}[:2] || {_AMB}[:2], ', ') else '' end) rewrite from words"""
)
def task_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prompt lacks, and a narrower wording."""
    task = F.col("task")
    return tasks(spark, sf_dir).select("task_id", F.array_join(K.prompt_warnings(task), " ").alias("warnings"), K.rewrite(task).alias("rewrite"))


_REFS = " || ".join(f"regexp_extract_all(y, '{p}', {int(k != 'github')})" for k, p in K.REFERENCE_KINDS)
_CLEAN = f"list_transform({_REFS}, lambda r: regexp_replace(trim(r), '[.,;:)\\]}}]+$', ''))"
_FIRST_REF = f"list_filter({_CLEAN}, lambda r, i: list_position(list_transform({_CLEAN}, lambda z: lower(z)), lower(r)) = i)"


@query(
    f"""with {TASKS}, t as (select task_id, regexp_replace(task, '[ \\n]', '  ', 'g') y from tasks), r as (select task_id, unnest({_FIRST_REF}) ref from t)
select lower(ref) ref, case when contains(lower(ref), '/pull/') then 'github_pr' when contains(lower(ref), '/issues/') or starts_with(ref, '#') or starts_with(lower(ref), 'gh-') then 'github_issue' when regexp_matches(ref, '^[A-Z][A-Z0-9]{{1,9}}-[0-9]+$') then 'jira_issue' else 'unknown' end kind, count(*) tasks, min(task_id) first_task from r group by all"""
)
def issue_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of all tasks, merged by their lower case."""
    found = tasks(spark, sf_dir).select("task_id", F.explode(K.issue_references(F.col("task"))).alias("ref"))
    return found.groupBy(F.lower("ref").alias("ref"), K.reference_kind(F.col("ref")).alias("kind")).agg(F.count("*").alias("tasks"), F.min("task_id").alias("first_task"))


@query(
    f"""with {TASKS}, l as (select task_id, unnest(regexp_extract_all(task, '{K.LOCATION.replace(chr(92) + 'n', chr(10))}')) x from tasks),
p as (select task_id, regexp_replace(regexp_extract(x, '^(.*):[0-9-]+$', 1), '^<(.*)>$', '\\1') path, try_cast(regexp_extract(x, ':([0-9]+)(-[0-9]+)?$', 1) as bigint) a, coalesce(try_cast(nullif(regexp_extract(x, '-([0-9]+)$', 1), '') as bigint), try_cast(regexp_extract(x, ':([0-9]+)$', 1) as bigint)) b from l)
select task_id, path, a "first", b "last" from p where a >= 1 and b >= a"""
)
def task_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tasks(spark, sf_dir).select("task_id", F.explode(K.locations(F.col("task"))).alias("x"))
    return found.select("task_id", "x.path", "x.first", "x.last")


_EPISODE = "list_distinct(list_filter(regexp_extract_all(lower(task), '[a-zA-Z][a-zA-Z0-9_]{2,}'), lambda t: not list_contains(['the', 'and', 'for', 'with', 'this', 'that', 'from', 'into'], t)))"
_SKILL = f"list_distinct(list_filter(list_transform(regexp_extract_all(translate(task, '_', '-'), '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda t: lower(t)), lambda t: not list_contains({STOP}, t)))"
_STEM = "case " + " ".join(f"when length(t) > {len(e) + 3} and ends_with(t, '{e}') then left(t, length(t) - {len(e)})" for e in ("ing", "ed", "es", "s")) + " else t end"
_CLAIM = f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(task), '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda t: not list_contains({words(K._CLAIM_STOP)}, t)), lambda t: {_STEM}))"
_RAW = "regexp_extract_all(translate(lower(task), '_', '-'), '[a-z][a-z0-9+.-]{1,}')"
_SORTED = "array_to_string(list_sort({}), ' ')"


@query(
    f"with {TASKS} select task_id, {_SORTED.format(_EPISODE)} episode, {_SORTED.format(_SKILL)} skill, {_SORTED.format(_CLAIM)} claim,"
    f" {_SORTED.format(f'{_RAW} || list_filter(flatten(list_transform({_RAW}, lambda t: string_split(t, chr(45)))), lambda p: length(p) > 1)')} domain from tasks"
)
def text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other four ways to take words from a text, each for its own comparison."""
    t, out = F.col("task"), lambda c: F.array_join(F.array_sort(c), " ")
    return tasks(spark, sf_dir).select("task_id", out(K.episode_terms(t)).alias("episode"), out(K.skill_terms(t)).alias("skill"), out(K.claim_terms(t)).alias("claim"), out(K.domain_words(t)).alias("domain"))


_CLEAN_ID = "regexp_replace(regexp_replace(trim(task), '[^A-Za-z0-9_.-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g')"
_VALUE = "trim(regexp_replace(task, '\\s+', ' ', 'g'))"
_MEANING = f"list_filter({TOKENS.format('stem')}, lambda t: length(t) >= 3 and not list_contains({words(K.IGNORED_NAMES)}, t))"
_HAS = "len(list_filter({}, lambda t: list_contains({}, t)))"


@query(f"with {TASKS} select task_id, substr(coalesce(nullif({_CLEAN_ID}, ''), 'thread'), 1, 80) safe_id, case when length({_VALUE}) <= 80 then {_VALUE} else rtrim(substr({_VALUE}, 1, 79)) || '...' end short from tasks")
def task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("task")
    return tasks(spark, sf_dir).select("task_id", K.safe_id(t).alias("safe_id"), K.short_value(t).alias("short"))


@query(
    f"""with {FILES}, s as (select path, regexp_replace(split_part(path, '/', -1), '^(.+)\\.[^.]+$', '\\1') stem from files), m as (select path, {_MEANING} m from s),
c as (select *, {_HAS.format('m', words(K.GENERIC_NAMES))} g, {_HAS.format('m', words(K.DOMAIN_NAMES))} d, {_HAS.format('m', words(K.ACTION_NAMES))} a from m)
select path, case when len(m) = 1 and g = 1 then 'generic' when d > 0 and (a > 0 or len(m) >= 2) then 'domain_revealing' when len(m) >= 2 and g = 0 then 'domain_revealing' when g > 0 and g = len(m) then 'generic' else 'neutral' end label from c"""
)
def name_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a file's name tells."""
    from siltstone.functions.paths import stem

    return files(spark, sf_dir).select("path", K.name_label(stem(F.col("path"))).alias("label"))
