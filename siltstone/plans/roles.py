"""Queries over roles and domains of files, with DuckDB's SQL: the rules are a table there, joined and summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import roles as O
from siltstone.functions.source import SYMBOLS
from siltstone.operators.roles import IMPORTS, assigned
from siltstone.plans.files import STEM, TOKENS
from siltstone.plans.registry import query
from siltstone.plans.source import _JOIN, _SYS, CODE, code

#: Ends that make entry points of texts, by the number of a document (fixed values of the mapping).
ENDS = (
    "", '@app.get("/users")~def users(): pass', "@shared_task~def send_mail(x): pass", '@cli.command("run-all")~def run_all(): pass', "@click.command~@click.option~def build_it(): pass", "class UserView(APIView): pass",
    'url = path("login/", views.login)~OTP_verify = getSessionToken', 'router.post("/webhook/stripe", handler)', "export default function LoginForm() {}~const Signin = (props) => 1", "from jose import jwt~rank_score = summarize(settings)", "class Command(BaseCommand): pass",
    '@api.router.delete(~)~def gone(): webhook', "import passport from 'passport'~app.ALL('/otp/verify', check)",
)
#: Places that some paths get before the rest (fixed values of the mapping).
STARTS = ("", "", "app/api/", "pages/", "auth/session/", "billing/", "core/repo_map_", "shop/management/commands/", "mailer/", "cache/", "jobs/")

_END = f"replace(split_part('{'|'.join(ENDS).replace(chr(39), chr(39) * 2)}', '|', cast(doc_id % {len(ENDS)} as int) + 1), '~', chr(10))"
_START = f"split_part('{'|'.join(STARTS)}', '|', cast(doc_id % {len(STARTS)} as int) + 1)"
_LANGUAGES = ("python", "javascript", "go")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _each(which: str, options: dict[str, str]) -> str:
    return f"case {which} " + " ".join(f"when '{k}' then {v}" for k, v in options.items()) + " end"


_SYMBOLS = {n: f"list_filter(flatten(list_transform(string_split(text, chr(10)), lambda x: [{', '.join(f'case when regexp_matches(x, {_quoted(p)}) then {{name: regexp_extract(x, {_quoted(p)}, 1), kind: {_quoted(k)}}} end' for k, p in SYMBOLS[n])}])), lambda z: z is not null)" for n in _LANGUAGES}


def _label(kind: str, first: str, second: str) -> str:
    one, two = f"regexp_extract(m, {_quoted(first)}, 1)", f"nullif(regexp_extract(m, {_quoted(second)}, 1), '')" if second else "null"
    if kind == "route":
        return f"upper({one}) || ' ' || coalesce({two}, '<dynamic route>')"
    if kind == "Django URL":
        return f"'Django URL: ' || {one} || coalesce(' -> ' || {two}, '')"
    return f"'{kind}: ' || " + (f"coalesce({two}, replace({one}, '_', '-'))" if kind == "CLI command" else one)


def _entries(language: str) -> str:
    parts = [f"list_transform(regexp_extract_all(text, {_quoted(p)}, 0), lambda m: {_label(kind, a, b)})" for kind, p, a, b in O.ENTRIES[language]]
    if language == "python":
        parts.append(f"case when contains(path, '/management/commands/') and regexp_matches(text, '\\bclass[ \\t]+Command\\b') then ['Django management command: ' || {STEM}] else [] end")
    else:
        parts += [f"case when regexp_matches(path, {_quoted(p)}) then ['{kind}: ' || path] else [] end" for kind, p in O.PLACES]
    return " || ".join(parts)


_ENTRIES = {n: _entries(n) for n in O.ENTRIES} | {"go": "[]::varchar[]"}
_IMPORTS = {n: f"regexp_extract_all(text, {_quoted(p)}, 1)" for n, p in IMPORTS.items()} | {"go": "[]::varchar[]"}


_WORDS = "list_sort(list_distinct(" + TOKENS.format("{0}") + "))"
_RULES = ", ".join(
    f"({i}, '{r.axis}', {_quoted(r.label)}, {r.points}::double, {_quoted(r.reason)}, {c}, {g}, {_list(group)}, {_list(r.without) if r.without else '[]::varchar[]'})"
    for i, r in enumerate(O.RULES) for c, case in enumerate(r.cases) for g, group in enumerate(case)
)
_HEAD = "case when regexp_matches(e, '^(?:GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|ALL) ') then 'entry:route' else 'entry:' || split_part(e, ':', 1) end"


def _marked(kind: str, tokens: str) -> str:
    return f"list_transform(list_intersect({tokens}, {_list(O.wanted(kind))}), lambda t: '{kind}:' || t)"


_PT, _ST, _IT, _ET, _TT = TOKENS.format("path"), TOKENS.format("array_to_string(names, ' ')"), TOKENS.format("array_to_string(imports, ' ')"), TOKENS.format("array_to_string(entries, ' ')"), TOKENS.format("text")


@query(
    f"""with {CODE}, s as (select {_START} || path path, doc_id, concat_ws(chr(10), text, {_END}) text, {_list(_LANGUAGES)}[doc_id % 3 + 1] lang from code),
a as (select path, text, {_each('lang', _SYMBOLS)} symbols, {_each('lang', _ENTRIES)} e0, {_each('lang', _IMPORTS)} imports, {_SYS} systems from s),
b as (select *, list_transform(symbols, lambda z: z.name) names, list_filter(e0, lambda x, i: list_position(e0, x) = i) entries from a),
g as (select *, {_marked('path', _PT)} || {_marked('symbol', _ST)} || {_marked('import', _IT)} || {_marked('any', f'({_PT} || {_ST} || {_IT} || {_ET} || {_TT})')}
  || list_transform(systems, lambda x: 'system:' || x) || list_transform(entries, lambda e: {_HEAD}) || case when len(entries) > 0 then ['entry:some'] else [] end || case when regexp_matches(path, '\\.(tsx|jsx)$') then ['file:jsx'] else [] end
  || case when contains(replace(path, '/', '_'), 'repo_map') then ['file:repo-map'] else [] end g0 from b),
h as (select *, case when list_has_all(g0, ['any:otp', 'any:verify']) then g0 || ['both:otp-verify'] else g0 end signals from g),
rules(id, axis, label, points, reason, kase, grp, wanted, barred) as (values {_RULES}),
v as (select distinct path, id, axis, label, points, reason from (select path, id, axis, label, points, reason, kase, bool_and(list_has_any(signals, wanted) and not list_has_any(signals, barred)) ok from h, rules group by all) where ok),
t as (select path, axis, label, sum(points) points from v group by all), w as (select path, axis, (list(label order by points desc, label))[1] label from t group by all),
d0 as (select h.*, x.label domain, y.label voted from h left join w x on x.path = h.path and x.axis = 'domain' left join w y on y.path = h.path and y.axis = 'role'),
d as (select *, coalesce(voted, case when len(entries) > 0 then 'entrypoint' when len(list_filter(symbols, lambda z: z.kind = 'class')) > 0 then translate({STEM}, '_-', '  ') || ' classes' when len(list_filter(symbols, lambda z: z.kind = 'function')) > 0 then translate({STEM}, '_-', '  ') || ' functions' else translate({STEM}, '_-', '  ') end) "role" from d0),
k as (select *, flatten(list_transform([coalesce(domain, ''), "role", array_to_string(entries, ' '), array_to_string(systems, ' ')] || names[:20], lambda q: {_WORDS.format('q')})) k0 from d)
select path, domain, "role", coalesce((select string_agg(reason, ';' order by id) from v where v.path = k.path), '') reasons, {_JOIN.format('entries')} entries,
array_to_string(list_filter(list_filter(k0, lambda x, i: list_position(k0, x) = i), lambda x: length(x) >= 3 and not list_contains({_list(O.NOISE)}, x))[:30], ' ') words from k"""
)
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, role, their reasons, entry points and words of each file, in one of three languages."""
    text = F.concat_ws("\n", "text", F.expr(_END.replace("chr(10)", "'\\n'")))
    rows = code(spark, sf_dir).select(F.concat(F.expr(_START), "path").alias("path"), text.alias("text"), "doc_id")
    parts = [assigned(rows.filter(F.col("doc_id") % 3 == i), language) for i, language in enumerate(_LANGUAGES)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("path", "domain", "role", F.array_join("votes.reason", ";").alias("reasons"), F.array_join("entries", ";").alias("entries"), F.array_join("words", " ").alias("words"))
