"""What a file is for: its entry points, its domain and its role, by a table of weighted votes.

A file's signals are strings such as "path:auth" or "entry:route".  A rule votes for a label where its condition
on signals holds; the label with the most points wins, the first by name among equals.  All of it are columns of one
row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions.source import SYMBOLS
from siltstone.functions.text import ordered_tokens

_METHODS = "get|post|put|patch|delete|options|head|all"
#: Entry points by language: what they are, the pattern of the text that shows one, and a second pattern within it (or none)
#: for the name.  Kind "route" has a method and a place, all others one name (fixed values).
ENTRIES = {
    "python": (
        ("route", rf"@(?:\w+\.)*(?:app|router)\.(?:{_METHODS})\(\s*(?:['\"][^'\"]*['\"])?", rf"\.({_METHODS})\(", r"['\"]([^'\"]*)"),
        ("Celery task", r"@(?:shared_task|[\w.]+\.task)\b[^\n]*\n(?:[ \t]*@[^\n]*\n)*[ \t]*(?:async[ \t]+)?def[ \t]+\w+", r"def[ \t]+(\w+)$", ""),
        ("CLI command", r"@[\w.]+\.command\b[^\n]*\n(?:[ \t]*@[^\n]*\n)*[ \t]*(?:async[ \t]+)?def[ \t]+\w+", r"def[ \t]+(\w+)$", r"\.command\(\s*(?:name\s*=\s*)?['\"]([^'\"]+)"),
        ("Django view", r"\bclass[ \t]+\w+\([^)\n]*View(?:Set)?[ \t]*[,)]", r"class[ \t]+(\w+)", ""),
        ("Django URL", r"(?:^|[^\w.])(?:django\.urls\.)?(?:re_)?path\(\s*r?['\"][^'\"]*['\"](?:\s*,\s*[\w.]+)?", r"['\"]([^'\"]*)['\"]", r",\s*([\w.]+)$"),
    ),
    "javascript": (
        ("route", rf"\b(?:router|app)\.(?i:{_METHODS})\s*\(\s*['\"][^'\"]+['\"]", rf"\.(?i:({_METHODS}))\s*\(", r"['\"]([^'\"]+)"),
        ("React component", r"\bfunction\s+[A-Z][A-Za-z0-9_]*\s*\(|\bconst\s+[A-Z][A-Za-z0-9_]*\s*=\s*(?:\([^)]*\)|\w+)\s*=>", r"^(?:function|const)\s+(\w+)", ""),
    ),
}
#: Entry points that the path alone shows, of JavaScript (fixed values).
PLACES = (
    ("Next API route", r"(^|/)app/api/.*/route\.(ts|tsx|js|jsx)$|(^|/)pages/api/.*\.(ts|tsx|js|jsx)$"),
    ("React page", r"(^|/)app/.*/page\.(tsx|jsx|ts|js)$|(^|/)pages/.*\.(tsx|jsx|ts|js)$"), ("React layout", r"(^|/)app/.*/layout\.(tsx|jsx|ts|js)$"),
)
#: Words that no list of keywords needs (fixed values).
NOISE = (
    "src", "app", "lib", "api", "py", "ts", "tsx", "js", "jsx", "route", "routes", "handler", "http", "component", "page", "fixtures", "tests",
    "fastapi", "django", "react", "nextjs", "router", "request", "response",
)


@dataclass(frozen=True)
class Rule:
    """A vote: it holds where, in any of its cases, each group has one of its signals and none of `without` is there."""

    axis: str
    label: str
    points: float
    reason: str
    cases: tuple[tuple[tuple[str, ...], ...], ...]
    without: tuple[str, ...] = ()


def _of(kind: str, words: str) -> tuple[str, ...]:
    return tuple(f"{kind}:{w}" for w in words.split())


def _domain(label: str, points: float, reason: str, *signals: str) -> Rule:
    return Rule("domain", label, points, reason, ((signals,),))


def _role(label: str, points: float, reason: str, *groups: tuple[str, ...], without: tuple[str, ...] = ()) -> Rule:
    return Rule("role", label, points, reason, (groups,), without)


_FRONTEND = (*_of("path", "component components page pages layout frontend"), "file:jsx")
_AUTH = (*_of("path", "auth login session jwt token otp"), *_of("import", "jwt jose passport nextauth"))
_DATABASES = tuple(f"system:{s}" for s in ("PostgreSQL/Django ORM", "SQLAlchemy", "Prisma", "MongoDB/Mongoose"))
_ROUTE = ("entry:route",)
_VERIFY = (_ROUTE, ("any:otp",), ("any:verify",))
#: The rules, with the labels, points, reasons and words of the survey (fixed values).
RULES = (
    _domain("auth", 3.0, "path suggests auth", *_of("path", "auth login session jwt token otp")),
    _domain("auth", 2.0, "imports auth library", *_of("import", "jwt jose passport nextauth")),
    _domain("otp/auth", 4.0, "OTP signal", "any:otp"),
    _domain("payments", 3.0, "path suggests payments", *_of("path", "payment payments billing invoice checkout stripe")),
    _domain("payments", 3.0, "Stripe signal", "import:stripe", "system:Stripe"),
    _domain("notifications", 3.0, "path suggests notifications", *_of("path", "email mail mailer notification notifications")),
    _domain("notifications", 2.0, "email provider import", *_of("import", "smtplib sendgrid mailgun")),
    _domain("cache", 3.0, "cache/Redis signal", *_of("path", "cache redis"), "system:Redis"),
    _domain("data", 2.0, "path suggests data layer", *_of("path", "model models schema db database repository")),
    _domain("data", 2.0, "database system signal", *_DATABASES),
    _domain("frontend", 2.0, "frontend path/component signal", *_FRONTEND),
    _domain("api", 1.5, "API route signal", *_of("path", "api route routes router view views controller"), "entry:some"),
    _domain("jobs", 2.0, "background job path", *_of("path", "task tasks job jobs worker workers")),
    _domain("context packing", 2.0, "context/summarization signal", *_of("path", "summary summaries rank ranking repo context pack")),
    Rule("domain", "frontend/auth", 4.0, "frontend auth signal", ((_FRONTEND, _AUTH), (_of("path", "component components page pages"), (*_of("path", "login auth session signin"), *_of("symbol", "login auth session signin"))))),
    _role("OTP verification API route", 7.0, "OTP verify route", *_VERIFY),
    # the case of OTP goes first: without either of its words
    Rule("role", "Stripe webhook handling", 7.0, "Stripe webhook route", ((_ROUTE, ("any:stripe",), ("any:webhook",)),), ("both:otp-verify",)),
    _role("webhook handler", 5.0, "webhook route", _ROUTE, ("any:webhook",), without=("both:otp-verify", "any:stripe")),
    _role("HTTP API route handler", 4.0, "HTTP route decorator/call", _ROUTE, without=("both:otp-verify", "any:webhook")),
    _role("Django URL routing", 5.0, "Django url pattern", ("entry:Django URL",)),
    _role("Django view handler", 4.0, "Django view class/function", ("entry:Django view",)),
    _role("Django management command", 6.0, "management command path", ("entry:Django management command",)),
    _role("background email task", 7.0, "Celery email task", ("entry:Celery task",), _of("any", "email mail send notify notification")),
    _role("background task", 5.0, "Celery task", ("entry:Celery task",), without=_of("any", "email mail send notify notification")),
    _role("CLI command", 5.0, "CLI command decorator", ("entry:CLI command",)),
    _role("Next.js API route", 5.0, "Next.js route file", ("entry:Next API route",)),
    _role("React page component", 4.0, "Next/React page", ("entry:React page",)),
    _role("login form UI component", 7.0, "login component", ("entry:React component",), _of("any", "login signin")),
    _role("React UI component", 4.0, "React component", ("entry:React component",), without=_of("any", "login signin")),
    _role("session/token management", 5.0, "session/token symbols", tuple(f"{k}:{w}" for k in ("path", "symbol", "import") for w in ("session", "jwt", "token")), without=_ROUTE),
    _role("offline file summary generation", 4.0, "summary symbols/path", _of("any", "summary summarize summaries")),
    _role("context ranking and selection", 4.0, "ranking symbols/path", _of("any", "ranking rank score selection")),
    _role("repo map generation", 4.0, "repo map path", ("file:repo-map",)),
    _role("configuration", 2.0, "config/env signal", _of("any", "config settings env")),
)


def wanted(kind: str) -> list[str]:
    """The words of a kind of signal that some rule looks for."""
    signals = {s for r in RULES for case in r.cases for group in case for s in group} | {s for r in RULES for s in r.without}
    extra = {"otp", "verify"} if kind == "any" else set()
    return sorted({s.split(":", 1)[1] for s in signals if s.startswith(kind + ":")} | extra)


def _strings(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def symbols_of(text: Column, language: str) -> Column:
    """Array of struct(name, kind) in the order of lines; a line gives one for each pattern that it holds."""
    one = lambda x: F.array_compact(F.array(*[F.when(x.rlike(p), F.struct(F.regexp_extract(x, p, 1).alias("name"), F.lit(kind).alias("kind"))) for kind, p in SYMBOLS[language]]))
    return F.flatten(F.transform(F.split(text, "\n"), one))


def _namer(kind: str, first: str, second: str) -> Callable[[Column], Column]:
    """The name of an entry point from the text that shows it."""
    one = lambda m: F.regexp_extract(m, first, 1)
    two = lambda m: F.nullif(F.regexp_extract(m, second, 1), F.lit("")) if second else F.lit(None).cast("string")
    if kind == "route":
        return lambda m: F.concat(F.upper(one(m)), F.lit(" "), F.coalesce(two(m), F.lit("<dynamic route>")))
    if kind == "Django URL":
        return lambda m: F.concat(F.lit("Django URL: "), one(m), F.coalesce(F.concat(F.lit(" -> "), two(m)), F.lit("")))
    if kind == "CLI command":
        return lambda m: F.concat(F.lit("CLI command: "), F.coalesce(two(m), F.replace(one(m), F.lit("_"), F.lit("-"))))
    return lambda m: F.concat(F.lit(f"{kind}: "), one(m))


def entries(path: Column, text: Column, language: str, gates: Column | None = None) -> Column:
    """Entry points in the order of their kinds and of the text, each once: "GET /users", "Celery task: send_mail".

    gates: the labels of entry_gates that the text holds, where they are known: other kinds aren't looked for.
    """
    may = lambda kind, found: found if gates is None else F.when(F.array_contains(gates, kind), found).otherwise(F.array().cast("array<string>"))
    found = [may(kind, F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), _namer(kind, first, second))) for kind, pattern, first, second in ENTRIES.get(language, ())]
    if language == "python":
        command = path.contains("/management/commands/") & text.rlike(r"\bclass[ \t]+Command\b")
        found.append(F.array_compact(F.array(F.when(command, F.concat(F.lit("Django management command: "), P.stem(path))))))
    if language == "javascript":
        found.append(F.array_compact(F.array(*[F.when(path.rlike(p), F.concat(F.lit(f"{kind}: "), path)) for kind, p in PLACES])))
    return F.array_distinct(F.flatten(F.array(*found))) if found else F.array().cast("array<string>")


def entry_gates(language: str) -> tuple[tuple[str, str], ...]:
    """Patterns of RE2 without which a text has no entry points of the language."""
    return tuple((kind, pattern.replace(r"\s", r"[\s\x0b]")) for kind, pattern, _, _ in ENTRIES.get(language, ())) + ((("command", "class[ \\t]+Command"),) if language == "python" else ())


def signals(path: Column, words: Column, names: Column, imports: Column, entry: Column, outer: Column) -> Column:
    """The signals of a file that rules look for.

    words: those of wanted("any") that are tokens of the text, every word of which counts, at any length; names, imports and entry: arrays of the names of symbols,
    of imports and of entry points; outer: of systems.
    """
    joined = lambda c: ordered_tokens(F.array_join(c, " "))
    by = {"path": ordered_tokens(path), "symbol": joined(names), "import": joined(imports)}
    marked = lambda kind, tokens: F.transform(F.array_intersect(tokens, _strings(wanted(kind))), lambda t: F.concat(F.lit(f"{kind}:"), t))
    everything = F.concat(*by.values(), joined(entry), words)
    parts = [marked(k, tokens) for k, tokens in by.items()] + [marked("any", everything), F.transform(outer, lambda s: F.concat(F.lit("system:"), s))]
    head = lambda e: F.when(e.rlike(f"^(?:{_METHODS.upper()}) "), "entry:route").otherwise(F.concat(F.lit("entry:"), F.substring_index(e, ":", 1)))
    parts.append(F.transform(entry, head))
    repo_map = F.replace(path, F.lit("/"), F.lit("_")).contains("repo_map")
    parts.append(F.array_compact(F.array(F.when(F.size(entry) > 0, "entry:some"), F.when(path.rlike(r"\.(tsx|jsx)$"), "file:jsx"), F.when(repo_map, "file:repo-map"))))
    return F.array_distinct(F.flatten(F.array(*parts)))


def with_pairs(found: Column) -> Column:
    """Signals with one more where both words of a verification are there."""
    both = F.array_contains(found, "any:otp") & F.array_contains(found, "any:verify")
    return F.when(both, F.array_append(found, "both:otp-verify")).otherwise(found)


def votes(found: Column) -> Column:
    """Array of struct(axis, label, points, reason): the rules that hold, in order."""
    def holds(rule: Rule) -> Column:
        cases = [reduce(lambda a, b: a & b, [F.arrays_overlap(found, _strings(g)) for g in case]) for case in rule.cases]
        some = reduce(lambda a, b: a | b, cases)
        return some & ~F.arrays_overlap(found, _strings(rule.without)) if rule.without else some

    vote = lambda r: F.struct(F.lit(r.axis).alias("axis"), F.lit(r.label).alias("label"), F.lit(r.points).alias("points"), F.lit(r.reason).alias("reason"))
    return F.array_compact(F.array(*[F.when(holds(r), vote(r)) for r in RULES]))


def winner(cast: Column, axis: str) -> Column:
    """The label with the most points on an axis, the first by name among equals; null where nothing votes."""
    own = F.filter(cast, lambda v: v["axis"] == axis)
    total = lambda label: F.aggregate(own, F.lit(0.0), lambda a, v: a + F.when(v["label"] == label, v["points"]).otherwise(0.0))
    ranked = F.transform(F.array_distinct(F.transform(own, lambda v: v["label"])), lambda label: F.struct((-total(label)).alias("lost"), label.alias("label")))
    return F.array_min(ranked)["label"]


def plain_role(path: Column, symbols: Column, entry: Column) -> Column:
    """What a file is where no rule says it: an entry point, or its name with the kind of its symbols."""
    stem = F.translate(P.stem(path), "_-", "  ")
    has = lambda kind: F.exists(symbols, lambda s: s["kind"] == kind)
    return F.when(F.size(entry) > 0, "entrypoint").when(has("class"), F.concat(stem, F.lit(" classes"))).when(has("function"), F.concat(stem, F.lit(" functions"))).otherwise(stem)


def keywords(domain: Column, role: Column, entry: Column, outer: Column, names: Column, most: int = 30, first: int = 20) -> Column:
    """Words of domain, role, entry points, systems and the first symbols, each text's sorted and each word once: a short list is the feature."""
    tokens = lambda c: F.array_sort(F.array_distinct(ordered_tokens(c)))
    texts = F.concat(F.array(F.coalesce(domain, F.lit("")), role, F.array_join(entry, " "), F.array_join(outer, " ")), F.slice(names, 1, first))
    words = F.array_distinct(F.flatten(F.transform(texts, tokens)))
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*NOISE)), 1, most)

