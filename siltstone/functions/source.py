"""What source files tell by their lines: symbols, imports, effects, hints; and views of texts.

Everything is a regular expression over a line or a text, in the subset that Java and RE2 share: no file
is parsed, so a name in a string or comment counts as well.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import estimate_tokens

#: Symbols by language: kind and pattern, whose first group is the name (fixed values).
SYMBOLS = {
    "python": (("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)\s*\(")),
    "javascript": (
        ("class", r"(?:export\s+)?class\s+(\w+)"), ("function", r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+(\w+)\s*\("),
        ("function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("variable", r"\bexport\s+(?:declare\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=;]+)?="),
    ),
    "go": (("method", r"^\s*func\s+\([^)]+\)\s*(\w+)\s*\("), ("function", r"^\s*func\s+(\w+)\s*\("), ("class", r"^\s*type\s+(\w+)\s+(?:struct|interface)\b")),
}
#: Imports by language: patterns of a line, whose first group is what is imported (fixed values).
IMPORTS = {
    "python": (r"^\s*import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)", r"^\s*from\s+([\w.]+)\s+import\b"),
    "javascript": (r"import\s+.*?\s+from\s+[\"']([^\"']+)[\"']", r"import\s+[\"']([^\"']+)[\"']", r"require\s*\(\s*[\"']([^\"']+)[\"']\s*\)", r"export\s+.*?\s+from\s+[\"']([^\"']+)[\"']"),
    "go": (r"^import\s+\"([^\"]+)\"", r"^\s+(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    "rust": (r"^\s*(?:pub\s+)?mod\s+(\w+)\s*[;{]", r"^\s*(?:pub\s+)?use\s+(\w+)[\w:{}, ]*;", r"^\s*extern\s+crate\s+(\w+)\s*;"),
    "java": (r"^import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",), "kotlin": (r"^import\s+([\w.]+(?:\.\*)?)",),
}
ENV_READS = (
    r"os\.environ\[\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]\s*\]", r"\bgetenv\(\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]", r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)",
    r"process\.env\[\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]\s*\]", r"\bconfig\.get\(\s*['\"]([A-Za-z_][A-Za-z0-9_.-]*)['\"]", r"\b(?:settings|config)\.([A-Z][A-Z0-9_]*)",
)
#: Systems outside of a program and their signs in lower case, in order (fixed values).
SYSTEMS = (
    ("Redis", r"\bredis\b|ioredis"), ("Celery", r"\bcelery\b|shared_task|\.delay\("), ("Kafka", r"\bkafka\b|confluent_kafka"), ("S3", r"\bs3\b|put_object|get_object"), ("SQS", r"\bsqs\b|send_message|receive_message"),
    ("SNS", r"\bsns\b|publish\("), ("DynamoDB", "dynamodb"), ("HTTP", r"\brequests\b|\bhttpx\b|\baiohttp\b|\burllib\b|\bfetch\(|\baxios\b"), ("Stripe", r"\bstripe\b"), ("SQLAlchemy", r"sqlalchemy|session\.query|select\("),
    ("PostgreSQL/Django ORM", r"django\.db|\.objects\.|psycopg|postgres|cursor\.execute"), ("Prisma", r"\bprisma\b"), ("MongoDB/Mongoose", r"\bmongoose\b|\bpymongo\b|mongodb"),
    ("SMTP/email", r"\bsmtplib\b|\bsmtp\b|send_mail|send_email|sendgrid|mailgun"), ("Sentry", r"\bsentry(_sdk)?\b"), ("Datadog", r"\bdatadog\b|\bddtrace\b"), ("CloudWatch/logging", r"cloudwatch|\blogging\b|logger\."),
)
#: What a program may do, by the systems it touches or by signs of its own (fixed values).
SYSTEM_EFFECTS = (
    ("possible Redis read/write", ("Redis",)), ("possible S3 usage", ("S3",)), ("possible queue/task dispatch", ("SQS", "SNS", "Kafka", "Celery")), ("possible HTTP call", ("HTTP",)),
    ("possible DB access", ("PostgreSQL/Django ORM", "SQLAlchemy", "Prisma", "MongoDB/Mongoose")), ("possible email send", ("SMTP/email",)), ("possible observability/logging", ("Sentry", "Datadog", "CloudWatch/logging")),
)
READS, WRITES = r"\bopen\(\s*[^,\)]+(?:,\s*['\"]r[bt]*['\"])?\)|\.read_text\(|\bfs\.(?:readFileSync|readFile|createReadStream)\(", r"\bopen\(\s*[^,\)]+,\s*['\"][^'\"]*[wax+][^'\"]*['\"]|\.write_text\(|\bfs\.(?:writeFileSync|writeFile|appendFile|createWriteStream)\("
ACCESS = (("possible filesystem read", READS), ("possible filesystem write", WRITES))
OWN_EFFECTS = (("subprocess", r"\b(subprocess|popen\(|exec\(|spawn\()"), ("logging", r"\b(print\(|logger\.|logging\.|console\.)"))
HINTS = (
    ("raises exceptions", r"\braise\s+\w+|\bthrow\s+new\b"), ("catches exceptions", r"\bexcept\b|\bcatch\s*\("), ("exits process", r"typer\.Exit|sys\.exit|process\.exit"),
    ("returns error responses", r"HTTPException|status_code\s*=\s*[45][0-9][0-9]|Response\("), ("logs errors", r"\.exception\(|\.error\("),
)
#: Concepts and the parts of a text that stand for them (fixed values).
CONCEPTS = (
    ("authentication", "auth|token|login|permission|jwt|expired"), ("retry logic", "retry|retries|attempt|backoff|timeout"), ("caching", "cache|redis|memo|ttl"), ("rate limiting", "rate.limit|ratelimit|limiter|throttle|quota|429"),
    ("configuration", "config|toml|env|setting"), ("testing", "test_|pytest|assert |fixture"), ("CLI design", "typer|@app.command|option|argument|command"), ("serialization", "json|model_dump|pydantic|schema"),
)
FAILURES = (
    ("test_assertion", "assert|expected|actual"), ("import_error", "importerror|modulenotfounderror|cannot find module"), ("type_error", "typeerror|mypy|tsc"), ("timeout", "timeout"),
    ("permission_or_auth", "permission denied|unauthorized|forbidden"), ("environment_or_network", "connection refused|network"),
)


def lines_of(files: DataFrame) -> DataFrame:
    """files with a row for each line of `text`: line (from 1) and value."""
    return files.select(*[c for c in files.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def symbols(files: DataFrame, language: str) -> DataFrame:
    """(path, line, name, kind): a line gives one symbol for each of the language's patterns that it holds."""
    found = F.array_compact(F.array(*[F.when(F.col("value").rlike(p), F.struct(F.regexp_extract("value", p, 1).alias("name"), F.lit(kind).alias("kind"))) for kind, p in SYMBOLS[language]]))
    return lines_of(files.select("path", "text")).select("path", "line", F.explode(found).alias("s")).select("path", "line", "s.name", "s.kind")


def imports(files: DataFrame, language: str) -> DataFrame:
    """(path, name): what a file imports, each once; a line of Python may import several."""
    found = F.flatten(F.array(*[F.regexp_extract_all("value", F.lit(p), 1) for p in IMPORTS[language]]))
    if language == "python":
        found = F.flatten(F.transform(found, lambda x: F.transform(F.split(x, ","), lambda part: F.regexp_extract(part, r"[\w.]+", 0))))
    return lines_of(files.select("path", "text")).select("path", F.explode(found).alias("name")).filter("name != ''").distinct()


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _signs(pattern: str) -> list[str]:
    """One plain part of each alternative of a pattern, without which it can't match: looking for these first is much cheaper."""
    return [max(re.split(r"[^A-Za-z0-9_]+", re.sub(r"\\[a-z]|\[[^\]]*\]", " ", part)), key=len) for part in pattern.split("|")]


def _holds(text: Column, pattern: str) -> Column:
    signs = _signs(pattern)
    return reduce(lambda a, b: a | b, [text.contains(x) for x in signs]) & text.rlike(pattern)


def _named(text: Column, cases: tuple[tuple[str, str], ...]) -> Column:
    return _once(text, lambda t: F.array_compact(F.array(*[F.when(_holds(t, p), F.lit(label)) for label, p in cases])))


#: What each of ENV_READS can't do without.
_ENV_SIGNS = ("environ", "getenv", "process.env", "process.env", "config.get", "")


def env_names(text: Column) -> Column:
    """Distinct names that a text reads from its environment or configuration."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[F.when(text.contains(sign), F.regexp_extract_all(text, F.lit(p), 1)).otherwise(none) for sign, p in zip(_ENV_SIGNS, ENV_READS, strict=True)])))


def env_reads(text: Column) -> Column:
    return F.slice(env_names(text), 1, 20)


def systems(text: Column) -> Column:
    return _named(F.lower(text), SYSTEMS)


def effects(text: Column, reads_env: Column | None = None) -> Column:
    """What running the file may do; reads_env, where it is known already."""
    env = env_effect(reads_env if reads_env is not None else F.size(env_names(text)) > 0)
    access = F.array_compact(F.array(*[F.when(_holds(text, p), F.lit(label)) for label, p in ACCESS]))
    return F.concat(env, access, _once(systems(text), system_effects), _named(F.lower(text), OWN_EFFECTS))


def env_effect(reads: Column) -> Column:
    return F.array_compact(F.array(F.when(reads, "reads environment/config")))


def system_effects(own: Column) -> Column:
    """What the systems of a text (array) let expect."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(own, F.array(*map(F.lit, names))), F.lit(label)) for label, names in SYSTEM_EFFECTS]))


def failure_hints(text: Column) -> Column:
    return _named(text, HINTS)


def concepts(text: Column) -> Column:
    return _named(F.lower(text), CONCEPTS)


def failure_class(output: Column, timed_out: Column | None = None) -> Column:
    """The first class whose sign an output holds."""
    def chosen(low: Column) -> Column:
        out = F.when(F.lit(False), "")
        for label, p in FAILURES:
            hit = _holds(low, p)
            out = out.when(hit | timed_out if label == "timeout" and timed_out is not None else hit, label)
        return out.otherwise("unknown")

    return _once(F.lower(output), chosen)


def bytes_tokens(size: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(size / 4)).cast("long")


def line_of(text: Column, at: Column) -> Column:
    """The line, from 1, of a place (from 0)."""
    before = F.substring(text, F.lit(1), at.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def cut(text: Column, most_tokens: int) -> Column:
    """The text within its budget, with a mark where it was cut."""
    return F.when(estimate_tokens(text) <= most_tokens, text).otherwise(F.concat(F.substring(text, 1, most_tokens * 4), F.lit("\n... truncated ...")))


def edges(lines: Column, most: int) -> Column:
    """The first and last lines, with the number left out between them."""
    n = F.size(lines)
    gap = F.concat(F.lit("... "), (n - most).cast("string"), F.lit(" line(s) omitted ..."))
    return F.when(n <= most, lines).otherwise(F.concat(F.slice(lines, 1, most // 2), F.array(gap), F.slice(lines, -(most - most // 2), most - most // 2)))


def fitting_lines(lines: Column, most_tokens: int) -> Column:
    """How many lines from the start fit a budget; the first always does."""
    step = lambda a, x: F.struct((a["t"] + estimate_tokens(x)).alias("t"), F.when((a["k"] == 0) | ((a["k"] == a["i"]) & (a["t"] + estimate_tokens(x) <= most_tokens)), a["k"] + 1).otherwise(a["k"]).alias("k"), (a["i"] + 1).alias("i"))
    return F.aggregate(lines, F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).alias("k"), F.lit(0).alias("i")), step)["k"]


#: Starts of the lines that a view keeps (fixed values).
VIEWS = {"skeleton": r"^\s*(def |class |async def |function |export |import |from )", "symbols": r"^\s*(def |class |async def |function |export function |export class )"}


def view(text: Column, mode: str) -> Column:
    """A text by its interface lines, or its first forty; the first 4,000 characters where there are none."""
    lines = F.split(text, "\n")
    if mode in VIEWS:
        kept = F.filter(lines, lambda x: x.rlike(VIEWS[mode]))
        return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(F.substring(text, 1, 4000))
    if mode == "summary":
        return F.array_join(F.slice(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), 1, 40), "\n")
    return text


def branch_status(line: Column) -> Column:
    """struct(branch, upstream, ahead, behind) of "main...origin/main [ahead 1, behind 2]"."""
    tracked = line.contains("...")
    number = lambda word: F.coalesce(F.nullif(F.regexp_extract(line, rf"\[.*{word} ([0-9]+)", 1), F.lit("")).cast("long"), F.lit(0))
    branch = F.when(tracked, F.nullif(F.trim(F.substring_index(line, "...", 1)), F.lit(""))).otherwise(F.when(line != "HEAD (no branch)", line))
    upstream = F.when(tracked, F.nullif(F.regexp_extract(line, r"\.\.\.([^ ]*)", 1), F.lit("")))
    return F.struct(branch.alias("branch"), upstream.alias("upstream"), number("ahead").alias("ahead"), number("behind").alias("behind"))


def change_kind(status: Column) -> Column:
    """added, modified, deleted, renamed, copied or changed, by the letter that a log gives."""
    first = F.substring(status, 1, 1)
    return F.when(first == "A", "added").when(first == "M", "modified").when(first == "D", "deleted").when(first == "R", "renamed").when(first == "C", "copied").when(status == "??", "untracked").otherwise("changed")


def task_state(text: Column) -> Column:
    """struct(status, done, open, blocked): the last valid status line of a task file, and its checklist."""
    lines = F.split(text, "\n")
    status = F.filter(F.transform(lines, lambda x: F.lower(F.trim(F.regexp_extract(x, "(?i)^status:(.*)$", 1)))), lambda x: x != "")
    last = F.element_at(status, -1)
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("long")
    known = F.when((F.size(status) > 0) & last.isin("todo", "in_progress", "blocked", "done"), last).otherwise("")
    return F.struct(known.alias("status"), count(r"^\s*[-*] \[[xX]\]").alias("done"), count(r"^\s*[-*] \[ \]").alias("open"), count(r"^\s*[-*] \[[!-]\]").alias("blocked"))


def execution_status(staged: Column, unstaged: Column, untracked: Column, ahead: Column, sha: Column) -> Column:
    dirty = F.coalesce(staged, F.lit(0)) + F.coalesce(unstaged, F.lit(0)) + F.coalesce(untracked, F.lit(0)) > 0
    return F.when(dirty, "in_progress").when(F.coalesce(ahead, F.lit(0)) > 0, "committed_not_pushed").when(F.coalesce(sha, F.lit("")) != "", "committed").otherwise("unknown")


def age_seconds(stamp: Column, now: Column) -> Column:
    """Seconds since an ISO time; infinite where there is none that parses."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(stamp))) / 1e6, F.lit(float("inf")))
