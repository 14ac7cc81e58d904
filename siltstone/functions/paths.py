"""Column functions over paths: their parts, and which kinds of file they name.

Kinds are regular expressions over the whole path, in the subset that Java and RE2 share, so each
is one JVM-side predicate.  A stem ends before the last dot of a name, unless that dot comes first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import ordered_tokens


def _dirs(*names: str) -> str:
    return f"(^|/)({'|'.join(names)})(/|$)"


def _names(*names: str) -> str:
    return f"(^|/)({'|'.join(names)})$"


_CODE = r"[^/]\.(go|rs|java|kt|py|tsx?|jsx?)$"
#: Kinds of paths (fixed values): alternatives of one kind are joined by "|".
KINDS: dict[str, str] = {
    "skipped": _dirs(r"\.git", r"\.claude", r"\.siltstone"),
    "unwatched": _dirs(r"\.git", "node_modules", r"\.venv", "venv", "dist", "build", r"\.next", "__pycache__", r"\.yarn", r"\.mypy_cache", r"\.ruff_cache", r"\.pytest_cache", r"\.tox", r"\.eggs", r"\.vscode", r"\.idea", r"\.fleet")
    + r"|(^|/)context(\.compact)?\.md$|\.tsbuildinfo$|^\.siltstone/",
    # four notions of a test, each for its own use
    "test_file": r"(^|/)test_[^/]*$|_test(\.[^./]+)?$|\.(test|spec)\.[^./]+$|" + _dirs("tests", "__tests__"),
    "test_path": r"(?i)^tests?/|/tests/|__tests?__/|(^|/)test_[^/]*$|(_test\.go|_test\.py|\.test\.tsx?|\.spec\.tsx?)$|" + _dirs("test"),
    "test_edit": r"^tests/|/tests/|__tests?__/|(^|/)test_[^/]*$|(_test\.py|_test\.go|\.test\.tsx?|\.spec\.tsx?)$|(?i:" + _dirs("test") + ")",
    "config_file": r"(?i)[^/]\.(toml|yaml|yml|json|env|ini|cfg|conf|dockerfile|makefile)$"
    r"|(^|/)(config|settings|configuration|env|\.env|pyproject|package|dockerfile|makefile|cargo|go|build|cmake)(\.[^./]+)?$"
    r"|(^|/|[^a-z0-9/])conf(ig)?([^a-z0-9/][^/]*)?$",
    "knowledge_file": r"(?i)(^|/)(decisions|adr|architecture|contributing|design|technical|tradeoffs|rfc|proposal)\.md$"
    r"|(^|/)adr[-_]?[0-9]+[^/]*$|(^|/)(adrs?|decisions|rfcs|proposals|design)/.*[^/]\.md$",
    "build_metadata": r"(?i)^(pom\.xml|(build|settings)\.gradle(\.kts)?|gradle\.properties)$",
    "release_name": r"(?i)(^|/)(pyproject\.toml|setup\.cfg|setup\.py|package(-lock)?\.json|cargo\.toml|pom\.xml|build\.gradle|gradle\.properties|__init__\.py|__about__\.py|_?version\.py)$"
    r"|version[^/]*\.(py|ts|js|java|toml|json|xml)$",
    "release_excluded": "(?i)" + _dirs("docs?", "examples?", "fixtures?", "tests?", "__tests__"),
    "release_primary": r"(?i)" + _names(r"pyproject\.toml", r"package\.json", r"cargo\.toml", r"pom\.xml", r"__init__\.py", r"__about__\.py", r"_version\.py", r"version\.py"),
    "docs_path": r"(?i)^docs?/|\.(md|mdx|rst)$",
    "example_path": "(?i)" + _dirs("examples?", "fixtures?", "playgrounds?", "templates?") + r"|^samples?(/|$)|(^|/)(template|sample)-",
    "lock_or_generated": "(?i)" + _dirs("dist", "build", "coverage", "vendor", "generated", "__generated__", "snapshots", "__snapshots__")
    + r"|" + _names(r"package-lock\.json", r"pnpm-lock\.yaml", r"(yarn|cargo|poetry|gemfile)\.lock") + r"|\.(snap|snapshot)$",
    "code": "(?i)" + _CODE,
    "source_place": "(?i)^[^/]+$|" + _dirs("src", "source") + "|^(src|lib|pkg|cmd|packages)/",
    "code_place": "(?i)" + _dirs("api", "handlers?", "cmd"),
    "ignore_control": "(?i)" + _names(r"\.(agent|cursor|docker|eslint|git|npm|prettier)ignore"),
    "deploy_config": r"(?i)" + _names(r"buildspec\.ya?ml", r"cfn\.patches\.ya?ml", r"cloudformation\.ya?ml", "containerfile", "dockerfile", r"serverless\.ya?ml")
    + r"|(^|/)(deploy|release|rollback)[^/]*\.(sh|py|js|ts)$|^\.github/workflows/|"
    + _dirs("addons", "cfn", "cloudformation", "copilot", "deploy", "deployment", "infra", "k8s", "kubernetes", "overrides", "pipelines?"),
    "vendored": r"/(vendor|dist|build|node_modules)/|" + _names(r"package-lock\.json", r"pnpm-lock\.yaml", r"yarn\.lock", r"go\.sum"),
    "agent_artifact": r"^\.(siltstone|agent)/",
}
#: Families of paths in order; the first that fits counts (fixed values).
FAMILIES = (
    ("docs", "(?i)" + _dirs("docs?") + r"|(^|/)readme[^/]*$|[^/]\.(md|mdx|rst)$"),
    ("fixtures", "(?i)" + _dirs("fixtures?", "__fixtures__", "snapshots", "__snapshots__")),
    ("examples", "(?i)" + _dirs("examples?", "playgrounds?", "samples?", "templates?")),
    ("test", "(?i)" + _dirs("tests?", "__tests__", "specs?", "e2e", "integration")),
    ("generated", "(?i)" + _dirs("dist", "build", "generated", "__generated__", "coverage")),
    ("test", r"(?i)(\.test\.tsx?|\.spec\.tsx?|_test\.go|_test\.py)$"),
    ("config", "(?i)" + _names(r"yarn\.lock", r"go\.mod", r"go\.sum", r"pom\.xml", r"build\.gradle", r"gradle\.properties") + r"|[^/]\.(toml|yaml|yml|json|ini|cfg)$"),
    ("source", r"(?i)[^/]\.(py|tsx?|jsx?|go|java|kt|rs|rb|php|cs)$"),
)
#: Words of paths that tell nothing about their subject, and those that name a part of a system (fixed values).
ROLE_WORDS = (
    "api apis route routes router endpoint endpoints controller controllers service services handler handlers resolver resolvers schema schemas model models "
    "repository repositories repo repos client clients adapter adapters provider providers serializer serializers validator validators worker workers job jobs "
    "mailer mailers migration migrations paginator pagination"
).split()
ENTRY_WORDS = "page pages screen screens view views component components api route routes router controller controllers endpoint endpoints handler handlers webhook webhooks".split()
PLACE_WORDS = "src app apps lib libs pkg packages backend frontend server client web mobile index main test tests spec specs".split()
NOISE_WORDS = tuple(sorted({*ROLE_WORDS, *ENTRY_WORDS, *PLACE_WORDS}))


def is_kind(path: Column, kind: str) -> Column:
    return path.rlike(KINDS[kind])


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"^(.+)\.[^.]+$", "$1")


def suffix(path: Column) -> Column:
    """With its dot; empty where a name has none."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def source_path(path: Column) -> Column:
    other = is_kind(path, "test_path") | is_kind(path, "docs_path") | is_kind(path, "example_path") | is_kind(path, "lock_or_generated")
    return ~other & is_kind(path, "code") & is_kind(path, "source_place")


def source_like(path: Column) -> Column:
    return (source_path(path) | is_kind(path, "code_place")) & is_kind(path, "code")


def release_metadata(path: Column) -> Column:
    return is_kind(path, "release_name") & ~is_kind(path, "release_excluded")


def release_bonus(path: Column) -> Column:
    """Points for the file that a release changes first."""
    return F.when(is_kind(path, "release_primary"), 70.0).otherwise(0.0)


def build_bonus(path: Column) -> Column:
    return F.when(F.lower(name(path)) == "gradle.properties", 35.0).otherwise(90.0)


def family(path: Column) -> Column:
    chosen = F.when(F.lit(False), "")
    for label, pattern in FAMILIES:
        chosen = chosen.when(path.rlike(pattern), label)
    return chosen.otherwise("other")


#: Kinds of a file in an overview, in order (fixed values).
CATEGORIES = (
    ("config", r"(?i)" + _names(r"yarn\.lock", r"requirements\.txt", r"poetry\.lock", r"setup\.(py|cfg)", r"tox\.ini", r"ruff\.toml", "dockerfile", r"package(-lock)?\.json", r"pyproject\.toml", r"pnpm-workspace\.yaml", r"docker-compose\.yml")
     + r"|(^|/)[^/]*config[^/]*$"),
    ("doc", r"(?i)[^/]\.(md|rst|txt)$"),
    ("test", r"(?i)" + _dirs("tests?", "specs?") + r"|(^|/)test_[^/]*$|(_test|\.test)\.[^./]+$|_test$"),
    ("entrypoint", r"(?i)(^|/)[^/]*(main|app|cli|server|index|routes|router|api)[^/]*$"),
)


def category(path: Column) -> Column:
    chosen = F.when(F.lit(False), "")
    for label, pattern in CATEGORIES:
        chosen = chosen.when(path.rlike(pattern), label)
    return chosen.otherwise("file")


def path_tokens(path: Column) -> Column:
    """Distinct tokens of the directories and the stem, in order."""
    return F.array_distinct(ordered_tokens(F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")))


def has_role(path: Column, words: list[str]) -> Column:
    return F.arrays_overlap(path_tokens(path), F.array(*map(F.lit, words)))


def domain_tokens(path: Column) -> Column:
    return F.filter(path_tokens(path), lambda t: (F.length(t) >= 3) & ~t.isin(*NOISE_WORDS))


def _leading(path: Column, roots: str, parts: int = 2) -> Column:
    split = F.split(path, "/")
    return F.when(split[0].rlike(f"^({roots})$") & (F.size(split) > 1), F.array_join(F.slice(split, 1, parts), "/"))


def module(path: Column) -> Column:
    """The first part, or two below the usual containers."""
    return F.coalesce(_leading(path, "src|tests|docs|apps|packages|services|libs"), F.split(path, "/")[0])


def group(path: Column) -> Column:
    return F.coalesce(_leading(path, "src|app|lib|tests|test"), F.split(path, "/")[0])


def package_root(path: Column) -> Column:
    return _leading(path, "packages")


def balance_scope(path: Column) -> Column:
    """The package or playground of a path, else two parts below a source root; null where there is none."""
    return F.coalesce(_leading(path, "packages|playground"), _leading(path, "src|lib|app|apps"))


def replacement_scope(path: Column) -> Column:
    """The scope within which one file may take another's place."""
    split, deep = F.split(path, "/"), F.regexp_extract(path, "^(.+)/[^/]+$", 1)
    inner = F.when(source_path(path) & (F.size(split) >= 5) & (split[0] == "packages") & (split[2] == "src"), deep)
    tests = F.when(is_kind(path, "test_path") & (F.size(split) >= 3), deep)
    return F.coalesce(_leading(path, "playground|integration"), inner, tests, balance_scope(path))


def api_key(path: Column) -> Column:
    """/api/... of the parts after the first "api", without route files, brackets and noise; null where nothing is left."""
    after = F.regexp_extract(F.lower(path), r"(?:^|/)api/(.+)$", 1)
    after = F.regexp_replace(after, r"(^|/)(routes?|urls|views|controller)(\.[^./]+)?$", "")
    parts = F.filter(F.transform(F.split(after, "/"), lambda p: F.regexp_replace(p, r"^[\[\](){}]+|[\[\](){}]+$", "")), lambda p: (p != "") & ~p.startswith("_"))
    terms = F.array_distinct(F.filter(F.flatten(F.transform(parts, ordered_tokens)), lambda t: ~t.isin(*NOISE_WORDS)))
    return F.when(F.size(terms) > 0, F.concat(F.lit("/api/"), F.array_join(terms, "/")))


def url_api_key(value: Column) -> Column:
    """The first /api/... of a text, without query, template parts and bracketed parameters; null where there is none."""
    found = F.regexp_extract(value, r"/api/[A-Za-z0-9_./${}\[\]-]+", 0)
    found = F.regexp_replace(F.regexp_replace(found, r"\$\{.*$", ""), r"/\[[^\]]+\]", "")
    found = F.regexp_replace(found, "[/,;)]+$", "")
    return F.when(value.rlike(r"/api/[A-Za-z0-9_./${}\[\]-]+"), F.when(found == "", "/api").otherwise(found))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression: "*" crosses "/", "?" is one character, [..] and [!..] are classes."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i:end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner.startswith('!') else inner}]"
            i = end + 1
        else:
            out += "\\" + c if c in ".^$+{}()|\\[]" else c
    return f"(?s)^({out})$"


def ignore_regex(rule: str) -> str:
    """One rule of an ignore file, without "!": anchored if it holds an inner "/", of any depth else; "/" at its end asks for a directory."""
    anchored, folder = "/" in rule.rstrip("/"), rule.endswith("/")
    body, out, i = rule.strip("/"), "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + body[i] if body[i] in ".^$+{}()|\\[]" else body[i]), i + 1
    return ("^" if anchored else "(^|/)") + out + ("/" if folder else "(/|$)")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that fits ignores the path; rules with "!" take it back, comments and blanks say nothing."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            out = F.when(path.rlike(ignore_regex(rule.removeprefix("!"))), F.lit(not rule.startswith("!"))).otherwise(out)
    return out


def allowed(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Neither vendored nor excluded, and included if anything is asked for."""
    hit = lambda globs: F.coalesce(F.greatest(*[path.rlike(glob_regex(g)) for g in globs], F.lit(False)), F.lit(False)) if globs else F.lit(False)
    return ~is_kind(path, "vendored") & ~hit(exclude) & (hit(include) if include else F.lit(True))
