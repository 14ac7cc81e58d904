"""Column functions over task texts: terms, phrases, weights, classes, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import ordered_tokens

#: Words of no meaning for a task, words that fit any task, and words that fit several (fixed values).
STOP_WORDS = (
    "a an and are at be been but by can class code could did do does file files for from function had has have how in is it its may method might module not of on or our "
    "should that the their them these they this those to use used using was we were what when where why will with would you your"
).split()
GENERIC_WORDS = (
    "add added change changed changes clean cleanup code commit context debug dev development doc docs eval evals feature fix freshness gap gaps general generic impl implement "
    "implementation improve issue metric metrics noise noisy pack package packs quality release remaining repo root rule rules source stat stats sync task tasks test tests text "
    "update use useful usefulness version visibility wording workflow workflows"
).split()
AMBIGUOUS_WORDS = "analysis analytics analyze component components flow flows page pages preview previews public screen screens tool tools ui".split()
#: Other forms of terms, and terms that belong to the same concept: defaults of this library, to be replaced by a caller's own.
VARIANTS = {"authentication": "auth", "configuration": "config", "database": "db", "failing": "fail", "limiting": "limit", "orders": "order", "settings": "config", "users": "user"}
CONCEPTS = {
    "auth": ("login", "session", "token"), "build": ("bundle", "compile", "release"), "limit": ("quota", "throttle"),
    "order": ("cart", "checkout", "users"), "rate": ("backoff", "quota", "throttle"), "user": ("account", "profile"),
}
#: Kinds of tasks and the words that point to them; of equal counts the first wins (fixed values).
CLASSES = (
    ("bugfix", "fix bug broken regression debug issue error failing fail"), ("refactor", "refactor cleanup clean simplify restructure rename"),
    ("docs", "readme doc docs documentation changelog guide"), ("release", "release publish version bump tag pypi npm"),
    ("test", "test tests coverage pytest jest spec eval benchmark"), ("ui", "ui frontend component page screen css style layout"),
    ("infra", "ci workflow docker deploy build package hook mcp"), ("audit", "audit review inspect scan verify doctor status"),
    ("feature", "add implement create support enable new"),
)
#: Intents in the order in which they are tried (fixed values).
INTENTS = {
    "audit": ("audit", "security review", "risk review", "architecture review"), "review": ("review", "pr", "pull request", "code review"),
    "share": ("share", "handoff", "promptable artifact", "broad context"), "repo_overview": ("repo overview", "repository overview", "explain repo", "understand repo", "map repo"),
}
#: Modes with their signs, which are plain parts of the text (fixed values).
MODES = (
    ("pr_review", ("pr ", "pull request", "review", "diff", "review comment")),
    ("runtime_debugging", ("log", "cloudwatch", "queue", "sqs", "db row", "postgres", "dashboard", "customer.io", "event pipeline", "runtime", "prod", "production")),
    ("integration_readiness", ("mcp", "doctor", "readiness", "integration", "install", "tool exposure", "available tools")),
    ("small_direct_edit", ("small", "quick", "typo", "copy", "css", "style", "button", "label", "frontend", "docs")),
    ("release_docs", ("release", "changelog", "benchmark", "publish")),
)
COMMIT = r"(?i)^\s*([a-z][a-z0-9-]*)(?:\(([^)]{1,80})\))?!?:\s*([^\n]+)\n?$"
COMPOUND = "[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)+"
REFERENCE_KINDS = (
    ("github", r"https?://github\.com/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/(?:issues|pull)/[0-9]+"),
    ("number", r"(?:^|[^\w/.-])(#[0-9]+)(?:$|[^\w])"), ("gh", r"(?i)(?:^|[^\w])(GH-[0-9]+)(?:$|[^\w])"), ("jira", r"(?:^|[^\w])([A-Z][A-Z0-9]{1,9}-[0-9]+)(?:$|[^\w])"),
)
LOCATION = "(<[^>\\n]+>|[A-Za-z0-9_./@+~:-]+):([0-9]+)(?:-([0-9]+))?"


def commit_parts(task: Column) -> tuple[Column, Column, Column]:
    """Kind, scope and subject of "kind(scope)!: subject"; null where the task is not of that form."""
    there = task.rlike(COMMIT)
    kind, scope, subject = (F.when(there, F.regexp_extract(task, COMMIT, k)) for k in (1, 2, 3))
    return F.lower(kind), scope, subject


def match_text(task: Column) -> Column:
    """The text that terms are taken from: the words of a scope stand apart."""
    kind, scope, subject = commit_parts(task)
    joined = F.concat_ws(" ", kind, F.array_join(ordered_tokens(F.coalesce(scope, F.lit(""))), " "), subject)
    return F.when(kind.isNotNull(), joined).otherwise(task)


def terms(task: Column) -> Column:
    """Lower-case terms of three letters or more without stop words, in order, repeats kept."""
    return F.filter(F.split(F.lower(match_text(task)), "[^a-zA-Z0-9]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def _generic(t: Column) -> Column:
    return t.isin(*GENERIC_WORDS)


def phrases(words: Column) -> Column:
    """Distinct pairs of neighbours that are not both generic."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.filter(pairs, lambda p: ~(_generic(p["a"]) & _generic(p["b"])))
    return F.array_distinct(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"])))


def literal_phrases(task: Column) -> Column:
    """Quoted spans and compounds of two to eight tokens, not all of them generic."""
    quoted = [F.regexp_extract_all(task, F.lit(f"{q}([^{q}]{{3,120}}){q}"), 1) for q in ("`", '"', "'")]
    raw = F.concat(*quoted, F.regexp_extract_all(task, F.lit(COMPOUND), 0))
    tokens = F.transform(raw, lambda x: F.filter(ordered_tokens(x), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS)))
    tokens = F.filter(tokens, lambda t: F.size(t).between(2, 8) & ~F.forall(t, _generic))
    return F.array_distinct(F.transform(tokens, lambda t: F.array_join(t, " ")))


def singular(word: Column) -> Column:
    """A shorter form of a plural; null where there is none."""
    long, n = F.length(word) > 5, F.length(word)
    cut = lambda k: word.substr(F.lit(1), n - k)
    return F.when(
        (n >= 5) & ~_generic(word),
        F.when(word.endswith("ies") & long, F.concat(cut(3), F.lit("y"))).when(word.rlike("(sses|xes|ches|shes)$") & long, cut(2)).when(word.rlike("s$") & ~word.rlike("(ss|us|is)$"), cut(1)),
    )


def literal_weight(word: Column) -> Column:
    return F.when(_generic(word), 0.25).when(word.isin(*AMBIGUOUS_WORDS), 0.45).otherwise(1.0)


def weights(tasks: DataFrame, key: str, variants: dict[str, str] | None = None, concepts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, term, weight): a task's terms, their other forms, singulars and concepts, each at its greatest weight.

    The dictionaries are dimensions that a caller gives: they are literals of the plan.
    """
    variants, concepts = VARIANTS if variants is None else variants, CONCEPTS if concepts is None else concepts
    spark = tasks.sparkSession
    forms = F.broadcast(spark.createDataFrame(list(variants.items()), "term string, form string"))
    kin = F.broadcast(spark.createDataFrame([(t, s) for t, all_ in concepts.items() for s in all_], "term string, kin string"))
    own = tasks.select(key, F.explode(terms(F.col("task"))).alias("term")).distinct().withColumn("weight", literal_weight(F.col("term")))
    form_weight = F.when(_generic(F.col("form")), 0.25).when(F.col("form").isin(*AMBIGUOUS_WORDS), F.least(F.lit(0.45), "weight")).otherwise(F.least(F.lit(0.75), "weight"))
    other = own.join(forms, "term").select(key, F.col("form").alias("term"), form_weight.alias("weight"))
    one = own.select(key, singular(F.col("term")).alias("term"), F.least(F.lit(0.85), "weight").alias("weight")).filter(F.col("term").isNotNull() & ~F.col("term").isin(*STOP_WORDS))
    base = own.unionByName(other).unionByName(one).groupBy(key, "term").agg(F.max("weight").alias("weight"))
    near = base.filter(~_generic(F.col("term"))).join(kin, "term").select(key, F.col("kin").alias("term"))
    near = near.unionByName(near.join(forms, "term").select(key, F.col("form").alias("term")))
    return base.unionByName(near.withColumn("weight", F.lit(0.35))).groupBy(key, "term").agg(F.max("weight").alias("weight"))


def generic_share(task: Column) -> Column:
    words = terms(task)
    return F.coalesce(F.size(F.filter(words, _generic)) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def rewrite(task: Column) -> Column:
    """A narrower wording of a task, made of its concrete terms."""
    words = terms(task)
    concrete = F.slice(F.filter(words, lambda t: ~_generic(t) & ~t.isin(*AMBIGUOUS_WORDS)), 1, 4)
    named = F.when(F.size(concrete) > 0, F.array_join(concrete, " + ")).otherwise("exact file, route, or failing symptom")
    has = lambda text: F.arrays_overlap(words, F.array(*map(F.lit, text.split())))
    front, back = has("frontend page pages component components seo signup public"), has("backend api service services job jobs")
    scope = F.when(front, "frontend page/component work only").when(back, "backend service/route work only").otherwise("focus exact subsystem only")
    bound = F.when(front, "; no backend service or analysis changes").when(back, "; no frontend page or component changes").otherwise("")
    weak = F.concat(F.slice(F.filter(words, _generic), 1, 2), F.slice(F.filter(words, lambda t: t.isin(*AMBIGUOUS_WORDS) & ~_generic(t)), 1, 2))
    caution = F.when(F.size(weak) > 0, F.concat(F.lit("; avoid vague terms like "), F.array_join(weak, ", "))).otherwise("")
    return F.concat(scope, F.lit(": "), named, bound, caution)


def classes(task: Column) -> Column:
    """struct(kind, confidence, signals): the kind with most signs, at most five of which are named."""
    text = F.lower(task)
    hits = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words.split()])).alias("s"), F.lit(-i).alias("order")) for i, (k, words) in enumerate(CLASSES)])
    found = F.filter(hits, lambda h: F.size(h["s"]) > 0)
    total = F.aggregate(found, F.lit(0), lambda a, h: a + F.size(h["s"]))
    best = F.array_max(F.transform(found, lambda h: F.struct(F.size(h["s"]).alias("n"), h["order"].alias("order"), h["kind"].alias("kind"), h["s"].alias("s"))))
    sure = F.round(F.least(F.lit(0.95), 0.45 + best["n"] / total * 0.45), 2)
    none = F.struct(F.lit("general").alias("kind"), F.lit(0.2).alias("confidence"), F.array().cast("array<string>").alias("signals"))
    return F.when(F.size(found) > 0, F.struct(best["kind"].alias("kind"), sure.alias("confidence"), F.slice(best["s"], 1, 5).alias("signals"))).otherwise(none)


def intent(task: Column) -> Column:
    """audit, review, share, repo_overview or coding_task, by whole words."""
    text = F.trim(F.regexp_replace(F.translate(F.lower(task), "_-", "  "), r"\s+", " "))
    has = lambda kind: text.rlike(f"(^|[^a-z0-9_])({'|'.join(INTENTS[kind])})($|[^a-z0-9_])")
    out = F.when(has("audit"), "audit")
    for kind in ("review", "share", "repo_overview"):
        out = out.when(has(kind), kind)
    return out.otherwise("coding_task")


def mode(task: Column) -> tuple[Column, Column]:
    """The working mode of a task and how sure it is, by how many signs of the mode there are."""
    text = F.lower(task)
    words = F.size(F.filter(F.split(F.translate(text, "/.", "  "), r"\s+"), lambda w: w != ""))
    short = (words <= 8) & text.rlike("fix|update|rename|remove|add")
    out, sure = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for name, signs in MODES:
        n = sum(text.contains(s).cast("int") for s in signs)
        hit = (n > 0) | short if name == "small_direct_edit" else n > 0
        out = out.when(hit, name)
        sure = sure.when(hit, F.lit(0.68) if name == "small_direct_edit" else F.when(n >= 3, 0.92).when(n == 2, 0.82).otherwise(0.68))
    return out.otherwise("broad_feature"), sure.otherwise(0.35)


def prompt_warnings(task: Column) -> Column:
    """Names of what a prompt lacks or suggests."""
    lower, chosen = F.lower(task), mode(task)[0]
    words = F.size(F.regexp_extract_all(task, F.lit("[A-Za-z0-9_#./:-]+"), 0))
    has_file = lower.contains("#file") | task.rlike(r"(^|\s)[\w./-]+\.(py|ts|tsx|js|jsx|go|rs|java|rb|md|json|toml|ya?ml|css|scss)($|[\s:,])")
    limits = lower.rlike("concise|one[- ]line|no commentary|brief|max |bullets|json only|short")
    spec = lower.rlike("acceptance|criteria|requirements|constraints|validation|must|ensure|spec|plan:")
    question = (words <= 14) & ~lower.rlike("fix|edit|change|implement|add |remove|update|release|run ") & F.trim(lower).rlike(r"\?$|^(what|why|how|can|should|is|does|do) ")
    letters = F.regexp_replace(task, r"[^\p{L}]", "")
    loud = task.rlike(r"!!!|\?\?\?") | ((F.length(letters) >= 10) & (F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) >= 0.65 * F.length(letters)))
    kinds = sum(lower.rlike(p).cast("int") for p in ("review|pr ", "debug|log|runtime", "release|publish|changelog", "docs|readme", "feature|implement|build"))
    rules = (
        ("no_file", ~has_file & ~chosen.isin("pr_review", "runtime_debugging", "integration_readiness")),
        ("vague", (words <= 5) | F.trim(lower).isin("can you fix these gaps")), ("no_output_limit", (words <= 35) & ~limits),
        ("no_spec", ~spec & chosen.isin("broad_feature", "runtime_debugging", "integration_readiness", "release_docs")),
        ("question", question), ("frustrated", loud), ("drift", kinds >= 3),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules]))


def issue_references(text: Column) -> Column:
    """References in the order of their kinds, each once whatever its case."""
    found = [F.regexp_extract_all(F.regexp_replace(text, "[ \\n]", "  "), F.lit(p), int(k != "github")) for k, p in REFERENCE_KINDS]
    cleaned = F.transform(F.concat(*found), lambda r: F.regexp_replace(F.trim(r), r"[.,;:)\]}]+$", ""))
    kept = F.aggregate(cleaned, F.array().cast("array<string>"), lambda a, r: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(r)), a).otherwise(F.array_append(a, r)))
    return F.coalesce(kept, F.array().cast("array<string>"))


def reference_kind(ref: Column) -> Column:
    low = F.lower(ref)
    return F.when(low.contains("/pull/"), "github_pr").when(low.contains("/issues/") | ref.startswith("#") | low.startswith("gh-"), "github_issue").when(ref.rlike("^[A-Z][A-Z0-9]{1,9}-[0-9]+$"), "jira_issue").otherwise("unknown")


def locations(text: Column) -> Column:
    """struct(path, first, last) of path:line and path:first-last, where 1 <= first <= last."""
    whole = F.regexp_extract_all(text, F.lit(LOCATION), 0)
    parts = F.transform(whole, lambda x: F.struct(
        F.regexp_replace(F.regexp_extract(x, LOCATION, 1), "^<(.*)>$", "$1").alias("path"), F.expr("try_cast(0 as long)").alias("zero"),
        F.regexp_extract(x, LOCATION, 2).try_cast("long").alias("first"), F.coalesce(F.nullif(F.regexp_extract(x, LOCATION, 3), F.lit("")), F.regexp_extract(x, LOCATION, 2)).try_cast("long").alias("last")))
    return F.filter(parts, lambda p: (p["first"] >= 1) & (p["last"] >= p["first"]))


def safe_id(value: Column, other: str = "thread") -> Column:
    """Runs of unsafe characters become "-"; at most 80 characters."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(value), "[^A-Za-z0-9_.-]+", "-"), "^[.-]+|[.-]+$", "")
    return F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(other)), 1, 80)


def short_value(value: Column, most: int = 80) -> Column:
    clean = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, most - 1)), F.lit("...")))


def episode_terms(text: Column) -> Column:
    """Identifiers of three characters or more, for comparing tasks with earlier ones."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z][a-zA-Z0-9_]{2,}"), 0), lambda t: ~t.isin("the", "and", "for", "with", "this", "that", "from", "into")))


def skill_terms(text: Column) -> Column:
    """Tokens that keep their hyphens; "_" counts as one."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.translate(text, "_", "-"), F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), 0), F.lower), lambda t: ~t.isin(*STOP_WORDS)))


_CLAIM_STOP = "about after also because before claim code does evidence file from line show shows that this value with".split()


def claim_terms(text: Column) -> Column:
    """Words of a claim without their endings."""
    def stem(t: Column) -> Column:
        out = F.when(F.lit(False), "")
        for end in ("ing", "ed", "es", "s"):
            out = out.when((F.length(t) > len(end) + 3) & t.endswith(end), t.substr(F.lit(1), F.length(t) - len(end)))
        return out.otherwise(t)

    words = F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), 0)
    return F.array_distinct(F.transform(F.filter(words, lambda t: ~t.isin(*_CLAIM_STOP)), stem))


def domain_words(text: Column) -> Column:
    """Tokens and the parts between their hyphens, repeats kept."""
    raw = F.regexp_extract_all(F.translate(F.lower(text), "_", "-"), F.lit("[a-z][a-z0-9+.-]{1,}"), 0)
    return F.concat(raw, F.filter(F.flatten(F.transform(raw, lambda t: F.split(t, "-"))), lambda p: F.length(p) > 1))


#: Words in names of functions and files (fixed values).
GENERIC_NAMES = "base common data handle helper manager misc process processor run service thing tool util utils".split()
IGNORED_NAMES = "api app class component controller file function handler http method module page route service test".split()
DOMAIN_NAMES = "auth billing cache chart checkout compatibility config context cursor env invoice jwt notification otp pack payment ranking redis repo search session stats stripe summaries summary token watch webhook".split()
ACTION_NAMES = (
    "add apply build check collect create delete dispatch enrich explain extract fetch find generate get infer install issue load manage pack parse rank read refresh render "
    "resolve save scan score select send start stop summarize sync track update validate verify watch write"
).split()


def name_label(name: Column) -> Column:
    """generic, domain_revealing or neutral, by the tokens of a public name."""
    meaningful = F.filter(ordered_tokens(name), lambda t: (F.length(t) >= 3) & ~t.isin(*IGNORED_NAMES))
    n = F.size(meaningful)
    count = lambda words: F.size(F.filter(meaningful, lambda t: t.isin(*words)))
    generic, domain, action = count(GENERIC_NAMES), count(DOMAIN_NAMES), count(ACTION_NAMES)
    return (
        F.when((n == 1) & (generic == 1), "generic").when((domain > 0) & ((action > 0) | (n >= 2)), "domain_revealing")
        .when((n >= 2) & (generic == 0), "domain_revealing").when((generic > 0) & (generic == n), "generic").otherwise("neutral")
    )
