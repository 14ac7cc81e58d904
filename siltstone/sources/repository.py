"""Documents seen as the files of a repository: a path for each row, from which path operators work.

The mapping is one SQL expression that Spark and DuckDB both read: directories, prefixes, suffixes
and extensions follow the number of the document, words of its text give the stem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import estimate_tokens
from siltstone.sources.tables import table

#: Parts of paths (fixed values of the mapping).
DIRECTORIES = (
    "src", "src/api/users", "tests", "docs", "docs/adr", "packages/web/src/pages", "packages/web/__tests__", "config",
    "examples/demo", ".github/workflows", "vendor/lib", "internal/service", "app/api/orders/[id]", "fixtures", "playground/one", "lib/handlers",
)
PREFIXES = ("", "", "test_", "", "config_", "adr-1-", "")
SUFFIXES = ("", "_test", "", ".test", "")
EXTENSIONS = (".py", ".ts", ".tsx", ".md", ".json", ".go", ".java", ".yml", "")
MANIFESTS = ("pyproject.toml", "package.json", "cargo.toml", "__init__.py", "version.py", "yarn.lock", "setup.cfg")


def _pick(values: tuple[str, ...], modulus: int) -> str:
    return f"split_part('{','.join(values)}', ',', cast(doc_id % {modulus} as int) + 1)"


def _word(k: int) -> str:
    return f"regexp_extract(coalesce(text, ''), '([a-z]{{3,}}) ([a-z]{{3,}})', {k})"


PATH = (
    "case when doc_id = 11 then 'pom.xml' when doc_id = 13 then 'gradle.properties' when doc_id % 97 = 5 then concat('.git/objects/', cast(doc_id as string))"
    f" when doc_id % 41 = 7 then concat('services/s', cast(doc_id as string), '/', {_pick(MANIFESTS, 7)})"
    f" else concat({_pick(DIRECTORIES, 16)}, '/', {_pick(PREFIXES, 7)}, {_word(1)}, '_', {_word(2)}, '_', cast(doc_id as string), {_pick(SUFFIXES, 5)}, {_pick(EXTENSIONS, 9)}) end"
)
#: The view as a common table expression of DuckDB.
FILES = f"files as (select doc_id, {PATH} path, text, lang, source, n_chars, greatest(1, length(text) // 4) tokens, sha256(text) hash from documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text, lang, source, n_chars, tokens and hash of each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.expr(PATH).alias("path"), "text", "lang", "source", "n_chars",
        estimate_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("hash"),
    )

#: Openings that make tasks of the users' turns (fixed values of the mapping).
OPENINGS = (
    "fix(api-orders): ", "add tests for ", "refactor: clean up the ", 'update "user settings" page of ', "investigate failing build in ", "release version bump for ",
    "review #12 and GH-34 diff of ", "`rate_limit/backoff` issues at src/app.py:10-12 and ABC-9 with ", "explain repo ",
)
TASK = f"concat(split_part('{'|'.join(OPENINGS)}', '|', cast((conv_id + turn) % {len(OPENINGS)} as int) + 1), text)"
TASKS = f"tasks as (select conv_id * 1000 + turn task_id, {TASK} task from conversations where role = 'user' and text is not null)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id and task: the users' turns, opened as tasks of a repository are."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user' and text is not null")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), F.expr(TASK).alias("task"))
