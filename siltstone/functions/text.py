"""Column functions over text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say little about a task (fixed values).
GENERIC = ("add", "and", "app", "are", "bug", "change", "code", "file", "fix", "for", "from", "improve", "issue", "make", "new", "support", "test", "that", "the", "this", "update", "with")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def ordered_tokens(text: Column) -> Column:
    """Camel case split, lower case, split at anything but ASCII letters and digits; order and repeats stay."""
    split = F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-zA-Z0-9]+")
    return F.filter(split, lambda t: t != "")


def task_terms(text: Column, least: int = 3) -> Column:
    """Lower-case terms of a task, without short and generic ones."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) >= least) & ~t.isin(*GENERIC))


def rarity(df: Column, n: Column) -> Column:
    """0 for a term in every document, towards 1 for rare ones; 1 where there is one document or none."""
    score = F.log((n + 1) / (df + 1)) / F.log(n + F.lit(1.0))
    return F.when(n <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def logistic_confidence(score: Column) -> Column:
    return 1 / (1 + F.exp(-(score - 45) / 15))


def first_line(text: Column) -> Column:
    """The first line that is neither empty nor a heading, with runs of space collapsed."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    return F.regexp_replace(F.trim(F.get(lines, F.lit(0))), "[ \\t]+", " ")
