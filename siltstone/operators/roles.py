"""Domains and roles of files by the votes of functions.roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import roles as O
from siltstone.functions.source import SYSTEMS
from siltstone.operators.marks import marked
from siltstone.operators.symbols import SYMBOL_LIST, symbol_lists

#: What imports look like in the languages whose rules ask for them: the module of each statement (fixed values).
IMPORTS = {"python": r"(?m)^\s*(?:import|from)\s+([\w.]+)", "javascript": r"(?m)^import\s+[^\n]*?[\"']([^\"']+)[\"']"}


def assigned(files: DataFrame, language: str) -> DataFrame:
    """files (path, text, ...) of one language with symbols, entries, systems, votes, domain, role and words.

    The domain is null where nothing votes for one.  Null texts are as empty ones; a null path has null words and, without votes, a null role.
    One Arrow pass looks for all patterns and words; what is taken out of texts by columns is looked for in those alone that can hold it.
    Each further step is a column of its own, which the next ones read: nothing is computed twice, nothing is shuffled.
    """
    c, none = F.col, F.array().cast("array<string>")
    cases = {"systems": ("_low", SYSTEMS)} | ({"_gates": ("text", gates)} if (gates := O.entry_gates(language)) else {})
    held = {"_words": ("text", tuple(O.wanted("any"))), "_outer": ("text", tuple(O.wanted("import")))}
    rows = marked(files.withColumn("_low", F.lower("text")), cases, ("_low",), held=held, more=(SYMBOL_LIST, lambda batch: symbol_lists(batch.column("text"), language)))
    # names of imports are parts of the text between ends of words, so without a word that rules look for there is nothing to see
    found = F.when(F.size("_outer") > 0, F.regexp_extract_all("text", F.lit(IMPORTS[language]), 1)).otherwise(none) if language in IMPORTS else none
    rows = rows.withColumns({"entries": O.entries(c("path"), F.coalesce("text", F.lit("")), language, c("_gates") if gates else None), "_imports": found})
    rows = rows.withColumn("_found", O.signals(c("path"), c("_words"), c("symbols.name"), c("_imports"), c("entries"), c("systems")))
    rows = rows.withColumn("_signals", O.with_pairs(c("_found")))
    rows = rows.withColumn("votes", O.votes(c("_signals")))
    rows = rows.withColumns({"domain": O.winner(c("votes"), "domain"), "role": F.coalesce(O.winner(c("votes"), "role"), O.plain_role(c("path"), c("symbols"), c("entries")))})
    rows = rows.withColumn("words", O.keywords(c("domain"), c("role"), c("entries"), c("systems"), c("symbols.name")))
    return rows.select(*files.columns, "symbols", "entries", "systems", "votes", "domain", "role", "words")
