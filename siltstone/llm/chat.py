"""Chat formatting by prefix-target expansion, in Spark's own functions.

A turn becomes `### role:`, a new line, its text and `</turn>` with a new line.
In texts and roles a backslash becomes `\\b`, `###` becomes `\\h` and `</turn>`
becomes `\\t` (in roles also `:` `\\c` and a new line `\\n`), so no control
string of the template is left in them and the way back is unique.

Every assistant turn makes one example: all turns before it as context, and
only its reply trainable.  Turns after the last reply make one more example
without a trainable part, so that the examples hold the whole conversation.

Turns are ordered by `turn`, ties by role and text; repeated rows are turns of
their own.  Null texts and roles are empty; rows with a null conv_id are one
conversation.  A conversation is one sequence and so is put together in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLY = "assistant"
OPEN, BREAK, CLOSE = "### ", ":\n", "</turn>\n"
_TEXT = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
_ROLE = (*_TEXT, (":", "\\c"), ("\n", "\\n"))


def _escaped(c: Column, pairs: tuple) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _plain(c: Column, pairs: tuple) -> Column:
    """Codes last to first: a backslash starts a code everywhere, so none can be mistaken, and `\\b` comes last."""
    for plain, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, last, text, loss_start, loss_end): places are code points from 0, ends exclusive."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), _escaped(t["role"], _ROLE), F.lit(BREAK))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), _escaped(t["text"], _TEXT).alias("body"), (t["role"] == REPLY).alias("reply")))
    written = turns.select("conv_id", parts.alias("parts")).select("conv_id", "parts", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("whole"))
    # where each turn ends, by a running sum over the parts
    step = lambda a, p: F.struct(
        (a["end"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).cast("long").alias("end"),
        F.when(p["reply"], F.array_append(a["found"], F.struct((a["end"] + F.length(p["head"])).cast("long").alias("start"), (a["end"] + F.length(p["head"]) + F.length(p["body"])).cast("long").alias("stop")))).otherwise(a["found"]).alias("found"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)").alias("found"))
    spans = F.aggregate("parts", zero, step)
    placed = written.select("conv_id", "whole", spans.alias("s")).select("conv_id", "whole", F.col("s.end").alias("end"), F.col("s.found").alias("found"))
    # a span without length at the end stands for the turns after the last reply
    tail = F.size("found") == 0
    tail = tail | (F.element_at("found", -1)["stop"] + len(CLOSE) < F.col("end"))
    every = F.when(tail, F.array_append("found", F.struct(F.col("end").alias("start"), F.col("end").alias("stop")))).otherwise(F.col("found"))
    rows = placed.select("conv_id", "whole", "end", every.alias("found")).select("conv_id", "whole", "end", F.size("found").alias("n"), F.posexplode("found").alias("example", "x"))
    until = F.least(F.col("x.stop") + len(CLOSE), F.col("end"))
    return rows.select("conv_id", F.col("example").cast("long").alias("example"), (F.col("example") == F.col("n") - 1).alias("last"), F.substring("whole", F.lit(1), until.cast("int")).alias("text"), F.col("x.start").alias("loss_start"), F.col("x.stop").alias("loss_end"))


def trained(text: str = "text") -> Column:
    """The text under an example's loss mask, as the assistant wrote it."""
    return _plain(F.substring(text, (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")), _TEXT)


def turns_of(text: str = "text") -> Column:
    """The turns (role, text) that an example's text holds."""
    whole = F.filter(F.split(text, CLOSE), lambda p: p.startswith(OPEN))
    role = lambda p: F.substring_index(F.substring(p, len(OPEN) + 1, 2**30), BREAK, 1)
    body = lambda p: F.substring(p, F.length(role(p)) + len(OPEN) + len(BREAK) + 1, F.lit(2**30))
    return F.transform(whole, lambda p: F.struct(_plain(role(p), _ROLE).alias("role"), _plain(body(p), _TEXT).alias("text")))


def digests(found: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: number and digest of its turns, length and digest of what is trained."""
    told = F.when(F.col("last"), turns_of())
    own = found.select("conv_id", "example", trained().alias("reply"), F.length("text").cast("long").alias("chars"), told.alias("turns"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    own = own.select("conv_id", "example", "reply", "chars", F.size("turns").cast("long").alias("n"), F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("sha"))
    whole = own.groupBy("conv_id").agg(
        F.max(F.when(F.col("sha").isNotNull(), F.col("n"))).alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"), F.sum("chars").alias("formatted_chars")
    )
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    whole = whole.select("conv_id", "n_turns", "turns_sha256", loss.alias("loss"), "formatted_chars")
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
