"""Where statements come from: citations against texts, claims against cited lines, changed ranges of diffs, exact redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.tasks import claim_terms
from siltstone.operators.relations import PLACEHOLDER, SECRETS


def validate(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """citations (id, doc_id, kind, first, last, hash, support, url, retrieved) with `status`: the first check that fails, else valid.

    Of a text: no line, missing, stale, line outside, range, range outside, support; of an external one: url,
    provenance, support without hash.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    facts = docs.select("doc_id", F.sha2("text", 256).alias("now"), F.split("text", "\n").alias("lines"))
    n = F.greatest(F.size("lines"), F.lit(1))
    span = F.array_join(F.slice("lines", F.col("first"), F.coalesce("last", "first") - F.col("first") + 1), "\n")
    outside = F.when(~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), "url").when(F.col("retrieved").isNull() & F.col("hash").isNull(), "provenance").when(F.col("support").isNotNull() & F.col("hash").isNull(), "support without hash").otherwise("valid")
    inside = (
        F.when(F.col("first").isNull(), "no line").when(F.col("now").isNull(), "missing").when(F.col("hash").isNotNull() & (F.col("hash") != F.col("now")), "stale")
        .when((F.col("first") < 1) | (F.col("first") > n), "line outside").when(F.col("last") < F.col("first"), "range").when(F.col("last") > n, "range outside")
        .when(F.col("support").isNotNull() & ~F.contains(flat(span), flat(F.col("support"))), "support").otherwise("valid")
    )
    status = F.when(F.col("kind") == "external", outside).otherwise(inside)
    return citations.join(facts, "doc_id", "left").select(*citations.columns, status.alias("status"))


def missing_claims(citations: DataFrame, required: DataFrame) -> DataFrame:
    """The required claims (claim) that no citation (claim) carries."""
    return required.select("claim").distinct().join(citations.select("claim"), "claim", "left_anti")


def supported(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """citations (id, doc_id, first, last, claim) with `overlap`: how many of the claim's terms the cited lines hold, by their stems."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    span = F.array_join(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n")
    both = F.array_intersect(claim_terms(F.col("claim")), claim_terms(span))
    return citations.filter("first >= 1 and last >= first").join(lines, "doc_id").select("id", "doc_id", F.size(both).alias("overlap"))


def changed_ranges(diffs: DataFrame) -> DataFrame:
    """(path, first, last, n): runs of added lines in the new text, of diffs (path, line, value); line is the order.

    A hunk's heading sets the number; added lines and context count on, removed ones and notes don't.  A run
    ends at anything but an added line.
    """
    order = Window.partitionBy("path").orderBy("line")
    v = F.col("value")
    start = F.regexp_extract("value", r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@", 1)
    rows = diffs.withColumn("start", F.when(start != "", start.cast("long"))).withColumn("hunk", F.sum((F.col("start").isNotNull()).cast("int")).over(order)).filter("hunk > 0")
    inner = Window.partitionBy("path", "hunk").orderBy("line")
    added = v.startswith("+") & ~v.startswith("+++")
    counts = (F.col("start").isNull() & ~v.startswith("\\") & ~(v.startswith("-") & ~v.startswith("---"))).cast("int")
    rows = rows.withColumn("added", F.col("start").isNull() & added).withColumn("at", F.max("start").over(Window.partitionBy("path", "hunk")) + F.sum(counts).over(inner) - 1)
    rows = rows.filter(F.col("start").isNull() & ~v.startswith("\\")).withColumn("run", F.sum((~F.col("added")).cast("int")).over(inner))
    return rows.filter("added").groupBy("path", "hunk", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).select("path", "first", "last", "n")


_REDACTED = tuple((label, re.compile(p), group) for label, p, group in SECRETS if label != "quoted-value")
_PLACEHOLDER = re.compile(PLACEHOLDER)
#: Whether there is any, for Arrow's RE2, which writes characters otherwise.
_ANY = "|".join(re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", f"(?:{p.pattern})") for _, p, _ in _REDACTED)


def _clean(text: str) -> tuple[str, list[str]]:
    spans: list[tuple[int, int, str]] = []
    notes = []
    for label, pattern, group in _REDACTED:
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if _PLACEHOLDER.search(m.group(group)) or any(a < d and b > c for c, d, _ in spans):
                continue
            spans.append((a, b, label))
            notes.append(f"{label} (line {text.count(chr(10), 0, a) + 1})")
    out, done = [], 0
    for a, b, label in sorted(spans):
        out += [text[done:a], f"[REDACTED:{label}]"]
        done = b
    return "".join([*out, text[done:]]), notes


def redact_secrets(rows: DataFrame, column: str = "text") -> DataFrame:
    """rows with [REDACTED:kind] in the place of each secret of a column, and last `warnings`: "kind (line n)" for each, in the order of the kinds.

    Of values that overlap, the earlier kind's counts; placeholders stay.  Null texts stay null.  Only texts that Arrow finds a secret in are taken apart.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("warnings", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column)
            held = pc.fill_null(pc.match_substring_regex(texts, _ANY), False)
            got = [_clean(t) for t in texts.filter(held).to_pylist()]
            notes: list[list[str]] = [[]] * len(texts)
            for k, (_, n) in zip(pc.indices_nonzero(held).to_pylist(), got):
                notes[k] = n
            clean = pc.replace_with_mask(texts, held, pa.array([t for t, _ in got], texts.type)) if got else texts
            columns = [clean if f.name == column else batch.column(f.name) for f in rows_fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(notes, pa.list_(pa.string()))], schema.names)

    rows_fields = rows.schema.fields
    return rows.mapInArrow(run, schema)


#: Keywords of a task at most.
KEYWORDS = 500


def hunks_within(diffs: DataFrame, keywords: DataFrame, budget: int) -> DataFrame:
    """(path, text, kept, omitted) of diffs (path, text): headers, and the hunks that say most for the task as long as they fit.

    keywords: (term).  A hunk's worth is a hundred for each keyword of three letters or more that it holds, and one for each
    changed line; ties go to the earlier hunk.  A hunk that doesn't fit is passed over, later ones may fit; where not even the
    best one does, its lines are cut.  Hunks come back in their order, after a line that tells how many were left out.
    A file's hunks are one row.
    """
    words = [r["term"] for r in keywords.select(F.lower("term").alias("term")).filter(F.length("term") >= 3).distinct().limit(KEYWORDS + 1).collect()]
    if len(words) > KEYWORDS:
        raise ValueError(f"more than {KEYWORDS} keywords")
    lines = F.split("text", "\n")
    starts = F.filter(F.transform("lines", lambda x, i: F.when(x.startswith("@@"), i)), lambda i: i.isNotNull())
    rows = diffs.select("path", lines.alias("lines")).withColumn("starts", starts).withColumn("n", F.size("starts"))
    cut = F.when(F.col("n") > 0, F.slice("lines", F.lit(1), F.col("starts")[0])).otherwise(F.col("lines"))
    end = lambda k: F.when(k + 1 < F.col("n"), F.get("starts", k + 1)).otherwise(F.size("lines"))
    parts = F.transform("starts", lambda s, k: F.slice("lines", s + 1, end(k) - s))
    rows = rows.withColumn("header", F.array_join(cut, "\n")).withColumn("parts", parts)
    low = lambda h: F.lower(F.array_join(h, "\n"))
    hits = lambda h: sum((low(h).contains(w).cast("int") for w in words), F.lit(0))
    changed = lambda h: F.size(F.filter(h, lambda x: x.rlike(r"^(\+(?!\+\+)|-(?!--))")))
    hunk = lambda h, k: F.struct((-(hits(h) * 100 + changed(h))).alias("v"), k.alias("k"), F.array_join(h, "\n").alias("body"))
    rows = rows.select("path", "lines", "n", "header", F.array_sort(F.transform("parts", hunk)).alias("hunks"))
    # the length of what is kept, with a line's end between parts
    start = F.struct(F.length("header").alias("size"), F.array().cast("array<struct<k:int,body:string>>").alias("kept"))

    def step(a: Column, h: Column) -> Column:
        size = a["size"] + F.length(h["body"]) + F.when(a["size"] > 0, 1).otherwise(0)
        fits = F.greatest(F.lit(1), F.floor(size / 4)) <= budget
        return F.struct(F.when(fits, size).otherwise(a["size"]).cast("int").alias("size"), F.when(fits, F.array_append(a["kept"], F.struct(h["k"].alias("k"), h["body"].alias("body")))).otherwise(a["kept"]).alias("kept"))

    rows = rows.withColumn("kept", F.array_sort(F.aggregate("hunks", start, step)["kept"]))
    none = (F.size("kept") == 0) | (F.col("n") == 0)
    omitted = F.when(none, F.greatest(F.lit(0), F.col("n") - 1)).otherwise(F.col("n") - F.size("kept"))
    told = F.when(omitted > 0, F.array(F.concat(F.lit("... "), omitted, F.lit(" less relevant diff hunk(s) omitted ..."))))
    head = F.when(F.col("header") != "", F.array("header"))
    empty = F.array().cast("array<string>")
    whole = F.array_join(F.concat(F.coalesce(head, empty), F.coalesce(told, empty), F.transform("kept", lambda h: h["body"])), "\n")
    best = F.array_join(F.concat(F.coalesce(head, empty), F.coalesce(F.array(F.get("hunks", F.lit(0))["body"]), empty)), "\n")
    # lines as long as they fit
    fit = F.aggregate(F.split(best, "\n"), F.lit(""), lambda a, x: F.when(F.length(a) + F.length(x) + 1 <= budget * 4, F.concat(a, x, F.lit("\n"))).otherwise(a))
    text = F.when(F.col("n") == 0, F.when(F.length("header") <= budget * 4, F.col("header")).otherwise(F.rtrim(fit))).when(none, F.regexp_replace(fit, "\n$", "")).otherwise(whole)
    return rows.select("path", text.alias("text"), F.when(none, F.least(F.lit(1), F.col("n"))).otherwise(F.size("kept")).alias("kept"), omitted.alias("omitted"))
