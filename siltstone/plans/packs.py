"""Queries of the registry of selections, with DuckDB's SQL.  A source's pack takes its longest texts into a budget."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import source as C
from siltstone.operators import registry as G
from siltstone.operators.replacements import by_score
from siltstone.plans.overview import SECRET
from siltstone.plans.registry import query
from siltstone.plans.source import CODE, CODE_TEXT
from siltstone.sources.repository import files
from siltstone.sources.shared import folder, written

BUDGET = 20_000
_LINES = "string_split({0}, chr(10))"


def _view(mode: str, text: str) -> str:
    lines = _LINES.format(text)
    if mode == "summary":
        return f"array_to_string(list_filter(list_transform({lines}, lambda x: trim(x)), lambda x: x <> '')[:40], chr(10))"
    kept = f"list_filter({lines}, lambda x: regexp_matches(x, '{C.VIEWS[mode]}'))"
    return f"case when len({kept}) > 0 then array_to_string({kept}, chr(10)) else substr({text}, 1, 4000) end"


_ID = "replace({0}, '/', '__') || ':' || left({1}, 12)"
_NAME = "(?m)^def (\\w+)"
_PACK = f"""{CODE}, texts as (select c.path, c.doc_id, c.text, f.source pack, sha256(c.text) hash, greatest(1, length(c.text) // 4) tokens, length(c.text)::double score from code c join files f using (doc_id) where f.source is not null),
chosen as (select *, case doc_id % 3 when 0 then 'full' when 1 then 'skeleton' else 'summary' end "mode", sum(tokens) over (partition by pack order by score desc) <= {BUDGET} selected from texts),
taken as (select *, case "mode" when 'full' then text when 'skeleton' then {_view('skeleton', 'text')} end content, case when "mode" = 'summary' then {_view('summary', 'text')} end summary from chosen where selected),
named as (select *, regexp_extract(text, '{_NAME}', 1) name from taken where "mode" = 'skeleton'),
own as (select pack, path, coalesce(content, summary) body, "mode", hash, doc_id, score, summary from taken),
recs as (select pack, {_ID.format('path', "sha256(case when body <> '' then body else path end)")} block_id, path, 'selected' kind, "mode", null symbol, hash file_hash, sha256(case when body <> '' then body else path end) content_hash, case when body <> '' then greatest(1, length(body) // 4) else 0 end::bigint tokens, score, summary,
    case when "mode" <> 'summary' and body <> '' then body end stored, 0 k, doc_id step, -1 n from own
  union all select pack, {_ID.format("path || '::' || name", "sha256(path || ':' || name || ':' || name)")}, path, 'selected', 'symbol', name, hash, sha256(path || ':' || name || ':' || name), greatest(1, length(name) // 4), score, null, name, 0, doc_id, 1 from named where name <> ''
  union all select pack, {_ID.format('path', "sha256(path || ':' || hash || ':' || 'budget exhausted')")}, path, 'omitted', 'skeleton', null, hash, sha256(path || ':' || hash || ':' || 'budget exhausted'), tokens, score, 'budget exhausted', null, 1, doc_id, -1 from chosen where not selected and tokens > 100)"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files, what a pack takes of them, what it leaves out, and symbols."""
    text = F.col("text")
    # the texts are made once: what follows reads them several times
    made = files(spark, sf_dir).filter("source is not null").select("path", "doc_id", F.col("source").alias("pack"), F.expr(CODE_TEXT).alias("text"))
    texts = written(made.withColumns({"hash": F.sha2("text", 256), "tokens": F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long"), "score": F.length(text).cast("double")}), "texts")
    mode = F.when(F.col("doc_id") % 3 == 0, "full").when(F.col("doc_id") % 3 == 1, "skeleton").otherwise("summary")
    # one score for each pack says what fits: it goes to the texts, which are not shuffled for it
    least = by_score(texts.select("pack", "score", "tokens"), "pack").filter(F.col("used") <= BUDGET).groupBy("pack").agg(F.min("score").alias("least"))
    fits = F.coalesce(F.col("score") >= F.col("least"), F.lit(False))
    chosen = texts.join(F.broadcast(least), "pack", "left").withColumns({"step": F.col("doc_id"), "mode": mode, "selected": fits, "reasons": F.array(F.lit("length"))})
    content = F.when(F.col("mode") == "full", text).when(F.col("mode") == "skeleton", C.view(text, "skeleton"))
    taken = chosen.filter("selected").withColumns({"content": content, "summary": F.when(F.col("mode") == "summary", C.view(text, "summary"))})
    left = chosen.filter("not selected and tokens > 100").withColumns({"mode": F.lit("skeleton"), "reason": F.lit("budget exhausted")})
    names = taken.filter("mode = 'skeleton'").select("pack", "path", F.lit(1).alias("n"), F.regexp_extract("text", _NAME, 1).alias("name"), F.lit(None).cast("string").alias("body")).filter("name != ''")
    return texts, taken, left, names


@query(f"""with {_PACK} select pack, block_id, path, kind, "mode", symbol, file_hash, content_hash, tokens, score, sha256(stored) stored, row_number() over (partition by pack order by k, step, n)::int place from recs""")
def pack_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each source's pack, in their order."""
    texts, taken, left, names = _inputs(spark, sf_dir)
    found = G.records(taken, left, texts, names)
    return found.select("pack", "block_id", "path", "kind", "mode", "symbol", "file_hash", "content_hash", "tokens", "score", "stored", F.row_number().over(Window.partitionBy("pack").orderBy("place")).alias("place"))


@query(
    f"""with {_PACK}, now as (select path, text, sha256(text) hash, regexp_replace(text, '{SECRET}', '\\1[REDACTED:api-key]', 'g') clean from (select path, case when doc_id % 7 = 3 then text || chr(10) || 'def added_later(x):' else text end text from texts where doc_id % 11 <> 5)),
asked as (select pack || '|' || path id, pack, path, null block_id, doc_id, case doc_id % 5 when 0 then 'as_stored' when 1 then 'full' when 2 then 'skeleton' when 3 then 'symbols' else 'summary' end "view", doc_id % 2 = 0 allow from texts
  union all select pack || '|' || block_id, pack, null, block_id, step, 'as_stored', false from recs),
hit as (select a.id, a."view", a.allow, r.*, row_number() over (partition by a.id order by r.k, r.step, r.n) pick from asked a left join recs r on r.pack = a.pack and (r.path = a.path or r.block_id = a.block_id)),
one as (select *, case when "view" = 'as_stored' and coalesce(stored, summary, '') <> '' then coalesce(stored, summary) end kept from hit where pick = 1),
st as (select o.*, n.clean, case when o.path is null then 'no record' when kept is not null then 'stored' when n.path is null then 'gone' when n.hash <> file_hash and not allow then 'stale' when n.hash <> file_hash then 'stale-current' else 'current' end status from one o left join now n using (path))
select id, status, block_id, "mode", coalesce(tokens, 0)::bigint tokens, sha256(case when status = 'stored' then kept when status in ('current', 'stale-current') then case "view" when 'skeleton' then {_view('skeleton', 'clean')} when 'symbols' then {_view('symbols', 'clean')} when 'summary' then {_view('summary', 'clean')} else clean end end) content from st"""
)
def pack_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry is saved and loaded; every file is asked for by its path and every record by its block, after some files changed and some went."""
    texts, taken, left, names = _inputs(spark, sf_dir)
    place = f"{folder(spark)}/registry-{uuid.uuid4().hex}"
    G.save(G.records(taken, left, texts, names), G.contents(taken, names), place, "1")
    found, kept = G.load(spark, place)
    k = F.col("doc_id")
    later = F.when(k % 7 == 3, F.concat("text", F.lit("\ndef added_later(x):"))).otherwise(F.col("text"))
    now = texts.filter("doc_id % 11 != 5").select("path", later.alias("text")).withColumn("hash", F.sha2("text", 256))
    view = F.when(k % 5 == 0, "as_stored").when(k % 5 == 1, "full").when(k % 5 == 2, "skeleton").when(k % 5 == 3, "symbols").otherwise("summary")
    null = F.lit(None).cast("string")
    by_path = texts.select(F.concat_ws("|", "pack", "path").alias("id"), "pack", "path", null.alias("block_id"), view.alias("mode"), (k % 2 == 0).alias("allow_stale"))
    by_block = found.select(F.concat_ws("|", "pack", "block_id").alias("id"), "pack", null.alias("path"), "block_id", F.lit("as_stored").alias("mode"), F.lit(False).alias("allow_stale"))
    got = G.retrieve(found, kept, by_path.unionByName(by_block), now)
    return got.select("id", "status", "block_id", "mode", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.sha2("content", 256).alias("content"))
