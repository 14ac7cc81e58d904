"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, chat, decontaminate, divergence, langid, licenses, neardup, negatives, pii, quality, rules, sharding, toxicity
from siltstone.llm.labels import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(pii, s -> s.base and s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).withColumn("kept", neardup.kept())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(fold("doc_id", 5) != 0)))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.judge(docs, rules.fit(docs, labels.filter(fold("doc_id", 5) != 0)))


#: The conversation that op10_chat adds to the table: control strings of templates inside texts.
PROBE = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = lambda k, role: spark.range(1).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(k).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text"))
    return chat.digests(chat.examples(rows.unionByName(turn(0, "user")).unionByName(turn(1, "assistant"))))


_CHAT_SQL = """
with rows_ as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
sized as (
  select *, row_number() over w k, count(*) over (partition by conv_id) n,
    sum(length(replace(replace(replace(text, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t')) + length(replace(replace(replace(replace(replace(role, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t'), ':', '\\c'), chr(10), '\\n')) + 14) over (w rows unbounded preceding) until_
  from rows_ window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) loss_sha256,
  (coalesce(sum(until_) filter (role = 'assistant'), 0) + coalesce(sum(until_) filter (k = n and role <> 'assistant'), 0))::bigint formatted_chars
from sized group by conv_id"""


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assigned(table(spark, sf_dir, "documents"), sharding.balanced(16))
    slotted = sharding.slotted(placed, ["doc_id", "size", "text_crc32"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_neardup": op3_neardup,
    "op4_toxicity": op4_toxicity,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_langid": op7_langid,
    "op8_rules": op8_rules,
    "op9_decontamination": op9_decontamination,
    "op10_chat": op10_chat,
    "op11_sharding": op11_sharding,
    "op12_negatives": op12_negatives,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op5_licenses": licenses.oracle(),
    "op10_chat": _CHAT_SQL,
    "op11_sharding": sharding.oracle(),
    "op12_negatives": negatives.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
