"""From raw documents to token ids: five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Extra columns go along, whatever their names; an empty table stays
empty; texts of any length are worked on whole.  tests/llm/test_pipeline.py holds every stage against plain counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontaminate, langid, neardup, pii
from siltstone.llm.queries import table, tokenizer_path
from siltstone.llm.storage import stored


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: null, empty and letterless texts and those below the learned score go; repeated rows and ties share their fate."""
    return langid.accepted(docs, langid.fit(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: of equal rows one stays, ties go to the least id; null texts and those without words are copies of each other; rows with a null id stay."""
    return neardup.deduplicate(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: null and empty texts hold none and stay; rows with a null or repeated id are judged each by its text."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind: every row stays, null texts stay null, n_chars follows."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of each document, packed, with the digest of the text that they decode to; nulls are encoded as empty texts."""
    coded = bpe.encode(docs, tokenizer_path(), decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", identify), ("near duplicates", deduplicate), ("decontamination", clean), ("personal data", redact), ("tokens", encode)]

#: The classifier, the candidate search and the encoder have no SQL form; tests/llm/test_pipeline.py holds each stage against plain counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
