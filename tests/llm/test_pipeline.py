"""The pipeline's stages, each on its predecessor's rows, against plain counts; and on odd rows."""

from collections import Counter

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import bpe, langid, pii
from siltstone.llm.queries import table, tokenizer_path
from siltstone.llm.storage import stored

SF = "/root/testdata/sf0.001"


def shingles(text):
    """Weighted five-word shingles of maximal runs of letters and digits, plainly."""
    words = "".join(c if (c.isascii() and c.isalnum()) or not c.isascii() else " " for c in (text or "").lower()).split(" ")
    words = [w for w in words if w]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def alike(a, b):
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 0.0


def test_stages_on_the_given_table(spark):
    docs = table(spark, SF, "documents")
    named = dict(cp.STAGES)
    one = stored(named["language"](spark, docs, SF), "test")
    model = langid.fit(docs)
    accepted = {r.doc_id for r in langid.predict(docs, model).filter("accepted").collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.select("doc_id").collect()} == accepted and len(accepted) > 150

    two = stored(named["near duplicates"](spark, one, SF), "test")
    before, after = ({r.doc_id: shingles(r.text) for r in df.collect()} for df in (one, two))
    left, gone = list(after), [k for k in before if k not in after]
    assert two.columns == docs.columns and gone
    pairs = [(i, j) for n, i in enumerate(left) for j in left[:n] if alike(after[i], after[j]) >= 0.8]
    assert not pairs
    assert all(any(alike(before[g], before[k]) >= 0.8 for k in before if k != g) for g in gone)

    three = stored(named["decontamination"](spark, two, SF), "test")
    items = [shingles(r.text) for r in table(spark, SF, "benchmark").collect()]
    kept = {r.doc_id for r in three.select("doc_id").collect()}
    holds = {k for k, s in after.items() if any(set(i) <= set(s) for i in items)}
    assert three.columns == docs.columns and holds and not holds & kept and len(kept) > 0.8 * len(after)

    four = stored(named["personal data"](spark, three, SF), "test")
    texts = {r.doc_id: r.text for r in three.collect()}
    own = pii.train()
    want = {k: pii.redacted(t, pii.spans_of([t], own, {})[0]) for k, t in texts.items()}
    got = {r.doc_id: (r.text, r.n_chars) for r in four.collect()}
    assert four.columns == docs.columns and {k: t for k, (t, _) in got.items()} == want and all(n == len(t) for t, n in got.values()) and want != texts

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    five = named["tokens"](spark, four, SF).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in five} == {k: library.encode(t, add_special_tokens=False).ids for k, t in want.items()}


def test_stages_on_odd_rows(spark):
    schema = table(spark, SF, "documents").schema.simpleString()[7:-1]
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (None, "no id here at all today", "en", "s", 3), (3, "word " * 40_000, "en", "s", 1), (4, "a b", "en", "s", 3), (4, "a b", "en", "s", 3), (6, "\n \t\n", "en", "s", 1)]
    odd = spark.createDataFrame(rows, schema.replace(":", " ").replace(",", ", "))
    odd = odd.withColumns({"label": F.lit("x"), "item_id": F.lit(1), "n_tokens": F.lit(2), "shingle": F.lit(3)})
    for df in (odd, odd.limit(0)):
        docs = df
        for name, stage in cp.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF), f"odd-{name.replace(' ', '-')}")
            assert docs.columns == odd.columns
        assert cp.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_tokens_and_personal_data_through_spark(spark):
    texts = [None, "", "x" * 60_000, "mail a.b@c.de or 10.0.0.1", "mail a.b@c.de or 10.0.0.1", "日本語 é 😀"]
    df = spark.createDataFrame([(1 if t and t.startswith("mail") else k, t, "x", 5) for k, t in enumerate(texts)], "doc_id long, text string, ids string, pii int").repartition(3)
    coded = bpe.encode(df, tokenizer_path(), decoded=True).collect()
    assert Counter(r.decoded for r in coded) == Counter(t or "" for t in texts) and len(coded) == len(texts)
    found = pii.find(df).collect()
    assert Counter(len([s for s in r.pii if s.base]) for r in found) == {0: 4, 2: 2}
    assert bpe.encode(df.limit(0), tokenizer_path()).count() == pii.find(df.limit(0)).count() == 0
