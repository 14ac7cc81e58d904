"""Operators 11 to 13 against DuckDB on the given tables, and against plain loops on odd rows."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import divergence, negatives, queries, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, rank int, label string, shard string, n long"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", 1) for r in rows], DOCS)


ODD = [
    (1, "Alpha beta alpha", "en", "a"), (1, "Alpha beta alpha", "en", "a"), (1, "Alpha beta alpha", "en", "a"), (2, "Alpha beta alpha", "en", "b"), (3, None, "en", "c"), (4, "", None, None), (None, "É été x-y", "fr", "a"),
    (5, "beta " * 20_000, "en", "b"), (6, "gamma Δelta", "en", "a"), (7, "alpha", "en", "a"), (8, "zeta", None, "b"), (9, "zeta", "", ""), (10, "1234 !?", "de", "a"),
]


@pytest.mark.parametrize("name", ["op11_sharding", "op12_negatives", "op13_divergence"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values.tolist())) == sorted(map(tuple, want.astype(str).values.tolist())) and len(got)


# --- shards


def slots(spark, rows):
    return sharding.slotted(sharding.assigned(docs_of(spark, rows), sharding.balanced(16)), ["doc_id", "size", "text_crc32"]).collect()


def test_odd_rows_have_gapless_slots(spark):
    rows = slots(spark, ODD * 30)
    assert len(rows) == len(ODD) * 30
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    texts = {k: t or "" for k, t, _, _ in ODD if k is not None and k != 1}
    for r in rows:
        if r.doc_id in texts:
            assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert slots(spark, []) == []


def test_shares_and_movement(spark):
    tree = sharding.balanced(16)
    heavy = sharding.reweighted(tree, 0, 1, 5, 3.0)
    light = sharding.reweighted(tree, 1, 2, 9, 0.0)
    keys = spark.range(20_000).select(*[sharding.shard_of("id", t).alias(n) for n, t in (("now", tree), ("grown", sharding.grown(tree)), ("heavy", heavy), ("light", light), ("twice", sharding.grown(sharding.grown(tree))))]).toPandas()
    shares = keys.now.value_counts() / len(keys)
    assert len(shares) == 16 and shares.between(0.055, 0.07).all()
    moved = keys[keys.now != keys.grown]
    assert (moved.grown == 16).all() and 0.05 < len(moved) / len(keys) < 0.07
    again = keys[keys.grown != keys.twice]
    assert (again.twice == 17).all() and len(again)
    # a greater weight draws rows into its region (shards 0 to 7), its rack (4 to 7) and itself alone
    region, rack = lambda s: s // 8, lambda s: s // 4
    moved = keys[keys.now != keys.heavy]
    assert (region(moved.heavy) == 0).all()
    inside = moved[region(moved.now) == 0]
    assert (rack(inside.heavy) == 1).all() and (inside[rack(inside.now) == 1].heavy == 5).all()
    assert abs((keys.heavy == 5).mean() - 3 / 18) < 0.01
    assert not (keys.light == 9).any() and (region(keys.now[keys.now != keys.light]) == 1).all()
    assert spark.range(1).select(sharding.shard_of("id", {}).alias("x")).first().x is None


# --- negatives


def test_scores_are_exact():
    rng = np.random.default_rng(5)
    for width, size in ((1, 10), (64, 150), (64, 2**20), (300, 2**25), (7, 2**29), (0, 1)):
        a, b = (rng.integers(-size, size + 1, (n, width)) for n in (5, 9))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert negatives.scores(negatives.Residues(a), negatives.Residues(b)).tolist() == want
    big = np.full((1, 2), 2**31)
    with pytest.raises(ArithmeticError):
        negatives.scores(negatives.Residues(big), negatives.Residues(big))


def plain(rows, anchor, n_pos=5, n_neg=5):
    """The contract, row by row."""
    usable = [(i, str(g), [int(np.floor(256 * float(x))) for x in v]) for i, g, v in rows if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, g, v) in enumerate(usable):
        if not anchor(i):
            continue
        dot = [sum(x * y for x, y in zip(v, w, strict=False)) for _, _, w in usable]
        order = sorted((j for j in range(len(usable)) if j != k), key=lambda j: (-dot[j], usable[j][0]))  # noqa: B023
        for p in [j for j in order if usable[j][1] == g][:n_pos]:
            bad = [j for j in order if usable[j][1] != g and 80 * dot[p] <= 100 * dot[j] <= 100 * dot[p]]
            out += [(i, usable[p][0], r + 1, usable[j][0], dot[p], dot[j]) for r, j in enumerate(bad[:n_neg])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_odd_vectors_against_a_plain_loop(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "CELLS", 7)
    rows = [(int(i), int(g), [float(x) for x in np.round(v, 1)]) for i, g, v in zip(rng.integers(0, 40, 70), rng.integers(0, 3, 70), rng.normal(0.3, 0.5, (70, 4)), strict=True)]
    rows += rows[:9] * 2  # repeated rows, anchors among them
    rows += [(0, 1, [0.5, 0.5]), (3, 1, []), (None, 1, [1.0]), (4, None, [1.0]), (5, 1, None), (6, 1, [None, 1.0]), (7, 1, [float("nan")]), (8, 1, [float("inf")]), (10, 2, [0.1] * 9), (0, 9, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"score": F.lit(1), "anchor": F.lit("x"), "rank": F.lit(0)}).repartition(5)
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 5 == 0).collect()))
    assert got == plain(rows, lambda i: i % 5 == 0) and got


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mine(none, F.col("vec_id") % 5 == 0).count() == 0


# --- sources


def audited(rows, least, top):
    letter = lambda c: c.isascii() and c.isalpha() or not c.isascii()
    split = lambda t: "".join(c if letter(c) else " " for c in "".join(c.lower() if c.isascii() else c for c in t)).split(" ")
    found, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = [w for w in split(text or "") if w]
        found[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in {g for g, _ in found}:
        kept = [t for t, n in df[lang].items() if n >= least]
        groups = {s: c for (g, s), c in found.items() if g == lang}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023,E731
        shares, whole = {s: p(c) for s, c in groups.items()}, p(sum(groups.values(), Counter()))
        for s, own in shares.items():
            pairs = [(sum(abs(own[t] - x[t]) for t in kept), o) for o, x in shares.items() if o != s]
            terms = [(own[t] - whole[t], t) for t in kept if groups[s][t] and own[t] > whole[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, r + 1) for r, (v, o) in enumerate(ranked) if part == "pair" or r < top]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "terms"), [(1, 50, 1024), (2, 1, 1), (99, 50, 1024)])
def test_odd_documents_against_a_plain_count(spark, monkeypatch, least, top, terms):
    monkeypatch.setattr(divergence, "TERMS", terms)
    rng = np.random.default_rng(2)
    words = ["a", "B", "ß", "日本", "Zz", "été", "x_y", "q1r", "😀"]
    more = [(k, " ".join(rng.choice(words, rng.integers(0, 9))), str(rng.choice(["en", "fr"])), f"s{rng.integers(5)}") for k in range(80)]
    rows = ODD + more + more[:7] * 2
    got = sorted(map(tuple, divergence.audit(docs_of(spark, rows).repartition(3), least, top).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == audited(rows, least, top) and got


def test_no_documents(spark):
    assert divergence.audit(docs_of(spark, [])).count() == 0
