"""The llm operators against brute force, public libraries, round trips and held-out labels; and odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bpe, chat, decontaminate, langid, licenses, neardup, pii, quality, rules, toxicity
from siltstone.llm.arrays import Words, similarity, weighted
from siltstone.llm.queries import PROBE, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, size string, label string, item_id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, and names that operators use themselves."""
    rows = [(1, "", "en", "s", 0, "x", "y", "z"), (2, None, None, None, None, None, None, None), (None, "no id here at all today", "en", "s", 3, "x", "y", "z"), (3, "word " * 40_000, "en", "s", 1, "x", "y", "z")]
    rows += [(4, "a b", "en", "s", 3, "x", "y", "z")] * 2 + [(5, "x" * 50_000, "en", "s", 1, "x", "y", "z"), (6, "\n \t\n", "en", "s", 1, "x", "y", "z"), (7, "a b", "en", "s", 3, "x", "y", "z")]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def texts():
    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]


def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    source = tokenizer_path()
    want, coder = Tokenizer.from_file(source), bpe.Encoder(open(source, encoding="utf-8").read())
    r = random.Random(1)
    texts = texts + ["", "<|endoftext|> a<|endoftext|>", " \n\n x\t\x1c\x85 don't I'LL", "b" * 5000, "日本語😀 é"]
    texts += ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(32, 0x2000), 10, 32))) for _ in range(200)) for _ in range(40)]
    texts += ["".join(r.choice("abcdefgh") for _ in range(30_000)), "é" * 3000, "12" * 3000, "?!" * 2000]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        own = want.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == own
        assert coder.decode(ids) == want.decode(own, skip_special_tokens=False)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_pii_base_equals_plain_patterns(texts):
    r = random.Random(2)
    texts = texts + ["".join(r.choice("01259 .-+()@a.@- ") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        want = []
        for kind, pattern in PATTERNS.items():
            for m in re.finditer(pattern, text):
                n = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(n) <= 19 and pii.luhn(n), "phone": 9 <= len(n) <= 15}[kind]
                if ok:
                    want.append((kind, m.start(), m.end()))
        assert pii.base_spans(text) == want


def test_pii_field_learns_and_redacts(spark, odd):
    model = pii.train()
    rows = pii.labelled(seed=99)
    found = model.decode([model.features(w, {}) for w, _ in rows])
    assert np.mean([(f == np.array(y)).all() for f, (_, y) in zip(found, rows, strict=True)]) > 0.97
    df = spark.createDataFrame([(1, 'see token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" or a.b@c.de now', 0)], "doc_id long, text string, n_chars long")
    got = pii.redact(df, model).first()
    assert got.text == 'see token = "[SECRET]" or [EMAIL] now' and got.n_chars == len(got.text)
    assert pii.redact(odd, model).count() == odd.count() and pii.redact(odd, model).columns == odd.columns


def test_pii_field_on_lines_of_another_hand():
    """Lines written for this test: the values are none of the labelled table's, nor are the sentences."""
    lines = {
        "export GITLAB_TOKEN=glpat9Fh2kLmQx7Rt3VbN8zYw": "glpat9Fh2kLmQx7Rt3VbN8zYw", "api key: abcdefghijklmnopqrstuvwxyzabcd": "abcdefghijklmnopqrstuvwxyzabcd",
        "the secret 0f1e2d3c4b5a69788796a5b4c3d2e1f0 was leaked": "0f1e2d3c4b5a69788796a5b4c3d2e1f0", "client_secret: Zx81qPw02LmNbVcXaSdFgHjKlQwErTyU": "Zx81qPw02LmNbVcXaSdFgHjKlQwErTyU",
        "sha256 of the release is published on the site in 2024": None, "Der Donaudampfschifffahrtsgesellschaftskapitän kam um 12 Uhr": None, "a token of thanks to everyone who came on 12 May": None,
        "the password is changed every ninety days": None, "secret ingredients: 200 g flour, 3 eggs and 1 l milk": None, "https://example.org/path/to/resource?id=12345 is the link": None,
    }
    model = pii.train()
    found = pii.spans_of(list(lines), model, {})
    assert [[t[a:b] for _, a, b, _ in f] for t, f in zip(lines, found, strict=True)] == [[v] if v else [] for v in lines.values()]


def classes_by_force(rows):
    """Connected components of all pairs that share a shingle and are similar."""
    shingles = [weighted(Words(pa.array([t or ""])).shingles()[0]) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, (s, _) in enumerate(shingles):
        for x in s.tolist():
            held[x].append(i)
    for i, j in {(a, b) for own in held.values() if len(own) < 200 for a in own for b in own if a < b}:
        if similarity(shingles[i], shingles[j]) >= 0.8:
            parent[root(i)] = root(j)
    first = {}
    for i, (_, t) in enumerate(rows):
        parent[root(i)] = root(first.setdefault(t, i))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return {d: min(g) for g in groups.values() for d in g}


def test_neardup_equals_brute_force(spark, texts):
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = list(enumerate(texts))
    for k in range(150):  # a family of copies that drift apart, so that some are linked by others alone
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(neardup.classes(df).collect()) == classes_by_force(rows)


def test_neardup_deals_heavy_keys(spark, monkeypatch):
    """The same classes when every key of more than three rows is dealt over parts; texts of one id are all linked."""
    monkeypatch.setattr(neardup, "HOT", 3)
    r = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = [(k, " ".join(base[: r.randint(84, 90)])) for k in range(60)] + [(100 + k, " ".join(f"v{r.randrange(9**6)}" for _ in range(30))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(neardup.classes(df).collect()) == classes_by_force(rows)
    one, two = " ".join(base), " ".join(f"u{i}" for i in range(70))
    twice = spark.createDataFrame([(1, one), (2, one + " tail"), (2, two), (3, two + " end"), (4, "x")], "doc_id long, text string")
    assert dict(neardup.classes(twice).collect()) == {1: 1, 2: 1, 3: 1, 4: 4}


def test_neardup_odd_tables(spark, odd):
    got = neardup.deduplicate(odd)
    assert got.columns == odd.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, None, 3, 4, 5, 6])  # the null text equals the empty one
    assert neardup.classes(odd.limit(0)).count() == 0


def test_decontamination(spark, texts, odd):
    items = [r[0] for r in duckdb.sql(f"select text from '{SF}/benchmark.parquet' order by item_id").fetchall()]
    index = decontaminate.Index(items)
    assert {(i, m[1]) for i, t in enumerate(texts) for m in index.matches(pa.array([t]), 0.8)} >= {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if x in t}
    r = random.Random(5)
    for j, item in enumerate(items):
        w = item.split()
        w[r.randrange(len(w))] = "zzz"
        pair = [weighted(Words(pa.array([t])).shingles()[0]) for t in (item, " ".join(w))]
        found = [m[1] for m in index.matches(pa.array([f"{texts[j][:200]} {' '.join(w)} {texts[j + 1][:200]}"]), 0.8)]
        assert (j in found) or similarity(*pair) < 0.8
    bench = spark.createDataFrame([(0, items[0]), (1, None), (2, "a b"), (3, "")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(odd, bench).collect()) == ["1", "2", "3", "5", "6", "None"]
    assert decontaminate.matches(odd, bench.limit(0)).count() == 0
    assert decontaminate.matches(odd.limit(0), bench).count() == 0


def windows_by_force(text, item):
    """The best similarity of any window of an item's size, one word more or less, by plain counting."""
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t.lower()))
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] * bool(w))
    w, own = words(text), grams(words(item))
    n, best = len(words(item)), 0.0
    for size in ({n - 1, n, n + 1} if n >= 5 else {n}):
        for i in range(max(0, len(w) - size + 1) if size > 0 else 0):
            g = grams(w[i : i + size])
            shared = sum((g & own).values())
            best = max(best, shared / (sum(g.values()) + sum(own.values()) - shared))
    return best


def test_decontamination_equals_all_windows(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [" ".join(some(n)) for n in (1, 2, 4, 5, 9, 14, 20, 33, 50, 70)]
    texts = []
    for k in range(120):
        own = items[k % len(items)].split()
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            at = r.randrange(len(own))
            own[at : at + r.randrange(2)] = r.choice(([], ["new"]))
            own = own or ["new"]
        texts.append(" ".join([*some(r.randint(0, 30)), *own, *some(r.randint(0, 30))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{j}", t) for j, t in enumerate(items)] + [(None, "null id item of six words")], "item_id string, text string")
    got = {(m.doc_id, m.item_id) for m in decontaminate.matches(df, bench).collect()}
    want = {(i, f"i{j}") for i, t in enumerate(texts) for j, x in enumerate(items) if windows_by_force(t, x) >= 0.8}
    assert got <= want and len(want - got) <= len(want) // 50
    own = spark.createDataFrame([(7, "here is the null id item of six words again")], "doc_id long, text string")
    assert [(m.doc_id, m.item_id) for m in decontaminate.matches(own, bench).filter("n_words > 4").collect()] == [(7, None)]


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op7_langid"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    model = langid.fit(docs)
    unknown = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert unknown[1] == unknown[2] == unknown[6] == "und" and unknown[3] == "en"
    assert langid.predict(odd, langid.fit(odd.limit(0))).count() == odd.count()


def test_classifiers_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, label in (("op6_quality", "quality"), ("op4_toxicity", "toxic")):
        got = QUERIES[name](spark, sf).join(labels, "doc_id").filter("held_out").collect()
        pos, neg = [r.score for r in got if r[label]], [r.score for r in got if not r[label]]
        assert np.mean([p > n for p in pos for n in neg]) > 0.75
    for part in (quality, toxicity):
        model = part.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
        assert all(0 <= r.score <= 1 for r in part.score(odd, model).collect())


def test_toxicity_tolerates_inserted_letters():
    r = random.Random(6)
    word = lambda: "".join(r.choice("the on er st an re le en qu ou".split()) for _ in range(r.randint(1, 4)))
    bags, truth = [], []
    for k in range(600):
        bags.append(sorted({word() for _ in range(40)} | ({r.choice(("idiot", "stupid"))} if k % 6 == 0 else set())))
        truth.append(float(k % 6 == 0))
    model = toxicity.train(bags, np.array(truth))
    best = lambda t: model.units(pa.array([t], pa.large_string()))[0].max()
    assert best("idiot") > 0 and best("i.d.i.o.t") > 0 and best("i d i o t") > 0 and best("idxiot") > 0 > best("other")


def test_licenses(spark, odd):
    text = "one\nReleased under the MIT license!\nLicensed under the Apache License Version 2.0, see below\nreleased under license"
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.line, r.licence, round(r.dice, 3)) for r in sorted(got)] == [(1, "MIT", 1.0), (2, "Apache-2.0", 0.875)]
    assert licenses.scan(odd).count() == 0


def test_licenses_inside_and_over_lines(spark):
    mit = next(t for n, t in licenses.TEXTS if n == "MIT").split()
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    rows = [
        "This file is released under the MIT License.", "Copyright Example Org. Licensed under the Apache License, Version 2.0 (the License);", "x\nThis work is licensed under a Creative Commons\nAttribution 4.0 International License. And more",
        f"Title\n\n{wrapped}\nthe end", "Released under the MIT License.\nnothing", "the license of this software is the license of the work " * 50,
    ]
    got = licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.line, r.licence, r.dice) for r in got) == [(0, 0, "MIT", 1.0), (1, 0, "Apache-2.0", 1.0), (2, 1, "CC-BY-4.0", 1.0), (3, 2, "MIT", 1.0), (4, 0, "MIT", 1.0)]


def test_license_sizes_hold_exact_ties(spark):
    """Four of six bigrams and no others are exactly 0.8."""
    got = licenses.scan(spark.createDataFrame([(1, "licensed under cc by nc")], "doc_id long, text string")).collect()
    assert [(r.licence, r.dice) for r in got] == [("CC-BY-NC-4.0", 0.8)]


def test_license_keys_lose_no_line():
    r = random.Random(5)
    for text in licenses.TEMPLATES.values():
        own, words = licenses.bigrams(text), licenses.normal_words(text)
        keys = set(licenses.least_keys(own, licenses.LEAST))
        for _ in range(3000):
            line = list(words)
            for _ in range(r.randrange(6)):
                k = r.randrange(len(line) + 1)
                line[k : k + r.randrange(2)] = [r.choice([*words, "x"])] * r.randrange(2)
            b = licenses.bigrams(" ".join(line))
            if b and 2 * len(set(own) & set(b)) / (len(own) + len(b)) >= licenses.LEAST:
                assert keys & set(b)


def test_rule_statistics_equal_brute_force(spark, texts, odd):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    for r in rules.judge(df, [], ("doc_id", "text")).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.kept != r.base_failed


def test_rules_are_learned():
    r = random.Random(7)
    rows = [{m: r.random() for m in rules.MEASURES} for _ in range(600)]
    for row in rows:
        row["bad"] = int(row["symbol_share"] > 0.8 or row["repeat_share"] > 0.9)
    found = rules.learn(rows)
    hit = [any(all(c.holds(row) for c in rule) for rule in found) for row in rows]
    assert np.mean([h == bool(row["bad"]) for h, row in zip(hit, rows, strict=True)]) > 0.95
    assert rules.learn([]) == []


def test_chat_round_trip(spark):
    nasty = [PROBE, "", None, "\\b\\\\h ### </turn>\n### user:\nx", "a:\nb</turn>\n"]
    rows = [(1, k, ("user", "assistant", "tool:\nx", None)[k % 4], t) for k, t in enumerate(nasty * 3)] + [(2, 0, "user", "alone"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.examples(df).cache()
    turns = {r.conv_id: [(t.role, t.text) for t in r.t] for r in found.filter("last").select("conv_id", chat.turns_of().alias("t")).collect()}
    assert turns[1] == [(role or "", text or "") for _, _, role, text in rows[:15]] and turns[2] == [("user", "alone")]
    replies = found.select("conv_id", "example", chat.trained().alias("x")).orderBy("example").collect()
    assert [r.x for r in replies if r.conv_id == 1][:4] == [t or "" for _, k, role, t in rows[:15] if role == "assistant"]
    got = {r.conv_id: r for r in chat.digests(found).collect()}
    assert got[2].loss_chars == 0 and got[None].loss_chars == 5
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in rows[:15]).encode()).hexdigest()
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


def test_sample_takes_an_id_once(spark):
    from siltstone.llm.labels import sample

    docs = spark.createDataFrame([(1, "a", "en"), (1, "b", "de"), (1, "c", "en")] * 20 + [(2, "d", "fr"), (3, None, "es")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0)] * 20 + [(2, 1), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    got = sorted((r.label, r.text or "") for r in sample(docs, labels, "toxic", 3).collect())
    assert [x for x, _ in got] == [0, 1, 1] and [t for _, t in got][1:] == ["", "d"] and got[0][1] in "abc"
    assert sorted((r.label, r.text) for r in sample(docs, docs, "lang", 5).collect()) == [("de", "b"), ("es", None), ("fr", "d")]


def test_toxicity_trains_on_all_units_of_a_text(spark, monkeypatch):
    letters = "abcdefghijklmnopqrst"
    words = {f"{a}{b}{c}x" for a in letters for b in letters for c in letters[:11]} | {"zebra"}
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda bags, truth: seen.extend(bags))
    toxicity.fit(spark.createDataFrame([(1, " ".join(sorted(words)))], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert len(words) > 4000 and set(seen[0]) == words
