"""Personal data: fixed patterns plus a conditional random field over word shapes.

The patterns (email, ip, card, phone) give the base spans, found leftmost and
without overlap for each kind.  A linear-chain conditional random field, trained
on the driver from a small labelled table, labels the words of every line that
could hold a value (a digit, "@", a word that announces a secret, or a long run
without a space) and is decoded by Viterbi in numpy batches.  A secret may be of
letters alone where a word before it announces one.  Its spans are added where they touch no base span; those of the four
pattern kinds must pass the same checks as the base (Luhn, octets, digits).
Places are code points, ends exclusive.  Nulls and empty texts have no spans;
whole texts are read, line by line, however long; repeated rows are rows of
their own, other columns are not read by find() and carried by redact(), and an
empty table gives an empty one.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.arrays import blocks
from siltstone.llm.storage import mapped

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("outside", *KINDS)
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_CUE = re.compile(r"(?i)passw|secret|token|api.?key|\bkey\s*[:=]|credential|passphrase")
_ANCHOR = re.compile(r"[0-9@]|[A-Za-z+/_-]{24,}|(?i:passw|secret|token|api.?key|credential|passphrase)")
# A match of these can only begin where a run of digits begins, hence the possessive runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR_DIGIT = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    n = _digits(text)
    if kind == "card":
        return 13 <= len(n) <= 19 and luhn(n)
    if kind == "phone":
        return 9 <= len(n) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each "@" in turn: as much of a local part as the match before leaves, then a domain with a dot."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)  # no local part holds an "@"
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            if kind != "phone" or "+" in text:
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return out


# ---------------------------------------------------------------- the model

#: Sentences of the labelled table: {kind} stands for a value of that kind, {word} and {number} for ordinary ones.
TEMPLATES = (
    "{word} {word} {word} {word}", "{word} {word} token = {secret} {word}", "{word} api_key = {secret} {word} {word}", "{word} password: {secret}", "secret {secret} {word}", "{word} {word} {email} {word}",
    "write to {email} {word}", "{word} | {email} | {word}", "{word} {ip} {word} {word}", "host {ip} {word}", "{word} {word} {card} {word}", "card {card} {word}", "{word} {phone} {word} {word}", "call {phone} {word}",
    "{word} version {number} {word}", "{word} {word} {number} {word} {number}", "{number} {word} {word}", "{word} | {word} | {number}", "{word} {junk} {junk} {word}", "{junk} {junk} {junk}", "Licensed under {word} {number}",
    "{word} password {word} {word}", "the token = {word} {word}", "{word} {long} {word} {long}", "secret: {word}", "{word} passphrase: {secret} {word}", "credentials {secret}", "API_KEY={secret}", "export X_TOKEN={secret}", "api key: {secret}", "key = {secret} {word}", "see https://{word}.example/{word}/{number}?id={number} {word}", "{word}/{word}/{number} {word}", "token {word}: {word} {number}", "{long} {word} {number}",
    "{word} token = {secret} {word} {ip} {word}", "{word} {email} {word} {phone} {word}", "{word} = {number} {word}", "{word} {word} 19{number} {word}", "{word}@ {word} {number}%",
)
_SYLLABLES = "the on er st an re le en qu ou ción der ung ä é à mente and ing".split()


def labelled(seed: int = 7, rounds: int = 24) -> list[tuple[list[str], list[int]]]:
    """The labelled table: (words, labels), a few hundred short rows written from TEMPLATES; all values are made up."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def word() -> str:
        w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
        return r.choice((w, w, w.capitalize(), w + r.choice(".,;"), w.upper() + "!!"))

    def value(kind: str) -> str:
        if kind == "word":
            return word()
        if kind == "long":
            return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(8, 12)))
        if kind == "junk":
            return word() + r.choice(("***", "###", "%%%", "$$$", "&&&", "!!"))
        if kind == "number":
            return r.choice((number(1), number(2), number(3) + ".", f"{number(1)}.{number(1)}.", number(4), f"{number(3)},{number(3)}", f"{number(1)}.{number(2)}", number(7)))
        if kind == "email":
            return f"{word().lower().strip('.,;!')}.{number(2)}@mail{number(1)}.example.{r.choice(('com', 'org'))}" + r.choice(("", "", ".", ","))
        if kind == "ip":
            return ".".join(str(r.randint(1, 255)) for _ in range(4)) + r.choice(("", "", ".", ","))
        if kind == "card":
            return r.choice((number(16), number(16), f"{number(4)} {number(4)} {number(4)} {number(4)}", f"{number(4)}-{number(4)}-{number(4)}-{number(4)}"))
        if kind == "phone":
            return r.choice((f"+{number(1)} ({number(3)}) 555-{number(4)}", f"({number(3)}) 555-{number(4)}", f"+{number(2)} {number(3)} {number(7)}"))
        letters = r.choice(("0123456789abcdef",) * 4 + ("abcdefghijklmnopqrstuvwxyz",) * 3 + ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"))
        secret = "".join(r.choice(letters) for _ in range(r.choice((32, 40, 40, 64)) if letters.isalnum() and len(letters) == 16 else r.randint(20, 48)))
        return r.choice(('"{}"', "{}", "'{}'")).format(r.choice((secret, secret, secret.upper())))

    rows = []
    for _ in range(rounds):
        for template in TEMPLATES:
            words, labels = [], []
            for part in template.split():
                kind = (re.search(r"\{(\w+)\}", part) or ("", ""))[1]
                filled = re.sub(r"\{(\w+)\}", lambda m: value(m[1]), part).split()
                words += filled
                labels += [LABELS.index(kind) if kind in KINDS else 0] * len(filled)
            rows.append((words, labels))
    return rows


def shape(word: str) -> str:
    s = re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", word))
    s = re.sub(r"[a-z]|[^\x00-\x7f]", "a", s)
    return re.sub(r"(.)\1+", r"\1", s)[:14]


def seen_as(word: str) -> str:
    """How a word looks to its neighbours: its shape, and whether it announces a secret."""
    return shape(word) + ("!" if _CUE.search(word) else "")


def own_features(word: str) -> tuple[str, ...]:
    core = word.strip("\"'.,;:!?#*$%&|<>()")
    n = len(_digits(core))
    is_hex = len(core) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core) is not None
    return (f"shape={shape(word)}", f"core={shape(core)}", f"length={min(len(core) // 4, 10)}", f"digits={min(n, 20)}", f"hex={is_hex}:{0 < n < len(core)}", f"ends={shape(word[:1])}{shape(word[-1:])}", f"cue={_CUE.search(word) is not None}:{'=' in word}:{'/' in word}", f"letters={core.isascii()}:{core.isalpha()}:{core.islower()}:{min(len(core) // 6, 5)}")


#: Features of a word: its own, and how the two before and the one after look.
_OWN = 8
_FEATURES = _OWN + 3


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def features(self, words: list[str], own: dict[str, tuple[list[int], list[int]]]) -> np.ndarray:
        """Feature numbers of each word; 0 has no weight.  own: memory of words seen."""
        out = np.zeros((len(words), _FEATURES), np.int32)
        for i, w in enumerate(words):
            if (known := own.get(w)) is None:
                if len(own) > 100_000:
                    own.clear()
                s = seen_as(w)
                known = own[w] = ([self.index.get(f, 0) for f in own_features(w)], [self.index.get(f"{k}{s}", 0) for k in ("-1:", "-2:", "+1:")])
            out[i, :_OWN] = known[0]
            if i + 1 < len(words):
                out[i + 1, _OWN] = known[1][0]
            if i + 2 < len(words):
                out[i + 2, _OWN + 1] = known[1][1]
            if i:
                out[i - 1, _OWN + 2] = known[1][2]
        return out

    def decode(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of each row, by Viterbi over rows of like length at once."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        start, k = 0, len(LABELS)
        while start < len(order):
            stop = start + 1
            while stop < len(order) and (stop - start + 1) * len(rows[order[stop]]) <= 50_000 and len(rows[order[stop]]) <= 2 * len(rows[order[start]]) + 4:
                stop += 1
            part = order[start:stop]
            width = len(rows[part[-1]])
            lengths = np.array([len(rows[i]) for i in part])
            scores = np.zeros((width, len(part), k), np.float32)
            for j, i in enumerate(part):
                scores[: len(rows[i]), j] = self.weights[rows[i]].sum(1)
            back = np.zeros((width, len(part), k), np.int8)
            best = scores[0].copy()
            for t in range(1, width):
                paths = best[:, :, None] + self.moves[None]
                back[t] = paths.argmax(1)
                new = paths.max(1) + scores[t]
                best = np.where((t < lengths)[:, None], new, best)
            label, j = best.argmax(1), np.arange(len(part))
            labels = np.zeros((width, len(part)), np.int64)
            for t in range(width - 1, -1, -1):
                live = t < lengths
                labels[t, live] = label[live]
                if t:
                    label = np.where(live, back[t, j, label], label)
            for j, i in enumerate(part):
                out[i] = labels[: lengths[j], j]
            start = stop
        return out


def train(rows: list[tuple[list[str], list[int]]] | None = None, steps: int = 120, decay: float = 1e-3) -> Model:
    """Maximise the regularised conditional likelihood by AdaGrad with forward-backward sums over all rows at once."""
    rows = labelled() if rows is None else rows
    index: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            for f in (*own_features(w), *(f"{p}{seen_as(w)}" for p in ("-1:", "-2:", "+1:"))):
                index.setdefault(f, len(index) + 1)
    k = len(LABELS)
    model = Model(index, np.zeros((len(index) + 1, k)), np.zeros((k, k)))
    feats = [model.features(w, {}) for w, _ in rows]
    n, width = len(rows), max(map(len, feats))
    x, mask, gold = np.zeros((n, width, _FEATURES), np.int64), np.zeros((n, width), bool), np.zeros((n, width), np.int64)
    for i, (f, (_, y)) in enumerate(zip(feats, rows, strict=True)):
        x[i, : len(f)], mask[i, : len(f)], gold[i, : len(f)] = f, True, y
    truth = np.eye(k)[gold] * mask[:, :, None]
    pairs = mask[:, 1:]
    moved = np.einsum("nta,ntb->ab", truth[:, :-1] * pairs[:, :, None], truth[:, 1:])
    squares = [np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6)]
    total = lambda a, axis: np.log(np.exp(a - (m := a.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
    for _ in range(steps):
        scores = model.weights[x].sum(2)
        ahead, behind = np.zeros((n, width, k)), np.zeros((n, width, k))
        ahead[:, 0] = scores[:, 0]
        for t in range(1, width):
            ahead[:, t] = np.where(mask[:, t, None], total(ahead[:, t - 1, :, None] + model.moves, 1) + scores[:, t], ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            behind[:, t] = np.where(mask[:, t + 1, None], total(model.moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2), behind[:, t + 1])
        norm = total(ahead[:, -1], 1)
        each = np.exp(ahead + behind - norm[:, None, None]) * mask[:, :, None]
        both = np.exp(ahead[:, :-1, :, None] + model.moves + (scores + behind)[:, 1:, None, :] - norm[:, None, None, None]) * pairs[:, :, None, None]
        slope = np.zeros_like(model.weights)
        error = (truth - each)[mask]
        for f in range(_FEATURES):
            np.add.at(slope, x[:, :, f][mask], error)
        slope[0] = 0
        for value, grad, sq in ((model.weights, slope / n, squares[0]), (model.moves, (moved - both.sum((0, 1))) / n, squares[1])):
            grad = grad - decay * value
            sq += grad**2
            value += 0.3 * grad / np.sqrt(sq)
    model.weights[0] = 0
    return Model(index, model.weights.astype(np.float32), model.moves.astype(np.float32))


def _trim(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    first = "+(" if kind == "phone" else ""
    while start < end and not (text[start].isalnum() or text[start] in first):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], model: Model, own: dict) -> list[list[tuple[str, int, int]]]:
    where, rows, out = [], [], [[] for _ in texts]
    for i, text in enumerate(texts):
        done = 0
        while m := _ANCHOR.search(text, done):
            start, done = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            done = len(text) if done < 0 else done
            found = list(_WORD.finditer(text, start, done))
            where.append((i, [(w.start(), w.end()) for w in found]))
            rows.append(model.features([w[0] for w in found], own))
    for (i, places), labels in zip(where, model.decode(rows), strict=True):
        j = 0
        while j < len(labels):
            stop = j + 1
            while stop < len(labels) and labels[stop] == labels[j]:
                stop += 1
            if labels[j]:
                kind = LABELS[labels[j]]
                # cards and phones may be of several words; of the others each word is a value
                pieces = [(places[j][0], places[stop - 1][1])] if kind in ("card", "phone") else [places[p] for p in range(j, stop)]
                for a, b in pieces:
                    before = texts[i][places[max(0, j - 2)][0] : b]
                    if kind == "secret":  # the value of name=value
                        a += max(texts[i][a:b].rfind("="), texts[i][a:b].rfind(":")) + 1 if _CUE.search(texts[i][a:b]) else 0
                    a, b = _trim(texts[i], a, b, kind)
                    value = texts[i][a:b]
                    sure = _ANCHOR_DIGIT.search(value) or (kind == "secret" and _CUE.search(before))
                    if b > a and sure and plausible(kind, value) and not any(a < y and x < b for _, x, y in base[i]):
                        out[i].append((kind, a, b))
            j = stop
    return out


def plausible(kind: str, value: str) -> bool:
    if kind == "email":
        return re.fullmatch(r"[^@\s]+@[^@\s]+", value) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", value) is not None and valid(kind, value)
    if kind == "secret":
        return len(value) >= 16 and any(c.isalpha() for c in value) and value.isascii()
    return valid(kind, value) and re.fullmatch(r"[+0-9 ().\-/]+", value) is not None


def spans_of(texts: list[str], model: Model, own: dict) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) by kind as listed, then start."""
    base = [base_spans(t) for t in texts]
    added = added_spans(texts, base, model, own)
    key = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return [sorted([(*s, True) for s in b] + [(*s, False) for s in a], key=key) for b, a in zip(base, added, strict=True)]


def find(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with `pii`: all spans of each whole text.  Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("pii", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        for batch in batches:
            for block in blocks(batch):
                found = spans_of([t or "" for t in block.column("text").to_pylist()], shared.value, own)
                rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in found]
                yield pa.RecordBatch.from_arrays([block.column(c) for c in keep] + [pa.array(rows, _ARROW_SPANS)], [f.name for f in schema])

    return mapped(docs.select(*keep, "text"), run, schema)


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Each stretch of spans that overlap becomes [KIND], after the kind of its first."""
    out, done = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The same table with personal data replaced in `text`; `n_chars`, if there, follows.  Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        for batch in batches:
            for block in blocks(batch):
                texts = block.column("text").to_pylist()
                found = spans_of([t or "" for t in texts], shared.value, own)
                texts = [t if t is None or not s else redacted(t, s) for t, s in zip(texts, found, strict=True)]
                columns = dict(zip(block.schema.names, block.columns, strict=True))
                columns["text"] = pa.array(texts, columns["text"].type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return mapped(docs, run, docs.schema)
