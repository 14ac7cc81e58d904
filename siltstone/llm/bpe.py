"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token there is exactly one token that can end its
encoding.  A suffix automaton of the vocabulary (a trie of the tokens whose
states lead on to their longest proper suffix in it) lists the tokens that are
suffixes of a prefix, longest first; a token fits if it and the token before it would not have
been merged otherwise (the compatibility test).  The last tokens of all
prefixes are found for many pre-tokens at once, and back-pointers give the ids.

Nulls and empty texts have no tokens.  Strings of added tokens in a text become
those tokens.  Texts are read whole; a pre-token may be of any length.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.arrays import blocks
from siltstone.llm.storage import mapped

#: How byte-level vocabularies split a text before the merges (a fixed, public pattern).
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Encodings of so many pre-tokens are kept by each Python worker.
CACHE = 150_000
#: Pre-tokens of more bytes are walked one by one, byte after byte; shorter ones many at once.
LONG = 2_000
_NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens in the order of their merges: 256 bytes, then one for each merge."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer is supported")
        if spec["pre_tokenizer"]["add_prefix_space"] or model.get("ignore_merges"):
            raise ValueError("add_prefix_space and ignore_merges are not supported")
        self.added = {}
        for token in spec.get("added_tokens", []):
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"added token {token['content']!r} has options that are not supported")
            self.added[token["content"]] = token["id"]
        by_letters = {letter: b for letter, b in letters.items()}
        texts: list[bytes] = [bytes([b]) for b in range(256)]
        names = [""] * 256
        for letter, b in letters.items():
            names[b] = letter
        left, right = list(range(256)), list(range(256))
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left.append(by_letters[a])
            right.append(by_letters[b])
            by_letters[a + b] = len(texts)
            names.append(a + b)
            texts.append(texts[left[-1]] + texts[right[-1]])
        self.texts = texts
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ids = np.array([model["vocab"][name] for name in names], np.uint32)
        keys = (self.left[256:] << 20) | self.right[256:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_tokens = keys[order], order + 256
        self.alone = np.ones(len(texts), bool)
        merged = np.arange(256, len(texts))
        sound = self._compatible(self.left[merged], self.right[merged], merged)
        for t, ok in zip(merged.tolist(), sound.tolist(), strict=True):
            self.alone[t] = ok and self.alone[left[t]] and self.alone[right[t]]
        self.decoded = {int(i): t for i, t in zip(self.ids, texts, strict=True)}
        self.decoded |= {i: content.encode() for content, i in self.added.items()}
        self._keys, self._known = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self._build_automaton()

    def _build_automaton(self) -> None:
        """Transitions over bytes, the longest token that ends in each state, and the next shorter one for each token."""
        children: list[dict[int, int]] = [{}]
        depths, owner, ends = [0], [-1], np.zeros(len(self.texts), np.int64)
        for token, text in enumerate(self.texts):
            state = 0
            for depth, b in enumerate(text, 1):
                if (to := children[state].get(b)) is None:
                    to = children[state][b] = len(children)
                    children.append({})
                    depths.append(depth)
                    owner.append(-1)
                state = to
            owner[state], ends[token] = token, state
        self.longest = np.array(owner, np.int64)
        fail = [0] * len(children)
        edges = [(p, b, c) for p, own in enumerate(children) for b, c in own.items()]
        for p, b, c in sorted(edges, key=lambda e: depths[e[2]]):
            state = p
            while state and fail[c] == 0:
                state = fail[state]
                fail[c] = children[state].get(b, 0)
            if self.longest[c] < 0:
                self.longest[c] = self.longest[fail[c]]
        self.fail = np.array(fail, np.int64)
        keys = np.array([(p << 8) | b for p, b, _ in edges], np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_ends = keys[order], np.array([c for _, _, c in edges], np.int64)[order]
        self.shorter = np.where(self.fail[ends] > 0, self.longest[self.fail[ends]], -1)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte: along an edge, else along that of the longest suffix that has one."""
        out = np.zeros(len(state), np.int64)
        live = np.arange(len(state))
        while len(live):
            keys = (state << 8) | byte[live]
            at = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            found = self.edge_keys[at] == keys
            out[live[found]] = self.edge_ends[at[found]]
            on = ~found & (state > 0)
            live, state = live[on], self.fail[state[on]]
        return out

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_tokens[at], _NONE)

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges leave two neighbouring tokens as they are.

        The later of the two is taken apart again and again; if the parts that
        then meet have a merge that comes before the one undone, it would have been made.
        """
        out = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), _NONE) if limit is None else limit.copy()
        while len(live):
            broken = self._merged(a, b) < limit
            out[live[broken]] = False
            part_a, part_b = self.right[a], self.left[b]
            whole_a, whole_b = part_a == a, part_b == b
            undo_a = np.where(a > b, ~whole_a, whole_b & ~whole_a)
            on = ~broken & (undo_a | ~whole_b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, part_a, a), np.where(undo_a, b, part_b)
            live, a, b, limit = live[on], a[on], b[on], limit[on]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_compatible with a direct-mapped memory of earlier answers."""
        keys = (a << 20) | b
        slots = (keys * 0x9E3779B1 >> 7) & (len(self._keys) - 1)
        missing = np.flatnonzero(self._keys[slots] != keys)
        out = self._known[slots]
        if len(missing):
            out[missing] = answers = self._compatible(a[missing], b[missing])
            self._keys[slots[missing]], self._known[slots[missing]] = keys[missing], answers
            clash = missing[self._keys[slots[missing]] != keys[missing]]
            self._keys[slots[clash]] = -1  # two new keys met in one slot: keep neither
        return out

    def _stay(self, a: int, b: int) -> bool:
        """_compatible of one pair."""
        (left, right), none = self._parts, int(_NONE)
        limit = none
        while True:
            if self._pairs.get((a << 20) | b, none) < limit:
                return False
            part_a, part_b = right[a], left[b]
            if part_a != a and (a > b or part_b == b):
                a, limit = part_a, a
            elif part_b != b:
                b, limit = part_b, b + 1
            else:
                return True

    def _walk(self, piece: bytes) -> bytes:
        """Ids of one long piece: the same dynamic programme with plain integers, in time that its length alone sets."""
        if not hasattr(self, "_edges"):
            self._edges = dict(zip(self.edge_keys.tolist(), self.edge_ends.tolist(), strict=True))
            self._plain = [x.tolist() for x in (self.fail, self.longest, self.shorter, self.lengths, self.alone)]
            self._pairs = dict(zip(self.pair_keys.tolist(), self.pair_tokens.tolist(), strict=True))
            self._parts = self.left.tolist(), self.right.tolist()
        edges, (fail, longest, shorter, lengths, alone) = self._edges, self._plain
        last, state, known = array("i", [0]), 0, {}
        for i, byte in enumerate(piece, 1):
            while (to := edges.get((state << 8) | byte)) is None and state:
                state = fail[state]
            state = to or 0
            token = longest[state]
            while True:
                begin = i - lengths[token]
                if alone[token]:
                    if begin == 0:
                        break
                    pair = (last[begin], token)
                    if (fit := known.get(pair)) is None:
                        if len(known) > 500_000:
                            known.clear()
                        fit = known[pair] = self._stay(*pair)
                    if fit:
                        break
                token = shorter[token]
            last.append(token)
        flat, place = array("i"), len(piece)
        while place:
            flat.append(last[place])
            place -= lengths[last[place]]
        return self.ids[np.array(flat, np.int64)[::-1]].astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [self._walk(p) if len(p) > LONG else b"" for p in pieces]
        order = sorted((i for i in range(len(pieces)) if len(pieces[i]) <= LONG), key=lambda i: -len(pieces[i]))
        start = 0
        while start < len(order):
            width = len(pieces[order[start]])
            stop = min(len(order), start + max(1, 1_000_000 // max(1, width)))
            part = order[start:stop]
            for i, ids in zip(part, self._encode([pieces[i] for i in part], width), strict=True):
                out[i] = ids
            start = stop
        return out

    def _encode(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Of pieces in descending order of length, the first `width` long."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        matrix = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        last = np.zeros((width + 1, n), np.int32)
        number = np.zeros((width + 1, n), np.int32)
        state = np.zeros(n, np.int64)
        for i in range(1, width + 1):
            k = int(np.searchsorted(-lengths, -i, "right"))
            state[:k] = self._step(state[:k], matrix[:k, i - 1])
            todo, token = np.arange(k), self.longest[state[:k]]
            while len(todo):
                begin = i - self.lengths[token]
                before = last[begin, todo].astype(np.int64)
                fit = self.alone[token]
                pairs = np.flatnonzero((begin > 0) & fit)
                fit[pairs] = self.fits(before[pairs], token[pairs])
                done = todo[fit]
                last[i, done] = token[fit]
                number[i, done] = number[begin[fit], done] + 1
                todo, token = todo[~fit], self.shorter[token[~fit]]
        ends = np.cumsum(number[lengths, np.arange(n)])
        flat = np.zeros(int(ends[-1]) if n else 0, np.int64)
        live, place, at = np.arange(n)[lengths > 0], lengths[lengths > 0], ends[lengths > 0] - 1
        while len(live):
            token = last[place, live]
            flat[at] = token
            place = place - self.lengths[token]
            on = place > 0
            live, place, at = live[on], place[on], at[on] - 1
        packed, ends = self.ids[flat].astype("<u4").tobytes(), (ends * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Whole texts to packed ids and back, with a bounded memory of pre-tokens."""

    def __init__(self, source: str, cache: int = CACHE):
        self.vocabulary, self.cache, self.limit = Vocabulary(source), {}, cache
        self.pattern = regex.compile(PRE_TOKEN)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in self.vocabulary.added.items()}

    def split(self, text: str) -> list[str]:
        if self.specials and self.specials.search(text):
            parts = self.specials.split(text)
            return list(chain.from_iterable([p] if k % 2 else self.pattern.findall(p) for k, p in enumerate(parts)))
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        pieces = set(chain.from_iterable(split))
        if len(self.cache) + len(pieces) > self.limit:
            self.cache.clear()
        new = list(pieces - self.cache.keys() - self.special_ids.keys())
        self.cache.update(zip(new, self.vocabulary.encode_pieces([p.encode() for p in new]), strict=True))
        known = self.cache | self.special_ids if any(s in pieces for s in self.special_ids) else self.cache
        return [b"".join(map(known.__getitem__, p)) for p in split]

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


_encoders: dict[str, Encoder] = {}


def encoder(source: str) -> Encoder:
    """One for each vocabulary and Python worker."""
    if source not in _encoders:
        _encoders.clear()
        _encoders[source] = Encoder(source)
    return _encoders[source]


def encode(docs: DataFrame, tokenizer: str, decoded: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with n_tokens and ids (binary, little-endian unsigned 32-bit), and the text that the ids decode to.

    tokenizer: path of a tokenizer file on the driver; its content is broadcast
    (a vocabulary, whose size does not follow the data).  Other columns of
    `docs` are not read, whatever their names.  An empty table gives an empty one; repeated
    rows have a row each, nulls are encoded as empty texts.
    """
    source = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    fields = [docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                coder = encoder(source.value)
                ids = coder.encode([t or "" for t in block.column("text").to_pylist()])
                columns = [block.column(c) for c in keep] + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                columns += [pa.array(map(coder.decode, ids), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        encoder(source.value).cache.clear()  # an idle worker holds the vocabulary alone

    return mapped(docs.select(*keep, "text"), run, T.StructType(fields))
