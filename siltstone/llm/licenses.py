"""Licences: Dice coefficient over word bigrams against templates.

A text is normalised (ASCII lower case, runs of anything but letters and digits
separate words).  The distinct bigrams of each line are held against those of
each template; then windows of the whole text, over line ends, within the size
bounds: with b bigrams in the template and t the least coefficient, a match has
between b*t/(2-t) and b*(2-t)/t bigrams.  Texts with fewer bigrams of a template
than any match must share are left out for it, which loses no match.
Ties go to the licence that comes first by name.

Nulls and empty texts have no licence.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.notices import TEXTS
from siltstone.llm.storage import mapped

LEAST = 0.8
#: Characters of all templates, which go to every task.
TEMPLATE_CHARS = 20_000_000
#: Licence templates: the notices that stand for a licence (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def normal_words(text: str) -> list[str]:
    out = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text)
    return out.split()


def bigrams(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(sizes: list[int], least: float) -> tuple[int, int]:
    """Fewest and most bigrams of lines that can reach the coefficient; the small number keeps exact ties inside."""
    return math.ceil(min(sizes) * least / (2 - least) - 1e-9), math.floor(max(sizes) * (2 - least) / least + 1e-9)


def least_keys(own: list[str], least: float) -> list[str]:
    """The longest bigrams of a template, so many that each line of at least this coefficient holds one of them."""
    fewest, _ = bounds([len(own)], least)
    shared = math.ceil(least * (fewest + len(own)) / 2 - 1e-9)
    return sorted(own, key=lambda b: (-len(b), b))[: len(own) - shared + 1]


#: Bytes as words are made of: ASCII letters in lower case, digits and line ends; all else separates.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c == 10 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
Pair = tuple[bytes, bytes]


class Matcher:
    """Finds lines and windows of texts that reach the least coefficient with a template."""

    def __init__(self, templates: list[tuple[str, str]], least: float) -> None:
        owns = [(name, {tuple(p.encode().split()) for p in bigrams(text)}) for name, text in sorted(templates)]
        self.least, self.owns = least, [(name, own) for name, own in owns if own]
        self.bounds = [bounds([len(own)], least) for _, own in self.owns]
        self.shared = [math.ceil(least * (low + len(own)) / 2 - 1e-9) for (low, _), (_, own) in zip(self.bounds, self.owns, strict=True)]
        self.holders: dict[Pair, list[int]] = {}
        for k, (_, own) in enumerate(self.owns):
            for pair in own:
                self.holders.setdefault(pair, []).append(k)

    def line(self, pairs: set[Pair]) -> tuple[float, str]:
        """The best coefficient of a line; ties go to the name that comes first."""
        best = (0.0, "")
        near = sorted({k for p in pairs for k in self.holders.get(p, ())})
        for name, own in (self.owns[k] for k in near):
            dice = 2.0 * len(pairs & own) / (len(pairs) + len(own))
            if dice > best[0]:
                best = (dice, name)
        return best

    def windows(self, pairs: list[Pair], hits: list[int], k: int, free: list[bool]) -> list[tuple[float, str, int, int]]:
        """(-dice, licence, first, last) of template k: the best window from each of its bigrams that begins one.

        The best windows start and end with a bigram of the template; those with too few of them within reach are left out.
        """
        (name, own), (_, most), shared, out = self.owns[k], self.bounds[k], self.shared[k], []
        for n, first in enumerate(hits):
            within = hits[n : bisect.bisect_left(hits, first + most, n)]
            if len(within) < shared or not free[first]:
                continue
            seen: set[Pair] = set()
            at, common, best = first, 0, (0.0, 0)
            for last in within:
                if not all(free[at : last + 1]):
                    break
                common += pairs[last] not in seen
                seen.update(pairs[at : last + 1])
                at = last + 1
                best = max(best, (2.0 * common / (len(seen) + len(own)), -last))
            if best[0] >= self.least:
                out.append((-best[0], name, first, -best[1]))
        return out

    def find(self, text: str) -> list[tuple[int, str, float]]:
        """(line, licence, dice): lines that reach the coefficient, and windows of the rest of the text by the line they start in."""
        raw = text.encode().translate(_WORDS)
        words = raw.split()
        pairs = list(zip(words, words[1:], strict=False))
        hits: dict[int, list[int]] = {}
        holders = self.holders
        for i, pair in enumerate(pairs):
            if pair in holders:
                for k in holders[pair]:
                    hits.setdefault(k, []).append(i)
        near = [k for k, at in hits.items() if len(at) >= self.shared[k]]
        if not near:
            return []
        of = [n for n, line in enumerate(raw.split(b"\n")) for _ in line.split()]
        free, found = [True] * len(pairs), {}
        hit = {i for k in near for i in hits[k]}
        start = 0
        for n, group in itertools.groupby(of):
            end = start + len(list(group))
            if any(i in hit for i in range(start, end - 1)):
                dice, name = self.line(set(pairs[start : end - 1]))
                if dice >= self.least:
                    found[n, name] = dice
                    # the pairs of a found line and those that lead into it and out of it
                    for i in range(max(0, start - 1), min(end, len(pairs))):
                        free[i] = False
            start = end
        for minus, name, first, last in sorted(w for k in near for w in self.windows(pairs, hits[k], k, free)):
            if all(free[first : last + 1]):
                free[first : last + 1] = [False] * (last + 1 - first)
                found.setdefault((of[first], name), -minus)
        return sorted((n, name, dice) for (n, name), dice in found.items())


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` with line (from 0), licence and dice: the best template of each line that has one of at least `least`.

    Notices inside longer lines or over several lines, and whole texts, are found by windows of the
    words that the found lines leave, and stand with the line in which they start.
    """
    chosen = [*TEMPLATES.items(), *TEXTS] if templates is None else list(templates.items())
    if sum(len(text) for _, text in chosen) > TEMPLATE_CHARS:
        raise ValueError("the templates are too long to be sent to every task")
    if not 0 < least <= 1:
        raise ValueError("the least coefficient lies in (0, 1]")
    matcher = Matcher(chosen, least)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("line", T.LongType()), T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *f) for i, text in enumerate(batch.column("text")) for f in matcher.find(text.as_py())]
            at, lines, names, dice = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in keep] + [pa.array(lines, pa.int64()), pa.array(names, pa.string()), pa.array(dice, pa.float64())], schema.names)

    return mapped(docs.filter("text is not null").select(*keep, "text"), run, schema)


def oracle() -> str:
    """The same for all documents in DuckDB's SQL, without pruning."""
    rows = ", ".join(f"('{n}', [{', '.join(repr(x) for x in bigrams(t))}])" for n, t in TEMPLATES.items())
    return f"""
with templates(licence, own) as (values {rows}),
lines as (select doc_id, unnest(string_split(text, chr(10))) raw, unnest(range(len(string_split(text, chr(10))))) line from documents),
words as (select doc_id, line, string_split(trim(lower(regexp_replace(raw, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') w from lines),
pairs as (select doc_id, line, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) p from words where len(w) > 1),
scored as (select doc_id, line, licence, 2.0::double * len(list_intersect(p, own)) / (len(p) + len(own)) dice from pairs, templates),
ranked as (select *, row_number() over (partition by doc_id, line order by dice desc, licence) k from scored where dice >= {LEAST})
select doc_id, line::bigint line, licence, dice::double dice from ranked where k = 1"""
