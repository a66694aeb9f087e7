"""License scans with a positional rare-token index (operator 4).

Templates are token sequences: whole texts of short licences, the notices and opening terms of long
ones, and one-line grants.  The words of all templates get inverse document frequencies counted over
the whole corpus (one small count a word goes to the driver: the vocabulary bounds it).  Of every
template its ``RARE`` words of highest IDF are posted with their positions.  A file looks up the posted
words it holds; each occurrence and posting give a start (word index minus position in the template),
and the postings of a template's words are intersected by start: a start stands where at least
``SHARE`` of the template's posted positions agree.  As words may be added or left out inside a long
text, starts within ``SLACK`` words, in template order, are taken together.  A start is then verified:
one of the template's mandatory key phrases must stand there word for word, at its relative position
within the slack.  Base phrases are templates whose every word is posted, slack 0, all must agree.

``labels`` holds the labels of all verified templates.  ``score`` is the highest share of a
template's IDF mass found in order at a verified start, base phrases left aside (0 where none is
verified): a whole licence text scores 1, one with changed words less, a bare mention what it holds.

Nulls and odd input: a null text is empty, has no words, no places, empty labels and score 0.  Starts
of equal support are all verified; of equal scores the value is the same.  Equal rows are separate
rows; a very long text is scanned whole; other columns, whatever their names, are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8_column

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (label, template text, key phrases).  Fixed values: texts and notices of public licences, as words.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
            "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the "
            "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders "
            "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
            "connection with the software or the use or other dealings in the software",
     ("permission is hereby granted free of charge", "the software is provided as is without warranty of any kind")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
            "above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all "
            "warranties with regard to this software including all implied warranties of merchantability and fitness",
     ("permission to use copy modify and or distribute this software for any purpose",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
               "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
               "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express "
               "or implied see the license for the specific language governing permissions and limitations under the license",
     ("you may not use this file except in compliance with the license", "licensed under the apache license")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
            "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope "
            "that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
            "see the gnu general public license for more details",
     ("under the terms of the gnu general public license", "see the gnu general public license")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are "
            "met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            "documentation and or other materials provided with the distribution",
     ("redistribution and use in source and binary forms",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
            "file you can obtain one at", ("mozilla public license",)),
    ("mpl", "licensed under the mozilla public license", ("mozilla public license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
             "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
             "applications and to alter it and redistribute it freely subject to the following restrictions",
     ("permission is granted to anyone to use this software for any purpose",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("licensed under cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("licensed under cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("licensed under cc by 4",)),
    ("cc", "licensed under a creative commons attribution license", ("creative commons attribution",)),
)
#: Posted words of a template, the share of their positions that must agree on a start, and how far
#: apart, in words, starts of a template of more than ``SHORT`` words may lie.
RARE, SHARE, SLACK, SHORT = 8, 0.3, 12, 16
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SPLIT = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _vocabulary() -> list[str]:
    return sorted({w for _, t, ks in TEMPLATES for w in (t + " " + " ".join(ks)).split()} | {w for p, _ in BASE for w in p.split()})


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """Documents that hold each licence word, and all documents; counted over the whole table."""
    vocabulary = [w.encode() for w in _vocabulary()]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, total, rows = frozenset(vocabulary), dict.fromkeys(vocabulary, 0), 0
        for b in batches:
            raw, off = utf8_column(b.column(0))
            data = raw.tobytes().lower()
            cuts = off.tolist()
            rows += len(cuts) - 1
            for i, j in zip(cuts, cuts[1:], strict=False):
                for w in known.intersection(_SPLIT.findall(data, i, j)):
                    total[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in vocabulary] + [""]), pa.array([*total.values(), rows], pa.int64())], ["word", "n"])

    found = {r["word"]: r["n"] for r in docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in _vocabulary()}, found.get("", 0)


class Template:
    """One template: its words, the posted positions, its key phrases and their positions."""

    def __init__(self, label: str, text: str, keys: tuple[str, ...], base: bool, idf: dict[bytes, float]):
        self.label, self.base = label, base
        self.words = [w.encode() for w in text.split()]
        self.keys = [[w.encode() for w in k.split()] for k in keys]
        self.at = [next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k) for k in self.keys]
        self.slack = SLACK if len(self.words) > SHORT else 0
        self.weight = [idf[w] for w in self.words]
        self.mass = sum(self.weight)
        if base:
            self.posted, self.need = list(range(len(self.words))), len(self.words)
        elif not self.slack:
            # A one-line grant is called up by its key phrases: all their words must agree on the start.
            self.posted = sorted({i for a, k in zip(self.at, self.keys, strict=True) for i in range(a, a + len(k))})
            self.need = min(len(k) for k in self.keys)
        else:
            rare = sorted(set(self.words), key=lambda w: (-idf[w], w))[:RARE]
            self.posted = [i for i, w in enumerate(self.words) if w in rare]
            self.need = max(2, int(SHARE * len(self.posted)))


class Index:
    """Postings of the rarest words of all templates: word to (template, position)."""

    def __init__(self, df: dict[str, int], n: int):
        self.idf = {w.encode(): math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
        self.templates = [Template(label, t, keys, False, self.idf) for label, t, keys in TEMPLATES]
        self.templates += [Template(label, p, (p,), True, self.idf) for p, label in BASE]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, x in enumerate(self.templates):
            for p in x.posted:
                self.postings.setdefault(x.words[p], []).append((t, p))
        # A file is looked at in full only if it holds the rarest word of some key phrase.
        anchors = sorted({min(k, key=lambda w: (-self.idf[w], w)) for x in self.templates for k in x.keys})
        self.anchor = re.compile(b"|".join(map(re.escape, anchors)))

    def starts(self, words: list[bytes]) -> dict[int, dict[int, set[int]]]:
        """For each template: start to the posted positions that stand there."""
        found: dict[int, dict[int, set[int]]] = {}
        get = self.postings.get
        for i, w in enumerate(words):
            for t, p in get(w, ()):
                found.setdefault(t, {}).setdefault(i - p, set()).add(p)
        return found

    def verify(self, x: Template, words: list[bytes], start: int) -> int | None:
        """The place of a key phrase at its position from ``start``, give or take the slack."""
        for a, key in zip(x.at, x.keys, strict=True):
            for d in range(-x.slack, x.slack + 1):
                b = start + a + d
                if b >= 0 and words[b : b + len(key)] == key:
                    return b
        return None

    def share(self, x: Template, words: list[bytes], start: int) -> float:
        """The share of the IDF mass of ``x`` that stands at ``start``, in order, each word at most the slack away."""
        hit, at = 0.0, max(start - x.slack, 0)
        for k, w in enumerate(x.words):
            lo, hi = max(at, start + k - x.slack, 0), min(start + k + x.slack + 1, len(words))
            for b in range(lo, hi):
                if words[b] == w:
                    hit += x.weight[k]
                    at = b + 1
                    break
        return hit / x.mass

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Base places, base labels, all labels and the score of one file's words."""
        places, base, labels, score = [], set(), set(), 0.0
        for t, votes in self.starts(words).items():
            x = self.templates[t]
            order = sorted(votes)
            for i, start in enumerate(order):
                near = set(votes[start])
                for other in order[i + 1 :]:
                    if other > start + x.slack:
                        break
                    near |= votes[other]
                if len(near) < x.need:
                    continue
                if (found := self.verify(x, words, start)) is None:
                    continue
                labels.add(x.label)
                if x.base:
                    base.add(x.label)
                    places.append(found)
                else:
                    score = max(score, self.share(x, words, start))
        return sorted(places), base, labels, min(score, 1.0)


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    index = Index(*document_frequencies(docs, text))
    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            raw, off = utf8_column(b.column(1))
            is_word = _WORD[raw]
            begins = is_word.copy()
            begins[1:] &= ~is_word[:-1]
            heads = off[:-1][off[:-1] < off[1:]]
            begins[heads] = is_word[heads]
            upto = np.concatenate(([0], np.cumsum(begins)))
            counts = upto[off[1:]] - upto[off[:-1]]
            data, cuts = raw.tobytes().lower(), off.tolist()
            rows = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if index.anchor.search(data, i, j):
                    places, base, labels, score = index.scan(_SPLIT.findall(data, i, j))
                    rows.append((len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score))
                else:
                    rows.append((0, None, None, "", "", 0.0))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
                                             [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(key, text).mapInArrow(run, schema)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
