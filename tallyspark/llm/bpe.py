"""BPE encoding and decoding with a contiguous rank array (operator 7).

A word's parts are held in two flat arrays, the part boundaries and the rank of every adjacent pair.
The minimum rank is found by a scan, its boundary deleted, and only the two neighbouring ranks are
looked up again.  Words are short, so a scan beats a heap; a word of more than ``LONG`` parts, where
scans would cost the square of its length, keeps the ranks in a heap instead, with the same result.
A worker keeps the ids of the words it
has met in two bounded tables: when the newer is full it becomes the older, whose words come back
to the newer as they are met.

The vocabulary file is read by its public JSON format; normalising (NFC, white space, lower case)
and splitting follow the rules the file states.  Special tokens in the raw text are cut out first.
Long texts are encoded whole.

Nulls and odd input: a null text is empty and has no tokens, and the hashes of the empty string; a null
key is a value like any other; of equal lowest ranks the leftmost is merged first; equal rows are
separate rows; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, table

#: Words whose ids a worker remembers at most, in both tables together.
MOST_WORDS = 1 << 17
#: Parts from which on a word's ranks are kept in a heap.
LONG = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """An encoder and decoder for a vocabulary file with word-end marks."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {(a, b): i for i, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])}
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split)
        self.alphabet = byte_alphabet()
        self.complete = all(x in self.vocab and x + self.suffix in self.vocab for x in self.alphabet)
        self.known: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}
        self.normal = None

    def normalise(self, text: str) -> str:
        """NFC, runs of white space to one space, lower case by character."""
        if text.isascii():
            return text.lower()
        import unicodedata

        return lower_each(unicodedata.normalize("NFC", text))

    def merge(self, parts: list[str]) -> list[str]:
        """The parts of one word after all merges, lowest rank first, leftmost among equals."""
        if len(parts) > LONG:
            return self.merge_long(parts)
        get, far = self.ranks.get, len(self.ranks)
        whole = "".join(parts)
        bound = list(accumulate(map(len, parts), initial=0))
        near = [get(pair, far) for pair in pairwise(parts)]
        while near:
            low = min(near)
            if low == far:
                break
            i = near.index(low)
            del bound[i + 1], near[i]
            a, b = bound[i], bound[i + 1]
            part = whole[a:b]
            if i:
                near[i - 1] = get((whole[bound[i - 1] : a], part), far)
            if i < len(near):
                near[i] = get((part, whole[b : bound[i + 2]]), far)
        return [whole[a:b] for a, b in pairwise(bound)]

    def merge_long(self, parts: list[str]) -> list[str]:
        """``merge`` by a heap of (rank, place of the left part); entries of parts that have changed are passed over."""
        get, n = self.ranks.get, len(parts)
        part: list[str | None] = list(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(pairwise(parts)) if (r := get(pair)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if part[i] is None or j == n or get((part[i], part[j])) != r:
                continue
            part[i] += part[j]
            part[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := get((part[i], part[k]))) is not None:
                    heappush(heap, (new, i))
            h = before[i]
            if h >= 0 and (new := get((part[h], part[i]))) is not None:
                heappush(heap, (new, h))
        return [x for x in part if x is not None]

    def word(self, word: str) -> tuple[str, str, int]:
        """(ids joined by a space, tokens joined by a space, number of tokens), remembered."""
        if len(self.known) >= MOST_WORDS // 2:
            self.known, self.older = {}, self.known
        found = self.older.get(word) or self.merged(word)
        if len(word) <= LONG:  # so the tables' bytes are bounded as well
            self.known[word] = found
        return found

    def merged(self, word: str) -> tuple[str, str, int]:
        vocab = self.vocab
        parts = list(word.encode("utf-8").decode("latin-1").translate(self.alphabet))
        parts[-1] += self.suffix
        # Units that the vocabulary lacks, without an unknown token, are left out.
        if not self.complete:
            parts = [p for p in parts if p in vocab]
        tokens = self.merge(parts)
        return " ".join([str(vocab[t]) for t in tokens]), " ".join(tokens), len(tokens)

    def encode(self, text: str) -> tuple[str, str, int]:
        """(ids joined by a space, decoded text, number of tokens) of a whole text."""
        ids, tokens, n = [], [], 0
        word = self.word
        for run in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if run in self.special:
                ids.append(str(self.special[run]))
                tokens.append(run)
                n += 1
                continue
            for w in self.split.findall(self.normalise(run)):
                i, t, k = self.known.get(w) or word(w)
                ids.append(i)
                tokens.append(t)
                n += k
        return " ".join(ids), " ".join(tokens), n

    def encode_ids(self, text: str) -> list[int]:
        ids = self.encode(text)[0]
        return [int(x) for x in ids.split(" ")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by one space; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def lower_each(text: str) -> str:
    """Lower case character by character, without the final-sigma rule."""
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


def encoder(path: str) -> WordBpe:
    """The encoder of this process; a reused worker keeps it, and the words it has met, from task to task."""
    held = sys.modules.setdefault("_tallyspark_worker_state", types.ModuleType("_tallyspark_worker_state"))
    encoders = held.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = WordBpe(path)
    return encoders[path]


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and with ``ids`` the ids and the decoded text."""
    path = path or default_vocabulary()
    bounded_batches(docs.sparkSession)

    @frugal
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = encoder(path)
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            n, a, c, raw, back = [], [], [], [], []
            for x in b.column(1):
                i, t, k = own.encode(x.as_py() or "")
                n.append(k)
                a.append(sha(i))
                c.append(sha(t))
                if ids:
                    raw.append([int(v) for v in i.split(" ")] if i else [])
                    back.append(t)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array(raw, pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
