"""The corpus pipeline as a whole against plain Python, stage by stage, on a small corpus."""

import hashlib
import random

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tallyspark.llm import bpe, mixing  # noqa: E402


def _words(g, n):
    return ["".join(g.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def _corpus():
    g = random.Random(71)
    rows, toxic, passage = [], {}, " ".join(_words(g, 40))
    for i in range(120):
        bad = i % 5 == 0
        w = _words(g, 60 + g.randrange(60)) + (["idiot", "moron"] if bad else [])
        if i % 7 == 1:
            w[10:10] = passage.split(" ")
        rows.append((i, " ".join(w), ["en", "de"][i % 2], f"s{i % 4}"))
        if i % 2 == 0:
            toxic[i] = int(bad)
    for k in range(1, 9):  # near and exact copies of clean documents
        w = rows[k * 11][1].split(" ")
        if k % 2:
            w[5] = "changed"
        rows.append((500 + k, " ".join(w).upper() if k == 4 else " ".join(w), "en", "s1"))
    return [(i, t, lang, s, len(t)) for i, t, lang, s in rows], toxic


def _near(rows):
    """Exact Jaccard of five-word shingles over all pairs; the smallest key of each group."""
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for x, r in enumerate(rows):
        least[top(x)] = min(least.get(top(x), r[0]), r[0])
    return [r for x, r in enumerate(rows) if r[0] == least[top(x)]]


def _stripped(rows, width=100):
    seen, out = set(), []
    for i, t, lang, s, _ in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if b[k : k + width] in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(b[k : k + width])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append((i, kept, lang, s, len(kept)))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rows, toxic = _corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, docs = rows, spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = {
        "toxicity": lambda r: [x for x in r if "idiot" not in x[1]],
        "simhash_near_dedup": _near,
        "suffix_array_dedup": _stripped,
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == [*plain, "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs, want = spark.read.parquet(f"{tmp_path}/{name}.parquet"), plain[name](want)
        assert sorted(tuple(r) for r in docs.collect()) == sorted(want), name
    assert len(want) < len(rows) and sum(len(r[1]) for r in want) < sum(len(r[1]) for r in rows if r[0] in {x[0] for x in want})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/suffix_array_dedup.parquet/*.parquet'")
    copies = {i: taken // size for i, size, _, _, taken in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP1_SQL})").fetchall()}
    lib = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    final = []
    for i, t, *_ in want:
        ids = lib.encode(t, add_special_tokens=False).ids
        final += [(i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))] * copies[i]
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(tuple(r) for r in got.collect()) == sorted(final)
