"""The training-data operators against brute force, on small fixtures with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tallyspark.llm import bpe, common, embedding_dedup, flac, licences, mixing, repeats, simhash, substring_dedup, toxicity, url_rules

RND = random.Random(7)
BASES = [" ".join(RND.choice(["alpha", "be", "cd", "gamma", "é", "zz"]) for _ in range(260)) for _ in range(3)]


def corpus():
    rows = []
    for i in range(60):
        parts = []
        for _ in range(RND.randrange(1, 5)):
            b = RND.choice(BASES)
            a = RND.randrange(len(b))
            parts.append(b[a : a + RND.randrange(420)] if RND.random() < 0.6 else "".join(RND.choice("ab ") for _ in range(90)))
        rows.append((i * 3 + 1, "".join(parts), f"s{i % 3}"))
    rows += [(500 + i, rows[3][1], None) for i in range(4)]
    return rows + [(600, None, "s0"), (601, "", "s1"), (602, " \t\n", "s1"), (603, "w " * 300, "s2"), (604, "a" * 900, "s2"), (605, "Released under the MIT License. <|endoftext|>", "s0")]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)


def by_key(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_mixing_totals_and_bounds(docs):
    m = mixing.mix_sources(docs).collect()
    total = sum(r["__size"] for r in m)
    targets = {r["source"]: r["__target"] for r in m}
    assert len(m) == len(ROWS) and all(0 <= r["__copies"] <= 2 for r in m)
    assert math.isclose(sum(targets.values()), 1.5 * total)
    assert all(r["__target"] <= 2 * r["__source_size"] + 1e-9 for r in m)
    assert mixing.mixed(docs).count() == sum(r["__copies"] for r in m)
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_comes_near_every_target(spark):
    g = random.Random(61)
    rows = [(i, " ".join("w" * (1 + k % 3) for k in range(int(3 * 1.9 ** g.randrange(1, 11)))), f"s{i % 7}") for i in range(350)]
    rows += [(None, "a b c", "s1"), (7, "a b c", "s1"), (7, "a b c", "s1")]
    m = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    for s in {r["source"] for r in m}:
        own = [r for r in m if r["source"] == s]
        taken = sum(r["__copies"] * r["__size"] for r in own)
        assert abs(taken - own[0]["__target"]) <= 0.05 * own[0]["__target"]


def brute_bytes(rows, w=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - w + 1):
            if b[k : k + w] in seen:
                gone[k : k + w] = b"\1" * w
            seen.add(b[k : k + w])
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def brute_words(rows, w=50):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode().split()
        gone, new = bytearray(len(b)), set()
        for k in range(len(b) - w + 1):
            s = tuple(b[k : k + w])
            if s in seen:
                gone[k : k + w] = b"\1" * w
            new.add(s)
        seen |= new
        out[i] = (len(b), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_mixing_writes_two_tables(docs, monkeypatch):
    written, write = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, label: (written.append(label), write(df, label))[1])
    assert mixing.mix_sources(docs).count() == len(ROWS) and written == ["sizes", "offsets"]


def test_repeated_bytes(docs):
    assert by_key(substring_dedup.dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes([r[:2] for r in ROWS])


def test_repeated_words(docs):
    assert by_key(substring_dedup.dedup_words(docs), "n_words", "n_removed", "kept_sha256") == brute_words([r[:2] for r in ROWS])


def test_repeats_with_small_batches(spark, docs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert by_key(substring_dedup.dedup_bytes(docs), "n_removed") == {k: (v[1],) for k, v in brute_bytes([r[:2] for r in ROWS]).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def components(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return [top(i) for i in range(n)]


def test_simhash_groups(docs):
    ids, fps = [r[0] for r in ROWS], np.array([simhash.fingerprint(r[1]) for r in ROWS], np.uint64)
    order = np.argsort(ids)
    ids, fps = [ids[i] for i in order], fps[order]
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = {ids[i]: (ids[c],) for i, c in enumerate(components(len(ids), near))}
    assert by_key(simhash.simhash_groups(docs), "component_id") == want


def test_simhash_broadcasts_no_table_of_documents(docs, monkeypatch):
    plans, write = [], common.materialize

    def planned(df, label):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, label)

    monkeypatch.setattr(common, "materialize", planned)
    monkeypatch.setattr(simhash, "materialize", planned)
    last = simhash.simhash_groups(docs)
    plans.append(last._jdf.queryExecution().sparkPlan().toString())
    chain = docs.sparkSession.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {r["component"] for r in common.connected_components(chain).collect()} == {0}
    assert sum(p.count("SortMergeJoin") for p in plans) >= 8 and not any("Broadcast" in p for p in plans)


def test_fingerprints_bit_by_bit(docs):
    """Plain loops over shingles and bits; only the hash function is shared."""
    import xxhash

    got = by_key(simhash.fingerprints(docs), "fp")
    for i, t, _ in ROWS:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i] == (fp - (1 << 64) if fp >> 63 else fp,)


def test_similar_groups_against_exact_jaccard(spark):
    g = random.Random(11)
    rows, sets = [], {}
    for i in range(40):
        base = [f"w{g.randrange(4000)}" for _ in range(300)]
        for j in range(1 + 5 * (i % 2)):
            w = list(base)
            for _ in range(j):
                w[g.randrange(300)] = f"x{g.randrange(4000)}"
            rows.append((len(rows) + 1, " ".join(w)))
    rows += [(900, rows[0][1].upper()), (901, None), (902, ""), (903, "one two"), (904, "ONE  two"), (None, "one two")]
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [r[0] for r in rows]
    sure, loose = [], []
    for x, a in enumerate(ids):
        for y in range(x):
            s, t = sets[a], sets[ids[y]]
            j = len(s & t) / len(s | t) if s | t else 1.0
            sure += [(y, x)] * (j >= 0.9)
            loose += [(y, x)] * (j >= 0.65)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[ids[y]] == got[ids[x]] for y, x in sure)
    comp = components(len(ids), loose)
    assert all(comp[x] == comp[y] for x in range(len(ids)) for y in range(x) if got[ids[x]] == got[ids[y]])
    assert simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(set(got.values()))


def test_dense_buckets_stay_connected(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NEAR_TILE", 40)
    monkeypatch.setattr(simhash, "TILE", 16)
    g = random.Random(12)
    base = [f"w{g.randrange(4000)}" for _ in range(400)]
    rows = []
    for i in range(120):
        w = list(base)
        w[g.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_embeddings(spark):
    g = np.random.default_rng(3)
    base = g.standard_normal((6, 64))
    rows = [(i, [float(x) for x in (base[i % 6] + 0.1 * g.standard_normal(64)).astype(np.float32)], i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 64, 0), (204, [float("nan")] + [1.0] * 63, 0), (205, [1.0, None], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: (np.array(v, np.float64), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, (x, l) in good.items() for b, (y, m) in good.items() if a != b and l == m and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    ids = [r[0] for r in rows]
    comp = components(len(ids), [(ids.index(a), ids.index(b)) for a, b in links])
    want = {i: (sum(a == i for a, _ in links), ids[c]) for i, c in zip(ids, comp, strict=True)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == want


def test_hot_cells_split_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "VISITORS", 16)
    monkeypatch.setattr(embedding_dedup, "NEAR_TILE", 32)
    monkeypatch.setattr(embedding_dedup, "NEAR_VISITORS", 16)
    g = np.random.default_rng(5)
    x = (np.ones(16) + 0.02 * g.standard_normal((120, 16)))
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: int(n) for i, n in enumerate((u @ u.T >= 0.98).sum(1) - 1)}
    assert {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(df).collect()} == want


def brute_licences(rows):
    """Every column by plain loops over all starts, not only those that the postings name."""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {i: word.findall((t or "").encode().lower()) for i, t in rows}
    vocabulary = {w for _, t, _ in licences.TEMPLATES for w in t.split()} | {w for p, _ in licences.BASE for w in p.split()}
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w.encode() in set(x) for x in texts.values()))) + 1 for w in vocabulary}
    out = {}
    for i, w in texts.items():
        places, base, labels, score = [], set(), set(), 0.0
        for p, label in licences.BASE:
            k = p.encode().split()
            at = [a for a in range(len(w)) if w[a : a + len(k)] == k]
            places += at
            base |= {label} if at else set()
        for label, t, keys in licences.TEMPLATES:
            t = t.split()
            slack = licences.SLACK if len(t) > licences.SHORT else 0
            key_at = [(next(a for a in range(len(t)) if t[a : a + len(k.split())] == k.split()), k.encode().split()) for k in keys]
            if slack:
                rare = sorted(set(t), key=lambda x: (-idf[x], x))[: licences.RARE]
                posted = [p for p, x in enumerate(t) if x in rare]
                need = max(2, int(licences.SHARE * len(posted)))
            else:
                posted = sorted({p for a, k in key_at for p in range(a, a + len(k))})
                need = min(len(k) for _, k in key_at)
            stands = lambda s: {p for p in posted if 0 <= s + p < len(w) and w[s + p] == t[p].encode()}  # noqa: E731, B023
            for s in range(-len(t), len(w)):
                if not stands(s) or len(set().union(*(stands(s + d) for d in range(slack + 1)))) < need:
                    continue
                if not any(s + a + d >= 0 and w[s + a + d : s + a + d + len(k)] == k for a, k in key_at for d in range(-slack, slack + 1)):
                    continue
                labels.add(label)
                mass, at = 0.0, 0
                for p, x in enumerate(t):
                    hit = [b for b in range(max(at, s + p - slack, s - slack, 0), min(s + p + slack + 1, len(w))) if w[b] == x.encode()]
                    if hit:
                        mass, at = mass + idf[x], hit[0] + 1
                score = max(score, mass / sum(idf[x] for x in t))
        labels |= base
        places.sort()
        out[i] = (len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), round(min(score, 1.0), 9))
    return out


def test_licences_against_brute_force(spark):
    g = random.Random(51)
    mit, apache, gpl = (next(t for a, t, _ in licences.TEMPLATES if a == x and len(t.split()) > 30) for x in ("mit", "apache", "gpl"))
    rows = list(dict.fromkeys([r[:2] for r in ROWS[::6]] + [r[:2] for r in ROWS[-6:]]))
    for i, t in enumerate([mit, apache, gpl]):
        w = t.split()
        for j in range(6):
            x = [y for y in w if g.random() > 0.03 * j]
            x.insert(g.randrange(len(x)), "Inserted, words!")
            rows.append((700 + 10 * i + j, "Intro text. " + " ".join(x[: len(x) - 12 * j]).replace(" the ", " The ") + ". The end"))
    rows += [(800, "See the MIT license; the mit  LICENSE. mit-license"), (801, "GNU Lesser General Public License"), (802, mit + " " + apache + " mit license"), (803, "general public\x00license"), (804, "mit license " * 3)]
    got = {r["doc_id"]: (*tuple(r)[1:-1], round(r["score"], 9)) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_licences(rows)
    assert got[605][1:6] == (1, 3, 3, "mit", "mit") and got[605][6] == 1.0 and got[800][1] == 3 and 0 < got[801][6] < 1 and got[802][5] == "apache,mit"


def test_toxicity_learns_the_words(spark):
    g = random.Random(2)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(8))
    text = lambda bad: " ".join([g.choice(["the", "of", "and", "tree", word()]) for _ in range(30)] + bad)
    rows = [(i, text(["idiot", "moron"][i % 4 // 2 :] if i % 4 < 2 else [])) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 < 2) for i in range(400)) and got[900] == got[901] < 0.5
    kept = {r["doc_id"] for r in toxicity.clean(docs, model).collect()}
    assert kept == {i for i in got if got[i] < 0.5}


def test_bpe_against_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    lib, own = tokenizers.Tokenizer.from_file(bpe.default_vocabulary()), bpe.WordBpe(bpe.default_vocabulary())
    odd = ["Hello  World's I'LL <|endoftext|>x", "ΣΑΣ ΟΔΟΣ İ", "ﬁ é Å", "日本語 १२३ ½", "x\x1cy\x85z", "a" * 300, "😀 don't!!!"]
    for x in odd + [r[1] or "" for r in ROWS]:
        ids = lib.encode(x, add_special_tokens=False).ids
        assert own.encode_ids(x) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, t, _ in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert by_key(bpe.encode_documents(docs), "n_tokens", "ids_sha256", "decoded_sha256") == want and want[600][0] == 0


def test_bpe_of_long_words():
    tokenizers = pytest.importorskip("tokenizers")
    lib, own, g = tokenizers.Tokenizer.from_file(bpe.default_vocabulary()), bpe.WordBpe(bpe.default_vocabulary()), random.Random(8)
    for n in (257, 400, 3000):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "éñ日"):
            word = "".join(g.choice(letters) for _ in range(n))
            assert own.encode_ids(word) == lib.encode(word, add_special_tokens=False).ids
    for _ in range(500):
        parts = [g.choice("thereandingtion") for _ in range(g.randrange(2, 40))]
        assert own.merge(parts) == own.merge_long(parts)


def test_flac_round_trip():
    g = random.Random(4)
    texts = [r[1] for r in ROWS] + ["".join(chr(g.randrange(1, 0x2FFF)) for _ in range(5000)), "\x00" * 4000 + "\U0010ffff" * 50]
    payloads = [flac.payload_of(t)[1] for t in texts]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    assert flac.encode([payloads[5]])[0] == streams[5]
    for at in (-20, len(streams[5]) // 2):
        bad = bytearray(streams[5])
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_flac_in_pieces_and_long_blocks(monkeypatch):
    g = random.Random(6)
    texts = ["".join(g.choice("abcdefgh \n") for _ in range(n)) for n in (1, 5000, 70_000, 3000)] + ["", "x" * 20_000]
    payloads = [flac.payload_of(t)[1] for t in texts]
    whole, features = flac.encode(payloads), [flac.feature(p) for p in payloads]
    monkeypatch.setattr(flac, "PIECE", 4000)
    assert flac.encode(payloads) == whole and flac.decode(whole) == payloads and [flac.feature(p) for p in payloads] == features
    monkeypatch.setattr(flac, "MOST_POINTS", 10)
    long = flac.encode(payloads)
    assert flac.decode(long) == payloads and long[0] == whole[0] and long[2] != whole[2] and len(flac.seek_points(long[2])[2]) == 4


def test_flac_query_columns(docs):
    import zlib

    rows = {r["doc_id"]: r for r in flac.store_media(docs, media=True).collect()}
    for i, t, _ in ROWS:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        s = np.array([x - 128 for x in p])
        assert r["feature"] == f"energy={(s * s).sum()};turns={sum((a < 0) != (c < 0) for a, c in zip(s[:-1], s[1:], strict=True))};peak={abs(s).max()}"
        assert (r["media_bytes"], r["media_sha256"], r["n_blocks"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest(), len(r["blocks"]))
        assert b"".join(x["pcm"] for x in r["blocks"]) == p
        for x in r["blocks"]:
            assert flac.read_block(r["media"], x["first_sample"] + 1) == (x["first_sample"], x["pcm"])
        lines = "\n".join(f"{x['first_sample']},{x['offset']},{len(x['pcm'])}" for x in r["blocks"])
        assert r["seek_sha256"] == hashlib.sha256(lines.encode()).hexdigest()


def brute_rule(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest)) if rest is not None else 0
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]) if rest is not None else ""
    path = rest[cut:] if rest is not None and rest[cut : cut + 1] == "/" else ""
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_url_rules_against_brute_force(spark):
    urls = ["http://A.Net/x", "https://blog.example.net/en/1?q", "https://example.net/de/", "http://example.com/de/#a", "//nothing", None, "http://org/fr/", "http://x.org:80/fr/", "http://net", "http://notexample.net/en/", "http://b.org/fr/x?y", "", "://", "x://y://z/é"]
    g = random.Random(41)
    rules = list(dict.fromkeys((".".join(g.choice("abc") for _ in range(g.randrange(1, 5))), g.choice(["/", "/x", "/x/y", ""])) for _ in range(90)))
    rules = [(h, p, g.choice(["allow", "block"])) for h, p in rules]
    urls += ["http://" + ".".join(g.choice("abc") for _ in range(g.randrange(1, 6))) + g.choice(["/", "/x/yz", "/x/y", "", "?q"]) for _ in range(600)] + ["http://hot.a/x"] * 400
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    for these in (list(url_rules.RULES), rules, [], [(f"h{i}.a", "/", "block") for i in range(3000)] + rules):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.apply_rules(pages, these).collect()}
        assert got == {i: brute_rule(u, these, "allow") for i, u in enumerate(urls)}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed(d).count() == substring_dedup.dedup_bytes(d).count() == simhash.simhash_groups(d).count() == licences.scan_licences(d).count() == 0
    assert flac.store_media(d).count() == bpe.encode_documents(d).count() == substring_dedup.dedup_words(d).count() == 0
    e = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(e).count() == url_rules.apply_rules(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_words_repeat_around_runs_of_one_word(spark):
    rows = []
    for seed in range(60):
        g = random.Random(seed)
        tail = [f"x{g.randrange(10**6)}" for _ in range(60)]
        rows.append((2 * seed, " ".join(["w"] * 60 + tail + [f"p{seed}"])))
        rows.append((2 * seed + 1, " ".join([f"v{seed}"] + ["w"] * 48 + tail[: g.randrange(2, 40)] + [f"q{seed}"])))
    got = by_key(substring_dedup.dedup_words(spark.createDataFrame(rows, "doc_id long, text string")), "n_words", "n_removed", "kept_sha256")
    assert got == brute_words(rows)


def test_rows_listed_twice_keep_their_text(spark):
    g = [random.Random(s) for s in (21, 22, 23)]
    a, b, c = ("".join(x.choice("abcdefgh ") for _ in range(1500)) for x in g)
    rows = [(None, c), (None, c), (1, a), (1, a), (1, a), (2, b + a[200:700]), (2, b + a[200:700]), (3, c[100:400] + b[:300])]
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in substring_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = brute_bytes([(-1 if i is None else i, t) for i, t in dict.fromkeys(rows)])
    assert got == {(None if i < 0 else i, v[0], v[1]) for i, v in want.items()}
    stripped = substring_dedup.strip_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(stripped) == len(rows) and all(r["text"] == (a if r["doc_id"] else c) for r in stripped if r["doc_id"] in (None, 1))


def test_a_row_listed_a_thousand_times(spark):
    g = random.Random(24)
    a, b = ("".join(g.choice("abcdefgh ") for _ in range(600)) for _ in range(2))
    rows = [(1, a)] * 1000 + [(2, b + a[100:400])] * 3 + [(None, a[:300] + b)]
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    want = brute_bytes([(-1 if i is None else i, t) for i, t in dict.fromkeys(rows)])
    assert got == {(None if i < 0 else i, *v) for i, v in want.items()}


def test_equal_names_are_told_apart_by_the_context(spark, monkeypatch):
    """With a name of four values every rank rests on the second key."""
    whole = repeats._join
    monkeypatch.setattr(repeats, "_span_name", lambda *a: whole(a[0][-1][a[1]], a[0][-1][a[1]], a[3]) & np.uint64(3))
    monkeypatch.setattr(repeats.Bytes, "anchors", lambda self, *a, f=repeats.Bytes.anchors: (*(x := f(self, *a))[:3], x[3] & np.uint64(3)))
    rows = [r[:2] for r in ROWS]
    raw = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len((t or "").encode()) for _, t in rows])))
    ranks, strings = {}, {}
    for row, lo, n, offset, name, ctx in repeats._runs_of(repeats.Bytes(), raw, off):
        for r, a, k, o, x, c in zip(row.tolist(), lo.tolist(), n.tolist(), offset.tolist(), name.tolist(), ctx.tolist(), strict=True):
            s = (raw[off[r] + a : off[r] + a + k + 99].tobytes(), o)
            assert ranks.setdefault((x, c), s) == s and strings.setdefault(s, (x, c)) == (x, c)


def test_columns_of_clashing_names(spark):
    names = "__size __source_size __copies __spans __doc __tag doc tag spans row s k t h salt rank start at u g __hash __key __y rule host verdict".split()
    extra = [f"'x' AS `{c}`" for c in names]
    g = random.Random(25)
    texts = ["".join(g.choice("abcdefgh ") for _ in range(300)) for _ in range(4)]
    d = spark.createDataFrame([(i, texts[i % 4] + "tail", "s") for i in range(8)], "doc_id long, text string, source string").selectExpr("*", *extra)
    assert mixing.mixed(d).columns == d.columns and {r["__size"] for r in mixing.mixed(d).collect()} == {"x"}
    assert {r["__size"] for r in mixing.mix_sources(d).collect()} != {"x"}
    for out in (substring_dedup.strip_bytes(d), simhash.keep_one(d), toxicity.clean(d, toxicity.Model({}, -1.0, 0.5))):
        assert out.columns == d.columns and {r["__spans"] + r["__hash"] + r["tag"] for r in out.collect()} == {"xxx"}
    for out in (simhash.simhash_groups(d), licences.scan_licences(d), flac.store_media(d), bpe.encode_documents(d), url_rules.apply_rules(d, key="doc_id", url="text")):
        assert out.count() == 8
    e = d.selectExpr("doc_id AS vec_id", "array(1.0D, doc_id) AS embedding", "0 AS label", *extra, "'x' AS id", "'x' AS cid", "'x' AS payload")
    assert embedding_dedup.near_vectors(e).count() == 8


def test_toxicity_learns_from_whole_texts(spark):
    filler = "the of and tree " * 1500
    g = random.Random(3)
    rows = [(i, filler + "".join(g.choice("abcdefgh") for _ in range(8)) + (" idiot" if i % 4 < 2 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(0, 200, 2)], "doc_id long, toxic int"))
    assert {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] >= 0.5} == {i for i in range(200) if i % 4 < 2}


def test_toxicity_brings_no_words_to_the_driver(spark, monkeypatch):
    g = random.Random(4)
    common = ["".join(g.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    rows = [(i, " ".join(common + ["".join(g.choice("abcdefgh") for _ in range(12)) for _ in range(40)] + ["idiot"] * (i % 4 < 2))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    cells, whole = [], type(docs).collect

    def size(x):
        return sum(map(size, x)) if isinstance(x, (list, tuple)) else 1

    def collect(df):
        out = whole(df)
        cells.append(max((size(tuple(r)) for r in out), default=0) * len(out))
        return out

    monkeypatch.setattr(type(docs), "collect", collect)
    model = toxicity.train(docs, labels)
    assert model.weights.keys() == {"idiot"} and sum(cells) < 400 * 12
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    sets = [[toxicity.words(rows[i][1]) for i in held if (i % 4 == 0) == bad] for bad in (True, False)]
    assert toxicity.fit(*sets, model.prior).weights == pytest.approx(model.weights)
    assert toxicity.train(docs.repartition(5), labels) == model


def test_similar_groups_meet_exact_links_near_the_threshold(spark):
    g = random.Random(31)
    rows, links = [], []
    for i in range(80):
        n, off = 100 + g.randrange(100), g.randrange(-3, 4)
        new = round(n * (1 - 0.8) / (1 + 0.8)) + off  # n shared-length texts, their ends differ
        base = [f"w{g.randrange(10**6)}" for _ in range(n + 4)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[: n + 4 - new] + [f"y{i}z{k}" for k in range(new)]))]
        links.append((n - new) / (n + new) >= 0.8)
    assert 20 < sum(links) < 60
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(80)] == links


def test_candidates_compared_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 2)
    g = random.Random(32)
    rows, base = [], [f"w{g.randrange(10**6)}" for _ in range(304)]
    for i in (0, *range(30, 37)):  # (300 - i) / (300 + i) of the shingles are shared
        rows.append((i, " ".join(base[: 304 - i] + [f"y{i}z{k}" for k in range(i)])))
    got = {r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0, 34, 35, 36}


@pytest.mark.parametrize(("small", "tile"), [(64, 8192), (0, 16)])
def test_candidates_go_only_to_the_bucket_of_their_first_meeting(spark, monkeypatch, small, tile):
    """A crowd without links: every pair is sent to at most one bucket, however many it shares."""
    got, write = [], common.materialize

    def kept(df, label):
        out = write(df, label)
        if label == "candidates":
            got.extend((r["block"], r["cell"], r["cid"]) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "materialize", kept)
    monkeypatch.setattr(simhash, "SMALL_TILE", small)
    monkeypatch.setattr(simhash, "NEAR_TILE", tile)
    monkeypatch.setattr(simhash, "PASSES", simhash.PASSES[:3])
    g = random.Random(34)
    base, rows = [f"w{g.randrange(10**6)}" for _ in range(204)], []
    for i in range(40):  # pairs share 175 or 150 of 200 shingles, a similarity of 0.78 or 0.6
        rows.append((i, " ".join(base[:179] + [f"y{i}z{k}" for k in range(25)]) if i % 2 else " ".join([f"y{i}z{k}" for k in range(25)] + base[25:])))
    rows += [(90, " ".join(base[:60])), (91, " ".join(base[:58]))]  # one link, of nearly equal fingerprints
    near = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = components(92, linked)
    assert {r["doc_id"]: r["component_id"] for r in near} == {i: comp[i] for i in sets}
    marks = [simhash.wide_fingerprint(t) for _, t in rows]
    x = np.array([m[2] for m in marks], np.int64).view(np.uint64)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1)
    cells = np.concatenate([np.ascontiguousarray(np.packbits(bits[:, np.random.default_rng(o).permutation(512)], axis=1)).view(np.uint16) for o in range(3)], axis=1)
    want = set()
    for a in range(len(rows)):
        for b in range(a):
            n, m = sorted((marks[a][1], marks[b][1]))
            shared = np.flatnonzero(cells[a] == cells[b])
            if n >= 0.8 * m and np.bitwise_count(x[a] ^ x[b]).sum() <= 112 and len(shared):
                assert comp[rows[a][0]] != comp[rows[b][0]] or shared[0] < 32
                want |= {(int(shared[0]), cells[c][shared[0]].tobytes(), marks[c][0]) for c in (a, b)}
    assert len(want) > 100 and sorted((k, bytes(c), n) for k, c, n in got) == sorted(want)


def test_keep_one_of_each_group_whatever_the_keys(spark):
    g = random.Random(33)
    a, b, c, d = (" ".join(f"w{g.randrange(10**6)}" for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (5, d.upper()), (7, c), (None, d), (9, None), (None, ""), (None, "one")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(kept) == 6 and {(r["doc_id"], (r["text"] or "").lower()) for r in kept} == {(None, a), (None, b), (5, c), (5, d), (9, ""), (None, "one")}
