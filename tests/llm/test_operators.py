"""The ten operators on small tables: brute force, round trips, and nulls, empties, ties, repeats and odd columns."""

import hashlib
import random
import re
import time
import zlib

from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import embeddings, html, language, ngrams, packing, prefixes, quality, queries, simhash, tokens, urlfilter, wavelet, wordtable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 97} and{i % 13}" for i in range(30_000))
TEXTS = [
    (1, "The cat sat on the mat, don't you THINK so? <|endoftext|> é́ ß 漢字 　x\n\n a  b \n"),
    (2, None),
    (3, ""),
    (4, "  \t\n "),
    (5, "The cat sat on the mat, don't you THINK so? <|endoftext|> é́ ß 漢字 　x\n\n a  b \n"),
    (5, "repeated row"),
    (5, "repeated row"),
    (6, LONG),
    (7, "12 34 !!"),
]
#: Extra columns with names that the operators use themselves.
SCHEMA = "doc_id bigint, text string, score double, start bigint, block string, kept boolean, fp bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, None, None, "x", None, None) for k, t in TEXTS], SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


def key(k, t):
    return (k, t or "")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    path = tokens.default_path(name)
    assert not tokens.unreachable(path)
    e, rng = tokens.Encoder(path), random.Random(3)
    alphabet = "ab ' \n\t\xa0é́ßİΣς漢٣½12,.!<|endoftext|>​　ﬁ"
    texts = [t or "" for _, t in TEXTS if t != LONG] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.hf.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_places_each_id_once(docs, none):
    hf = tokens.library(tokens.default_path("byte_bpe_50k.json"))
    want = sorted([*hf.encode(t or "", add_special_tokens=False).ids, 0] for _, t in TEXTS)
    rows = packing.pack_documents(docs).collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    got = []
    for (_, n), parts in by.items():
        parts.sort()
        copies = sum(len(p) for _, p in parts) // n
        for c in range(copies):
            got.append([x for _, p in parts[c::copies] for x in p])
    assert sorted(got) == want
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack_documents(none).count() == 0


def test_packing_holds_all_three_limits(spark):
    rng = random.Random(1)
    rows = [(k, list(range(n)), rng.randint(0, n)) for k, n in enumerate(rng.randint(0, 90) for _ in range(400))]
    df = spark.createDataFrame(rows, "id int, ids array<int>, loss int")
    got = packing.pack_examples(df, "id", "ids", "loss", 64, 4, 40).collect()
    sums: dict = {}
    for r in got:
        s = sums.setdefault(r["sequence_id"], [0, 0, 0])
        s[0] += r["length"]
        s[1] += 1
        s[2] += r["loss_tokens"]
    assert all(a <= 64 and b <= 4 and c <= 40 for a, b, c in sums.values())
    assert sum(r["length"] for r in got) == sum(len(x) for _, x, _ in rows) and sum(r["loss_tokens"] for r in got) == sum(x for *_, x in rows)


def test_wavelet_matrix_round_trip(docs, none):
    hf = tokens.library(tokens.default_path("word_bpe_49k.json"))
    store = wavelet.write_documents(docs)
    want, at = [], 0
    for k, t in sorted(TEXTS, key=lambda x: key(*x)):
        ids = [*hf.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, at, ids))
        at += len(ids)
    got = sorted((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in store.documents().collect())
    assert got == want
    flat = [x for *_, ids in want for x in ids]
    assert {r["token"]: r["n"] for r in store.counts([2, flat[0]]).collect()} == {2: len(want), flat[0]: flat.count(flat[0])}
    assert sorted(r["place"] for r in store.occurrences(2).collect()) == [i for i, x in enumerate(flat) if x == 2]
    assert wavelet.write_documents(none).documents().count() == 0


def test_rows_without_ids(spark):
    """Null ids stay null, in each operator that carries the id along; an id that isn't an integer is refused by the files."""
    d = spark.createDataFrame([(None, "one two"), (None, None), (3, "one two")], "doc_id bigint, text string")
    assert {(str(r["doc_id"]), r["doc_tokens"]) for r in packing.query(d).collect()} == {("3", 3), ("None", 1), ("None", 3)}
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in wordtable.encode_decode(d).collect()) == [("3", 2), ("None", 0), ("None", 2)]
    assert [(r["doc_id"], r["start"]) for r in wavelet.write_documents(d).documents().orderBy("start").collect()] == [(None, 0), (None, 1), (3, 4)]
    with pytest.raises(TypeError):
        wavelet.write_documents(d.withColumn("doc_id", F.lit("a")))


def test_packing_limits_are_checked(spark):
    d = spark.createDataFrame([(1, [1, 2], 1)], "id int, ids array<int>, loss int")
    for limits in ((0, 1, 1), (8, 0, 1), (8, 1, 0), (8, 1, -1)):
        with pytest.raises(ValueError):
            packing.pack_examples(d, "id", "ids", "loss", *limits)


def test_wavelet_shard_answers():
    rng = np.random.default_rng(0)
    for n in (1, 511, 512, 513, 3000):
        x = (rng.zipf(1.3, n) % 49_408).astype(np.uint32)
        s = wavelet.Shard(wavelet.build(x, [5, None], np.array([0, n // 2, n])))
        assert (s.tokens() == x).all() and s.doc_ids == [5, None]
        for i in map(int, rng.integers(0, n, 20)):
            assert s.access(i) == x[i] and s.rank(int(x[i]), i) == (x[:i] == x[i]).sum()
        for t in map(int, x[:5]):
            assert [s.find(t, k) for k in range(s.count(t))] == np.flatnonzero(x == t).tolist()
        for t in (0, 1, 5, int(x.max())):
            assert s.places(t).tolist() == np.flatnonzero(x == t).tolist()
        assert s.count(60_000) == 0 and len(s.places(60_000)) == 0
        with pytest.raises(IndexError):
            s.find(60_000, 0)


def test_word_table_equals_library(docs, none):
    hf = tokens.library(tokens.default_path("word_bpe_49k.json"))
    want = []
    for k, t in TEXTS:
        ids = hf.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(hf.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in wordtable.encode_decode(docs, full=False).collect()) == sorted(want)
    assert wordtable.encode_decode(none).count() == 0


def components_of(n, near):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprint_by_hand():
    def slow(t):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for _, t in TEXTS[:8]:
        assert simhash.fingerprint(t) == slow(t)


def test_fingerprint_parts():
    for words in (3, 5, 4):
        one, four = simhash.fingerprint(LONG, words), simhash.fingerprint(LONG, words, parts=4)
        assert four >> 192 == one and four.bit_length() <= 256
    assert simhash.fingerprint(LONG, 5) != simhash.fingerprint(LONG, 3) and simhash.fingerprint(None, parts=4) == 0


def clusters(rng, bits, centres, members, flips):
    points = set()
    for c in [rng.getrandbits(bits) for _ in range(centres)] + [0]:
        for _ in range(members):
            v = c
            for _ in range(rng.randint(0, flips)):
                v ^= 1 << rng.randrange(bits)
            points.add(v)
    return sorted(points)


def labels_of(spark, fps, size, search, group_rows):
    df = spark.createDataFrame([(x.to_bytes(size, "big"),) for x in fps], "fp binary")
    got = simhash.components.connected_components(simhash.links(df, search, group_rows), "a", "b")
    label = {bytes(r["node"]): bytes(r["component"]) for r in got.collect()}
    return [int.from_bytes(label.get(x.to_bytes(size, "big"), x.to_bytes(size, "big")), "big") for x in fps]


@pytest.mark.parametrize("group_rows", [10_000, 20])
def test_simhash_links(spark, group_rows):
    """Also with nodes so small that they are split by deeper node pairs."""
    fps = clusters(random.Random(5), 64, 12, 25, 4)
    want = components_of(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert labels_of(spark, fps, 8, simhash.exact_search(3), group_rows) == [fps[r] for r in want]


def test_simhash_wide_links(spark):
    """A search by recall links nothing beyond its budget, and pairs at the similarity nearly always."""
    search = simhash.similar_search(1000)
    rng = random.Random(6)
    p = np.arccos(1.6 / 1.8) / np.pi
    fps, pairs = [], 400
    for _ in range(pairs):
        a = rng.getrandbits(256)
        b = a
        for i in range(256):
            b ^= int(rng.random() < p) << i
        fps += [a, b]
    got = labels_of(spark, fps, 32, search, 10_000)
    linked = [got[2 * k] == got[2 * k + 1] for k in range(pairs)]
    within = [(fps[2 * k] ^ fps[2 * k + 1]).bit_count() <= search.budget for k in range(pairs)]
    assert all(w or not x for w, x in zip(within, linked)) and sum(linked) >= 0.92 * pairs
    assert len(set(got)) == 2 * pairs - sum(linked)
    # a crowd in one node is split, and stays one component
    centre = rng.getrandbits(256)
    crowd = sorted({centre ^ sum(1 << i for i in rng.sample(range(256), 6)) for _ in range(300)})
    assert len(set(labels_of(spark, crowd, 32, search, 40))) <= 3


def test_simhash_large_nodes_are_found_by_broadcast(spark):
    """The turned fingerprints, which are many times the input's, aren't shuffled to tell large nodes from others."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        centre = random.Random(7).getrandbits(256)
        df = spark.createDataFrame([((centre ^ 1 << i).to_bytes(32, "big"),) for i in range(100)], "fp binary")
        plan = simhash.links(df, simhash.similar_search(100), 40)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_simhash_documents(docs, none):
    got = {(r["doc_id"], bytes(r["fp"])): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert {c for (k, _), c in got.items() if k in (2, 3, 4)} == {2} and {c for (k, _), c in got.items() if k == 1} == {1}
    assert 1 in {c for (k, _), c in got.items() if k == 5} and simhash.near_duplicates(none).count() == 0
    nulls = docs.withColumn("doc_id", F.when(F.col("doc_id") > 4, F.col("doc_id")))
    assert {r["component_id"] for r in simhash.near_duplicates(nulls).collect()} == {None, 5, 6, 7}


def test_keep_first(spark, none):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(500)}" for _ in range(300)] for _ in range(30)]
    rows = []
    for k, w in enumerate(base):
        rows.append((k, " ".join(w), {"a": "1"}))
        near = list(w)
        for at in (60, 200):
            near[at] = "other"
        rows.append((100 + k, " ".join(near), None))
    rows += [(0, rows[0][1], {"a": "2"}), (None, rows[2][1], None), (None, "alone in the world without any id", None), (None, "alone in the world without any id", None), (None, None, None), (5, "this row has an id that another text has too", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, more map<string,string>").repartition(3)
    got = simhash.keep_first(df).collect()
    ids = [r["doc_id"] for r in got]
    assert sorted(i for i in ids if i is not None) == sorted([*range(30), 5]) and ids.count(None) == 2
    assert {r["text"] for r in got if r["doc_id"] is None} == {None, "alone in the world without any id"}
    assert simhash.keep_first(none).count() == 0 and got[0].asDict().keys() == {"doc_id", "text", "more"}


def test_keep_first_at_the_similarity(spark):
    """No pair at the similarity is left out, though short texts' fingerprints often differ beyond the budget."""
    rng = random.Random(3)
    rows = []
    for k in range(200):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 20, 28, 60]))]
        more = [f"x{rng.randrange(10**6)}" for _ in range((len(w) - 4) // 4)]  # n shared shingles of n + n / 4 in all
        rows += [(k, " ".join(w)), (1000 + k, " ".join(w + more))]
    # one set of shingles in other numbers
    rows += [(300, "a b c d e f g h " * 2), (1300, "a b c d e f g h " * 2 + "a b c d e " * 40)]
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in rows]
    want = components_of(len(rows), lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(r["doc_id"] for r in simhash.keep_first(df).collect())
    assert got == sorted(rows[r][0] for r in set(want)) and len(got) <= 202


@pytest.mark.parametrize("often", [0, 3])
def test_prefix_meetings(monkeypatch, often):
    """Whatever the order, sets at the similarity meet once, and none of one component."""
    monkeypatch.setattr(prefixes, "TRY_PAIRS", 50)
    rng = random.Random(4)
    sets = []
    for _ in range(60):
        s = [rng.getrandbits(64) for _ in range(rng.choice([1, 4, 5, 16, 40]))]
        sets.append(s)
        for _ in range(3):
            sets.append(s[: len(s) - rng.randrange(len(s) // 4 + 1)] + [rng.getrandbits(64) for _ in range(rng.randrange(len(s) // 5 + 1))])
    sets = [np.unique(np.array(s, np.uint64)) for s in sets]
    every = np.unique(np.concatenate(sets))
    order = (every[:: often or len(every)], np.array([rng.randrange(9) + 1 for _ in every[:: often or len(every)]]))
    sigs = [prefixes.signature(s) for s in sets]
    comps = [rng.randrange(100) for _ in sets]
    rows = [(h >> np.uint64(32), g, c, len(s), k) for s, g, c in zip(sets, sigs, comps) for k, h in enumerate(prefixes.prefix(s, order, 0.8))]
    got = prefixes._meetings(*(np.array(x) for x in zip(*rows)), 0.8).tolist()
    met = {tuple(x) for x in got}
    assert len(met) == len(got)
    alike = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if sigs[i] != sigs[j] and comps[i] != comps[j] and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                alike += 1
                assert (min(sigs[i], sigs[j]), max(sigs[i], sigs[j])) in met
    assert alike > 50 and len(met) < 4 * alike


def test_prefix_parities():
    """They rule out no pair at the similarity, also of unequal sizes, and most pairs well below it; a smaller code than the set."""
    rng = np.random.default_rng(5)
    near = lambda f, x, y, code: f(code(x), code(y), len(x), len(y), 0.8)
    out = 0
    for n in (4, 16, 32, 64, 400, 1000) * 10:
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        at = np.unique(np.concatenate([s, rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))
        below = np.unique(np.concatenate([s, rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)]))
        assert near(prefixes._are_near, s, at, np.ndarray.tobytes) and near(prefixes._may_be_near, s, at, prefixes.parities)
        assert not near(prefixes._are_near, s, below, np.ndarray.tobytes) and near(prefixes._may_be_near, below, at, prefixes.parities) >= near(prefixes._are_near, below, at, np.ndarray.tobytes)
        out += not near(prefixes._may_be_near, s, below, prefixes.parities)
        assert n < 100 or 4 * len(prefixes.parities(s)) < s.nbytes
    assert out > 50


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.vstack([base, base[:20] + rng.normal(size=(20, 16)) * 0.15, base[:5] * 3, np.repeat(base[:1], 30, 0)])
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None]), (1004, []), (1005, [float("inf")] * 16), (1006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(k, v, "x") for k, v in odd], "vec_id bigint, embedding array<double>, n_links string")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / (n[:, None] * n) >= 0.9
    np.fill_diagonal(near, False)
    want = components_of(len(x), lambda i, j: near[i, j])
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == want
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] and got[k]["component_id"] == k for k, _ in odd)
    assert embeddings.near_duplicates(df.filter("vec_id < 0")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_recall_at_the_threshold(spark, monkeypatch, kind):
    """Pairs of cosine 0.90 to 0.92 among many vectors: all found, none below, with tables of several bits."""
    monkeypatch.setattr(embeddings, "BUCKET", 16)
    rng = np.random.default_rng(9)
    a = rng.normal(size=(700, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d = rng.normal(size=a.shape)
    d -= (d * a).sum(1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    c = np.where(np.arange(len(a)) % 2, rng.uniform(0.9, 0.92, len(a)), rng.uniform(0.88, 0.8999, len(a)))[:, None]
    x = np.vstack([a, a * c + d * np.sqrt(1 - c * c)])
    if kind == "float":
        x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"vec_id bigint, embedding array<{kind}>")
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / (n[:, None] * n) >= 0.9
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.998 * near.sum() and near.sum() >= 700


def test_embedding_plan():
    """Tables and bits for far more rows than here; what a pair at the threshold may differ in is rarely exceeded."""
    for n in (10, 10**5, 10**8, 10**10):
        bits, tables, most = embeddings.plan(n, 0.9)
        assert bits <= 31 and 60 < most < 100 and embeddings.choices(bits, tables).shape == (tables, bits)
        assert all(len(set(t)) == bits for t in embeddings.choices(bits, tables).tolist())


def test_embedding_odd_rows(spark):
    """Repeated ids with other vectors, ids that are null, vectors of several lengths."""
    one, two = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0, 0.5]
    rows = [(1, one), (1, two), (2, one), (3, two), (4, [x * 2 for x in two]), (None, one), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (2, 2, 1), (None, 2, 1), (1, 2, 1), (3, 2, 1), (4, 2, 1), (None, 1, None), (None, 1, None)], key=str)


def test_embedding_chunks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    x = np.vstack([np.random.default_rng(4).normal(size=(30, 8)), np.ones((60, 8)) + np.random.default_rng(5).normal(size=(60, 8)) * 0.05])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / (n[:, None] * n) >= 0.9
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(x))] == (near.sum(1) - 1).tolist()


def test_quality_counts(docs, none):
    rows = quality.quality(docs.withColumn("lang", F.lit("en"))).collect()
    assert len(rows) == len(TEXTS)
    want = []
    for k, t in TEXTS:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen: dict = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
        want.append((k, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert sorted(tuple(r)[:7] for r in rows) == sorted(want)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality.quality(none.withColumn("lang", F.lit("en"))).count() == 0
    assert quality.quality(docs.withColumn("lang", F.lit(None).cast("string"))).count() == len(TEXTS)


def test_quality_common_words(spark):
    """Long texts in another language than their label, and without common words, are far; texts of their language aren't."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").select("doc_id")
    good = d.join(labels, "doc_id").filter(F.size(F.split("text", " ")) >= 150)
    wrong = good.filter("lang <> 'en'").select((F.col("doc_id") + 100_000).alias("doc_id"), "text", F.lit("en").alias("lang"))
    rng = random.Random(7)
    strange = ["".join(rng.choice("bcdfghklmnprstvw") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    bare = ". ".join(" ".join(strange[i : i + 8]).capitalize() for i in range(0, 400, 8))
    piped = " ".join(w + (" |" if i % 12 == 0 else "") for i, w in enumerate(strange)).capitalize()
    odd = spark.createDataFrame([(200_000, bare, "en"), (200_001, piped, "en"), (200_002, bare, None)], d.schema)
    words = {r["lang"]: r["__list"] for r in quality.common_words(d, "text", "lang").collect()}
    assert set(words) == {"en", "de", "fr", "es", None} and all(re.search(r"[^\W\d_]", w) for x in words.values() for w in x)
    got = {r["doc_id"]: r for r in quality.quality(d.union(wrong).union(odd)).collect()}
    kept = [got[r["doc_id"]]["kept"] for r in good.collect()]
    far = [not r["kept"] for k, r in got.items() if 100_000 <= k < 200_000 and not r["base_failed"]]
    assert len(kept) > 50 and sum(kept) >= 0.98 * len(kept)
    assert len(far) > 30 and sum(far) >= 0.95 * len(far)
    assert all(not got[k]["base_failed"] and not got[k]["kept"] and got[k]["char_distance"] < quality.MAX_CHAR_DISTANCE for k in (200_000, 200_001, 200_002))
    assert {r["doc_id"] for r in quality.keep_good(d.union(wrong).union(odd)).collect()} == {k for k, r in got.items() if r["kept"]}


def js_distance(p, q):
    half = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * np.log2(a / m) for a, m in zip(x, half) if a > 0)
    return np.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def test_quality_equals_brute_force(spark):
    """Distances and verdicts, computed anew from the rule's text: also unlabelled documents and more languages."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = [(900, "supercalifragilistic wordswithmanyletters " * 60, "xx"), (901, "eins zwei drei " * 40, None), (902, "", "yy"), (903, None, None)]
    d = d.withColumn("lang", F.when(F.col("doc_id") % 10 != 3, F.col("lang"))).union(spark.createDataFrame(more, d.schema))
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in d.collect()]
    sets = [set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("0123456789"), set(".,;:!?'\"()-"), set("#*$%&|<>"), set(" \t\n\r\x0b\x0c")]

    def classes(t):
        n = [sum(c in x for c in t) for x in sets]
        wide = sum(ord(c) > 127 for c in t)
        return [*n, wide, len(t) - sum(n) - wide]

    by: dict = {}
    for _, t, lang in rows:
        if lang is not None:
            by.setdefault(lang, []).append(t)
    refs = {}
    for lang, texts in by.items():
        words = [w.lower() for t in texts for w in WORD.findall(t)]
        if words:
            counts: dict = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            top = sorted((w for w in counts if re.search(r"[^\W\d_]", w)), key=lambda w: (-counts[w], w))[: quality.COMMON]
            total = np.sum([classes(t) for t in texts], 0)
            refs[lang] = (top, [counts[w] / len(words) for w in top], total / total.sum())
    got = {r["doc_id"]: r for r in quality.quality(d).collect()}
    assert len(got) == len(rows) and "xx" in refs
    for k, t, lang in rows:
        words = [w.lower() for w in WORD.findall(t)]
        best = None
        for top, q, shape in (refs.values() if lang is None else [refs[lang]] if lang in refs else []):
            if not words:
                break
            p = [words.count(w) / len(words) for w in top]
            c = js_distance(np.array(classes(t)) / len(t), shape)
            w = js_distance([*p, 1 - sum(p)], [*q, 1 - sum(q)])
            limit = quality.WORD_SHARE * js_distance([*[0] * len(q), 1], [*q, 1 - sum(q)])
            if best is None or c + w < best[0] + best[1] - 1e-12:
                best = (c, w, limit, sum(q))
        r = got[k]
        if best is None:
            assert r["char_distance"] is None and not r["kept"]
            continue
        assert abs(r["char_distance"] - best[0]) < 2e-6 and abs(r["word_distance"] - best[1]) < 2e-6, k
        far = len(t) >= 200 and best[0] > quality.MAX_CHAR_DISTANCE or len(words) >= 50 and len(words) * best[3] >= 5 and best[1] > best[2]
        assert r["kept"] == (not r["base_failed"] and not far)


def test_language_held_out_accuracy(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.learn(d.filter(~language.held_out()))
    got = language.predict(d.filter(language.held_out()), net, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    odd = {(r["doc_id"]): r for r in language.predict(docs.filter("doc_id <> 5"), net, id_col="doc_id").collect()}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["score"] == 0 for k in (2, 3, 4, 7)) and 0 <= odd[6]["score"] <= 1
    assert language.learn(d.filter("doc_id < 0")) is None and language.predict(none, net).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}


def test_language_network_by_hand():
    """The rearranged convolution equals one written out place by place."""
    rng = np.random.default_rng(3)
    net = language.Network(["a", "b", "c"])
    net.shift[:] = rng.normal(size=net.shift.shape)
    net.bias[:] = rng.normal(size=3)
    x = rng.integers(1, 256, (5, language.WINDOW)).astype(np.uint8)
    x[1, 40:] = 0
    x[2, 250:] = 0
    got = net.probabilities(x)
    for row, p in zip(x, got):
        e = np.concatenate([net.embed[row], np.zeros((language.SPAN, language.EMBED), np.float32)])
        feats = []
        for k, w in enumerate(language.WIDTHS):
            for f in range(k * language.FILTERS, (k + 1) * language.FILTERS):
                kernel = net.filters[:, f].reshape(language.SPAN, language.EMBED)[:w]
                best = max(float((e[i : i + w] * kernel).sum()) for i in range(language.WINDOW))
                feats.append(max(0.0, best + float(net.shift[f])))
        z = np.array(feats) @ net.dense + net.bias
        z = np.exp(z - z.max())
        assert np.allclose(p, z / z.sum(), atol=1e-4)


def test_language_many_languages(spark, monkeypatch):
    """More languages than the sample's bound has room for are all learned; a row without an id is predicted."""
    monkeypatch.setattr(language, "TRAIN_TOTAL", 600)
    rows = [(k, f"{chr(97 + k % 300 // 26)}{chr(97 + k % 26)}" * 40, f"l{k % 300}") for k in range(1200)]
    d = spark.createDataFrame([*rows, (None, "aa" * 40, None)], "doc_id bigint, text string, lang string")
    net = language.learn(d)
    assert len(net.languages) >= 250
    got = language.predict(d, net).select("doc_id", language.held_out().alias("h"), "lang_pred").filter("doc_id IS NULL").collect()
    assert [(r["h"], r["lang_pred"] in net.languages) for r in got] == [(False, True)]


def test_html_cases(spark):
    page = "<html><head><title>x</title></head><body><header>Site name</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>T</h1><p>A &lt;b&gt; x&nbsp; y<br>z</p><script>var t='</p>'</script><form>Your name</form><section class=comments><p>I liked this article very much, thank you all.</p></section></article><aside>More</aside><footer>&copy; 2024 Site</footer>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p", "x"), (1, "u", page, "x"), (5, "u", "<article><p>" + "word " * 50_000, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted([(1, "T\nA <b> x y z")] * 2 + [(2, ""), (3, ""), (4, ""), (5, ("word " * 50_000).strip())])
    assert html.extract(df.filter("page_id < 0")).count() == 0
    table = np.array(html.LABELLED, float)
    assert (html.train().predict(table[:, :-1]) == table[:, -1].astype(bool)).mean() >= 0.95


class Article(HTMLParser):
    """The synthetic pages' article, read by the standard parser: its paragraphs and headings are the blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.hidden = 0, [[]], 0

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "br":
            self.blocks[-1].append(" ")
        if tag not in ("b", "i", "em", "strong", "a", "span", "br", "code"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside -= 1
        if tag in ("script", "style"):
            self.hidden -= 1
        if tag not in ("b", "i", "em", "strong", "a", "span", "br", "code"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.blocks[-1].append(data)


def test_html_equals_a_parser_on_all_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in html.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert got.keys() == pages.keys() and len(pages) >= 200
    for k, page in pages.items():
        p = Article()
        p.feed(page or "")
        p.close()
        want = [" ".join("".join(b).split()) for b in p.blocks]
        assert got[k] == "\n".join(b for b in want if b), k


def test_html_long_attributes():
    tree = html.train()
    text = lambda page: html.main_text(page, tree)
    for q, other in (('"', "'"), ("'", '"')):
        value = "x " * 5_000 + f"{other}>secret <b>{other} " + "y " * 5_000
        assert text(f"<article><p>one</p><p data-x={q}{value}{q}>two</p><img alt = {q}{value}{q}><p>three</p></article>") == "one\ntwo\nthree"
    assert text("<article><p>one</p><p don't>it's</p><p title=a\"b>two</p><p title=\"never closed>three</p></article>") == "one\nit's\ntwo\nthree"
    assert text("<article><p>one</p><p data-x='cut off > here") == "one\nhere"
    began = time.monotonic()
    for junk in ('<a x=">" ', "<a x='", '<a x="', "<a ", "<", '"', "<a b= "):
        text("<article><p>one</p>" + junk * 50_000)
    assert time.monotonic() - began < 20


def test_html_names_are_whole():
    tree = html.train()
    for tag in ("video-player", "button-group", "title-bar", "map-view", "svg:x", "canvas.x"):
        assert html.main_text(f"<article><p>one</p><{tag} a=b></{tag}><p>two</p></article>", tree) == "one\ntwo", tag
    for tag in ("video", "button", "title", "map", "SCRIPT"):
        assert html.main_text(f"<article><p>one</p><{tag}\na=b>no</{tag}><p>two</p></article>", tree) == "one\ntwo", tag
    plain = ('href="/hidden-lakes/"', 'title="a hidden lake"', 'data-title="Hidden gems"', 'data-id="comments"', 'href="/v?id=comments"', "href=/v?id=comments", "title='x class=sidebar'", "data-hidden", "hidden-x=1", 'aria-hidden="false"', 'data-role = "navigation"', 'data-style="display:none"')
    for attrs in plain:
        assert html._says("p", " " + attrs, True) == (False, False), attrs
        assert html.main_text(f"<article><p>one</p><section {attrs}><p>two</p></section></article>", tree) == "one\ntwo", attrs
    for attrs in ("hidden", 'HIDDEN=""', "id=comments", "title='x' class = 'a sidebar'", 'aria-hidden="true"', "role=navigation", 'style="color:red; display: none"', "data-a=b/hidden hidden/"):
        assert html._says("p", " " + attrs, True)[0], attrs


def test_ngram_cases(docs, none):
    got = [r for r in ngrams.ngram_scores(docs).collect()]
    assert len(got) == len(TEXTS)
    assert all(r["score"] is None and r["n_words"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    twin = [r["score"] for r in got if r["doc_id"] == 1][0]
    assert twin > [r["score"] for r in got if r["doc_id"] == 7][0]
    assert ngrams.ngram_scores(none).count() == 0
    assert all(r["score"] is None or r["score"] <= 0 for r in ngrams.ngram_scores(docs, order=3).collect())


URL_ENTRIES = [("domain", "example.com", "c1", "add", "2024-01-01"), ("domain", "example.com", "c1", "add", "2024-01-02"), ("domain", "Example.com", "c1", "remove", "2024-01-10"), ("host", "a.example.com", "c2", "add", "2024-01-10"), ("prefix", "A.example.com/x", "c3", "add", "2024-01-05"), ("prefix", "s.org/Secret/", "c6", "add", "2024-01-05"), ("host", None, "c4", "add", "2024-01-01"), ("prefix", None, "c4", "add", "2024-01-01"), ("host", "b.example.com", "c5", "odd", "2024-01-01")]


@pytest.mark.parametrize("few", [1000, 0])
def test_url_filter_cases(spark, few):
    """Also with the list too long to be broadcast."""
    rows = [(1, "http://a.example.com/x/y", "2024-01-05"), (2, "HTTP://A.Example.com/x?q", "2024-01-10"), (3, "http://b.example.com/", "2024-01-05"), (4, None, "2024-01-05"), (5, "nonsense", "2024-01-05"), (6, "http://a.example.com/x/y", None), (1, "http://a.example.com/x/y", "2024-01-05"), (7, "http://a.example.com/X/y", "2024-01-05"), (8, "http://a.example.com/xy", "2024-01-05"), (9, "http://s.org/Secret//a", "2024-01-05"), (10, "http://s.org/secret//a", "2024-01-05")]
    cap = spark.createDataFrame(rows, "id int, url string, d string").withColumn("t", F.to_timestamp("d")).withColumns({"kind": F.lit("x"), "key": F.lit("x"), "host": F.lit("x"), "n_active": F.lit(7)})
    e = spark.createDataFrame(URL_ENTRIES, "kind string, key string, category string, action string, d string").withColumn("at", F.to_timestamp("d"))
    got = sorted((r["id"], r["n_active"], r["reason"]) for r in urlfilter.judge(cap, e, "id", "url", "t", few).collect())
    assert got == [(1, 2, "c1,c3"), (1, 2, "c1,c3"), (2, 2, "c2,c3"), (3, 1, "c1"), (4, 0, None), (5, 0, None), (6, 0, None), (7, 1, "c1"), (8, 1, "c1"), (9, 1, "c6"), (10, 0, None)]
    assert not any(r["blocked"] for r in urlfilter.judge(cap, e.filter("kind = 'x'"), "id", "url", "t", few).collect())
    assert urlfilter.judge(cap.filter("id < 0"), e, "id", "url", "t", few).count() == 0


def test_url_filter_long_urls(spark):
    rows = [(1, "http://a.example.com/x" + "/y" * 500_000), (2, "http://a.example.com/x/" + "z" * 1_000_000), (3, "http://" + "a." * 200 + "example.com/x")]
    cap = spark.createDataFrame(rows, "id int, url string").withColumn("t", F.to_timestamp(F.lit("2024-01-06")))
    e = spark.createDataFrame(URL_ENTRIES, "kind string, key string, category string, action string, d string").withColumn("at", F.to_timestamp("d"))
    began = time.monotonic()
    assert sorted((r["id"], r["reason"]) for r in urlfilter.judge(cap, e, "id", "url", "t").collect()) == [(1, "c1,c3"), (2, "c1,c3"), (3, "c1")]
    assert time.monotonic() - began < 30


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    from tests.compare import connect, same

    d = "/root/testdata/sf0.001"
    same(queries.QUERIES[name](spark, d), connect(d), queries.ORACLE_SQL[name])


def test_packing_checksums(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    full = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in packing.pack_documents(d).collect()}
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in packing.query(d).collect()} == full
