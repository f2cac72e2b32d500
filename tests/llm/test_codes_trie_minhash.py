"""Vector codes, prefix trie, MinHash links: against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD_TEXTS, SMALL, WORD, documents, empty

from ledgerlens.llm import minhash, prefix_trie, vector_codes
from ledgerlens.llm.ordered import numbered

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label) by direct distances on Python integers."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], [], {}
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size:(p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                held[p, nearest(v, p)[1]].append(cut(v, p))
        for (p, k), own in held.items():
            books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, v, lab in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), lab))
    labels = defaultdict(int)
    for _, _, e, lab in out:
        labels[lab] += e
    return out, books, labels


def check_codes(spark, rows, **kw):
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS), **kw).collect()
    plain, books, labels = plain_codes(rows, **kw)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, c, e, labels[lab], sha) for i, c, e, lab in plain), key=key)


def test_vector_codes_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "STEP", 7)
    rnd = random.Random(3)
    vec = lambda: [float(np.float32(rnd.uniform(-1, 1))) for _ in range(8)]
    rows = [(i, vec(), rnd.choice([0, 1, 2, None])) for i in range(60)]
    same = vec()
    rows += [(200 - i, same, 1) for i in range(40)] + [(5, vec(), 1), (5, rows[5][1], 1), (None, vec(), 2)]
    rows += [(300, None, 1), (301, [float("nan")] * 8, 1), (302, [float("inf")] + [0.0] * 7, 1), (303, [None] + [0.0] * 7, 1),
             (304, [0.0] * 8, None), (305, [3000.5, -3000.25, 0.0, 0.0, 1e5, -1e5, 0.0, 0.0], 4)]
    check_codes(spark, rows, entries=12, rounds=3)
    check_codes(spark, rows, entries=256, rounds=2)


def test_vector_codes_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").limit(300).collect()]
    check_codes(spark, rows, entries=32, rounds=2)


def test_vector_codes_odd_tables(spark):
    assert vector_codes.compress(empty(spark, VECTORS)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 2)], VECTORS)).collect() == []
    rows = [(1, [0.5] * 4, 1), (2, [0.25] * 4, 1), (3, [1.0] * 5, 1), (4, [3e38] * 4, None)]
    got = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()}
    assert [got[i]["code"] for i in (1, 2, 3, 4)] == ["00000000", "01010101", None, None]
    assert got[3]["error"] is None and got[1]["label_error"] == 0
    empties = spark.createDataFrame([(1, [], 1), (2, [], None)], VECTORS)
    assert {(r["code"], r["error"]) for r in vector_codes.compress(empties).collect()} == {("00000000", 0)}


def plain_trie(rows, shared=100, heads=6):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t, role or "", text or ""))
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    own = {c: [x[1:] for x in sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(*x[1:])))] for c, t in own.items()}
    conv = {c: own.get(c - int(math.fmod(c, shared)), [])[:zlib.crc32(str(c).encode()) % heads] + t[zlib.crc32(str(c).encode()) % heads:]
            for c, t in own.items()}
    members = defaultdict(list)
    for c in sorted(conv):
        for d in range(len(conv[c]) + 1):
            members[tuple(conv[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        sums[p] = (sum(sums[k][0] for k in children[p]) or 1, own_saved + sum(sums[k][1] for k in children[p]))
        ends = ",".join(str(c) for c in members[p] if len(conv[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), *sums[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def check_trie(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, depth int")
    got = prefix_trie.trie(df, **kw)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == plain_trie([r[:4] for r in rows])


def conversations(rnd, n, longest=9):
    words = ["ja", "né", "😀 ok", "", None]
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(1, longest)):
            rows.append((c * 3, t if rnd.random() > 0.1 else None, ["user", "assistant", None][t % 3], rnd.choice(words), "k", 1))
    return rows


@pytest.mark.parametrize("shard,band", [(2048, 256), (3, 256), (5, 2), (2048, 3)])
def test_trie_brute_force(spark, shard, band):
    rnd = random.Random(4)
    rows = conversations(rnd, 60) + [(3 * c, t, "user", "ja", "k", 1) for c in range(200, 240) for t in range(7)]
    rows += [(None, 1, "user", "lost", "k", 1), (7, 0, "user", "ja", "k", 1), (7, 0, "user", "ja", "k", 1), (-40, 1, "user", "ja", "k", 1)]
    check_trie(spark, rows, shard=shard, band=band)


def test_trie_long_conversations(spark):
    """A hot conversation over many ranges and bands, and a copy of its start."""
    long = [f"t{i % 7} {i}" for i in range(400)]
    rows = [(100, i, "user", t, "k", 1) for i, t in enumerate(long)] + [(101, i, "user", t, "k", 1) for i, t in enumerate(long[:390])]
    rows += [(200 + c, i, "user", t, "k", 1) for c in range(3) for i, t in enumerate(long[:20 * c + 1])]
    check_trie(spark, rows, shard=2, band=16)


def test_trie_table_and_empty(spark):
    rows = [(*r, "k", 1) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_trie(spark, rows)
    assert prefix_trie.trie(empty(spark, "conv_id long, turn long, role string, text string")).collect() == []


def test_numbered(spark):
    rnd = random.Random(8)
    rows = [(5, rnd.randrange(10 ** 6)) for _ in range(3000)] + [(k, k * j % 13) for k in range(20) for j in range(k)]
    got = defaultdict(list)
    for r in numbered(spark.createDataFrame(rows, "k long, o long"), "k", ["o"], "test").collect():
        got[r["k"]].append((r["_at"], r["o"]))
    for k in got:
        assert [o for _, o in sorted(got[k])] == sorted(o for a, o in rows if a == k)
        assert sorted(at for at, _ in got[k]) == list(range(len(got[k])))


def plain_sets(texts, shingle=3):
    out = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set()))
    return out


def check_minhash(spark, texts, ids=None, **kw):
    ids = list(range(len(texts))) if ids is None else ids
    sets = plain_sets(texts)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            s = len(a & b)
            if s and 100 * s >= 85 * (len(a) + len(b) - s):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = [(d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(zip(ids, sets))]
    want = [(*w, w[0] == w[2]) for w in want]
    got = minhash.near_duplicates(documents(spark, texts, ids), **kw)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    key = lambda r: [(x is None, x) for x in r]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    return want


def near_texts(rnd, n, groups, words=80):
    """Groups of texts some words apart, so that links form chains."""
    out = []
    for _ in range(groups):
        text = [f"w{rnd.randrange(3000)}" for _ in range(words)]
        for _ in range(n):
            text = list(text)
            for _ in range(rnd.randrange(4)):
                text[rnd.randrange(words)] = f"w{rnd.randrange(3000)}"
            out.append(" ".join(text))
    rnd.shuffle(out)
    return out


def test_minhash_brute_force(spark):
    texts = near_texts(random.Random(1), 12, 15) + ODD_TEXTS + ["One  two\tthree four", "one two THREE four"]
    want = check_minhash(spark, texts)
    assert len({c for _, _, c, _ in want}) < len(texts) - 60


@pytest.mark.parametrize("block", [4, 128])
def test_minhash_keys_of_several_components(spark, block):
    """Sets below the similarity share keys, so members meet in blocks."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(rnd.randrange(3, 9)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(10 ** 6)}"
        texts.append(" ".join(t))
    check_minhash(spark, texts, block=block)


@pytest.mark.parametrize("nearest", [1, None])
def test_minhash_rows_dealt_follow_the_members(spark, monkeypatch, nearest):
    """nearest sets are looked for in a member's own block, and the largest
    component's blocks meet the others', not each other: rows in proportion."""
    dealt, run = [], minhash.map_rows
    monkeypatch.setattr(minhash, "map_rows", lambda df, *a: dealt.append(df.count()) or run(df, *a))
    sign, fine = b"\1\0" * minhash.SYMBOLS, b"\1" * minhash.FINE
    # the smallest id is a component of its own; 400 of 405 are one
    rows = [(7, 0, i, 5 if i > 4 else i, 100, 0, sign, fine) for i in range(405)]
    members = spark.createDataFrame(rows, "key long, slot int, id long, root long, n long, slack long, sign binary, fine binary")
    found = {tuple(r) for r in minhash._residual(members, minhash.DISTANCE, 85, 8, nearest).collect()}
    assert dealt[0] <= 2 * len(rows) + 5 * 51
    if nearest is None:
        assert found == {(i, j) for i in range(5) for j in range(i + 1, 405)}


def test_minhash_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    texts = [text, text, f"{text} end", f"{text} end", "other words here now", None, "", None, f"{text} more"]
    check_minhash(spark, texts, [9, 4, None, None, 4, 4, None, 7, 11])
    null = spark.createDataFrame([(None, text), (None, f"{text} end"), (None, "a b c d")], "doc_id long, text string")
    assert {(r["component_id"], r["kept"]) for r in minhash.near_duplicates(null).collect()} == {(None, True)}
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_minhash_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    check_minhash(spark, [r["text"] for r in rows], [r["doc_id"] for r in rows])


def test_shingles_by_slices(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = minhash.shingle_set(text)
    monkeypatch.setattr("ledgerlens.llm.words.word_slices.__defaults__", (100,))
    assert (minhash.shingle_set(text) == whole).all() and len(whole) == 97


def test_pigeonhole():
    """Signatures under the distance share a key, whatever symbols differ."""
    rnd = np.random.default_rng(5)
    for _ in range(300):
        one = rnd.integers(0, 1 << 16, (1, minhash.SYMBOLS)).astype("<u2")
        two = one.copy()
        two[0, rnd.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)] ^= 1
        assert (minhash.chunk_keys(one) == minhash.chunk_keys(two)).any()
