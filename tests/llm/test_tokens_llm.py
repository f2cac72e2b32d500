"""Packing, token files and BPE: against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from helpers import ODD_TEXTS, documents, empty

from ledgerlens.llm import bpe_automaton, packing, tokenfile
from ledgerlens.llm.tokens import encoder, slices, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def library(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    parts = list("ab. ,!\n\t é日ß'12 \r\x0b  \xa0\x1c!!") + ["<|endoftext|>", " foo", " the", "don't", "ing"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_chunk_encoder_equals_library():
    texts = [t or "" for t in ODD_TEXTS] + random_texts(3000) + ["héllo wörld  foo. " * 30000]
    assert len(list(slices(texts[-1]))) > 1
    assert [x.tolist() for x in encoder(BYTE).encode(texts)] == library(BYTE, texts)


def test_words_of_letters_take_no_pre_tokenizer(monkeypatch):
    """All Latin letters, alone and in words; the general path sees none of them."""
    from ledgerlens.llm.tokens import ChunkEncoder

    letters = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "\xaa\xb5\xba")
    rnd = random.Random(3)
    words = [*letters, *("".join(rnd.choices(letters, k=rnd.randrange(1, 12))) for _ in range(2000)), "the", "The", "x" * 500]
    slow = []
    learn = ChunkEncoder._learn_words
    monkeypatch.setattr(ChunkEncoder, "_learn_words", lambda self, keys: (slow.extend(keys), learn(self, keys)))
    texts = [" ".join(["12", *words]), " ".join(["12", *reversed(words), "a1 don't"])]
    assert [x.tolist() for x in encoder(BYTE).encode(texts)] == library(BYTE, texts)
    assert not [k for k in slow if k.isalpha()]


def test_words_are_cached_without_their_punctuation():
    """a word is kept once, whatever stands behind it; what a group of
    texts puts together from words and punctuation is not kept."""
    enc, tails = encoder(BYTE), [".", ",", "!!", "?", ")", "...", ":", ";", "\"", "###"]
    words = ["alpha", "béta", "Gamma", "ß", "don"]
    texts = [" ".join(["x", *(w + t for w in words for t in tails[k:] + tails[:k]), "é. y", "z"]) for k in range(len(tails))]
    assert [x.tolist() for x in enc.encode(texts)] == library(BYTE, texts)
    size = len(enc.number), enc.bytes, enc.ids.n, enc.start.n, enc.count.n
    assert len(enc.number) <= len(words) + len(tails) + 5
    texts = [" ".join(["x", *(w + s + t for w in words for s in tails for t in tails[:k] if s + t in tails)]) for k in range(3)]
    assert [x.tolist() for x in enc.encode(texts)] == library(BYTE, texts)
    assert (len(enc.number), enc.bytes, enc.ids.n, enc.start.n, enc.count.n) == size


@pytest.mark.parametrize("seed", range(20))
def test_best_fill_against_all_subsets(seed):
    rnd = random.Random(seed)
    counts = {rnd.randrange(1, 20): rnd.randrange(1, 4) for _ in range(4)}
    target = rnd.randrange(1, 60)
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    used = packing.best_fill(counts, target)
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= target)
    assert all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_piece_once():
    rnd = random.Random(4)
    histogram = {rnd.randrange(1, 2049): rnd.randrange(1, 500) for _ in range(300)}
    used = {}
    for pattern, times in packing.plan_windows(histogram):
        assert sum(k * n for k, n in pattern.items()) <= 2048
        for k, n in pattern.items():
            used[k] = used.get(k, 0) + n * times
    assert used == histogram


def test_pack_is_gapless_and_whole(spark):
    texts = ODD_TEXTS + ["lorem ipsum dolor " * 4000] + ["same text here"] * 200
    ids = [[*i, 1] for i in library(BYTE, texts)]
    rows = packing.pack(documents(spark, texts).repartition(3), BYTE).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        piece = np.frombuffer(r["ids"], "<u4").tolist()
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(piece) == r["length"]
        got.setdefault(r["doc_id"], []).extend(piece)
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    assert got == dict(enumerate(ids))
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(fill) == list(range(len(fill))) and max(fill.values()) <= 2048
    assert all(r["sequence_length"] == fill[r["sequence_id"]] for r in rows)
    assert all(r["padded_length"] in (2048, r["sequence_length"]) for r in rows)
    assert sum(fill.values()) > 0.9 * 2048 * (len(fill) - 1)


def test_sequences_join_the_pieces(spark):
    packed = packing.pack(documents(spark, ["alpha beta", "gamma", None]), BYTE, capacity=8)
    rows = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["sequence_length"] for r in rows)
    assert packing.pack(empty(spark), BYTE).collect() == []


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 32])
@pytest.mark.parametrize("n", [1, 1023, 1024, 5000])
def test_blocks_round_trip(high, n):
    rnd = np.random.default_rng(n)
    ids = rnd.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[rnd.integers(0, n, n // 20)] = 7 % high
    assert tokenfile.decode_blocks(tokenfile.encode_blocks(ids))[:n].tolist() == ids.tolist()


def test_segment_reads_only_a_range():
    docs = [(None, np.arange(3000, dtype=np.uint32)), (5, np.zeros(0, np.uint32)), (9, np.full(2000, 9, np.uint32))]
    seg = tokenfile.Segment(tokenfile.encode_segment(docs))
    whole = np.concatenate([d[1] for d in docs])
    assert seg.doc_ids == [None, 5, 9] and seg.lengths.tolist() == [3000, 0, 2000]
    assert seg.read(1000, 3100).tolist() == whole[1000:3100].tolist()
    assert seg.read(4999, 9999).tolist() == whole[4999:].tolist() and seg.read(7, 7).tolist() == []


def test_token_file_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 500)
    texts = ODD_TEXTS + ODD_TEXTS
    ids = [3 * (i % len(ODD_TEXTS)) for i in range(len(texts))]  # every id twice
    rows = tokenfile.read_documents(tokenfile.write_tokens(documents(spark, texts, ids).repartition(4), BYTE),
                                    with_ids=True).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(ids)
    at, expect = 0, dict(zip(ids, library(BYTE, texts)))
    for r in rows:
        assert r["start"] == at and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*expect[r["doc_id"]], 2]
        at += r["n_tokens"]
    assert tokenfile.read_documents(tokenfile.write_tokens(empty(spark), BYTE)).collect() == []


def test_automaton_accepts_what_merging_gives():
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "aa"), ("ba", "b"), ("b", "b")]
    vocab = {t: i for i, t in enumerate(["a", "b", *(u + v for u, v in merges)])}
    auto = bpe_automaton.Automaton(vocab, merges)
    rank = {m: i for i, m in enumerate(merges)}
    rnd = random.Random(2)
    for _ in range(2000):
        word = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 14)))
        parts = list(word)
        while True:
            best = min(zip(parts, parts[1:]), key=lambda p: rank.get(p, 99), default=None)
            if best not in rank:
                break
            k, out = 0, []
            while k < len(parts):
                if tuple(parts[k:k + 2]) == best:
                    out.append("".join(best))
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        assert auto.encode(word) == parts


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    texts = ODD_TEXTS + random_texts(400, 3) + ["a" * n for n in range(30)] + ["ha" * n for n in range(20)]
    rows = bpe_automaton.encode_decode(documents(spark, texts), WORD).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    assert bpe_automaton.encode_decode(empty(spark), WORD).collect() == []
