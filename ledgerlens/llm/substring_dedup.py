"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the smallest hash
of the ``GRAM``-word runs in it, so equal windows have equal minimisers;
consecutive windows that share one form a super-k-mer, which travels as one
packed string (its words) to the minimiser's bucket.  There the words are
numbered, and sorting ranks of doubled length tells exactly which windows are
equal: no window is judged by a hash.

Only minimisers met in two documents or more can hold a shared window, so a
narrow pass counts minimisers first, and only their super-k-mers travel.  That
count also says where to split: the super-k-mers of a hot minimiser are dealt
over several buckets by document, and the first instances these find meet once
more by the window's digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import IN_ROWS, clustered, map_rows, staged
from .quality import _word_hashes
from .words import word_slices

WINDOW = 50
GRAM = 8
BUCKET_RUNS = 20_000   # super-k-mers a bucket, about
RUN_WINDOWS = 2048     # windows a super-k-mer, at most (longer ones are cut)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def super_kmers(text: str | None, window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """``(minimiser, first window, windows)`` of a whole text, in order."""
    raw = (text or "").encode()
    h = np.concatenate([_word_hashes(w) for w in word_slices(raw)])
    if len(h) < window:
        return []
    n = len(h) - gram + 1
    code = np.zeros(n, np.uint64)
    for k in range(gram):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    least = _smallest(_mix(code), window - gram + 1)
    cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    out = []
    for first, stop in zip(cut.tolist(), [*cut[1:].tolist(), len(least)]):
        mini = int(least[first].astype(np.int64))
        out += [(mini, at, min(RUN_WINDOWS, stop - at)) for at in range(first, stop, RUN_WINDOWS)]
    return out


def _equal_windows(ids: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Numbers that are equal exactly for equal windows: ranks of runs of
    1, 2, 4, ... words, each from the sorted pairs of the one before."""
    rank, size = ids, 1
    while 2 * size <= window:
        pair = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        rank, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * size
    if size == window:
        return rank[starts]
    pair = rank[starts] * (int(rank.max()) + 1) + rank[starts + window - size]
    return np.unique(pair, return_inverse=True)[1].astype(np.int64)


def count_bucket(rows: list[tuple], window: int = WINDOW):
    """Windows of one bucket's super-k-mers ``(doc_id, key, first, parts, body)``.

    Yields ``(doc_id, key, start, stop, None)``, word ranges whose windows also
    start in a smaller document here, and, of super-k-mers dealt in ``parts``
    over 1, ``(doc_id, key, start, stop, digest)`` for windows that do not."""
    number: dict[bytes, int] = {}
    words = [r[4].encode().split(b" ") for r in rows]
    ids = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    lens = np.array([len(w) for w in words], np.int64)
    counts = lens - window + 1
    base = np.cumsum(lens) - lens
    run = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    same = _equal_windows(ids, base[run] + inside, window)
    doc = np.array([r[0] for r in rows], np.int64)[run]
    least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    later = doc > least[same]
    # neighbours of one super-k-mer make one range
    edge = np.concatenate([[True], (run[1:] != run[:-1]) | (later[1:] != later[:-1])])
    at = np.flatnonzero(edge)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(run)]):
        d, key, first, parts, _ = rows[run[a]]
        start, stop = first + int(inside[a]), first + int(inside[b - 1]) + window
        if later[a]:
            yield d, key, start, stop, None
        elif parts > 1:
            for k in range(int(inside[a]), int(inside[b - 1]) + 1):
                body = b" ".join(words[run[a]][k:k + window])
                yield d, key, first + k, first + k + window, hashlib.blake2b(body, digest_size=16).digest()


def cuts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """``doc_id, key, cuts`` for documents ``doc_id, text, key`` (key: a hash of
    the text) that lose words: ``cuts`` is a flat array of word ranges
    start, stop, start, stop."""
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")

    def kmers(batches):
        for cols in batches:
            for doc, key, text in zip(cols["doc_id"], cols["key"], cols["text"]):
                found = super_kmers(text, window, gram)
                if found:
                    mini, first, n = zip(*found)
                    yield doc, key, list(mini), list(first), list(n)

    runs = staged(map_rows(known, kmers, "doc_id long, key long, mini array<long>, first array<int>, n array<int>", IN_ROWS),
                  "super-kmers")
    shared = staged(runs.select("doc_id", F.explode("mini").alias("mini")).groupBy("mini").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("runs")
    ).where("lo < hi").select("mini", F.ceil(F.col("runs") / bucket_runs).cast("int").alias("parts"), "runs"),
        "shared-minimisers")
    total = shared.agg(F.sum("runs")).first()[0] or 0
    buckets = max(1, -(-total // bucket_runs))
    spans = runs.select("doc_id", "key", F.explode(F.arrays_zip("mini", "first", "n")).alias("r")).select(
        "doc_id", "key", "r.mini", "r.first", "r.n").join(shared.select("mini", "parts"), "mini")
    wanted = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n", "mini", "parts")).alias("runs"))

    def packed(batches):
        for cols in batches:
            for doc, key, text, need in zip(cols["doc_id"], cols["key"], cols["text"], cols["runs"]):
                for r, body in _bodies(text, need, window):
                    part = hash((doc, key)) % r["parts"]
                    yield doc, key, r["first"], r["mini"], r["parts"], part, body

    strings = map_rows(known.join(wanted, ["doc_id", "key"]).select("doc_id", "key", "text", "runs"), packed,
                       "doc_id long, key long, first int, mini long, parts int, part int, body string", IN_ROWS)
    dealt = strings.withColumn("bucket", F.pmod(F.xxhash64("mini", "part"), F.lit(buckets)))

    def counted(pdf):
        import pandas as pd

        rows = list(zip(pdf["doc_id"], pdf["key"], pdf["first"], pdf["parts"], pdf["body"]))
        return pd.DataFrame(list(count_bucket(rows, window)), columns=["doc_id", "key", "start", "stop", "digest"])

    found = staged(dealt.select("doc_id", "key", "first", "parts", "body", "bucket").groupBy("bucket").applyInPandas(
        counted, "doc_id long, key long, start int, stop int, digest binary"), "windows")
    open_ = found.where("digest IS NOT NULL")
    first = open_.groupBy("digest").agg(F.min("doc_id").alias("least"))
    late = open_.join(first, "digest").where("doc_id > least").select("doc_id", "key", "start", "stop")
    ranges = found.where("digest IS NULL").select("doc_id", "key", "start", "stop").unionByName(late)
    # every range is below one super-k-mer of its document
    return ranges.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "stop")).alias("r")).select(
        "doc_id", "key", F.flatten(F.transform(F.array_sort("r"), lambda x: F.array(x["start"], x["stop"]))).alias("cuts"))


def _bodies(text: str, need: list[dict], window: int):
    """The packed string of each wanted super-k-mer, slice by slice."""
    need = sorted(need, key=lambda r: r["first"])
    held: dict[int, list[bytes]] = {}
    offset, begin = 0, 0
    for words in word_slices(text.encode()):
        end = offset + len(words)
        for k in range(begin, len(need)):
            a, b = need[k]["first"], need[k]["first"] + need[k]["n"] + window - 1
            if a >= end:
                break
            if b <= offset:
                continue
            part = words[max(a - offset, 0):b - offset]
            whole = held.pop(k, []) + part
            if b <= end:
                yield need[k], b" ".join(whole).decode()
                begin = k + 1 if k == begin else begin
            else:
                held[k] = whole
        offset = end


def kept_words(text: str | None, ranges) -> tuple[int, int, str]:
    """Words, words removed, and the kept words joined by one space."""
    flat = [] if ranges is None else [int(x) for x in ranges]
    kept, offset, removed, k = [], 0, 0, 0
    spans: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    for words in word_slices((text or "").encode()):
        end, at = offset + len(words), offset
        while k < len(spans) and spans[k][0] < end:
            a, b = max(spans[k][0], offset), min(spans[k][1], end)
            kept += words[at - offset:a - offset]
            removed += b - a
            at = b
            if spans[k][1] > end:
                break
            k += 1
        kept += words[at - offset:]
        offset = end
    return offset, removed, b" ".join(kept).decode()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          gram: int = GRAM, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """``docs`` with a struct ``dedup`` of ``n_words, n_removed, kept`` (the
    kept words joined by one space); rows and other columns stay (a column
    ``dedup`` is replaced).

    Windows are judged on the input.  Null text has no words.  Rows with a
    null id lose nothing and make nothing a repeat; rows of equal id never
    make each other repeats, repeated rows get equal results."""
    cols = [c for c in docs.columns if c != "dedup"]
    inner = [{id_col: "doc_id", text_col: "text"}.get(c, f"c{i}") for i, c in enumerate(cols)]
    rest = [docs[c].alias(a) for c, a in ((id_col, "doc_id"), (text_col, "text")) if a not in inner]
    # texts travel once: both joins are by id and key
    own = clustered(docs.select(*[docs[c].alias(a) for c, a in zip(cols, inner)], *rest).withColumn("key", F.xxhash64("text")),
                    "texts", "doc_id", "key")
    found = cuts(own.select("doc_id", "text", "key"), window, gram, bucket_runs)

    @F.pandas_udf("struct<n_words:long,n_removed:long,kept:string>")
    def apply(texts, ranges):
        import pandas as pd

        return pd.DataFrame([kept_words(t, r) for t, r in zip(texts, ranges)], columns=["n_words", "n_removed", "kept"])

    joined = own.join(found, ["doc_id", "key"], "left").withColumn("dedup", apply("text", "cuts"))
    return joined.select(*inner, "dedup").toDF(*cols, "dedup")
