"""Quality rules by a hashed n-gram log-likelihood ratio.

Words and word pairs of a text are hashed to buckets.  Two multinomials over
the buckets are counted: one of a trusted target (documents labelled good and
not toxic, a bounded sample of the labels), one of the raw corpus (all
documents).  The target's prior is the raw corpus itself, so an n-gram the
sample lacks costs at most log 2.  A document's score is the mean log ratio of
its n-grams; it is kept if the score reaches one threshold, fixed before any
document is judged, from labelled documents that the target counts leave out.
Plain base rules come first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import IN_ROWS, map_rows, renamed
from .words import word_slices

BUCKETS = 1 << 14
SMOOTH = 1.0           # added to every bucket of the raw counts
LABEL_SAMPLE = 20_000  # labelled rows the classifier is fitted on, at most
GOOD_WEIGHT = 20.0     # a good document's loss against a bad one's stay, when the threshold is set
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
MIN_WORDS = 50
REPEAT_PERCENT = 50


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def ngram_buckets(words: list[bytes], buckets: int = BUCKETS, last: np.uint64 | None = None):
    """Buckets of the words and of the pairs of neighbours (the pair with the
    word hash ``last`` before them too), and the last word's hash."""
    h = _word_hashes(words)
    if not len(h):
        return np.zeros(0, np.int64), last
    shift = np.uint64(64 - (buckets - 1).bit_length())
    chain = h if last is None else np.concatenate([[last], h])
    pairs = chain[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ chain[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = pairs * np.uint64(0x165667B19E3779F9)
    return np.concatenate([h >> shift, pairs >> shift]).astype(np.int64), h[-1]


def text_buckets(text: str | None, buckets: int = BUCKETS):
    last = None
    for words in word_slices((text or "").encode()):
        found, last = ngram_buckets(words, buckets, last)
        yield found


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words], np.int64)
           for words in word_slices(text.encode())]
    ids = np.concatenate(ids)
    n, repeat = len(ids), 0
    if n >= 3:
        size = len(number)
        pair = ids[:-1] * size + ids[1:]
        if size > 1 << 20:  # keep the codes of three words within 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        three = pair[:-1] * size + ids[2:]
        _, at, times = np.unique(three, return_inverse=True, return_counts=True)
        again = (times[at] > 1).astype(np.int8)
        cover = np.zeros(n, np.int8)
        for k in range(3):
            cover[k:n - 2 + k] |= again
        repeat = int(cover.sum())
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


@dataclass
class Model:
    """``ratio``: log(target / raw) of each bucket; ``threshold``: least score kept."""

    ratio: np.ndarray
    threshold: float

    def score(self, text: str | None) -> float:
        """Mean log ratio of the text's n-grams (0 without words)."""
        total, n = 0.0, 0
        for found in text_buckets(text, len(self.ratio)):
            total += float(self.ratio[found].sum())
            n += len(found)
        return total / n if n else 0.0


def label_sample(labels: DataFrame, size: int = LABEL_SAMPLE) -> DataFrame:
    """``doc_id, quality, toxic, counted`` of at most ``size`` labelled
    documents, chosen by a hash of the id; ``counted`` marks the half whose
    n-grams are counted.  Of several labels the worst holds; null labels and
    ids are left out."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    each = known.groupBy("doc_id").agg(F.min("quality").alias("quality"),
                                       F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).withColumn(
        "counted", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = LABEL_SAMPLE,
        good_weight: float = GOOD_WEIGHT, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts over all documents and the trusted sample, then the threshold.

    What reaches the driver is bounded by ``buckets`` and ``sample``.
    Without trusted documents every ratio is 0 and every document is kept."""
    texts = renamed(docs, doc_id=id_col, text=text_col)
    chosen = label_sample(labels, sample).collect()
    good = {r["doc_id"] for r in chosen if r["quality"] == 1 and not r["toxic"]}
    target_ids = {r["doc_id"] for r in chosen if r["counted"]} & good
    judged = {r["doc_id"]: r["doc_id"] in good for r in chosen
              if r["doc_id"] not in target_ids and (r["quality"] == 0 or r["doc_id"] in good)}

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for cols in batches:
            for doc, text in zip(cols["doc_id"], cols["text"]):
                for found in text_buckets(text, buckets):
                    np.add.at(raw, found, 1)
                    if doc in target_ids:
                        np.add.at(target, found, 1)
        for b in np.flatnonzero(raw).tolist():
            yield b, int(raw[b]), int(target[b])

    rows = map_rows(texts, count, "bucket int, n_raw long, n_target long", IN_ROWS).groupBy("bucket").agg(
        F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")).collect()
    raw, target = np.full(buckets, SMOOTH), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]] += r["n_raw"]
        target[r["bucket"]] = r["n_target"]
    if not target.sum():
        return Model(np.zeros(buckets), float("-inf"))
    model = Model(np.log(0.5 + 0.5 * (target / target.sum()) / (raw / raw.sum())), float("-inf"))
    ids = texts.sparkSession.createDataFrame([(d,) for d in judged], "doc_id long")
    held = texts.join(F.broadcast(ids), "doc_id")

    def scores(batches):
        for cols in batches:
            for doc, text in zip(cols["doc_id"], cols["text"]):
                counts = base_counts(text)
                if not base_failed(counts[0], counts[4]):
                    yield doc, model.score(text)

    # one score a labelled id, however often its row occurs
    scored = map_rows(held, scores, "doc_id long, score double", IN_ROWS).groupBy("doc_id").agg(F.min("score").alias("score"))
    found = [(r["score"], judged[r["doc_id"]]) for r in scored.collect()]
    model.threshold = threshold([s for s, g in found if g], [s for s, g in found if not g], good_weight)
    return model


def threshold(good: list[float], bad: list[float], good_weight: float = GOOD_WEIGHT) -> float:
    """The cut with the least ``share of bad kept + good_weight * share of
    good rejected``; of equals the one in the widest gap, at its middle.
    Minus infinity if nothing is to be gained."""
    if not good or not bad:
        return float("-inf")
    at = np.unique([*good, *bad])
    cuts = (at[:-1] + at[1:]) / 2
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    cost = kept + good_weight * lost
    if not len(cuts) or cost.min() >= 1:
        return float("-inf")
    best = np.flatnonzero(cost == cost.min())
    return float(cuts[best[np.argmax((at[1:] - at[:-1])[best])]])


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept`` for every row (null text: no words)."""

    def run(batches):
        for cols in batches:
            for doc, text in zip(cols["doc_id"], cols["text"]):
                yield doc, *_verdict(text, model)

    return map_rows(renamed(docs, doc_id=id_col, text=text_col), run,
                    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
                    " n_repeat_words long, base_failed boolean, score double, kept boolean", IN_ROWS)


def _verdict(text: str | None, model: Model) -> tuple:
    counts = base_counts(text)
    failed = base_failed(counts[0], counts[4])
    score = model.score(text)
    return *counts, failed, score, not failed and score >= model.threshold


def filtered(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, all columns as they are."""
    import pyarrow as pa

    k = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, IN_ROWS):
                part = b.slice(at, IN_ROWS)
                yield part.filter(pa.array([_verdict(t.as_py(), model)[-1] for t in part.column(k)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
