"""Language identification by prediction by partial matching (PPM).

Per language a tree of byte contexts up to ``ORDER`` bytes counts which byte
follows.  A byte's code length is that of PPM with escape method C and
exclusion, under frozen statistics: from the longest context known, a byte
not seen there pays the escape (distinct / (total + distinct)) and goes on in
the next shorter context, where bytes already excluded no longer count; below
the empty context all 256 bytes are equal.  A text's language is the one with
the shortest code for the whole text.

Code lengths depend on ``ORDER`` + 1 bytes only, so they are tabulated for
every sequence seen in training, for all languages at once; a text is scored
by sorted-array search.  Sequences seen in none are coded once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows, renamed, staged

ORDER = 3
SAMPLE_BYTES = 1 << 20  # training text per language, about (whole distinct texts, the smallest hashes)
SAMPLE_TOTAL = 200 << 20  # of all languages; more than 200 of them share it evenly
SLICE = 1 << 20
PAD = b"\n" * ORDER     # what stands before a text's first byte
UNKNOWN = "und"


def _grams(raw: bytes, order: int = ORDER) -> np.ndarray:
    """Codes of every byte with the ``order`` bytes before it; ``raw`` starts with them."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = np.zeros(max(0, len(b) - order), np.uint32)
    for k in range(order + 1):
        code = code << np.uint32(8) | b[k:len(b) - order + k]
    return code


def text_grams(text: str) -> Iterator[np.ndarray]:
    raw = PAD + text.encode()
    for at in range(ORDER, len(raw), SLICE):
        yield _grams(raw[at - ORDER:at + SLICE])


class Tree:
    """Context statistics of one language: by order, context -> {byte: count}."""

    def __init__(self, grams: dict[int, int]):
        self.next: list[dict[int, dict[int, int]]] = [{} for _ in range(ORDER + 1)]
        for code, n in grams.items():
            byte, context = code & 255, code >> 8
            for order in range(ORDER + 1):
                node = self.next[order].setdefault(context & ((1 << (8 * order)) - 1), {})
                node[byte] = node.get(byte, 0) + n
        self.total = [{c: sum(f.values()) for c, f in level.items()} for level in self.next]

    def bits(self, code: int) -> float:
        """Exact PPM code length of the last byte after the bytes before it."""
        byte, context = code & 255, code >> 8
        cost, seen = 0.0, {}
        for order in range(ORDER, -1, -1):
            c = context & ((1 << (8 * order)) - 1)
            found = self.next[order].get(c)
            if found is None:
                continue
            # what a longer context has seen, every shorter one has seen too
            total = self.total[order][c] - (sum(found[b] for b in seen) if seen else 0)
            distinct = len(found) - len(seen)
            if byte in found:
                return cost + math.log2(total + distinct) - math.log2(found[byte])
            if distinct:
                cost += math.log2(total + distinct) - math.log2(distinct)
            seen = found
        return cost + math.log2(256 - len(seen))


class Model:
    """Tables of code lengths: ``codes`` sorted, ``table[i, j]`` bits in language j."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[x] for x in self.langs]
        codes = {c << 8 | b for t in self.trees for c, f in t.next[ORDER].items() for b in f}
        self.codes = np.array(sorted(codes), np.uint32)
        self.table = np.array([[t.bits(c) for t in self.trees] for c in self.codes.tolist()], np.float32
                              ).reshape(len(self.codes), len(self.langs))
        self.other: dict[int, list[float]] = {}

    def bits(self, text: str) -> tuple[np.ndarray, int]:
        """Code length of the whole text in every language, and its bytes."""
        total, n = np.zeros(len(self.langs)), 0
        for grams in text_grams(text):
            n += len(grams)
            grams, times = np.unique(grams, return_counts=True)
            at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
            known = self.codes[at] == grams
            total += times[known] @ self.table[at[known]].astype(np.float64)
            for code, k in zip(grams[~known].tolist(), times[~known].tolist()):
                if code not in self.other:
                    if len(self.other) > 200_000:
                        self.other.clear()
                    self.other[code] = [t.bits(code) for t in self.trees]
                total += k * np.array(self.other[code])
        return total, n

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the share of the best language when each has
        the weight 2 ** -(bits a byte).  ``und`` and 0 for null, for text
        without a letter, and where nothing was learned.  Ties go to the
        smaller name."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, n = self.bits(text)
        weight = np.exp2(-(total - total.min()) / n)
        return self.langs[int(np.argmin(total))], float(weight.max() / weight.sum())


def training_texts(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, total: int = SAMPLE_TOTAL) -> DataFrame:
    """``lang, text``: of every language of ``docs(text, lang)`` the distinct
    texts with the smallest hashes, until they hold ``sample_bytes`` (or the
    language's even part of ``total``, if less): one text at least, and all of
    them where they hold less.  No language is left out.

    The last hash is found in a histogram of the distinct texts' bytes, whose
    steps are 1/64 of the hash wide: a step is taken whole."""
    named = docs.where("lang IS NOT NULL AND length(text) > 0").withColumn("hash", F.xxhash64("text"))
    # the hash as an unsigned number in floating point: exponent and the first six digits behind
    place = "(CAST(shiftrightunsigned(hash, 1) AS DOUBLE) + 1)"
    step = f"CAST(floor(log2({place})) * 64 + floor({place} / pow(2D, floor(log2({place}))) * 64) AS INT)"
    named = named.withColumn("step", F.expr(step))
    sizes = named.groupBy("lang", "hash").agg(F.first("step").alias("step"), F.max(F.octet_length("text")).alias("size"))
    steps = staged(sizes.groupBy("lang", "step").agg(F.sum("size").alias("size")), "sample-steps")
    bound = max(1, min(sample_bytes, total // max(1, steps.select("lang").distinct().count())))
    before = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    last = (steps.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
            .where(F.col("before") < bound).groupBy("lang").agg(F.max("step").alias("last")))
    chosen = named.join(F.broadcast(last), "lang").where("step <= last")
    return chosen.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text")


def training_grams(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``lang, code, n`` over the whole texts of :func:`training_texts`."""
    chosen = training_texts(docs, sample_bytes)

    def count(batches):
        for cols in batches:
            held: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(cols["lang"], cols["text"]):
                held.setdefault(lang, []).extend(text_grams(text))
            for lang, parts in held.items():
                codes, times = np.unique(np.concatenate(parts), return_counts=True)
                for c, n in zip(codes.tolist(), times.tolist()):
                    yield lang, c, n

    return map_rows(chosen, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Trees of every language, from a bounded sample (``sample_bytes`` a language).  Rows without
    text or language teach nothing; a table without any gives a model that
    predicts ``und``."""
    grams: dict[str, dict[int, int]] = {}
    for r in training_grams(renamed(docs, lang=lang_col, text=text_col), sample_bytes).collect():
        grams.setdefault(r["lang"], {})[r["code"]] = r["n"]
    return Model({lang: Tree(g) for lang, g in grams.items()})


def held_out(id_col: str = "doc_id"):
    """The documents kept out of training: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row, from its whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        own = shared.value
        for cols in batches:
            for doc, text in zip(cols["doc_id"], cols["text"]):
                yield doc, *own.predict(text)

    return map_rows(renamed(docs, doc_id=id_col, text=text_col), run, "doc_id long, lang_pred string, score double")
