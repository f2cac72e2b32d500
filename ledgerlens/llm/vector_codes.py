"""Vector code compression: product codes by per-dimension value dictionaries.

Components become integers, floor(scale * x).  Rows are stored in blocks; a
block holds, per dimension, the dictionary of its distinct integers and each
row's dictionary code.  To assign parts to codebook entries, the squared
differences of every dictionary value to all entries are tabulated once per
block and dimension; a part's distances are then gathers of table rows by
code, added up.  A block's tables do not grow with the data, and nothing but
the codebooks and their sums (entries x dimensions) meets on the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import staged

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 8192      # rows a block; a code of a dictionary fits 16 bits
STEP = 1024       # rows whose distances are held at once
_BLOCK = "vec_id array<long>, label array<string>, sizes array<int>, dictionary binary, codes binary"


def cuts(dim: int, parts: int) -> list[int]:
    """Where parts start and end; equal parts if ``dim`` is a multiple."""
    return [dim * p // parts for p in range(parts + 1)]


def clean(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
          label_col: str = "label") -> DataFrame:
    """``vec_id, label, vector`` without null vectors and vectors with null or
    non-finite components."""
    df = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"),
                        vectors[vector_col].cast("array<double>").alias("vector"))
    return df.where("vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")


class Block:
    """Rows of one block: per dimension a dictionary of integers and codes."""

    def __init__(self, sizes, dictionary: bytes, codes: bytes):
        ends = np.cumsum([0, *sizes])
        values = np.frombuffer(dictionary, "<i8")
        self.values = [values[a:b] for a, b in zip(ends, ends[1:])]
        self.codes = np.frombuffer(codes, "<u2").reshape(len(self.values), -1) if len(self.values) else None

    def assign(self, books: list[np.ndarray], rows: int):
        """Per part, the nearest entry of each row (ties: the lower index) and
        its squared distance."""
        at = 0
        for book in books:
            entry, error = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            dims = range(at, at + book.shape[1])
            at += book.shape[1]
            reach = sum(max(int(self.values[d].max()) - int(book[:, k].min()), int(book[:, k].max()) - int(self.values[d].min()))
                        ** 2 for k, d in enumerate(dims))
            kind = np.int32 if reach < 1 << 31 else np.int64
            tables = [((self.values[d][:, None] - book[None, :, k]) ** 2).astype(kind) for k, d in enumerate(dims)]
            for a in range(0, rows, STEP):
                b = min(a + STEP, rows)
                total, part = np.zeros((b - a, len(book)), kind), np.empty((b - a, len(book)), kind)
                for table, d in zip(tables, dims):
                    np.take(table, self.codes[d, a:b], axis=0, out=part, mode="clip")
                    total += part
                entry[a:b] = total.argmin(axis=1)
                error[a:b] = total[np.arange(b - a), entry[a:b]]
            yield entry, error

    def sums(self, books: list[np.ndarray], rows: int) -> list[np.ndarray]:
        """Per part, entries x (components' sums, count)."""
        out, at = [], 0
        for book, (entry, _) in zip(books, self.assign(books, rows)):
            n = len(book)
            # a block's sums stay below 2^53, where double sums of integers are exact
            cols = [np.bincount(entry, self.values[d][self.codes[d]], n) for d in range(at, at + book.shape[1])]
            out.append(np.stack([*cols, np.bincount(entry, minlength=n)], axis=1).astype(np.int64))
            at += book.shape[1]
        return out


def blocks(kept: DataFrame, dim: int, scale: int = SCALE) -> DataFrame:
    """Rows of ``dim`` components as stored blocks."""

    def block(ids, labels, flat):
        ints = np.floor(np.concatenate(flat).reshape(len(ids), dim) * scale).astype(np.int64)
        found = [np.unique(ints[:, d], return_inverse=True) for d in range(dim)]
        values = [v for v, _ in found]
        return pa.RecordBatch.from_pydict({
            "vec_id": pa.array([ids], pa.list_(pa.int64())), "label": pa.array([labels], pa.list_(pa.string())),
            "sizes": pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
            "dictionary": pa.array([b"".join(v.astype("<i8").tobytes() for v in values)], pa.binary()),
            "codes": pa.array([b"".join(c.astype("<u2").tobytes() for _, c in found)], pa.binary())})

    def run(batches):
        ids, labels, flat = [], [], []
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                if len(ids) + part.num_rows > BLOCK:
                    yield block(ids, labels, flat)
                    ids, labels, flat = [], [], []
                ids += part.column("vec_id").to_pylist()
                labels += part.column("label").to_pylist()
                flat.append(part.column("vector").flatten().to_numpy(zero_copy_only=False))
        if ids:
            yield block(ids, labels, flat)

    return staged(kept.mapInArrow(run, _BLOCK), "vector-blocks")


def _each(batches):
    for batch in batches:
        for ids, labels, *stored in zip(*(batch.column(n).to_pylist() for n in batch.schema.names)):
            yield ids, labels, Block(*stored)


def refine(stored: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: each entry becomes its parts' componentwise floor(sum / count)."""

    def run(batches):
        total = None
        for ids, _, block in _each(batches):
            own = block.sums(books, len(ids))
            total = own if total is None else [a + b for a, b in zip(total, own)]
        if total is not None:
            flat = np.concatenate([t.ravel() for t in total])
            slot = np.flatnonzero(np.concatenate([np.repeat(t[:, -1] > 0, t.shape[1]) for t in total]))
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(flat[slot], pa.int64())], ["slot", "total"])

    found = stored.mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(sum(b.shape[0] * (b.shape[1] + 1) for b in books), np.int64)
    for r in found:
        flat[r["slot"]] = r["total"]
    out, at = [], 0
    for book in books:
        own = flat[at:at + book.shape[0] * (book.shape[1] + 1)].reshape(book.shape[0], book.shape[1] + 1)
        at += own.size
        used = own[:, -1:] > 0
        out.append(np.where(used, own[:, :-1] // np.maximum(own[:, -1:], 1), book))
    return out


def codes(stored: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error`` under fixed codebooks."""
    from .common import BATCH_ROWS

    def run(batches):
        for ids, labels, block in _each(batches):
            entry, error = zip(*block.assign(books, len(ids)))
            code, total = np.stack(entry, axis=1).astype(np.uint8), np.sum(error, axis=0)
            text = [row.tobytes().hex() for row in code]
            whole = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(text),
                                                pa.array(total, pa.int64())], ["vec_id", "label", "code", "error"])
            for a in range(0, len(ids), BATCH_ROWS):
                yield whole.slice(a, BATCH_ROWS)

    return stored.mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry, position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row.

    Codebooks start as the parts of the ``entries`` (256 at most) rows with
    the smallest ids (null ids last, equal ids by vector; each repeated row
    counts) and are refined in ``rounds`` rounds.  ``label_error`` sums the
    error over rows of equal label, null labels together.

    All vectors should have the length of that with the smallest id.  Rows of
    another length, or with a component so large that squared distances leave
    63 bits, stay with null code and error and train nothing.  A length that
    is no multiple of ``parts`` gives parts that differ by one.  Fewer rows
    than ``entries`` give that many entries; no rows give no rows."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept = clean(vectors, id_col, vector_col, label_col)
    order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    first = kept.orderBy(*order).limit(1).collect()
    dim = len(first[0]["vector"]) if first else 0
    at = cuts(dim, parts)
    most = int((2.0 ** 62 / max(1, dim)) ** 0.5 / 2) / scale
    fits = F.expr(f"size(vector) = {dim} AND NOT exists(vector, x -> abs(x) >= {most!r}D)")
    start = [r["vector"] for r in kept.where(fits).orderBy(*order).limit(entries).collect()]
    ints = np.floor(np.array(start, float).reshape(len(start), dim) * scale).astype(np.int64)
    books = [ints[:, a:b] for a, b in zip(at, at[1:])]
    stored = blocks(kept.where(fits), dim, scale)
    for _ in range(rounds):
        books = refine(stored, books)
    odd = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"),
                                   F.lit(None).cast("long").alias("error"))
    coded = staged(codes(stored, books).unionByName(odd), "vector-codes")
    sums = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, coded["label"].eqNullSafe(sums["label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
