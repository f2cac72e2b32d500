"""Token files: patched frame-of-reference blocks.

A file is a table of self-contained segments in id order.  A segment holds
whole documents: their doc ids and lengths, and their ids in blocks of
``BLOCK``.  A block subtracts its minimum, packs what is left at the width
that covers a percentile of its values, and lists the others as exceptions
(position, value).  The block starts are indexed, so one block can be read
without its neighbours.

Segments are Parquet rows (one binary each), because executors share only
what Spark's own readers and writers reach.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import IN_ROWS, map_rows, renamed, staged, task_id
from .tokens import encode_column, encoder

BLOCK = 1024
PERCENTILE = 95
SEGMENT_IDS = 1 << 16
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIIII")   # magic, ids, documents, block size, blocks
BLOCK_HEAD = struct.Struct("<IBH")  # minimum, width, exceptions


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values at ``width`` bits each, packed; one byte row a block."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    raw = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(len(values), -1, 4), axis=2)
    return np.packbits(raw[:, :, 32 - width:].reshape(len(values), -1), axis=1)


def _values(packed: np.ndarray, width: int, block: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), block), np.uint32)
    raw = np.zeros((len(packed), block, 32), np.uint8)
    raw[:, :, 32 - width:] = np.unpackbits(packed, axis=1)[:, :block * width].reshape(len(packed), block, width)
    return np.packbits(raw, axis=2).view(">u4").reshape(len(packed), block).astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> list[bytes]:
    """The ids as blocks; the last one is filled up with its minimum."""
    n = -(-len(ids) // block)
    if not n:
        return []
    whole = np.full(n * block, ids[(n - 1) * block:].min(), np.uint32)
    whole[:len(ids)] = ids
    whole = whole.reshape(n, block)
    low = whole.min(axis=1)
    rest = whole - low[:, None]
    at = min(block - 1, -(-block * percentile // 100) - 1)
    cover = np.partition(rest, at, axis=1)[:, at]
    widths = np.frexp(cover.astype(np.float64))[1]
    over = rest >> np.minimum(widths, 31)[:, None].astype(np.uint32) > 0
    over &= (widths < 32)[:, None]
    small = np.where(over, 0, rest)
    out: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        for k, packed in zip(rows.tolist(), _bits(small[rows], width)):
            where = np.flatnonzero(over[k])
            out[k] = (BLOCK_HEAD.pack(int(low[k]), width, len(where)) + where.astype("<u2").tobytes()
                      + rest[k][where].astype("<u4").tobytes() + packed.tobytes())
    return out


def decode_blocks(blocks: list[bytes], block: int = BLOCK) -> np.ndarray:
    heads = [BLOCK_HEAD.unpack_from(b) for b in blocks]
    out = np.zeros((len(blocks), block), np.uint32)
    widths = np.array([h[1] for h in heads], np.int64)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        body = [np.frombuffer(blocks[k], np.uint8, offset=BLOCK_HEAD.size + 6 * heads[k][2]) for k in rows]
        out[rows] = _values(np.stack(body), width, block)
    for k, (low, _, count) in enumerate(heads):
        if count:
            where = np.frombuffer(blocks[k], "<u2", count, BLOCK_HEAD.size)
            out[k, where] = np.frombuffer(blocks[k], "<u4", count, BLOCK_HEAD.size + 2 * count)
        out[k] += np.uint32(low)
    return out.reshape(-1)


def encode_segment(docs: list[tuple[int | None, np.ndarray]], block: int = BLOCK) -> bytes:
    ids = np.concatenate([d[1] for d in docs]) if docs else np.zeros(0, np.uint32)
    blocks = encode_blocks(ids, block)
    starts = np.cumsum([0, *map(len, blocks)])
    return b"".join([
        HEAD.pack(MAGIC, len(ids), len(docs), block, len(blocks)),
        np.array([d[0] is not None for d in docs], "u1").tobytes(),
        np.array([d[0] or 0 for d in docs], "<i8").tobytes(),
        np.array([len(d[1]) for d in docs], "<u4").tobytes(),
        starts.astype("<u4").tobytes(), *blocks])


class Segment:
    """Reader of one segment; ``read(start, stop)`` decodes only the blocks it needs."""

    def __init__(self, data: bytes):
        magic, self.n_ids, n_docs, self.block, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size
        known = np.frombuffer(data, "u1", n_docs, at)
        doc_ids = np.frombuffer(data, "<i8", n_docs, at + n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids, known)]
        at += 9 * n_docs
        self.lengths = np.frombuffer(data, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        self.starts = np.frombuffer(data, "<u4", n_blocks + 1, at).astype(np.int64)
        self.at, self.data = at + 4 * (n_blocks + 1), data

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        blocks = [self.data[self.at + self.starts[k]:self.at + self.starts[k + 1]] for k in range(first, last)]
        return decode_blocks(blocks, self.block)[start - first * self.block:stop - first * self.block]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The token file of ``docs`` in ascending doc_id order (null first; equal
    ids in any one order): rows ``shard, segment, n_ids, n_docs, data``.

    Null text counts as empty and gives the end id alone; repeated rows are
    written as often as they occur; an empty table gives no segments."""
    spark = docs.sparkSession

    def ids_of(batches):
        part = task_id()
        dtype = encoder(tokenizer).dtype
        if end_id >= 1 << (8 * dtype.itemsize):
            dtype = np.dtype("<u4")
        end = np.array([end_id], dtype).tobytes()
        for pos, (row, ids) in enumerate(encode_column(batches, tokenizer)):
            yield row["doc_id"], part, pos, dtype.itemsize, ids.astype(dtype, copy=False).tobytes() + end

    plain = staged(map_rows(renamed(docs, doc_id=id_col, text=text_col), ids_of,
                            "doc_id long, part int, pos long, width int, ids binary", IN_ROWS), "tokens")

    def segments(batches):
        shard, held, size, k = task_id(), [], 0, 0
        for cols in batches:
            for doc, width, ids in zip(cols["doc_id"], cols["width"], cols["ids"]):
                held.append((doc, np.frombuffer(ids, f"<u{width}").astype(np.uint32)))
                size += len(held[-1][1])
                if size >= SEGMENT_IDS:
                    yield shard, k, size, len(held), encode_segment(held)
                    held, size, k = [], 0, k + 1
        if held:
            yield shard, k, size, len(held), encode_segment(held)

    # part and pos make every key distinct: equal doc ids can be parted too
    ordered = plain.repartitionByRange("doc_id", "part", "pos").sortWithinPartitions("doc_id", "part", "pos")
    return staged(map_rows(ordered, segments, "shard int, segment int, n_ids long, n_docs long, data binary"),
                  "token-file")


def read_documents(file: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read a token file back: ``doc_id, start, n_tokens, ids_crc32`` (and
    ``ids``, little-endian unsigned 32-bit).  ``start`` counts the ids of all
    documents before this one."""

    def decode(batches):
        for cols in batches:
            for shard, k, data in zip(cols["shard"], cols["segment"], cols["data"]):
                seg = Segment(data)
                ids, at = seg.read().astype("<u4"), 0
                for doc, n in zip(seg.doc_ids, seg.lengths.tolist()):
                    raw = ids[at:at + n].tobytes()
                    yield (shard, k, doc, at, n, zlib.crc32(raw), *([raw] if with_ids else []))
                    at += n

    rows = map_rows(file.select("shard", "segment", "data"), decode,
                    "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long"
                    + ", ids binary" * with_ids)
    sizes = file.select("shard", "segment", "n_ids")
    # one row a shard: as many as the write had partitions
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.sum("n").over(Window.orderBy("shard")).alias("upto"), "n")
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    base = sizes.select("shard", "segment", inside.alias("inside")).join(shards, "shard").select(
        "shard", "segment", (F.col("inside") + F.col("upto") - F.col("n")).alias("base"))
    return rows.join(base, ["shard", "segment"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
