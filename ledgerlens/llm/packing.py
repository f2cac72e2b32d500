"""Packing by minimum bin slack.

Documents are cut into pieces of at most ``capacity`` ids: full windows and
one remainder.  What fills the windows is planned on the histogram of piece
lengths alone (at most ``capacity`` rows, whatever the input's size): a
bitset subset-sum over the remaining lengths picks, beside the longest one
left, the multiset that comes closest to the capacity; the counts used are
backtracked, and the pattern is repeated as often as the counts allow.  The
pieces then find their window by their rank among pieces of equal length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import IN_ROWS, map_rows, renamed, staged, task_id
from .tokens import encode_column

CAPACITY = 2048


def best_fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) with the largest
    sum up to ``target``.  Bit s of ``bits`` is 1 if sum s can be reached;
    counts go in by powers of two, so k equal lengths cost log k steps."""
    mask, bits, steps = (1 << (target + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= target), reverse=True):
        left, k = min(counts[length], target // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, bits))
            bits |= (bits << (take * length)) & mask
            left, k = left - take, 2 * k
        if bits >> target & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:  # only with this item could the sum be reached
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({length: count}, repetitions)`` that use up the histogram."""
    left = {k: v for k, v in histogram.items() if v > 0}
    plan = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = best_fill({k: v for k, v in rest.items() if v}, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        plan.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return plan


def _slots(plan):
    """Per length the rank intervals of the patterns, sorted by (length, rank)."""
    rank, seq, rows = {}, 0, []
    for pattern, times in plan:
        offset, fill = 0, sum(k * n for k, n in pattern.items())
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            lo = rank.get(length, 0)
            rows.append((length, lo, n, seq, offset, fill))
            rank[length] = lo + n * times
            offset += n * length
        seq += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: ``doc_id, start, length, doc_tokens, ids`` (little-endian
    unsigned 32-bit), and ``part, pos``: the task, and the piece's number
    among pieces of its length there.  Null text counts as empty, and still
    gives the end id; a repeated row is packed as often as it occurs."""

    def run(batches):
        part, seen = task_id(), {}
        for row, ids in encode_column(batches, tokenizer):
            ids = np.append(ids, end_id).astype("<u4")
            for start in range(0, len(ids), capacity):
                cut = ids[start:start + capacity]
                pos = seen.get(len(cut), 0)
                seen[len(cut)] = pos + 1
                yield row["doc_id"], start, len(cut), len(ids), cut.tobytes(), part, pos

    return map_rows(renamed(docs, doc_id=id_col, text=text_col), run,
                    "doc_id long, start long, length long, doc_tokens long, ids binary, part int, pos long", IN_ROWS)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed pieces: those of :func:`pieces` with ``ids_crc32`` and
    ``sequence_id, offset, sequence_length, padded_length``.

    A sequence is padded to ``capacity`` unless its length is a power of two.
    Empty input gives no rows."""
    cut = staged(pieces(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan_windows(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (cut.withColumn("ids_crc32", F.crc32("ids"))
              .join(base, ["length", "part"])
              .withColumn("rank", F.col("base") + F.col("pos")).drop("base", "part", "pos"))
    return _seated(ranked, slots, capacity)


def _seated(ranked: DataFrame, slots: np.ndarray, capacity: int) -> DataFrame:
    """Window and offset of each piece by its rank; ``slots`` has a bounded
    number of rows (a pattern uses up at least one length's count)."""
    keys = slots[:, 0] << 44 | slots[:, 1]

    @F.pandas_udf("struct<sequence_id:long,offset:long,sequence_length:long,padded_length:long>")
    def seat(length, rank):
        import pandas as pd

        size, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        s = slots[np.searchsorted(keys, size << 44 | r, side="right") - 1]
        turn = r - s[:, 1]
        n, fill = s[:, 2], s[:, 5]
        return pd.DataFrame({"sequence_id": s[:, 3] + turn // n, "offset": s[:, 4] + turn % n * size,
                             "sequence_length": fill,
                             "padded_length": np.where(fill & (fill - 1) == 0, fill, capacity)})

    return ranked.withColumn("seat", seat("length", "rank")).select(
        "doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "seat.*")


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence: its pieces in order (at most ``capacity`` of them)
    and the ids joined.  Padding is left to the reader (``padded_length``)."""
    piece = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    return packed.groupBy("sequence_id", "sequence_length", "padded_length").agg(piece.alias("pieces")).select(
        "sequence_id", "sequence_length", "padded_length",
        F.transform("pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"),
                                                 p["offset"].alias("offset"))).alias("pieces"),
        F.expr("aggregate(pieces, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))
