"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into fewer segments than exact matching would need: of
two fingerprints at two bits or fewer, one of two halves differs in at most
one bit.  Each half is indexed whole (for halves that are equal) and once per
bit with that bit as a wildcard (for halves that differ there); equal keys
are joined and the pairs verified on all 64 bits.

Work is per distinct fingerprint.  A key held by two needs no more than its
minimum and maximum; one held by up to ``BUCKET`` is verified inside the
bucket, which yields a spanning forest of its links, not all pairs.  Larger
buckets are cut again by wildcards on the other half: two bits where the
halves are equal, one where they differ.  That leaves at most four
fingerprints a key, so no bucket grows with the data and no link is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import IN_ROWS, map_rows, renamed, staged
from .components import components
from .words import word_slices

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET = 512
TASK_CLASSES = 1 << 14  # fingerprints whose keys (66 each) one task counts in memory


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text (null: as empty, zero)."""
    import xxhash

    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_slices((text or "").encode().lower()):
        words = tail + words
        if len(words) < shingle:
            tail = words
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], "<u8")
        for i in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[i:i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
            ones += bits.sum(axis=0, dtype=np.int64)
        total += len(h)
        tail = words[len(words) - shingle + 1:] if shingle > 1 else []
    if not total and tail:
        ones += [xxhash.xxh64_intdigest(b" ".join(tail), SEED) >> b & 1 for b in range(64)]
        total = 1
    return sum(1 << b for b in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long), a row for each input row."""

    def run(batches):
        for cols in batches:
            for doc, text in zip(cols["doc_id"], cols["text"]):
                fp = fingerprint(text, shingle)
                yield doc, fp - (1 << 64) if fp >> 63 else fp

    return map_rows(renamed(docs, doc_id=id_col, text=text_col), run, "doc_id long, fp long", IN_ROWS)


def fingerprint_column(shingle: int = SHINGLE):
    """Column expression: the fingerprint of a text, as in :func:`fingerprints`."""

    @F.pandas_udf("long")
    def of(texts):
        import pandas as pd

        found = (fingerprint(t, shingle) for t in texts)
        return pd.Series([fp - (1 << 64) if fp >> 63 else fp for fp in found], dtype="int64")

    return of


def _forest(max_bits: int):
    """Links that connect what pairs within ``max_bits`` connect, in one bucket."""

    @F.pandas_udf("array<struct<u:long,v:long>>")
    def forest(members):
        import pandas as pd

        out = []
        for group in members:
            fp = np.unique(np.asarray(group, np.int64))
            near = np.bitwise_count(fp[:, None].view(np.uint64) ^ fp[None, :].view(np.uint64)) <= max_bits
            left, links = np.ones(len(fp), bool), []
            while left.any():
                front = [int(np.argmax(left))]
                left[front[0]] = False
                while front:
                    k = front.pop()
                    new = np.flatnonzero(near[k] & left)
                    left[new] = False
                    links += [{"u": int(fp[k]), "v": int(fp[j])} for j in new]
                    front += new.tolist()
            out.append(links)
        return pd.Series(out, dtype=object)

    return forest


def dealt(classes: DataFrame, rows: int = TASK_CLASSES) -> DataFrame:
    """``classes`` in so many partitions that each holds about ``rows``: a scan
    puts a file of short rows into few tasks, whatever each row becomes there."""
    return classes.repartition(max(1, -(-classes.count() // rows)))


def links(classes: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``u, v``: links that connect all distinct fingerprints ``fp`` at
    ``max_bits`` (1 or 2) or fewer differing bits.  Every link returned is
    verified; links that others already imply may be absent."""
    if max_bits not in (1, 2):
        raise ValueError("two halves with one wildcard cover 1 or 2 bits")
    # s: 0-31 and 32-63 the halves with bit s % 32 as a wildcard, 64 and 65 the whole halves
    low = "(s < 32 OR s = 64)"
    half = f"(CASE WHEN {low} THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END)"
    keys = dealt(classes).selectExpr("fp", "explode(sequence(0, 65)) AS s").selectExpr("fp", "s", f"{half} AS half").selectExpr(
        "fp", "(CAST(s AS BIGINT) << 32) | (CASE WHEN s < 64 THEN half & ~(1L << (s % 32)) ELSE half END) AS key",
        "CASE WHEN s < 64 THEN (half >> (s % 32)) & 1L END AS bit")
    held = staged(keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"),
        F.min("bit").alias("bit0"), F.max("bit").alias("bit1"),
    ).where("n > 1 AND (bit0 IS NULL OR bit0 < bit1)").drop("bit0", "bit1"), "signatures")
    two = held.where(f"n = 2 AND bit_count(u ^ v) <= {max_bits}").select("u", "v")
    more = keys.select("key", "fp").join(held.where("n > 2").select("key", "n"), "key")
    forest = _forest(max_bits)

    def linked(grouped):
        return grouped.select(F.explode(forest("members")).alias("l")).select("l.u", "l.v")

    some = linked(more.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("members")))
    seg = "(key >> 32)"
    other = f"(CASE WHEN {seg} < 32 OR {seg} = 64 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END)"
    wild = f"(CASE WHEN {seg} < 64 THEN array(x * 33) ELSE transform(sequence(0, x), y -> x * 32 + y) END)"
    cut = more.where(F.col("n") > bucket).selectExpr(
        "key", "fp", f"explode(flatten(transform(sequence(0, 31), x -> {wild}))) AS w").selectExpr(
        "key", "fp", "w", f"{other} & ~(1L << (w % 32)) & ~(1L << CAST(w div 32 AS INT)) AS rest")
    many = linked(cut.groupBy("key", "w", "rest").agg(F.collect_list("fp").alias("members")).where("size(members) > 1"))
    return two.unionByName(some).unionByName(many)


def groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
           bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, root, component_id`` for every row: ``root`` tells
    components apart, also those with the same smallest doc_id."""
    prints = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), max_bits, bucket))
    of = staged(classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "class-roots")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = staged(of.join(staged(least, "component-ids"), "root").select("fp", "root", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    ``component_id`` is the smallest doc_id reachable over links (null only
    if all ids of a component are null).  Null and empty texts have
    fingerprint zero and are linked like any other; repeated rows share
    their component; an empty table gives no rows."""
    return groups(docs, shingle, max_bits, bucket, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text`` and further columns ``x0, x1, ...``)
    that stay when of each group of near-duplicates the smallest id does.

    Rows with a null id stay.  Where several rows have an id, each group of
    which it is the smallest keeps one of them, the smallest text.  Null and
    empty texts are one group; an empty table stays empty."""
    named = docs.where("doc_id IS NOT NULL")
    found = staged(groups(named.select("doc_id", "text"), shingle, max_bits), "groups")
    rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.expr("doc_id = component_id")).alias("_first"))
    # texts meet the ids that go or repeat, by far the fewer, not those that stay
    other = staged(rows.where("NOT _first OR _n > 1"), "other-ids")
    several = other.where("_first").select("doc_id")
    alone = named.join(other.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # an id of several rows does not say which of them are in the group: their fingerprints do
    own = found.where("doc_id = component_id").join(several, "doc_id", "left_semi").select(
        "doc_id", F.col("fp").alias("_fp"), F.col("root").alias("_root")).distinct()
    # called deterministic, the function would go below the first join as a filter for nulls, and so to every text
    print_of = fingerprint_column(shingle).asNondeterministic()
    shared = named.join(several, "doc_id").withColumn("_fp", print_of("text")).join(own, ["doc_id", "_fp"])
    order = Window.partitionBy("doc_id", "_root").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    one = shared.withColumn("_place", F.row_number().over(order)).where("_place = 1").select(*docs.columns)
    return alone.unionByName(one).unionByName(docs.where("doc_id IS NULL"))
