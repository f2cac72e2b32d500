"""Conversation prefix trie by vertical bitmaps.

Conversations are dealt into shards of neighbouring ids.  A shard indexes
(position, turn) to the bitset of its conversations with that turn there; a
depth-first walk intersects the bitset of a node with the postings of the
next position, which gives its children, their popcounts and the conversations
that end.  Nodes of different shards meet by the digest of their turns:
popcounts are added, the smallest member taken, end lists hashed in order.

Sums over subtrees need no walk over the whole trie.  Every node is owned by
its smallest member; each shard sums what it owns along its own preorder, and
a node's sum is that of its shards' sums.  Long conversations are cut into
bands of turns, so neither a shard nor a hot conversation grows with the data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows, staged
from .ordered import numbered

SHARD = 2048      # conversations a shard
BAND = 256        # turns a band
SHARED = 100      # conversation c begins with turns of c - c % SHARED
HEADS = 6         # crc32(decimal c) % HEADS of them
ROOT = b"\0" * 16
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, digest, chars``: narrow rows, texts stay behind."""
    role, text = F.coalesce(turns[role_col], F.lit("")), F.coalesce(turns[text_col], F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return turns.where(turns[id_col].isNotNull()).select(
        turns[id_col].cast("long").alias("conv_id"), turns[turn_col].alias("turn"), role.alias("role"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("digest"), F.length(text).cast("long").alias("chars"))


def rebuilt(turns: DataFrame, shared: int = SHARED, heads: int = HEADS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """``conv_id, range, shard, end`` (turns of the rebuilt conversation) for
    every conversation, and ``conv_id, range, shard, depth, digest, chars``
    for every rebuilt turn (depth from 1)."""
    rows = numbered(turns, "conv_id", [F.asc_nulls_first("turn"), "role", "digest"], "turns")
    own = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_range", "_run")).alias("at"))
    own = own.selectExpr("conv_id", "n", "at._range AS range", f"at._run div {shard} AS shard",
                         f"conv_id - conv_id % {shared} AS base", f"crc32(CAST(conv_id AS STRING)) % {heads} AS h")
    first = rows.where(f"conv_id % {shared} = 0 AND _at < {heads - 1}").groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("_at", "digest", "chars"))).alias("first"))  # less than `heads` a base
    begun = staged(own.join(first, "base", "left").selectExpr(
        "conv_id", "range", "shard", "n", "h", "CASE WHEN h > 0 THEN slice(first, 1, CAST(h AS INT)) END AS first").selectExpr(
        "*", "CASE WHEN first IS NULL THEN 0 ELSE size(first) END AS taken").selectExpr("*", "taken + greatest(n - h, 0) AS end"), "conversations")
    shift = begun.select("conv_id", "range", "shard", (F.col("taken") - F.col("h")).alias("shift"))
    tail = rows.where(F.expr(f"_at >= crc32(CAST(conv_id AS STRING)) % {heads}")).select("conv_id", "_at", "digest", "chars")
    tail = tail.join(shift, "conv_id").selectExpr("conv_id", "range", "shard", "_at + shift + 1 AS depth", "digest", "chars")
    head = begun.select("conv_id", "range", "shard", F.explode("first").alias("t")).selectExpr(
        "conv_id", "range", "shard", "t._at + 1 AS depth", "t.digest", "t.chars")
    return begun.select("conv_id", "range", "shard", "end"), tail.unionByName(head)


def entries(convs: DataFrame, turns: DataFrame, band: int) -> DataFrame:
    """``conv_id, range, shard, band, end, entry``: the bands of every
    conversation and the key of the prefix before each."""
    one = convs.withColumns({"band": F.lit(0).cast("long"), "entry": F.lit(ROOT)})
    long = convs.where(F.col("end") > band)
    longest = convs.agg(F.max("end")).first()[0] or 0
    if longest <= band:
        return one
    full = turns.join(long.select("conv_id", "end"), "conv_id").withColumn("band", F.expr(f"(depth - 1) div {band}")).where(
        f"band < (end - 1) div {band}")
    # at most `band` digests a group
    bands = full.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list(F.struct("depth", "digest"))).alias("t")).select(
        "conv_id", "band", F.expr("unhex(sha2(unhex(array_join(transform(t, x -> hex(x.digest)), '')), 256))").alias("own"))

    def chain(batches):
        conv = None
        for cols in batches:
            for c, k, own in zip(cols["conv_id"], cols["band"], cols["own"]):
                if c != conv:
                    conv, entry = c, ROOT
                entry = _key(entry, own)
                yield c, k + 1, entry

    later = map_rows(bands.repartition("conv_id").sortWithinPartitions("conv_id", "band"), chain,
                     "conv_id long, band long, entry binary")
    return one.unionByName(later.join(long, "conv_id").select(*one.columns))


def _key(entry: bytes, own: bytes) -> bytes:
    return hashlib.sha256(entry + own).digest()[:16]


def walk(members: list[tuple], turns: dict, start: int, stop: int):
    """Nodes of a shard's band in preorder: ``pre, span, parent key, key,
    depth, members, ends, smallest member, chars, ended ids``.

    ``members``: (conv_id, end, entry key) by conv_id; ``turns``: conv_id to
    its (digest, chars) at depths ``start + 1`` to ``stop``.  Prefixes before
    the band are no nodes of it, but for the root."""
    ids = [m[0] for m in members]
    own = [turns.get(c, ()) for c in ids]
    postings: list[dict] = [{} for _ in range(max(map(len, own), default=0))]
    for bit, t in enumerate(own):
        for at, (turn, _) in enumerate(t):
            postings[at][turn] = postings[at].get(turn, 0) | 1 << bit
    ended: dict[int, int] = {}
    for bit, (_, end, _) in enumerate(members):
        ended[end] = ended.get(end, 0) | 1 << bit
    tops: dict[bytes, int] = {}
    for bit, (_, _, entry) in enumerate(members):
        tops[entry] = tops.get(entry, 0) | 1 << bit
    out: list[list] = []
    # bitset, depth, parent's place, parent key, key, hash of the band's turns, chars
    stack = [(bits, start, -1, None, entry, hashlib.sha256(), 0) for entry, bits in tops.items()]
    while stack:
        bits, depth, up, parent, key, state, chars = stack.pop()
        place = up
        if depth > start or depth == 0:
            ends = bits & ended.get(depth, 0)
            place = len(out)
            out.append([place, up, parent, key, depth, bits.bit_count(), ends.bit_count(),
                        ids[(bits & -bits).bit_length() - 1], chars, _ids(ends, ids)])
            bits &= ~ends
        if depth == stop:
            continue
        at, entry = depth - start, members[(bits & -bits).bit_length() - 1][2] if bits else ROOT
        while bits:
            turn, size = own[(bits & -bits).bit_length() - 1][at]
            child = bits & postings[at][turn]
            bits &= ~child
            below = state.copy()
            below.update(turn)
            stack.append((child, depth + 1, place, key, _key(entry, below.digest()), below, size))
    span = [1] * len(out)
    for node in reversed(out):
        if node[1] >= 0:
            span[node[1]] += span[node[0]]
    for node in out:
        yield node[0], span[node[0]], *node[2:]


def _ids(bits: int, ids: list[int]) -> str:
    found = []
    while bits:
        low = bits & -bits
        found.append(str(ids[low.bit_length() - 1]))
        bits ^= low
    return ",".join(found)


_NODE = ("range int, shard long, band long, pre long, span long, parent binary, key binary, depth long, n long, n_ends long,"
         " conv_id long, chars long, ended string")


def nodes(bands: DataFrame, turns: DataFrame, band: int) -> DataFrame:
    """Nodes of every shard and band, written once."""
    marks = bands.selectExpr("range", "shard", "band", "conv_id", "CAST(0 AS BIGINT) AS depth", "entry AS digest", "end AS chars")
    rows = marks.unionByName(turns.withColumn("band", F.expr(f"(depth - 1) div {band}")))
    dealt = rows.repartition("range", "shard", "band").sortWithinPartitions("range", "shard", "band", "conv_id", "depth")

    def run(batches):
        held, members, own = None, [], {}
        for cols in batches:
            for *group, conv, depth, digest, size in zip(*(cols[c] for c in (
                    "range", "shard", "band", "conv_id", "depth", "digest", "chars"))):
                if group != held:
                    if held:
                        yield from done(held, members, own)
                    held, members, own = group, [], {}
                if depth:
                    own.setdefault(conv, []).append((digest, size))
                else:
                    members.append((conv, size, digest))
        if held:
            yield from done(held, members, own)

    def done(group, members, own):
        for node in walk(members, own, group[2] * band, (group[2] + 1) * band):
            yield (*group, *node)

    return staged(map_rows(dealt, run, _NODE), "trie-nodes")


def _sums(owned: DataFrame) -> DataFrame:
    """``key, n_leaves, saved_tokens`` of each shard's subtrees."""

    def run(batches):
        import numpy as np

        held, rows = None, []
        for cols in batches:
            for *group, pre, span, key, leaf, saved in zip(*(cols[c] for c in (
                    "range", "shard", "band", "pre", "span", "key", "leaf", "saved"))):
                if group != held:
                    yield from done(np, rows)
                    held, rows = group, []
                rows.append((span, key, leaf, saved))
        yield from done(np, rows)

    def done(np, rows):  # by pre, which counts from 0
        if rows:
            leaf, saved = (np.cumsum([0, *(r[k] for r in rows)]).tolist() for k in (2, 3))
            for at, (span, key, *_) in enumerate(rows):
                yield key, leaf[at + span] - leaf[at], saved[at + span] - saved[at]

    dealt = owned.repartition("range", "shard", "band").sortWithinPartitions("range", "shard", "band", "pre")
    return map_rows(dealt.select("range", "shard", "band", "pre", "span", "key", "leaf", "saved"), run,
                    "key binary, n_leaves long, saved_tokens long")


def _below(owned: DataFrame, bands: DataFrame, band: int) -> DataFrame:
    """What a band's last nodes get from the bands below: for every
    conversation that goes on, the weights it owns there."""
    weight = owned.where("mine AND band > 0").groupBy(F.col("conv_id"), "band").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    every = bands.where("band > 0").select("conv_id", "range", "shard", "band", "entry")
    below = Window.partitionBy("conv_id").orderBy(F.desc("band"))  # one row a band
    summed = every.join(weight, ["conv_id", "band"], "left").select(
        "range", "shard", (F.col("band") - 1).alias("band"), F.col("entry").alias("key"),
        F.sum(F.coalesce("leaf", F.lit(0))).over(below).alias("leaf"), F.sum(F.coalesce("saved", F.lit(0))).over(below).alias("saved"))
    return summed.groupBy("range", "shard", "band", "key").agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))


def _end_digests(found: DataFrame) -> DataFrame:
    """``key, ends_sha256``: each node's end lists, hashed in order as they stream."""
    lists = found.where("n_ends > 0").select("key", "conv_id", "range", "shard", "ended")
    dealt = lists.repartition("key").sortWithinPartitions("key", "range", "shard")

    def run(batches):
        held = None
        for cols in batches:
            for key, ended in zip(cols["key"], cols["ended"]):
                if key != held:
                    if held is not None:
                        yield held, state.hexdigest()
                    held, state = key, hashlib.sha256()
                    state.update(ended.encode())
                else:
                    state.update(f",{ended}".encode())
        if held is not None:
            yield held, state.hexdigest()

    return map_rows(dealt, run, "key binary, ends_sha256 string")


def trie(turns: DataFrame, shared: int = SHARED, heads: int = HEADS, shard: int = SHARD, band: int = BAND,
         id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node of the trie of all rebuilt conversations: ``conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.

    Turns go by ``turn`` (nulls first); equal turn numbers by role, then by
    the digest of role and text; repeated rows are turns of their own.  Null
    role and text count as empty.  Rows without a conv_id belong to no
    conversation.  ``c - c % shared`` truncates towards zero, as SQL does.
    Turns and prefixes are told apart by 128 bits of SHA-256.  An empty table
    gives no rows (there is no smallest member)."""
    convs, rows = rebuilt(turn_rows(turns, id_col, turn_col, role_col, text_col), shared, heads, shard)
    rows = staged(rows, "rebuilt-turns")
    bands = staged(entries(convs, rows, band), "bands")
    found = nodes(bands, rows, band)
    whole = staged(found.groupBy("key").agg(
        F.sum("n").alias("n_convs"), F.sum("n_ends").alias("n_ends"), F.min("conv_id").alias("least"),
        F.max("depth").alias("depth"), F.first("parent").alias("parent")), "trie-keys")
    mine = F.col("conv_id") == F.col("least")
    owned = found.join(whole.select("key", "n_convs", F.col("n_ends").alias("all_ends"), "least"), "key").select(
        "range", "shard", "band", "pre", "span", "key", "conv_id", mine.alias("mine"),
        F.when(mine & (F.col("n_convs") == F.col("all_ends")), 1).otherwise(0).cast("long").alias("leaf"),
        F.when(mine, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).alias("saved"))
    if bands.where("band > 0").limit(1).count():
        owned = staged(owned, "trie-weights")
        more = staged(_below(owned, bands, band), "trie-below")
        owned = owned.join(more, ["range", "shard", "band", "key"], "left").withColumns({
            c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaf", "saved")})
    none = F.lit(0).cast("long")
    parts = _sums(owned).withColumn("n_children", none).unionByName(
        whole.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
        .select("key", none.alias("n_leaves"), none.alias("saved_tokens"), "n_children"))
    sums = staged(parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")]), "trie-sums")
    above = whole.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    return whole.join(sums, "key").join(staged(_end_digests(found), "trie-ends"), "key", "left").join(above, "parent", "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
