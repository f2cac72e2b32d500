"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles (as 64-bit hashes) gets a signature of
``SYMBOLS`` b-bit MinHash values: the low ``BITS`` bits of the smallest hash
under each of as many permutations.  Signatures are cut into ``CHUNKS``
chunks.  By the pigeonhole principle two signatures that differ in at most
``2 * CHUNKS - 1`` symbols have a chunk that differs in at most one, so every
chunk is indexed once for each of its symbols as the one that may be wrong.
Equal keys give all pairs under that distance; sets at a similarity of 0.85
exceed it about once in 60,000 pairs, more similar ones less often.

Work is per distinct set.  A key's sets first meet only its smallest one: a
star, not all pairs.  Candidates close enough by signature and size are
confirmed on their full sets.  Where a key then still holds several
components, the hashes that no other component's set has are counted: a set
with too many of them can have no partner there, two sets with many cannot be
partners.  What that leaves open meets in blocks of bounded size, where a
longer signature rules out all but likely pairs (about 1 in 75,000 of the
least similar ones wrongly); sets already connected are not compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, staged
from .components import components
from .words import word_slices

SHINGLE = 3
PERCENT = 85      # of the union that must be shared
CHUNKS = 10
WIDTH = 5         # symbols a chunk
SYMBOLS = CHUNKS * WIDTH
DISTANCE = 2 * CHUNKS - 1
BITS = 16
SEED = 11
BLOCK = 1024      # members of a key that meet at once, on either side
FINE = 400        # one-byte symbols of the longer signature that sets of unsettled keys get
NEAREST = 1       # of a set's neighbours under a key that are tried before all others
ROWS = 2048       # hashes permuted at once


def _folded(words: list[np.ndarray]) -> np.ndarray:
    """One hash of the words at equal places, in order."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = (out ^ w) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z lower-cased
    (fewer words: the whole sequence; no words or null: empty)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts, tail = [], np.zeros(0, np.uint64)
    for words in word_slices((text or "").encode().lower()):
        own = np.fromiter(map(digest, words), np.uint64, len(words))
        own = np.concatenate([tail, own])
        n = len(own) - shingle + 1
        if n < 1:
            tail = own
            continue
        parts.append(np.unique(_folded([own[k:k + n] for k in range(shingle)])))
        tail = own[n:]
    if not parts and len(tail):
        parts.append(_folded([tail[k:k + 1] for k in range(len(tail))]))
    if len(parts) == 1:
        return parts[0]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


class Signer:
    """b-bit MinHash signatures; the same for every worker."""

    def __init__(self, symbols: int = SYMBOLS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.factor = draw.integers(0, 1 << 63, symbols, np.uint64) << np.uint64(1) | np.uint64(1)
        self.mask = draw.integers(0, 1 << 63, symbols, np.uint64) << np.uint64(1)

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for a in range(0, len(hashes), ROWS):
            part = (hashes[a:a + ROWS, None] ^ self.mask) * self.factor
            np.minimum(least, part.min(axis=0), out=least)
        return (least & np.uint64((1 << BITS) - 1)).astype("<u2")


def prints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
           sets: bool = False) -> DataFrame:
    """``doc_id, own, n, sign`` for each row: a 128-bit digest of the set, its
    size, its signature; with ``sets`` also the hashes as ``items``."""
    import hashlib

    fields = [("doc_id", pa.int64()), ("own", pa.binary()), ("n", pa.int64()), ("sign", pa.binary())]
    if sets:
        fields.append(("items", pa.list_(pa.int64())))
    schema = pa.schema(fields)

    def run(batches):
        signer, out, size = Signer(), [], 0

        def flush():
            cols = list(zip(*out))
            flat = [pa.array(c, f.type) for c, f in zip(cols[:4], schema)]
            if sets:
                ends = np.cumsum([0, *map(len, cols[4])])
                flat.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cols[4]).view(np.int64))))
            return pa.RecordBatch.from_arrays(flat, schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                items = shingle_set(text.as_py(), shingle)
                row = [doc, hashlib.blake2b(items.tobytes(), digest_size=16).digest(), len(items), signer.sign(items).tobytes()]
                out.append([*row, items] if sets else row)
                size += len(items) if sets else 1
                if size >= 1 << 19 or len(out) >= 8192:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    kind = "doc_id long, own binary, n long, sign binary" + ", items array<long>" * sets
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, kind)


def chunk_keys(sign: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows): every chunk without each one of its symbols."""
    mixed = np.empty((len(sign), SYMBOLS), np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    chunks = sign.reshape(len(sign), CHUNKS, WIDTH).astype(np.uint64)
    for left_out in range(WIDTH):
        for c in range(CHUNKS):
            key = np.full(len(sign), c * WIDTH + left_out + 1, np.uint64)
            for k in range(WIDTH):
                if k != left_out:
                    key = (key ^ chunks[:, c, k]) * odd
                    key ^= key >> np.uint64(29)
            mixed[:, c * WIDTH + left_out] = key
    return mixed.view(np.int64)


def _keys():
    @F.pandas_udf("array<long>")
    def of(signs):
        import pandas as pd

        flat = np.frombuffer(b"".join(signs), "<u2").reshape(len(signs), SYMBOLS)
        return pd.Series(list(chunk_keys(flat)))

    return of


def _distance():
    @F.pandas_udf("int")
    def of(a, b):
        import pandas as pd

        one, two = (np.frombuffer(b"".join(x), "<u2").reshape(len(x), SYMBOLS) for x in (a, b))
        return pd.Series((one != two).sum(axis=1), dtype="int32")

    return of


def _sized(percent: int) -> str:
    """Sets whose sizes alone do not rule the similarity out."""
    return f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)"


def _full_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, name: str) -> DataFrame:
    """``id, items`` of the wanted classes: their texts are read once more."""
    wanted = staged(ids.distinct().join(classes.select("id", "first", "own"), "id"), "wanted-sets")
    named = wanted.select("first").distinct()
    # texts go where a class's first document is; another text under the same id has another digest
    texts = docs.join(named, docs["doc_id"].eqNullSafe(named["first"]), "left_semi")
    found = prints(texts, shingle, sets=True).select("own", "items").join(wanted.select("id", "own"), "own")
    return staged(found.dropDuplicates(["id"]).select("id", "items"), name)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``u, v`` of classes those whose full sets are similar."""
    both = pairs.join(sets.withColumnsRenamed({"id": "u", "items": "a"}), "u").join(
        sets.withColumnsRenamed({"id": "v", "items": "b"}), "v")
    shared = both.select("u", "v", F.size("a").alias("x"), F.size("b").alias("y"), F.size(F.array_intersect("a", "b")).alias("s"))
    return shared.where(f"100L * s >= {percent}L * (x + y - s)").select("u", "v")


def _slack(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``id, n, slack``: how many of a set's hashes no set of another component
    has.  These cannot be shared with any set it may yet be linked with."""
    own = sets.join(roots, "id").select("id", "root", F.explode("items").alias("item"))
    shared = own.groupBy("item").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("item")
    met = own.join(shared, "item", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("met"))
    return sets.select("id", F.size("items").cast("long").alias("n")).join(met, "id", "left").select(
        "id", "n", (F.col("n") - F.coalesce("met", F.lit(0))).alias("slack"))


def _fine(sets: DataFrame) -> DataFrame:
    """``id, fine``: a longer signature of full sets."""

    def run(batches):
        signer = Signer(FINE, SEED + 1)
        for cols in batches:
            for doc, items in zip(cols["id"], cols["items"]):
                yield doc, signer.sign(np.array(items, np.int64).view(np.uint64)).astype(np.uint8).tobytes()

    return map_rows(sets.select("id", "items"), run, "id long, fine binary", 256)


def fine_limit(percent: int, sigmas: float = 4.5) -> int:
    """Differing symbols of the longer signature that similar sets may have."""
    p = (1 - percent / 100) * 255 / 256
    return int(FINE * p + sigmas * (FINE * p * (1 - p)) ** 0.5)


def _residual(members: DataFrame, distance: int, percent: int, block: int, nearest: int | None) -> DataFrame:
    """``u, v`` of different components under one key that may be similar.

    ``members``: ``key, slot, id, root, n, slack, sign, fine``.  Those of a key
    are dealt into blocks of ``block``.  With ``nearest`` a block meets only
    itself, in every key dealt otherwise, and a pair is returned if it is among
    so many nearest of either set there.  Without, every block meets every
    other, but blocks of the key's largest component do not meet each other, and
    a pair is returned under the first key it shares.  Two sets share at most
    what neither's slack takes away."""
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held"))
    keys = sizes.groupBy("key").agg(F.sum("held").alias("total"), F.max(F.struct("held", "root")).alias("most")).where("total > most.held")
    held = members.join(keys, "key").selectExpr("*", f"total <= {block} AS small")
    if nearest is not None:
        dealt = held.selectExpr("*", f"CAST(pmod(xxhash64(id, key), CAST(ceil(total / {block}) AS INT)) AS INT) AS own", "own AS met")
    else:
        dealt = held.selectExpr(
            "*", "root = most.root AS main", f"CAST(ceil((total - most.held) / {block}) AS INT) AS a",
            f"CAST(ceil(most.held / {block}) AS INT) AS b").selectExpr(
            "*", "CASE WHEN small THEN 0 WHEN main THEN a + CAST(pmod(xxhash64(id), b) AS INT) ELSE CAST(pmod(xxhash64(id), a) AS INT) END AS own").withColumn(
            "met", F.expr("explode(CASE WHEN small THEN array(0) WHEN main THEN sequence(0, a - 1) ELSE sequence(0, a + b - 1) END)"))
    rows = dealt.selectExpr("key", "least(own, met) AS i", "greatest(own, met) AS j", "slot", "id", "root", "n", "slack", "sign", "fine", "own",
                            f"{'NOT small' if nearest is not None else 'FALSE'} AS part")
    limit = fine_limit(percent)

    def run(batches):
        group, own = None, []
        for cols in batches:
            for key, i, j, *row in zip(*(cols[c] for c in ("key", "i", "j", "own", "slot", "id", "root", "n", "slack", "sign", "fine", "part"))):
                if (key, i, j) != group:
                    yield from meet(group, own)
                    group, own = (key, i, j), []
                own.append(row)
        yield from meet(group, own)

    def meet(group, own):
        if not own:
            return
        place, slot, ids, roots, sizes, slacks = (np.array([r[k] for r in own]) for k in range(6))
        signs = np.frombuffer(b"".join(r[6] for r in own), "<u2").reshape(len(own), SYMBOLS)
        part = own[0][8]  # of a key whose blocks do not meet: a pair may be together under a later key only
        fine = np.frombuffer(b"".join(r[7] for r in own), np.uint8).reshape(len(own), FINE)
        left, right = np.flatnonzero(place == group[1]), np.flatnonzero(place == group[2])
        for at in range(0, len(left), 32):
            one = left[at:at + 32]
            fits = roots[one, None] != roots[right]
            fits &= 100 * np.minimum(sizes[one, None], sizes[right]) >= percent * np.maximum(sizes[one, None], sizes[right])
            fits &= (100 + percent) * (slacks[one, None] + slacks[right]) <= (100 - percent) * (sizes[one, None] + sizes[right])
            if group[1] == group[2]:
                fits &= ids[one, None] < ids[right]
            x, y = np.nonzero(fits)
            wrong = signs[one[x]] != signs[right[y]]
            far = wrong.sum(axis=1)
            near = np.flatnonzero(far <= distance)
            if not part and len(near):
                near = near[first_shared(wrong[near]) == slot[0]]
            if len(near):
                far = (fine[one[x[near]]] != fine[right[y[near]]]).sum(axis=1)
                near, far = near[far <= limit], far[far <= limit]
            if nearest is not None and len(near):
                near = near[_nearest(x[near], y[near], far, nearest)]
            for u, v in zip(ids[one[x[near]]].tolist(), ids[right[y[near]]].tolist()):
                yield min(u, v), max(u, v)

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = map_rows(dealt, run, "u long, v long")
    return found if nearest is None else found.distinct()  # without, each pair at its first key and one block only


def _nearest(x: np.ndarray, y: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Pairs among the ``k`` nearest of their ``x`` or of their ``y``."""
    keep = np.zeros(len(x), bool)
    for side in (x, y):
        order = np.lexsort((far, side))
        first = np.searchsorted(side[order], side[order])
        keep[order[np.arange(len(x)) - first < k]] = True
    return keep


def first_shared(wrong: np.ndarray) -> np.ndarray:
    """Per row of differing symbols, the place of the first key both have."""
    chunks = wrong.reshape(len(wrong), CHUNKS, WIDTH)
    c = np.argmax(chunks.sum(axis=2) <= 1, axis=1)
    return c * WIDTH + chunks[np.arange(len(wrong)), c].argmax(axis=1)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``id, root`` after links between ids of different components."""
    root = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    named = links.join(root("u"), "u", "left").join(root("v"), "v", "left").select(
        F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    over = components(named).select(F.col("node").alias("below"), F.col("root").alias("top"))
    every = roots.unionByName(over.select(F.col("below").alias("id"), F.col("below").alias("root"))).distinct()
    return staged(every.join(over, F.col("root") == F.col("below"), "left").select("id", F.coalesce("top", "root").alias("root")), "roots")


def roots(classes: DataFrame, docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, distance: int = DISTANCE,
          block: int = BLOCK) -> DataFrame:
    """``id, root`` of classes linked with another: links join sets whose
    similarity is ``percent`` or more and whose signatures differ in
    ``distance`` symbols or fewer.  All are confirmed; links that others
    imply may not be looked at."""
    if distance > DISTANCE:
        raise ValueError("chunks with one wrong symbol cover less than two errors a chunk")
    keys = classes.select("id", F.posexplode(_keys()("sign")).alias("slot", "key"))
    held = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1"), "shared-keys")
    members = staged(keys.join(held.select("key", "hub"), "key"), "key-members")
    star = members.where("id <> hub").selectExpr("hub AS u", "id AS v").distinct()
    side = classes.select("id", "n", "sign")
    near = star.join(side.withColumnsRenamed({"id": "u", "n": "n_u", "sign": "s_u"}), "u").join(
        side.withColumnsRenamed({"id": "v", "n": "n_v", "sign": "s_v"}), "v").where(_sized(percent))
    near = staged(near.where(_distance()("s_u", "s_v") <= distance).select("u", "v"), "candidates")
    sets = _full_sets(near.select(F.col("u").alias("id")).unionByName(near.select(F.col("v").alias("id"))), classes, docs, shingle, "full-sets")
    found = staged(components(_confirmed(near, sets, percent)).select(F.col("node").alias("id"), "root"), "roots")
    kept = None
    # first each set's nearest of one block a key, which joins most of a group in so many rows as it has; then all that is still apart
    for nearest in (NEAREST, None):
        rooted = members.join(found, "id", "left").select("key", "slot", "id", F.coalesce("root", "id").alias("root"))
        # keys of two members have been decided by their star; others are looked at again while they hold several components
        split = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")).where(
            "n > 2 AND least < most")
        rest = staged(rooted.join(split.select("key"), "key"), "residual")
        if kept is None:
            apart = staged(rest.select("id", "root").distinct(), "residual-ids")
            if not apart.limit(1).count():
                break
            sets = _full_sets(apart.select("id"), classes, docs, shingle, "residual-sets")
            # hashes no other component has: there can only be more of them later, so this stays a bound
            kept = staged(_slack(sets, apart).join(side.select("id", "sign"), "id").join(_fine(sets), "id"), "slack")
        # more than this share of a set away, and it has no partner
        full = rest.join(kept, "id").where(f"{percent} * slack <= {100 - percent} * n")
        more = staged(_residual(staged(full, "residual-members"), distance, percent, block, nearest).join(near, ["u", "v"], "left_anti"), "more-candidates")
        found = _joined(found, _confirmed(more, sets, percent))
        near = near.unionByName(more)
    return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, distance: int = DISTANCE,
                    block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Rows link at ``100 * intersection >= percent * union`` of their shingle
    sets.  ``component_id`` is the smallest doc_id reachable, a null id only
    where all ids are null.  Null texts and texts without words have an empty
    set and are linked with nothing; repeated rows and equal sets share their
    component; an empty table gives no rows."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = staged(prints(texts, shingle), "shingle-prints")
    classes = found.where("n > 0").groupBy("own").agg(
        F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sign").alias("sign"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "shingle-classes")  # written: ids stay
    of = staged(classes.select("id", "own", "first").join(roots(classes, texts, percent, shingle, distance, block), "id", "left").select(
        "own", "first", F.coalesce("root", "id").alias("root")), "class-roots")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of.join(least, "root").select("own", "component_id")
    return found.join(named, "own", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias(
            "component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
