"""SimHash links, components and substring dedup: against brute force."""

import random
import re

import numpy as np
from helpers import ODD_TEXTS, SMALL, WORD, documents, empty, kept_after_windows, near_roots
from pyspark.sql import functions as F

from ledgerlens.llm import simhash, substring_dedup
from ledgerlens.llm.components import components


def plain_fingerprint(text):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_brute_force(spark):
    texts = ODD_TEXTS + ["one two three four five six"] * 3 + ["ONE two three four five six"]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    prints = [plain_fingerprint(t) for t in texts]
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in range(len(texts))] == near_roots(prints, list(range(len(texts))))


def test_fingerprint_of_slices(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr("ledgerlens.llm.words.word_slices.__defaults__", (100,))
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_links_in_full_buckets(spark):
    """Buckets beyond the limit are cut again and lose no link."""
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    prints = sorted({base ^ rnd.getrandbits(11) << 30 for _ in range(300)}
                    | {base ^ 1 << a ^ 1 << b for a, b in ((0, 1), (0, 40), (33, 62))} | {0, 3, 1 << 63})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, bucket=8)
    for r in links.collect():
        assert bin((r["u"] ^ r["v"]) & (1 << 64) - 1).count("1") <= 2
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert [roots.get(p, p) for p in signed] == near_roots(prints, signed)


def test_keys_are_counted_in_tasks_of_bounded_rows(spark):
    """a small file of many fingerprints is not one task."""
    classes = spark.range(1000).selectExpr("id AS fp").coalesce(1)
    parts = simhash.dealt(classes, 100).rdd.glom().map(len).collect()
    assert len(parts) == 10 and sum(parts) == 1000 and max(parts) < 200
    assert simhash.dealt(spark.range(0).selectExpr("id AS fp")).count() == 0


def test_first_of_groups_reads_prints_of_repeated_ids_only(spark):
    """the fingerprint of a row is made anew only behind the join with the
    ids of several rows."""
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "q r s t u v"), (2, "a b c d"), (3, "m n o p"), (None, "a b c d")]
    kept = simhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(
        [(1, "a b c d"), (1, "q r s t u v"), (3, "m n o p"), (None, "a b c d")], key=str)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_first_of_groups_joins_texts_with_the_ids_that_go(spark, monkeypatch):
    """what meets the texts are ids that go or repeat, not those that stay."""
    held, keep = {}, simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: held.setdefault(name, keep(df, name)))
    rows = [(i, " ".join(f"w{i * k}" for k in range(1, 40))) for i in range(100)]
    rows += [(100, rows[0][1]), (101, rows[3][1]), (5, rows[5][1])]
    kept = simhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(100))
    assert sorted(r["doc_id"] for r in held["other-ids"].collect()) == [5, 100, 101]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(200, 300)] + [(5000, 5000), (7, 6), (6, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 200 for k in range(200, 300)}, 1000: 200}
    assert components(empty(spark, "u long, v long")).collect() == []


def test_near_duplicates_null_ids_and_empty(spark):
    rows = simhash.near_duplicates(documents(spark, ["a b c d"] * 3, [None, 9, 4])).collect()
    assert {r["component_id"] for r in rows} == {4} and len(rows) == 3
    assert simhash.near_duplicates(empty(spark)).collect() == []


def check_dedup(spark, rows, window, gram, bucket):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "dedup": F.lit(1)})
    got = substring_dedup.dedup(df, window=window, gram=gram, bucket_runs=bucket)
    assert got.columns == ["doc_id", "text", "key", "dedup"]
    found = sorted((str(r["doc_id"]), *r["dedup"]) for r in got.collect())
    assert found == sorted((str(d), *x) for d, *x in kept_after_windows(rows, window))


def test_dedup_hot_windows(spark):
    """Few words, null ids and texts, repeated rows; buckets of five, so hot
    minimisers are dealt in parts."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(6)]
    rows = [(i % 70 if i % 9 else None, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40))) if i % 11 else None)
            for i in range(120)]
    rows += [(200 + i, " ".join(words * 3)) for i in range(60)] + [(5, "w1 " * 30)] * 3
    check_dedup(spark, rows, 7, 2, 5)


def test_dedup_whole_windows(spark):
    rnd = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(70))
    text = lambda: " ".join(f"v{rnd.randrange(500)}" for _ in range(rnd.randrange(120)))
    rows = [(i, f"{text()} {passage if i % 3 else ''}\n\t{text()}") for i in range(40)] + list(enumerate(ODD_TEXTS, 100))
    check_dedup(spark, rows, 50, 8, 20_000)


def test_dedup_shuffles_texts_once(spark):
    """after texts are dealt by id and key, neither join moves them again."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        passage = " ".join(f"p{i}" for i in range(60))
        rows = [(i, f"x{i} {passage} y{i}", f"more {i}") for i in range(20)]
        got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, more string"))
        assert [tuple(r) for r in got.select("doc_id", "more", "dedup.n_removed").orderBy("doc_id").collect()] == [
            (i, f"more {i}", 60 if i else 0) for i in range(20)]
        plan = got._jdf.queryExecution().executedPlan().toString()
        left = plan[plan.index("LeftOuter"):].splitlines()
        scan = next(x for x, line in enumerate(left) if "Bucketed: true" in line)
        assert not any("Exchange" in line for line in left[:scan])
        names = [t.name for t in spark.catalog.listTables()]
        assert not any(n.startswith("ledgerlens_") for n in names)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_dedup_by_slices(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"x y {passage} z"), (2, f"a {passage} b c d {passage}")]
    need = [{"first": 1, "n": 31, "mini": 0, "parts": 1}]
    monkeypatch.setattr("ledgerlens.llm.words.word_slices.__defaults__", (30,))
    assert [b for _, b in substring_dedup._bodies(rows[1][1], need, 10)] == [passage]
    assert substring_dedup.kept_words(rows[1][1], [1, 41, 44, 84, 2, 50]) == (84, 83, "a")


def test_equal_windows_are_exact():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 2, 3000)
    starts = np.arange(3000 - 13 + 1)
    same = substring_dedup._equal_windows(ids, starts, 13)
    seen = {}
    for s, k in zip(starts, same.tolist()):
        assert seen.setdefault(tuple(ids[s:s + 13]), k) == k
    assert len(set(seen.values())) == len(seen)


def test_dedup_empty(spark):
    assert substring_dedup.dedup(empty(spark)).collect() == []
