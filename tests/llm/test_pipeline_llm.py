"""The pipeline stage by stage on planted documents; the registered names."""

import random

import __spark_entry__ as entry
import corpus_pipeline as cp


def test_registered():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and 4 <= len(cp.STAGES) <= 5


def test_stages_on_planted_documents(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["ka", "lo", "mi", "re", "su"]) + rnd.choice(["ta", "ne", "vi"]) + str(rnd.randrange(60))
    clean = lambda n=120: " ".join(word() for _ in range(n))
    passage, copy = clean(80), clean(200)
    texts = {i: clean() for i in range(60)}
    texts |= {60: copy, 61: copy, 62: f"{clean()} {passage}", 63: f"{passage} {clean()}",
              64: f"{clean()} token = abcdef123456 {clean(10)}", 65: "too short", 66: "same words again " * 40, 67: None}
    texts |= {70 + i: " ".join(word() + "$$$ %%%" for _ in range(80)) for i in range(20)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 70), 0) for i in [*range(50), *range(70, 84)]], "doc_id long, quality long, toxic long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    by = {}
    for name, stage in cp.STAGES[:4]:
        docs = cp.staged(stage(spark, docs, d), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        by[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(by["quality rules"]) == set(range(65))
    assert set(by["SimHash near-dedup"]) == set(range(65)) - {61}
    cut = by["substring dedup"]
    assert cut[62] == texts[62] and cut[63] == " ".join(texts[63].split()[80:])
    assert all(cut[i] == texts[i] for i in range(61))
    assert by["secret scan"][64] == texts[64].replace("token = abcdef123456", "[SECRET]")
    packed = cp.STAGES[4][1](spark, docs, d)
    assert {r["doc_id"] for r in packed.collect()} == set(cut)
    whole = cp.run(spark, d)
    cols = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(whole.select(cols).collect()) == sorted(packed.select(cols).collect())


def test_stages_keep_any_column(spark, tmp_path):
    """Columns named as the operators' own, null ids and texts, repeated rows."""
    rnd = random.Random(3)
    text = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(70))
    rows = [(i, text()) for i in range(12)] + [(None, text()), (20, None), (None, None), (21, "")]
    rows += [rows[0], (30, rows[1][1]), (31, f"{text()} secret=abcdef99 {rows[2][1]}")]
    extra = ["_n", "_first", "_fp", "_root", "_place", "dedup", "secrets", "TEXT", "key", "x0", "_cut", "a b", "ids", "length"]
    cols = ", ".join(f"`{c}` string" for c in extra)
    spark.conf.set("spark.sql.caseSensitive", "true")  # to make a table with both text and TEXT
    try:
        docs = spark.createDataFrame([(i, t, *[f"{c} of {k}" for c in extra]) for k, (i, t) in enumerate(rows)],
                                     f"doc_id long, text string, {cols}")
        own = docs.columns
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
        kept = cp.quality_rules(spark, docs, str(tmp_path))
        assert kept.columns == own and kept.count() == 16
        for stage in (cp.near_dedup, cp.substring, cp.secrets):
            got = stage(spark, docs, str(tmp_path))
            assert got.columns == own
            found = got.collect()
            for r in found:  # the extra columns are those of one input row
                k = int(r["_n"].split()[-1])
                assert tuple(r)[2:] == tuple(f"{c} of {k}" for c in extra) and r["doc_id"] == rows[k][0]
            if stage is cp.near_dedup:
                assert sorted(str(r["doc_id"]) for r in found) == sorted(map(str, [*range(12), None, None, 20, 31]))
            else:
                assert len(found) == len(rows)
        masked = {r["doc_id"]: r["text"] for r in cp.secrets(spark, docs, str(tmp_path)).collect()}
        assert "[SECRET]" in masked[31] and masked[20] is None
        assert {r["doc_id"] for r in cp.pack(spark, docs, str(tmp_path)).collect()} == {r[0] for r in rows}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_stages_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_near_dedup_clashing_ids(spark, tmp_path):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (5, text("c")), (5, text("c")), (6, text("b")), (7, text("d")),
            (None, text("a")), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"] or -1, r["text"] or "") for r in got.collect()))
    assert kept == [(-1, text("a")), (3, text("a")), (5, text("b")), (5, text("c")), (7, text("d")), (8, "")]
