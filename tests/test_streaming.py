"""The streaming daily totals equal the batch ones on the same files."""

import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.operators import forecast as fc
from ledgerlens.sources.tables import Tables
from ledgerlens.streaming import daily


def test_stream_equals_batch(spark, tmp_path):
    ev = Tables(spark, SF_SMALL).events
    src = str(tmp_path / "landing")
    # two upload batches landing in the folder
    ev.where(F.col("event_id") % 2 == 0).write.parquet(src + "/part1")
    ev.where(F.col("event_id") % 2 == 1).write.parquet(src + "/part2")
    files = spark.read.parquet(src + "/part1", src + "/part2")
    name = f"daily_{uuid.uuid4().hex[:8]}"
    s = daily.daily_totals_stream(spark, src + "/*", files.schema, "ts", "value", "event_type")
    q = daily.start(s, name, sink="memory", mode="complete")
    q.processAllAvailable()
    q.stop()
    got = {(r["sid"], str(r["day"])): round(r["value"], 6) for r in spark.table(name).collect()}
    want = {(r["sid"], str(r["d"])): round(r["y"], 6)
            for r in fc.daily_totals(ev, "ts", "value", "event_type").collect()}
    assert got == want
