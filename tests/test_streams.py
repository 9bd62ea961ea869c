"""Streams: late rows, expiring state, and the file listing."""

import datetime as dt
import os

from siftlake.plans.registry import QUERIES
from siftlake.sources.shared import new_dir
from siftlake.streaming import ingest
from siftlake.streaming.ingest import first_seen_in


def test_keys_expire_with_the_delay_and_late_rows_are_left_out(spark):
    folder, at = new_dir(spark, "dedup"), lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    schema, got = "k string, at timestamp, n int", None
    arriving = [
        [("a", at(0), 1), ("b", at(1), 2)],
        [("a", at(5), 3)],  # within the delay
        [("c", at(60), 4)],  # the watermark goes to 0:50
        [("a", at(61), 5), ("d", at(10), 6), ("e", at(55), 7)],  # a counts anew, d is late, e isn't
        [("e", at(64), 8), ("a", at(62), 9)],  # both within the delay
    ]
    for rows in arriving:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = first_seen_in(spark, folder, spark.createDataFrame([], schema).schema, ["k"], "at", "10 minutes")
    assert sorted(r.n for r in got.collect()) == [1, 2, 4, 5, 7]


def test_many_batches_share_the_triggers(spark, monkeypatch):
    monkeypatch.setattr(ingest, "TRIGGERS", 4, raising=False)
    folder = new_dir(spark, "drained")
    monkeypatch.setattr(ingest, "work_dir", lambda spark: folder)
    got = ingest.drained(spark, spark.range(95).withColumnRenamed("id", "k"), 10, "k").collect()
    assert sorted((r.k, r.batch) for r in got) == [(k, k // 10) for k in range(95)]
    assert spark.read.text(f"{folder}/state/commits", recursiveFileLookup=True).selectExpr("_metadata.file_path").distinct().count() == 4


def test_the_listing_holds_every_file_once(spark):
    sf = "/root/testdata/sf0.001"
    want = {(os.path.join(d, f), os.path.getsize(os.path.join(d, f)), int(os.path.getmtime(os.path.join(d, f)))) for d, _, fs in os.walk(sf) for f in fs}
    got = QUERIES["scan_files_recursive"](spark, sf).collect()
    assert {(r.path.removeprefix("file:"), r.length, int(r.modificationTime.timestamp())) for r in got} == want and len(got) == len(want)
