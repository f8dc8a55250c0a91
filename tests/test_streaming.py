"""A replayed stream says what the batch says."""

import json
from datetime import date, timedelta

from pyspark.sql import functions as F

from moraine.streaming import incremental


def test_poll_reads_new_files_once(spark, tmp_path):
    name = "NISAR_L2_PR_GOFF_006_098_A_074_007_2000_SH_{0}T125813_{0}T125848_{1}T125814_{1}T125849_X05010_N_F_J_001.h5"
    inbox = tmp_path / "in"
    inbox.mkdir()
    seen: list[str] = []

    def once():
        stream = incremental.new_products(spark, str(inbox), "name string")
        incremental.poll(stream, str(tmp_path / "check"), lambda df, _: seen.extend(r.name for r in df.collect()), F.lit("2026-07-01").cast("date")).awaitTermination()

    (inbox / "a.json").write_text(json.dumps({"name": name.format("20260601", "20260613")}) + "\n" + json.dumps({"name": name.format("20260620", "20260702")}))
    once()
    assert len(seen) == 1
    (inbox / "b.json").write_text(json.dumps({"name": name.format("20260702", "20260714")}))
    once()
    assert len(seen) == 2 and seen[1] != seen[0]


def test_incremental_detector_equals_batch(spark, tmp_path):
    start, total, rows = date(2026, 1, 1), 0.0, [("s", date(2026, 1, 1), 0.0)]
    for d in range(0, 48, 6):
        total += 6 / (0.004 * (60 - d - 3))
        rows.append(("s", start + timedelta(days=d + 6), total))
    for i, part in enumerate((rows[:4], rows[4:6], rows[6:])):
        spark.createDataFrame(part, "series string, epoch date, cumulative double").coalesce(1).write.mode("append").parquet(str(tmp_path / "series"))
        stream = spark.readStream.schema("series string, epoch date, cumulative double").parquet(str(tmp_path / "series"))
        q = incremental.detect(stream, gate=1.0).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).start()
        q.awaitTermination()
        assert i < 3
    alarms = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(alarms) == 1 and abs((alarms[0].fail_date - date(2026, 3, 2)).days) <= 2
