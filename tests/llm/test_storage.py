"""Tables of the shared folder cost few processes beside the JVM, and their checksums are verified."""

from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from moraine.llm.storage import Scratch, written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("write", [lambda df: written(df, "plain"), lambda df: Scratch(df.sparkSession, "plain").put(df)])
def test_fewer_processes_for_a_table(spark, write):
    df = spark.range(10_000, numPartitions=16)

    def faults(run):  # of the JVM's ended children: as many for each
        stat = Path(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/stat")
        before = int(stat.read_text().rpartition(")")[2].split()[8])
        out = run()
        return out, int(stat.read_text().rpartition(")")[2].split()[8]) - before

    folder = written(df, "first").inputFiles()[0].rpartition("/")[0]
    _, usual = faults(lambda: df.write.parquet(folder + "-usual"))
    back, plain = faults(lambda: write(df))
    assert plain < 0.8 * usual
    assert back.dtypes == df.dtypes and sorted(r.id for r in back.collect()) == list(range(10_000))


def test_damaged_page_is_seen(spark):
    back = written(spark.range(1000, numPartitions=1), "damaged", codec="none")
    file = Path(back.inputFiles()[0].removeprefix("file://"))
    data = bytearray(file.read_bytes())
    data[len(data) // 4] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        back.collect()


def test_stages_come_in_few_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(40)
    most = 2 * spark.sparkContext.defaultParallelism
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).rdd.getNumPartitions() <= most, name
