import struct

import pytest

from accrete.sources import files


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,first,last,age\n1,John,Doe,25\n2,Jane,"Smi, th",30\n3,Michael,Johnson,35\n')
    got = files.read_samples("csv", spark, str(tmp_path), 4, 0, header=True).orderBy("sample_index").collect()
    assert [(r["sample_index"], r["label"], bytes(r["payload"])) for r in got] == [(0, 1, b"John,Doe,25"), (1, 2, b"Jane,Smi, th,30"), (2, 3, b"Michael,Johnson,35")]


@pytest.mark.parametrize("little", [True, False])
def test_records(spark, tmp_path, little):
    fmt = "<H2s" if little else ">H2s"
    (tmp_path / "a.bin").write_bytes(b"".join(struct.pack(fmt, i * 300, bytes([i, 255])) for i in range(5)))
    got = files.record_samples(spark, str(tmp_path), 4, 2, little).orderBy("sample_index").collect()
    assert [(r["label"], bytes(r["payload"])) for r in got] == [(i * 300, bytes([i, 255])) for i in range(5)]


def test_broken_records_fail(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="not whole records"):
        files.record_samples(spark, str(tmp_path), 4, 2).collect()


def test_single_samples(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}.png").write_bytes(bytes([i]))
        (tmp_path / f"s{i}.txt").write_text(f"{i + 10}\n")
    got = files.single_samples(spark, str(tmp_path), ".png", ".txt").collect()
    assert sorted((r["label"], bytes(r["payload"])) for r in got) == [(10, b"\x00"), (11, b"\x01"), (12, b"\x02")]
    assert files.listing(spark, str(tmp_path), ".png").count() == 3


def test_training_sets(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 0, 0), (2, 1.0, 0, 1), (3, 2.0, 1, 0)], "key long, weight double, trigger_id long, partition_id long")
    files.write_training_set(rows, str(tmp_path / "t"))
    files.write_training_set(rows.where("trigger_id = 1").selectExpr("key + 1 as key", "weight", "trigger_id", "partition_id"), str(tmp_path / "t"))
    assert [r["key"] for r in files.read_training_set(spark, str(tmp_path / "t"), 1).collect()] == [4]
    assert sorted(r["key"] for r in files.read_training_set(spark, str(tmp_path / "t"), 0).collect()) == [1, 2]
