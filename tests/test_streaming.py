from pyspark.sql import functions as F

from accrete.streaming import triggers


def stream_of(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "g string, key long, timestamp long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("g string, key long, timestamp long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name).collect()


def test_amount_carries_over(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[("a", i, i) for i in range(5)], [("a", i, i) for i in range(5, 10)]])
    got = drain(triggers.amount_trigger(s, 4, "g"), "amount")
    assert len(got) == 8
    assert sorted(r["trigger_id"] for r in got) == [0] * 4 + [1] * 4


def test_time_windows(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[("a", i, i * 10) for i in range(30)]]).withColumn("at", F.timestamp_seconds("timestamp"))
    got = {r["start"]: r["n"] for r in drain(triggers.time_trigger(s, "60 seconds", "0 seconds"), "windows")}
    assert got[0] == 6
    assert got[60] == 6


def test_ingest_takes_each_file_once(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "key long, label long").write.parquet(str(tmp_path / "in"))
    run = lambda: triggers.ingest(spark, str(tmp_path / "in"), "key long, label long", str(tmp_path / "out"), str(tmp_path / "seen")).awaitTermination()
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    spark.createDataFrame([(3, 4)], "key long, label long").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
