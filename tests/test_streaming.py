from postmill.streaming import attempts


def test_first_attempts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", 5), (1, 1, "2024-01-01 00:01:00", 9), (1, 2, "2024-01-01 00:02:00", 7)], "run_id long, endpoint_id long, at string, seen long")
    rows.selectExpr("run_id", "endpoint_id", "timestamp(at) as finished_at", "seen").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = attempts.first_attempts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["run_id", "endpoint_id"])
    q = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["seen"] for r in spark.table("firsts").collect()) == [5, 7]
