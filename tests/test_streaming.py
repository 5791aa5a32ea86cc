from quarrystat.streaming.moments import windowed_moments


def test_stream_agrees_with_table(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", float(i)) for i in range(60)], "s long, k string, v double").selectExpr("timestamp_seconds(s * 60) AS ts", "k", "v")
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed_moments(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "ts", "v", ["k"], "10 minutes", "1 minute")
    query = stream.writeStream.format("memory").queryName("moments").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (str(r["start"]), r["k"], r["n"], round(r["mean"], 9), round(r["variance"], 9))
    whole = windowed_moments(spark.read.parquet(f"{tmp_path}/in"), "ts", "v", ["k"], "10 minutes")
    assert sorted(map(key, spark.table("moments").collect())) == sorted(map(key, whole.collect()))
