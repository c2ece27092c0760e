from landreach.streaming.classes import people_by_class


def test_stream_equals_batch(spark, data, tmp_path):
    table = spark.read.parquet(f"{data}/flood_accessibility.parquet").select("loaded_at", "run_id", "point_id", "population", "drive_flood_time_min").filter("loaded_at is not null")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = people_by_class(stream, "3650 days").writeStream.outputMode("complete").format("memory").queryName("classes").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.window.start, r.drive_class, r.points, round(r.people, 3))
    got = sorted(map(key, spark.sql("select * from classes").collect()))
    assert got and got == sorted(map(key, people_by_class(table).collect()))
