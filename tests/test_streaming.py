import shutil

from pyspark.sql import functions as F

from tamnan.streaming import state


def files(spark, sf, path, parts=3):
    e = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").toPandas()
    step = -(-len(e) // parts)
    for i in range(parts):
        spark.createDataFrame(e.iloc[i * step : (i + 1) * step], spark.read.parquet(f"{sf}/events.parquet").schema).coalesce(1).write.parquet(f"{path}/in{i}")
        for name in __import__("glob").glob(f"{path}/in{i}/*.parquet"):
            shutil.move(name, f"{path}/src/part-{i}.parquet")


def test_state_gives_the_rows_of_its_batch_twin(spark, sf, tmp_path):
    (tmp_path / "src").mkdir()
    files(spark, sf, str(tmp_path))
    stream = state.remember(state.read_events(spark, str(tmp_path / "src")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.event_id, r.previous) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.event_id, r.previous) for r in state.remembered(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    assert got == want


def test_ring_keeps_the_newest(spark, sf, tmp_path):
    (tmp_path / "src").mkdir()
    files(spark, sf, str(tmp_path))
    stream = state.read_events(spark, str(tmp_path / "src")).select("event_id", "ts", "user_id")
    q = stream.writeStream.foreachBatch(state.ring_sink(str(tmp_path / "ring"), 20)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.event_id for r in state.ring_table(spark, str(tmp_path / "ring")).collect()}
    want = {r.event_id for r in state.newest(spark.read.parquet(f"{sf}/events.parquet"), 20).collect()}
    assert got == want


def test_time_to_live_is_inclusive(spark):
    rows = [(1, 1, "a", "2024-01-01 00:00:00"), (2, 1, "b", "2024-01-01 00:15:00"), (3, 1, "c", "2024-01-01 00:30:01"), (4, 2, "d", "2024-01-01 00:30:02")]
    e = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, t string").withColumn("ts", F.to_timestamp_ntz("t"))
    assert {r.event_id: r.previous for r in state.remembered(e).collect()} == {1: None, 2: "a", 3: None, 4: None}


def test_a_retried_batch_of_the_ring_writes_the_same(spark, tmp_path):
    path = str(tmp_path / "ring")
    batch = lambda a, b: spark.range(a, b).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts")
    sink = state.ring_sink(path, 5)
    for n in (0, 1, 1, 2):
        sink(batch(n * 4, n * 4 + 4), n)
    assert sorted(r.event_id for r in state.ring_table(spark, path).collect()) == [7, 8, 9, 10, 11]
    assert state.ring_table(spark, str(tmp_path / "none")) is None


def test_requests_are_joined_to_their_replies(spark, tmp_path):
    at = "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m)"
    for name, rows in (("asked", [(1, 0), (2, 5), (3, 6)]), ("replied", [(1, 3), (2, 40), (4, 1)])):
        spark.createDataFrame(rows, "id int, m int").selectExpr("id", f"{at} AS {name}").write.parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n)) for n in ("asked", "replied"))
    q = state.answered(a, b).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
