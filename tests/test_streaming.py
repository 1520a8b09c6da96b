from pyspark.sql import functions as F

from quire.streaming import operators as S


def feed(spark, path, rows, schema):
    for i, some in enumerate(rows):
        spark.createDataFrame(some, schema).withColumn("ts", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, t)")).coalesce(1).write.mode("append").parquet(path)


def result(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_throttle_and_breaker(spark, tmp_path):
    path = str(tmp_path / "progress")
    feed(spark, path, [[("a", 0.0, False), ("a", 0.1, False), ("a", 0.3, False), ("b", 0.0, False)], [("a", 0.4, False), ("a", 0.45, True)]], "layer string, t double, final boolean")
    src = S.replay(spark, path, "layer string, t double, final boolean, ts timestamp", 1)
    got = result(S.throttle(src), tmp_path, "throttled")
    assert got.count() == 4 and got.where("final").count() == 1
    path = str(tmp_path / "calls")
    feed(spark, path, [[("s", float(i), False) for i in range(5)], [("s", 70.0, True)]], "source string, t double, ok boolean")
    got = result(S.breaker(S.replay(spark, path, "source string, t double, ok boolean, ts timestamp", 1)), tmp_path, "broken")
    assert [r.let_through for r in got.orderBy("ts").collect()] == [True, True, True, False, False, True]


def test_usage_matches_batch(spark, tmp_path):
    path = str(tmp_path / "usage")
    feed(spark, path, [[("k", 1.0, 2.0), ("k", 30.0, 3.0)], [("j", 61.0, 1.0)], [("k", 9000.0, 1.0)]], "key string, t double, v double")
    src = S.replay(spark, path, "key string, t double, v double, ts timestamp", 1)
    got = result(S.usage(src, "ts", "1 minute", "10 minutes", ["key"], "v"), tmp_path, "used")
    want = spark.read.parquet(path).where("t < 8000").groupBy(F.window("ts", "1 minute").alias("w"), "key").agg(F.count("*").alias("n"), F.sum("v").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n", "total")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    path = str(tmp_path / "once")
    feed(spark, path, [[("a", 1.0)], [("a", 2.0), ("b", 2.0)]], "key string, t double")
    assert result(S.once(S.replay(spark, path, "key string, t double, ts timestamp", 1), "key", "ts", "1 hour"), tmp_path, "first").count() == 2


def test_judging(spark, tmp_path):
    path = str(tmp_path / "checks")
    feed(spark, path, [[("r1", 1.0)], [("r2", 2.0), ("r2", 2.0)]], "ref_id string, t double")
    claims = spark.createDataFrame([("c1", "r1"), ("c2", "r2"), ("c3", "r3")], "claim_id string, ref_id string")
    q = S.judge_as_they_land(S.replay(spark, path, "ref_id string, t double, ts timestamp", 1), claims, lambda p: p.select("claim_id", "ref_id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(r.claim_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["c1", "c2"]
