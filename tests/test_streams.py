from lumenfold.streaming import streams


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_limiter_and_token_cut(spark, tmp_path):
    spark.createDataFrame([("a", i, float(t)) for i, t in enumerate([0, 10, 20, 61, 70, 71])], "account string, id long, t double").coalesce(1).write.parquet(str(tmp_path / "r"))
    got = _run(spark, streams.limited(spark.readStream.schema("account string, id long, t double").parquet(str(tmp_path / "r")), 2), "limited")
    assert [(r.allowed, r.retry_after) for r in sorted(got, key=lambda r: r.id)] == [(True, 0), (True, 0), (False, 41), (True, 0), (False, 1), (True, 0)]
    rows = [("c", 1, "Hello <"), ("c", 2, "b> and <"), ("c", 3, "<EN"), ("c", 4, "D>> hidden"), ("c", 5, "gone"), ("d", 1, "x")]
    spark.createDataFrame(rows, "conv string, seq long, token string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = _run(spark, streams.shown(spark.readStream.schema("conv string, seq long, token string").parquet(str(tmp_path / "t")), "<<END>>"), "shown")
    assert "".join(r.text for r in sorted(got, key=lambda r: r.seq) if r.conv == "c") == "Hello <b> and " and [r.text for r in got if r.conv == "d"] == ["x"]


def test_daily(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(50).select((F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7200)).alias("ts"), F.lit("x").alias("event_type"))
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    got = _run(spark, streams.daily_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))), "daily", "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, streams.daily_counts(df).collect()))


def test_heading_and_order():
    view = streams.Shown("<<", "# H")
    assert [view.add(t) for t in ("# ", "H a <", "b #", " H c", "d")] == ["", "# H a ", "<b ", "", ""] and view.stopped
    view = streams.Shown("<<", None)
    assert view.add("a <") == "a " and view.end() == "<"


def test_tokens_out_of_order_and_late_requests(spark, tmp_path):
    schema = "conv string, seq long, token string"
    for n, rows in enumerate(([("c", 3, "C"), ("c", 1, "A")], [("c", 2, "B"), ("c", 1, "A"), ("c", 4, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        out = streams.drained(streams.shown(spark.readStream.schema(schema).parquet(str(tmp_path / "t")), "<<"), str(tmp_path / "o"))
        assert [r.text for r in out.orderBy("seq").collect()] == [["A"], ["A", "B", "C", ""]][n]
    schema = "account string, id long, t double"
    for n, rows in enumerate(([("a", 1, 100.0)], [("a", 2, 10.0), ("a", 3, 161.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
        out = streams.drained(streams.limited(spark.readStream.schema(schema).parquet(str(tmp_path / "r")), 1), str(tmp_path / "l"))
    assert [(r.id, r.allowed) for r in out.orderBy("id").collect()] == [(1, True), (2, False), (3, True)]


def test_finish_and_kinds(spark, tmp_path):
    schema, seen = "id long, kind string, done boolean", []
    spark.createDataFrame([(1, "content", True), (2, "reasoning", False)], schema).coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "s"))
    reasoning, content = streams.split_kinds(stream)
    assert reasoning.isStreaming and content.isStreaming
    streams.on_finish(stream, [lambda d, n: seen.append((n, [r.id for r in d.collect()]))], str(tmp_path / "k")).awaitTermination(120)
    assert seen == [(0, [1])]

